"""The driver's tables as a graph: named graphs of triples, and labelled entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (graph, table, key column, subject kind, relation, object kind, object column)
FACTS = (
    ("nation", "nation", "n_nationkey", "nation", "inRegion", "region", "n_regionkey"),
    ("customer", "customer", "c_custkey", "customer", "inNation", "nation", "c_nationkey"),
    ("supplier", "supplier", "s_suppkey", "supplier", "inNation", "nation", "s_nationkey"),
    ("part", "part", "p_partkey", "part", "brand", "brand", "p_brand"),
    ("part", "part", "p_partkey", "part", "kind", "kind", "p_type"),
    ("part", "part", "p_partkey", "part", "size", "size", "p_size"),
    ("orders", "orders", "o_orderkey", "order", "placedBy", "customer", "o_custkey"),
    ("orders", "orders", "o_orderkey", "order", "priority", "priority", "o_orderpriority"),
    ("orders", "orders", "o_orderkey", "order", "status", "status", "o_orderstatus"),
    ("lineitem", "lineitem", "l_orderkey", "order", "hasPart", "part", "l_partkey"),
    ("lineitem", "lineitem", "l_orderkey", "order", "hasSupplier", "supplier", "l_suppkey"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quads(spark: SparkSession, sf_dir: str, graphs: tuple[str, ...] | None = None) -> DataFrame:
    """(g, s, p, o); each table is scanned once, for all its relations."""
    out = None
    for g in dict.fromkeys(f[0] for f in FACTS if graphs is None or f[0] in graphs):
        own = [f for f in FACTS if f[0] == g]
        node = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))
        facts = F.array(*[F.struct(node(k, key).alias("s"), F.lit(p).alias("p"), node(ok, oc).alias("o")) for _, _, key, k, p, ok, oc in own])
        rows = table(spark, sf_dir, own[0][1]).select(F.lit(g).alias("g"), F.inline(facts))
        rows = rows.distinct() if g == "lineitem" else rows
        out = rows if out is None else out.unionByName(rows)
    return out


def graph(spark: SparkSession, sf_dir: str, graphs: tuple[str, ...] | None = None) -> DataFrame:
    return quads(spark, sf_dir, graphs).select("s", "p", "o")


def customers_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("entity"), F.lit("livesIn").alias("relation"), F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")).alias("label"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def quads_sql(graphs: tuple[str, ...] | None = None) -> str:
    parts = [f"SELECT '{g}' AS g, '{k}/' || {key} AS s, '{p}' AS p, '{ok}/' || {oc} AS o FROM {t}" for g, t, key, k, p, ok, oc in FACTS if graphs is None or g in graphs]
    return "SELECT DISTINCT g, s, p, o FROM (" + " UNION ALL ".join(parts) + ")"


def graph_sql(graphs: tuple[str, ...] | None = None) -> str:
    return f"SELECT DISTINCT s, p, o FROM ({quads_sql(graphs)})"


CUSTOMERS_SQL = "SELECT 'customer/' || c_custkey AS entity, 'livesIn' AS relation, 'region/' || n_regionkey AS label FROM customer JOIN nation ON c_nationkey = n_nationkey"
