"""Triples (s, p, o): files, lists, named graphs, joint sources, place holders."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.functions.terms import AUX_RELATION, add_braces, entity_url, relation_url, unquoted, valid_id

TRIPLE = "s string, p string, o string"


def formatted(df: DataFrame, prefix: str = "", quoted: bool = False) -> DataFrame:
    """Entities and relations as full URLs."""
    return df.withColumns({"s": entity_url(F.col("s"), prefix, quoted), "p": relation_url(F.col("p"), prefix), "o": entity_url(F.col("o"), prefix, quoted)})


def fields(value: Column, delimiter: str = r"\s+") -> Column:
    return F.split(F.trim(F.regexp_replace(value, r"[\r\n]+$", "")), delimiter)


def read_triples(spark: SparkSession, path: str, prefix: str = "", quoted: bool = False, delimiter: str = r"\s+") -> DataFrame:
    """The first three fields of each line; lines with a backslash in any field or with fewer fields are left out.

    Every token is a string: ``NA`` and ``null`` too.
    """
    rows = spark.read.text(path).filter(valid_id(F.col("value")) & (F.trim("value") != "")).select(fields(F.col("value"), delimiter).alias("f"))
    rows = rows.filter(F.size("f") >= 3).select(*[F.col("f")[i].alias(c) for i, c in enumerate("spo")])
    return formatted(rows, prefix, quoted) if prefix or quoted else rows


def from_list(spark: SparkSession, rows: Iterable[Sequence[str]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], TRIPLE)


def joint(*sources: DataFrame) -> DataFrame:
    """All rows of all sources, repeats included."""
    return reduce(DataFrame.unionByName, sources)


def place_holders(spark: SparkSession, clusters: int = 10, iterations: int = 10, prefix: str = "http://execute_aux.org/", relation: str = AUX_RELATION) -> DataFrame:
    """One triple for each cluster and each iteration from -1 on, so that later names are known to a model."""
    rows = spark.range(clusters).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(-1), F.lit(iterations))).alias("i"))
    return rows.select(
        F.format_string(f"{prefix}auxC%d_%d", "c", "i").alias("s"), F.lit(relation).alias("p"), F.format_string(f"{prefix}aux_dummy_entity_%d_%d", "c", "i").alias("o")
    )


def index(triples: DataFrame, graph: str) -> DataFrame:
    """(g, s, p, o) without repeats: a named graph is a set."""
    return triples.select(F.lit(graph).alias("g"), "s", "p", "o").distinct()


def graphs(quads: DataFrame, names: Sequence[str]) -> DataFrame:
    """The union of named graphs, as a set."""
    return quads.filter(F.col("g").isin(list(names))).select("s", "p", "o").distinct()


def write_quads(quads: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per graph, so that reading some graphs reads only theirs. A common predicate is dealt by its subjects."""
    quads.select("g", "s", "p", "o").dropDuplicates().repartitionByRange("g", "p", "s").write.partitionBy("g").mode(mode).parquet(path)


def graph_exists(quads: DataFrame, graph: str) -> bool:
    return quads.filter(F.col("g") == graph).limit(1).count() > 0


def dropped(quads: DataFrame, graph: str) -> DataFrame:
    return quads.filter(F.col("g") != graph)


def triple_lines(df: DataFrame, braces: bool = False, unquote_urls: bool = True) -> DataFrame:
    cols = [F.col(c) for c in "spo"]
    cols = [unquoted(c) for c in cols] if unquote_urls else cols
    cols = [add_braces(c) for c in cols] if braces else cols
    return df.select(F.concat_ws("\t", *cols).alias("value"))


def write_triples(df: DataFrame, path: str, braces: bool = False, unquote_urls: bool = True) -> None:
    triple_lines(df, braces, unquote_urls).write.mode("overwrite").text(path)


def fact_lines(df: DataFrame, braces: bool = False) -> DataFrame:
    cols = [add_braces(F.col(c)) if braces else F.col(c) for c in "pso"]
    return df.select(F.concat(cols[0], F.lit("("), cols[1], F.lit(","), cols[2], F.lit(")")).alias("value"))


def subject_object_relation(lines: DataFrame) -> DataFrame:
    """Lines of head, relation, tail as head, tail, relation; other lines stay."""
    f = F.split(F.trim("value"), r"\s+")
    return lines.select(F.when(F.size(f) == 3, F.concat_ws("\t", f[0], f[2], f[1])).otherwise(F.col("value")).alias("value"))
