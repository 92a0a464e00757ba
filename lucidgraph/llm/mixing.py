"""Mixing sources to target weights by systematic sampling.

Each document's expected copies (its source's rate) are prefix-summed within the source, one random offset per source
is added, and a document is emitted once for every integer boundary that its interval crosses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucidgraph.llm.shared import hashed, table, with_sums_before, words, written

#: Documents of one source and size are ranked in buckets: so many at least, and one for each so many rows of the table.
BUCKETS, ROWS_PER_BUCKET = 64, 20_000


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """``sizes`` (source, source_size and others) plus target: one row per source.

    Sources in code point order, null last, take ``weights`` in turn and share ``budget`` times all sizes. A target
    stops at ``cap`` times its source's size and the excess goes to the others by weight until none is above. That is
    filling to a common level: sources in the order of cap / weight stop while the level is above their own.
    """
    source = F.col("source").asc_nulls_last()
    rows = with_sums_before(sizes, [source], {"_place": F.lit(1)})
    turn = (F.pmod(F.col("_place"), F.lit(len(weights))) + 1).cast("int")
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    rows = with_sums_before(rows.withColumn("stops", F.col("most") / F.col("weight")), [F.col("stops"), source], {"_most": F.col("most"), "_weight": F.col("weight")})
    rows = written(rows, "mix-levels")
    whole = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    # the level if all sources before this one stop at their cap and the others do not
    level = (F.lit(float(whole["size"] or 0) * float(budget)) - F.col("_most")) / (F.lit(float(whole["weight"] or 0)) - F.col("_weight"))
    rows = rows.withColumn("level", level)
    # of sources that stop at the same level, the first
    first = F.min(F.struct("stops", (-F.col("level")).alias("less")))
    least = rows.filter(F.col("level") * F.col("weight") <= F.col("most")).agg(first.alias("x")).first()["x"]
    target = F.col("most") if least is None else F.least(F.lit(-least["less"]) * F.col("weight"), F.col("most"))
    return rows.select(*sizes.columns, target.alias("target"))


def offset_of(name: Column, seed: int) -> Column:
    """A number in [0, 1) from a source's key and the seed: reruns agree."""
    return hashed(F.lit(seed), name).cast("double") / F.lit(float(1 << 32))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    budget: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Every row with size (words), source_size, target, copies and taken (copies x size).

    Within a source, rows are taken in the order (size, bucket, key, hash of the text), so that the sample is spread over
    all sizes and the taken words come near the target, and reruns take the same texts. A bucket is a hash of key and
    text, so only rows that agree in both must share one. Null text: size 0. Null source: a source of its own, the last.
    Null keys: last among equals. Repeated rows are rows of their own. A source without words has target 0 and its rows
    are not copied. An empty table gives an empty result. Columns of these names in ``docs`` are replaced.

    A rank within the source is the number of rows of smaller sizes, plus those of the size in buckets before, plus the
    place in the own bucket: no task holds a source, and the rows move once.
    """
    buckets = max(BUCKETS, -(-docs.count() // ROWS_PER_BUCKET))
    new = ["size", "source_size", "target", "copies", "taken", "_source", "_bucket", "_before", "_place"]
    base = docs.drop(*[c for c in new if c not in (key, text, source)])
    # never null, so that windows and joins on it share one exchange
    named = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    rows = base.withColumns(
        {
            "size": F.size(words(F.col(text))).cast("long"),
            "_source": named,
            "_bucket": F.pmod(hashed(F.col(key), F.col(text)), F.lit(buckets)),
        }
    )
    groups = written(rows.groupBy("_source", "size", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "mix-counts")
    of_size = groups.groupBy("_source", "size").agg(F.sum("_n").alias("_n"))
    smaller = Window.partitionBy("_source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    of_size = of_size.select("_source", "size", F.coalesce(F.sum("_n").over(smaller), F.lit(0)).alias("_smaller"))
    sizes = groups.groupBy("_source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"))
    sizes = sizes.withColumn("source", F.when(F.col("_source") != "n", F.expr("substring(_source, 2)")))
    targets = source_targets(sizes, weights, budget, cap)
    earlier = Window.partitionBy("_source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = groups.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n").join(of_size, ["_source", "size"])
    plan = plan.withColumn("_before", F.col("_before") + F.col("_smaller")).drop("_smaller").join(targets.drop("source"), "_source")
    inside = Window.partitionBy("_source", "size", "_bucket").orderBy(F.col(key).asc_nulls_last(), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    ranked = rows.withColumn("_place", F.row_number().over(inside).cast("long") - 1)
    joined = ranked.join(plan, ["_source", "size", "_bucket"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = (F.col("_before") + F.col("_place")).cast("double")
    offset = offset_of(F.col("_source"), seed)
    copies = F.floor(rate * (start + 1) + offset) - F.floor(rate * start + offset)
    joined = joined.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return joined.select(*base.columns, "size", "source_size", "target", "copies", "taken")


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies."""
    return mixed.filter(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_copy")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 8) AS BIGINT) % (SELECT greatest({BUCKETS}, (count(*) + {ROWS_PER_BUCKET - 1}) // {ROWS_PER_BUCKET}) FROM documents) AS bucket, md5(coalesce(text, '')) AS body, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS DOUBLE) AS weight,
             source_size * 2.0::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM w),
v AS (SELECT arg_min(own, (most / weight, -own)) AS level FROM l WHERE own * weight <= most),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN most ELSE least(level * weight, most) END AS target FROM l CROSS JOIN v),
r AS (SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.bucket, d.doc_id, d.body) - 1 AS DOUBLE) AS before,
             CAST(('0x' || substr(md5('7:' || CASE WHEN d.source IS NULL THEN 'n' ELSE 's' || d.source END), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS shift
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(rate * (before + 1) + shift) - floor(rate * before + shift) AS BIGINT) * size AS taken FROM r
"""
