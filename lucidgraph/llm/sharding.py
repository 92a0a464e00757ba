"""Rendezvous hashing of stable record keys over weighted shards.

Each (key, shard) pair has a pseudo-random score; a record goes to the shard with the highest one. A shard that is
added can only win records for itself, so growing from N to N + 1 shards moves about 1 / (N + 1) of the records and
none between old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucidgraph.llm.shared import hashed, table

#: Shards of the query, all of one weight.
SHARDS = 40
#: Rows that one numbering task should get.
ROWS_PER_BUCKET = 20_000


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard (0 to len(weights) - 1) of a key: the largest -weight / ln(u), u uniform from the pair's hash.

    u is of 52 bits of the MD5 of seed, shard and key. A null key is hashed as the text ``null``. Ties go to the smaller shard.
    A weight of 0 or less takes the shard out.
    """
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scores = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            continue
        # half a step off both ends of (0, 1)
        u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{shard}:"), text)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("back")))
    if not scores:
        raise ValueError("at least one shard needs a weight above 0")
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["back"]).cast("int")


def shard_records(
    docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", seed: int = 0, grown_weight: float = 1.0
) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to every row.

    Null text counts as empty; null keys share one shard; repeated rows get slots of their own; an empty table gives
    an empty result. Columns of these names in ``docs`` are replaced. Slots run from 0 without gaps within a shard, in
    the order of (bucket, key, crc, size); a shard is numbered in buckets by a hash of key and text, whose offsets come
    from one count per bucket, so no task sorts a whole shard, and rows of one key spread if their texts differ.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    n = docs.select(key).count()
    buckets = max(1, -(-n // (ROWS_PER_BUCKET * max(1, sum(w > 0 for w in weights)))))
    buckets = max(buckets, 8)
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "_bucket", "_before", "_tail"]
    base = docs.drop(*[c for c in new if c not in (key, text)])
    bucket = F.pmod(hashed(F.col(key), F.crc32(body.cast("binary"))), F.lit(buckets))
    rows = base.withColumns(
        {
            "size": F.octet_length(body).cast("long") + 16,
            "text_crc32": F.crc32(body.cast("binary")),
            "law": F.lit("key"),
            "shard": rendezvous(F.col(key), weights, seed),
            "grown_shard": rendezvous(F.col(key), [*weights, grown_weight], seed),
            "_bucket": bucket,
        }
    )
    keys = docs.select(rendezvous(F.col(key), weights, seed).alias("shard"), bucket.alias("_bucket"))
    # one row per shard and bucket: at most len(weights) * buckets
    counts = keys.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(F.col(key).asc_nulls_last(), "text_crc32", "size")
    return (
        rows.withColumn("_tail", F.row_number().over(inside).cast("long") - 1)
        .join(offsets, ["shard", "_bucket"])
        .withColumn("slot", F.col("_before") + F.col("_tail"))
        .drop("_bucket", "_before", "_tail")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; a large shard is written by many tasks."""
    sharded.write.partitionBy("shard").parquet(path)


def assign_shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", seed: int = 0, column: str = "shard") -> DataFrame:
    """Only the shard of each row: no shuffle."""
    return docs.withColumn(column, rendezvous(F.col(key), weights, seed))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shard_records(docs, [1.0] * SHARDS)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _best(shards: int) -> str:
    u = "(CAST('0x' || substr(md5('0:' || s || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496"
    return f"list_reduce(list_transform(range(0, {shards}), lambda s: {{'score': -1 / ln({u}), 'shard': s}}), lambda x, y: CASE WHEN y.score > x.score THEN y ELSE x END).shard"


#: CRC-32 by its table of 256 remainders, byte after byte.
OP6_SQL = rf"""
WITH RECURSIVE remainders AS (SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(0, 256) AS r(i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT rid, doc_id, length(h) // 2 AS n, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
c AS (SELECT rid, doc_id, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM b CROSS JOIN remainders),
s AS (SELECT rid, doc_id, n, crc, {_best(SHARDS)} AS shard, {_best(SHARDS + 1)} AS grown_shard,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || crc), 1, 8) AS BIGINT) % (SELECT greatest(8, (count(*) + {ROWS_PER_BUCKET * SHARDS - 1}) // {ROWS_PER_BUCKET * SHARDS}) FROM documents) AS bucket FROM c)
SELECT doc_id, n + 16 AS size, crc AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS LAST, crc, n) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM s
"""
