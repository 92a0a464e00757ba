"""The corpus pipeline: each stage is one of the corpus operators, over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.llm import decontamination, mixing, perplexity, sharding, simhash
from lucidgraph.llm.shared import table, written

#: Shards of the result, all of one weight.
SHARDS = 40


#: Columns that the operators read; a document's others travel in one, so that no name of theirs clashes.
READ = ("doc_id", "text", "lang", "source")
OTHERS = "_document"


def apart(docs: DataFrame) -> DataFrame:
    others = [F.col(f"`{c}`") for c in docs.columns if c not in READ]
    return docs.select(*READ, F.struct(*others).alias(OTHERS)) if others else docs.select(*READ)


def together(rows: DataFrame, columns: list[str]) -> list:
    """The documents' columns, by their names."""
    return [rows[c] if c in READ else rows[OTHERS][c].alias(c) for c in columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limits; trusted are those that ``labels`` trusts."""
    kept = perplexity.keep_good(apart(docs), table(spark, sf_dir, "labels"))
    return kept.select(*together(kept, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.deduplicate(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = mixing.emit(mixing.mix(apart(docs)))
    return rows.select(*together(rows, docs.columns))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot, which take the place of columns of their names."""
    rows = sharding.shard_records(apart(docs), [1.0] * SHARDS)
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return rows.select(*together(rows, [c for c in docs.columns if c not in new]), *new)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("leaks", leaks), ("mix", mix), ("shards", shards)]

#: Neither the language model nor XXH64 can be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    out = STAGES[-1][1](spark, docs, sf_dir)
    return out
