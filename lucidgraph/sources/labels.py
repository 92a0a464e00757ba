"""Target entities with labels: (entity, relation, label), from files of one to three columns or from pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucidgraph.functions.terms import AUX_CLUSTER, AUX_RELATION, valid_id
from lucidgraph.sources.storage import stored
from lucidgraph.sources.triples import fields

#: Names that one task numbers.
NAMES_PER_TASK = 500_000


def read_labels(spark: SparkSession, path: str, default_relation: str = AUX_RELATION, delimiter: str = r"\s+") -> DataFrame:
    """Entity: first column; label: last; relation: the second of three, else the default."""
    rows = spark.read.text(path).filter(valid_id(F.col("value")) & (F.trim("value") != "")).select(fields(F.col("value"), delimiter).alias("f"))
    rows = rows.select(F.slice("f", 1, 3).alias("f"))
    return rows.select(F.col("f")[0].alias("entity"), F.when(F.size("f") > 2, F.get("f", F.lit(1))).otherwise(F.lit(default_relation)).alias("relation"), F.element_at("f", -1).alias("label"))


def cluster_triples(pairs: DataFrame, relation: str = AUX_RELATION, iteration: int = -1) -> DataFrame:
    """(entity, label) -> (s, p, o) with the cluster's name for an iteration."""
    return pairs.select(F.col("entity").alias("s"), F.lit(relation).alias("p"), F.concat(F.lit(AUX_CLUSTER), F.col("label").cast("string"), F.lit(f"_{iteration}")).alias("o"))


def distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def unique_labels(labels: DataFrame) -> DataFrame:
    return labels.select("label").distinct()


def as_mapping(labels: DataFrame, order: str) -> DataFrame:
    """One label per entity: the last by ``order``."""
    return labels.groupBy("entity").agg(F.max_by("label", order).alias("label"))


def aligned(reference: DataFrame, predicted: DataFrame, missing: str = "-2") -> DataFrame:
    """(entity, truth, predicted) for the reference's entities; what isn't predicted gets ``missing``."""
    one = predicted.groupBy("entity").agg(F.max("label").alias("predicted"))
    return reference.select("entity", F.col("label").alias("truth")).join(one, "entity", "left").withColumn("predicted", F.coalesce("predicted", F.lit(missing)))


def dictionary(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, id): ids from 0 in the order of names, without gaps.

    Ids come from a count per range of names and the place in the range, so that no task sorts all names.
    """
    distinct = stored(names.select(F.col(column).alias("name")).filter("name IS NOT NULL").distinct(), "names")
    ranges = max(1, -(-distinct.count() // NAMES_PER_TASK))
    rows = stored(distinct.repartitionByRange(ranges, "name").withColumn("_range", F.spark_partition_id()), "name-ranges")
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each range
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("name")) - 1
    return rows.withColumn("_place", place).join(F.broadcast(before), "_range").select("name", (F.col("_before") + F.col("_place")).cast("long").alias("id"))
