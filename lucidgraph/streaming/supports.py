"""Supports of rules over a stream of triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lucidgraph.operators.mining import supports
from lucidgraph.plans.rules import Rule

TRIPLES = "s string, p string, o string"


class RunningSupports:
    """Keeps the triples seen and each rule's supports, which are counted anew only for rules with a predicate that came.

    State is two Parquet folders: the triples, one part per micro-batch, and the supports, one version per micro-batch
    and rule. A batch that is repeated after a failure overwrites its own part, so results are counted once.
    """

    def __init__(self, spark: SparkSession, rules: Sequence[Rule], labels: DataFrame, path: str):
        self.spark, self.rules, self.labels, self.path = spark, list(rules), labels, path

    def add(self, batch: DataFrame, number: int) -> None:
        batch = batch.select("s", "p", "o").distinct()
        batch.write.mode("overwrite").parquet(f"{self.path}/triples/batch={number}")
        came = {r["p"] for r in batch.select("p").distinct().collect()}
        touched = [r for r in self.rules if came & set(r.predicates())]
        if touched:
            supports(self.triples(), touched, self.labels).write.mode("overwrite").parquet(f"{self.path}/supports/batch={number}")

    def triples(self) -> DataFrame:
        return self.spark.read.schema(f"{TRIPLES}, batch long").parquet(f"{self.path}/triples").select("s", "p", "o").distinct()

    def current(self) -> DataFrame:
        """(rule_id, cluster, support, size): the last count of each rule."""
        rows = self.spark.read.schema("rule_id string, cluster string, support long, size long, batch long").parquet(f"{self.path}/supports")
        last = F.max(F.struct("batch", "support", "size")).alias("x")
        return rows.groupBy("rule_id", "cluster").agg(last).select("rule_id", "cluster", "x.support", "x.size")

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
