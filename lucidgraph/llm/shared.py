"""The folder that driver and executors share, and small helpers used by several operators."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words in every contract of this package: space, and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    The setting is read from the session. Only where it is unset, as in tests on one machine, a temporary folder is
    made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{qualified(spark, base)}/{what}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as tasks that don't go through Spark's readers need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def _written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and outlives executors."""
    return _written_at(df, shared_dir(df.sparkSession, what))


class Scratch:
    """Tables in the shared folder that are removed at the end of the ``with`` block.

    Nothing that is read after the block may be computed from them: their last use is a table written elsewhere, or rows
    that came to the driver. Then no stage that a lost executor has run again can miss them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_dir(spark, "scratch")

    def place(self, what: str) -> str:
        return f"{self.folder}/{what}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, what: str) -> DataFrame:
        return _written_at(df, self.place(what))

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: The column that names a row's part.
PART = "_part"


def in_parts(df: DataFrame, what: str, scratch: Scratch | None = None) -> DataFrame:
    """``df`` written to the shared folder, or to ``scratch``, with the part - the task that wrote it - of each row.

    What tasks ask for by part in one pass over the rows can be looked up elsewhere and handed to them by part in the
    next, whatever tasks then read the rows.
    """
    return (scratch.written if scratch else written)(df.withColumn(PART, F.spark_partition_id()), what)


def by_part(answers: DataFrame, what: str, scratch: Scratch | None = None) -> str:
    """Writes rows (part, ...), sorted, in a folder for each part; returns where."""
    uri = scratch.place(what) if scratch else shared_dir(answers.sparkSession, what)
    n = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers.repartition(n, "part").sortWithinPartitions(*answers.columns).write.option("compression", "zstd").partitionBy("part").parquet(uri)
    return uri


class PartReader:
    """In a task: the rows that ``by_part`` wrote for a part. The last one read is kept."""

    def __init__(self, uri: str, columns: list[str]):
        self.uri, self.columns, self.part, self.rows = uri, columns, None, None

    def read(self, part: int):
        """An Arrow table, or None if nothing was written for the part."""
        if part != self.part:
            import pyarrow.dataset as ds
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(f"{self.uri}/part={part}")
            here = store.get_file_info(path).type.name != "NotFound"
            self.part = part
            self.rows = ds.dataset(path, filesystem=store, format="parquet").to_table(columns=self.columns) if here else None
        return self.rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; null text: none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(spaced, " "), "")


def hashed(*parts: Column) -> Column:
    """32 bits of the MD5 of the parts' texts, null as an empty text: a hash that SQL engines share."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 8), 16, 10).cast("long")


#: Rows that one task puts in order for running sums.
ROWS_PER_TASK = 200_000


def with_sums_before(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its column over all rows before the own one; ``order`` has no ties.

    Rows are dealt by ranges of the order; each range has its own window, and the ranges' totals - a row each - are
    added up apart. No window holds all rows.
    """
    ranges = max(1, -(-df.count() // ROWS_PER_TASK))
    rows = df.withColumns({f"_own_{n}": c for n, c in sums.items()}).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    rows = written(rows, "ranges")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_range").agg(*[F.sum(f"_own_{n}").alias(f"_own_{n}") for n in sums])
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_own_{n}").over(before(Window.orderBy("_range"))), F.lit(0)).alias(f"_earlier_{n}") for n in sums])
    inside = before(Window.partitionBy("_range").orderBy(*order))
    rows = rows.join(F.broadcast(offsets), "_range")
    out = {n: F.col(f"_earlier_{n}") + F.coalesce(F.sum(f"_own_{n}").over(inside), F.lit(0)) for n in sums}
    return rows.withColumns(out).select(*df.columns, *sums)


#: Rows of an Arrow batch of whole texts; Spark's own number is meant for short rows.
TEXT_ROWS = 1_000


def text_batches(spark: SparkSession) -> None:
    """Has the session hand texts to Python in smaller batches, unless it has been told a number."""
    name, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, usual) == usual:
        spark.conf.set(name, str(TEXT_ROWS))


def by_value(module) -> None:
    """Ships the module's functions inside the task, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(module)


by_value(sys.modules[__name__])
