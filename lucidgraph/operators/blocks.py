"""All pairs of vectors, block against block: a task holds two blocks, whatever the number of points."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lucidgraph.sources.storage import stored

#: Points of a block, and pairs of blocks whose rows are put in order together.
BLOCK, SORTED = 1024, 2


def distance_matrix(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        return np.clip(1 - unit(x) @ unit(y).T, 0, 2)
    q = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(q, 0))


class Space:
    """Gaps between the rows of a matrix: squared distances, or cosine ones, with what each row needs worked out once.

    Gaps below ``least`` count as that much.
    """

    def __init__(self, x: np.ndarray, metric: str, least: float = 0.0):
        self.metric, self.least = metric, least
        self.x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x
        self.squares = (self.x * self.x).sum(1)

    def take(self, rows: np.ndarray) -> "Space":
        out = object.__new__(Space)
        out.metric, out.least, out.x, out.squares = self.metric, self.least, self.x[rows], self.squares[rows]
        return out

    def gaps(self, of: "Space") -> np.ndarray:
        """A row for each row here, a column for each of ``of``."""
        q = self.x @ of.x.T
        if self.metric == "cosine":
            np.subtract(1, q, out=q)
        else:
            q *= -2
            q += self.squares[:, None]
            q += of.squares[None, :]
        return np.clip(q, self.least, 2 if self.metric == "cosine" else None, out=q)


def over_pairs(points: DataFrame, columns: list[str], schema: str, handle: Callable[[dict, dict], dict], once: bool = False, sort: str | None = None) -> DataFrame:
    """``handle`` of every ordered pair of blocks, a block with itself included: a dict of lists by column of ``schema``.

    ``points`` has vec and ``columns``; a block is a dict of lists, a matrix under "vec", and its number under "block".
    Blocks are by a hash of the row, of ``BLOCK`` points on average; the table of blocks is written once and joined with itself, so
    that pairs of blocks are what is dealt to tasks, not pairs of points. ``once``: of two blocks' two orders only one, and
    blocks are of neighbours in the order of the first column, so that those of the first block come before the second's.
    ``sort``: a column of numbers; rows of some pairs of blocks go out in its order, so that equal ones follow each other and
    files are smaller.
    """
    n = points.count()
    blocks = max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in columns]), F.lit(blocks))
    if once:
        points = points.repartitionByRange(-(-blocks // 4), columns[0]).sortWithinPartitions(columns[0])
        block = F.floor(F.monotonically_increasing_id() / BLOCK)
    rows = points.select(block.alias("_b"), F.struct(*columns, F.col("vec").cast("array<double>").alias("vec")).alias("_r"))
    held = stored(rows.groupBy("_b").agg(F.collect_list("_r").alias("_r")).repartition(min(blocks, 200), "_b"), "blocks")
    if once:
        held = held.repartition(min(blocks, 16))
    pairs = held.select(F.col("_b").alias("na"), F.col("_r").alias("a")).join(held.select(F.col("_b").alias("nb"), F.col("_r").alias("b")), F.expr("na <= nb") if once else None, "inner" if once else "cross")

    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for name in ("a", "b"):
                    own = batch.column(name).slice(i, 1).flatten()
                    side = {c: own.field(c).to_pylist() for c in columns}
                    sides.append(side | {"vec": np.array(own.field("vec").to_pylist(), float).reshape(len(own), -1), "block": batch.column(f"n{name}")[i].as_py()})
                out = handle(*sides)
                yield pa.RecordBatch.from_pydict(out, schema=kinds)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = run(batches)
        while some := list(itertools.islice(made, SORTED)):
            table = pa.Table.from_batches(some).combine_chunks()
            del some
            order = np.argsort(table[sort].to_numpy())
            for f in range(0, len(order), 1 << 17):
                yield from table.take(pa.array(order[f : f + (1 << 17)])).to_batches()

    return pairs.mapInArrow(in_order if sort else run, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
