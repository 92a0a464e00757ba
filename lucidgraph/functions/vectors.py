"""Vector functions over array<float> or array<double> columns, with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column, order: float = 2) -> Column:
    if order == 1:
        return _sum(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.sqrt(dot(a, a)) if order == 2 else F.pow(_sum(F.transform(a, lambda x: F.pow(F.abs(x.cast("double")), F.lit(float(order))))), F.lit(1.0 / order))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def euclidean(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def cosine_similarity(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def clipped(a: Column, most: float = 1.0) -> Column:
    """A vector with its norm cut to ``most``."""
    n = norm(a)
    scale = F.when(n > most, F.lit(most) / n).otherwise(F.lit(1.0))
    return F.transform(a, lambda x: x.cast("double") * scale)


def transe(s: Column, p: Column, o: Column, order: float = 1) -> Column:
    return -norm(minus(plus(s, p), o), order)


def distmult(s: Column, p: Column, o: Column) -> Column:
    return _sum(times(times(s, p), o))


def complex_score(s: Column, p: Column, o: Column) -> Column:
    """Real parts in the first half of a vector, imaginary ones in the second."""
    half = lambda v: (F.slice(v, F.lit(1), (F.size(v) / 2).cast("int")), F.slice(v, (F.size(v) / 2).cast("int") + 1, (F.size(v) / 2).cast("int")))
    (sr, si), (pr, pi), (or_, oi) = half(s), half(p), half(o)
    return distmult(sr, pr, or_) + distmult(si, pr, oi) + distmult(sr, pi, oi) - distmult(si, pi, or_)


def soft_assignment(points: DataFrame, centres: DataFrame, point: str = "id", centre: str = "centre", vec: str = "vec", alpha: float = 1.0) -> DataFrame:
    """(point, centre, q, p): Student-t similarity of each point to each centre, and the sharpened target q^2 / sum q.

    The centres are few (one per cluster) and go to all tasks.
    """
    pairs = points.select(point, F.col(vec).alias("_v")).join(F.broadcast(centres.select(centre, F.col(vec).alias("_c"))), F.lit(True))
    d = euclidean(F.col("_v"), F.col("_c"))
    raw = F.pow(1.0 / (1.0 + d * d / alpha), F.lit((alpha + 1.0) / 2.0))
    q = pairs.withColumn("_r", raw).withColumn("q", F.col("_r") / F.sum("_r").over(Window.partitionBy(point)))
    share = q.groupBy(centre).agg(F.sum("q").alias("_f"))
    q = q.join(F.broadcast(share), centre).withColumn("_w", F.col("q") * F.col("q") / F.col("_f"))
    return q.select(point, centre, "q", (F.col("_w") / F.sum("_w").over(Window.partitionBy(point))).alias("p"))
