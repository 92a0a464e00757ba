"""Rule measures from supports and cluster sizes, as columns. Zero denominators give null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ("c_coverage", "n_coverage", "x_coverage", "wr_acc", "tfidf")


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def coverage() -> Column:
    return _ratio(F.col("support"), F.col("size"))


def measure_columns() -> dict[str, Column]:
    """Over a row's support, size, and of the other clusters: o_cov_max, o_cov_sum, o_support, o_size, o_n, and
    n_with (clusters with support, own included)."""
    c = coverage()
    w = _ratio(F.col("support") + F.col("o_support"), F.col("size") + F.col("o_size"))
    return {
        "c_coverage": c,
        "n_coverage": _ratio(c, F.col("o_cov_sum") + c),
        "x_coverage": F.when(F.col("o_n") == 0, c).otherwise(F.when(F.col("o_cov_max") < c, c - F.col("o_cov_max")).otherwise(F.lit(0.0))),
        "wr_acc": w * (_ratio(F.col("support"), F.col("support") + F.col("o_support")) - _ratio(F.col("size"), F.col("size") + F.col("o_size"))),
        "tfidf": c * (F.log10(_ratio(F.col("o_n") + 1, F.col("n_with")) + 1) + 1),
    }


def with_measures(grid: DataFrame, rule: str = "rule_id", cluster: str = "cluster", extra: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """Adds the measures to a full grid of (rule, cluster, support, size), supports 0 included.

    What is needed of the other clusters are sums over a rule's rows less the own, and the largest other coverage from
    the two largest: one window per rule, as wide as there are clusters.
    """
    own = F.coalesce(coverage(), F.lit(0.0))
    rows = grid.withColumn("_cov", own)
    w = Window.partitionBy(rule)
    ranked = Window.partitionBy(rule).orderBy(F.col("_cov").desc(), F.col(cluster))
    rows = rows.withColumns(
        {
            "o_cov_sum": F.sum("_cov").over(w) - F.col("_cov"),
            "o_support": F.sum("support").over(w) - F.col("support"),
            "o_size": F.sum("size").over(w) - F.col("size"),
            "o_n": F.count(F.lit(1)).over(w) - 1,
            "n_with": F.sum((F.col("support") > 0).cast("long")).over(w),
            "_rank": F.row_number().over(ranked),
        }
    )
    first = F.max(F.when(F.col("_rank") == 1, F.col("_cov"))).over(w)
    second = F.max(F.when(F.col("_rank") == 2, F.col("_cov"))).over(w)
    rows = rows.withColumn("o_cov_max", F.coalesce(F.when(F.col("_rank") == 1, second).otherwise(first), F.lit(0.0)))
    made = measure_columns() | {k: f() for k, f in (extra or {}).items()}
    return rows.withColumns(made).drop("_cov", "_rank", "o_cov_sum", "o_support", "o_size", "o_n", "n_with", "o_cov_max")
