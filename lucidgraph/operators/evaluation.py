"""Metrics of clusterings, rules, predictions and embeddings."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucidgraph.functions.measures import MEASURES
from lucidgraph.functions.vectors import cosine_similarity
from lucidgraph.operators.blocks import distance_matrix, over_pairs


def contingency(pairs: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(truth, predicted, n): all metrics below need no more than these few rows of the data."""
    return pairs.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) of a square matrix's assignment of the largest weight, by shortest augmenting paths."""
    cost = weights.max(initial=0) - np.asarray(weights, float)
    n = len(cost)
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for row in range(1, n + 1):
        owner[0], j = row, 0
        least, used, back = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while True:
            used[j] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[owner[j] - 1, free - 1] - u[owner[j]] - v[free]
            better = reduced < least[free]
            least[free[better]] = reduced[better]
            back[free[better]] = j
            k = free[np.argmin(least[free])]
            step = least[k]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j = k
            if owner[j] == 0:
                break
        while j:
            owner[j], j = owner[back[j]], back[j]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, n + 1))


def accuracy(table: DataFrame, plus_one: bool = False) -> tuple[float, float]:
    """(micro, macro) of the best one-to-one assignment of predicted to true clusters.

    ``table``: a contingency, as many rows as pairs of clusters, that comes to the driver. Macro averages over the
    true clusters that exist, and is the greatest of those of the best micro. ``plus_one`` adds one to micro's numerator, as some tools do.
    """
    rows = table.collect()
    if not rows:
        return float("nan"), float("nan")
    truths, preds = sorted({str(r["truth"]) for r in rows}), sorted({str(r["predicted"]) for r in rows})
    d = max(len(truths), len(preds))
    w = np.zeros((d, d), np.int64)
    for r in rows:
        w[preds.index(str(r["predicted"])), truths.index(str(r["truth"]))] += r["n"]
    sizes = w.sum(0)
    # the shares of all true clusters together stay under one: they decide between assignments of one weight only
    matched = {c: w[i, c] for i, c in assignment(w + w / np.maximum(sizes, 1) / (2 * d))}
    macro = float(np.mean([matched[c] / sizes[c] for c in range(len(truths))]))
    return float((sum(matched.values()) + plus_one) / w.sum()), macro


def partition_scores(table: DataFrame, nmi_average: str = "arithmetic") -> DataFrame:
    """One row: ARI, NMI, HMS (homogeneity) and PUR (purity) of a contingency table.

    ``nmi_average``: arithmetic or geometric mean of the entropies.
    """
    pairs = lambda x: x * (x - 1) / 2
    a = table.groupBy("truth").agg(F.sum("n").cast("double").alias("x"))
    b = table.groupBy("predicted").agg(F.sum("n").cast("double").alias("x"), F.max("n").cast("double").alias("top"))
    total = table.agg(F.sum("n").cast("double").alias("n"), F.sum(pairs(F.col("n").cast("double"))).alias("pairs"))
    sums_a = a.agg(F.sum(pairs(F.col("x"))).alias("pa"))
    sums_b = b.agg(F.sum(pairs(F.col("x"))).alias("pb"), F.sum("top").alias("top"))
    one = total.join(sums_a).join(sums_b)
    entropy = lambda t, name: t.join(F.broadcast(total.select("n"))).agg(F.sum(-(F.col("x") / F.col("n")) * F.log(F.col("x") / F.col("n"))).alias(name))
    joint = table.join(F.broadcast(a.withColumnRenamed("x", "xa")), "truth").join(F.broadcast(b.select("predicted", F.col("x").alias("xb"))), "predicted")
    joint = joint.withColumn("c", F.col("n").cast("double")).drop("n").join(F.broadcast(total.select("n")))
    mutual = joint.agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("xa") * F.col("xb")))).alias("mi"))
    rows = one.join(entropy(a, "ha")).join(entropy(b, "hb")).join(mutual)
    expected = F.col("pa") * F.col("pb") / pairs(F.col("n"))
    mean = (F.col("ha") + F.col("hb")) / 2 if nmi_average == "arithmetic" else F.sqrt(F.col("ha") * F.col("hb"))
    return rows.select(
        F.coalesce(F.try_divide(F.col("pairs") - expected, (F.col("pa") + F.col("pb")) / 2 - expected), F.lit(1.0)).alias("ari"),
        F.coalesce(F.try_divide("mi", mean), F.lit(1.0)).alias("nmi"),
        F.coalesce(F.try_divide("mi", "ha"), F.lit(1.0)).alias("hms"),
        (F.col("top") / F.col("n")).alias("pur"),
    )


def silhouette(vectors: DataFrame, label: str = "label", vec: str = "vec", key: str = "id", metric: str | None = None) -> DataFrame:
    """One row, the mean silhouette width over all pairs of vectors; metric None: euclidean.

    A point alone in its cluster counts 0. Sums of distances by point and cluster are made block against block, and
    only these are aggregated: exact, and quadratic by definition.
    """
    kind = dict(vectors.dtypes)
    rows = vectors.select(F.col(key).alias("i"), F.col(label).alias("li"), F.col(vec).alias("vec"))
    which = metric or "euclidean"

    def summed(a: dict, b: dict) -> dict[str, list]:
        d = distance_matrix(a["vec"], b["vec"], which)
        place = {k: j for j, k in enumerate(b["i"])}
        for i, k in enumerate(a["i"]):
            if k in place:
                d[i, place[k]] = 0.0
        others = sorted(set(b["li"]), key=str)
        member = np.array([[x == o for o in others] for x in b["li"]], float)
        same = np.array([[k in place and b["li"][place[k]] == o for o in others] for k in a["i"]], float)
        total, n = d @ member, member.sum(0)[None, :] - same
        at = [(i, j) for i in range(len(a["i"])) for j in range(len(others))]
        return {"i": [a["i"][i] for i, _ in at], "li": [a["li"][i] for i, _ in at], "lj": [others[j] for _, j in at], "sum": [float(total[i, j]) for i, j in at], "n": [float(n[i, j]) for i, j in at]}

    parts = over_pairs(rows, ["i", "li"], f"i {kind[key]}, li {kind[label]}, lj {kind[label]}, sum double, n double", summed)
    sums = parts.groupBy("i", "li", "lj").agg((F.sum("sum") / F.sum("n")).alias("d"), F.sum("n").alias("n")).filter("n > 0")
    point = sums.groupBy("i", "li").agg(F.max(F.when(F.col("li") == F.col("lj"), F.col("d"))).alias("a"), F.min(F.when(F.col("li") != F.col("lj"), F.col("d"))).alias("b"))
    width = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return point.agg(F.avg(width).alias("ss"))


def evaluate(pairs: DataFrame, vectors: DataFrame | None = None, metric: str | None = None) -> dict[str, float]:
    """ACC, ARI and NMI of (truth, predicted) rows, and SS where vectors (id, label, vec) are given."""
    table = contingency(pairs).cache()
    out = {"ACC": accuracy(table)[0]}
    one = partition_scores(table).first()
    out |= {"ARI": one["ari"], "NMI": one["nmi"]}
    if vectors is not None:
        out["SS"] = silhouette(vectors, metric=metric).first()["ss"]
    table.unpersist()
    return out


def mean_similarity(a: DataFrame, b: DataFrame, key: str = "id", vec: str = "vec") -> DataFrame:
    """One row: the mean cosine similarity of vectors with the same key."""
    both = a.select(key, F.col(vec).alias("_a")).join(b.select(key, F.col(vec).alias("_b")), key)
    return both.agg(F.avg(cosine_similarity(F.col("_a"), F.col("_b"))).alias("similarity"))


def top_quality(rules: DataFrame, measures: Sequence[str] = MEASURES, objective: str | None = None, max_k: int = 3) -> DataFrame:
    """(measure, k, value): the mean of a measure over the best k rules of all clusters together.

    Best by the objective, or by the measure itself; k up to the longest list, 3 at most.
    """
    out = None
    longest = Window.partitionBy("cluster")
    for m in measures:
        order = Window.partitionBy("cluster").orderBy(F.col(objective or m).desc_nulls_last(), "rule_id")
        rows = rules.select("cluster", F.lit(m).alias("measure"), F.col(m).cast("double").alias("q"), F.row_number().over(order).alias("n"), F.count(F.lit(1)).over(longest).alias("len"))
        out = rows if out is None else out.unionByName(rows)
    ks = out.filter(F.col("n") <= max_k).withColumn("k", F.explode(F.sequence(F.col("n"), F.lit(max_k))))
    most = rules.groupBy("cluster").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("most"))
    return ks.join(F.broadcast(most)).filter(F.col("k") <= F.col("most")).groupBy("measure", "k").agg(F.avg("q").alias("value"))


def explanation_stats(clusters: DataFrame, rules: DataFrame, measure: str = "x_coverage", threshold: float = 0.0) -> DataFrame:
    """One row: clusters, those with any rule, those whose first rule is over the threshold."""
    first = rules.filter("rank = 1").select("cluster", (F.col(measure) > threshold).alias("good"))
    rows = clusters.select("cluster").distinct().join(first, "cluster", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("clusters"), F.count("good").alias("clusters_with_any_explans"), F.count_if(F.coalesce("good", F.lit(False))).alias("clusters_with_accepted_explans")
    )


def evaluate_predictions(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(metric, value): predictions_mrr, predictions_coverage and hit@k of ranked predictions (s, o, rank).

    hit@k goes up to the number of different ranks that were hit, a miss counting as one.
    """
    t = truth.select("s", "o").join(predictions.select("s", "o", F.col("rank").alias("r")), ["s", "o"], "left").withColumn("r", F.coalesce("r", F.lit(0)))
    found = t.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("r") > 0, 1.0 / F.col("r")).otherwise(0.0)).alias("rr"), F.count_distinct("r").alias("kinds"))
    entities = truth.select("s").distinct()
    covered = entities.join(predictions.select("s").distinct(), "s", "left_semi").agg(F.count(F.lit(1)).alias("covered")).join(entities.agg(F.count(F.lit(1)).alias("entities")))
    base = found.join(covered).select(F.explode(F.create_map(F.lit("predictions_mrr"), F.col("rr") / F.col("n"), F.lit("predictions_coverage"), F.col("covered") / F.col("entities"))).alias("metric", "value"))
    hits = t.join(F.broadcast(found)).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("kinds").cast("int"))))
    hits = hits.groupBy("k").agg((F.count_if((F.col("r") > 0) & (F.col("r") <= F.col("k"))) / F.first("n")).alias("value"))
    return base.unionByName(hits.select(F.concat(F.lit("hit@"), F.col("k").cast("string")).alias("metric"), "value"))


def average_trials(rows: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """Means of the numbers of each setting; lists are left out, other columns keep one value."""
    aggs = []
    for name, kind in rows.dtypes:
        if name in parameters or kind.startswith("array"):
            continue
        number = kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal")
        aggs.append((F.avg(name) if number else F.min(name)).alias(name))
    return rows.groupBy(*parameters).agg(*aggs)


def best_iteration(metrics: DataFrame, measure: str) -> DataFrame:
    """The iteration with the largest value, the first of equals; iteration 0 only if there is no other."""
    n = Window.partitionBy(F.lit(1))
    rows = metrics.withColumn("_n", F.count(F.lit(1)).over(n)).filter((F.col("_n") == 1) | (F.col("iteration") > 0))
    return rows.orderBy(F.col(measure).desc_nulls_last(), "iteration").limit(1).drop("_n")


def distances(vectors: DataFrame, key: str = "id", vec: str = "vec", metric: str = "euclidean", scale: float = 1.0, **settings) -> DataFrame:
    """(i, j, d) for i < j: all pairs, for the methods that need them."""
    return distance_table(vectors, {"d": (metric, scale)}, key, vec, **settings)


def distance_table(vectors: DataFrame, measures: dict[str, tuple[str, float]], key: str = "id", vec: str = "vec", digits: int | None = None, then: tuple[str, Callable[[dict], dict]] | None = None, sort: str | None = None) -> DataFrame:
    """(i, j, a column of each measure) for i < j: all pairs in one pass, block against block.

    ``then``: a schema and what makes its rows of those of two blocks, which are in order of i where no key is twice.
    ``sort``: a measure in whose order rows of some blocks go out, which makes files of them smaller.

    A measure is a metric, euclidean or cosine, and what its distances are multiplied by. Sums run over a vector's
    places in order, as the higher-order functions' do. Null: a vector is null or has a null, lengths differ, or a
    cosine's vector is zero. ``digits``: decimals that are kept, halves rounded up as SQL does.
    """
    if any(metric not in ("euclidean", "cosine") for metric, _ in measures.values()):
        raise ValueError(f"no such metric in {measures}")
    x = F.col(vec).cast("array<double>")
    n = F.coalesce(F.when(F.exists(x, F.isnull), F.lit(-1)).otherwise(F.size(x)), F.lit(-1))
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("i"), F.greatest(n, F.lit(-1)).alias("n"), x.alias("x"))
    least, most = rows.agg(F.min("n"), F.max("n")).first()
    if least != most or (least or 0) < 0:  # shorter ones end with zeros, which change no sum
        filled = F.transform(F.sequence(F.lit(0), F.lit(max(most or 0, 0))), lambda k: F.coalesce(F.get("x", k), F.lit(0.0)))
        rows = rows.withColumn("x", F.coalesce(filled, F.array(F.lit(0.0))))
    kind = dict(vectors.dtypes)[key]
    whole = kind in ("tinyint", "smallint", "int", "bigint")

    def table(a: dict, b: dict) -> dict:
        for side in (a, b):
            order = np.argsort(np.array(side["i"], np.int64 if whole else object), kind="stable")
            side["vec"] = side["vec"][order]
            side |= {c: [side[c][k] for k in order] for c in ("i", "n")}
        ka, kb = (np.array(s["i"], np.int64 if whole else object) for s in (a, b))
        na, nb = np.array(a["n"]), np.array(b["n"])
        same = a["block"] == b["block"]
        width = a["vec"].shape[1]
        here, there = (np.ascontiguousarray(s["vec"].T) for s in (a, b))
        sums = {}
        for what in {metric for metric, _ in measures.values()}:
            total, part = np.zeros((len(ka), len(kb))), np.empty((min(len(ka), 64), len(kb)))
            for f in range(0, len(ka), 64):  # as many rows as stay near the processor
                own = total[f : f + 64]
                p = part[: len(own)]
                for k in range(width):
                    if what == "euclidean":
                        np.subtract(here[k, f : f + 64, None], there[k], out=p)
                        np.multiply(p, p, out=p)
                    else:
                        np.multiply(here[k, f : f + 64, None], there[k], out=p)
                    own += p
            sums[what] = total
        wrong = (na[:, None] != nb) | (na[:, None] < 0)
        odd = {"euclidean": wrong}
        with np.errstate(invalid="ignore", divide="ignore"):
            if "euclidean" in sums:
                sums["euclidean"] = np.sqrt(sums["euclidean"])
            if "cosine" in sums:
                norms = []
                for side in (here, there):
                    square = np.zeros(side.shape[1])
                    for k in range(width):
                        square += side[k] * side[k]
                    norms.append(np.sqrt(square))
                both = norms[0][:, None] * norms[1]
                odd["cosine"] = wrong | (both == 0)
                sums["cosine"] = 1.0 - sums["cosine"] / both
        if not same and len(ka) and len(kb) and ka[-1] < kb[0]:
            at, low, high = slice(None), np.repeat(ka, len(kb)), np.tile(kb, len(ka))
        else:
            first, second = np.broadcast_to(ka[:, None], wrong.shape), np.broadcast_to(kb, wrong.shape)
            less = (first < second).astype(bool)
            at = np.flatnonzero(less if same else less | (second < first).astype(bool))
            less, first, second = less.ravel()[at], first.ravel()[at], second.ravel()[at]
            low, high = np.where(less, first, second), np.where(less, second, first)
        out = {"i": pa.array(low, from_pandas=False), "j": pa.array(high, from_pandas=False)}
        for name, (metric, scale) in measures.items():
            d, none = sums[metric].ravel()[at] * scale, odd[metric].ravel()[at]
            out[name] = pa.array(rounded(d, digits) if digits is not None else d, mask=none if none.any() else None, from_pandas=False)
        return then[1](out) if then else out

    schema = ", ".join([f"i {kind}, j {kind}", *[f"{name} double" for name in measures]])
    return over_pairs(rows.select("i", "n", F.col("x").alias("vec")), ["i", "n"], then[0] if then else schema, table, once=True, sort=sort)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Numbers of 0 or more rounded to decimals, halves up, by their shortest decimal form, as Spark does."""
    with np.errstate(invalid="ignore", over="ignore"):
        large = x * 10.0**digits
        low = np.floor(large)
        out = (low + (large - low >= 0.5)) / 10.0**digits
        # near a half the product's own rounding must not decide, nor for large numbers
        unsure = np.flatnonzero((np.abs(large - low - 0.5) < 1e-4) | ~(np.abs(large) < 2**32) | (x < 0))
    for i in unsure.tolist():
        if np.isfinite(x[i]):
            out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(prec=400)))
        else:
            out[i] = x[i]
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
