"""Compiles conjunctive patterns into DataFrame joins.

Rules of one shape - the same variables in the same places - are matched by one plan: their constants are columns of a
small rule table, so that the number of plans follows the number of shapes, not of rules.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.plans.rules import Atom, Rule, is_var


def column_of(variable: str) -> str:
    return "v_" + variable.removeprefix("?")


def _shape(rule: Rule) -> tuple[tuple[str, str, str], ...]:
    """The body with every constant replaced by the place that it fills."""
    return tuple(tuple(t if is_var(t) else f"c{i}{place}" for place, t in zip("spo", (a.s, a.p, a.o))) for i, a in enumerate(rule.body))


def _constants(rule: Rule) -> dict[str, str]:
    return {f"c{i}{place}": t for i, a in enumerate(rule.body) for place, t in zip("spo", (a.s, a.p, a.o)) if not is_var(t)}


def connected_order(body: Sequence[Atom], anchors: Sequence[str]) -> list[int]:
    """Places of the atoms such that each, if it can, touches a variable that is bound already."""
    left, bound, out = list(range(len(body))), set(anchors), []
    while left:
        best = next((i for i in left if set(body[i].variables()) & bound), left[0])
        left.remove(best)
        out.append(best)
        bound |= set(body[best].variables())
    return out


def match(
    kg: DataFrame,
    rules: Sequence[Rule],
    keep: Sequence[str] | None = None,
    injective: bool = True,
    distinct_atoms: bool = True,
    excluded_predicates: Iterable[str] = (),
    anchors: DataFrame | None = None,
) -> DataFrame:
    """(rule_id, v_<variable>...) of all matches of the rules; ``keep``: the variables to return, all if None.

    ``injective``: distinct variables bind distinct nodes. ``distinct_atoms``: the last atom differs from each earlier
    one. ``excluded_predicates``: values that predicate variables can't take. ``anchors``: one column, ``v_x``, that
    the anchor is restricted to. Variables that nothing later needs are dropped and the rest made distinct, so that a
    join's fan-out is bounded by what is asked for.
    """
    spark = kg.sparkSession
    shapes: dict[tuple, list[Rule]] = defaultdict(list)
    for r in {(r.rule_id(), r.body): r for r in rules}.values():
        shapes[_shape(r)].append(r)
    frames, names = [], sorted({column_of(v) for v in keep}) if keep is not None else None
    every = sorted({column_of(v) for r in rules for v in (*r.variables(), *(p for p in r.predicates() if is_var(p)))})
    for shape, own in shapes.items():
        found = _match_shape(spark, kg, shape, own, keep, injective, distinct_atoms, list(excluded_predicates), anchors)
        wanted = names if names is not None else every
        frames.append(found.select("rule_id", *[F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in wanted]))
    return reduce(DataFrame.unionByName, frames)


def _match_shape(spark: SparkSession, kg: DataFrame, shape, own: list[Rule], keep, injective, distinct_atoms, excluded, anchors) -> DataFrame:
    places = sorted(_constants(own[0]))
    table = spark.createDataFrame([(r.rule_id(), *[_constants(r)[c] for c in places]) for r in own], ", ".join(["rule_id string", *[f"{c} string" for c in places]]))
    if not shape:
        if anchors is None:
            raise ValueError("a rule without a body needs anchors")
        return anchors.select(F.col(anchors.columns[0]).alias(column_of(own[0].anchors[0]))).distinct().withColumn("rule_id", F.lit(own[0].rule_id()))
    body = [Atom(*t) for t in shape]
    arg_vars = list(dict.fromkeys(v for a in body for v in a.variables()))
    pred_vars = [a.p for a in body if is_var(a.p)]
    repeated = [(len(body) - 1, i) for i in range(len(body) - 1)] if distinct_atoms else []
    order = connected_order(body, own[0].anchors)
    checks: list[tuple[set[str], Column]] = []
    if injective:
        checks += [({a, b}, F.col(column_of(a)) != F.col(column_of(b))) for a, b in combinations(arg_vars, 2)]
    checks += [({p}, ~F.col(column_of(p)).isin(excluded)) for p in pred_vars if excluded]
    value = lambda t: F.col(column_of(t)) if is_var(t) else F.col(t)
    for i, j in repeated:
        needs = {t for t in (*shape[i], *shape[j]) if is_var(t)}
        same = [value(x) == value(y) if x != y else F.lit(True) for x, y in zip(shape[i], shape[j])]
        checks.append((needs, ~(same[0] & same[1] & same[2])))
    rows, bound = F.broadcast(table), set()
    if anchors is not None:
        anchor = own[0].anchors[0]
        rows = anchors.select(F.col(anchors.columns[0]).alias(column_of(anchor))).distinct().withColumn("_one", F.lit(1)).join(F.broadcast(table.withColumn("_one", F.lit(1))), "_one").drop("_one")
        bound.add(anchor)
    for step, i in enumerate(order):
        a = body[i]
        edge = kg.select(F.col("s").alias("_s"), F.col("p").alias("_p"), F.col("o").alias("_o"))
        on, new = [], {}
        for term, place in ((a.s, "_s"), (a.p, "_p"), (a.o, "_o")):
            if not is_var(term):
                on.append(F.col(place) == F.col(term))
            elif term in bound:
                on.append(F.col(place) == F.col(column_of(term)))
            elif term in new:
                on.append(F.col(place) == F.col(new[term]))
            else:
                new[term] = place
        rows = edge.join(rows, reduce(lambda x, y: x & y, on) if on else F.lit(True)) if step == 0 and anchors is None else rows.join(edge, reduce(lambda x, y: x & y, on) if on else F.lit(True))
        for term, place in new.items():
            rows = rows.withColumnRenamed(place, column_of(term))
        bound |= set(new)
        rows = rows.drop("_s", "_p", "_o")
        ready = [c for needs, c in checks if needs <= bound]
        checks = [(needs, c) for needs, c in checks if not needs <= bound]
        if ready:
            rows = rows.filter(reduce(lambda x, y: x & y, ready))
        if keep is not None:
            later = {t for k in order[step + 1 :] for t in shape[k] if is_var(t)} | {t for needs, _ in checks for t in needs} | set(keep)
            dead = [column_of(t) for t in bound if t not in later]
            unused = [c for c in places if not any(c in shape[k] for k in order[step + 1 :]) and not any(int(c[1:-1]) in pair for pair in repeated)]
            if step == len(order) - 1:
                unused = places
            if dead:
                rows = rows.drop(*dead, *unused).distinct()
            else:
                rows = rows.drop(*unused)
    return rows.drop(*places)
