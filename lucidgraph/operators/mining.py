"""Level-wise mining of rules that describe clusters, for all clusters and patterns of a level in one job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucidgraph.functions.measures import with_measures
from lucidgraph.operators.graph import predicate_classes, predicate_stats, usual_categorical, usual_constants
from lucidgraph.plans.patterns import match
from lucidgraph.plans.rules import ANCHOR, Atom, Rule, is_var
from lucidgraph.sources.storage import stored

SHAPES = ("path", "tree", "categorical", "subgraph")


@dataclass
class Settings:
    """How rules are mined.

    ``first_generation``: path rules as they were mined at first - nodes may repeat, a path doesn't turn back over the
    predicate it came by, constants are bound only to rules of two atoms and more that end in an out-edge, and unbound
    categorical predicates are left out of results only.
    """

    shape: str = "subgraph"
    max_length: int = 2
    min_coverage: float = 0.4
    beam: int = 20
    top: int = 10
    objective: str = "x_coverage"
    with_constants: bool = True
    constant_relations: Sequence[str] = field(default_factory=usual_constants)
    categorical_relations: Sequence[str] = field(default_factory=usual_categorical)
    excluded_relations: Sequence[str] = ()
    use_stats: bool = True
    first_generation: bool = False
    extra_measures: dict = field(default_factory=dict)


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.col("label").alias("cluster")).agg(F.count_distinct("entity").alias("size"))


def support_grid(found: DataFrame, labels: DataFrame, sizes: DataFrame, rule_ids: DataFrame) -> DataFrame:
    """(rule_id, cluster, support, size) for every rule and cluster, 0 included, from matches (rule_id, v_x)."""
    x = labels.select(F.col("entity").alias("v_x"), F.col("label").alias("cluster")).distinct()
    counts = found.select("rule_id", "v_x").distinct().join(x, "v_x").groupBy("rule_id", "cluster").agg(F.count(F.lit(1)).alias("support"))
    # rules x clusters: both are few and bounded by the beam, not by the data
    every = rule_ids.select("rule_id").distinct().join(F.broadcast(sizes), F.lit(True))
    return every.join(counts, ["rule_id", "cluster"], "left").withColumn("support", F.coalesce("support", F.lit(0).cast("long")))


def supports(kg: DataFrame, rules: Sequence[Rule], labels: DataFrame, injective: bool = True) -> DataFrame:
    """(rule_id, cluster, support, size) of given rules in all clusters."""
    spark = kg.sparkSession
    anchors = labels.select(F.col("entity").alias("v_x")).distinct()
    found = match(kg, rules, keep=[ANCHOR], injective=injective, anchors=anchors)
    ids = spark.createDataFrame([(r.rule_id(),) for r in rules], "rule_id string")
    return support_grid(found, labels, cluster_sizes(labels), ids)


def pattern_bindings(kg: DataFrame, rule: Rule, labels: DataFrame, variable: str, min_support: int = 0, limit: int = -1, injective: bool = True) -> DataFrame:
    """(cluster, binding, support): distinct anchors by the value of an open variable, over ``min_support``, the first
    ``limit`` of each cluster by support, ties by value."""
    heads = [r["relation"] for r in labels.select("relation").distinct().collect()]
    anchors = labels.select(F.col("entity").alias("v_x")).distinct()
    found = match(kg, [rule], keep=[ANCHOR, variable], injective=injective, excluded_predicates=heads if is_var(rule.body[-1].p) else (), anchors=anchors)
    x = labels.select(F.col("entity").alias("v_x"), F.col("label").alias("cluster")).distinct()
    counts = found.join(x, "v_x").groupBy("cluster", F.col(f"v_{variable[1:]}").alias("binding")).agg(F.count_distinct("v_x").alias("support"))
    if min_support > 0:
        counts = counts.filter(F.col("support") > min_support)
    if limit > 0:
        order = Window.partitionBy("cluster").orderBy(F.col("support").desc(), "binding")
        counts = counts.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")
    return counts


def expansions(rule: Rule, level: int, settings: Settings) -> list[tuple[str, str]]:
    """(subject, object) of the atoms that a rule can grow by at a level."""
    new = f"?x{level}"
    if settings.shape == "path":
        open_ = rule.open_variables() if not settings.first_generation else [path_end(rule)]
        return [p for v in open_[:1] if is_var(v) for p in ((v, new), (new, v))]
    if settings.shape == "categorical":
        return [p for v in rule.anchors for p in ((v, new), (new, v))]
    known = rule.variables()
    grown = [p for v in known for p in ((v, new), (new, v))]
    if settings.shape == "tree":
        return grown
    if settings.shape == "subgraph":
        return grown + [(a, b) for a in known for b in known if a != b]
    raise ValueError(f"no such shape: {settings.shape}; there are {', '.join(SHAPES)}")


class Miner:
    """Matches of a level are kept as a table (rule_id, v_x, other variables), and the next level extends them.

    The graph is written once without repeats, as every level joins it; ``ready``: it is such a table already.
    """

    def __init__(self, kg: DataFrame, settings: Settings | None = None, ready: bool = False):
        self.settings = s = settings or Settings()
        if s.excluded_relations:
            kg = kg.filter(~F.col("p").isin(list(s.excluded_relations)))
        self.kg = kg if ready else stored(kg.select("s", "p", "o").distinct(), "kg")
        constant, categorical = set(s.constant_relations), set(s.categorical_relations)
        if s.with_constants and s.use_stats and not s.first_generation:
            # one row per predicate
            for r in predicate_classes(predicate_stats(self.kg)).filter("binds_constants OR categorical").collect():
                constant |= {r["p"]} if r["binds_constants"] else set()
                categorical |= {r["p"]} if r["categorical"] else set()
        self.constant = sorted(constant) if s.with_constants else []
        self.categorical = sorted(categorical) if s.with_constants else []

    def mine(self, labels: DataFrame) -> tuple[list[Rule], DataFrame]:
        """The rules of all levels, and their grid (rule_id, cluster, support, size, measures).

        A rule is in a cluster's result if its support there is over the least; ``level_supports`` says so.
        """
        s, spark = self.settings, self.kg.sparkSession
        labels = labels.select("entity", "relation", "label").distinct()
        sizes = stored(cluster_sizes(labels), "cluster-sizes")
        heads = [r["relation"] for r in labels.select("relation").distinct().collect()]
        least = sizes.withColumn("least", F.floor(F.col("size") * F.lit(max(0.0, s.min_coverage))))
        rules: dict[str, Rule] = {}
        accepted: set[tuple[str, str]] = set()
        root = Rule(Atom(ANCHOR, heads[0] if heads else "", "?c"))
        found = labels.select(F.lit("").alias("rule_id"), F.col("entity").alias("v_x")).distinct()
        x = labels.select(F.col("entity").alias("v_x"), F.col("label").alias("cluster"))
        clusters = [r["cluster"] for r in sizes.collect()]
        parents = {"": root}
        alive = {("", c) for c in clusters}
        grids = []
        for level in range(1, s.max_length + 1):
            cand = self._extend(found, parents, level, heads)
            if cand is None:
                break
            cand = stored(cand, "candidates")
            pairs = spark.createDataFrame(sorted(alive), "rule_id string, cluster string")
            per = cand.join(x, "v_x").join(F.broadcast(pairs), ["rule_id", "cluster"]).join(F.broadcast(least), "cluster")
            bound = self._beam(per.groupBy("cluster", "rule_id", "s", "o", "p", "least"), [])
            picks = [(r["cluster"], r["rule_id"], r["s"], r["o"], r["p"], None) for r in bound.collect()]
            eligible = [p for p in picks if self._binds(parents[p[1]], p)]
            if eligible:
                keys = spark.createDataFrame([p[:5] for p in eligible], "cluster string, rule_id string, s string, o string, p string")
                more = self._beam(per.join(F.broadcast(keys), ["cluster", "rule_id", "s", "o", "p"]).withColumn("value", F.col("_o")).groupBy("cluster", "rule_id", "s", "o", "p", "least", "value"), ["value"])
                picks += [(r["cluster"], r["rule_id"], r["s"], r["o"], r["p"], r["value"]) for r in more.collect()]
            made: dict[str, Rule] = {}
            names, alive = [], set()
            for cluster, parent, subject, obj, p, value_ in picks:
                rule = parents[parent].extended(Atom(subject, p, obj))
                rule = rule.bound(value_) if value_ is not None else rule
                if not s.first_generation and rule.is_categorical_unbound(self.categorical):
                    continue
                rid = rule.rule_id()
                made.setdefault(rid, rule)
                alive.add((rid, cluster))
                if made[rid].body == rule.body:
                    names.append((parent, subject, obj, p, value_, rid))
            if not made:
                break
            table = spark.createDataFrame(sorted(set(names), key=str), "rule_id string, s string, o string, p string, value string, new_id string")
            kept = cand.join(F.broadcast(table), ["rule_id", "s", "o", "p"]).filter("value IS NULL OR value = _o")
            columns = [c for c in cand.columns if c.startswith("v_")]
            new = f"v_x{level}"
            fresh = F.when(F.col("value").isNotNull(), F.lit(None)).when(F.col("s") == f"?x{level}", F.col("_s")).when(F.col("o") == f"?x{level}", F.col("_o"))
            found = stored(kept.select(F.col("new_id").alias("rule_id"), *columns, fresh.cast("string").alias(new)).distinct(), "matches")
            grids.append(support_grid(found, labels, sizes, spark.createDataFrame([(r,) for r in made], "rule_id string")))
            shown = {r: rule for r, rule in made.items() if not self._hidden(rule)}
            accepted |= {(r, c) for r, c in alive if r in shown}
            rules |= {r: v for r, v in shown.items() if r not in rules}
            parents = made
        if not rules:
            empty = spark.createDataFrame([], "rule_id string, cluster string, support long, size long")
            return [], with_measures(empty, extra=s.extra_measures)
        grid = with_measures(reduce(DataFrame.unionByName, grids).dropDuplicates(["rule_id", "cluster"]), extra=s.extra_measures)
        flags = spark.createDataFrame(sorted(accepted), "rule_id string, cluster string")
        return list(rules.values()), grid.join(F.broadcast(flags), ["rule_id", "cluster"])

    def _beam(self, grouped, more: list[str]) -> DataFrame:
        counts = grouped.agg(F.count_distinct("v_x").alias("support"))
        # without a least support nothing is asked for
        counts = counts.filter((F.col("least") <= 0) | (F.col("support") > F.col("least")))
        if self.settings.beam > 0:
            by = ["cluster", "rule_id", "s", "o"] + (["p"] if more else [])
            order = Window.partitionBy(*by).orderBy(F.col("support").desc(), "value" if more else "p")
            counts = counts.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= self.settings.beam)
        return counts

    def _binds(self, parent: Rule, pick: tuple) -> bool:
        """Constants go to the new variable only, where it is the object; binding an older one would cut the rule apart."""
        _, _, _, obj, p, _ = pick
        longer = not self.settings.first_generation or len(parent) > 0
        return p in self.constant and longer and obj.startswith("?x") and obj not in parent.variables()

    def _hidden(self, rule: Rule) -> bool:
        if self.settings.first_generation:
            return rule.body[-1].p in self.categorical and is_var(path_end(rule))
        return False

    def _extend(self, found: DataFrame, parents: dict[str, Rule], level: int, heads: list[str]) -> DataFrame | None:
        """(rule_id, s, o, p, _s, _o, v_...) for all ways to grow; one join per pair of ends, whatever the rules."""
        s, spark = self.settings, self.kg.sparkSession
        ways: dict[tuple[str, str], list[str]] = {}
        for rid, rule in parents.items():
            if s.first_generation and rule.body and not is_var(path_end(rule)):
                continue
            for ends in expansions(rule, level, s):
                ways.setdefault(ends, []).append(rid)
        new = f"?x{level}"
        kg = self.kg.filter(~F.col("p").isin(heads)) if heads else self.kg
        edge = kg.select(F.col("s").alias("_s"), F.col("p"), F.col("o").alias("_o"))
        atoms = spark.createDataFrame([(rid, [list((a.s, a.p, a.o)) for a in rule.body]) for rid, rule in parents.items()], "rule_id string, atoms array<array<string>>")
        frames = []
        variables = [c for c in found.columns if c.startswith("v_")]
        for (subject, obj), own in sorted(ways.items()):
            fresh = "_s" if subject == new else "_o" if obj == new else None
            # a fresh node differs from all variables' nodes: only a constant, or a closing atom, can repeat an atom
            can_repeat = not s.first_generation and any(parents[r].body and (fresh is None or any(not is_var(t) for a in parents[r].body for t in a.args())) for r in own)
            if can_repeat or s.first_generation:
                rows = found.join(F.broadcast(atoms.filter(F.col("rule_id").isin(own))), "rule_id")
            else:
                rows = found if len(own) == len(parents) else found.filter(F.col("rule_id").isin(own))
            on = []
            if subject != new:
                on.append(F.col(f"v_{subject[1:]}") == F.col("_s"))
            if obj != new:
                on.append(F.col(f"v_{obj[1:]}") == F.col("_o"))
            rows = rows.join(edge, reduce(lambda a, b: a & b, on))
            if not s.first_generation:
                if fresh:
                    for v in variables:
                        rows = rows.filter(F.col(v).isNull() | (F.col(v) != F.col(fresh)))
                if can_repeat:
                    # same predicate, and ends that are the same node
                    named = {f"?{v[2:]}": F.col(v) for v in variables}
                    value = lambda t: F.coalesce(*[F.when(t == F.lit(k), c) for k, c in named.items()], t)  # noqa: E731, B023
                    rows = rows.filter(~F.exists("atoms", lambda a: (a[1] == F.col("p")) & (value(a[0]) == F.col("_s")) & (value(a[2]) == F.col("_o"))))  # noqa: B023
            else:
                # not back over the predicate that the path came by
                last = F.element_at("atoms", -1)
                out = last[2] == F.lit(subject if subject != new else obj)
                turned = (out & (F.lit(subject) == new)) | (~out & (F.lit(obj) == new))
                rows = rows.filter(F.coalesce(~((F.size("atoms") > 0) & turned & (last[1] == F.col("p"))), F.lit(True)))
            frames.append(rows.select("rule_id", F.lit(subject).alias("s"), F.lit(obj).alias("o"), "p", "_s", "_o", *variables))
        # matches and triples are without repeats, and so are their joins
        return reduce(DataFrame.unionByName, frames) if frames else None


def path_end(rule: Rule) -> str:
    """The end of a path rule: the argument of the last atom that isn't where it was attached."""
    at = ANCHOR
    for a in rule.body:
        at = a.o if a.s == at else a.s
    return at


def rules_table(rules: Iterable[Rule], grid: DataFrame, relation: str, measures: Sequence[str] = ("c_coverage", "n_coverage", "x_coverage", "wr_acc", "tfidf")) -> DataFrame:
    """One row per (cluster, rule): rule_id, cluster, head_rel, body (text and structs), c_support and the measures."""
    spark = grid.sparkSession
    table = spark.createDataFrame([(r.rule_id(), relation, [(a.s, a.p, a.o) for a in r.body], ", ".join(a.readable() for a in r.body)) for r in rules], "rule_id string, head_rel string, body array<struct<s:string,p:string,o:string>>, body_text string")
    return grid.join(F.broadcast(table), "rule_id").withColumn("c_support", F.col("support"))


def top_rules(table: DataFrame, k: int = 10, objective: str = "x_coverage") -> DataFrame:
    """The best k rules of each cluster, ties by rule id."""
    order = Window.partitionBy("cluster").orderBy(F.col(objective).desc_nulls_last(), "rule_id")
    return table.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def explain(kg: DataFrame, labels: DataFrame, settings: Settings | None = None, ready: bool = False) -> DataFrame:
    """The top rules of every cluster of ``labels`` (entity, relation, label)."""
    s = settings or Settings()
    rules, grid = Miner(kg, s, ready).mine(labels)
    first = labels.select("relation").first()
    table = rules_table(rules, grid, first["relation"] if first else "") if rules else rules_table([], grid, "")
    return top_rules(table, s.top, s.objective)


def as_rules(table: DataFrame, relation: str | None = None) -> dict[str, list[Rule]]:
    """Rules by cluster, best first, of a table of ``explain``: at most ``top`` for each cluster."""
    out: dict[str, list[Rule]] = {}
    for r in table.orderBy("cluster", "rank").collect():
        marks = {k: r[k] for k in ("c_support", "c_coverage", "n_coverage", "x_coverage", "wr_acc", "tfidf") if k in r.asDict()}
        out.setdefault(r["cluster"], []).append(Rule(Atom(ANCHOR, relation or r["head_rel"], r["cluster"]), tuple(Atom(a["s"], a["p"], a["o"]) for a in r["body"]), marks))
    return out
