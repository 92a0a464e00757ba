"""The iterative pipeline: embed, cluster, explain, make feedback, update the embedding, and again."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidgraph.functions.terms import AUX_CLUSTER, AUX_RELATION
from lucidgraph.operators import clustering, deduction, embedding, evaluation, graph, mining
from lucidgraph.plans.rules import Rule
from lucidgraph.sources.storage import stored
from lucidgraph.sources.triples import joint, place_holders


@dataclass
class Iteration:
    """What one iteration leaves: all tables are written ones."""

    number: int
    model: embedding.Embedding
    vectors: DataFrame
    clusters: DataFrame
    rules: dict[str, list[Rule]]
    feedback: DataFrame
    metrics: dict


@dataclass
class Plan:
    """Settings of a run.

    ``stop_below``: ends once fewer of the entities change their cluster; 0 never does.
    """

    iterations: int = 2
    method: str = "kmeans"
    method_settings: dict = field(default_factory=lambda: {"k": 2, "restarts": 5})
    mining: mining.Settings = field(default_factory=lambda: mining.Settings(shape="path"))
    strategy: str = "entexplcls"
    min_quality: float = 0.0
    training: embedding.Training = field(default_factory=embedding.Training)
    update_mode: str = "adapt_progressive"
    data_mode: str = "assignments_subgraph"
    history: int = 1
    hops: int = 1
    objective: str = "x_coverage"
    top: int = 1
    stop_below: float = 0.0
    seed: int = 0


class Result:
    def __init__(self, iterations: list[Iteration], objective: str, top: int):
        self.iterations, self.objective, self.top = iterations, objective, top

    def base(self) -> Iteration:
        return self.iterations[0]

    def last(self) -> Iteration:
        return self.iterations[-1]

    def best(self) -> Iteration:
        """By the mean objective of the top rules; iteration 0 only if there is no other, the first of equals."""
        later = self.iterations[1:] or self.iterations
        return max(later, key=lambda i: (i.metrics.get(f"{self.objective}@{self.top}") or 0.0, -i.number))

    def explanations(self, iteration: Iteration | None = None) -> dict[str, list[Rule]]:
        return (iteration or self.best()).rules

    def clustering(self, iteration: Iteration | None = None) -> DataFrame:
        return (iteration or self.best()).clusters

    def metrics(self) -> list[dict]:
        return [i.metrics for i in self.iterations]


def _measure(number: int, table: DataFrame, clusters: DataFrame, truth: DataFrame | None, vectors: DataFrame, past: list[Iteration], plan: Plan) -> dict:
    sizes = {r["label"]: r["n"] for r in clusters.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    out: dict = {"itr_num": number, "clusters_sizes": sorted(sizes.values(), reverse=True)}
    out |= {f"{r['measure']}@{r['k']}": r["value"] for r in evaluation.top_quality(table, objective=plan.objective).collect()}
    out |= evaluation.explanation_stats(clusters.select(F.col("label").alias("cluster")), table, plan.objective).first().asDict()
    if truth is not None:
        pairs = truth.select("entity", F.col("label").alias("truth")).join(clusters.select("entity", F.col("label").alias("predicted")), "entity")
        out |= evaluation.evaluate(pairs)
    named = vectors.select(F.col("name").alias("id"), "vec")
    labelled = named.join(clusters.select(F.col("entity").alias("id"), "label"), "id")
    out["SS"] = evaluation.silhouette(labelled).first()["ss"] if len(sizes) > 1 else None
    for key, other in (("curr_vs_base", past[:1]), ("curr_vs_prv", past[-1:])):
        if other:
            out[key] = evaluation.mean_similarity(named, other[0].vectors.select(F.col("name").alias("id"), "vec")).first()["similarity"]
    return out


def run(kg: DataFrame, targets: DataFrame, plan: Plan | None = None, labelled: bool = True) -> Result:
    """``targets``: (entity, relation, label); the labels are only measured against, and only if ``labelled``."""
    plan = plan or Plan()
    kg = stored(kg.select("s", "p", "o").distinct(), "kg")
    entities = stored(targets.select(F.col("entity").alias("name")).distinct(), "targets")
    truth = targets if labelled else None
    holders = place_holders(kg.sparkSession, plan.method_settings.get("k", 10), plan.iterations)
    context = stored(graph.subgraph(kg, entities, plan.hops), "context")
    base, _ = embedding.train(joint(kg, holders), plan.training)
    model, past, feedbacks = base, [], []
    cluster = clustering.method(plan.method, **plan.method_settings)
    for number in range(plan.iterations):
        vectors = stored(embedding.lookup(model.entities, entities), "target-vectors")
        found = cluster(vectors.select(F.col("name").alias("id"), "vec"))
        name = F.concat(F.lit(AUX_CLUSTER), F.col("cluster").cast("string"), F.lit(f"_{number}"))
        clusters = stored(found.select(F.col("id").alias("entity"), F.lit(AUX_RELATION).alias("relation"), name.alias("label")), "clusters")
        table = stored(mining.explain(kg, clusters, plan.mining, ready=True), "rules")
        rules = mining.as_rules(table)
        every = [r for own in rules.values() for r in own]
        feedback = stored(deduction.feedback(kg, every, entities, plan.strategy, plan.min_quality, iteration=number), "feedback") if every else kg.limit(0)
        metrics = _measure(number, table, clusters, truth, vectors, past, plan)
        past.append(Iteration(number, model, vectors, clusters, rules, feedback, metrics))
        feedbacks.append(feedback)
        if plan.stop_below > 0 and number and _changed(past[-2].clusters, clusters) < plan.stop_below:
            break
        if number + 1 < plan.iterations:
            chosen = embedding.update_data(kg, context, feedbacks, plan.update_mode, plan.data_mode, plan.history)
            old = {"retrain": None, "adapt_restart": base, "adapt_progressive": model}[plan.update_mode]
            # without any triples there is nothing to learn from, and the vectors stay
            if chosen.first() is not None:
                model, _ = embedding.train(chosen, plan.training, old)
    return Result(past, plan.objective, plan.top)


def _changed(before: DataFrame, after: DataFrame) -> float:
    """The share of entities outside the best one-to-one match of the two clusterings."""
    pairs = before.select("entity", F.col("label").alias("truth")).join(after.select("entity", F.col("label").alias("predicted")), "entity")
    return 1.0 - evaluation.accuracy(evaluation.contingency(pairs))[0]


def settings_grid(options: Mapping[str, Sequence]) -> Iterator[dict]:
    """All combinations of the options' values."""
    names = list(options)
    for values in itertools.product(*(options[n] for n in names)):
        yield dict(zip(names, values))
