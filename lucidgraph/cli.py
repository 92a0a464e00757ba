"""Command line: ``explain`` clusters of a graph, or ``cluster`` its entities and explain them, again and again."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lucidgraph.functions.terms import entity_url, relation_url
from lucidgraph.iterations import Plan, run
from lucidgraph.operators import clustering, deduction, embedding, mining
from lucidgraph.operators.graph import usual_categorical, usual_constants
from lucidgraph.sources.labels import read_labels
from lucidgraph.sources.output import write_metrics, write_rules
from lucidgraph.sources.triples import read_triples


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lucidgraph")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("explain", "cluster"):
        c = sub.add_parser(name)
        c.add_argument("--kg", required=True, help="whitespace-separated triples")
        c.add_argument("--targets", required=True, help="entities, one to three columns")
        c.add_argument("--out", required=True, help="folder of the results")
        c.add_argument("--prefix", default="", help="joined to names that are no URLs")
        c.add_argument("--shape", default="path", choices=mining.SHAPES)
        c.add_argument("--max-length", type=int, default=2)
        c.add_argument("--min-coverage", type=float, default=0.4)
        c.add_argument("--objective", default="x_coverage")
        c.add_argument("--constants", nargs="*", default=usual_constants(), help="relations whose objects are bound")
        c.add_argument("--categorical", nargs="*", default=usual_categorical(), help="relations that need a bound object")
    # the last one, cluster, has more
    c.add_argument("--model", default="transe", choices=embedding.MODELS)
    c.add_argument("--size", type=int, default=100)
    c.add_argument("--epochs", type=int, default=100)
    c.add_argument("--rate", type=float, default=0.05)
    c.add_argument("--method", default="kmeans", choices=sorted(clustering.METHODS))
    c.add_argument("--clusters", type=int, default=2)
    c.add_argument("--iterations", type=int, default=10)
    c.add_argument("--strategy", default="entexplcls", choices=sorted(deduction.STRATEGIES))
    c.add_argument("--update-mode", default="adapt_progressive", choices=embedding.UPDATE_MODES)
    c.add_argument("--data-mode", default="assignments_subgraph", choices=embedding.DATA_MODES)
    c.add_argument("--seed", type=int, default=0)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("lucidgraph").getOrCreate()
    kg, targets = read_triples(spark, a.kg, a.prefix), read_labels(spark, a.targets)
    if a.prefix:
        targets = targets.withColumns({"entity": entity_url(F.col("entity"), a.prefix), "relation": relation_url(F.col("relation"), a.prefix)})
    rules = mining.Settings(shape=a.shape, max_length=a.max_length, min_coverage=a.min_coverage, objective=a.objective, constant_relations=a.constants, categorical_relations=a.categorical)
    spark.createDataFrame([(json.dumps(vars(a)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/settings")
    if a.command == "explain":
        write_rules(spark, mining.as_rules(mining.explain(kg, targets, rules)), f"{a.out}/explanations")
        return
    k = {"k": a.clusters} if a.method in ("kmeans", "spectral", "hierarchical") else {}
    training = embedding.Training(model=a.model, k=a.size, epochs=a.epochs, rate=a.rate)
    plan = Plan(iterations=a.iterations, method=a.method, method_settings=k, mining=rules, strategy=a.strategy, training=training, update_mode=a.update_mode, data_mode=a.data_mode, objective=a.objective, seed=a.seed)
    result = run(kg, targets, plan)
    for i in result.iterations:
        i.clusters.write.mode("overwrite").option("sep", "\t").csv(f"{a.out}/clusters/itr={i.number}")
        write_rules(spark, i.rules, f"{a.out}/explanations/itr={i.number}")
        embedding.save(i.model, f"{a.out}/model/itr={i.number}")
    write_metrics(spark, result.metrics(), f"{a.out}/metrics")


if __name__ == "__main__":
    main()
