"""The command line, from files to files; and rules over a stream."""

import json

from lucidgraph import cli
from lucidgraph.operators import mining
from lucidgraph.plans.rules import Atom, Rule
from lucidgraph.sources import output, triples
from lucidgraph.streaming.supports import RunningSupports


def _files(folder):
    rows = [f"c{i}\tin\tn{i % 4} " for i in range(24)] + [f"n{k} of r{k % 2}" for k in range(4)]
    (folder / "kg").write_text("\n".join(rows) + "\n")
    (folder / "targets").write_text("".join(f"c{i}\tlives\tr{i % 2}\n" for i in range(24)))
    return ["--kg", f"file://{folder}/kg", "--targets", f"file://{folder}/targets", "--out", f"file://{folder}/out", "--prefix", "http://e.org/"]


def test_explain(spark, tmp_path):
    cli.main(["explain", *_files(tmp_path), "--min-coverage", "0.3", "--constants", "http://e.org/of"])
    rules = output.rules_by_cluster(output.read_rules(spark, f"file://{tmp_path}/out/explanations.parsable"))
    assert set(rules) == {"r0", "r1"} and all(r.head.p == "http://e.org/lives" for own in rules.values() for r in own)
    best = rules["r0"][0]
    assert best.qualities["x_coverage"] == 1.0 and {a.p for a in best.body} <= {"http://e.org/in", "http://e.org/of"}
    assert json.loads(spark.read.text(f"file://{tmp_path}/out/settings").first()[0])["command"] == "explain"


def test_cluster(spark, tmp_path):
    cli.main(["cluster", *_files(tmp_path), "--min-coverage", "0.3", "--size", "6", "--epochs", "8", "--iterations", "2", "--clusters", "2", "--strategy", "direct"])
    metrics = spark.read.csv(f"file://{tmp_path}/out/metrics", header=True)
    assert metrics.count() == 2 and metrics.columns == list(output.METRIC_HEADERS)
    assert spark.read.csv(f"file://{tmp_path}/out/clusters/itr=1", sep="\t").count() == 24


def test_running_supports(spark, tmp_path):
    labels = spark.createDataFrame([("a", "in", "c"), ("b", "in", "c"), ("d", "in", "e")], "entity string, relation string, label string")
    rules = [Rule(Atom("?x", "in", "?c"), (Atom("?x", "p", "?y"), Atom("?y", "q", "k"))), Rule(Atom("?x", "in", "?c"), (Atom("?x", "z", "?y"),))]
    running = RunningSupports(spark, rules, labels, f"file://{tmp_path}/state")
    batches = [[("a", "p", "m"), ("b", "p", "n")], [("m", "q", "k"), ("d", "z", "o")], [("n", "q", "k"), ("a", "p", "m")]]
    seen = []
    for i, b in enumerate([*batches, batches[-1]]):
        running.add(triples.from_list(spark, b), min(i, 2))  # the last batch comes twice
        seen += b
        want = {(r["rule_id"], r["cluster"]): r["support"] for r in mining.supports(triples.from_list(spark, seen).distinct(), rules, labels).collect()}
        got = {(r["rule_id"], r["cluster"]): r["support"] for r in running.current().collect()}
        assert all(got.get(k, 0) == v for k, v in want.items())
    assert got[rules[0].rule_id(), "c"] == 2 and got[rules[1].rule_id(), "e"] == 1
