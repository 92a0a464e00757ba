"""Patterns, mining, deduction and feedback on a small graph, against brute force and by hand."""

import itertools
import random

import pytest

from lucidgraph.functions.measures import MEASURES, with_measures
from lucidgraph.operators import deduction, evaluation, graph, mining
from lucidgraph.plans.patterns import connected_order, match
from lucidgraph.plans.rules import Atom, Rule, is_var
from lucidgraph.sources import labels as label_sources
from lucidgraph.sources import output, triples

HEAD = Atom("?x", "in", "?c")


def rule(*atoms, head=HEAD, **q):
    return Rule(head, tuple(Atom(*a) for a in atoms), q)


@pytest.fixture(scope="module")
def films(spark):
    """Actors work under directors and are in films; directors have a genre; types of all."""
    rows = []
    for i in range(12):
        a, boss = f"a{i}", f"d{i % 3}"
        rows += [(a, "under", boss), (f"f{i % 4}", "cast", a), (a, "type", "person"), (a, "type", "male" if i % 2 else "female")]
    for j in range(3):
        rows += [(f"d{j}", "type", "person"), (f"f{j}", "cast", f"d{j}"), (f"d{j}", "genre", "drama" if j else "crime")]
    rows += [("drama", "type", "film"), ("crime", "type", "film")]
    return rows


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(f"a{i}", "in", "actor") for i in range(12)] + [(f"d{j}", "in", "director") for j in range(3)]
    return spark.createDataFrame(rows, "entity string, relation string, label string")


def brute(facts, r, injective=True, last_differs=True):
    """All bindings of a rule's variables."""
    facts, names = set(facts), list(dict.fromkeys(["?x", *(v for a in r.body for v in a.variables())]))
    nodes = sorted({t for s, _, o in facts for t in (s, o)})
    out = set()
    for values in itertools.product(nodes, repeat=len(names)):
        b = dict(zip(names, values))
        if injective and len(set(values)) < len(values):
            continue
        ground = [tuple(b.get(t, t) for t in (a.s, a.p, a.o)) for a in r.body]
        if all(g in facts for g in ground) and not (last_differs and ground[-1] in ground[:-1]):
            out.add(values)
    return names, out


RULES = [
    rule(("?x", "under", "?y")),
    rule(("?y", "under", "?x")),
    rule(("?x", "under", "?y"), ("?y", "genre", "drama")),
    rule(("?x", "under", "?y"), ("?z", "under", "?y")),
    rule(("?f", "cast", "?x"), ("?f", "cast", "?y"), ("?x", "under", "?y")),
    rule(("?x", "type", "male"), ("?x", "type", "?t")),
]


@pytest.mark.parametrize("injective", [True, False])
@pytest.mark.parametrize("r", RULES, ids=str)
def test_match_is_brute_force(spark, films, r, injective):
    kg = triples.from_list(spark, films)
    names, want = brute(films, r, injective)
    got = match(kg, [r], injective=injective)
    assert {tuple(row[f"v_{n[1:]}"] for n in names) for row in got.collect()} == want
    few = {row[0] for row in match(kg, [r], keep=["?x"], injective=injective).select("v_x").collect()}
    assert few == {v[0] for v in want}


def test_rules_of_one_shape_share_a_plan(spark, films, labels):
    kg = triples.from_list(spark, films)
    own = [rule(("?x", "under", "?y"), ("?y", "genre", g)) for g in ("drama", "crime")]
    got = {(r["rule_id"], r["cluster"]): (r["support"], r["size"]) for r in mining.supports(kg, own, labels).collect()}
    assert got == {
        (own[0].rule_id(), "actor"): (8, 12), (own[1].rule_id(), "actor"): (4, 12), (own[0].rule_id(), "director"): (0, 3), (own[1].rule_id(), "director"): (0, 3),
    }


def test_connected_order():
    body = [Atom("?a", "p", "?b"), Atom("?x", "q", "?a")]
    assert connected_order(body, ["?x"]) == [1, 0]


def test_measures_by_hand(spark):
    rows = [("r", "a", 8, 10), ("r", "b", 1, 5), ("r", "c", 0, 20), ("none", "a", 0, 10), ("none", "b", 0, 5), ("none", "c", 0, 20)]
    got = {(r["rule_id"], r["cluster"]): r for r in with_measures(spark.createDataFrame(rows, "rule_id string, cluster string, support long, size long")).collect()}
    r = got["r", "a"]
    assert r["c_coverage"] == pytest.approx(0.8) and r["n_coverage"] == pytest.approx(0.8) and r["x_coverage"] == pytest.approx(0.6)
    assert r["wr_acc"] == pytest.approx(9 / 35 * (8 / 9 - 10 / 35)) and r["tfidf"] == pytest.approx(0.8 * (0.39794000867 + 1))
    assert got["r", "b"]["x_coverage"] == 0 and got["none", "a"]["n_coverage"] is None and got["none", "a"]["wr_acc"] is None


def test_mined_supports_are_brute_force(spark, films, labels):
    kg = triples.from_list(spark, films)
    for shape in mining.SHAPES:
        rules, grid = mining.Miner(kg, mining.Settings(shape=shape, min_coverage=0.5, beam=-1, constant_relations=("genre", "type"))).mine(labels)
        by_id = {r.rule_id(): r for r in rules}
        assert len(by_id) == len(rules) > 2
        members = {"actor": {f"a{i}" for i in range(12)}, "director": {f"d{j}" for j in range(3)}}
        for row in grid.collect():
            found = {v[0] for v in brute(films, by_id[row["rule_id"]])[1]}
            assert row["support"] == len(found & members[row["cluster"]]) > int(0.5 * row["size"]), (shape, by_id[row["rule_id"]].text())
            assert 0 <= row["x_coverage"] <= 1


def test_support_does_not_grow_with_the_body(spark, films, labels):
    kg = triples.from_list(spark, films)
    chain = [rule(("?x", "under", "?y")), rule(("?x", "under", "?y"), ("?f", "cast", "?x")), rule(("?x", "under", "?y"), ("?f", "cast", "?x"), ("?f", "cast", "?y"))]
    got = {(r["rule_id"], r["cluster"]): r["support"] for r in mining.supports(kg, chain, labels).collect()}
    for c in ("actor", "director"):
        own = [got[r.rule_id(), c] for r in chain]
        assert own == sorted(own, reverse=True)


def test_first_generation_rules(spark, films, labels):
    kg = triples.from_list(spark, films)
    s = mining.Settings(shape="path", min_coverage=0.4, beam=-1, first_generation=True, constant_relations=("genre", "type"), categorical_relations=("genre", "type"))
    rules, grid = mining.Miner(kg, s).mine(labels)
    table = mining.rules_table(rules, grid, "in")
    got = {(r["cluster"], r["body_text"]): r["support"] for r in table.collect()}
    # constants only beyond the first atom, and never an unbound categorical relation at the end
    assert got["actor", "(?x under ?x1), (?x1 type person)"] == 12 and got["actor", "(?x under ?x1), (?x1 genre drama)"] == 8
    assert got["director", "(?x genre ?x1), (?x1 type film)"] == 3
    assert not any(b in ("(?x type person)", "(?x type ?x1)", "(?x under ?x1), (?x1 type ?x2)") for _, b in got)
    # a path may go on to a node it was at, but not back over the relation that it came by
    assert not any("(?x under ?x1), (?x2 under ?x1)" == b for _, b in got)


def test_infer_and_feedback(spark, films):
    kg = triples.from_list(spark, films)
    own = [
        rule(("?x", "under", "?y"), head=Atom("?x", "in", "actor"), x_coverage=0.9),
        rule(("?x", "type", "male"), head=Atom("?x", "in", "actor"), x_coverage=0.4),
        rule(("?f", "cast", "?x"), head=Atom("?x", "in", "director"), x_coverage=0.5),
    ]
    targets = spark.createDataFrame([("a1",), ("d1",)], "e string")
    got = {(r["s"], r["o"]): (r["quality"], r["main_rule"], len(r["sources"]), r["rank"]) for r in deduction.infer(kg, own, targets).collect()}
    assert got == {("a1", "actor"): (0.9, own[0].rule_id(), 2, 1), ("a1", "director"): (0.5, own[2].rule_id(), 1, 2), ("d1", "director"): (0.5, own[2].rule_id(), 1, 1)}
    one = deduction.infer(kg, own, targets, min_quality=0.5, topk=1)
    assert [(r["s"], r["o"]) for r in one.collect()] == [("a1", "actor")]  # strictly above
    assert {tuple(r) for r in deduction.direct(one, 2).collect()} == {("a1", "in_2", "actor")}
    nodes = deduction.feedback(kg, own, targets, "entExplCls", 0.4, iteration=1)
    assert nodes.count() == 6 and deduction.feedback(kg, own, targets, "explasedges", 0.4).count() == 3
    assert deduction.feedback(kg, own, None, "sameclas").count() == 12**2 + 3**2
    with pytest.raises(ValueError):
        deduction.strategy("unknown")


def test_slice_grows_with_hops(spark, films):
    kg, seed = triples.from_list(spark, films), spark.createDataFrame([("a0",)], "node string")
    sizes = [graph.subgraph(kg, seed, h).count() for h in (1, 2, 3)]
    assert sizes[0] == 4 and sizes == sorted(sizes)
    assert graph.subgraph(kg, seed, 1, limit=1).count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "t").write_text("a p b \nc\tp  d e\nx\\y p z\nshort p\n\nNA null q\n")
    assert {tuple(r) for r in triples.read_triples(spark, str(tmp_path / "t")).collect()} == {("a", "p", "b"), ("c", "p", "d"), ("NA", "null", "q")}
    (tmp_path / "l").write_text("e1\ne2 k\ne3 rel k2\n")
    got = {r["entity"]: (r["relation"], r["label"]) for r in label_sources.read_labels(spark, str(tmp_path / "l"), "aux").collect()}
    assert got == {"e1": ("aux", "e1"), "e2": ("aux", "k"), "e3": ("rel", "k2")}
    full = triples.formatted(triples.from_list(spark, [("<a b>", "rdf:type", "http://h/x y"), ("c", "http://h/p", "é")]), "http://e.org/", True)
    assert {tuple(r) for r in full.collect()} == {("http://e.org/a%20b", "rdf:type", "http://h/x%20y"), ("http://e.org/c", "http://h/p", "http://e.org/%C3%A9")}
    d = label_sources.dictionary(spark.createDataFrame([("b",), ("a",), ("abc",), ("abcd",), ("abce",), ("a",), (None,)], "name string"))
    assert [tuple(r) for r in d.orderBy("id").collect()] == [(n, i) for i, n in enumerate(["a", "abc", "abcd", "abce", "b"])]


def test_rules_written_and_read(spark, tmp_path):
    own = {"c1": [rule(("?x", "p", f"k{i}"), head=Atom("?x", "in", "c1"), x_coverage=i / 20) for i in range(12)]}
    output.write_rules(spark, own, f"file://{tmp_path}/rules", limit=10)
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/rules").collect()].count("") == 1
    back = output.rules_by_cluster(output.read_rules(spark, f"file://{tmp_path}/rules.parsable"))
    assert set(back["c1"]) == set(own["c1"]) and len(back["c1"]) == 12 and not any(is_var(a.o) for r in back["c1"] for a in r.body)


def test_assignment_is_the_best():
    import numpy as np

    rng = random.Random(5)
    for n in (1, 2, 3, 5, 6):
        for _ in range(20):
            w = np.array([[rng.randrange(9) for _ in range(n)] for _ in range(n)])
            best = max(sum(w[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert sum(w[i, j] for i, j in evaluation.assignment(w)) == best


def test_scores_ignore_names(spark):
    rng = random.Random(2)
    rows = [(str(rng.randrange(3)), str(rng.randrange(4))) for _ in range(200)]
    frame = lambda r: evaluation.contingency(spark.createDataFrame(r, "truth string, predicted string"))
    one, other = (evaluation.partition_scores(frame(r)).first() for r in (rows, [("z" + a, str(9 - int(b))) for a, b in rows]))
    assert tuple(one) == pytest.approx(tuple(other))
    same = evaluation.partition_scores(frame([(a, "k" + a) for a, _ in rows])).first()
    assert tuple(same) == pytest.approx((1, 1, 1, 1))
    assert evaluation.accuracy(frame([(a, "k" + a) for a, _ in rows])) == (1.0, 1.0)
    assert MEASURES[2] == "x_coverage"
