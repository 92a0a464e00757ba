"""Clustering, embedding and the iterative pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidgraph import iterations
from lucidgraph.operators import clustering, embedding, evaluation, mining
from lucidgraph.sources import triples


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (np.array([4.0 * (i % 3), 3.0 * (i % 3 == 1)]) + rng.normal(0, 0.2, 2)).tolist()) for i in range(60)]
    return spark.createDataFrame(rows, "id long, vec array<double>"), rows


@pytest.mark.parametrize("name, settings", [("kmeans", {"k": 3, "restarts": 3}), ("dbscan", {"eps": 1.0, "least": 4}), ("hierarchical", {"k": 3}), ("spectral", {"k": 3})])
def test_three_blobs(points, name, settings):
    got = {r["id"]: r["cluster"] for r in clustering.method(name.upper(), **settings)(points[0]).collect()}
    assert len(got) == 60 and len(set(got.values())) == 3
    assert all(len({got[i] for i in range(60) if i % 3 == k}) == 1 for k in range(3))


def test_dbscan_noise_and_border(spark):
    rows = [(0, [0.0]), (1, [0.4]), (2, [0.8]), (3, [1.2]), (4, [9.0])]
    got = {r["id"]: r["cluster"] for r in clustering.dbscan(spark.createDataFrame(rows, "id long, vec array<double>"), eps=0.5, least=3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: -1}


def test_multicut_finds_the_number(spark):
    rows = [(i, [1.0, 0.01 * i]) for i in range(5)] + [(5 + i, [-1.0, 0.01 * i]) for i in range(5)]
    got = {r["id"]: r["cluster"] for r in clustering.multicut(spark.createDataFrame(rows, "id long, vec array<double>")).collect()}
    assert got == {i: int(i >= 5) for i in range(10)}


def test_unknown_and_too_many(points, monkeypatch):
    with pytest.raises(ValueError):
        clustering.method("nothing")
    monkeypatch.setattr(clustering, "MOST_POINTS", 10)
    with pytest.raises(ValueError):
        clustering.hierarchical(points[0])


def test_silhouette_by_hand(points, spark):
    frame, rows = points
    x, lab = np.array([v for _, v in rows]), np.array([i % 3 for i, _ in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(60):
        a = d[i][(lab == lab[i]) & (np.arange(60) != i)].mean()
        b = min(d[i][lab == k].mean() for k in range(3) if k != lab[i])
        want.append((b - a) / max(a, b))
    got = evaluation.silhouette(frame.withColumn("label", F.pmod("id", F.lit(3)))).first()["ss"]
    assert got == pytest.approx(np.mean(want))


def _kg(spark):
    rows = [(f"c{i}", "in", f"n{i % 4}") for i in range(40)] + [(f"n{k}", "of", f"r{k % 2}") for k in range(4)]
    return triples.from_list(spark, rows)


@pytest.mark.parametrize("model", embedding.MODELS)
def test_training_learns(spark, model):
    kg = _kg(spark)
    t = embedding.Training(model=model, k=12, epochs=60, rounds=2, rate=0.02 if model == "convkb" else 0.05)
    found, losses = embedding.train(kg, t)
    assert losses[-1] < losses[0]
    wrong = kg.filter("p = 'in'").withColumn("o", F.concat(F.lit("n"), F.pmod(F.substring("o", 2, 1).cast("int") + 1, F.lit(4)).cast("string")))
    mean = lambda df: embedding.predict(found, df).agg(F.avg("score")).first()[0]
    assert mean(kg.filter("p = 'in'")) > mean(wrong)


def test_averaging_over_tasks_and_going_on(spark, tmp_path):
    kg = _kg(spark)
    t = embedding.Training(k=8, epochs=16, rounds=2)
    found, _ = embedding.train(kg, t, tasks=3)
    assert found.entities.count() == 46 and found.relations.count() == 2
    grown, _ = embedding.train(kg.unionByName(triples.from_list(spark, [("new", "in", "n0")])), t, found)
    assert grown.entities.count() == 47
    embedding.save(grown, f"file://{tmp_path}/m")
    back = embedding.load(spark, f"file://{tmp_path}/m")
    assert back.training == t and back.entities.exceptAll(grown.entities).count() == 0
    with pytest.raises(KeyError):
        embedding.lookup(back.entities, spark.createDataFrame([("nowhere",)], "n string"), "raise")
    with pytest.raises(ValueError):
        embedding.train(kg, embedding.Training(model="other"))


def test_update_data_modes(spark):
    kg = _kg(spark)
    context = kg.limit(3)
    history = [triples.from_list(spark, [(f"f{i}", "p", "o")]) for i in range(3)]
    n = lambda mode, data, window=1: embedding.update_data(kg, context, history, mode, data, window).count()
    assert n("retrain", "subgraph_only") == 45 and n("adapt_restart", "subgraph_only") == 3 and n("adapt_restart", "graph_only") == 44
    assert n("adapt_progressive", "assignments_only", 2) == 2 and n("adapt_progressive", "assignments_subgraph") == 4 and n("adapt_progressive", "assignments_graph", 3) == 47


def test_matrix_file(spark, tmp_path):
    np.arange(6, dtype="<f4").tofile(tmp_path / "m.bin")
    names = spark.createDataFrame([("a", 0), ("b", 1)], "name string, id long")
    got = {r["name"]: r["vec"] for r in embedding.read_matrix(spark, f"file://{tmp_path}/m.bin", 3, names).collect()}
    assert got == {"a": [0, 1, 2], "b": [3, 4, 5]}


def test_iterations(spark):
    kg = _kg(spark)
    targets = spark.createDataFrame([(f"c{i}", "lives", f"r{i % 2}") for i in range(40)], "entity string, relation string, label string")
    plan = iterations.Plan(iterations=2, training=embedding.Training(k=8, epochs=20, rounds=1), mining=mining.Settings(shape="path", min_coverage=0.2))
    found = iterations.run(kg, targets, plan)
    assert [i.number for i in found.iterations] == [0, 1] and found.best() is found.last()
    assert all(sum(m["clusters_sizes"]) == 40 and 0 <= m["ACC"] <= 1 for m in found.metrics())
    assert found.base().metrics.get("curr_vs_prv") is None and -1 <= found.last().metrics["curr_vs_base"] <= 1
    assert len(list(iterations.settings_grid({"a": [1, 2], "b": "xyz"}))) == 6
