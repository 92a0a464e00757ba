"""Tables of all pairs: each pair once, dealt in blocks, whatever the keys and vectors."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import sqlcheck
from lucidgraph import catalog
from lucidgraph.operators import blocks, deduction, evaluation
from lucidgraph.sources import output


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_same_cluster_deals_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(deduction, "PAIRED", 7, raising=False)
    rows = [(f"e{i}", "big") for i in range(60)] + [("e1", "big"), ("x", "one"), ("y", None), (None, "one")]
    found = deduction.same_cluster(spark.createDataFrame(rows, "s string, o string"), 3)
    want = sorted((a, "http://execute.org/sameCLAs_3", b) for a, c in rows for b, d in rows if c is not None and c == d if a and b)
    got = [tuple(r) for r in found.collect()]
    assert sorted(r for r in got if r[0] and r[2]) == want and len(got) == len(want) + 3
    # a cluster's pairs come from many rows that any task can take, not from one join key
    dealt = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < 0.6 * len(got)


@pytest.mark.parametrize("block", [3, 1024])
def test_distances_of_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    rows = [("a", [1.0, 2.0]), ("b", [1.0, 2.0]), ("c", [0.0, 0.0]), ("d", [1.0]), ("e", None), ("f", [1.0, None]), ("g", [-3.0, 4.0]), ("g", [5.0, 4.0]), (None, [1.0, 1.0]), ("h", []), ("i", [])]
    df = spark.createDataFrame(rows, "id string, vec array<double>")
    got = {}
    for r in evaluation.distance_table(df, {"d": ("euclidean", 1.0), "c": ("cosine", 0.5)}).collect():
        got.setdefault((r["i"], r["j"]), []).append((r["d"], r["c"]))
    keyed = [(k, v) for k, v in rows if k is not None]
    assert sum(map(len, got.values())) == sum(a < b for a, _ in keyed for b, _ in keyed)
    assert got["a", "b"] == [(0.0, pytest.approx(0.0, abs=1e-12))] and got["h", "i"] == [(0.0, None)]
    assert got["a", "c"] == [(math.sqrt(5.0), None)] and got["a", "d"] == got["a", "e"] == got["a", "f"] == got["f", "h"] == [(None, None)]
    assert sorted(x[0] for x in got["a", "g"]) == [math.sqrt(20.0), math.sqrt(20.0)] and len({x[1] for x in got["a", "g"]}) == 2


def test_distances_are_one_pass(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, vec array<float>")
    assert "MapInArrow" in _plan(evaluation.distances(df))
    assert evaluation.distances(df).count() == 50 * 49 // 2
    assert evaluation.distances(df.limit(0)).count() == 0


def test_rounding_is_spark_s(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.random(2000) * 3, np.round(rng.random(2000), 7), np.arange(0, 2000) / 2e6, [0.0, 0.0000005, 1.0000005, 2.5e-7, 1e300, np.inf, 123456789.1234565]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "n int, x double")
    want = [r[0] for r in df.orderBy("n").select(F.round("x", 6)).collect()]
    assert evaluation.rounded(x, 6).tolist() == want


def test_blocks_are_in_order_of_the_key(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(k), [float(k), 1.0]) for k in rng.permutation(100)], "id long, vec array<double>").repartition(3)
    runs = evaluation.distances(df, then=("i long, n long, least double", output.least_of_lines)).collect()
    want = {i: (99 - i, 1.0) for i in range(99)}
    got = {}
    for r in runs:
        n, least = got.get(r["i"], (0, math.inf))
        got[r["i"]] = n + r["n"], min(least, r["least"])
    # a block's rows of one i follow each other, so a block pair has a row for each of its points at most
    assert got == want and len(runs) < 100 * 2 * -(-100 // 16)


def test_lines_of_a_block():
    d = [0.1, None, 2.0, 1e-7, 1.0000000000000002, 1e22, math.inf]
    columns = {"i": pa.array([1, 1, 1, 2, 2, 3, 4]), "j": pa.array([2, 3, 4, 5, 6, 7, 8]), "d": pa.array(d)}
    text = output.distance_text(columns)
    assert text.to_pybytes().decode().split("\n")[:2] == ["1\t2\t0.1", "1\t3\t"]
    assert output.read_distance_text(text).to_pydict() == {k: v.to_pylist() for k, v in columns.items()}
    found = output.least_of_lines(columns)
    assert list(found["i"]) == [1, 2, 3, 4] and list(found["n"]) == [3, 2, 1, 1] and found["least"].to_pylist() == [0.1, 1e-7, 1e22, math.inf]


def test_lines_are_made_in_the_tasks_of_the_blocks(spark):
    plan = _plan(catalog.snk_distance_lines(spark, sqlcheck.FOLDER))
    assert "MapInArrow" in plan and "split(" not in plan
    assert sqlcheck.rows_of_query(spark, catalog.snk_distance_lines) == sqlcheck.rows_of_sql(catalog.SQL["snk_distance_lines"])


def test_equal_distances_follow_each_other(spark):
    parts = catalog.vec_distances(spark, sqlcheck.FOLDER).select(F.spark_partition_id(), "d").collect()
    down = sum(a[0] == b[0] and a[1] > b[1] for a, b in zip(parts, parts[1:]))
    assert down < len(parts) / 1000
    assert sqlcheck.rows_of_query(spark, catalog.vec_distances) == sqlcheck.rows_of_sql(catalog.SQL["vec_distances"])


def test_rows_in_order_are_whole(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    rows = [(i, None if i % 9 == 0 else [float(i * 37 % 50), 1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = evaluation.distance_table(df, {"d": ("euclidean", 1.0), "c": ("cosine", 1.0)}, digits=6, sort="d")
    assert sorted(map(str, got.collect())) == sorted(map(str, evaluation.distance_table(df, {"d": ("euclidean", 1.0), "c": ("cosine", 1.0)}, digits=6).collect()))


@pytest.mark.parametrize("n, lists, piece", [(40, 7, 3), (33, 100, 16), (1, 5, 4)])
def test_same_cluster_makes_few_rows_at_once(spark, monkeypatch, n, lists, piece):
    monkeypatch.setattr(deduction, "PAIRED", lists)
    monkeypatch.setattr(deduction, "AT_ONCE", piece, raising=False)
    found = deduction.same_cluster(spark.createDataFrame([(f"e{i}", "big") for i in range(n)], "s string, o string"))
    assert sorted((r["s"], r["o"]) for r in found.collect()) == sorted((f"e{i}", f"e{j}") for i in range(n) for j in range(n))
    # the pairs are made behind a stage that hands on lists cut into pieces
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 4
    assert "Coalesce" in found._jdf.queryExecution().executedPlan().toString()
