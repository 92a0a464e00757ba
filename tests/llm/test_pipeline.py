"""The stages of the corpus pipeline, each against a plain version of its decision."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice(["the", "on", "er", "ou", "an", "ti"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    item = text(30)
    rows = [(i, text(80), "en", f"s{i % 3}", 0) for i in range(200)]
    rows += [(200 + i, rows[i][1], "en", "s0", 0) for i in range(20)]
    rows += [(300 + i, " ".join("#|*" * 3 for _ in range(60)), "en", "s1", 0) for i in range(5)]
    rows += [(400, text(20) + " " + item + " " + text(20), "en", None, 0), (401, None, None, None, None)]
    path = tmp_path_factory.mktemp("data")
    write = lambda r, ddl, name: spark.createDataFrame(r, ddl).write.parquet(f"file://{path}/{name}.parquet")
    write(rows, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int", "labels")
    write([(1, item)], "item_id long, text string", "benchmark")
    return f"file://{path}"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, folder)
    assert good.columns == docs.columns and ids(good) == [*range(220), 400]
    single = stage["near_duplicates"](spark, good, folder)
    assert single.columns == docs.columns and ids(single) == [*range(200), 400]
    clean = stage["leaks"](spark, single, folder)
    assert clean.columns == docs.columns and ids(clean) == list(range(200))
    mixed = stage["mix"](spark, clean, folder)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(range(200)) and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    out = stage["shards"](spark, mixed, folder)
    assert ids(out) == ids(mixed) and set(docs.columns) < set(out.columns)
    assert ids(corpus_pipeline.run(spark, folder)) == ids(out)


def test_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit("clash") for c in ("size", "shard", "copies", "_bucket", "_kept", "_model", "_n", "print", "target")})
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, folder)
        if name != "shards":
            assert rows.columns == docs.columns and rows.filter("_kept != 'clash' OR size != 'clash'").count() == 0 < rows.count()
        else:
            assert len(set(rows.columns)) == len(rows.columns) and rows.filter("copies = 'clash' AND shard < 40").count() == docs.count()


def test_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
