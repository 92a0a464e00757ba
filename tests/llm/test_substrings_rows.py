"""What tells rows of the same key apart in op10 is sent only where there are such rows."""

import pytest
from pyspark.sql import functions as F

from lucidgraph.llm import substrings


@pytest.mark.parametrize("most", [0, 200_000])
def test_hashes_only_of_keys_with_several_texts(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "MOST_SEVERAL", most, raising=False)
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(1, text), (2, "a " + text), (2, "a " + text), (2, text + " b"), (2, None), (3, "c " + text), (4, "short"), (None, text), (None, "x")] * 2
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows, spans = substrings.find_repeats(frame)
    assert rows.count() == len(docs) and rows.filter("doc = 2").select("tkey").distinct().count() == 3
    if most:
        assert {r["doc"] for r in rows.filter("tkey != 0").collect()} == {2}
        assert spans.filter("doc = 3 AND tkey = 0").count() > 0 == spans.filter("doc = 3 AND tkey != 0").count()
    got = sorted((r["doc"] or 0, r["n_removed"], r["kept"]) for r in substrings.remove_repeats(frame).collect())
    kept = lambda d, t: {2: (t or "").replace(text, "").strip(), 3: "c"}.get(d, t)
    assert got == sorted((d or 0, 60 if d in (2, 3) and t else 0, kept(d, t)) for d, t in docs)


def test_one_text_for_each_key(spark):
    rows, _ = substrings.find_repeats(spark.createDataFrame([(i, f"text {i}") for i in range(5)] * 2, "doc_id long, text string"))
    assert rows.agg(F.max(F.abs("tkey"))).first()[0] == 0
