"""Executors that have no copy of the package: every operator ships its code with its tasks."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{folder}/checkpoint").getOrCreate()

def importable(batches):
    import pyarrow as pa
    for batch in batches:
        try:
            import lucidgraph
            found = 1
        except ImportError:
            found = 0
        yield pa.RecordBatch.from_pydict({{"found": [found]}})

assert spark.range(1).mapInArrow(importable, "found long").first()["found"] == 0
text = " ".join(f"w{{i % 97}}x{{i % 31}}" for i in range(120))
item = "What is the longest river of the northern lands? It is the old Tasman."
docs = spark.createDataFrame([(i, text + (" " + item if i == 3 else f" own{{i}}"), "en", "s", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
write = lambda df, name: df.write.parquet("file://{folder}/" + name + ".parquet")
write(docs, "documents")
write(docs.selectExpr("doc_id", "1 quality", "0 toxic"), "labels")
write(spark.createDataFrame([(1, item)], "item_id long, text string"), "benchmark")
write(spark.createDataFrame([(i, f"http://a.org/{{i}}", text) for i in range(5)], "page_id long, url string, html string"), "pages")
from lucidgraph.llm import queries
for name, query in queries.QUERIES.items():
    print(name, len(query(spark, "file://{folder}").collect()))
import corpus_pipeline
print("pipeline", len(corpus_pipeline.run(spark, "file://{folder}").collect()))
"""


def test_no_package_on_executors(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, folder=tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if " " in line)
    assert counts["op8_decontamination"] == "1" and counts["op4_simhash"] == counts["op5_perplexity"] == counts["op10_substrings"] == "60" and counts["op1_warc"] == "5" and len(counts) == 11
