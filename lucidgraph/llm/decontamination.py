"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND with every passage.

The test items are the documents of the index and each passage of a training text is a query. All items above a score
are retrieved, not a top k, and each hit is verified by the overlap of its question and its answer with the passage.
The score is each item's own: the least that a passage which passes verification can have.

Items are indexed in shards of bounded size, one after the other on the driver, each written to the shared folder; a
task loads one shard at a time. Nothing is broadcast, and executors need no copy of this package.
"""

from __future__ import annotations

import bisect
import math
import pickle
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucidgraph.llm.shared import by_value, shared_dir, table, text_batches

#: Words of a shingle, and the similarity from which a passage counts as a copy.
SHINGLE, SIMILAR = 5, 0.8
K1, B = 1.2, 0.75
#: Blocks of an index.
BLOCKS = 64
#: Bytes of item text and items in one index; more items are indexed in shards.
SHARD_BYTES, SHARD_ITEMS = 4 << 20, 10_000
#: Bytes of text that a task holds while it goes through the shards, if there are several.
HELD_BYTES = 64 << 20
#: Words of a text whose block bounds are computed together.
BOUND_WORDS = 1 << 16

_WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """An item's words, split before its last sentence; one sentence alone: before its last quarter."""
    parts = [p for p in (tokens(s) for s in re.split(r"(?<=[.?!])\s+|\n+", text or "")) if p]
    if not parts:
        return [], []
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    cut = len(parts[0]) - max(1, len(parts[0]) // 4)
    return parts[0][:cut], parts[0][cut:]


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    """The word shingles of a text; a shorter one is one shingle."""
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _may_lack(n: int) -> int:
    """Of n parts, how many a copy may lack."""
    return n - math.ceil(n * SIMILAR - 1e-9)


def _most_lost(words: list[str], weight: dict[str, float]) -> float:
    """No less than the weight of the words that a passage can lack, with ``SIMILAR`` of the shingles of ``words``.

    ``weight`` is of one occurrence. Lacking a place loses the shingles over it; places are chosen from left to right
    by the shingles lost so far. Places of one word are chosen apart and a shingle that is repeated may be lost at each
    of its places, so that the bound is never too low.
    """
    if not words:
        return 0.0
    size = min(SHINGLE, len(words))
    last = len(words) - size
    often = sorted(Counter(tuple(words[i : i + size]) for i in range(last + 1)).values(), reverse=True)
    may = sum(often[: _may_lack(len(often))])
    # ends[i]: the most weight by the number of shingles lost, where place i is the last that lacks
    ends: list[np.ndarray] = []
    before = np.full(may + 1, -np.inf)
    before[0] = 0.0
    best = 0.0
    for i, w in enumerate(words):
        own = np.full(may + 1, -np.inf)
        if i >= size:
            before = np.maximum(before, ends[i - size])
        for source, after in [(before, i - size + 1), *((ends[j], j + 1) for j in range(max(0, i - size + 1), i))]:
            lost = max(0, min(i, last) - max(0, i - size + 1, after) + 1)
            if lost <= may:
                own[lost:] = np.maximum(own[lost:], source[: may + 1 - lost] + weight[w])
        ends.append(own)
        best = max(best, float(own.max()))
    return best


def least_score(question: list[str], answer: list[str], impact: dict[str, float]) -> float:
    """No more than the share of the item's own score that any passage has which passes verification."""
    whole = question + answer
    weight = {w: impact[w] / tf for w, tf in Counter(whole).items()}
    by_parts = _most_lost(question, weight) + sum(sorted((weight[w] for w in answer), reverse=True)[: _may_lack(len(answer))])
    return max(1e-6, 1.0 - max(_most_lost(whole, weight), by_parts) - 1e-6)


class ItemIndex:
    """Postings of the items in blocks, each impact as a share of the item's ``least_score``: from 1 it is retrieved.

    Items are put in the order of their commonest word and length, so that a block's items are alike and its largest
    impacts bound them well. ``block_most[t, b]`` is the largest impact of term t in block b.
    """

    def __init__(self, items: list[tuple], n_items: int, mean_words: float, frequency: dict[str, int], longest: int = 1):
        """``items``: (id, text) or (id, text, times), as often as the row is repeated; ``longest``: of all shards."""
        rows, self.longest = [], longest
        for item, text, *times in items:
            question, answer = question_and_answer(text)
            whole = question + answer
            if not whole:
                continue
            own = {}
            for w, tf in Counter(whole).items():
                df = frequency[w]
                idf = math.log(1 + (n_items - df + 0.5) / (df + 0.5))
                own[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(whole) / mean_words))
            total = sum(own.values())
            commonest = max(own, key=lambda w: (frequency[w], w))
            impact = {w: x / total for w, x in own.items()}
            least = least_score(question, answer, impact)
            parts = (shingles(question), min(SHINGLE, len(question)), Counter(answer), shingles(whole), min(SHINGLE, len(whole)), least)
            rows.append((commonest, len(whole), item, parts, {w: x / least for w, x in impact.items()}, times[0] if times else 1))
            self.longest = max(self.longest, len(whole))
        rows.sort(key=lambda r: (*r[:2], r[2] is not None, str(r[2])))
        self.ids, self.parts, self.times = [r[2] for r in rows], [r[3] for r in rows], [r[5] for r in rows]
        self.terms = {w: i for i, w in enumerate(sorted({w for r in rows for w in r[4]}))}
        self.size = max(1, -(-len(rows) // BLOCKS))
        n = max(1, -(-len(rows) // self.size))
        # the last row is for words of no item
        self.block_most = np.zeros((len(self.terms) + 1, n), np.float32)
        self.blocks: list[dict[int, tuple[list[int], list[float]]]] = [{} for _ in range(n)]
        for doc, r in enumerate(rows):
            for w, x in r[4].items():
                t, b = self.terms[w], doc // self.size
                docs, impacts = self.blocks[b].setdefault(t, ([], []))
                docs.append(doc)
                impacts.append(x)
                self.block_most[t, b] = max(self.block_most[t, b], x)

    def search(self, query: list[int], least: float, blocks: list[int] | None = None) -> list[tuple[int, float]]:
        """Block-max WAND: every (item, score) with score >= least for a set of terms, block by block.

        A block is skipped if its largest impacts don't reach the score. In a block, the lists stand in the order of
        their next item; the first at which their bounds reach the score is the pivot, and no item before it can.
        """
        found = []
        if blocks is None:
            blocks = np.flatnonzero(self.block_most[query].sum(0) >= least - 1e-4).tolist()
        for b in blocks:
            lists = self.blocks[b]
            most = self.block_most[:, b]
            live = [[lists[t][0][0], 0, float(most[t]) + 1e-7, *lists[t]] for t in query if t in lists]
            while live:
                live.sort(key=lambda x: x[0])
                bound, pivot = 0.0, -1
                for i, x in enumerate(live):
                    bound += x[2]
                    if bound >= least:
                        pivot = i
                        break
                if pivot < 0:
                    break
                doc = live[pivot][0]
                if live[0][0] == doc:
                    score = sum(x[4][x[1]] for x in live if x[0] == doc)
                    if score >= least:
                        found.append((doc, score))
                    goal = doc + 1
                else:
                    goal = doc
                for x in live:
                    if x[0] < goal:
                        x[1] = bisect.bisect_left(x[3], goal, x[1])
                        x[0] = x[3][x[1]] if x[1] < len(x[3]) else -1
                live = [x for x in live if x[0] >= 0]
        return found

    def passages(self, words: list[str]) -> Iterator[tuple[int, int, list[int], list[int]]]:
        """(start, stop, terms, blocks) of the passages that some block's bound lets through.

        Passages have twice the longest item's words and start every such length, so that any copy of an item is whole
        in one. A term counts once in a passage: where it stood before within the passage, it adds nothing. The
        bounds of all passages and blocks are sums over chunks, computed together.
        """
        none, size = len(self.terms), self.longest
        get = self.terms.get
        ids = np.array([get(w, none) for w in words], np.int64)
        order = np.argsort(ids, kind="stable")
        before = np.full(len(ids), -1)
        same = ids[order[1:]] == ids[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        chunk = np.arange(len(ids)) // size * size
        here, near = before < chunk, before < chunk - size
        step = max(1, BOUND_WORDS // size) * size
        for at in range(0, len(ids), step):
            # the passages that start in these words, and the chunk after them
            to = min(len(ids), at + step + size)
            most = self.block_most[ids[at:to]]
            starts = np.arange(0, to - at, size)
            most[~here[at:to]] = 0
            bounds = np.add.reduceat(most, starts)
            most[~near[at:to]] = 0
            bounds[:-1] += np.add.reduceat(most, starts)[1:]
            bounds = bounds[: step // size]
            for k in np.flatnonzero((bounds >= 1 - 1e-4).any(1)).tolist():
                start, stop = at + k * size, min(len(ids), at + (k + 2) * size)
                yield start, stop, [t for t in set(ids[start:stop].tolist()) if t != none], np.flatnonzero(bounds[k] >= 1 - 1e-4).tolist()

    def copies(self, text: str | None) -> dict[int, tuple[float, float, float, float]]:
        """place of the item -> (score, question overlap, answer overlap, overlap) in its best passage that is a copy."""
        words = tokens(text)
        if not words or not self.ids:
            return {}
        best: dict[int, tuple[float, float, float, float]] = {}
        for start, stop, query, blocks in self.passages(words):
            hits = self.search(query, 1.0, blocks)
            if not hits:
                continue
            own = {SHINGLE: shingles(words[start:stop])}
            bag = Counter(words[start:stop])
            for item, score in hits:
                q, q_size, answer, whole, size, least = self.parts[item]
                # a part of fewer words is compared with the passage's shingles of as many
                for n in {q_size, size} - own.keys():
                    own[n] = shingles(words[start:stop], n) if n else set()
                question_share = len(q & own[q_size]) / len(q) if q else 1.0
                answer_share = sum((answer & bag).values()) / max(1, sum(answer.values()))
                overlap = len(whole & own[size]) / len(whole)
                if overlap >= SIMILAR or (question_share >= SIMILAR and answer_share >= SIMILAR):
                    best[item] = max(best.get(item, (0.0,) * 4), (score * least, question_share, answer_share, overlap), key=lambda x: (x[3], x[0]))
        return best

    def leaks(self, text: str | None) -> dict[int, tuple[float, float, float, float]]:
        """The copies by the items' ids."""
        return {self.ids[i]: v for i, v in self.copies(text).items()}


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, len(t), sorted(set(t))) for k, t in zip(batch.column("times").to_pylist(), map(tokens, batch.column("text").to_pylist())) if t]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.string())))], ["times", "n", "words"])


_COUNTED = "times long, n long, words array<string>"


def build_indexes(items: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[ItemIndex]:
    """One index for each ``SHARD_BYTES`` of text or ``SHARD_ITEMS`` items; frequencies are those of all items.

    Null and blank items are left out. Repeated items are items of their own, kept once with their number; a null id is
    an id. One index is on the driver at a time.
    """
    rows = items.filter(F.col(text).isNotNull()).groupBy(F.col(item).alias("item"), F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn("h", F.xxhash64(F.col("item").cast("string"), "text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("items")).first()
    shards = max(1, -(-(size["bytes"] or 0) // SHARD_BYTES), -(-size["items"] // SHARD_ITEMS))
    counted = lambda r: r.select("text", "times").mapInArrow(_count_words, _COUNTED)
    total = counted(rows).agg(F.sum("times").alias("items"), F.sum(F.col("n") * F.col("times")).alias("words"), F.max("n").alias("longest")).first()
    if not total["items"]:
        return
    frequencies = lambda r: counted(r).select("times", F.explode("words").alias("word")).groupBy("word").agg(F.sum("times").alias("df"))
    every = frequencies(rows)
    for shard in range(shards):
        own = rows.filter(F.pmod("h", F.lit(shards)) == shard) if shards > 1 else rows
        listed = [(r["item"], r["text"], r["times"]) for r in own.select("item", "text", "times").collect()]
        known = every.join(frequencies(own).select("word"), "word", "left_semi") if shards > 1 else every
        frequency = {r["word"]: r["df"] for r in known.collect()}
        yield ItemIndex(listed, total["items"], total["words"] / total["items"], frequency, total["longest"])


class Shards:
    """Indexes in the shared folder, pickled with their code: a task loads one at a time, or keeps the only one."""

    def __init__(self, uri: str, n: int):
        self.uri, self.n = uri, n

    def load(self, i: int) -> ItemIndex:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        with store.open_input_stream(f"{path}/{i}.index", compression=None) as f:
            return pickle.loads(f.read())

    def copies(self, batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
        """Each batch with, by row, (id, times, score, overlaps) of the items that it has copies of."""
        only = self.load(0) if self.n == 1 else None
        held, size = [], 0

        def searched():
            found = [[[] for _ in range(b.num_rows)] for b in held]
            for i in range(self.n):
                index = only or self.load(i)
                for b, rows in zip(held, found):
                    for own, t in zip(rows, b.column(text).to_pylist()):
                        own += [(index.ids[k], index.times[k], *v) for k, v in sorted(index.copies(t).items())]
            return zip(held, found)

        for batch in batches:
            held.append(batch)
            size += batch.column(text).nbytes
            if only is not None or size >= HELD_BYTES:
                yield from searched()
                held, size = [], 0
        if held:
            yield from searched()


def saved_indexes(spark: SparkSession, items: DataFrame, item: str, text: str) -> Shards:
    from pyarrow import fs

    uri, n = shared_dir(spark, "item-indexes"), 0
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    for n, index in enumerate(build_indexes(items, item, text), 1):
        with store.open_output_stream(f"{path}/{n - 1}.index", compression=None) as f:
            f.write(cloudpickle.dumps(index))
    return Shards(uri, n)


_FOUND = [("score", T.DoubleType()), ("question_overlap", T.DoubleType()), ("answer_overlap", T.DoubleType()), ("overlap", T.DoubleType())]


def _finder(shards: Shards):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in shards.copies(batches, 1):
            rows = [(key, x[0], *x[2:]) for key, own in zip(batch.column("key").to_pylist(), found) for x in own for _ in range(x[1])]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate([batch.column("key").type, pa.int64(), *[pa.float64()] * 4])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "item_id", *names])

    names = [n for n, _ in _FOUND]
    return find


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, overlap) of every copy of an item in a whole text.

    Null and empty texts have none; repeated rows and repeated items return their copies each; null ids, of documents
    and of items, are returned as null; a document's id may have any type, an item's is a whole number. Without items or texts
    the result is empty. Other columns are ignored. The texts don't move: each task goes through the indexes.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("item_id", T.LongType()), *[T.StructField(n, t) for n, t in _FOUND]])
    shards = saved_indexes(docs.sparkSession, items.withColumn(item, F.col(item).cast("long")), item, item_text)
    found = rows.mapInArrow(_finder(shards), schema) if shards.n else docs.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("key", key)


def _cleaner(shards: Shards, at: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in shards.copies(batches, at):
            yield batch.filter(pa.array([not own for own in found], pa.bool_()))

    return clean


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no copy of an item. Null and empty texts hold none."""
    text_batches(docs.sparkSession)
    shards = saved_indexes(docs.sparkSession, items, item, item_text)
    return docs.mapInArrow(_cleaner(shards, docs.columns.index(text)), docs.schema) if shards.n else docs


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c, _ in _FOUND])


#: Every passage and item that share a shingle are compared: what passes has one, or is an item of one word.
OP8_SQL = rf"""
WITH words(kind, id, rid, w, parts) AS (
  SELECT 'item', item_id, row_number() OVER () AS rid, NULL, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.?!])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+')), lambda p: len(p) > 0) FROM benchmark WHERE text IS NOT NULL
  UNION ALL SELECT 'doc', doc_id, row_number() OVER (), regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+'), NULL FROM documents),
i AS (SELECT id AS item_id, rid AS item, flatten(parts) AS w, CASE WHEN len(parts) > 1 THEN len(flatten(parts)) - len(parts[-1]) ELSE len(parts[1]) - greatest(1, len(parts[1]) // 4) END AS cut FROM words WHERE kind = 'item' AND len(parts) > 0),
n AS (SELECT count(*) AS items, avg(len(w)) AS mean, max(len(w)) AS longest FROM i),
tf AS (SELECT item, len(w) AS size, t, count(*) AS tf FROM (SELECT item, w, unnest(w) AS t FROM i) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
own AS (SELECT item, t, ln(1 + (items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * ({K1}::DOUBLE + 1) / (tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * size / mean)) AS x FROM tf JOIN df USING (t) CROSS JOIN n),
impact AS (SELECT item, t, x / sum(x) OVER (PARTITION BY item) AS x FROM own),
d AS (SELECT id AS doc_id, rid, w FROM words WHERE kind = 'doc' AND len(w) > 0),
p AS (SELECT doc_id, rid, c, w[c * longest + 1:(c + 2) * longest] AS w FROM (SELECT doc_id, rid, w, longest, unnest(range(0, (len(w) + longest - 1) // longest)) AS c FROM d CROSS JOIN n)),
x AS (SELECT item, item_id, w, w[1:cut] AS q, w[cut + 1:] AS a, least({SHINGLE}, len(w)) AS wn, least({SHINGLE}, cut) AS qn FROM i),
y AS (SELECT *, list_distinct(list_transform(range(1, len(w) - wn + 2), lambda k: array_to_string(w[k:k + wn - 1], ' '))) AS ws,
  CASE WHEN qn = 0 THEN [] ELSE list_distinct(list_transform(range(1, len(q) - qn + 2), lambda k: array_to_string(q[k:k + qn - 1], ' '))) END AS qs FROM x),
g AS (SELECT DISTINCT n, unnest(s) AS s, item FROM (SELECT wn AS n, ws AS s, item FROM y UNION ALL SELECT qn, qs, item FROM y)),
ps AS (SELECT rid, c, n, CASE WHEN n = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - n + 1) + 1), lambda k: array_to_string(w[k:k + n - 1], ' '))) END AS ps FROM p CROSS JOIN (SELECT DISTINCT unnest([wn, qn]) AS n FROM y)),
hit AS (SELECT DISTINCT rid, c, item FROM (SELECT rid, c, n, unnest(ps) AS s FROM ps) JOIN g USING (n, s)),
t AS (SELECT DISTINCT rid, c, unnest(w) AS t FROM p),
score AS (SELECT rid, c, item, sum(x) AS score FROM hit JOIN t USING (rid, c) JOIN impact USING (item, t) GROUP BY ALL),
o AS (SELECT h.rid, p.doc_id, h.item, y.item_id, h.score, CASE WHEN len(qs) = 0 THEN 1 ELSE len(list_intersect(qs, b.ps)) / len(qs)::DOUBLE END AS question_overlap,
  list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda z: z = x)), len(list_filter(p.w, lambda z: z = x))))) / greatest(1, len(a))::DOUBLE AS answer_overlap, len(list_intersect(ws, f.ps)) / len(ws)::DOUBLE AS overlap
  FROM score h JOIN p USING (rid, c) JOIN y USING (item) JOIN ps f ON f.rid = h.rid AND f.c = h.c AND f.n = y.wn JOIN ps b ON b.rid = h.rid AND b.c = h.c AND b.n = y.qn),
k AS (SELECT *, row_number() OVER (PARTITION BY rid, item ORDER BY overlap DESC, score DESC) AS r FROM o WHERE overlap >= {SIMILAR}::DOUBLE OR (question_overlap >= {SIMILAR}::DOUBLE AND answer_overlap >= {SIMILAR}::DOUBLE))
SELECT doc_id, item_id, round(score, 6) AS score, round(question_overlap, 6) AS question_overlap, round(answer_overlap, 6) AS answer_overlap, round(overlap, 6) AS overlap FROM k WHERE r = 1
"""


by_value(sys.modules[__name__])
