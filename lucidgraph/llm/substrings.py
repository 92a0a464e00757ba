"""Substring dedup: repeats of 50 words by suffix trees that are partitioned by prefix.

A suffix tree of all texts would not fit anywhere, so suffixes are split by their prefixes in groups of which each fits
in memory, and a group's subtree is built on its own. Three things keep the groups few and small:

* Which prefix stands for a suffix is chosen by content. Of the 8-word sequences in each window of 50 words the one
  with the least hash is its anchor. Equal windows have the same anchor at the same place, so all of a window's
  occurrences are in the anchor's group, and windows that follow each other mostly share it: they are a run.
* Equal runs are one variant, whatever their number: only its smallest document matters. Where an anchor has one
  variant there is nothing to compare, and no text moves.
* Of the other variants the words are sent once each, by one occurrence in the smallest document. Texts stay in parts:
  a task is handed the places that it sends, and later the spans that it removes, by part, and no text is shuffled.

An anchor with more variants than a task should hold is dealt to several by a hash of the variant, and what these find
is merged by the whole 50 words, the longest prefix that counts. In a group the nodes of the tree at depth 1, 2, 4, 8, 16, 32 and 50 are
named level by level (equal names: equal words); a node at depth 50 that two documents share is a repeat, and
neighbouring ones in a document join to a maximal one. Nothing below depth 50 changes which words are removed.
"""

from __future__ import annotations

import hashlib
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucidgraph.llm.shared import PART, PartReader, by_part, by_value, in_parts, shared_dir, table, text_batches, written

WINDOW, ANCHOR = 50, 8
#: Variants of an anchor that one task takes as a group.
GROUP = 5_000
#: Variants of a larger group that go together: each comes with up to 43 nodes to be merged.
PIECE = 64
#: Words that are handled together; a batch of groups has at most this and one more group.
CHUNK_WORDS = 400_000
#: Occurrences from which a run is hot, and how many of the hottest all executors get (about 100 bytes each); the others
#: have less than a 200,000th of the occurrences each.
HOT, MOST_HOT = 2_000, 200_000

_BASE = 0x9E3779B97F4A7C15 | 1


def packed(words: list[bytes]) -> bytes:
    """Words, deflated: a run is sent through a shuffle once."""
    pack = zlib.compressobj(9, zlib.DEFLATED, -12, 5)
    return pack.compress(b" ".join(words)) + pack.flush()


def unpacked(data: bytes) -> list[bytes]:
    return zlib.decompress(data, -12).split()


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text: without an argument, bytes are split at U+0020 and U+0009 to U+000D, and only there."""
    return (text or b"").split()


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as asked for so far."""

    def __init__(self):
        self.inverse = pow(_BASE, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, 1 << 64))])
        return self.up, self.down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_places(grams: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of each ``span`` values that follow each other; the first of equals.

    Values are compared by their upper 40 bits, then by place. Minima to the left and to the right within blocks of
    ``span`` meet in each window.
    """
    n = len(grams)
    keys = (grams >> np.uint64(24) << np.uint64(24)) | (np.arange(n, dtype=np.uint64) & np.uint64(0xFFFFFF))
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, span)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(left[: n - span + 1], right[span - 1 : n]) & np.uint64(0xFFFFFF)
    at = np.arange(n - span + 1, dtype=np.int64)
    return at + ((low.astype(np.int64) - at) & 0xFFFFFF)


def runs(words: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, run, first window, windows) of the runs of a text's windows that share an anchor; run: a hash of all
    their words."""
    import xxhash

    n = len(words)
    if n < WINDOW:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    up, down = powers.get(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[:n], dtype=np.uint64)])
    grams = _mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
    places = least_places(grams, WINDOW - ANCHOR + 1)
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    count = np.diff(np.concatenate([first, [len(places)]]))
    whole = _mixed((sums[first + count + WINDOW - 1] - sums[first]) * down[first] + count.astype(np.uint64))
    return grams[places[first]], whole, first, count


_OCCURRENCE = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("doc", pa.int64()), ("tkey", pa.int64()), ("part", pa.int32()), ("first", pa.int32()), ("windows", pa.int32())])
_OCCURRENCE_DDL = "anchor long, run long, doc long, tkey long, part int, first int, windows int"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    seen: set[tuple[int, int]] = set()
    part_seen = None
    for batch in batches:
        found, own = [], []
        for doc, tkey, part, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "tkey", PART, "text"))):
            if part != part_seen:
                seen, part_seen = set(), part
            # of rows that repeat in a part one speaks for all
            if (doc, tkey) not in seen:
                seen.add((doc, tkey))
                found.append(runs(words_of(text), powers))
                own.append((doc, tkey, part))
        sizes = [len(f[0]) for f in found]
        if sum(sizes):
            anchor, run, first, count = (np.concatenate([f[i] for f in found]) for i in range(4))
            doc, tkey, part = (np.repeat(np.array([o[i] for o in own], np.int64), sizes) for i in range(3))
            columns = (anchor.view(np.int64), run.view(np.int64), doc, tkey, part.astype(np.int32), first.astype(np.int32), count.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_OCCURRENCE)


#: Keys with several texts of which all executors get a list.
MOST_SEVERAL = 200_000


def _told_apart(rows: DataFrame) -> DataFrame:
    """tkey is 0 for keys that have one text only: it goes with every run through two shuffles, and a hash doesn't
    compress."""
    several = rows.groupBy("doc").agg(F.min("tkey").alias("least"), F.max("tkey").alias("most")).filter("least < most AND doc IS NOT NULL")
    several = written(several.select(F.col("doc").alias("_doc")), "keys-with-several-texts")
    n = several.limit(MOST_SEVERAL + 1).count()
    if n == 0:
        return rows.withColumn("tkey", F.lit(0).cast("long"))
    if n > MOST_SEVERAL:
        return rows
    found = rows.join(F.broadcast(several), F.col("doc") == F.col("_doc"), "left")
    return found.withColumn("tkey", F.when(F.col("_doc").isNull(), F.lit(0).cast("long")).otherwise(F.col("tkey"))).select(*rows.columns)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, tkey, text): tkey tells texts of the same id apart."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} must be a whole number: words are removed by the order of documents")
    text_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(body).alias("tkey"), body.cast("binary").alias("text"))


_VARIANT = pa.schema([("anchor", pa.int64()), ("salt", pa.int32()), ("run", pa.int64()), ("doc", pa.int64()), ("windows", pa.int32()), ("words", pa.binary()), ("many", pa.bool_())])
_VARIANT_DDL = "anchor long, salt int, run long, doc long, windows int, words binary, many boolean"


def _of_part(reader: PartReader, part: int, columns: list[str]) -> dict[tuple[int, int], list[tuple]]:
    """What was handed to a part, by (doc, tkey)."""
    out = defaultdict(list)
    rows = reader.read(part)
    if rows is not None:
        for doc, tkey, *row in zip(*(rows.column(c).to_pylist() for c in ("doc", "tkey", *columns))):
            out[doc, tkey].append(tuple(row))
    return out


_PLACE = ["anchor", "run", "first", "windows", "salts"]


def _emitter(uri: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, places, known = PartReader(uri, ["doc", "tkey", *_PLACE]), {}, None
        rows: list[tuple] = []
        for batch in batches:
            for doc, tkey, part, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "tkey", PART, "text"))):
                if part != known:
                    places, known = _of_part(reader, part, _PLACE), part
                # what is sent once is not sent again for a row that repeats
                own = places.pop((doc, tkey), None)
                if own:
                    words = words_of(text)
                    rows += [(a, r % salts if salts > 1 else 0, r, doc, c, packed(words[f : f + c + WINDOW - 1]), salts > 1) for a, r, f, c, salts in own]
                if len(rows) >= 20_000:
                    yield _batch(rows, _VARIANT)
                    rows = []
        if rows:
            yield _batch(rows, _VARIANT)

    return emit


def nodes(groups: np.ndarray, words: list[bytes]) -> np.ndarray:
    """The name of the tree's node at depth 50 for each place, of words one after the other and their groups' numbers.

    Names are equal if and only if the group and the next 50 words are. Places whose 50 words cross a run's end get
    names that mean nothing.
    """
    own = pd.factorize(np.array(words, object))[0].astype(np.int64)
    names = pd.factorize(own * (int(groups.max(initial=0)) + 1) + groups)[0].astype(np.int64)
    depth = 1
    while depth < WINDOW:
        step = min(depth, WINDOW - depth)
        later = np.concatenate([names[step:], np.full(step, -1, np.int64)])
        names = pd.factorize(names * (len(names) + 2) + later + 1)[0].astype(np.int64)
        depth += step
    return names


class Chunk:
    """The variants of some groups, with the node of each window. A variant's smallest document is its first row's."""

    def __init__(self, rows: list[dict]):
        self.rows = [r for i, r in enumerate(rows) if not i or (r["anchor"], r["run"]) != (rows[i - 1]["anchor"], rows[i - 1]["run"])]
        split = [unpacked(r["words"]) for r in self.rows]
        lengths = np.array([len(x) for x in split], np.int64)
        key = np.array([(r["anchor"], r["salt"]) for r in self.rows], np.int64).reshape(-1, 2)
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).any(1)]))[: len(self.rows)]
        names = nodes(np.repeat(group, lengths), [w for x in split for w in x])
        starts = np.cumsum(lengths) - lengths
        counts = np.array([r["windows"] for r in self.rows], np.int64)
        self.run = np.repeat(np.arange(len(self.rows)), counts)
        self.inside = np.arange(len(self.run)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.node = pd.factorize(names[np.repeat(starts, counts) + self.inside])[0]
        self.doc = np.array([r["doc"] for r in self.rows], np.int64)[self.run]
        self.split = split

    def least(self) -> np.ndarray:
        """The smallest document of each node."""
        low = np.full(int(self.node.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, self.node, self.doc)
        return low

    def digests(self) -> list[tuple[int, int, int]]:
        """(a window that has it, 128 bits of its words in two) of each node."""
        import xxhash

        first = np.full(int(self.node.max(initial=-1)) + 1, -1, np.int64)
        first[self.node[::-1]] = np.arange(len(self.node))[::-1]
        out = []
        for i in first.tolist():
            at = int(self.inside[i])
            value = xxhash.xxh3_128_intdigest(b" ".join(self.split[int(self.run[i])][at : at + WINDOW]))
            out.append((i, (value >> 64) - (1 << 63), (value & (1 << 64) - 1) - (1 << 63)))
        return out

    def found(self, low: np.ndarray) -> pa.RecordBatch:
        """For each variant the smallest document of its windows, as (windows from, to, document)."""
        value = low[self.node]
        new = np.flatnonzero(np.concatenate([[True], (self.run[1:] != self.run[:-1]) | (value[1:] != value[:-1])])) if len(value) else np.empty(0, np.int64)
        ends = np.concatenate([new[1:], [len(value)]]) if len(new) else new
        at = self.inside[new]
        offsets = np.concatenate([np.searchsorted(self.run[new], np.arange(len(self.rows))), [len(new)]]).astype(np.int32)
        parts = pa.StructArray.from_arrays([pa.array(x.astype(np.int32) if i < 2 else x) for i, x in enumerate((at, at + ends - new, value[new]))], ["a", "b", "low"])
        return pa.RecordBatch.from_arrays([pa.array([r["anchor"] for r in self.rows], pa.int64()), pa.array([r["run"] for r in self.rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), parts)], ["anchor", "run", "parts"])


_FOUND_DDL = "anchor long, run long, parts array<struct<a:int,b:int,low:long>>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows sorted by (anchor, salt) in lists that end with a group."""
    rows, size, key = [], 0, None
    for batch in batches:
        for r in batch.to_pylist():
            if (r["anchor"], r["salt"]) != key:
                if size >= CHUNK_WORDS:
                    yield rows
                    rows, size = [], 0
                key = (r["anchor"], r["salt"])
            rows.append(r)
            size += (r["windows"] or 0) + WINDOW
    if rows:
        yield rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_NODE = pa.schema([("anchor", pa.int64()), ("salt", pa.int32()), ("n1", pa.int64()), ("n2", pa.int64()), ("low", pa.int64())])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups that are whole."""
    for rows in _chunks(batches):
        chunk = Chunk(rows)
        yield chunk.found(chunk.least())


def _part_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each part of a split group, with the smallest document there."""
    for rows in _chunks(batches):
        chunk = Chunk(rows)
        low = chunk.least()
        yield _batch([(chunk.rows[chunk.run[i]]["anchor"], chunk.rows[chunk.run[i]]["salt"], a, b, int(low[chunk.node[i]])) for i, a, b in chunk.digests()], _NODE)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Split groups; a part comes with its nodes and their smallest document in all parts."""
    for rows in _chunks(batches):
        known = {(r["anchor"], r["salt"], r["n1"], r["n2"]): r["low"] for r in rows if r["words"] is None}
        chunk = Chunk([r for r in rows if r["words"] is not None])
        low = np.array([known[chunk.rows[chunk.run[i]]["anchor"], chunk.rows[chunk.run[i]]["salt"], a, b] for i, a, b in chunk.digests()], np.int64)
        yield chunk.found(low)


def compared(rows: DataFrame, variants: DataFrame) -> DataFrame | None:
    """(anchor, run, parts) of the variants of anchors that have several, from their trees; None if there is none."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    several = variants.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).filter("n > 1 AND low < high").select("anchor", "n")
    several = written(several, "anchors")
    size = several.agg(F.max("n").alias("most")).first()
    if size["most"] is None:
        return None
    salts = F.when(F.col("n") > GROUP, F.ceil(F.col("n") / PIECE)).otherwise(1).cast("int").alias("salts")
    leaders = variants.select("anchor", "run", "place.*").join(several.select("anchor", salts), "anchor")
    uri = by_part(leaders.select("part", "doc", "tkey", *_PLACE), "places-by-part")
    sent = rows.select("doc", "tkey", PART, "text").mapInArrow(_emitter(uri), _VARIANT_DDL)
    order = ("anchor", "salt", "run", "doc")
    together = lambda df: df.repartition(n, "anchor", "salt").sortWithinPartitions(*order)
    if size["most"] <= GROUP:
        return together(sent.drop("many")).mapInArrow(_whole, _FOUND_DDL)
    path = shared_dir(spark, "variants-sent")
    # the words are deflated already
    sent.write.option("compression", "uncompressed").partitionBy("many").parquet(path)
    sent = spark.read.schema(_VARIANT_DDL).parquet(path)
    whole = together(sent.filter("NOT many").drop("many")).mapInArrow(_whole, _FOUND_DDL)
    split = sent.filter("many").drop("many")
    part = written(together(split).mapInArrow(_part_nodes, "anchor long, salt int, n1 long, n2 long, low long"), "anchor-nodes")
    told = part.drop("low").join(part.groupBy("n1", "n2").agg(F.min("low").alias("low")), ["n1", "n2"])
    both = together(split.unionByName(told, allowMissingColumns=True))
    return whole.unionAll(both.mapInArrow(_parts, _FOUND_DDL))


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The texts in parts (doc, tkey, text, _part), and (part, doc, tkey, start, stop): the words of a document under
    windows whose words also start in one with a smaller key.

    Spans of a document can touch and overlap. ``tkey``, a hash of the text, tells rows of the same key apart, and is 0
    for other keys; they don't remove each other's words. Rows with a null key remove nothing and lose nothing. Keys are whole numbers.
    """
    rows = _told_apart(in_parts(_rows(docs, key, text), "texts-in-parts"))
    taken = written(rows.filter("doc IS NOT NULL").mapInArrow(_occurrences, _OCCURRENCE_DDL), "runs")
    place = F.min(F.struct("doc", "tkey", "part", "first", "windows")).alias("place")
    variants = taken.groupBy("anchor", "run").agg(F.max("doc").alias("high"), F.count(F.lit(1)).alias("n"), place)
    variants = written(variants.withColumn("low", F.col("place.doc")), "variants")
    trees = compared(rows, variants)
    trees = written(trees, "trees") if trees is not None else taken.sparkSession.createDataFrame([], _FOUND_DDL)
    both = ["anchor", "run"]
    again = variants.filter("low < high").select("anchor", "run", "low")
    hot = variants.filter(F.col("n") > HOT).orderBy(F.col("n").desc()).limit(MOST_HOT).select("anchor", "run", F.ceil(F.col("n") / HOT).cast("int").alias("salts"))
    hot = written(hot, "hot-runs")
    if hot.first() is not None:
        # runs with very many occurrences are dealt to several tasks, and what is known of them to each
        salted = lambda df: df.join(F.broadcast(hot), both, "left")
        every = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
        taken = salted(taken).withColumn("salt", F.pmod(F.xxhash64("doc", "first"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        again, trees = salted(again).select("anchor", "run", "low", every), salted(trees).select("anchor", "run", "parts", every)
        both = [*both, "salt"]
    # by merges at every size, as one side grows with the other
    seen = taken.join(again.hint("merge"), both, "left").join(trees.hint("merge"), both, "left")
    alone = f"if(low < doc, array(named_struct('start', first, 'stop', first + windows + {WINDOW - 1})), array())"
    shared = f"transform(filter(parts, x -> x.low < doc), x -> named_struct('start', first + x.a, 'stop', first + x.b + {WINDOW - 1}))"
    return rows, seen.select("part", "doc", "tkey", F.expr(f"inline(if(parts IS NULL, {alone}, {shared}))"))


_KEPT = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _remover(uri: str, digest: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, spans, known = PartReader(uri, ["doc", "tkey", "start", "stop"]), {}, None
        for batch in batches:
            rows = []
            for doc, tkey, part, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "tkey", PART, "text"))):
                if part != known:
                    spans, known = _of_part(reader, part, ["start", "stop"]), part
                words = words_of(text)
                n = len(words)
                if doc is not None and (own := spans.get((doc, tkey))):
                    gone = np.zeros(n, bool)
                    for start, stop in own:
                        gone[start:stop] = True
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                kept = b" ".join(words)
                rows.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
            yield _batch(rows, _KEPT)

    return remove


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc, n_words, n_removed, kept) of every row; kept: the words that stay, joined by a space, or their SHA-256.

    Null and empty texts have no words. Repeated rows lose the same words each. An empty table gives an empty result.
    Other columns are ignored; a key that is no whole number is an error.
    """
    rows, spans = find_repeats(docs, key, text)
    uri = by_part(spans, "spans-by-part")
    return rows.mapInArrow(_remover(uri, digest), "doc long, n_words long, n_removed long, kept string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return kept.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
m AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY h) AS low FROM p) WHERE doc_id > low),
g AS (SELECT DISTINCT rid, i + o AS i FROM m, (SELECT unnest(range(0, 50)) AS o)),
k AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS kept, count(*) AS n FROM
        (SELECT rid, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN g USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""


by_value(sys.modules[__name__])
