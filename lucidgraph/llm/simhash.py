"""SimHash near-duplicates: an inverted index of byte positions with count filtering.

A fingerprint has 8 bytes. Two that differ in at most 4 bits agree in at least 4 bytes in place: a pair is retained if
the tally of its shared positional bytes reaches 4, and then verified by its bits. To tally without listing every pair that shares
one byte, postings are of three places at once: of any 4 places out of 8, some 3 are one of 20 chosen triples, so every
pair with 4 shared bytes meets in a posting list, and lists are about 2^24 times shorter than the table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucidgraph.llm.shared import by_value, table, text_batches, written

BYTES, MOST_BITS, SHINGLE, SEED = 8, 4, 4, 42
#: Members of a posting list that are compared as one block; longer lists are compared block by block.
BLOCK = 2048


def covering_triples(places: int = BYTES) -> list[tuple[int, int, int]]:
    """Triples of places such that any 4 places hold one: the places are split in three groups; triples within a
    group, and two of a group with one of the next (4 places have 3 in a group, or 2 and 1 or more in the next)."""
    groups = [set(range(places)[i::3]) for i in range(3)]
    fits = lambda c: any(len(set(c) & g) == 3 or len(set(c) & g) == 2 and set(c) - g <= groups[(i + 1) % 3] for i, g in enumerate(groups))
    return [c for c in combinations(range(places), 3) if fits(c)]


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a UTF-8 text: see ``fingerprints``.

    Of bytes, lower() changes A-Z only, and split() splits at U+0020 and U+0009 to U+000D only.
    """
    import xxhash

    own = (text or b"").lower().split()
    if not own:
        return 0
    n = max(1, len(own) - SHINGLE + 1)
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(b" ".join(own[i : i + SHINGLE]), SEED) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(prints)], ["key", "print"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, print) of every row: A-Z in lower case, shingles of 4 words, repeats included, XXH64 of each.

    A bit is set if more than half the hashes have it. Null texts and texts without words have fingerprint 0.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("print", T.LongType())]))


def postings(prints: DataFrame) -> DataFrame:
    """(list, print): each distinct fingerprint in its 20 posting lists; a list is a triple and its three bytes."""
    byte = lambda i: F.shiftrightunsigned("print", 8 * i).bitwiseAND(F.lit(255))
    lists = [F.lit(k << 24).cast("long") + byte(a) * 65536 + byte(b) * 256 + byte(c) for k, (a, b, c) in enumerate(covering_triples())]
    return prints.select("print", F.explode(F.array(*lists)).alias("list"))


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """The tally of shared positional bytes of each pair: of its XOR ``x``, the bytes that are 0."""
    x = x | x >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return BYTES - np.bitwise_count(x & np.uint64(0x0101010101010101))


def linked_within(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in a, j in b) of the pairs that are retained by the tally of shared positional bytes and verified."""
    left, right = [], []
    step = max(1, (1 << 21) // max(1, len(b)))
    for at in range(0, len(a), step):
        x = (a[at : at + step, None] ^ b[None, :]).view(np.uint64)
        i, j = np.nonzero(shared_bytes(x) >= BYTES - MOST_BITS)
        near = np.bitwise_count(x[i, j]) <= MOST_BITS
        left.append(i[near] + at)
        right.append(j[near])
    return np.concatenate(left), np.concatenate(right)


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links (larger, smaller) that connect what the fingerprints' pairs connect: at most one per fingerprint.

    Each component is a star around its smallest member, so a list of n near copies gives n - 1 links, not n^2 / 2.
    """
    n = len(prints)
    if n < 2:
        return []
    root = np.arange(n)
    for at in range(0, n, BLOCK):
        for to in range(at, n, BLOCK):
            i, j = linked_within(prints[at : at + BLOCK], prints[to : to + BLOCK])
            i, j = i + at, j + to
            while True:
                a, b = root[i], root[j]
                low = np.minimum(a, b)
                if (a == b).all():
                    break
                np.minimum.at(root, a, low)
                np.minimum.at(root, b, low)
                while (root[root] != root).any():
                    root = root[root]
                i, j = i[a != b], j[a != b]
    return [(int(prints[k]), int(prints[root[k]])) for k in range(n) if root[k] != k]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (list, print): the links of each list."""
    kept_list, kept = None, []

    def flush():
        rows = forest(np.concatenate(kept)) if sum(map(len, kept)) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], schema=_LINK)

    for batch in batches:
        lists = batch.column("list").to_numpy(zero_copy_only=False)
        prints = batch.column("print").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
        out = []
        for at, to in zip(edges, [*edges[1:], len(lists)]):
            if lists[at] != kept_list:
                if len(kept) and sum(map(len, kept)) > 1:
                    out.append(flush())
                kept_list, kept = lists[at], []
            kept.append(prints[at:to])
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
    if kept:
        yield flush()


def links(prints: DataFrame, most: int = BLOCK * 8) -> DataFrame:
    """(a, b), a > b: links between distinct fingerprints that connect all that differ in at most 4 bits.

    Lists longer than ``most`` are dealt in blocks: the list's members go in chunks of ``most / 2`` by their rank, each
    pair of chunks is a list of its own, and so all pairs of the list still meet in one.
    """
    prints = prints.select("print").distinct()
    dealt = postings(prints)
    partitions = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    long_lists = dealt.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    long_lists = written(long_lists, "simhash-long-lists")
    if long_lists.first() is None:
        ranged = dealt.withColumn("pair", F.lit(0).cast("long"))
    else:
        tagged = dealt.join(long_lists, "list", "left")
        short = tagged.filter("n IS NULL").select("print", "list", F.lit(0).cast("long").alias("pair"))
        # chunks by a hash of the fingerprint: each pair of chunks (i <= j) gets both; the number follows the list
        chunks = F.ceil(F.col("n") * 2 / F.lit(most)).cast("long")
        own = F.pmod(F.xxhash64("print"), chunks)
        long_ = tagged.filter("n IS NOT NULL").withColumns({"chunks": chunks, "own": own})
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.least(j, F.col("own")) * F.col("chunks") + F.greatest(j, F.col("own")) + 1)
        ranged = short.unionByName(long_.select("print", "list", F.explode(pairs).alias("pair")))
    together = ranged.repartition(partitions, "list", "pair").sortWithinPartitions("list", "pair", "print")
    together = together.select(F.xxhash64("list", "pair").alias("list"), "print") if long_lists.first() is not None else together.select("list", "print")
    return together.mapInArrow(_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Large-star and small-star steps in turn: each node's neighbours are linked to the smallest of them, until nothing
    changes. Links stay at most as many as at first, and a step is one aggregation and one join, written to the shared
    folder.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        small = written(small, "small-star")
        # done once each node has one link, and no node is both an end and a centre
        state = small.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if state.filter("n > 1").first() is None and small.join(small.select(F.col("b").alias("a")).distinct(), "a", "left_semi").first() is None:
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = small


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, print, component) of every row; component: the smallest key that links of fingerprints reach. Keys may be
    of any type that has an order.

    Null and empty texts have fingerprint 0 and are linked as others are. Equal texts, ties and repeated rows share a
    fingerprint and so a component. Null keys are never the smallest, and have a null component where they are
    alone. An empty table gives an empty result. Other columns are ignored.
    """
    rows = written(fingerprints(docs, key, text), "fingerprints")
    own = written(rows.groupBy("print").agg(F.min("key").alias("least")), "distinct-fingerprints")
    found = components(links(own))
    of_print = own.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    smallest = of_print.groupBy("root").agg(F.min("least").alias("component"))
    named = of_print.join(smallest, "root").select("print", "component")
    return rows.join(named, "print").select("key", "print", "component")


def hex_digits(print_: str = "print"):
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, all columns as they are: the one with the component's key.

    Of rows that repeat that key one stays, the one whose text has the least hash. Rows with a null key stay: no
    component can name them.
    """
    found = written(near_duplicates(docs.filter(F.col(key).isNotNull()), key, text).select("key", "component"), "near-duplicates")
    stays = found.filter("key = component").groupBy("key").agg(F.count(F.lit(1)).alias("_rows"))
    kept = docs.join(stays.select(F.col("key").alias(key)), key, "left_semi")
    if stays.filter("_rows > 1").first() is not None:
        order = Window.partitionBy(key).orderBy(F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
        place = "_" * (1 + max(map(len, docs.columns)))  # longer than any name
        kept = kept.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
    return kept.unionByName(docs.filter(F.col(key).isNull()))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), hex_digits().alias("fingerprint"), F.col("component").alias("component_id"))


by_value(sys.modules[__name__])
