"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of characters, order 4. Its counts are tables: each task counts its texts, counts are summed by (language,
n-gram), and the adjusted counts, discounts, contexts and lower orders come from aggregations and joins of these tables
on n-gram keys. Scores come from joins too: the texts' tasks hand on the distinct n-grams of their part, these are joined
with the model's orders and back-offs - on n-gram keys, so that no task holds the model - and the logarithms go back by
part, where they are added up along each text. A task needs the n-grams of its own part in memory and nothing else.

A text is judged by its mean and by its worst few symbols in a row: a foreign word in long clean prose leaves the mean.
"""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucidgraph.llm.shared import PART, PartReader, Scratch, by_part, by_value, hashed, in_parts, table, text_batches, written

ORDER = 4
#: Bits of a symbol: a character of the basic plane is its code, others share the last; 0 stands before a text.
BITS, LAST = 16, 0xFFFF
POOLED = "*"
#: Trusted texts that a language needs for a model of its own; others use the pooled one.
LEAST_TRUSTED = 40
#: One in so many trusted texts is kept from training, for the thresholds.
HELD_OUT = 4
#: Trusted ids up to this number go to all executors (16 bytes each); beyond it they are joined.
MOST_BROADCAST = 2_000_000
#: Languages up to which a row for each goes to all tasks.
MOST_LANGUAGES = 10_000
#: Symbols of a language's middle that are put beside each text's own.
PRIOR = 200
#: Symbols in a row of which the worst are judged.
WORST = 6
#: What n held-out texts leave open widens a limit by this over sqrt(n): some standard errors of the 95 % quantile, 1.3
#: over sqrt(n) of its distance for a normal and 1.7 for Gumbel's.
WIDER, WORST_WIDER = 3.0, 7.0
#: Distinct n-grams that a counting task holds before it hands them on, and symbols that are scored together.
MOST_COUNTED, MOST_SYMBOLS = 500_000, 500_000


def symbols(text: str | None) -> np.ndarray:
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where((codes == 0) | (codes > LAST), LAST, codes).astype(np.uint64)


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol, packed in 64 bits, text after text, and the texts' lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    pad = np.zeros(ORDER - 1, np.uint64)
    line = np.concatenate([x for t in texts for x in (pad, t)] or [pad])
    real = np.ones(len(line), bool)
    starts = np.cumsum(lengths + ORDER - 1) - lengths - (ORDER - 1)
    for k in range(ORDER - 1):
        real[starts + k] = False
    grams = line[: len(line) - ORDER + 1].copy()
    for k in range(1, ORDER):
        grams <<= np.uint64(BITS)
        grams |= line[k : len(line) - ORDER + 1 + k]
    return grams[real[ORDER - 1 :]], lengths


def _chunks(texts: list[str | None]) -> Iterator[list[int]]:
    """Places of texts that are handled together."""
    own, size = [], 0
    for i, t in enumerate(texts):
        own.append(i)
        size += len(t or "") + ORDER
        if size >= MOST_SYMBOLS:
            yield own
            own, size = [], 0
    if own:
        yield own


_COUNT = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("c", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, pd.Series] = {}

    def out(lang, s):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(s), pa.string()), pa.array(s.index.to_numpy().view(np.int64)), pa.array(s.to_numpy().astype(np.int64))], schema=_COUNT)

    for batch in batches:
        by_lang = defaultdict(list)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by_lang[lang].append(text)
        for lang, texts in by_lang.items():
            for own in _chunks(texts):
                grams, _ = windows([symbols(texts[i]) for i in own])
                places, distinct = pd.factorize(grams)
                new = pd.Series(np.bincount(places, minlength=len(distinct)), index=distinct)
                held[lang] = held[lang].add(new, fill_value=0) if lang in held else new
                if len(held[lang]) > MOST_COUNTED:
                    yield out(lang, held.pop(lang))
    for lang, s in held.items():
        yield out(lang, s)


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids whose labels all say quality 1 and toxic 0. Null labels don't trust."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return labels.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(good.cast("int")).alias("_good")).filter("_good = 1").select(key)


def trusted_texts(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, scratch: Scratch) -> DataFrame:
    """(lang, text, held): the trusted rows. The ids are broadcast where their number allows."""
    ids = scratch.written(trusted_ids(labels, key), "trusted-ids")
    if ids.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    held = F.pmod(hashed(F.col(key), F.lit("held")), F.lit(HELD_OUT)) == 0
    rows = docs.filter(F.col(text).isNotNull() & (F.col(text) != "")).join(ids, key, "left_semi")
    return rows.select(F.coalesce(F.col(lang), F.lit(POOLED)).alias("lang"), F.col(text).alias("text"), held.alias("held"))


def _mask(k: int) -> int:
    return (1 << BITS * k) - 1


def train(texts: DataFrame, few: bool = True) -> DataFrame:
    """The model (lang, ord, code, p, bow) of texts (lang, text): probabilities of seen n-grams, back-off weights of
    contexts (null where an n-gram is only one of the two). Row (lang, 0, 0) has a new symbol's share as ``p``.

    The model is written; the tables it is made of are removed.

    ``few``: the languages are so few that a row for each can go to all tasks. Else n-grams are joined by language.
    """
    text_batches(texts.sparkSession)
    with Scratch(texts.sparkSession) as scratch:
        return written(_trained(texts, few, scratch), "ngram-model")


def _trained(texts: DataFrame, few: bool, scratch: Scratch) -> DataFrame:
    counts = texts.mapInArrow(_count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("a"))
    counts = scratch.written(counts, "ngram-counts")
    pooled = counts.withColumn("lang", F.lit(POOLED)).groupBy("lang", "gram").agg(F.sum("a").alias("a"))
    # each table is written: the next order is a small job of its own
    orders = {ORDER: scratch.written(counts.filter(F.col("lang") != POOLED).unionByName(pooled), f"ngram-order-{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        # continuation counts: distinct symbols before; what stands at a text's start keeps its count
        suffix = F.col("gram").bitwiseAND(F.lit(_mask(k)))
        first = F.shiftrightunsigned("gram", BITS * (k - 1)).bitwiseAND(F.lit(LAST)) if k > 1 else F.lit(1)
        below = orders[k + 1].select("lang", suffix.alias("gram"), "a").withColumn("at_start", first == 0)
        orders[k] = scratch.written(below.groupBy("lang", "gram").agg(F.when(F.first("at_start"), F.sum("a")).otherwise(F.count(F.lit(1))).alias("a")), f"ngram-order-{k}")
    # discounts by the counts of counts: three numbers per language
    n = [F.sum((F.col("a") == i).cast("long")).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.expr("n1 / (n1 + 2 * n2)")
    usual = F.expr("n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0")
    d = [F.when(usual, F.least(F.lit(float(i)), F.greatest(F.lit(0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(F.lit(i / 2)).alias(f"d{i}") for i in (1, 2, 3)]
    parts, lower = [], None
    for k in range(1, ORDER + 1):
        discounts = orders[k].groupBy("lang").agg(*n).select("lang", *d)
        discounts = F.broadcast(discounts) if few else discounts
        rows = orders[k].join(discounts, "lang").withColumn("d", F.expr("CASE a WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"))
        rows = rows.select("lang", "gram", "a", "d", F.shiftrightunsigned("gram", BITS).alias("context"))
        contexts = rows.groupBy("lang", "context").agg(F.sum("a").cast("double").alias("total"), F.sum("d").alias("lost"), F.count(F.lit(1)).alias("types"))
        contexts = scratch.written(contexts.select("lang", "context", "total", F.expr("lost / total").alias("weight"), "types"), f"ngram-contexts-{k}")
        seen = rows.join(contexts, ["lang", "context"]).select("lang", "gram", F.expr("(a - least(d, a)) / total").alias("own"), "weight", "types")
        if k == 1:
            # a new symbol takes part as one type more
            p = seen.select("lang", "gram", F.expr("own + weight / (types + 1)").alias("p"))
            nothing = F.lit(None).cast("double").alias("bow")
            parts.append(contexts.select("lang", F.lit(0).alias("ord"), F.lit(0).cast("long").alias("code"), F.expr("weight / (types + 1)").alias("p"), nothing))
        else:
            seen = seen.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(_mask(k - 1))))
            p = seen.join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("under")), ["lang", "suffix"]).select("lang", "gram", F.expr("own + weight * under").alias("p"))
            bows = contexts.select("lang", F.col("context").alias("gram"), F.col("weight").alias("bow"))
            parts.append(lower.join(bows, ["lang", "gram"], "full").select("lang", F.lit(k - 1).alias("ord"), F.col("gram").alias("code"), "p", "bow"))
        lower = scratch.written(p, f"ngram-probabilities-{k}")
    parts.append(lower.select("lang", F.lit(ORDER).alias("ord"), F.col("gram").alias("code"), "p", nothing))
    return _union(parts)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _wanted(languages: frozenset[str], lang: int, text: int, part: int):
    """The distinct n-grams of each part by model; those of a large part come in several rows."""

    def want(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], np.ndarray] = {}

        def out(key):
            grams = held.pop(key)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(grams), pa.int32()), pa.array([key[1]] * len(grams), pa.string()), pa.array(grams.view(np.int64))], ["part", "model", "gram"])

        for batch in batches:
            texts = batch.column(text).to_pylist()
            for key, rows in _grouped(batch, languages, lang, part).items():
                for own in _chunks([texts[i] for i in rows]):
                    grams, _ = windows([symbols(texts[rows[i]]) for i in own])
                    held[key] = np.union1d(held[key], grams) if key in held else np.unique(grams)
                    if len(held[key]) > MOST_COUNTED:
                        yield out(key)
        for key in list(held):
            yield out(key)

    return want


def _grouped(batch: pa.RecordBatch, languages: frozenset[str], lang: int, part: int) -> dict[tuple[int, str], list[int]]:
    """A batch's rows by part and model."""
    rows = defaultdict(list)
    for i, (p, x) in enumerate(zip(batch.column(part).to_pylist(), batch.column(lang).to_pylist())):
        rows[p, x if x in languages else POOLED].append(i)
    return rows


def lookups(wanted: DataFrame, model: DataFrame) -> DataFrame:
    """(model, gram, nll) of the distinct n-grams (model, gram): -log p of the last symbol after the others.

    Order by order: an n-gram has its own p, or its context's back-off times the p of its suffix; the distinct suffixes
    are looked up in the same way, and are fewer with each order.
    """
    levels = {ORDER: wanted.select("model", "gram").distinct()}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = levels[k + 1].select("model", F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("gram")).distinct()
    of = lambda k, column, name, key: model.filter(f"ord = {k} AND {column} IS NOT NULL").select(F.col("lang").alias("model"), F.col("code").alias(key), F.col(column).alias(name))
    new = model.filter("ord = 0").select(F.col("lang").alias("model"), F.col("p").alias("under"))
    rows = levels[1].join(of(1, "p", "own", "gram"), ["model", "gram"], "left").join(new, "model", "left")
    rows = rows.select("model", "gram", F.coalesce("own", "under").alias("p"))
    for k in range(2, ORDER + 1):
        shorter = rows.select("model", F.col("gram").alias("suffix"), F.col("p").alias("under"))
        rows = levels[k].join(of(k, "p", "own", "gram"), ["model", "gram"], "left")
        rows = rows.withColumns({"context": F.shiftrightunsigned("gram", BITS), "suffix": F.col("gram").bitwiseAND(F.lit(_mask(k - 1)))})
        rows = rows.join(of(k - 1, "bow", "bow", "context"), ["model", "context"], "left").join(shorter, ["model", "suffix"], "left")
        rows = rows.select("model", "gram", F.coalesce("own", F.coalesce("bow", F.lit(1.0)) * F.col("under")).alias("p"))
    return rows.select("model", "gram", (-F.log("p")).alias("nll"))


def text_scores(texts: list[str | None], grams: np.ndarray, nll: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the perplexity by symbol, and the mean of -log p over its worst ``WORST`` symbols in a row (all of a
    shorter text); NaN where there is no symbol. ``grams``, in order, has every n-gram of the texts."""
    out, worst = np.full(len(texts), np.nan), np.full(len(texts), np.nan)
    for own in _chunks(texts):
        found, lengths = windows([symbols(texts[i]) for i in own])
        if not len(found):
            continue
        logs = nll[np.searchsorted(grams, found)]
        some = np.flatnonzero(lengths)
        at, sizes = (np.cumsum(lengths) - lengths)[some], lengths[some]
        means = np.add.reduceat(logs, at) / sizes
        rows = np.array(own)[some]
        out[rows] = np.exp(means)
        # the sum of each window by its last symbol, where it is whole in one text
        sums = logs.copy()
        for j in range(1, min(WORST, len(logs))):
            sums[j:] += logs[:-j]
        sums[np.arange(len(logs)) - np.repeat(at, sizes) < WORST - 1] = -np.inf
        worst[rows] = np.where(sizes < WORST, means, np.maximum.reduceat(sums, at) / WORST)
    return out, worst


def _scorer(uri: str, languages: frozenset[str], lang: int, text: int, part: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known, known_part = PartReader(uri, ["model", "gram", "nll"]), {}, None
        for batch in batches:
            texts = batch.column(text).to_pylist()
            value, worst, names = np.full(len(texts), np.nan), np.full(len(texts), np.nan), [""] * len(texts)
            for (p, name), at in sorted(_grouped(batch, languages, lang, part).items()):
                if p != known_part:
                    known, known_part, rows = {}, p, reader.read(p)
                    if rows is not None:
                        codes, models = pd.factorize(rows.column("model").to_pandas())
                        grams, nll = rows.column("gram").to_numpy().view(np.uint64), rows.column("nll").to_numpy().astype(np.float64)
                        for i, m in enumerate(models):
                            # a part that was handed on in pieces repeats some
                            own, first = np.unique(grams[codes == i], return_index=True)
                            known[m] = own, nll[codes == i][first]
                if name in known:
                    value[at], worst[at] = text_scores([texts[i] for i in at], *known[name])
                for i in at:
                    names[i] = name
            extra = [pa.array(names, pa.string()), *(pa.array(x, pa.float64(), from_pandas=True) for x in (value, worst))]
            columns = [c for i, c in enumerate(batch.columns) if i != part]
            yield pa.RecordBatch.from_arrays([*columns, *extra], names=[*(n for i, n in enumerate(batch.schema.names) if i != part), "_model", "_perplexity", "_worst"])

    return score


def scored(docs: DataFrame, model: DataFrame, languages: frozenset[str], text: str, lang: str, scratch: Scratch | None = None) -> DataFrame:
    """All columns of ``docs``, the model that was used, the perplexity and the worst window. With ``scratch``, the result
    can be read only while that lasts."""
    text_batches(docs.sparkSession)
    rows = in_parts(docs.drop(PART), "texts-in-parts", scratch)
    with Scratch(docs.sparkSession) as own:
        wanted = own.written(rows.select(lang, text, PART).mapInArrow(_wanted(languages, 0, 1, 2), "part int, model string, gram long"), "ngrams-wanted")
        answers = wanted.join(lookups(wanted, model), ["model", "gram"]).select("part", "model", "gram", F.col("nll").cast("float").alias("nll"))
        uri = by_part(answers, "ngrams-by-part", scratch)
    kept = [f for f in docs.schema if f.name != PART]
    schema = T.StructType([*kept, T.StructField("_model", T.StringType()), T.StructField("_perplexity", T.DoubleType()), T.StructField("_worst", T.DoubleType())])
    names = [f.name for f in kept]
    return rows.select(*names, PART).mapInArrow(_scorer(uri, languages, names.index(lang), names.index(text), len(names)), schema)


class Classifier:
    """Model table, the languages that have one of their own, and (middle, low, high, slope, worst) by language, as logarithms."""

    def __init__(self, model: DataFrame, languages: frozenset[str], limits: dict[str, tuple[float, float, float, float, float]]):
        self.model, self.languages, self.limits = model, languages, limits


def shrunk(x: Column, symbols_: Column, middle: Column) -> Column:
    """A text's mean logarithm as if ``PRIOR`` symbols of its language's middle stood beside its own: short texts say
    little, and are not judged by a few symbols."""
    n = symbols_.cast("double")
    return (n * x + F.lit(float(PRIOR)) * middle) / (n + F.lit(float(PRIOR)))


def _beyond(middle: float, edge: float, factor: float) -> float:
    return middle + factor * (edge - middle)


def normal_tail(quantile: float) -> float:
    """How far a normal's ``quantile`` is from its median, in distances of its 95 % quantile."""
    return NormalDist().inv_cdf(quantile) / NormalDist().inv_cdf(0.95)


def greatest_tail(quantile: float) -> float:
    """The same for the greatest of many, whose distribution is Gumbel's."""
    g = lambda q: -math.log(-math.log(q))
    return (g(quantile) - g(0.5)) / (g(0.95) - g(0.5))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = 0.99999, worst_quantile: float = 0.98) -> Classifier | None:
    """Trains on the trusted rows of ``docs`` and sets each language's limits; None if no row is trusted.

    Limits are quantiles of the held-out trusted texts by language. A few hundred texts can't show the quantile 0.99999,
    so it is read off the tail through their median and their 95 % quantile (5 % for the lower limit): a normal's for
    the mean logarithm, shrunk by length; Gumbel's for the worst window, which is the greatest of many, after its growth
    with the logarithm of the length is taken off. Tails are 1 + ``WIDER`` / sqrt(n) as wide where n texts were held out,
    for what so many leave open. All trusted rows count, whatever their number.
    """
    with Scratch(docs.sparkSession) as scratch:
        return _fitted(trusted_texts(docs, labels, key, text, lang, scratch), quantile, worst_quantile, scratch)


def _fitted(texts: DataFrame, quantile: float, worst_quantile: float, scratch: Scratch) -> Classifier | None:
    sizes = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    # limits, and the languages with their number of texts, are a few numbers each
    languages = frozenset(x for x, n in sizes.items() if n >= LEAST_TRUSTED and x != POOLED)
    # a language with few texts has a part in the pooled model only
    own = F.when(F.col("lang").isin(sorted(languages)), F.col("lang")).otherwise(F.lit(POOLED)).alias("lang")
    model = train(texts.filter("NOT held").select(own, "text"), len(languages) <= MOST_LANGUAGES)
    if model.filter(F.col("lang") == POOLED).first() is None:
        return None
    checked = scored(texts.filter("held").select("lang", "text"), model, languages, "text", "lang", scratch)
    checked = scratch.written(checked.select("_model", F.length("text").alias("n"), F.log("_perplexity").alias("x"), "_worst").filter("x IS NOT NULL"), "held-out-perplexities")
    # the pooled limits are of all, by whatever model
    fits = [at_quantile("x", 0.5).alias("m"), F.regr_slope(F.col("_worst"), F.log("n")).alias("slope")]
    fitted = checked.groupBy("_model").agg(*fits).collect() + checked.agg(F.lit(POOLED).alias("_model"), *fits).collect()
    middles = {r["_model"]: r["m"] for r in fitted}
    if middles[POOLED] is None:
        return None
    # texts of one length have no slope
    slopes = {r["_model"]: r["slope"] if (r["slope"] or 0.0) > 0 else 0.0 for r in fitted}
    drawn = checked.withColumn("x", shrunk(F.col("x"), F.col("n"), _by_model(middles, middles[POOLED])))
    drawn = drawn.withColumn("_worst", F.col("_worst") - _by_model(slopes, slopes[POOLED]) * F.log("n"))
    marks = [at_quantile("x", q).alias(n) for n, q in (("low", 0.05), ("mid", 0.5), ("high", 0.95))]
    marks += [at_quantile("_worst", q).alias(n) for n, q in (("worst_mid", 0.5), ("worst_high", 0.95))] + [F.count(F.lit(1)).alias("texts")]
    limits = {}
    for r in drawn.groupBy("_model").agg(*marks).collect() + drawn.agg(F.lit(POOLED).alias("_model"), *marks).collect():
        wide = lambda x: 1 + x / math.sqrt(r["texts"])  # noqa: E731, B023
        mean, worst, m = wide(WIDER) * normal_tail(quantile), wide(WORST_WIDER) * greatest_tail(worst_quantile), r["_model"]
        limits[m] = (middles[m], _beyond(r["mid"], r["low"], mean), _beyond(r["mid"], r["high"], mean), slopes[m], _beyond(r["worst_mid"], r["worst_high"], worst))
    return Classifier(model, languages, limits)


def at_quantile(column: str, q: float) -> Column:
    """A quantile from a summary of bounded size: exact up to some 10,000 rows, then within 0.001 % of the rank."""
    return F.percentile_approx(column, q, 100_000)


def _by_model(values: dict[str, float], other: float) -> Column:
    return F.coalesce(*[F.when(F.col("_model") == k, F.lit(float(v))) for k, v in sorted(values.items())], F.lit(float(other)))


def classify(docs: DataFrame, classifier: Classifier | None, text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns of ``docs`` plus _model, _perplexity, _score (shrunk by length), _low, _high, _worst, _worst_high and
    _kept.

    Null and empty texts have no perplexity and are not kept. Without a classifier, every text is kept. A null language,
    or one with few trusted texts, uses the pooled model. Repeated rows are judged each; an empty table gives an empty
    result. Names that start with an underscore are the operator's own.
    """
    base = docs.drop("_model", "_perplexity", "_score", "_low", "_high", "_worst", "_worst_high", "_kept")
    some = F.coalesce(F.col(text), F.lit("")) != ""
    if classifier is None:
        none = F.lit(None).cast("double")
        return base.withColumns({"_model": F.lit(None).cast("string"), "_perplexity": none, "_score": none, "_low": none, "_high": none, "_worst": none, "_worst_high": none, "_kept": some})
    rows = scored(base, classifier.model, classifier.languages, text, lang)
    pick = lambda i: _by_model({k: v[i] for k, v in classifier.limits.items()}, classifier.limits[POOLED][i])
    score = F.exp(shrunk(F.log("_perplexity"), F.length(text), pick(0)))
    rows = rows.withColumns({"_score": score, "_low": F.exp(pick(1)), "_high": F.exp(pick(2)), "_worst_high": pick(4) + pick(3) * F.log(F.length(text))})
    return rows.withColumn("_kept", some & F.coalesce(F.col("_score").between(F.col("_low"), F.col("_high")) & (F.col("_worst") <= F.col("_worst_high")), F.lit(False)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier keeps, with the columns of ``docs``."""
    return classify(docs, fit(docs, labels)).filter("_kept").select(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = classify(docs, fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "lang", F.col("_model").alias("model"), F.col("_perplexity").alias("perplexity"), F.col("_score").alias("score"), F.col("_low").alias("low"), F.col("_high").alias("high"), F.col("_kept").alias("kept"))


by_value(sys.modules[__name__])
