"""Embeddings of entities and relations: scores as columns, training in NumPy over Arrow batches.

Training is synchronous parameter averaging: in each round every task trains a copy of the vectors on its own triples,
and the vectors are averaged by name. A round is one job; vectors are tables and never pass through the driver.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.functions.vectors import complex_score, distmult, transe
from lucidgraph.sources.storage import stored

MODELS = ("transe", "distmult", "complex", "convkb")
UPDATE_MODES = ("retrain", "adapt_restart", "adapt_progressive")
DATA_MODES = ("subgraph_only", "graph_only", "assignments_only", "assignments_graph", "assignments_subgraph")


@dataclass
class Training:
    model: str = "transe"
    k: int = 100
    epochs: int = 100
    rounds: int = 4
    rate: float = 0.05
    margin: float = 1.0
    negatives: int = 2
    batch: int = 512
    norm: int = 1
    filters: int = 8
    clip: bool = True
    seed: int = 555

    def width(self) -> int:
        return 2 * self.k if self.model == "complex" else self.k


@dataclass
class Embedding:
    """Tables (name, vec) of entities and of relations, and ConvKB's dense weights (name, vec)."""

    entities: DataFrame
    relations: DataFrame
    weights: DataFrame | None
    training: Training


def _initial(names: DataFrame, width: int, seed: int) -> DataFrame:
    """Vectors from each name's hash: the same in every run, and for names that come later."""
    bound = math.sqrt(6.0 / max(1, width))
    vec = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (F.pmod(F.xxhash64(F.col("name"), i, F.lit(seed)), F.lit(1 << 30)).cast("double") / float(1 << 29) - 1.0) * bound)
    return names.select("name", vec.alias("vec"))


def vocabulary(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    entities = triples.select(F.col("s").alias("name")).union(triples.select(F.col("o").alias("name"))).distinct()
    return entities, triples.select(F.col("p").alias("name")).distinct()


def extended(known: DataFrame, names: DataFrame, width: int, seed: int) -> DataFrame:
    """The known vectors and fresh ones for new names."""
    return known.unionByName(_initial(names.join(known, "name", "left_anti"), width, seed))


def score_column(model: str, s: Column, p: Column, o: Column, norm: int = 1) -> Column:
    if model == "transe":
        return transe(s, p, o, norm)
    if model == "distmult":
        return distmult(s, p, o)
    if model == "complex":
        return complex_score(s, p, o)
    raise ValueError(f"{model} has no column form")


def _conv_scores(s: np.ndarray, p: np.ndarray, o: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """1x3 filters over the stacked vectors, rectified, then a dense layer."""
    stack = np.stack([s, p, o], -1)
    maps = np.maximum(np.einsum("nkc,cf->nkf", stack, w["filters"]) + w["bias"], 0)
    return maps.reshape(len(s), -1) @ w["dense"] + w["offset"][0]


def _gradients(t: Training, s: np.ndarray, p: np.ndarray, o: np.ndarray, w: dict[str, np.ndarray]):
    """Scores, and a function from their gradient to those of s, p, o and the weights."""
    if t.model == "transe":
        d = s + p - o
        if t.norm == 1:
            return -np.abs(d).sum(1), lambda g: (-(e := g[:, None] * np.sign(d)), -e, e, {})
        n = np.sqrt((d * d).sum(1)) + 1e-12
        return -n, lambda g: (-(e := g[:, None] * d / n[:, None]), -e, e, {})
    if t.model == "distmult":
        return (s * p * o).sum(1), lambda g: (g[:, None] * p * o, g[:, None] * s * o, g[:, None] * s * p, {})
    if t.model == "complex":
        h = s.shape[1] // 2
        sr, si, pr, pi, or_, oi = s[:, :h], s[:, h:], p[:, :h], p[:, h:], o[:, :h], o[:, h:]
        score = (sr * pr * or_ + si * pr * oi + sr * pi * oi - si * pi * or_).sum(1)

        def back(g):
            g = g[:, None]
            return (
                g * np.concatenate([pr * or_ + pi * oi, pr * oi - pi * or_], 1),
                g * np.concatenate([sr * or_ + si * oi, sr * oi - si * or_], 1),
                g * np.concatenate([sr * pr - si * pi, si * pr + sr * pi], 1),
                {},
            )

        return score, back
    stack = np.stack([s, p, o], -1)
    raw = np.einsum("nkc,cf->nkf", stack, w["filters"]) + w["bias"]
    maps = np.maximum(raw, 0)
    flat = maps.reshape(len(s), -1)

    def back(g):
        dm = (g[:, None] * w["dense"][None, :]).reshape(raw.shape) * (raw > 0)
        ds = np.einsum("nkf,cf->nkc", dm, w["filters"])
        grads = {"filters": np.einsum("nkc,nkf->cf", stack, dm), "bias": dm.sum((0, 1)), "dense": flat.T @ g, "offset": np.array([g.sum()])}
        return ds[..., 0], ds[..., 1], ds[..., 2], grads

    return flat @ w["dense"] + w["offset"][0], back


_VEC = pa.schema([("kind", pa.string()), ("name", pa.string()), ("vec", pa.list_(pa.float64())), ("loss", pa.float64())])


#: Triples that one training task holds.
TRIPLES_PER_TASK = 200_000


def _trainer(t: Training, epochs: int, seed: int, names: list[str]):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        vectors: dict[str, dict[str, np.ndarray]] = {"e": {}, "r": {}, "w": {}}
        triples = []
        for r in rows:
            if r["kind"] == "t":
                triples.append((r["s"], r["p"], r["o"]))
            else:
                vectors[r["kind"]][r["s"]] = np.array(r["vec"], float)
        if not triples:
            return
        ents, rels = sorted(vectors["e"]), sorted(vectors["r"])
        ei, ri = {n: i for i, n in enumerate(ents)}, {n: i for i, n in enumerate(rels)}
        e, r_ = np.array([vectors["e"][n] for n in ents]), np.array([vectors["r"][n] for n in rels])
        w = {n: vectors["w"][n] for n in names if n in vectors["w"]}
        if "filters" in w:
            w["filters"] = w["filters"].reshape(3, t.filters)
        data = np.array([(ei[s], ri[p], ei[o]) for s, p, o in triples])
        rng = np.random.default_rng(seed)
        loss = 0.0
        for _ in range(epochs):
            order = rng.permutation(len(data))
            for at in range(0, len(data), t.batch):
                pos = np.repeat(data[order[at : at + t.batch]], t.negatives, 0)
                neg = pos.copy()
                side = rng.random(len(neg)) < 0.5
                neg[np.arange(len(neg)), np.where(side, 0, 2)] = rng.integers(len(ents), size=len(neg))
                fp, bp = _gradients(t, e[pos[:, 0]], r_[pos[:, 1]], e[pos[:, 2]], w)
                fn, bn = _gradients(t, e[neg[:, 0]], r_[neg[:, 1]], e[neg[:, 2]], w)
                violation = t.margin - fp + fn
                active = (violation > 0).astype(float)
                loss += float((violation * active).sum())
                if not np.isfinite(loss):
                    raise ValueError("the loss is not a number; use a smaller rate")
                for idx, (gs, gp, go, gw) in ((pos, bp(-active)), (neg, bn(active))):
                    np.add.at(e, idx[:, 0], -t.rate * gs)
                    np.add.at(r_, idx[:, 1], -t.rate * gp)
                    np.add.at(e, idx[:, 2], -t.rate * go)
                    for name, g in gw.items():
                        w[name] -= t.rate / len(pos) * g
            if t.clip:
                e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1.0)
        out = [("e", n, v) for n, v in zip(ents, e)] + [("r", n, v) for n, v in zip(rels, r_)] + [("w", n, v.ravel()) for n, v in w.items()]
        for at in range(0, len(out), 5000):
            part = out[at : at + 5000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part]), pa.array([x[1] for x in part]), pa.array([x[2].tolist() for x in part], pa.list_(pa.float64())), pa.array([loss / len(data) / max(1, epochs)] * len(part))], schema=_VEC)

    return train


def _round(triples: DataFrame, model: Embedding, epochs: int, seed: int, tasks: int) -> tuple[Embedding, float]:
    t = model.training
    part = F.pmod(F.xxhash64("s", "p", "o", F.lit(seed)), F.lit(tasks)).cast("int")
    dealt = triples.select("s", "p", "o", part.alias("part"))
    ends = dealt.select("part", F.explode(F.array("s", "o")).alias("name")).distinct()
    none = F.lit(None).cast("string")
    ents = ends.join(model.entities, "name").select("part", F.lit("e").alias("kind"), F.col("name").alias("s"), none.alias("p"), none.alias("o"), "vec")
    rels = dealt.select("part", F.col("p").alias("name")).distinct().join(model.relations, "name").select("part", F.lit("r").alias("kind"), F.col("name").alias("s"), none.alias("p"), none.alias("o"), "vec")
    facts = dealt.select("part", F.lit("t").alias("kind"), "s", "p", "o", F.lit(None).cast("array<double>").alias("vec"))
    rows = facts.unionByName(ents).unionByName(rels)
    names: list[str] = []
    if model.weights is not None:
        names = sorted(r["name"] for r in model.weights.select("name").collect())
        parts = dealt.select("part").distinct()
        rows = rows.unionByName(parts.join(F.broadcast(model.weights), F.lit(True)).select("part", F.lit("w").alias("kind"), F.col("name").alias("s"), none.alias("p"), none.alias("o"), "vec"))
    trained = rows.repartitionByRange(tasks, "part").sortWithinPartitions("part", "kind", "s", "p", "o").select("kind", "s", "p", "o", "vec").mapInArrow(_trainer(t, epochs, seed, names), "kind string, name string, vec array<double>, loss double")
    trained = stored(trained, "trained")
    elements = trained.select("kind", "name", F.posexplode("vec").alias("i", "x")).groupBy("kind", "name", "i").agg(F.avg("x").alias("x"))
    mean = elements.groupBy("kind", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("vec"))
    mean = stored(mean, "averaged")
    pick = lambda kind, old: stored(mean.filter(F.col("kind") == kind).select("name", "vec").unionByName(old.join(mean.filter(F.col("kind") == kind), "name", "left_anti")), "vectors")
    loss = trained.agg(F.avg("loss")).first()[0] or 0.0
    return Embedding(pick("e", model.entities), pick("r", model.relations), pick("w", model.weights) if model.weights is not None else None, t), loss


def start(triples: DataFrame, training: Training, old: Embedding | None = None) -> Embedding:
    """Vectors to begin with: fresh ones, or the old ones and fresh ones for new names."""
    spark = triples.sparkSession
    ents, rels = vocabulary(triples)
    width = training.width()
    weights = None
    if training.model == "convkb":
        rng = np.random.default_rng(training.seed)
        filters = np.tile(np.array([[0.1], [0.1], [-0.1]]), (1, training.filters)) + rng.normal(0, 0.02, (3, training.filters))
        first = {"filters": filters.ravel(), "bias": np.zeros(training.filters), "dense": rng.normal(0, 0.1, width * training.filters), "offset": np.zeros(1)}
        weights = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in first.items()], "name string, vec array<double>")
    if old is None:
        return Embedding(stored(_initial(ents, width, training.seed), "vectors"), stored(_initial(rels, width, training.seed), "vectors"), weights, training)
    if old.training.width() != width or old.training.model != training.model:
        raise ValueError("a model goes on only with the kind and width that it has")
    grown = lambda known, names: stored(extended(known, names, width, training.seed), "vectors")
    return Embedding(grown(old.entities, ents), grown(old.relations, rels), old.weights, training)


def train(triples: DataFrame, training: Training | None = None, old: Embedding | None = None, tasks: int | None = None) -> tuple[Embedding, list[float]]:
    """A trained model and the mean loss of a triple and epoch in each round. On from ``old``, a quarter of the epochs is enough.

    Triples are dealt to ``tasks``, by default one for each ``TRIPLES_PER_TASK``: a task holds its own and their vectors.
    """
    t = training or Training()
    if t.model not in MODELS:
        raise ValueError(f"no such model: {t.model}; there are {', '.join(MODELS)}")
    triples = stored(triples.select("s", "p", "o"), "training-triples")
    tasks = tasks or max(1, -(-triples.count() // TRIPLES_PER_TASK))
    model, losses = start(triples, t, old), []
    epochs = math.ceil(t.epochs / 4) if old is not None else t.epochs
    for i in range(max(1, t.rounds)):
        model, loss = _round(triples, model, max(1, epochs // max(1, t.rounds)), t.seed + i, tasks)
        losses.append(loss)
    return model, losses


def _conv_batches(weights: dict[str, np.ndarray]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.array(b.column(c).to_pylist(), float).reshape(b.num_rows, -1) for c in ("_s", "_p", "_o")]
            x = _conv_scores(*v, weights) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("s"), b.column("p"), b.column("o"), pa.array(x, pa.float64())], ["s", "p", "o", "score"])

    return score


def predict(model: Embedding, triples: DataFrame) -> DataFrame:
    """(s, p, o, score) of triples whose names are known."""
    e, r = model.entities, model.relations
    rows = triples.join(e.select(F.col("name").alias("s"), F.col("vec").alias("_s")), "s").join(e.select(F.col("name").alias("o"), F.col("vec").alias("_o")), "o")
    rows = rows.join(r.select(F.col("name").alias("p"), F.col("vec").alias("_p")), "p")
    if model.training.model == "convkb":
        w = {x["name"]: np.array(x["vec"]) for x in model.weights.collect()}  # four rows
        w["filters"] = w["filters"].reshape(3, -1)
        return rows.select("s", "p", "o", "_s", "_p", "_o").mapInArrow(_conv_batches(w), "s string, p string, o string, score double")
    return rows.select("s", "p", "o", score_column(model.training.model, F.col("_s"), F.col("_p"), F.col("_o"), model.training.norm).alias("score"))


def calibrate(positive: DataFrame, negative: DataFrame):
    """A logistic model of scores (score): ``transform`` gives probabilities through ``probabilities``."""
    rows = positive.select("score", F.lit(1.0).alias("label")).unionByName(negative.select("score", F.lit(0.0).alias("label")))
    return LogisticRegression(regParam=1e-6).fit(rows.select("label", array_to_vector(F.array("score")).alias("features")))


def probabilities(calibration, scored: DataFrame) -> DataFrame:
    rows = calibration.transform(scored.withColumn("features", array_to_vector(F.array("score"))))
    return rows.select(*scored.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))


def lookup(vectors: DataFrame, names: DataFrame, missing: str = "drop") -> DataFrame:
    """(name, vec) of one column of names; ``missing``: drop them, keep them with null, or raise."""
    wanted = names.select(F.col(names.columns[0]).alias("name"))
    rows = wanted.join(vectors, "name", "inner" if missing == "drop" else "left")
    if missing == "raise" and (lost := rows.filter("vec IS NULL").first()):
        raise KeyError(lost["name"])
    return rows


def update_data(kg: DataFrame, context: DataFrame, history: list[DataFrame], mode: str = "retrain", data: str = "assignments_subgraph", window: int = 1) -> DataFrame:
    """Training triples for an update, repeats kept: the last ``window`` feedbacks and what the modes ask for."""
    if mode not in UPDATE_MODES or data not in DATA_MODES:
        raise ValueError(f"modes are {', '.join(UPDATE_MODES)}; data modes are {', '.join(DATA_MODES)}")
    recent = history[-window:] if window > 0 else history
    feedback = kg.limit(0)
    for f in recent:
        feedback = feedback.unionByName(f)
    if mode == "retrain" or data == "assignments_graph":
        return kg.unionByName(feedback)
    return {"subgraph_only": context, "graph_only": kg, "assignments_only": feedback, "assignments_subgraph": context.unionByName(feedback)}[data]


def save(model: Embedding, path: str) -> None:
    """Vectors as Parquet; no pickles."""
    parts = [model.entities.withColumn("kind", F.lit("e")), model.relations.withColumn("kind", F.lit("r"))]
    if model.weights is not None:
        parts.append(model.weights.withColumn("kind", F.lit("w")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/vectors")
    t = model.training
    spark = rows.sparkSession
    spark.createDataFrame([(k, str(v)) for k, v in vars(t).items()], "name string, value string").write.mode("overwrite").json(f"{path}/training")


def load(spark: SparkSession, path: str) -> Embedding:
    rows = spark.read.schema("name string, vec array<double>, kind string").parquet(f"{path}/vectors")
    values = {r["name"]: r["value"] for r in spark.read.schema("name string, value string").json(f"{path}/training").collect()}
    usual = vars(Training())
    t = Training(**{k: (v == "True" if isinstance(usual[k], bool) else type(usual[k])(v)) for k, v in values.items() if k in usual})
    of = lambda kind: rows.filter(F.col("kind") == kind).select("name", "vec")
    return Embedding(of("e"), of("r"), of("w") if t.model == "convkb" else None, t)


def read_matrix(spark: SparkSession, path: str, width: int, names: DataFrame) -> DataFrame:
    """(name, vec) from a raw little-endian float32 matrix and a dictionary (name, id)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                m = np.frombuffer(content, "<f4").reshape(-1, width).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(m)), pa.int64()), pa.array(m.tolist(), pa.list_(pa.float64()))], ["id", "vec"])

    matrix = spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "id long, vec array<double>")
    return names.join(matrix, "id").select("name", "vec")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
