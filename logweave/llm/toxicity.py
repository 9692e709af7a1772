"""Toxicity by a chain of linear classifiers (operator 2).

The categories are label columns in a fixed order. The model of each category is a logistic regression
on the words of a text, their four-letter beginnings, and the probabilities of all earlier categories.
While training, those probabilities are out-of-fold: for each fold they come from a model that has not
seen it, so that a later model learns how far the earlier ones can be trusted. When scoring, they come
from the earlier models fitted on all folds.

Fitting uses a bounded sample of labelled rows (``SAMPLE`` documents, chosen by a hash of doc_id);
scoring reads every document whole, in one pass without a shuffle. Features are words that at least
``MIN_DOCS`` sampled documents have, so an unseen word counts for nothing, whatever its hash.

A null or empty text has no features: its probability is that of the intercepts. Labels that repeat a
doc_id are combined by their maximum; rows with a null in any category are not used. With no usable
labels every probability is 0 and nothing is toxic. Repeated rows are each scored, a null doc_id is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, held, stored
from .decontaminate import TO_WORDS

CATEGORIES = ("quality", "toxic")
SAMPLE = 20_000
FOLDS = 3
MIN_DOCS = 5
PREFIX = 4
RIDGE, STEPS, RATE = 1e-4, 150, 0.3
THRESHOLD = 0.5
#: Documents whose features a task holds at once, and features whose weights it gathers at once.
AT_ONCE, CHUNK = 200, 1 << 20
_SPLIT = re.compile(r"[^\W_]+")


def features(text: str | None) -> set[str]:
    """Distinct words and, marked by ``~``, their beginnings."""
    if not text:
        return set()
    words = set(text.encode("utf-8", "replace").translate(TO_WORDS).decode("utf-8", "replace").split())
    if not text.isascii():
        plain = {w for w in words if w.isascii()}
        for w in words - plain:
            plain.update(_SPLIT.findall(w.lower()))
        words = plain
    return words | {"~" + w[:PREFIX] for w in words}


@dataclass
class Model:
    """Weights over the vocabulary, then one for each earlier category's centred probability."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, flat: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
        z = np.concatenate([np.zeros(0), *(_sums(self.weights, ids, n) for _, ids, n in _parts(flat, sizes))]) + self.bias
        if before.shape[1]:
            z = z + (before - 0.5) @ self.earlier
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _parts(flat: np.ndarray, sizes: np.ndarray) -> list[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of about CHUNK features together: which they are, their features one after the other, and how many each has."""
    ends = np.cumsum(sizes)
    edges = np.unique(np.concatenate(([0], np.searchsorted(ends, np.arange(CHUNK, len(flat), CHUNK)) + 1, [len(sizes)])))
    return [(slice(a, b), flat[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b]) for a, b in zip(edges, edges[1:])]  # noqa: B905


def _sums(weights: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of the weights of each row's features."""
    out, some = np.zeros(len(sizes)), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(weights[flat], (np.cumsum(sizes) - sizes)[some])
    return out


def flattened(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32), np.array([len(r) for r in rows], np.int64)


def fit(flat: np.ndarray, sizes: np.ndarray, before: np.ndarray, y: np.ndarray, width: int) -> Model:
    """Logistic regression with a ridge, by full-batch Adam; each class has the same total weight up to 4 to 1."""
    k = before.shape[1]
    positive = float(y.mean()) if len(y) else 0.0
    if positive in (0.0, 1.0):
        return Model(np.zeros(width), np.zeros(k), -30.0 if positive == 0 else 30.0)
    parts = _parts(flat, sizes)
    w, b = np.zeros(width + k), float(np.log(positive / (1 - positive)))
    weight = np.where(y == 1, min(4.0, max(1.0, (1 - positive) / positive)), min(4.0, max(1.0, positive / (1 - positive))))
    weight /= weight.sum()
    m, v = np.zeros(width + k + 1), np.zeros(width + k + 1)
    centred = before - 0.5
    for step in range(1, STEPS + 1):
        z = np.concatenate([_sums(w, ids, n) for _, ids, n in parts]) + centred @ w[width:] + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.concatenate([sum(np.bincount(ids, np.repeat(g[at], n), width) for at, ids, n in parts), centred.T @ g, [g.sum()]])
        grad[:-1] += RIDGE * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w, b = w - move[:-1], b - move[-1]
    return Model(w[:width], w[width:], b)


@dataclass
class Chain:
    categories: tuple[str, ...]
    vocabulary: dict[str, int]
    models: list[Model]

    def rows(self, texts) -> list[np.ndarray]:
        get = self.vocabulary.get
        return [np.array([i for i in map(get, sorted(features(x))) if i is not None], np.int32) for x in texts]

    def predict(self, texts) -> np.ndarray:
        """Probabilities, a column for each category in order."""
        flat, sizes = flattened(self.rows(texts))
        out = np.zeros((len(sizes), 0))
        for model in self.models:
            out = np.column_stack([out, model.predict(flat, sizes, out)])
        return out


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held("toxicity")
    for pdf in batches:
        for part in (pdf.iloc[i : i + AT_ONCE] for i in range(0, len(pdf), AT_ONCE)):
            yield part.drop(columns="text").assign(words=[sorted(features(x)) for x in part["text"]])


def _fold_fit(width: int, k: int):
    """Fits category k without fold ``held`` (-1: on all) and predicts that fold; one task for each fold."""

    def run(table: pa.Table) -> pa.Table:
        held("toxicity")
        table = table.sort_by("doc_id")
        fold = table["held"][0].as_py()
        inside = table["fold"].to_numpy() == fold
        doc_ids, n = table["doc_id"].to_numpy(), table.num_rows
        lists = table["ids"].combine_chunks()
        sizes, flat = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
        before = table["before"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, k)
        y = table["labels"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)[:, k]
        del table, lists
        of = np.repeat(inside, sizes)
        model = fit(flat[~of], sizes[~inside], before[~inside], y[~inside], width)
        out = {"held": [fold], "weights": [None], "earlier": [None], "bias": [model.bias], "doc_ids": [[]], "p": [[]]}
        if fold < 0:
            out |= {"weights": [model.weights.astype("<f8").tobytes()], "earlier": [model.earlier.tolist()]}
        else:
            out |= {"doc_ids": [doc_ids[inside].tolist()], "p": [model.predict(flat[of], sizes[inside], before[inside]).tolist()]}
        return pa.table(out, schema=_FITTED)

    return run


_FITTED = pa.schema([("held", pa.int32()), ("weights", pa.binary()), ("earlier", pa.list_(pa.float64())), ("bias", pa.float64()), ("doc_ids", pa.list_(pa.int64())), ("p", pa.list_(pa.float64()))])
FITTED = "held int, weights binary, earlier array<double>, bias double, doc_ids array<long>, p array<double>"


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> tuple[Chain, DataFrame | None]:
    """The chain, and the out-of-fold probabilities of the sample (doc_id, labels, p) to judge it by.

    Everything here has the size of the sample: at most about SAMPLE documents.
    """
    spark = bounded(docs).sparkSession
    labels = labels.where("doc_id is not null").dropna(subset=list(categories)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(c).alias(c) for c in categories])
    total = labels.count()
    if not total:
        return Chain(tuple(categories), {}, [Model(np.zeros(0), np.zeros(k), -30.0) for k in range(len(categories))]), None
    share = min(1.0, SAMPLE / total)
    picked = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    picked = picked.select("doc_id", F.array(*[F.col(c).cast("double") for c in categories]).alias("labels"))
    # The sample is bounded, so it may be broadcast; the texts stay where they are.
    # Of texts that share a doc_id the least one is learnt from.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.any_value("labels").alias("labels"))
    sample = stored(sample.mapInPandas(_featured, "doc_id long, labels array<double>, words array<string>"), "toxicity-sample")
    common = sample.select(F.explode("words").alias("w")).groupBy("w").count().where(F.col("count") >= MIN_DOCS).select("w")
    vocabulary = {w: i for i, w in enumerate(sorted(r["w"] for r in common.collect()))}
    shared = spark.sparkContext.broadcast(vocabulary)

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = shared.value.get
        for pdf in batches:
            yield pdf.drop(columns="words").assign(ids=[[i for i in map(get, w) if i is not None] for w in pdf["words"]])

    rows = sample.mapInPandas(numbered, "doc_id long, labels array<double>, ids array<int>").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    rows = stored(rows.withColumn("before", F.array().cast("array<double>")), "toxicity-rows")
    models: list[Model] = []
    for k in range(len(categories)):
        copies = rows.withColumn("held", F.explode(F.array(*[F.lit(f) for f in range(-1, FOLDS)])))
        fitted = copies.groupBy("held").applyInArrow(_fold_fit(len(vocabulary), k), FITTED).collect()
        final = next((r for r in fitted if r["held"] < 0), None)
        if final is None:  # labels, but of no document at hand
            return Chain(tuple(categories), {}, [Model(np.zeros(0), np.zeros(j), -30.0) for j in range(len(categories))]), None
        models.append(Model(np.frombuffer(final["weights"], "<f8"), np.array(final["earlier"], float), final["bias"]))
        held_out = [(d, float(p)) for r in fitted for d, p in zip(r["doc_ids"], r["p"], strict=True)]
        scores = spark.createDataFrame(held_out, "doc_id long, p double") if held_out else spark.createDataFrame([], "doc_id long, p double")
        rows = stored(rows.join(F.broadcast(scores), "doc_id").select("doc_id", "labels", "ids", "fold", F.concat("before", F.array("p")).alias("before")), "toxicity-rows")
    return Chain(tuple(categories), vocabulary, models), rows.select("doc_id", "labels", F.col("before").alias("p"))


def probabilities(chain: Chain, spark) -> callable:
    """A column function from text to the array of the chain's probabilities."""
    shared = spark.sparkContext.broadcast(chain)

    def predict(text: pd.Series) -> pd.Series:
        held("toxicity")
        return pd.Series(list(shared.value.predict(text)), index=text.index, dtype=object)

    return F.pandas_udf(predict, T.ArrayType(T.DoubleType()))


def is_toxic(p: Column, categories: tuple[str, ...] = CATEGORIES) -> Column:
    return p[len(categories) - 1] >= THRESHOLD


def score(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """doc_id, p_<category> for each category, toxic (the last category reaches THRESHOLD)."""
    chain, _ = train(docs, labels, categories)
    p = docs.select(F.col("doc_id").cast("long").alias("doc_id"), probabilities(chain, docs.sparkSession)("text").alias("p"))
    return p.select("doc_id", *[F.round(F.col("p")[k], 6).alias(f"p_{c}") for k, c in enumerate(categories)], is_toxic(F.col("p"), categories).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """``docs`` without the rows the chain finds toxic; all columns are kept."""
    chain, _ = train(docs, labels, categories)
    return docs.where(~is_toxic(probabilities(chain, docs.sparkSession)("text"), categories))
