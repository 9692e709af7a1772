"""Approximate nearest-neighbour graphs: random-projection trees for a start, then rounds in which neighbours of a row meet.

Trees cut the rows by hyperplanes through their mean into leaves of about ``LEAF`` rows; a leaf that has far more, as
many equal rows do, is dealt into parts. In each part every row takes its nearest. Then, round by round, the
neighbours that a row has and those that have it are compared with each other, and each keeps its nearest. The recall
of some rows is measured against all rows, and while it is too low twice as many trees come in: vectors without much
structure need more of them the more rows there are. What a task holds is a part of a leaf or some rows' neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import search
from .storage import stored

TREES, LEAF, ROUNDS, SEED = 6, 4_000, 4, 42
#: Recall at which no more trees come in, and how often they may.
LEAST, TURNS = 0.95, 6
#: Rows whose neighbours meet in one task's call.
MEETING_ROWS = 500
EDGES = "chunk_id bigint, neighbor bigint, distance double"


def _nearest(ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest others of each row among some, by squared distance and then by id."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    if len(ids) > 512:
        row, col, d = search.nearest_of(ids, vectors, ids, vectors, k)
        return pd.DataFrame({"chunk_id": ids[row], "neighbor": ids[col], "distance": d})
    out, squares = [], (vectors**2).sum(axis=1)
    for lo in range(0, len(ids), 512):
        d = np.maximum(squares[lo : lo + 512, None] + squares[None] - 2 * vectors[lo : lo + 512] @ vectors.T, 0)
        d[ids[lo : lo + 512, None] == ids[None]] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(d, near, axis=1)
        out.append(pd.DataFrame({"chunk_id": np.repeat(ids[lo : lo + 512], near.shape[1]), "neighbor": ids[near].ravel(), "distance": found.ravel()}))
    edges = pd.concat(out) if out else pd.DataFrame({"chunk_id": ids, "neighbor": ids, "distance": squares})
    return edges[np.isfinite(edges["distance"])]


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest different neighbours of each row."""
    once = edges.groupBy("chunk_id", "neighbor").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy("distance", "neighbor"))
    return once.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def _leaves(rows: DataFrame, n: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """tree, leaf, chunk_id, vector: the leaf of each row in each tree."""
    mean = rows.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m")).orderBy("at").collect()
    centre = np.array([r["m"] for r in mean])  # a number for each component
    depth = max(0, math.ceil(math.log2(max(1, n / leaf))))
    planes = np.random.default_rng(seed).normal(size=(trees, depth, len(centre)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vector"].to_list()) - centre
                for t in range(trees):
                    bits = (x @ planes[t].T > 0) @ (1 << np.arange(depth, dtype=np.int64))
                    yield pdf.assign(tree=t, leaf=bits)

    return rows.mapInPandas(run, "chunk_id bigint, vector array<double>, tree int, leaf bigint")


def _started(rows: DataFrame, n: int, k: int, trees: int, seed: int) -> DataFrame:
    some = rows.head()
    leaf = min(LEAF, max(300, search.BLOCK_NUMBERS // max(1, len(some["vector"]) if some else 1)))
    placed = stored(_leaves(rows, n, trees, leaf, seed), "leaves")
    sizes = placed.groupBy("tree", "leaf").count()
    part = F.pmod(F.xxhash64("chunk_id", "tree"), F.ceil(F.col("count") / (2 * leaf)))
    dealt = placed.join(sizes, ["tree", "leaf"]).withColumn("part", part)
    near = dealt.groupBy("tree", "leaf", "part").applyInPandas(lambda pdf: _nearest(pdf["chunk_id"].to_numpy(), np.stack(pdf["vector"].to_list()), k), EDGES)
    return _best(near, k)


def _met(edges: DataFrame, rows: DataFrame, k: int, meetings: int) -> DataFrame:
    """What the rows that know one row, and those it knows, are to each other."""
    known = edges.select(F.col("chunk_id").alias("at"), F.col("neighbor").alias("chunk_id"))
    rank = F.row_number().over(Window.partitionBy("neighbor").orderBy("distance", "chunk_id"))
    knowing = edges.withColumn("_rank", rank).where(F.col("_rank") <= 2 * k).select(F.col("neighbor").alias("at"), "chunk_id")
    own = rows.select(F.col("chunk_id").alias("at"), "chunk_id")
    together = known.unionByName(knowing).unionByName(own).distinct().join(rows, "chunk_id")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [_nearest(g["chunk_id"].to_numpy(), np.stack(g["vector"].to_list()), k) for _, g in pdf.groupby("at")]
        return pd.concat(out) if out else pd.DataFrame({"chunk_id": [], "neighbor": [], "distance": []})

    met = together.withColumn("meeting", F.pmod(F.xxhash64("at"), F.lit(meetings)))
    return met.groupBy("meeting").applyInPandas(meet, EDGES)


def graph(vectors: DataFrame, k: int, trees: int = TREES, rounds: int = ROUNDS, least: float = LEAST) -> DataFrame:
    """chunk_id, neighbor, distance: k near others of each row (chunk_id, vector), nearly always its nearest.

    Rounds end early where one finds nothing; trees are added until ``least`` is reached, ``TURNS`` times at most.
    """
    rows = stored(vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")), "vectors")
    n, truth, edges = rows.count(), stored(nearest_of_some(rows, k), "truth"), None
    for turn in range(TURNS):
        start = _started(rows, n, k, trees << turn, SEED + turn)
        edges = stored(start if edges is None else _best(edges.unionByName(start), k), "edges")
        for _ in range(rounds):
            if _share(edges, truth) >= least:
                break
            found = stored(_best(edges.unionByName(_met(edges, rows, k, n // MEETING_ROWS + 1)), k), "edges")
            new = found.join(edges, ["chunk_id", "neighbor"], "left_anti").count()
            edges = found
            if new <= n * k // 1000:
                break
        if _share(edges, truth) >= least:
            break
    return edges.withColumn("distance", F.round("distance", 6))


def nearest_of_some(vectors: DataFrame, k: int, every: int = 50) -> DataFrame:
    """chunk_id, neighbor, distance: the k nearest of all rows whose id ``every`` divides, by comparing these with all rows."""
    asked = vectors.where(F.col("chunk_id") % every == 0).select(F.col("chunk_id").alias("asked"), F.col("vector").cast("array<double>").alias("q"))
    queries = asked.collect()  # the stated query set
    ids = np.array([r["asked"] for r in queries], np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, np.array([r["q"] for r in queries], float)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        for pdf in batches:
            if len(pdf) and len(ids):
                pdf = pdf.sort_values("chunk_id")
                own = pdf["chunk_id"].to_numpy()
                row, col, d = search.nearest_of(ids, q, own, np.stack(pdf["vector"].to_list()).astype(float), k)
                yield pd.DataFrame({"chunk_id": ids[row], "neighbor": own[col], "distance": d})

    return _best(vectors.select("chunk_id", "vector").mapInPandas(run, EDGES), k)


def _share(edges: DataFrame, truth: DataFrame) -> float:
    farthest = truth.groupBy("chunk_id").agg(F.max("distance").alias("_far"), F.count("*").alias("_n"))
    hits = edges.join(F.broadcast(farthest), "chunk_id").where(F.col("distance") <= F.col("_far") + 1e-6).count()  # a row for each query
    wanted = truth.count()
    return hits / wanted if wanted else 1.0


def recall(vectors: DataFrame, edges: DataFrame, k: int, every: int = 50) -> float:
    """Of the k nearest of all rows whose id ``every`` divides, the share that the graph has."""
    return _share(edges, stored(nearest_of_some(vectors, k, every), "truth"))
