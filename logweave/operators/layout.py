"""A three-dimensional layout that keeps neighbourhoods: fuzzy neighbour weights, and gradient steps that move every row.

Equal vectors are one point. All different ones get a neighbour graph. What a neighbour weighs falls with
its distance beyond the nearest one's, at a rate found by bisection so that the weights of a row add up to log2 of
their number; both directions of an edge are united as fuzzy sets. Points start from their first three components:
edges pull by their weight, random others push. Rows are dealt by hash to blocks of about ``SAMPLE``, each moved by a
task, in rounds: a task also has the points at the other ends of its rows' edges, as the last round left them. What a
task holds is a block and its edges; a round is a shuffle of points and edges. Few rows are one block and one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neighbours, projection, search
from .storage import fresh_dir, stored

#: Rows of a block; each block is a random sample of all.
SAMPLE = 20_000
NEIGHBOURS, EPOCHS, SEED = 15, 200, 42
#: Epochs of the first round; rounds get shorter as the steps do.
LONGEST = 30
#: Up to so many rows all are compared with all, which takes less than the trees for rows without much structure.
EXACT = 200_000
#: The curve 1 / (1 + A * d ** (2 * B)) of membership over distances in the layout, for a least distance of 0.1 (fixed values).
A, B = 1.577, 0.895
PUSHES, REPEL, LIMIT = 5, 1.0, 4.0


def memberships(distances: np.ndarray, steps: int = 40) -> np.ndarray:
    """Weights of each row's neighbours by their ascending distances; missing ones are infinite."""
    there = np.isfinite(distances)
    nearest = np.where(there[:, :1] & (distances[:, :1] > 0), distances[:, :1], np.min(np.where(there & (distances > 0), distances, np.inf), axis=1, keepdims=True))
    beyond = np.where(there, np.maximum(distances - np.where(np.isfinite(nearest), nearest, 0), 0), np.inf)
    wanted = np.log2(np.maximum(there.sum(axis=1, keepdims=True), 1) + 1e-9)
    lo, hi = np.full(wanted.shape, 1e-6), np.full(wanted.shape, 1e6)
    for _ in range(steps):
        rate = np.sqrt(lo * hi)
        high = np.exp(-beyond / rate).sum(axis=1, keepdims=True) > wanted
        lo, hi = np.where(high, lo, rate), np.where(high, rate, hi)
    return np.exp(-beyond / np.sqrt(lo * hi))


def fuzzy_edges(edges: DataFrame, k: int) -> DataFrame:
    """a, b, weight for neighbours (chunk_id, neighbor, distance): each pair once, a < b."""
    rows = edges.groupBy("chunk_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbor"))), 1, k).alias("near"))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = np.full((len(pdf), k), np.inf)
                for i, near in enumerate(pdf["near"]):
                    d[i, : len(near)] = np.sqrt([n["distance"] for n in near])
                w = memberships(d)
                at, place = np.nonzero(np.isfinite(d))
                others = [n["neighbor"] for near in pdf["near"] for n in near]
                yield pd.DataFrame({"a": pdf["chunk_id"].to_numpy()[at], "b": others, "weight": w[at, place]})

    told = rows.mapInPandas(weigh, "a bigint, b bigint, weight double")
    pairs = told.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.agg((F.sum("weight") - F.when(F.count("*") > 1, F.product("weight")).otherwise(0.0)).alias("weight"))


def moved(points: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, free: int | None = None, first: int = 0, total: int | None = None) -> np.ndarray:
    """Points after gradient steps along edges, drawn by their weight, with pushes from random others.

    Only the ``free`` first points move and push; ``a`` is one of them. ``first`` and ``total`` say which epochs these are of how many.
    """
    rng, x, n = np.random.default_rng(SEED + first), points.copy(), len(points) if free is None else free
    often = weight / weight.max() if len(weight) else weight
    for epoch in range(first, first + epochs):
        rate = 1 - epoch / (total or epochs)
        drawn = rng.permutation(np.flatnonzero(rng.random(len(a)) < often))
        for part in np.array_split(drawn, max(1, len(drawn) // max(1, n // 2))):
            i, j = a[part], b[part]
            off = x[i] - x[j]
            d = (off**2).sum(axis=1, keepdims=True)
            pull = np.clip(np.where(d > 0, -2 * A * B * d ** (B - 1) / (1 + A * d**B), 0) * off, -LIMIT, LIMIT) * rate
            own = j < n
            np.add.at(x, i, pull)
            np.add.at(x, j[own], -pull[own])
            # Edges are told once, a < b: both ends are pushed, as both are pulled.
            i = np.repeat(np.concatenate([i, j[own]]), PUSHES)
            off = x[i] - x[rng.integers(n, size=len(i))]
            d = (off**2).sum(axis=1, keepdims=True)
            push = np.clip(np.where(d > 0, 2 * REPEL * B / ((0.001 + d) * (1 + A * d**B)), 0) * off, -LIMIT, LIMIT) * rate
            np.add.at(x, i, push)
    return x[:n]


def rounds(epochs: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """First epoch and number of epochs of each round: ``longest`` at first, one at last."""
    cuts = [0]
    while cuts[-1] < epochs:
        cuts.append(min(epochs, cuts[-1] + max(1, int(longest * (1 - cuts[-1] / epochs)))))
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _near(rows: DataFrame, n: int, k: int) -> DataFrame:
    if n > EXACT:
        return neighbours.graph(rows, k)
    width = max(1, len(rows.head()["vector"]))
    return search.knn_graph(rows, k, max(1_000, min(search.BLOCK_NUMBERS // width, n // 6 + 1)))


def _turn(at: int, many: int, total: int):
    """A round of a block: its own points and those beyond it, and the edges of its rows."""

    def run(some: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        some, pairs = some.sort_values(["own", "chunk_id"], ascending=[False, True]), pairs.sort_values(["a", "b"])
        ids, own = some["chunk_id"].to_numpy(), int(some["own"].sum())
        order = np.argsort(ids, kind="stable")
        a, b = (order[np.searchsorted(ids, pairs[c].to_numpy(), sorter=order)] for c in ("a", "b"))
        x = moved(np.stack(some["point"].to_list()), a, b, pairs["weight"].to_numpy(), many, own, at, total)
        return some[["chunk_id", "block"]][:own].assign(point=list(x))

    return run


def fit(rows: DataFrame, block_rows: int = SAMPLE, k: int = NEIGHBOURS, epochs: int = EPOCHS) -> DataFrame:
    """chunk_id, point: the layout of different vectors (chunk_id, vector), every one moved along its own edges."""
    spark, n = rows.sparkSession, rows.count()
    blocks = -(-n // block_rows)
    of = lambda c: F.pmod(F.xxhash64(c, F.lit(SEED)), F.lit(max(blocks, 1))).alias("block")
    edges = stored(fuzzy_edges(_near(rows, n, k), k), "layout-edges")
    cross = edges.where(of("a") != of("b"))
    ends = edges.select(of("a"), "a", "b", "weight").unionByName(cross.select(of("b"), F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    ends = stored(ends, "layout-ends")
    beyond = stored(ends.where(of("b") != F.col("block")).select("block", F.col("b").alias("chunk_id")).distinct(), "layout-beyond")
    first = stored(projection.pca(rows.select("chunk_id", "vector"), 3)[0].select("chunk_id", "projected"), "layout-start")
    scale = 10 / max(first.agg(F.max(F.array_max(F.transform("projected", F.abs)))).head()[0] or 0, 1e-9)
    axes = [F.coalesce(F.get("projected", F.lit(c)), F.lit(0.0)) * scale + F.xxhash64("chunk_id", F.lit(SEED + c)) / 2.0**63 * 1e-4 for c in range(3)]
    points = first.select("chunk_id", of("chunk_id"), F.array(*axes).alias("point"))
    ways = fresh_dir(spark, "layout-points")
    for turn, (at, many) in enumerate(rounds(epochs) if blocks > 1 else [(0, epochs)]):
        seen = points.select("block", "chunk_id", "point", F.lit(True).alias("own")).unionByName(points.drop("block").join(beyond, "chunk_id").select("block", "chunk_id", "point", F.lit(False).alias("own")))

        # A group is a block: its size is bounded by block_rows, its edges by those rows'.
        told = seen.groupBy("block").cogroup(ends.groupBy("block")).applyInPandas(_turn(at, many, epochs), "chunk_id bigint, block bigint, point array<double>")
        told.write.mode("overwrite").parquet(f"{ways}/{turn % 2}")  # the last round's points are read from the other
        points = spark.read.schema(told.schema).parquet(f"{ways}/{turn % 2}")
    return points.select("chunk_id", "point")


def different(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``first``: the smallest id of the rows that have the same vector."""
    copies = vectors.groupBy("vector").agg(F.min("chunk_id").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return vectors.join(copies, "vector", "left").withColumn("first", F.coalesce("first", "chunk_id"))


def layout(vectors: DataFrame, sample: int = SAMPLE, pca_dim: int = 200, k: int = NEIGHBOURS, epochs: int = EPOCHS) -> DataFrame:
    """chunk_id, guild_id, channel_id, x, y, z of each vector: first components, then the layout, centred and scaled to the radius.

    ``sample`` is how many rows a task moves, not how many are moved.
    """
    some = vectors.select("vector").head()
    if some is None:
        return vectors.select("chunk_id", "guild_id", "channel_id", *[F.lit(0.0).alias(c) for c in "xyz"])
    reduced, _ = projection.pca(different(vectors), min(pca_dim, len(some["vector"])))
    reduced = stored(reduced.select("chunk_id", "guild_id", "channel_id", "first", F.col("projected").alias("vector")), "reduced")
    once = stored(reduced.where("chunk_id = first").select("chunk_id", "vector").dropDuplicates(["chunk_id"]), "different")
    fitted = fit(once, sample, k, epochs).withColumnRenamed("chunk_id", "first")
    placed = reduced.drop("vector").join(fitted, "first").select("chunk_id", "guild_id", "channel_id", *[F.col("point")[i].alias(c) for i, c in enumerate("xyz")])
    return projection.normalized_layout(stored(placed, "layout"))


def kept(rows: DataFrame, columns: list[str], k: int, every: int = 5) -> list[float]:
    """Trustworthiness of each of some columns of points (1: the k nearest there are the nearest of ``vector``): the rows whose id ``every`` divides, with all rows."""
    n, asked = rows.count(), F.col("chunk_id") % every == 0
    near = [search.knn_graph(rows.select("chunk_id", F.col(c).alias("vector")), k, asked=asked).select("chunk_id", "neighbor", F.lit(i).alias("of")) for i, c in enumerate(columns)]
    pairs = near[0]
    for more in near[1:]:
        pairs = pairs.unionByName(more)
    own, other = rows.select("chunk_id", "vector"), rows.select(F.col("chunk_id").alias("neighbor"), F.col("vector").alias("_there"))
    apart = F.aggregate(F.zip_with("vector", "_there", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda t, x: t + x)
    each = pairs.join(other, "neighbor").join(own, "chunk_id").select("chunk_id", "of", apart.alias("limit"))
    limits = stored(each.groupBy("chunk_id").agg(F.collect_list("of").alias("of"), F.collect_list("limit").alias("limits")), "limits")
    ranks = search.closer(rows.join(limits.select("chunk_id", "limits"), "chunk_id"), rows).join(limits, "chunk_id").select(F.explode(F.arrays_zip("of", "closer")).alias("r"))
    lost = dict(ranks.groupBy("r.of").agg(F.sum(F.greatest(F.col("r.closer") + 1 - k, F.lit(0)))).collect())  # a row for each column
    most = limits.count() * k * (2 * n - 3 * k - 1)
    return [1 - 2 * (lost.get(i) or 0) / most if most > 0 else 1.0 for i in range(len(columns))]


def trustworthiness(vectors: np.ndarray, points: np.ndarray, k: int) -> float:
    """How far the k nearest in a layout are among the nearest in the vectors (1: all are), for a bounded number of rows."""
    n = len(vectors)
    far = lambda x: np.maximum((x**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None] - 2 * x @ x.T, 0) + np.diag(np.full(n, np.inf))
    rank = np.argsort(np.argsort(far(vectors), axis=1, kind="stable"), axis=1, kind="stable") + 1
    near = np.argsort(far(points), axis=1, kind="stable")[:, :k]
    return float(1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, axis=1) - k, 0).sum())
