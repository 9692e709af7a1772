"""Exact n-gram Jaccard join in metric space (operator 4).

A document is the set of its distinct five-word shingles (64-bit fingerprints). Two documents link when
100 * |intersection| >= 80 * |union|, a Jaccard distance of at most R = 0.2. The join finds every
connected component of that graph:

1. *Copies.* Documents with one set are a class, represented by its smallest doc_id.
2. *Pivots.* A bounded sample of documents (``PIVOTS``, chosen by a hash of the rows) are the pivots; an
   inverted index over their shingles is broadcast, and each document learns its distance to every pivot
   it shares a shingle with. A document within R of a pivot is *anchored*: it links to the pivot itself,
   so that the members of a large group of near copies need not be compared with one another.
3. *Voronoi regions.* Pivots at least APART = 0.5 apart own cells. A document is at home with its nearest
   pivot if that is within RHO = 0.3, else in the outer region. By the triangle inequality a partner of a
   document at home with p lies within RHO + R of p, and within 2 R more of p than of its own nearest
   pivot: boundary documents are replicated into just those cells.
4. *Recursion.* Inside a region, one-shingle sets act as the next pivots: in any global order, partners
   share one of their first |x| - ceil(0.8 |x|) + 1 shingles, so a document goes to the regions of those
   that another document has among its first. The order puts frequent shingles last, by the powers of two
   of their counts in one document of ORDER_SHARE; any order is exact, this one keeps regions small. The
   smallest document of each such region is its next pivot: it is compared with all others, and what it
   links is one group from then on. Regions with more than one group left are parted once more by set
   size, which for partners differs by a factor of at most 1.25; there, documents outside of the region's
   largest group meet the others. Pairs are dropped when their distances to the cell's pivot differ by more
   than R, when both are of one group already, or when, the region's shingle being the first they share,
   what follows it in either set is less than the overlap needed. Of different pairs left, those go whose
   parities (for each of CLASSES classes of shingles, whether a set has an odd number of them) differ in more
   places than partners differ in shingles; and of sets of over LONG shingles, those whose numbers of
   shingles in each class differ by more in all.
5. *Exact check.* The sets of remaining pairs are made again from the texts and intersected.

Sampling chooses pivots and the order only; every document takes part in every step and no list, region
or group is capped. Links that are not looked at join documents that other links have joined already.

Null and blank texts have an empty set and link with nothing. Texts of fewer than five words have the
whole sequence as their one shingle. Rows that repeat a doc_id are the same node; a null doc_id has a
null component and takes part in no link. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded, fresh_dir, held, maybe_broadcast, remove_dir, stored, stored_at, unused
from .graph import components

SHINGLE = 5
#: A bounded sample of documents, whatever the size of the corpus; pivots have at most PIVOT_SHINGLES.
PIVOTS = 2048
PIVOT_SHINGLES = 4096
#: The order of shingles is counted in one document of so many, and keeps at most ORDERED frequent ones.
ORDER_SHARE, ORDERED = 16, 2_000_000
R, RHO, APART = 0.2, 0.3, 0.5
OUTER = -1
#: Classes of shingles by the last bits of their fingerprints; sets of more shingles are compared by their numbers in each as well.
CLASSES, LONG = 512, 400
#: Fingerprints of words that a worker keeps.
CACHE_WORDS = 100_000
#: Documents whose sets a task holds at once.
AT_ONCE = 500
_EPS = 1e-9

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | bytes | None) -> np.ndarray:
    """The ascending distinct fingerprints of a text's shingles; bytes are UTF-8."""
    if isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    w = text.lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    known = held("jaccard")
    if len(known) > CACHE_WORDS:
        known.clear()
    try:
        h = np.array([known[x] for x in w], np.uint64)
    except KeyError:
        for x in w:
            if x not in known:
                known[x] = xxhash.xxh3_64_intdigest(x)
        h = np.array([known[x] for x in w], np.uint64)
    size = min(SHINGLE, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def linked(inter, union):
    return 100 * inter >= 80 * union


class Pivots:
    """Inverted index over the pivots' shingles, and what the pivots are to one another."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *sets])
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(every, kind="stable")
        self.keys, first = np.unique(every[order], return_index=True)
        self.ends = np.append(first, len(every)).astype(np.int64)
        self.owners = owner[order]
        self.group = np.arange(len(sets))  # smallest pivot reachable by links between pivots
        self.cell = np.zeros(len(sets), bool)
        for p, s in enumerate(sets):
            near, inter = self.overlaps(s)
            union = self.sizes[near] + len(s) - inter
            for q in near[linked(inter, union) & (near < p)]:
                a, b = sorted((self.group[p], self.group[q]))
                if a != b:
                    self.group[self.group == b] = a
            close = near[(1 - inter / union < APART) & (near < p)]
            self.cell[p] = not self.cell[close].any()

    def overlaps(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pivots that a set meets, and in how many shingles."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.keys) or not len(s):
            return none
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        known = self.keys[at] == s
        at = at[known]
        if not len(at):
            return none
        starts, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        flat = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        inter = np.bincount(self.owners[flat], minlength=len(self.sizes))
        near = np.flatnonzero(inter)
        return near, inter[near]

    def place(self, s: np.ndarray) -> tuple[list[int], list[tuple[int, float, bool]]]:
        """Groups of pivots that a set links to, and its (cell, distance, at home)."""
        near, inter = self.overlaps(s)
        union = self.sizes[near] + len(s) - inter
        anchors = np.unique(self.group[near[linked(inter, union)]]).tolist()
        distance = 1 - inter / np.maximum(union, 1)
        own = self.cell[near]
        near, distance = near[own], distance[own]
        cells: list[tuple[int, float, bool]] = []
        least, home = (distance.min(), int(near[distance.argmin()])) if len(near) else (1.0, OUTER)
        if least > RHO + _EPS:
            home = OUTER
            cells.append((OUTER, 0.0, True))
        inside = distance <= min(least + 2 * R, RHO + R) + _EPS
        cells += [(p, d, p == home) for p, d in zip(near[inside].tolist(), distance[inside].tolist(), strict=True)]
        return anchors, cells


def first_shingles(s: np.ndarray, frequent: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first shingles in the order that goes by ``level``, which ``frequent`` (ascending) have above zero."""
    if not len(s):
        return s
    size = len(s) - (8 * len(s) + 9) // 10 + 1
    if not len(frequent):
        return s[:size]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    return s[np.argsort(np.where(frequent[at] == s, level[at], 0), kind="stable")[:size]]


def in_classes(s: np.ndarray) -> np.ndarray:
    """How many shingles of a set are in each class."""
    return np.bincount((s & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches and the sets of their texts; only a part's texts become Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(i, AT_ONCE)
            yield part, [shingles(x) for x in part["text"].cast(pa.binary()).to_pylist()]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *values]), kind))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets in _slices(batches):
        yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "digest", "s"])


SETS = "doc_id long, digest binary, s binary"


def sample_pivots(docs: DataFrame) -> tuple[list[bytes], list[np.ndarray]]:
    """Digests and sets of about PIVOTS documents, chosen by a hash of the row; different sets only."""
    total = docs.count()
    share = min(1.0, PIVOTS / max(total, 1))
    picked = docs.where("doc_id is not null").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = picked.mapInArrow(_sets, SETS).where(f"length(s) between 8 and {8 * PIVOT_SHINGLES}").select("digest", "s").collect()
    different = sorted({bytes(r["digest"]): bytes(r["s"]) for r in rows}.items())
    return [k for k, _ in different], [np.frombuffer(v, np.uint64) for _, v in different]


_CELL = pa.struct([("p", pa.int32()), ("d", pa.float64()), ("home", pa.bool_())])


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, *order = shared.value
        for part, sets in _slices(batches):
            got = [pivots.place(s) for s in sets]
            cells = [[{"p": p, "d": d, "home": h} for p, d, h in c] for _, c in got]
            first = [first_shingles(s, *order).view(np.int64) for s in sets]
            counts = [in_classes(s) for s in sets]
            odd = [np.packbits(c.astype(np.uint8) & 1).view(np.int64) for c in counts]
            spread = [np.minimum(c, 255).astype(np.uint8).tobytes() if len(s) > LONG else None for c, s in zip(counts, sets, strict=True)]
            columns = [part["doc_id"], part["uid"], pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([a for a, _ in got], pa.list_(pa.int32())), pa.array(cells, pa.list_(_CELL)), _lists(first, pa.int64()), _lists(odd, pa.int64()), pa.array(spread, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "uid", "n", "digest", "anchors", "cells", "first", "odd", "spread"])

    return run


PLACED = "doc_id long, uid long, n long, digest binary, anchors array<int>, cells array<struct<p:int,d:double,home:boolean>>, first array<long>, odd array<long>, spread binary"


@F.pandas_udf(T.LongType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending shingles that at least two documents of the counted share have, the most frequent ORDERED of them, and the power of two of each one's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _slices(batches):
            different = {_digest(s): s for s in sets}
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *different.values()]).view(np.int64))], names=["h"])

    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(ORDER_SHARE)) == 0).dropDuplicates(["text"])
    counted = part.mapInArrow(run, "h long").groupBy("h").count().where("count > 1")
    rows = counted.orderBy(F.desc("count"), "h").limit(ORDERED).select("h", F.log2("count").cast("byte").alias("level")).toPandas()
    h, level = rows["h"].to_numpy(np.int64).view(np.uint64), rows["level"].to_numpy(np.uint8)
    order = np.argsort(h)
    return h[order], level[order]


def _may(n1: str, at1: str, n2: str, at2: str) -> str:
    """Whether sets whose first shared shingle is at these places can link: what follows in either is enough."""
    return f"10 * least({n1}, {n2}) >= 8 * greatest({n1}, {n2}) and least({n1} - {at1}, {n2} - {at2}) >= ceil(4 * ({n1} + {n2}) / 9)"


def regions(reps: DataFrame) -> DataFrame:
    """p, h, rep, n, at, d, home, leader: the documents of each one-shingle region that has two at least, with their places in it and its smallest document."""
    first = reps.select("rep", F.posexplode("first").alias("at", "h"))
    twice = first.groupBy("h").count().where("count > 1").select("h")
    met = first.join(twice, "h", "left_semi").join(reps.select("rep", F.col("n").cast("int").alias("n"), "cells"), "rep")
    rows = stored(met.select("rep", "n", "at", "h", F.explode("cells").alias("c")).select("c.p", "h", "rep", "n", "at", "c.d", "c.home"), "placed-regions")
    shared = rows.groupBy("p", "h").agg(F.count("*").alias("m"), F.min(F.struct("rep", "n", "at")).alias("leader")).where("m > 1").drop("m")
    return rows.join(shared, ["p", "h"])


def leader_pairs(members: DataFrame) -> DataFrame:
    """(x, y): documents and the leaders of their regions that may link."""
    met = members.where("rep <> leader.rep").where(_may("n", "at", "leader.n", "leader.at"))
    return met.select(F.col("leader.rep").alias("x"), F.col("rep").alias("y")).distinct()


def other_pairs(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(x, y) that may link and are not of one group, within regions where more than one group is left."""
    grouped = members.drop("leader").join(groups, members["rep"] == groups["node"], "left").drop("node").withColumn("g", F.coalesce("component", "rep")).drop("component")
    counted = grouped.groupBy("p", "h", "g").agg(F.count("*").alias("m"), F.max("home").alias("at_home"))
    left_over = counted.groupBy("p", "h").agg(F.count("*").alias("k"), F.max("at_home").alias("at_home"), F.max_by("g", F.struct("m", "g")).alias("top")).where("k > 1 and at_home").select("p", "h", "top")
    known = grouped.join(left_over, ["p", "h"]).withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + F.lit(1e-6)).cast("int"))
    named = lambda k: [F.col(c).alias(c + k) for c in ("rep", "n", "at", "d", "home", "g")]
    left = known.where("g <> top").select("p", "h", F.col("size").alias("part"), "top", *named("1"))
    right = known.select("p", "h", F.explode(F.array(F.col("size") - 1, "size", F.col("size") + 1)).alias("part"), *named("2"))
    may = f"g1 <> g2 and (g2 = top or rep1 < rep2) and (home1 or home2) and abs(d1 - d2) <= {R + _EPS} and {_may('n1', 'at1', 'n2', 'at2')}"
    return left.join(right, ["p", "h", "part"]).where(may).select(F.least("rep1", "rep2").alias("x"), F.greatest("rep1", "rep2").alias("y")).distinct()


#: In how many shingles partners may differ, and in how many the parities say that two sets differ at least.
_MOST = "nx + ny - 2 * ceil(4 * (nx + ny) / 9)"
_ODD = " + ".join(f"bit_count(oddx[{k}] ^ oddy[{k}])" for k in range(CLASSES // 64))


@F.pandas_udf(T.LongType())
def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    """In how many shingles two sets differ at least by their numbers in each class; 0 where these are not kept."""
    counts = lambda x: np.frombuffer(x, np.uint8).astype(np.int64)
    return pd.Series([0 if x is None or y is None else int(np.abs(counts(x) - counts(y)).sum()) for x, y in zip(a, b, strict=True)], dtype="int64")


def alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The (x, y) of ``pairs``, each once, that may link by what is kept of their sets."""
    side = lambda k: reps.select(F.col("rep").alias(k), *(F.col(c).alias(c + k) for c in ("n", "odd", "spread")))
    near = pairs.join(side("x"), "x").join(side("y"), "y").where(f"{_ODD} <= {_MOST}")
    return near.where(_apart("spreadx", "spready") <= F.expr(_MOST)).select("x", "y")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose sets, made again from the texts, link."""
    pairs = stored(pairs, "pairs")
    wanted = stored(pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct(), "wanted")
    texts = docs.join(maybe_broadcast(wanted), "doc_id", "left_semi").mapInArrow(_sets, SETS)
    chosen = texts.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["doc_id"]).select("doc_id", "s")
    chosen = stored(chosen, "sets")
    both = pairs.join(chosen.select(F.col("doc_id").alias("x"), F.col("s").alias("sx")), "x").join(chosen.select(F.col("doc_id").alias("y"), F.col("s").alias("sy")), "y")
    counted = both.select(F.col("x").alias("a"), F.col("y").alias("b"), ((F.length("sx") + F.length("sy")) / 8).cast("long").alias("n"), _shared("sx", "sy").alias("i"))
    return stored(counted.where(linked(F.col("i"), F.col("n") - F.col("i"))).select("a", "b"), "links")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digests, sets = sample_pivots(docs)
    pivots = Pivots(sets)
    shared = spark.sparkContext.broadcast((pivots, *frequent_shingles(docs)))
    path = fresh_dir(spark, "placed")
    placed = stored_at(docs.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_placed(shared), PLACED), path)
    classes = placed.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "uid")).alias("least"))
    classes = stored(classes.select("digest", F.col("least.doc_id").alias("rep"), F.col("least.uid").alias("uid")), "classes")
    reps = stored(classes.select("rep", "uid").join(placed.select("uid", "n", "anchors", "cells", "first", "odd", "spread"), "uid").drop("uid"), "reps")
    placed = stored(placed.select("doc_id", "n", "digest"), "placed-ids")
    remove_dir(spark, path)  # what is needed of it is in reps and placed
    shared.destroy()
    members = stored(regions(reps), "regions")
    links = _anchor_edges(reps, classes, digests, pivots).unionByName(verified(alike(leader_pairs(members), reps), docs, classes))
    links = stored(links, "links")
    groups = stored(components(links), "groups")
    links = links.unionByName(verified(alike(other_pairs(members, groups), reps), docs, classes))
    found = components(links)
    labels = classes.join(found, classes["rep"] == found["node"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "n", "digest").join(labels, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def _anchor_edges(reps: DataFrame, classes: DataFrame, digests: list[bytes], pivots: Pivots) -> DataFrame:
    """(a, b): an anchored representative and that of the pivot its group is named after, and of each pivot of a group."""
    spark = reps.sparkSession
    rows = [(bytearray(k), int(p), int(pivots.group[p])) for p, k in enumerate(digests)]
    table = spark.createDataFrame(rows, "digest binary, pivot int, grp int")
    owners = classes.join(F.broadcast(table), "digest").select("pivot", "grp", "rep")  # PIVOTS rows at most
    heads = owners.where("pivot = grp").select(F.col("grp").alias("anchor"), F.col("rep").alias("b"))
    return reps.select(F.col("rep").alias("a"), F.explode("anchors").alias("anchor")).join(F.broadcast(heads), "anchor").select("a", "b").where("a <> b")


def keep_one(docs: DataFrame, joined: DataFrame | None = None) -> DataFrame:
    """``docs`` without all but one document of each component: the one with the smallest doc_id stays.

    Of rows that repeat a kept doc_id one stays; rows with a null doc_id stay. All columns are kept.
    """
    joined = stored(join(docs) if joined is None else joined, "joined")
    gone = stored(joined.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    out = docs.join(maybe_broadcast(gone), "doc_id", "left_anti")
    repeated = stored(joined.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return out
    again = unused(out, "_again")
    marked = out.join(maybe_broadcast(repeated.withColumn(again, F.lit(1))), "doc_id", "left")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    single = marked.where(F.col(again).isNotNull()).withColumn(again, rank).where(F.col(again) == 1)
    return marked.where(F.col(again).isNull()).drop(again).unionByName(single.drop(again))
