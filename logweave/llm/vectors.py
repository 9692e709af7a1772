"""Embedding near-duplicates over a robust-pruned flat graph (operator 10).

1. *Copies.* Equal vectors of one label are a class; the rest works on one vector of each.
2. *Shards.* Centres are fitted on a bounded sample of each label; every vector goes to the shards of its
   ``OVERLAP`` nearest centres. A shard of more than ``BLOCK`` vectors gets centres of its own, and so on.
   Centres that are near one another become one, so that a large group of near copies neither draws all of
   them to itself nor is cut up; a shard that its centres leave nearly whole is dealt into blocks instead.
3. *Build.* In each block every vector gets out-edges by robust pruning of its nearest candidates and of
   some far ones, with reverse edges, and every vector can be reached from the block's medoid. The
   adjacency lists that a vector has in several shards are united.
4. *Search.* Every vector is a query in all blocks of its shards: a greedy beam search from the medoid and
   from the vector's own place or neighbours in the block; then the range expands from the vectors within
   range along the united edges until nothing new is in range.
5. *Verify.* Only pairs whose cosine, in double precision, reaches the threshold are links. A pair that has
   several shards counts in the first of them. A task returns how many links each vector has and the
   smallest vector that it is joined with, not the pairs.

``audit`` compares with brute force for queries chosen by vec_id. Vectors are compared only under equal,
non-null labels (and of equal length). A vector that is null, empty, zero or has a null or non-finite
component links with nothing, as does a row with a null vec_id; such a row is kept. Rows that repeat a
vec_id are vectors of their own in the counts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, maybe_broadcast, stored
from .graph import components

THRESHOLD = 0.98
#: Vectors of all labels that the first centres are fitted on, at most about so many with so many components, and
#: these centres at most; the same for the centres of one shard.
SAMPLE, SAMPLE_VALUES, MAX_CENTRES = 20_000, 4_000_000, 2_000
SHARD_SAMPLE, SHARD_CENTRES = 2_000, 64
#: Centres whose cosine is higher are one.
ONE_CENTRE = 0.9
BLOCK, OVERLAP, OVERLAP_AGAIN = 1_000, 3, 2
#: A shard that keeps a greater share of the one that it comes from is not parted again.
NEARLY_WHOLE = 0.7
NEAR, FAR, DEGREE, ALPHA, BEAM = 48, 32, 20, 1.2, 32
SEED = 17


def unit(rows) -> np.ndarray:
    v = np.array([np.asarray(x, np.float64) for x in rows])
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def prune(v: np.ndarray, i: int, candidates: np.ndarray) -> list[int]:
    """Out-neighbours of i: nearest first, leaving out those much nearer to one already chosen."""
    candidates = candidates[candidates != i]
    gap = 2 - 2 * (v[candidates] @ v[i])
    order = np.argsort(gap, kind="stable")
    candidates, gap = candidates[order], gap[order]
    alive, chosen = np.ones(len(candidates), bool), []
    for k in range(len(candidates)):
        if alive[k]:
            chosen.append(int(candidates[k]))
            if len(chosen) == DEGREE:
                break
            alive &= ALPHA * ALPHA * (2 - 2 * (v[candidates] @ v[candidates[k]])) > gap
    return chosen


def build(v: np.ndarray) -> tuple[list[list[int]], int]:
    """Adjacency lists over the rows of ``v`` (unit vectors) and the medoid."""
    n = len(v)
    medoid = int(np.argmax(v @ v.mean(axis=0)))
    rng = np.random.default_rng(SEED)
    out: list[list[int]] = []
    for start in range(0, n, 256):
        sims = v[start : start + 256] @ v.T
        near = np.argpartition(-sims, min(NEAR, n - 1), axis=1)[:, : NEAR + 1]
        for r, i in enumerate(range(start, min(start + 256, n))):
            out.append(prune(v, i, np.unique(np.concatenate([near[r], rng.integers(0, n, FAR)]))))
    back: list[list[int]] = [[] for _ in range(n)]
    for i, near in enumerate(out):
        for j in near:
            back[j].append(i)
    for i in range(n):
        both = np.unique(np.array(out[i] + back[i], np.int64))
        out[i] = both.tolist() if len(both) <= DEGREE else prune(v, i, both)
    reached = np.zeros(n, bool)

    def walk(i: int) -> None:
        reached[i] = True
        todo = [i]
        while todo:
            for j in out[todo.pop()]:
                if not reached[j]:
                    reached[j] = True
                    todo.append(j)

    walk(medoid)
    for i in range(n):
        if not reached[i]:
            inside = np.flatnonzero(reached)
            nearest = int(inside[np.argmax(v[inside] @ v[i])])
            out[nearest].append(i)
            out[i].append(nearest)
            walk(i)
    return out, medoid


def search(v: np.ndarray, edges: list[np.ndarray], entries: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes within range of q that the search from ``entries`` meets, and their cosines."""
    seen = np.zeros(len(v), bool)
    seen[entries] = True
    ids, sims = np.flatnonzero(seen), v[seen] @ q
    expanded = np.zeros(len(ids), bool)
    while True:
        # All that is in range and not expanded yet; then the next best of the beam, until the beam is spent.
        open_ = np.flatnonzero(~expanded)
        if not len(open_):
            break
        take = open_[sims[open_] >= threshold]
        if not len(take):
            best = open_[np.argmax(sims[open_])]
            if (sims > sims[best]).sum() >= BEAM:
                break
            take = np.array([best])
        expanded[take] = True
        near = np.unique(np.concatenate([edges[i] for i in ids[take]]))
        near = near[~seen[near]]
        if len(near):
            seen[near] = True
            ids, sims, expanded = np.concatenate([ids, near]), np.concatenate([sims, v[near] @ q]), np.concatenate([expanded, np.zeros(len(near), bool)])
            if len(ids) > 6 * BEAM and (sims < threshold).sum() > 2 * BEAM:
                keep = np.sort(np.union1d(np.argsort(-sims, kind="stable")[:BEAM], np.flatnonzero(sims >= threshold)))
                ids, sims, expanded = ids[keep], sims[keep], expanded[keep]
    inside = sims >= threshold
    return ids[inside], sims[inside]


def _clean(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array of double; null unless it can link)."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & (square > 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(F.coalesce(good, F.lit(False)), v).alias("v"))


def fit_centres(v: np.ndarray, k: int) -> np.ndarray:
    """At most k centres of unit vectors, by a few rounds of k-means; of near ones the first stays."""
    c = v[np.random.default_rng(SEED).permutation(len(v))[:k]]
    for _ in range(5):
        own = np.argmax(v @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, v)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    c = c[np.argsort(-np.bincount(np.argmax(v @ c.T, axis=1), minlength=len(c)), kind="stable")]
    apart: list[int] = []
    for i in range(len(c)):
        if not (c[apart] @ c[i] >= ONE_CENTRE).any():
            apart.append(i)
    return c[apart]


def _centres(reps: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """The first centres for each (label, length), on a bounded sample."""
    sizes = reps.groupBy("label", F.size("v").alias("d")).count().orderBy(F.desc("count"), "label", "d").limit(MAX_CENTRES).collect()
    total = sum(r["count"] for r in sizes)
    if not total:
        return {}
    most = min(SAMPLE, SAMPLE_VALUES // max(r["d"] for r in sizes))
    share = int(min(1.0, most / total) * (1 << 30)) + 1
    groups: dict[tuple[str, int], list] = {}
    for r in reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < share).select("rep", "label", "v").collect():
        groups.setdefault((r["label"], len(r["v"])), []).append((r["rep"], r["v"]))
    wanted = {(r["label"], r["d"]): _wanted(r["count"]) for r in sizes}
    scale = max(1.0, sum(wanted.values()) / MAX_CENTRES)
    return {key: fit_centres(unit([x for _, x in sorted(rows)]), max(1, int(wanted.get(key, 1) / scale))) for key, rows in groups.items()}


def _wanted(n: int) -> int:
    """Centres for n vectors, so that shards, which differ in size, are mostly below BLOCK."""
    return -(-2 * OVERLAP * n // BLOCK) if n > BLOCK else 1


def _nearest(v: np.ndarray, centres: np.ndarray, n: int) -> list[list[int]]:
    return np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :n].tolist()


def _assign(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for pdf in batches:
            shard = []
            for label, x in zip(pdf["label"], pdf["v"], strict=True):
                c = centres.get((label, len(x)))
                near = [0] if c is None else _nearest(unit([x]), c, OVERLAP)[0]
                shard.append([f"{label}/{len(x)}/{k}" for k in near])
            yield pdf.drop(columns="label").assign(shards=shard)

    return run


def _fit_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Centres of one shard from its sample."""
    pdf = pdf.sort_values("rep")
    c = fit_centres(unit(pdf["v"]), min(SHARD_CENTRES, _wanted(int(pdf["size"].iloc[0]))))
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "centres": [c.tolist()]})


def _deal_again(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """One block of a shard to the shards of its centres; to a single one where its sample was empty."""
    if not len(rows):
        return pd.DataFrame({"rep": pd.Series(dtype="int64"), "v": [], "shard": []})
    c = np.array([list(x) for x in centres["centres"].iloc[0]]) if len(centres) else np.zeros((1, len(rows["v"].iloc[0])))
    near = _nearest(unit(rows["v"]), c, OVERLAP_AGAIN)
    at = np.repeat(np.arange(len(rows)), [len(x) for x in near])
    names = [f"{s}/{k}" for s, x in zip(rows["shard"], near, strict=True) for k in x]
    return rows[["rep", "v"]].iloc[at].assign(shard=names)


def shards(reps: DataFrame) -> DataFrame:
    """rep, v, shard: each vector in some shards; of more than BLOCK vectors are only those that cannot be parted."""
    shared = reps.sparkSession.sparkContext.broadcast(_centres(reps))
    dealt = reps.select("rep", "label", "v").mapInPandas(_assign(shared), "rep long, v array<double>, shards array<string>").select("rep", "v", F.explode("shards").alias("shard"))
    dealt, parted = stored(dealt, "vector-shards"), None
    while True:
        large = dealt.groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
        if parted is not None:  # the name of a shard begins with that of the one it comes from
            whole = parted.select(F.col("shard").alias("of"), F.col("size").alias("before"))
            large = large.withColumn("of", F.regexp_extract("shard", "^(.*)/[^/]*$", 1)).join(whole, "of", "left").where(f"before is null or size <= {NEARLY_WHOLE} * before").select("shard", "size")
        large = stored(large, "large-shards")
        if large.isEmpty():
            return dealt
        parted = large if parted is None else parted.union(large)
        mine = dealt.join(maybe_broadcast(large), "shard")
        sample = mine.where(F.pmod(F.xxhash64("rep", "shard"), "size") < SHARD_SAMPLE)
        centres = stored(sample.groupBy("shard").applyInPandas(_fit_shard, "shard string, centres array<array<double>>"), "shard-centres")
        blocks = F.ceil(F.col("size") / BLOCK).cast("long")
        rows = mine.withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).select("rep", "v", "shard", "block")
        each = centres.join(large, "shard").select("shard", "centres", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
        again = rows.groupBy("shard", "block").cogroup(each.groupBy("shard", "block")).applyInPandas(_deal_again, "rep long, v array<double>, shard string")
        dealt = stored(dealt.join(maybe_broadcast(large), "shard", "left_anti").select("rep", "v", "shard").unionByName(again), "vector-shards")


def _build_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep")
    ids = pdf["rep"].to_numpy()
    edges, _ = build(unit(pdf["v"]))
    return pd.DataFrame({"rep": ids, "near": [ids[e].tolist() for e in edges]})


#: Cosines nearer to the threshold are taken anew, from the vectors as they are.
_CLOSE = 1e-9


def _search_group(threshold: float):
    """For queries and the nodes of one block: rep, links of the queries that count here, and the smallest rep that each is joined with."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["node"]].sort_values("rep")
        asks = pdf[pdf["query"]].sort_values("rep")
        if not len(nodes) or not len(asks):
            return pd.DataFrame({"rep": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        ids, raw, v = nodes["rep"].to_numpy(), nodes["v"].to_numpy(), unit(nodes["v"])
        at = {x: i for i, x in enumerate(ids.tolist())}
        edges = [np.array([at[j] for j in near if j in at], np.int64) for near in nodes["near"]]
        medoid = int(np.argmax(v @ v.mean(axis=0)))
        weight = nodes["n"].to_numpy()
        inside: dict[str, np.ndarray] = {}  # of each shard that comes before this one, the nodes
        for i, before in enumerate(nodes["before"]):
            for shard in before:
                inside.setdefault(shard, np.zeros(len(ids), bool))[i] = True
        every = np.union1d(ids, asks["rep"].to_numpy())
        place, root, links = np.searchsorted(every, ids), np.arange(len(every)), np.zeros(len(every), np.int64)
        for rep, x, q, near, before in zip(asks["rep"].tolist(), asks["v"], unit(asks["v"]), asks["near"], asks["before"], strict=True):
            entries = [medoid, *(at[j] for j in (rep, *near) if j in at)]
            found, sims = search(v, edges, np.array(entries), q, threshold - _CLOSE)
            good = sims >= threshold + _CLOSE
            for i in np.flatnonzero(~good):
                x, y = np.asarray(x, np.float64), np.asarray(raw[found[i]], np.float64)
                good[i] = np.dot(x, y) >= threshold * np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y))
            found = found[good & (ids[found] != rep)]
            if not len(found):
                continue
            own = np.searchsorted(every, rep)
            joined = np.unique(root[np.append(place[found], own)])
            if len(joined) > 1:
                root[np.isin(root, joined)] = joined[0]
            counts = np.ones(len(found), bool)
            for shard in before:
                if shard in inside:
                    counts &= ~inside[shard][found]
            links[own] += weight[found[counts]].sum()
        some = (links > 0) | (root != np.arange(len(every)))
        return pd.DataFrame({"rep": every[some], "links": links[some], "root": every[root[some]]})

    return run


def classes_of(vectors: DataFrame) -> DataFrame:
    """rep, label, v, n: a row for each different vector of a label that can link, and how many rows have it."""
    return _clean(bounded(vectors)).where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select("rep", "label", "v", "n")


def links(reps: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rep, links): in how many rows other classes that a class links to have been found; and (a, b): edges that join the same classes as all links."""
    dealt = shards(reps)
    blocks = stored(dealt.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "vector-blocks")
    own = dealt.groupBy("rep").agg(F.sort_array(F.collect_set("shard")).alias("all"))
    members = dealt.join(maybe_broadcast(blocks), "shard").join(own, "rep").join(reps.select("rep", "n"), "rep")
    members = members.select("rep", "v", "n", "shard", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int").alias("block"), F.filter("all", lambda s: s < F.col("shard")).alias("before"))
    members = stored(members, "vector-members")
    lists = members.select("shard", "block", "rep", "v").groupBy("shard", "block").applyInPandas(_build_group, "rep long, near array<long>")
    united = stored(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vector-graph")
    full = members.join(united, "rep")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ["rep", "v", "n", "near", "before", "shard", "nodes", "queries", "node", "query"]
    as_nodes = full.select("*", F.col("block").alias("nodes"), others.alias("queries")).withColumns({"node": F.lit(True), "query": F.col("queries") == F.col("block")})
    as_queries = full.select("*", others.alias("nodes"), F.col("block").alias("queries")).where("nodes <> queries").withColumns({"node": F.lit(False), "query": F.lit(True)})
    found = as_nodes.select(*columns).unionByName(as_queries.select(*columns)).groupBy("shard", "nodes", "queries").applyInPandas(_search_group(threshold), "rep long, links long, root long")
    found = stored(found, "vector-links")
    return found.groupBy("rep").agg(F.sum("links").alias("links")), found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding, label)``."""
    reps = stored(classes_of(vectors), "vector-classes")
    counts, edges = links(reps, threshold)
    groups = components(edges)
    known = reps.select("rep", "n").join(counts, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    known = known.select("rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # A class is met by its label and vector; classes are few against the rows only where copies abound.
    owned = _clean(vectors).join(reps.select("label", "v", "rep"), ["label", "v"], "left").select("vec_id", "rep").join(known, "rep", "left")
    component = F.coalesce("component_id", "vec_id")
    return owned.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def audit(vectors: DataFrame, result: DataFrame, threshold: float = THRESHOLD, every: int = 50, block: int = 20_000) -> DataFrame:
    """vec_id, found, there: the links in ``result`` of the rows whose id is divisible by ``every``, and those by brute force over all rows, in blocks."""
    rows = stored(_clean(vectors).where("v is not null"), "vector-audit")
    blocks = F.lit(rows.count() // block + 1)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "label", "v").agg(F.count("*").alias("n"))
    asked = asked.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    held = rows.withColumn("b", F.pmod(F.xxhash64("vec_id"), blocks.cast("long")))

    def count(asks: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(asks), np.int64)
        if len(asks) and len(there):
            sizes = there["v"].map(len).to_numpy()
            for d in np.unique(sizes):
                mine = np.flatnonzero(asks["v"].map(len).to_numpy() == d)
                if len(mine):
                    out[mine] = (unit(asks["v"].iloc[mine]) @ unit(there["v"][sizes == d]).T >= threshold).sum(axis=1)
        return pd.DataFrame({"vec_id": asks["vec_id"], "there": out})

    met = asked.groupBy("label", "b").cogroup(held.groupBy("label", "b")).applyInPandas(count, "vec_id long, there long")
    there = met.groupBy("vec_id").agg((F.sum("there") - 1).alias("there"))  # a row is within range of itself
    return there.join(result.groupBy("vec_id").agg(F.max("n_links").alias("found")), "vec_id").select("vec_id", "found", "there")
