"""Removal of repeated 400-byte strings by merged suffix runs (operator 12).

Texts are UTF-8 bytes. A byte goes if it is covered by a string of ``LENGTH`` bytes that starts anywhere else
too, in the same text or another; strings are judged on the input.

Not every suffix is sorted. Of the ``GRAM``-byte strings in a window of ``LENGTH`` bytes the one of the least hash
is the window's anchor, so equal windows have equal anchors at equal offsets, and consecutive windows share
one. Anchors whose gram occurs once cannot lie in a repeat. For every other anchor the suffix that begins at
it travels, to the end of its last window, together with what its first window has before it:

* a task sorts such suffixes in runs of bounded size by (gram hash, suffix) and front-codes them: the number
  of bytes shared with the one before, and the others;
* runs are exchanged by ranges of the hash, which are even, so no sample is needed for splitters;
* a loser tree merges the runs of a range. Each entry knows how many bytes it shares with the last suffix put
  out; entries of different counts are ordered by these alone, and of equal ones only later bytes are compared;
* the merged order and its counts of shared bytes say which suffixes agree to any depth, and a sort of what
  stands before the anchors does so backwards. Two windows at offset ``o`` before their anchors are equal if they
  agree ``o`` bytes backwards and ``LENGTH - o`` forwards; that is decided for all suffixes at once.

A gram with more than ``CLASS_ROWS`` anchors is too much for one task. Its windows are told apart by digests of
128 bits instead: blocks of neighbouring windows at a time, by what all of them share and by all that they
span, and only blocks that are neither unique nor whole repeats are cut smaller, down to single windows.
Counts of hashes and digests are summed map-side and those of frequent ones are broadcast, so no task holds such a class.

Texts are handled once each: of equal ones of ``LENGTH`` bytes or more every byte goes. A null text is empty;
rows that repeat a doc_id are texts of their own; an empty table gives no rows; texts of any length are taken
whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh_dir, maybe_broadcast, released, remove_dir, stored, stored_at

LENGTH, GRAM = 400, 128
#: Anchors that a window can have, less one: the largest offset of a window before its anchor.
REACH = LENGTH - GRAM
#: Anchors of one gram that a task may hold, and of a range of hashes on average.
CLASS_ROWS, RANGE_ROWS = 40_000, 12_000
#: Rows of one hash or digest that a join may bring together in a task.
HOT_ROWS = 2_000
#: Windows of a block, where a gram has too many anchors.
WIDTHS = (64, 8, 1)
#: Bytes of a run, and bytes whose anchors are found at once.
RUN_BYTES, STEP = 8 << 20, 1 << 20

_BASE = 0x9E3779B97F4A7C15
_ANCHORS = pa.schema([("row", pa.int64()), ("hash", pa.int64()), ("at", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
_RUNS = pa.schema([("range", pa.int32()), ("shared", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())), ("before", pa.list_(pa.binary())), ("owner", pa.list_(pa.int64())), ("at", pa.list_(pa.int64())), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64()))])
_COVERED = pa.schema([("row", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
_BLOCKS = pa.schema([("row", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("core", pa.binary()), ("span", pa.binary())])
_KEPT = pa.schema([("digest", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def gram_hashes(values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    n = len(values)
    down = np.full(n, inverse, np.uint64)
    down[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * np.cumprod(down))])
    up = np.full(n - GRAM + 1, base, np.uint64)
    up[0] = pow(_BASE, GRAM - 1, 1 << 64)
    h = (sums[GRAM:] - sums[:-GRAM]) * np.cumprod(up)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts that lie one after the other: text, hash, place of each anchor, and its first and last window."""
    out = []
    for base in range(0, len(values), STEP):
        stop = min(base + STEP + LENGTH - 1, len(values))
        if stop - base < LENGTH:
            continue
        h = gram_hashes(values[base:stop])
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size < REACH + 1:
            step = min(size, REACH + 1 - size)
            least, size = np.minimum(least[:-step], least[step:]), size + step
        start = np.arange(base, base + len(least))
        owner = np.searchsorted(ends, base, side="right") + np.cumsum(np.bincount(np.maximum(ends[(ends > base) & (ends < base + len(least))] - base, 0), minlength=len(least))[: len(least)])
        inside = np.flatnonzero(start + LENGTH <= ends[np.minimum(owner, len(ends) - 1)])
        if not len(inside):
            continue
        at, start, owner = (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64), start[inside], owner[inside]
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1) | (owner[1:] != owner[:-1])))
        last = np.append(first[1:] - 1, len(at) - 1)
        out.append((owner[first], h[at[first]].view(np.int64), at[first] + base, start[first], start[last]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    owner, h, at, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True))
    h = h.view(np.uint64) * np.uint64(0x9FB21C651E98DF25)  # anchors have small hashes; these are even again
    h = (h ^ (h >> np.uint64(32))).view(np.int64)
    begin = np.concatenate(([0], ends[:-1]))[owner]
    return owner, h, at - begin, lo - begin, hi - begin


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            texts = batch["raw"].to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            owner, *facts = anchors(np.frombuffer(b"".join(texts), np.uint8), ends)
            rows = batch["row"].to_numpy(zero_copy_only=False)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(rows), *map(pa.array, facts)], schema=_ANCHORS)


def shared_bytes(a: bytes, b: bytes, known: int) -> int:
    """How many bytes two strings share, ``known`` at least."""
    most = min(len(a), len(b))
    while known + 32 <= most and a[known : known + 32] == b[known : known + 32]:
        known += 32
    while known < most and a[known] == b[known]:
        known += 1
    return known


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """For sorted strings: the bytes each shares with the one before, and the others."""
    shared = [0, *(shared_bytes(a, b, 0) for a, b in zip(strings, strings[1:]))][: len(strings)]  # noqa: B905
    return shared, [s[n:] for s, n in zip(strings, shared, strict=True)]


def merged(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """Front-coded sorted runs as one order: the run, the place in it and the bytes shared with the one before.

    A loser tree. Each entry is a run and the bytes its next string shares with the string put out last; bytes
    that are known to be shared are not looked at again.
    """
    leaves = 1 << max(0, len(runs) - 1).bit_length()
    strings: list[bytes | None] = [rest[0] if rest else None for _, rest in runs] + [None] * (leaves - len(runs))
    place = [0] * leaves

    def met(x: tuple[int, int], y: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """Winner and loser."""
        a, b = strings[x[0]], strings[y[0]]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if x[1] != y[1]:
            return (x, y) if x[1] > y[1] else (y, x)
        n = shared_bytes(a, b, x[1])
        if n == len(a) or (n < len(b) and a[n] < b[n]):
            return x, (y[0], n)
        return y, (x[0], n)

    losers: list[tuple[int, int]] = [(0, 0)] * leaves
    level = [(i, 0) for i in range(leaves)]
    node = leaves
    while len(level) > 1:
        node //= 2
        pairs = [met(a, b) for a, b in zip(level[::2], level[1::2], strict=True)]
        losers[node : 2 * node] = [loser for _, loser in pairs]
        level = [winner for winner, _ in pairs]
    (best,) = level
    while strings[best[0]] is not None:
        run = best[0]
        yield run, place[run], best[1]
        place[run] += 1
        shared, rest = runs[run]
        if place[run] < len(rest):
            n = shared[place[run]]
            strings[run], best = strings[run][:n] + rest[place[run]], (run, n)
        else:
            strings[run], best = None, (run, 0)
        node = (run + leaves) // 2
        while node:
            best, losers[node] = met(best, losers[node])
            node //= 2


def _sorted_runs(ranges: int):
    """Suffixes of a task in front-coded runs, a row for each range of hashes in a run."""

    def flushed(items: list[tuple]) -> pa.RecordBatch:
        items.sort(key=itemgetter(0, 1))
        rows, lo = [], 0
        while lo < len(items):
            hi = lo
            while hi < len(items) and items[hi][0] == items[lo][0]:
                hi += 1
            part = items[lo:hi]
            rows.append((part[0][0], *front_coded([x[1] for x in part]), *([x[k] for x in part] for k in range(2, 7))))
            lo = hi
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RUNS, strict=True)], schema=_RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row, raw, found = batch["row"][k].as_py(), batch["raw"][k].as_py(), batch["found"][k].values
                for h, at, lo, hi in zip(*(found.field(c).to_pylist() for c in ("hash", "at", "lo", "hi")), strict=True):
                    key = (h + (1 << 63)).to_bytes(8)
                    after, before = raw[at : hi + LENGTH], raw[lo:at][::-1]
                    items.append(((h + (1 << 63)) * ranges >> 64, key + after, before, row, at, lo, hi))
                    size += len(after) + len(before) + 64
                    if size >= RUN_BYTES:
                        yield flushed(items)
                        items, size = [], 0
        if items:
            yield flushed(items)

    return run


def repeated_windows(shared: np.ndarray, before: list[bytes], nearest: np.ndarray, farthest: np.ndarray) -> np.ndarray:
    """For suffixes in order: whether the window at each offset before the anchor occurs at another suffix too.

    ``shared`` has the bytes each shares with the one before it in the order, ``before`` what precedes the anchors,
    read backwards; offsets from ``nearest`` to ``farthest`` are those of a suffix's own windows.
    """
    n = len(before)
    order = sorted(range(n), key=before.__getitem__)
    back = np.array([0, *(shared_bytes(before[a], before[b], 0) for a, b in zip(order, order[1:]))])  # noqa: B905
    order, out = np.array(order), np.zeros((n, REACH + 1), bool)
    backwards = np.empty(n, np.int64)
    for o in range(int(nearest.min()), int(farthest.max()) + 1):
        own = np.flatnonzero((nearest <= o) & (o <= farthest))
        if len(own) < 2:
            continue
        forwards = np.cumsum(shared < LENGTH - o)
        backwards[order] = np.cumsum(back < o)
        key = (forwards * (n + 1) + backwards)[own]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        out[own[by], o] = np.append(False, same) | np.append(same, False)
    return out


def _merged_range(table: pa.Table) -> pa.Table:
    """Covered byte ranges of the suffixes of one range of hashes."""
    rows = [{c: table[c][k].as_py() for c in ("shared", "rest", "before", "owner", "at", "lo", "hi")} for k in range(table.num_rows)]
    order = list(merged([(r["shared"], r["rest"]) for r in rows]))
    shared = np.array([n - 8 for _, _, n in order])
    facts = {c: np.array([rows[r][c][k] for r, k, _ in order], np.int64) for c in ("owner", "at", "lo", "hi")}
    found = repeated_windows(shared, [rows[r]["before"][k] for r, k, _ in order], facts["at"] - facts["hi"], facts["at"] - facts["lo"])
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (i, first), (_, last) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    # Offsets first to last - 1 before the anchor: windows from at - last + 1 to at - first.
    at = facts["at"][i]
    return pa.table([pa.array(facts["owner"][i]), pa.array(at - last + 1), pa.array(at - first + LENGTH)], schema=_COVERED)


def _repeated(rows: DataFrame, key: str, path: str, how: str = "inner") -> DataFrame:
    """``rows`` with the ``count`` of their key in ``rows`` or, for a left join, null where it occurs once.

    Keys of more than HOT_ROWS rows, of which there are few, are sent to all tasks, so that no task gets all rows of one.
    """
    counts = stored_at(rows.groupBy(key).count().where("count > 1"), path)
    hot = F.broadcast(counts.where(F.col("count") > HOT_ROWS))
    others = rows.join(hot.select(key), key, "left_anti").join(counts.where(F.col("count") <= HOT_ROWS), key, how)
    return rows.join(hot, key).unionByName(others)


def _with_texts(texts: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """row, raw, found: each text that has rows in ``found``, with these, which its length bounds."""
    of = found.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("found"))
    return texts.select("row", "raw").join(maybe_broadcast(of, found.count()), "row")


def _covered_by_runs(texts: DataFrame, found: DataFrame) -> DataFrame:
    ranges = found.count() // RANGE_ROWS + 1
    runs = bounded(_with_texts(texts, found, ["hash", "at", "lo", "hi"])).mapInArrow(_sorted_runs(ranges), "range int, shared array<int>, rest array<binary>, before array<binary>, owner array<bigint>, at array<bigint>, lo array<bigint>, hi array<bigint>")
    return runs.repartition(ranges, "range").groupBy("range").applyInArrow(_merged_range, "row bigint, begin bigint, end bigint")


def _blocks(width: int):
    """Windows of an anchor in blocks of ``width`` offsets, with digests of what the windows of a block share and of what they span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row, raw, found, out = batch["row"][k].as_py(), batch["raw"][k].as_py(), batch["found"][k].values, []
                for at, lo, hi in zip(*(found.field(c).to_pylist() for c in ("at", "lo", "hi")), strict=True):
                    for b in range((at - hi) // width, (at - lo) // width + 1):
                        near, far = max(b * width, at - hi), min(b * width + width - 1, at - lo)
                        core = xxhash.xxh3_128_digest(b"%d %d " % (width, b) + raw[at - b * width : at - (b * width + width - 1) + LENGTH])
                        span = xxhash.xxh3_128_digest(b"%d %d %d " % (near, far, width) + raw[at - far : at - near + LENGTH])
                        out.append((row, at, at - far, at - near, core, span))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)

    return run


def _covered_by_digests(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The same for grams with very many anchors."""
    spark, done = texts.sparkSession, []
    for width in WIDTHS:
        paths = [fresh_dir(spark, name) for name in ("window-blocks", "shared-cores", "cores", "spans")]
        blocks = bounded(_with_texts(texts, found, ["at", "lo", "hi"])).mapInArrow(_blocks(width), "row bigint, at bigint, first bigint, last bigint, core binary, span binary")
        blocks = stored_at(blocks, paths[0])
        blocks = stored_at(_repeated(blocks, "core", paths[2]).drop("count"), paths[1])  # equal spans have equal cores
        remove_dir(spark, paths[0])
        told = _repeated(blocks, "span", paths[3], "left").select("row", "at", "first", "last", "core", "span", F.col("count").isNotNull().alias("whole"))
        told = stored(told, "repeated-blocks")
        for path in paths[1:]:
            remove_dir(spark, path)
        done.append(told.where("whole").select("row", F.col("first").alias("begin"), (F.col("last") + LENGTH).alias("end")))
        # Cut smaller, and of each whole repeat that has something in common with these, one that they can be found in.
        parts = told.where("not whole")
        met = told.where("whole").groupBy("span").agg(F.min(F.struct("row", "at", "first", "last", "core")).alias("one")).select("one.*")
        met = met.join(parts.select("core").distinct(), "core", "left_semi").drop("core")
        found = parts.select("row", "at", "first", "last").unionByName(met).withColumnsRenamed({"first": "lo", "last": "hi"})
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of texts without the byte ranges in ``found``."""
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            raw, found = batch["raw"][k].as_py(), batch["found"][k].values
            begin, end = (found.field(c).to_numpy(zero_copy_only=False) for c in ("begin", "end"))
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], np.maximum.accumulate(end[order])
            first = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
            begin, end = begin[first], end[np.append(first[1:] - 1, len(end) - 1)]
            told, at = hashlib.sha256(), 0
            for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                told.update(raw[at:b])
                at = e
            told.update(raw[at:])
            out.append((hashlib.sha256(raw).digest(), int((end - begin).sum()), len(begin), told.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _KEPT, strict=True)], schema=_KEPT)


def report(docs: DataFrame, class_rows: int = CLASS_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    given = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    texts = given.where(F.octet_length("raw") >= LENGTH).groupBy("raw").agg(F.count("*").alias("copies"))
    spark = docs.sparkSession
    paths = [fresh_dir(spark, name) for name in ("texts", "anchors", "shared-anchors", "covered", "grams")]
    texts = stored_at(texts.withColumn("row", F.monotonically_increasing_id()), paths[0])
    released(spark)
    found = stored_at(bounded(texts.select("row", "raw")).mapInArrow(_anchor_rows, "row bigint, hash bigint, at bigint, lo bigint, hi bigint"), paths[1])
    found = stored_at(_repeated(found, "hash", paths[4]), paths[2])
    released(spark)
    few, many = found.where(F.col("count") <= class_rows), found.where(F.col("count") > class_rows)
    covered = _covered_by_runs(texts, few)
    if not many.isEmpty():
        covered = covered.unionByName(_covered_by_digests(texts, many))
    covered = stored_at(covered, paths[3])
    released(spark)
    once = texts.where("copies = 1")
    kept = _with_texts(once, covered, ["begin", "end"]).select("raw", "found")
    some = bounded(kept).mapInArrow(_kept, "digest binary, n_removed bigint, n_spans bigint, kept_sha256 string")
    nothing = F.lit(hashlib.sha256().hexdigest())
    gone = texts.where("copies > 1").select(F.unhex(F.sha2("raw", 256)).alias("digest"), F.octet_length("raw").cast("bigint").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), nothing.alias("kept_sha256"))
    told = stored(some.unionByName(gone), "removed")
    del texts, found, few, many, covered, once, kept, some, gone
    for path in paths:
        remove_dir(spark, path)
    released(spark)
    rows = given.select("doc_id", F.octet_length("raw").cast("bigint").alias("n_bytes"), F.unhex(F.sha2("raw", 256)).alias("digest")).join(maybe_broadcast(told), "digest", "left")
    zero = F.lit(0).cast("bigint")
    return rows.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"))
