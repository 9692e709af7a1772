"""Substring deduplication by content-defined chunking (operator 9).

A gear rolling hash over the last 16 bytes cuts each text at places that its content alone decides: after
the byte of the least hash of every ``WINDOW`` bytes, so an insertion moves only the cuts around it and no
stretch of ``WINDOW`` bytes is without a cut. From each cut, as many chunks as make ``MIN_SPAN`` bytes are a
span, known by a 128-bit digest. A digest that occurs in two documents at least is a repeat. Overlapping and
touching repeats of a document make runs, and runs of at least ``MIN_RUN`` characters are reported.

Of a passage of n bytes that two documents share, all is covered but 15 + WINDOW bytes before the first
cut and WINDOW after the last at most; so it is reported if n is at least 15 + 2 * WINDOW + MIN_RUN (175),
wherever it stands, and most of those that are shorter by half of that are, too. The occurrence in the
document with the smallest doc_id stays, the others are for removal.

Offsets are code points, ends exclusive. A null or empty text has no repeats; a repeat within one document
alone does not count; rows that repeat a doc_id are one document and carry its report each; a row with a
null doc_id has an empty report and makes nothing a repeat. Other columns are ignored by ``repeats`` and
kept by ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .castore import rolling
from .common import bounded, stored, unused

WINDOW, MIN_SPAN, MIN_RUN = 48, 48, 64
#: Bytes that the rolling hash looks at.
GEAR = 16
#: Bytes of texts, of which a longer one is taken whole, and bytes whose cuts are found at once.
AT_ONCE, STEP = 2 << 20, 1 << 20
#: A span is its start, shifted by so many bits, and its length.
LENGTH_BITS = 20

_SPANS = pa.schema([("key", pa.int64()), ("key2", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])


def cuts(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of texts that lie one after the other and end at ``ends``."""
    n, begins = len(values), np.concatenate(([0], ends[:-1]))
    found = []
    for lo in range(0, n, STEP):
        back, hi = max(lo - GEAR + 1, 0), min(lo + STEP + WINDOW - 1, n)
        if hi - lo < WINDOW:
            continue
        inside = begins[np.searchsorted(begins, back) : np.searchsorted(begins, hi)]
        least = (rolling(values[back:hi], inside - back)[lo - back :].astype(np.uint64) << np.uint64(32)) | np.arange(hi - lo, dtype=np.uint64)
        size = 1
        while size < WINDOW:
            step = min(size, WINDOW - size)
            least, size = np.minimum(least[:-step], least[step:]), size + step
        whole = np.arange(lo + WINDOW, hi + 1)
        least = least[whole <= ends[np.searchsorted(ends, whole - WINDOW, side="right")]]  # windows within one text
        least = least[np.append(True, least[1:] != least[:-1])] if len(least) else least
        found.append(((least & np.uint64(0xFFFFFFFF)).astype(np.int64) + lo, least >> np.uint64(32)))
    at, h = (np.concatenate([np.zeros(0, np.int64), *(x[k].astype(np.int64) for x in found)]) for k in (0, 1))
    if len(at):
        # Of equal hashes, as in a run of one character, one in a window is enough.
        first = np.append(True, h[1:] != h[:-1])
        run = np.cumsum(first)
        offset = (at - at[first][run - 1]) // WINDOW
        at = at[np.append(True, (run[1:] != run[:-1]) | (offset[1:] != offset[:-1]))]
    return np.unique(np.concatenate([at + 1, ends]))


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """For texts in UTF-8: the text of each span, its code-point start and end, and its bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    raw, ends = b"".join(texts), np.cumsum(sizes)
    if not raw:
        none = np.zeros(0, np.int64)
        return none, none, none, []
    values = np.frombuffer(raw, np.uint8)
    at = cuts(values, ends[sizes > 0])
    owner = np.searchsorted(ends, at, side="left")
    begin = np.concatenate(([0], at[:-1]))
    # From each cut to the first cut at least MIN_SPAN bytes on, if the text has one.
    stop = np.searchsorted(at, begin + MIN_SPAN, side="left")
    use = np.flatnonzero(stop < len(at))
    use = use[owner[stop[use]] == owner[use]]
    # And from the last of these cuts to the end of the text.
    final = use[np.append(owner[use[1:]] != owner[use[:-1]], True)] if len(use) else use
    end = np.searchsorted(at, ends[owner[final]], side="left")
    more = end != stop[final]
    use, stop = np.concatenate([use, final[more]]), np.concatenate([stop[use], end[more]])
    leads = np.concatenate(([0], np.cumsum((values & 0xC0) != 0x80)))
    base = leads[(ends - sizes)[owner[use]]]
    a, b = begin[use], at[stop]
    return owner[use], leads[a] - base, leads[b] - base, [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):  # noqa: B905
            part = batch.slice(lo, hi - lo)
            texts = [t or b"" for t in part["text"].cast(pa.binary()).to_pylist()]
            owner, start, end, pieces = spans(texts)
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), np.int64).reshape(-1, 2)
            columns = [*map(pa.array, digests.T), part["doc_id"].take(pa.array(owner)), pa.array((start << LENGTH_BITS) | (end - start))]
            yield pa.RecordBatch.from_arrays(columns, schema=_SPANS)


def _merged(start: np.ndarray, end: np.ndarray) -> list[dict]:
    """Runs of at least MIN_RUN of overlapping or touching ranges."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    last = np.append(first[1:], len(start)) - 1
    return [{"start": s, "end": e} for s, e in zip(start[first].tolist(), end[last].tolist(), strict=True) if e - s >= MIN_RUN]


RUNS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(T.StructType([T.StructField("repeats", RUNS), T.StructField("removed", RUNS)]))
def _runs(start: pd.Series, end: pd.Series, later: pd.Series) -> pd.DataFrame:
    repeats, removed = [], []
    for s, e, m in zip(start, end, later, strict=True):
        s, e, m = np.asarray(s, np.int64), np.asarray(e, np.int64), np.asarray(m, bool)
        repeats.append(_merged(s, e))
        removed.append(_merged(s[m], e[m]))
    return pd.DataFrame({"repeats": repeats, "removed": removed})


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, repeats, removed (arrays of start, end) of the documents that have any."""
    rows = bounded(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Cut twice, once to count and once to look up: that costs less than to keep the spans of all texts.
    found = rows.mapInArrow(_span_rows, "key long, key2 long, doc_id long, at long")
    # Written, so that the join below has a shuffle on either side and a digest of very many documents can be split.
    shared = stored(found.groupBy("key", "key2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key", "key2", "lo"), "shared-spans")
    start = F.shiftright("at", LENGTH_BITS)
    span = F.struct(start.cast("int").alias("start"), (start + F.col("at").bitwiseAND(F.lit((1 << LENGTH_BITS) - 1))).cast("int").alias("end"), (F.col("doc_id") > F.col("lo")).alias("later"))
    hits = found.join(shared, ["key", "key2"]).select("doc_id", span.alias("s"))
    each = hits.groupBy("doc_id").agg(F.collect_set("s").alias("s"))
    runs = each.select("doc_id", _runs("s.start", "s.end", "s.later").alias("r")).select("doc_id", "r.*")
    return runs.where(F.size("repeats") > 0)


def _total(runs: str) -> F.Column:
    return F.coalesce(F.aggregate(runs, F.lit(0), lambda n, x: n + x["end"] - x["start"]), F.lit(0)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """A row for every row of ``docs``: doc_id, n_repeats, repeated_chars, removed_chars, repeats, removed (start:end lists)."""
    found = repeats(docs)
    listed = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"], x["end"])), ","), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.size("repeats"), F.lit(0)).cast("long").alias("n_repeats"), _total("repeats").alias("repeated_chars"), _total("removed").alias("removed_chars"), listed("repeats").alias("repeats"), listed("removed").alias("removed"))


@F.pandas_udf(T.StringType())
def _cut(text: pd.Series, removed: pd.Series) -> pd.Series:
    out = []
    for x, runs in zip(text, removed, strict=True):
        if x is not None and runs is not None and len(runs):
            edges = [0, *(e for r in runs for e in (r["start"], r["end"])), len(x)]
            x = "".join(x[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
        out.append(x)
    return pd.Series(out, dtype=object)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with later occurrences of repeats cut from the texts; all rows and columns are kept."""
    of, removed = unused(docs, "_of"), unused(docs, "_removed")
    found = repeats(docs).select(F.col("doc_id").alias(of), F.col("removed").alias(removed))
    joined = docs.join(found, docs["doc_id"].cast("long") == F.col(of), "left")
    return joined.withColumn("text", _cut("text", removed)).drop(of, removed)
