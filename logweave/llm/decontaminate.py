"""Benchmark decontamination with an Aho-Corasick automaton (operator 3).

Texts and items are normalised alike: A-Z lower-cased, words are runs of digits, letters a-z and all
code points from U+0080, everything else separates. A window is ten consecutive words of an item, or a
whole item of fewer. One automaton over all windows scans each normalised text once; a hit is mapped to
the words it covers and these to offsets in the original.

The automaton is broadcast. Its size is checked: the items are dealt by hash into slices of about
``SLICE_BYTES`` of text (an item is in one slice whole). Where the benchmark has more than one, texts are written
once with a row number and scanned slice by slice, a job each; what is hit is written, and put together by row
number at the end. So driver and workers hold one slice at a time, however large the benchmark is.

A null or empty text has no words and no hits; an item without words has no window; items that repeat a
text are each reported, items that repeat an id count once; the text of an item with a null item_id is
looked for like any other, but the item is not among those listed. Repeated
documents are each reported; a null doc_id is kept. Other columns are ignored by ``scan`` and kept by
``drop_contaminated``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, fresh_dir, held, stored, unused

WINDOW = 10
#: Items whose text has together at most so many characters share an automaton (about 100 bytes of memory for each).
SLICE_BYTES = 2_000_000

# Bytes of UTF-8: all from 0x80 belong to words, so words can be cut from the bytes.
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
TO_WORDS = bytes(c if c >= 0x80 or c in _WORD else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

Items = list[tuple[str | None, str]]


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split() if text else []


def build(items: Items):
    """The automaton over all windows; a match gives (length, words, item ids). None without windows."""
    import ahocorasick

    windows: dict[bytes, tuple[int, set[str]]] = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
            piece = w[i : i + WINDOW]
            windows.setdefault(b" " + b" ".join(piece) + b" ", (len(piece), set()))[1].update(() if item_id is None else (item_id,))
    if not windows:
        return None
    found = ahocorasick.Automaton()
    for key, (n, ids) in windows.items():
        found.add_word(key.decode("latin-1"), (len(key), n, sorted(ids)))
    found.make_automaton()
    return found


def hits(automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, ranges of hit words (ends exclusive, ascending, apart), items that occur."""
    w = words(text)
    if not w or automaton is None:
        return len(w), [], set()
    line = b" " + b" ".join(w) + b" "
    found, items = [], set()
    for end, (size, n, ids) in automaton.iter(line.decode("latin-1")):
        found.append((end - size + 1, n))
        items.update(ids)
    if not found:
        return len(w), [], items
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    ranges: list[tuple[int, int]] = []
    for first, n in sorted(zip(np.searchsorted(blanks, [s for s, _ in found]).tolist(), (n for _, n in found), strict=True)):
        if ranges and first <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(ranges[-1][1], first + n))
        else:
            ranges.append((first, first + n))
    return len(w), ranges, items


def in_original(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the text of ranges of words."""
    at = [m.span() for m in ORIGINAL_WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


_RANGE = pa.struct([(c, pa.int32()) for c in ("a", "b", "start", "end")])
_SCAN = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("ranges", pa.list_(_RANGE)), ("items", pa.list_(pa.string()))])
SCAN = "row long, doc_id long, n_words long, ranges array<struct<a:int,b:int,start:int,end:int>>, items array<string>"


def _scanner(shared, every: bool):
    """Rows (row, doc_id, text) with their ranges of hit words, where these stand in the text, and the items; ``every`` row or those with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.automaton()
        for batch in batches:
            at, counts, ranges, items = [], [], [], []
            for k, text in enumerate(batch["text"].to_pylist()):
                n, found, ids = hits(automaton, text)
                if every or found:
                    at.append(k)
                    counts.append(n)
                    spans = in_original(text, found) if found else []
                    ranges.append([{"a": a, "b": b, "start": s, "end": e} for (a, b), (s, e) in zip(found, spans, strict=True)])
                    items.append(sorted(ids))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["row"].take(at), batch["doc_id"].take(at), pa.array(counts, pa.int64()), pa.array(ranges, pa.list_(_RANGE)), pa.array(items, pa.list_(pa.string()))], schema=_SCAN)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of all slices, merged where they touch."""
    for batch in batches:
        out = []
        for ranges in batch["ranges"].to_pylist():
            merged: list[dict] = []
            for r in sorted(ranges, key=lambda r: (r["a"], r["b"])):
                if merged and r["a"] <= merged[-1]["b"]:
                    merged[-1] |= {c: max(merged[-1][c], r[c]) for c in ("b", "end")}
                else:
                    merged.append(r)
            out.append(merged)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("row", "doc_id", "n_words")), pa.array(out, pa.list_(_RANGE)), batch["items"]], schema=_SCAN)


class _Slice:
    """Items broadcast to the tasks, and a name under which a worker keeps the automaton it built from them."""

    def __init__(self, spark, items: Items):
        self.items = spark.sparkContext.broadcast(items)
        self.id = uuid.uuid4().hex

    def automaton(self):
        built = held("decontaminate")
        if self.id not in built:
            built.clear()
            built[self.id] = build(self.items.value)
        return built[self.id]


def _sliced(benchmark: DataFrame) -> tuple[int, Callable[[int], _Slice]]:
    """The number of slices, and a function that takes up one of them."""
    spark = benchmark.sparkSession
    items = bounded(benchmark).where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    n = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // SLICE_BYTES + 1
    path = fresh_dir(spark, "benchmark-slices")
    if n > 1:
        dealt = items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        dealt.repartition("slice").write.partitionBy("slice").parquet(path)

    def one(k: int) -> _Slice:
        own = items if n == 1 else spark.read.schema("item_id string, text string, slice bigint").parquet(path).where(F.col("slice") == k)
        return _Slice(spark, sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda x: (x[0] or "", x[1])))

    return n, one


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids that occur, ascending), spans (original offsets of hit runs)."""
    n, taken = _sliced(benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if n == 1:
        found = rows.withColumn("row", F.lit(0).cast("long")).mapInArrow(_scanner(taken(0), True), SCAN)
    else:
        rows, path = stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-texts"), fresh_dir(docs.sparkSession, "hits")
        for k in range(n):  # the first gives every row, the others those they hit
            part = taken(k)
            rows.mapInArrow(_scanner(part, k == 0), SCAN).write.mode("append").parquet(path)
            part.items.destroy()
        told = [F.flatten(F.collect_list(c)).alias(c) for c in ("ranges", "items")]
        found = docs.sparkSession.read.schema(SCAN).parquet(path).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *told)
        found = found.withColumn("items", F.array_sort(F.array_distinct("items"))).select("row", "doc_id", "n_words", "ranges", "items").mapInArrow(_joined, SCAN)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda total, r: total + (r["b"] - r["a"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", F.transform("ranges", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return scan(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans")
    )


def _is_clean(shared: _Slice):
    def clean(text: pd.Series) -> pd.Series:
        automaton = shared.automaton()
        return pd.Series([not hits(automaton, x)[1] for x in text], dtype=bool)

    return F.pandas_udf(clean, T.BooleanType())


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no window occurs, with all their columns."""
    n, taken = _sliced(benchmark)
    if n == 1:
        return docs.where(_is_clean(taken(0))("text"))
    row, spark = unused(docs, "_row"), docs.sparkSession
    rows, path = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-texts"), fresh_dir(spark, "hits")
    for k in range(n):
        part = taken(k)
        rows.where(~_is_clean(part)("text")).select(row).write.mode("append").parquet(path)
        part.items.destroy()
    return rows.join(spark.read.schema(f"{row} long").parquet(path), row, "left_anti").select(*docs.columns)
