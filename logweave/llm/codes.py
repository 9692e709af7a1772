"""Compression of vectors to codes (operator 11): integer product quantisation over distinct parts.

Every component becomes ``floor(256 * x)`` and every vector is cut into equal consecutive parts. At each part
position equal parts are counted once: Lloyd's rounds run over these distinct parts with their weights, in
64-bit integers, and what the driver learns of a round is one sum and weight for each entry and component.
After the last round the distinct parts are assigned once more, and codes and errors are joined back to the
vectors by part.

Rows whose vector is null or holds a null, NaN or infinite component are left out, and so are vectors of a
length that is no positive multiple of ``PARTS`` or not the most frequent one (of equally frequent lengths the
longest counts). A codebook starts from the smallest ``ENTRIES`` different vec_ids, a null one after all others
and of rows that repeat a vec_id the one with the least vector; with fewer ids it has fewer entries. Rows that
repeat a vec_id are coded each. Null labels are one label. Components beyond ``LARGEST / 256`` raise an error, as
their squares would not be exact. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, maybe_broadcast, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Integers up to this size have squared distances that fit 64 bits, in parts of up to 256 components.
LARGEST = 1 << 26
#: Differences that are held at once.
AT_ONCE = 1 << 22

_SUMS = pa.schema([("pos", pa.int32()), ("entry", pa.int32()), ("weight", pa.decimal128(38)), ("sums", pa.list_(pa.decimal128(38)))])
_PLACED = pa.schema([("pos", pa.int32()), ("part", pa.list_(pa.int32())), ("entry", pa.int64()), ("err", pa.int64())])


def integer_parts(embeddings: DataFrame, parts: int = PARTS) -> DataFrame:
    """row, vec_id, label, parts: the vectors that are coded, as integers cut into parts; written once."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    too_large = F.raise_error(F.lit(f"a component is beyond {LARGEST // 256}"))
    whole = F.transform(v, lambda x: F.when(F.abs(x) <= LARGEST // 256, F.floor(x * 256).cast("int")).otherwise(too_large.cast("int")))
    rows = embeddings.where(v.isNotNull() & finite & (F.size(v) > 0) & (F.size(v) % parts == 0)).select("vec_id", "label", whole.alias("q"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "integers")
    common = rows.groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = common[0]["n"] // parts if common else 1
    cut = F.array(*[F.slice("q", p * width + 1, width) for p in range(parts)])
    return rows.where(F.size("q") == width * parts).select("row", "vec_id", "label", cut.alias("parts"))


def first_books(rows: DataFrame, entries: int = ENTRIES) -> list[np.ndarray]:
    """A codebook for each part position: the parts of the smallest vec_ids."""
    ids = [r["vec_id"] for r in rows.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    if not ids:
        return []
    known = [i for i in ids if i is not None]
    asked = F.col("vec_id").isin(known) if known else F.lit(False)
    asked = asked | F.col("vec_id").isNull() if len(known) < len(ids) else asked
    least = rows.where(asked).groupBy("vec_id").agg(F.min("parts").alias("parts")).orderBy(F.asc_nulls_last("vec_id")).collect()
    return [np.array([r["parts"][p] for r in least], np.int64) for p in range(len(least[0]["parts"]))]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row and its squared distance."""
    entry, err = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    step = max(1, AT_ONCE // max(1, book.size))
    for lo in range(0, len(x), step):
        d = ((x[lo : lo + step, None, :] - book[None]) ** 2).sum(axis=2)
        entry[lo : lo + step] = d.argmin(axis=1)
        err[lo : lo + step] = d.min(axis=1)
    return entry, err


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return batch["part"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def _by_position(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    pos = batch["pos"].to_numpy(zero_copy_only=False)
    for p in np.unique(pos).tolist():
        yield p, np.flatnonzero(pos == p)


def _summed(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in books]
        weights = [np.zeros(len(b), object) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            values, weight = _values(batch), batch["weight"].to_numpy(zero_copy_only=False)
            for p, at in _by_position(batch):
                x, w = values[at], weight[at]
                entry, _ = nearest(x, books[p])
                exact = np.int64 if int(w.sum()) * max(1, int(np.abs(x).max(initial=0))) < 1 << 62 else object
                add, count = np.zeros(books[p].shape, exact), np.zeros(len(books[p]), np.int64)
                np.add.at(add, entry, w.astype(exact)[:, None] * x.astype(exact))
                np.add.at(count, entry, w)
                sums[p] = sums[p] + add.astype(object)
                weights[p] = weights[p] + count.astype(object)
        for p, (s, w) in enumerate(zip(sums, weights, strict=True)):
            used = [e for e in range(len(w)) if w[e]]
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array([Decimal(int(w[e])) for e in used], pa.decimal128(38)), pa.array([[Decimal(int(c)) for c in s[e]] for e in used], _SUMS.field("sums").type)], schema=_SUMS)

    return run


def moved(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round; an entry that no part is nearest to stays."""
    told = distinct.mapInArrow(_summed(books), "pos int, entry int, weight decimal(38,0), sums array<decimal(38,0)>")
    each = told.select("pos", "entry", "weight", F.posexplode("sums").alias("at", "x")).groupBy("pos", "entry", "at").agg(F.sum("x").alias("x"), F.sum("weight").alias("n"))
    out = [b.copy() for b in books]
    for r in each.collect():  # ENTRIES rows for each component of a vector
        out[r["pos"]][r["entry"], r["at"]] = int(r["x"]) // int(r["n"])
    return out


def _placed(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _values(batch)
            entry, err = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for p, at in _by_position(batch):
                entry[at], err[at] = nearest(values[at], books[p])
            yield pa.RecordBatch.from_arrays([batch["pos"], batch["part"], pa.array(entry), pa.array(err)], schema=_PLACED)

    return run


def train(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(pos, part, weight) for every distinct part of ``rows``, and the codebooks after ``rounds``."""
    distinct = rows.select(F.posexplode("parts").alias("pos", "part")).groupBy("pos", "part").agg(F.count("*").alias("weight"))
    distinct, books = stored(distinct, "distinct-parts"), first_books(rows, entries)
    for _ in range(rounds if books else 0):
        books = moved(distinct, books)
    return distinct, books


def encode(rows: DataFrame, distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error: distinct parts are placed, and entries and errors joined back by part."""
    placed = distinct.select("pos", "part").mapInArrow(_placed(books), "pos int, part array<int>, entry bigint, err bigint")
    n = distinct.count()
    placed = placed if n > BROADCAST_ROWS else F.broadcast(placed)  # counted; beyond that a skewed join is split
    each = rows.select("row", "vec_id", "label", F.posexplode("parts").alias("pos", "part")).join(placed, ["pos", "part"])
    coded = each.groupBy("row", "vec_id", "label").agg(F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("entries"), F.sum("err").alias("error"))
    digits = F.transform("entries", lambda e: F.lpad(F.lower(F.hex(e["entry"])), 2, "0"))
    return coded.select("vec_id", "label", F.array_join(digits, "").alias("code"), "error")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components of all entries, by position and entry."""
    told = hashlib.sha256()
    for k, book in enumerate(books):
        told.update((("," if k else "") + ",".join(map(str, book.ravel().tolist()))).encode())
    return told.hexdigest()


def compress(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector that is coded."""
    rows = integer_parts(embeddings)
    distinct, books = train(rows)
    if not books:
        return rows.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = stored(encode(rows, distinct, books), "codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    told = coded.join(maybe_broadcast(totals), F.col("label").eqNullSafe(F.col("of")))
    return told.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
