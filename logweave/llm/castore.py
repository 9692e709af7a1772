"""Token ids in a content-addressed store (operator 7).

``write_store`` encodes every document, cuts each id stream into chunks at places that a gear rolling
hash picks from the ids alone, and writes

* ``chunks/``   digest, n_ids, payload: every distinct chunk once,
* ``recipes/``  doc_id, start, n_tokens, root, chunks: the digests that make up a document, ascending
  by doc_id, with ``start`` the number of ids before it and ``root`` the Merkle root of its digests,
* ``manifest/`` part, first_start, n_docs, n_tokens, root: the Merkle root of each run of recipes.

``verify_store`` reads the files back. Each payload is hashed again against its digest, the CRC-32 of
every chunk is combined into that of the document (CRC-32 is linear, so payloads need not be moved a
second time), and the Merkle roots are computed anew. ``read_ids`` rebuilds the id streams themselves.

A null text is an empty one: the document is the end id alone. Rows that repeat a doc_id are documents
of their own, in order of root and then of row; a null doc_id comes first. An empty table gives an empty
store. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, fresh_dir, held, remove_dir, stored

END_ID = 0
#: A chunk ends where the top bits of the rolling hash are zero: every 2**CUT_BITS ids on average.
CUT_BITS = 9
MAX_CHUNK = 4096
#: Units in the newer half of the cache; when it is full it becomes the older half.
CACHE_UNITS = 350_000
#: Texts encoded at once, so that the units of a whole Arrow batch are not held together.
AT_ONCE = 2000


class Encoder:
    """A byte-level BPE tokenizer with a cache of what it gave for each unit of text.

    Its pre-tokenizer never joins text across a single space that stands before a non-space, nor across
    the places named in ``PARTS``, so a text is the concatenation of units between these; each unit is
    encoded by the tokenizer once for as long as it is cached. A text with other white space around a
    space, and any other kind of tokenizer, is encoded whole.
    """

    #: A space beside another white space, or at either end; or the mark of a unit that no space leads.
    AROUND = r"^ | $|\x01| [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    LETTER = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}\x{3a3}-\x{3ff}\x{400}-\x{481}"
    #: Between a single line break and a letter, and between a letter and punctuation.
    PARTS = (rf"([{LETTER}.,;:!?])\n([{LETTER}])", "\\1\n \x01\\2"), (rf"([{LETTER}])([.,;:!?])", "\\1 \x01\\2")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            pre = json.load(f).get("pre_tokenizer") or {}
        self.units = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
        size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.leads = np.array([(self.tok.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, units: list[str]) -> None:
        """Cache the ids of units; those that begin with the mark have no space before them."""
        width, led = self.dtype.itemsize, [u for u in units if u[:1] != "\x01"]
        for i in range(0, len(led), 2000):
            some = led[i : i + 2000]
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self.leads[ids])
            if len(at) == len(some):
                raw, at = ids.tobytes(), (at * width).tolist()
                self.cache.update(zip(some, [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)], strict=True))
            else:
                self.cache.update(zip(some, self.whole([" " + u for u in some]), strict=True))
        other = [u for u in units if u[:1] == "\x01"]
        self.cache.update(zip(other, self.whole([u[1:] for u in other]), strict=True))

    def known(self, units: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_UNITS:
            self.older, self.cache = self.cache, {}
        got = list(map(self.cache.get, units))
        missing = [i for i, ids in enumerate(got) if ids is None]
        if self.older:
            for i in missing:
                got[i] = self.cache[units[i]] = self.older.get(units[i])
            for i in (missing := [i for i in missing if got[i] is None]):
                del self.cache[units[i]]
        self.learn([units[i] for i in missing])
        for i in missing:
            got[i] = self.cache[units[i]]
        return got

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end_id``, and where each text's end."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.AROUND) if self.units else pa.array([True] * len(texts))
        parted = pc.if_else(whole, "", texts)
        for place, marked in self.PARTS:
            parted = pc.replace_substring_regex(parted, place, marked)
        lists = pc.split_pattern(parted, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        found = lists.flatten().dictionary_encode()
        unit = found.indices.to_numpy()
        # The first unit of a text has no space before it; a text to be taken whole is its own first unit.
        heads = pc.if_else(whole, texts, found.dictionary.take(pa.array(unit[offsets[:-1]])))
        led = np.ones(len(unit), bool)
        led[offsets[:-1]] = False
        needed = np.zeros(len(found.dictionary), bool)
        needed[unit[led]] = True
        known = self.known(found.dictionary.filter(pa.array(needed)).to_pylist())
        n = len(known)
        known += [*self.whole(heads.to_pylist()), np.array([end_id], self.dtype).tobytes()]
        row = (np.cumsum(needed) - 1)[unit]
        row[offsets[:-1]] = n + np.arange(len(texts))
        row = np.insert(row, offsets[1:], len(known) - 1)
        ends = np.cumsum(np.array(list(map(len, known)), np.int64)[row])[offsets[1:] + np.arange(len(texts))] // self.dtype.itemsize
        return np.frombuffer(b"".join(map(known.__getitem__, row.tolist())), self.dtype), ends


def encoder(path: str) -> Encoder:
    kept = held("castore")
    if path not in kept:
        kept.clear()
        kept[path] = Encoder(path)
    return kept[path]


def rolling(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Gear hash (32 bits) over the last 16 values of the same stream, by doubling; streams begin at ``starts``."""
    h = (values.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    for k in (1, 2, 4, 8):
        before = h[:-k] << np.uint32(k)
        other = (starts[:, None] + np.arange(-k, 0)).ravel()  # what would come from the stream before
        before[other[(other >= 0) & (other < len(before))]] = 0
        h[k:] += before
    return h


def cuts(ids: np.ndarray, ends: np.ndarray, bits: int = CUT_BITS, longest: int = MAX_CHUNK) -> np.ndarray:
    """Ends of the chunks of streams that lie one after the other and end at ``ends``."""
    at = np.flatnonzero(rolling(ids, np.concatenate(([0], ends[:-1]))) < np.uint32(1 << (32 - bits))) + 1
    at = np.unique(np.concatenate([at, ends]))
    at = at[at > 0]
    gaps = np.diff(at, prepend=0)
    long = np.flatnonzero(gaps > longest)  # a run without a cut is split at fixed steps from its start
    return np.unique(np.concatenate([at, *(np.arange(at[i] - gaps[i] + longest, at[i], longest) for i in long)]))


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up. Leaves and inner nodes are hashed apart."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


ROWS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_ids", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("payload", T.BinaryType()), T.StructField("doc_id", T.LongType()), T.StructField("uid", T.LongType())])
_ARROW = pa.schema([("kind", pa.string()), ("digest", pa.binary()), ("n_ids", pa.int64()), ("width", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("uid", pa.int64())])


def _store_rows(path: str, end_id: int):
    """Rows of kind chunks (each once for some texts; payload: its ids) and recipes (one for each document; digest: its root, payload: the digests of its chunks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = enc.dtype.itemsize
        for whole in batches:
            for batch in (whole.slice(i, AT_ONCE) for i in range(0, whole.num_rows, AT_ONCE)):
                ids, ends = enc.encode(batch["text"], end_id)
                at = cuts(ids, ends)
                raw, edges = ids.tobytes(), [0, *(at * width).tolist()]
                pieces = [raw[a:b] for a, b in zip(edges, edges[1:])]  # noqa: B905
                keys = list(map(digest, pieces))
                seen = dict(zip(keys, pieces, strict=True))
                n, none = len(seen), [None] * len(seen)
                yield pa.RecordBatch.from_arrays([pa.array(["chunks"] * n), pa.array(list(seen), pa.binary()), pa.array([len(p) // width for p in seen.values()], pa.int64()), pa.array([width] * n, pa.int32()), pa.array(list(seen.values()), pa.binary()), pa.array(none, pa.int64()), pa.array(none, pa.int64())], schema=_ARROW)
                first = np.searchsorted(at, ends, side="left") + 1
                lists = [keys[a:b] for a, b in zip([0, *first.tolist()], first.tolist())]  # noqa: B905
                n = len(lists)
                yield pa.RecordBatch.from_arrays([pa.array(["recipes"] * n), pa.array([merkle(x) for x in lists], pa.binary()), pa.array(np.diff(ends, prepend=0)), pa.array([width] * n, pa.int32()), pa.array([b"".join(x) for x in lists], pa.binary()), batch["doc_id"], batch["uid"]], schema=_ARROW)

    return run


@F.pandas_udf(T.BinaryType())
def _root(chunks: pd.Series) -> pd.Series:
    return pd.Series([merkle(list(x)) for x in chunks], dtype=object)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Write the store of ``docs(doc_id, text)`` under ``path``; see the module for the layout."""
    spark = docs.sparkSession
    rows = bounded(docs).select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("uid")).mapInArrow(_store_rows(tokenizer_path, end_id), ROWS)
    # Equal chunk rows meet by all their columns and are combined before the shuffle; a chunk that very many
    # documents share is one row of each slice of texts, and the documents that use it are rows of their own.
    rows.distinct().write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/raw")
    recipes = (
        spark.read.schema(ROWS)
        .parquet(f"{path}/raw")
        .where("kind = 'recipes'")
        .select("doc_id", "uid", F.col("n_ids").alias("n_tokens"), F.expr("transform(sequence(1, length(payload), 16), i -> substring(payload, i, 16))").alias("chunks"), F.col("digest").alias("root"))
        .orderBy("doc_id", "root", "uid")
        .withColumn("part", F.spark_partition_id())
    )
    ordered = stored(recipes, "recipes")
    # One row per written partition reaches the driver, whatever the number of documents.
    before, starts = 0, {}
    for r in sorted(ordered.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        starts[r["part"]], before = before, before + r["n"]
    base = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[F.col("part")] if starts else F.lit(0)
    run = Window.partitionBy("part").orderBy("doc_id", "root", "uid")
    recipes = ordered.select("part", "doc_id", (base + F.sum("n_tokens").over(run) - F.col("n_tokens")).cast("long").alias("start"), "n_tokens", "root", "chunks")
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest = recipes_of(spark, path).groupBy("part").agg(F.min("start").alias("first_start"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "root"))).alias("leaves"))
    manifest.select("part", "first_start", "n_docs", "n_tokens", _root(F.col("leaves.root")).alias("root")).write.parquet(f"{path}/manifest")
    remove_dir(spark, f"{path}/raw/kind=recipes")


RECIPES = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("root", T.BinaryType()), T.StructField("chunks", T.ArrayType(T.BinaryType()))])
CHUNKS = T.StructType([x for x in ROWS if x.name in ("digest", "n_ids", "width", "payload")])


def recipes_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def chunks_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{path}/raw").where("kind = 'chunks'").select(*CHUNKS.names)


# CRC-32 of a concatenation from those of its parts: appending k zero bytes is a linear map over GF(2).


@lru_cache(maxsize=1)
def _zero_maps() -> list[np.ndarray]:
    """For each b, four tables of 256 entries that append 2**b zero bytes to a CRC."""

    def tables(columns: np.ndarray) -> np.ndarray:
        byte = np.arange(256, dtype=np.uint32)
        out = np.zeros((4, 256), np.uint32)
        for bit in range(8):
            on = (byte >> np.uint32(bit)) & np.uint32(1)
            for k in range(4):
                out[k] ^= on * columns[8 * k + bit]
        return out

    def one(crc: np.uint32) -> int:
        c = int(crc)
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        return c

    columns = np.array([one(np.uint32(1 << i)) for i in range(32)], np.uint32)
    maps = []
    for _ in range(48):
        maps.append(tables(columns))
        columns = _through(maps[-1], columns)
    return maps


def _through(t: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return t[0][crc & 255] ^ t[1][(crc >> 8) & 255] ^ t[2][(crc >> 16) & 255] ^ t[3][crc >> 24]


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRCs after ``zeros`` more zero bytes each, without the pre- and post-conditioning."""
    crc, zeros = crc.astype(np.uint32), zeros.astype(np.int64)
    for b, t in enumerate(_zero_maps()):
        if not (zeros >> b).any():
            break
        on = (zeros >> b) & 1 == 1
        crc[on] = _through(t, crc[on])
    return crc


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = batch["payload"].to_pylist()
        ok = [digest(x) == key for x, key in zip(payloads, batch["digest"].to_pylist(), strict=True)]
        widths = set(batch["width"].to_pylist())
        if len(widths) == 1:  # a store has one width throughout
            wide, width = memoryview(np.frombuffer(b"".join(payloads), f"<u{min(widths)}").astype("<u4").tobytes()), min(widths)
            ends = (np.cumsum(list(map(len, payloads))) // width * 4).tolist()
            crc = [zlib.crc32(wide[a:b]) for a, b in zip([0, *ends], ends)]  # noqa: B905
        else:
            crc = [zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x, w in zip(payloads, batch["width"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["digest"], batch["n_ids"], pa.array(ok, pa.bool_()), pa.array(crc, pa.int64())], names=["digest", "n_ids", "ok", "crc"])


JOINED = T.StructType([T.StructField("crc", T.LongType()), T.StructField("root", T.BinaryType())])


@F.pandas_udf(JOINED)
def _joined(sizes: pd.Series, crcs: pd.Series, digests: pd.Series) -> pd.DataFrame:
    """CRC-32 and Merkle root of documents, each a list of chunks in order."""
    if not len(sizes):
        return pd.DataFrame({"crc": [], "root": []})
    count = sizes.map(len).to_numpy()
    ids = np.concatenate(sizes.to_list()).astype(np.int64)
    ends = np.cumsum(ids)
    last = np.cumsum(count) - 1
    after = np.repeat(ends[last], count) - ends
    crc = np.bitwise_xor.reduceat(shifted(np.concatenate(crcs.to_list()).astype(np.uint32), 4 * after), last - count + 1)
    return pd.DataFrame({"crc": crc.astype(np.int64), "root": [merkle(list(x)) for x in digests]})


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified: read from the files of the store alone.

    ``verified`` holds where every chunk is there once and hashes to its digest, the lengths add up and
    the document's and its part's Merkle roots agree with recipes and manifest.
    """
    chunks = chunks_of(spark, path).mapInArrow(_checked, "digest binary, n_ids long, ok boolean, crc long")
    recipes = recipes_of(spark, path)
    uses = recipes.select("start", F.posexplode("chunks").alias("pos", "digest"))
    parts = uses.join(chunks, "digest").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("pos", "n_ids", "crc", "ok", "digest"))).alias("parts"))
    docs = parts.select("start", F.expr("aggregate(parts.n_ids, 0L, (s, x) -> s + x)").alias("n"), F.forall("parts.ok", lambda x: x).alias("ok"), _joined("parts.n_ids", "parts.crc", "parts.digest").alias("got"))
    leaves = recipes.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("start", "root"))).alias("leaves")).select("part", _root(F.col("leaves.root")).alias("again"))
    runs = spark.read.parquet(f"{path}/manifest").select("part", F.col("root").alias("said")).join(leaves, "part").select("part", (F.col("said") == F.col("again")).alias("part_ok"))
    return (
        recipes.join(docs, "start", "left")
        .join(F.broadcast(runs), "part", "left")  # one row for each written partition
        .select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("got.crc").alias("ids_crc32"), F.coalesce(F.col("ok") & (F.col("got.root") == F.col("root")) & (F.col("n") == recipes["n_tokens"]) & F.col("part_ok"), F.lit(False)).alias("verified"))
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array of int): the streams rebuilt from chunks and recipes."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def unpack(parts: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([np.frombuffer(p["payload"], f"<u{p['width']}").astype(np.int32) for p in doc]) for doc in parts])

    recipes = recipes_of(spark, path)
    uses = recipes.select("doc_id", "start", F.posexplode("chunks").alias("pos", "digest"))
    whole = uses.join(chunks_of(spark, path), "digest").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("pos", "width", "payload"))).alias("parts"))
    return whole.select("doc_id", "start", unpack("parts").alias("ids"))


def store_and_verify(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write a store in the shared folder (or ``path``) and return what reading it back gives."""
    spark = docs.sparkSession
    path = path or fresh_dir(spark, "token-store")
    write_store(docs, path, tokenizer_path)
    return verify_store(spark, path)
