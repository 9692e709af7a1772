import json
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweave.llm import castore

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "a", "  two  spaces ", " lead", "tail ", "a\n \nb", "a \nb\t c\r\n d", "naïve 漢字 👩‍💻 x  y", "9" * 5000, "word " * 3000, "<|endoftext|> x<|endoftext|>y z", "it's  I'm　 ok \x1c x"]


def expected(rows):
    tok = Tokenizer.from_file(PATH)
    start, out = 0, []
    for doc_id, text in sorted(rows):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_matches_plain_encoding_and_verifies(spark, tmp_path):
    rows = [(3 * i % 41, x) for i, x in enumerate(ODD)] + [(100 + i, "shared text of many copies, " * 400) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunks", F.lit(1)).repartition(3)
    got = castore.store_and_verify(docs, PATH, f"file://{tmp_path}/s").collect()
    assert all(r["verified"] for r in got)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected(rows)
    assert castore.chunks_of(spark, f"file://{tmp_path}/s").groupBy("digest").count().where("count > 1").count() == 0
    ids = {r["doc_id"]: r["ids"] for r in castore.read_ids(spark, f"file://{tmp_path}/s").collect()}
    tok = Tokenizer.from_file(PATH)
    assert all(ids[i] == [*tok.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows)


def test_damage_shows(spark, tmp_path):
    path = f"{tmp_path}/s"
    castore.write_store(spark.createDataFrame([(1, "some text"), (2, "other text")], "doc_id long, text string"), path, PATH)
    rows = castore.chunks_of(spark, path).withColumn("payload", F.when(F.col("n_ids") == 3, F.lit(b"\1\0\2\0\3\0")).otherwise(F.col("payload"))).withColumns({"kind": F.lit("chunks"), "doc_id": F.lit(None).cast("long"), "uid": F.lit(None).cast("long"), "pos": F.lit(None).cast("int")}).collect()
    castore.remove_dir(spark, f"{path}/raw")
    spark.createDataFrame(rows, "digest binary, n_ids int, width int, payload binary, kind string, doc_id long, uid long, pos int").write.partitionBy("kind").parquet(f"{path}/raw")
    assert not any(r["verified"] for r in castore.verify_store(spark, path).collect())


def test_repeated_ids_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (1, "d")], "doc_id long, text string")
    got = sorted((r["start"], r["doc_id"]) for r in castore.store_and_verify(docs, PATH).collect())
    assert [d for _, d in got] == [None, 1, 1, 1]
    assert castore.store_and_verify(docs.limit(0), PATH).count() == 0


def test_insertion_keeps_later_chunks():
    ids = np.random.default_rng(1).integers(0, 50000, 20000)
    keys = lambda x: {castore.digest(p.astype("<u2").tobytes()) for p in np.split(x, castore.cuts(x, np.array([len(x)]))[:-1])}
    a, b = keys(ids), keys(np.insert(ids, 5000, [7, 8, 9]))
    assert len(a - b) <= 3 and len(b - a) <= 3
    assert max(np.diff(castore.cuts(np.zeros(20000, np.int64), np.array([20000])), prepend=0)) <= castore.MAX_CHUNK


def test_crc_of_a_concatenation():
    parts = [b"abc", b"", b"x" * 1000, bytes(range(256))]
    after = np.array([sum(map(len, parts[i + 1 :])) for i in range(4)])
    got = np.bitwise_xor.reduce(castore.shifted(np.array([zlib.crc32(p) for p in parts], np.uint32), after))
    assert got == zlib.crc32(b"".join(parts))
    assert json.dumps([castore.merkle([]).hex(), castore.merkle([b"a"]).hex()]) != ""
