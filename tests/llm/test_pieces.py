import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from logweave.llm import pieces

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["a", "Hello  world ▁x ", " lead", "\n\n a\tb", "漢字 👩‍💻 ￾ z", " ", "   ", "ünïcödé " * 30, "x" * 3000, "12.5% (off)  --  yes", "\x00\x01"]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(PATH)


def plain(model, text):
    """Best score by a direct dynamic program over all pieces, without units or an automaton."""
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    low = min(scores.values()) - 10
    s = " " + text
    t = s.replace("▁", "￾").replace(" ", "▁")
    best = [0.0] + [-float("inf")] * len(t)
    for e in range(1, len(t) + 1):
        for n in range(1, min(e, 24) + 1):
            if (p := scores.get(t[e - n : e])) is not None:
                best[e] = max(best[e], best[e - n] + p)
        if best[e] == -float("inf"):
            best[e] = best[e - 1] + low * len(s[e - 1].encode())
    return best[-1], scores, low


def test_ids_of_the_library(codec):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).to_pylist()]
    rnd = random.Random(5)
    odd = [chr(rnd.choice((rnd.randrange(32, 127), rnd.randrange(0xA0, 0x500), rnd.randrange(0x3000, 0x9000)))) for _ in range(300)]
    texts += ["".join(rnd.choice("aeinrst hlo" if k % 2 else [*odd, *"aaaabbb   ..--'\n\t0011"]) for _ in range(rnd.randrange(1, 40))) for k in range(3000)]
    texts += [t for t in TEXTS if pieces.MARK not in t] + ["a" * 2000, "ab" * 1000, " " * 500]
    for text, want in zip(texts, model.encode(texts), strict=True):
        ids = codec.encode(text).tolist()
        assert ids == want and codec.decode(ids) == text


def test_best_paths_and_round_trip():
    """The search by sums of scores, as for a unigram model."""
    codec = pieces.Codec(PATH, bpe=False)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(3)
    for text in [*TEXTS, *("".join(rnd.choice("ab et▁é\nzth") for _ in range(60)) for _ in range(40))]:
        ids = codec.encode(text).tolist()
        assert codec.decode(ids) == text
        want, scores, low = plain(model, text)
        got = sum(low if model.is_byte(i) else scores[model.id_to_piece(i)] for i in ids)
        assert got == pytest.approx(want), text


def test_report(spark, codec):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (51, ""), (0, "a"), (None, "b c"), (52, "long text " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(3)
    got = pieces.report(docs, PATH).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    want = sorted((str(d), len(codec.encode(t)), zlib.crc32(np.asarray(codec.encode(t), "<u4").tobytes())) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["n_pieces"], r["ids_crc32"]) for r in got) == want
    assert pieces.report(docs.limit(0), PATH).count() == 0
