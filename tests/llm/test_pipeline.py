import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from test_decontaminate import plain as plain_leaks
from test_jaccard import plain as plain_groups
from test_pii import plain as plain_pii
from test_toxicity import corpus

import corpus_pipeline
from logweave.llm import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, folder):
    """Documents with labelled toxic ones, near copies, leaked benchmark items and personal data."""
    rnd = random.Random(4)
    rows, labels = corpus(n=150)
    say = lambda n: " ".join("".join(rnd.choice("abcdefghijklmn") for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    items = [(i, say(14)) for i in range(6)]
    base = [say(60) for _ in range(10)]
    for i in range(60):
        w = base[i % 10].split()
        w[rnd.randrange(60)] = say(1)
        rows.append((1000 + i, " ".join(w) if i % 4 else base[i % 10]))
    rows += [(2000 + i, f"{say(20)} {items[i % 6][1]} {say(5)}") for i in range(12)]
    rows += [(3000 + i, f"{say(9)} {rnd.choice(['a.b@c.org', '10.1.2.3', '+1 (269) 555-3296'])} {say(9)}") for i in range(12)]
    rows += [(4000, None), (4001, ""), (4002, "one two"), (4003, "one two")]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def redacted(text):
    out, at = [], 0
    for kind, s, e in plain_pii(text):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_run_like_the_stages_in_plain(spark, tmp_path):
    folder = str(tmp_path)
    docs, items = tables(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "personal_data", "sentencepiece"]
    marked = spark.read.parquet(f"{folder}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.score(docs, marked).where("toxic").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.where("text is not null").collect() if r["doc_id"] not in toxic) + [(4000, None)]
    assert 10 < len(toxic) < 100
    group = {d: c for d, _, c in plain_groups(rows)}
    rows = [(d, t) for d, t in rows if group[d] == d]
    leaked = {r[0] for r in plain_leaks(rows, items) if r[-1]}
    assert leaked == set(range(2000, 2012))
    rows = [(d, redacted(t) if t else t) for d, t in rows if d not in leaked]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d, t in rows:
        ids = model.encode(t or "")
        want.append((d, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), True))
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(want)


def test_stages_keep_columns_and_take_no_rows(spark, tmp_path):
    docs, _ = tables(spark, str(tmp_path))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "sentencepiece" or out.columns == COLUMNS)
