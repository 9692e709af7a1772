import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import toxicity


def corpus(seed=1, n=300):
    """Texts, and labels that their words give away, with some noise; toxic texts are mostly of low quality."""
    rnd = random.Random(seed)
    vocab = [f"word{c}{i}" for i in range(60) for c in "ab"]
    rows, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.3
        quality = rnd.random() < (0.2 if toxic else 0.8)
        w = rnd.choices(vocab, k=rnd.randrange(10, 40)) + ["vile"] * (toxic and rnd.random() < 0.9) + ["Fine"] * (quality and rnd.random() < 0.8)
        rnd.shuffle(w)
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, int(quality), int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_like_a_plain_sequential_fit(spark):
    rows, labels = corpus()
    docs, marked = frames(spark, rows, labels)
    chain, held_out = toxicity.train(docs, marked)
    texts, ids = dict(rows), sorted(d for d, *_ in labels)
    y = np.array([lab for _, *lab in sorted(labels)], float)
    folds = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    fold = np.array([folds[d] for d in ids])
    words = {d: toxicity.features(texts[d]) for d in ids}
    counts = {}
    for d in ids:
        for w in words[d]:
            counts[w] = counts.get(w, 0) + 1
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= toxicity.MIN_DOCS))}
    assert chain.vocabulary == vocabulary
    x = [np.array([vocabulary[w] for w in sorted(words[d]) if w in vocabulary], np.int64) for d in ids]
    before = np.zeros((len(ids), 0))
    for k in range(2):
        out = np.zeros(len(ids))
        for f in range(toxicity.FOLDS):
            rest = [i for i in range(len(ids)) if fold[i] != f]
            model = toxicity.fit(*toxicity.flattened([x[i] for i in rest]), before[rest], y[rest, k], len(vocabulary))
            mine = np.flatnonzero(fold == f)
            out[mine] = model.predict(*toxicity.flattened([x[i] for i in mine]), before[mine])
        final = toxicity.fit(*toxicity.flattened(x), before, y[:, k], len(vocabulary))
        assert chain.models[k].weights == pytest.approx(final.weights, abs=1e-7) and chain.models[k].earlier == pytest.approx(final.earlier, abs=1e-7)
        before = np.column_stack([before, out])  # the next model learns from what was predicted of unseen folds
    told = {r["doc_id"]: r["p"] for r in held_out.collect()}
    assert np.array([told[d] for d in ids]) == pytest.approx(before, abs=1e-7)
    assert chain.models[1].earlier[0] < 0  # good texts are seldom toxic
    toxic, p = y[:, 1] == 1, before[:, 1]
    assert (p[toxic][:, None] > p[~toxic]).mean() > 0.9


def test_fit_in_parts_is_fit_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    lists = [np.unique(rng.integers(0, 50, rng.integers(0, 12))) for _ in range(90)]
    rows = toxicity.flattened(lists)
    y, before = np.array([float(5 in r) for r in lists]), rng.random((90, 1))
    whole = toxicity.fit(*rows, before, y, 50)
    monkeypatch.setattr(toxicity, "CHUNK", 17)
    parts = toxicity.fit(*rows, before, y, 50)
    assert parts.weights == pytest.approx(whole.weights, abs=1e-9) and parts.bias == pytest.approx(whole.bias)
    assert ((whole.predict(*rows, before) > 0.5) == (y == 1)).mean() > 0.95


def test_edges_of_the_input(spark):
    rows, labels = corpus(n=120)
    docs, marked = frames(spark, [*rows, (None, "vile vile"), (500, None), (501, ""), (3, rows[3][1]), (502, "vile " * 50_000)], [*labels, (1, None, 1), (None, 1, 1), (labels[0][0], 0, 0), (9999, 1, 1)])
    docs = docs.withColumn("toxic", F.lit(7)).withColumn("p", F.lit("x"))
    got = toxicity.score(docs, marked).collect()
    assert len(got) == 125 and all(0 <= r["p_toxic"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["toxic"] and by[502]["toxic"] and by[500][1:] == by[501][1:]
    kept = toxicity.drop_toxic(docs, marked)
    assert kept.columns == docs.columns and kept.count() == sum(not r["toxic"] for r in got)
    assert not any(r["toxic"] or r["p_toxic"] for r in toxicity.score(docs, marked.limit(0)).collect())
    assert toxicity.score(docs.limit(0), marked).count() == 0


def test_the_least_text_of_a_repeated_id_is_learnt_from(spark):
    rows, labels = corpus(n=80)
    docs, marked = frames(spark, rows, labels)
    more = docs.unionByName(docs.withColumn("text", F.concat(F.lit("~ vile "), "text")))
    want = toxicity.train(docs, marked)[0].models
    for some in (more, more.orderBy(F.desc("text")).repartition(3)):
        got = toxicity.train(some, marked)[0].models
        assert [m.bias for m in got] == pytest.approx([m.bias for m in want])
