import math
import random
from collections import Counter

import pytest

from logweave.llm import lmscore


def counted(split):
    """Words, words before others, and pairs of documents given as lists of words."""
    some = [["", *w] for w in split if w]
    return Counter(x for w in some for x in w[1:]), Counter(x for w in some for x in w[:-1]), Counter(p for w in some for p in zip(w, w[1:]))  # noqa: B905


def probability(model, a, b, size):
    word, context, pair = model
    alone = (word[b] + 0.5) / (sum(word.values()) + 0.5 * size)
    return 0.6 * pair[a, b] / context[a] + 0.4 * alone if context[a] else alone


def plain(rows, target_ids):
    """Losses of each document by models of the others that are held as a whole."""
    split = [((t or "").split(), d in target_ids) for d, t in rows]
    models = [counted(w for w, target in split if target), counted(w for w, _ in split)]
    size = len(models[1][0])
    out = []
    for (d, _), (w, target) in zip(rows, split, strict=True):
        losses = []
        for model, inside in zip(models, (target, True), strict=True):
            for whole, own in zip(model, counted([w]), strict=True):
                whole.subtract(own if inside else ())
            total = sum(model[0].values())
            loss = 0.0
            for a, b in zip(["", *w], w):  # noqa: B905
                alone = (model[0][b] + 0.5) / (total + 0.5 * size)
                loss -= math.log(0.6 * model[2][a, b] / model[1][a] + 0.4 * alone if model[1][a] else alone)
            for whole, own in zip(model, counted([w]), strict=True):
                whole.update(own if inside else ())
            losses.append(loss / len(w) if w else None)
        out.append((d, len(w), *losses))
    return out


def test_probabilities_sum_to_one():
    """Of the plain models that the operator is compared with, whatever the context."""
    rnd = random.Random(5)
    every = [[f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(30))] for _ in range(60)]
    words = {x for w in every for x in w}
    for model in (counted(every), counted(every[:7]), counted([])):
        for context in ["", *sorted(words)]:
            assert sum(probability(model, context, b, len(words)) for b in words) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("small", [False, True])
def test_counts_of_the_whole_corpus(spark, monkeypatch, small):
    """More words and pairs than any fixed table had, and a pair that stands in every document."""
    rnd = random.Random(3)
    rows = [(i, " ".join(["of the", *(f"w{rnd.randrange(400_000 if not small else 300)}" for _ in range(rnd.randrange(2000 if not small else 60)))])) for i in range(300)]
    rows += [(400, None), (401, ""), (5, rows[5][1]), (None, rows[6][1]), (402, "once")]
    targets = [(i,) for i in range(0, 300, 3)] + [(3,), (None,), (9999,)]
    if small:  # many blocks and parts
        for name, value in (("BLOCK_TOKENS", 500), ("PART_WORDS", 300), ("PART_TOKENS", 900)):
            monkeypatch.setattr(lmscore, name, value)
    docs, ids = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(targets, "doc_id long")
    got = lmscore.score(docs, ids).collect()
    want = plain(rows, {i for (i,) in targets if i is not None})
    key = lambda x: (x[0] is None, x[0], x[1])
    assert len(got) == len(want)
    for g, (d, n, target, background) in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == (d, n)
        assert g[2:4] == (pytest.approx(target, abs=2e-6), pytest.approx(background, abs=2e-6)) if n else g[2:] == (None, None, None)
    assert lmscore.score(docs.limit(0), ids).count() == 0
    assert lmscore.score(docs, ids.limit(0)).where("n_tokens > 0 and target_loss is null").count() == 0
