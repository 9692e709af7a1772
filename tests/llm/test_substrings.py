import random

import numpy as np
from pyspark.sql import functions as F

from logweave.llm import substrings


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnopé") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def test_planted_passages(spark):
    rnd = random.Random(7)
    passages = [sentence(rnd, 55) for _ in range(12)]
    rows, want = [], set()
    for i in range(240):
        text = sentence(rnd, rnd.randrange(20, 200))
        if i % 4 == 0:
            text = text + "\n" + passages[i // 4 % 12] + " " + sentence(rnd, 30)
            want.add(i)
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).repartition(4)
    got = {r["doc_id"]: r for r in substrings.report(docs).collect()}
    assert len(got) == 240
    flagged = {d for d, r in got.items() if r["n_repeats"]}
    assert flagged == want
    texts = dict(rows)
    for d in flagged:
        for part in filter(None, got[d]["repeats"].split(",")):
            s, e = map(int, part.split(":"))
            assert sum(texts[d][s:e] in t for t in texts.values()) >= 2  # a true repeat, with true offsets
    assert all(got[d]["removed_chars"] == 0 for d in range(0, 48, 4))  # first occurrences stay
    named = docs.withColumns({"_of": F.lit("a"), "_Removed": F.col("doc_id") + 1})
    cut = substrings.without_repeats(named)
    assert cut.columns == named.columns and cut.where("_of = 'a' and _Removed = doc_id + 1").count() == 240
    kept = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert all(len(texts[d]) - len(kept[d]) == r["removed_chars"] for d, r in got.items())
    assert sum(sum(p[60:-60] in t for t in kept.values()) for p in passages) <= 12 + 2


def plain_cuts(raw):
    """After the byte of the least hash of each window; the hash of the last bytes, shifted by their age."""
    h = []
    for v in raw:
        x = (v + 1) * 0x9E3779B1 & 0xFFFFFFFF
        x = (x ^ (x >> 15)) * 0x85EBCA77 & 0xFFFFFFFF
        h.append(x)
    gear = [sum(h[i - k] << k for k in range(min(i + 1, substrings.GEAR))) & 0xFFFFFFFF for i in range(len(h))]
    w = substrings.WINDOW
    return sorted({min(range(i, i + w), key=lambda k: (gear[k], k)) + 1 for i in range(len(h) - w + 1)} | {len(raw)})


def plain_runs(texts):
    """Runs of repeated spans of each document, from the definition."""
    spans = {}
    for d, text in texts.items():
        raw = text.encode()
        at = [0, *plain_cuts(raw)] if raw else []
        lead = [len(raw[:x].decode("utf-8", "ignore")) if x == len(raw) or raw[x] & 0xC0 != 0x80 else len(raw[:x].decode("utf-8", "ignore")) + 1 for x in at]
        for i, a in enumerate(at[:-1]):
            j = next((k for k in range(i + 1, len(at)) if at[k] - a >= substrings.MIN_SPAN), None)
            if j is not None:
                spans.setdefault(raw[a : at[j]], set()).add((d, lead[i], lead[j]))
                last = (i, j)
        if at and at[-1] >= substrings.MIN_SPAN and last[1] != len(at) - 1:
            spans.setdefault(raw[at[last[0]] :], set()).add((d, lead[last[0]], lead[-1]))
    found = {d: [] for d in texts}
    for where in spans.values():
        if len({d for d, _, _ in where}) > 1:
            for d, s, e in where:
                found[d].append((s, e))
    out = {}
    for d, ranges in found.items():
        runs = []
        for s, e in sorted(ranges):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        out[d] = ",".join(f"{s}:{e}" for s, e in runs if e - s >= substrings.MIN_RUN)
    return out


def test_cuts_like_the_definition(monkeypatch):
    rnd = random.Random(11)
    texts = [sentence(rnd, rnd.randrange(0, 120)).encode() for _ in range(30)]
    texts = [t for t in texts if t]
    for step in (1 << 20, 700):
        monkeypatch.setattr(substrings, "STEP", step)
        ends = np.cumsum([len(t) for t in texts])
        got = substrings.cuts(np.frombuffer(b"".join(texts), np.uint8), ends).tolist()
        assert got == sorted(a + c for t, a in zip(texts, (ends - [len(t) for t in texts]).tolist(), strict=True) for c in plain_cuts(t))


def test_repeats_like_the_definition(spark):
    rnd = random.Random(12)
    shared = [sentence(rnd, rnd.randrange(5, 60)) for _ in range(8)]
    texts = {i: " ".join(sentence(rnd, rnd.randrange(0, 40)) if rnd.random() < 0.6 else rnd.choice(shared) for _ in range(rnd.randrange(0, 5))) for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["repeats"] for r in substrings.report(docs).collect()} == plain_runs(texts)


def test_short_words_are_found_too(spark):
    """Passages of 51 words of two to four letters, at any place of longer texts."""
    rnd = random.Random(13)
    short = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 5))) for _ in range(n))
    passages = [short(51) for _ in range(60)]
    rows = [(i, f"{short(rnd.randrange(1, 90))} {passages[i % 60]} {short(rnd.randrange(1, 90))}") for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert substrings.report(docs).where("n_repeats = 0").count() == 0


def test_insertions_move_few_spans():
    rnd = random.Random(8)
    text = sentence(rnd, 3000)
    other = text[:5000] + " inserted " + text[5000:9000] + text[9003:]
    a, b = (set(substrings.spans([t.encode()])[3]) for t in (text, other))
    assert len(a - b) <= 8


def test_edges_of_the_input(spark):
    same = "all of one text that stands in two documents, long enough to be seen as a repeat of some length " * 3
    rows = [(1, same), (2, same), (3, None), (4, ""), (5, "short"), (None, same), (6, "x" * 300_000), (7, "x" * 300_000), (8, "own " + same[::-1]), (8, "own " + same[::-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["repeated_chars"], r["removed_chars"]) for r in substrings.report(docs).collect()), key=str)
    n = len(same)
    assert got == sorted([(1, n, 0), (2, n, n), (3, 0, 0), (4, 0, 0), (5, 0, 0), (None, 0, 0), (6, 300000, 0), (7, 300000, 300000), (8, 0, 0), (8, 0, 0)], key=str)
    assert substrings.report(docs.limit(0)).count() == 0
