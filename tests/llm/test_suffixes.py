import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import suffixes as S


def plain(texts):
    """n_bytes, n_removed, n_spans, digest of each text by a table of all its windows."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(hash(r[i : i + S.LENGTH]) for r in raws for i in range(len(r) - S.LENGTH + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - S.LENGTH + 1):
            if seen[hash(r[i : i + S.LENGTH])] > 1:
                gone[i] += 1
                gone[min(i + S.LENGTH, len(r))] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def got(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def table(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return rows.withColumns({"row": F.lit(1), "raw": F.lit("x"), "digest": F.lit(2), "copies": F.lit(3), "n_bytes": F.lit(4)})


def made(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkä") for _ in range(rng.randrange(2, 9)))
    words = [word() for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(n) for n in (55, 62, 70, 75, 90, 160, 300)]
    texts = []
    for _ in range(60):
        parts = [text(rng.randrange(120)) for _ in range(3)]
        for p in rng.sample(passages, 2):
            lo, hi = sorted((rng.randrange(len(p)), rng.randrange(len(p)))) if rng.random() < 0.5 else (0, len(p))
            parts.insert(rng.randrange(len(parts)), p[lo:hi])
        texts.append(" ".join(parts))
    long = text(400)
    for _ in range(25):  # near copies
        w = long.split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    same = text(150)
    return [*texts, same, same, None, "", "short", "short", "z" * 399, "z" * 399, "y" * 900, "ab" * 700, long + long, "é" * 250, passages[0][:400] + "q", "w" + passages[0][:400]]


@pytest.mark.parametrize("class_rows", [S.CLASS_ROWS, 6, 0])
def test_like_all_windows(spark, class_rows):
    """Also where grams have too many anchors for a task: some, and all."""
    texts = made()
    want = [(i, *x) for i, x in enumerate(plain(texts))]
    assert sum(0 < w[2] < w[1] for w in want) > 30
    assert got(S.report(table(spark, texts).repartition(5), class_rows)) == want


@pytest.mark.parametrize("class_rows", [S.CLASS_ROWS, 0])
def test_rows_of_a_frequent_gram_are_spread(spark, monkeypatch, tmp_path, class_rows):
    """Anchors and blocks of a passage that stands in most texts do not meet in one task of a join."""
    paths = []
    monkeypatch.setattr(S, "HOT_ROWS", 50)
    monkeypatch.setattr(S, "fresh_dir", lambda _, name: paths.append(f"{tmp_path}/{len(paths)}-{name}") or paths[-1])
    monkeypatch.setattr(S, "stored", lambda df, name: S.stored_at(df, S.fresh_dir(None, name)))
    monkeypatch.setattr(S, "remove_dir", lambda *_: None)
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = some(600)
    texts = [*(f"{some(rng.randrange(300))}{passage}{some(300)}" for _ in range(400)), *(some(700) for _ in range(60))]
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as where tables are large
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        out = got(S.report(table(spark, texts), class_rows))
    finally:
        for key in conf:
            spark.conf.unset(key)
    assert out == [(i, *x) for i, x in enumerate(plain(texts))]
    for name, key in (("shared-anchors", "hash"), ("repeated-blocks", "core"))[: 2 - bool(class_rows)]:
        path = next(p for p in paths if p.endswith(f"-{name}"))
        rows = spark.read.parquet(path).groupBy(key, F.input_file_name()).count().collect()
        in_all = Counter()
        for r in rows:
            in_all[r[key]] += r["count"]
        most, n = in_all.most_common(1)[0]
        assert n >= 400 and max(r["count"] for r in rows if r[key] == most) < 0.6 * n


def test_many_ranges_and_runs(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE_ROWS", 40)
    texts = made(9)
    assert got(S.report(table(spark, texts).repartition(7))) == [(i, *x) for i, x in enumerate(plain(texts))]


def test_no_rows_and_repeated_ids(spark):
    assert got(S.report(table(spark, []))) == []
    a, b = "x1" * 300, "".join(map(str, range(300)))
    rows = spark.createDataFrame([(1, a), (1, b), (1, b), (None, b)], "doc_id long, text string")
    out = S.report(rows).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in out) == [(600, 600), (790, 790), (790, 790), (790, 790)]


def test_merge_of_front_coded_runs():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(300)]
    runs = [sorted(strings[k::7]) for k in range(7)] + [[]]
    coded = [S.front_coded(r) for r in runs]
    order = list(S.merged(coded))
    out = [runs[r][k] for r, k, _ in order]
    assert out == sorted(strings)
    assert [n for _, _, n in order] == [0, *(S.shared_bytes(a, b, 0) for a, b in zip(out, out[1:], strict=False))]


def test_anchors_of_equal_windows_agree():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 101, 3000).astype(np.uint8)
    both = np.concatenate([raw, rng.integers(97, 101, 500).astype(np.uint8), raw])
    owner, h, at, lo, hi = S.anchors(both, np.array([3000, len(both)]))
    cover = {(o, i): (a - i, x) for o, x, a, p, q in zip(owner.tolist(), h.tolist(), at.tolist(), lo.tolist(), hi.tolist(), strict=True) for i in range(p, q + 1)}
    assert len(cover) == 3000 - S.LENGTH + 1 + 3500 - S.LENGTH + 1
    assert all(cover[0, i] == cover[1, i + 500] for i in range(3000 - S.LENGTH + 1))
