import random
import re

from pyspark.sql import functions as F

from logweave.llm import jaccard


def plain(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    smallest = {d: d for d, _ in rows}

    def root(d):
        while smallest[d] != d:
            d = smallest[d]
        return d

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if None not in (a, b) and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                lo, hi = sorted((root(a), root(b)))
                smallest[hi] = lo
    return sorted(((d, len(s), root(d) if d is not None else None) for (d, _), s in zip(rows, sets, strict=True)), key=str)


def corpus(seed, n=150):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "WORD", "Straße"]
    common = [rnd.choice(vocab) for _ in range(45)]
    rows, base = [], []
    for i in range(n):
        if base and rnd.random() < 0.65:
            w = list(rnd.choice(base[: 1 + len(base) // 3]))
            for _ in range(rnd.randrange(5)):
                k = rnd.randrange(len(w) + 1)
                w[k : k + rnd.randrange(3)] = [rnd.choice(vocab) for _ in range(rnd.randrange(3))]
        else:
            w = [rnd.choice(vocab) for _ in range(rnd.randrange(1, 120))]
            if rnd.random() < 0.4:
                w[5:5] = common
        base.append(w)
        rows.append((1000 - i, rnd.choice([" ", "\n", " \t"]).join(w)))
    return rows


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    for seed, pivots in ((1, 4096), (2, 25), (3, 0.5)):
        monkeypatch.setattr(jaccard, "PIVOTS", pivots)
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).repartition(3)
        assert got(jaccard.join(docs)) == plain(rows), seed


def test_edges_of_the_input(spark):
    long = " ".join(f"t{i}" for i in range(20000))
    rows = [(5, None), (6, ""), (7, " \n "), (8, "a b"), (3, "A B"), (9, "a b c"), (1, long), (2, long + " more"), (2, "other"), (None, "a b"), (4, long), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))
    assert got(jaccard.join(docs)) == plain(rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([5, 6, 7, 3, 9, 1, None], key=str)
    assert got(jaccard.join(docs.limit(0))) == []


def test_copies_do_not_multiply(spark):
    rows = [(i, "the same text in very many rows of one table " * 3) for i in range(3000)] + [(5000, "something else altogether here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.join(docs).collect()} == {0, 5000}
    assert jaccard.keep_one(docs).count() == 2


def test_one_row_of_a_repeated_id_stays_with_its_columns(spark):
    rows = [(1, "b x y", "u", "p"), (1, "a x y", "v", "q"), (1, None, "w", "r"), (2, "z", "x", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, again string, _AGAIN string")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[1], rows[3]]
