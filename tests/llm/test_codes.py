import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from logweave.llm import codes


def plain(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error, label_error, digest by nested loops."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and len(v) and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in kept]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n)) // parts
    kept = [(i, [tuple(v[p * width : (p + 1) * width]) for p in range(parts)], label) for i, v, label in kept if len(v) == width * parts]
    last = lambda i: (i is None, i or 0)
    first = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    starts = [first[i] for i in sorted(first, key=last)[:entries]]
    books = [[s[p] for s in starts] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [tuple(sum(c) // len(mine[e]) for c in zip(*mine[e], strict=True)) if e in mine else c for e, c in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    told = [(i, [near(v[p], books[p]) for p in range(parts)], label) for i, v, label in kept]
    each = [(i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), label) for i, n, label in told]
    totals = {}
    for *_, err, label in each:
        totals[label] = totals.get(label, 0) + err
    return sorted(((i, c, err, totals[label], digest) for i, c, err, label in each), key=str)


def got(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"row": F.lit(1), "parts": F.lit("x"), "code": F.lit(2), "n": F.lit(3)})


def test_like_the_plain_rounds(spark):
    rng = random.Random(1)
    rows = [(1000 - i, [rng.choice([0.0, rng.gauss(0, 0.3)]) for _ in range(32)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(3000 + i, rows[7][1], 1) for i in range(80)]  # a very common vector
    rows += [(1, None, 1), (2, [], 1), (3, [float("nan")] * 32, 1), (4, [None] * 32, 1), (5, [float("inf")] * 32, 2), (6, [0.5] * 16, 2), (7, [0.5] * 31, 2), (None, rows[3][1], None), (900, rows[4][1], 2), (900, rows[4][1], 2)]
    assert got(codes.compress(table(spark, rows).repartition(5))) == plain(rows)


def test_few_ids_and_ties(spark):
    rows = [(i, [float(i % 2)] * 16, None) for i in range(5)] + [(None, [0.25] * 16, 3)]
    assert got(codes.compress(table(spark, rows))) == plain(rows)
    alone = [(None, [0.25] * 16, 3), (None, [-0.25] * 16, 3)]
    assert got(codes.compress(table(spark, alone))) == plain(alone)


def test_nothing_and_too_large(spark):
    assert got(codes.compress(table(spark, []))) == []
    assert got(codes.compress(table(spark, [(1, None, 1)]))) == []
    with pytest.raises(Exception, match="a component is beyond"):
        codes.compress(table(spark, [(1, [1e30] * 16, 1)])).collect()


def test_large_weights_are_summed_exactly(spark):
    distinct = spark.createDataFrame([(0, [1 << 25, -3], 1 << 40), (0, [(1 << 25) - 1, -4], (1 << 40) + 1)], "pos int, part array<int>, weight long")
    import numpy as np

    (book,) = codes.moved(distinct, [np.array([[0, 0]], np.int64)])
    a, b = 1 << 40, (1 << 40) + 1
    assert book.tolist() == [[((1 << 25) * a + ((1 << 25) - 1) * b) // (a + b), (-3 * a - 4 * b) // (a + b)]]
