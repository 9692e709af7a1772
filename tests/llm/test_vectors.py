import numpy as np
from pyspark.sql import functions as F

from logweave.llm import vectors


def plain(rows):
    v = [np.asarray(x, float) if x is not None and len(x) and all(c is not None and np.isfinite(c) for c in x) and any(x) else None for _, x, _ in rows]
    near = {i: set() for i in range(len(rows))}
    for i, (a, _, la) in enumerate(rows):
        for j in range(i):
            if None in (la, rows[j][2], a, rows[j][0]) or la != rows[j][2] or v[i] is None or v[j] is None or len(v[i]) != len(v[j]):
                continue
            if v[i] @ v[j] / np.sqrt((v[i] @ v[i]) * (v[j] @ v[j])) >= 0.98:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i, (a, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        c = min((rows[j][0] for j in seen), default=None) if a is not None else None
        out.append((a, len(near[i]), c, a is None or a == c))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def table(n=400, d=16):
    rng = np.random.default_rng(3)
    rows, base = [], rng.normal(size=(40, d))
    for i in range(n):
        x = base[rng.integers(40)] * rng.choice([1, 3]) + rng.normal(size=d) * rng.choice([0, 0.02, 0.08, 0.6])
        rows.append((2000 - i, x.tolist(), int(rng.integers(3))))
    odd = [(1, None, 0), (2, [], 0), (3, [0.0] * d, 0), (4, [float("nan")] * d, 0), (5, [None] + [1.0] * (d - 1), 0), (6, rows[0][1], None), (None, rows[0][1], rows[0][2]), (7, rows[0][1][:5], rows[0][2]), (8, rows[0][1], rows[0][2]), (8, rows[0][1], rows[0][2])]
    return rows + odd


def test_like_brute_force(spark, monkeypatch):
    for name, value in (("BLOCK", 40), ("MAX_CENTRES", 4), ("SHARD_CENTRES", 3)):  # shards are parted again and again
        monkeypatch.setattr(vectors, name, value)
    rows = table()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1)).repartition(3)
    result = vectors.near_duplicates(df)
    mine, want = got(result), plain(rows)
    assert len(mine) == len(want)
    assert sum(a == b for a, b in zip(mine, want, strict=True)) >= 0.98 * len(want)
    assert all(a[1] <= b[1] for a, b in zip(mine, want, strict=True))  # no link below the threshold
    audited = {r["vec_id"]: (r["found"], r["there"]) for r in vectors.audit(df, result, every=1, block=70).collect()}
    links = {a: n for a, n, _, _ in want if n or a not in (1, 2, 3, 4, 5, 6, None)}
    assert {a: there for a, (_, there) in audited.items()} == links


def test_small_groups_beside_a_large_one(spark, monkeypatch):
    """Groups of six, and one of 300 around the threshold: each must be found, whatever the other draws to itself."""
    monkeypatch.setattr(vectors, "BLOCK", 100)
    rng = np.random.default_rng(9)
    near = lambda n, x: (x / np.linalg.norm(x) + 0.018 * rng.normal(size=(n, 64))).tolist()
    rows = near(300, rng.normal(size=64)) + [x for _ in range(60) for x in near(6, rng.normal(size=64))] + rng.normal(size=(600, 64)).tolist()
    rows = [(i, x, 1) for i, x in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    mine, want = ({r[0]: r for r in x} for x in (got(vectors.near_duplicates(df)), plain(rows)))
    for ids in (range(300), range(300, 660), range(660, 1260)):
        assert sum(mine[i][1] for i in ids) >= 0.98 * sum(want[i][1] for i in ids)
    assert sum(mine[i][2] == want[i][2] for i in range(300, 660)) >= 0.98 * 360
    assert all(mine[i][1] <= want[i][1] for i in mine)


def test_one_hot_group_and_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(8) + 0.01 * rng.normal(size=8)).tolist(), 1) for i in range(200)] + [(500 + i, [1.0] * 8, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    mine = got(vectors.near_duplicates(df))
    assert {c for _, _, c, _ in mine} == {0} and sum(n for _, n, _, _ in mine) >= 0.97 * 500 * 499
    assert got(vectors.near_duplicates(df.limit(0))) == []


def test_graph_is_reachable_and_searched():
    rng = np.random.default_rng(5)
    v = vectors.unit(np.repeat(rng.normal(size=(60, 12)), 5, axis=0) + 0.02 * rng.normal(size=(300, 12)))
    edges, medoid = vectors.build(v)
    found = sum(len(vectors.search(v, [np.array(e, np.int64) for e in edges], np.array([medoid]), q, 0.98)[0]) for q in v)
    assert found >= 0.97 * ((v @ v.T) >= 0.98).sum()
