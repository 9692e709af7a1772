import numpy as np
from pyspark.sql import functions as F

from logweave.operators import layout, lists, neighbours, projection, search


def table(spark, n=1500, d=12, seed=1, copies=200):
    """Clusters, and one vector very often."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, d)) * 3
    x = centres[rng.integers(30, size=n)] + rng.normal(size=(n, d))
    x[:copies] = x[0]
    rows = [(i, i % 4, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id bigint, guild_id bigint, vector array<double>").repartition(5), x


def test_graph_has_nearly_all_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 60)
    monkeypatch.setattr(neighbours, "MEETING_ROWS", 200)
    v, x = table(spark)
    edges = neighbours.graph(v, 6)
    assert neighbours.recall(v, edges, 6) >= 0.9
    near = {}
    for r in edges.collect():
        near.setdefault(r["chunk_id"], []).append((r["distance"], r["neighbor"]))
    assert len(near) == len(x) and all(len({n for _, n in e}) == 6 for e in near.values()) and all(n != i for i, e in near.items() for _, n in e)
    for i in range(0, len(x), 97):
        assert all(abs(((x[i] - x[n]) ** 2).sum() - d) < 1e-5 for d, n in near[i])


def test_few_rows_have_all_others(spark):
    v, _ = table(spark, n=4, copies=2)
    edges = neighbours.graph(v, 6)
    assert edges.count() == 12 and neighbours.recall(v, edges, 6, every=1) == 1.0


def test_lists_give_what_a_full_search_gives(spark, tmp_path):
    v, x = table(spark)
    index = lists.Index.build(v, str(tmp_path))
    assert index.rows().count() == len(x)
    read = []
    for q in (x[3], x[700], x[1100] + 0.3, x[5] * 40):
        for k, filters in ((1, {}), (10, {}), (10, {"guild_ids": [2]}), (400, {"guild_ids": [3]})):
            found, used = index.top_k(q.tolist(), k, **filters)
            want = search.top_k(v, q.tolist(), k, **filters)
            assert [(r["chunk_id"], r["distance"]) for r in found.collect()] == [(r["chunk_id"], r["distance"]) for r in want.collect()]
            read.append(len(used) / len(index.lists))
    assert min(read) < 0.1 and read[1] < 0.6  # only part of the lists
    again = lists.Index.open(spark, str(tmp_path))
    plan = again.within(x[3].tolist(), 0.5)[0]._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(away" in plan


def test_components_are_those_of_the_covariance(spark):
    v, x = table(spark, copies=1)
    rows, share = projection.pca(v, 4)
    n, mean, scatter = projection.moments(v)
    assert n == len(x) and np.allclose(mean, x.mean(axis=0)) and np.allclose(scatter / (n - 1), np.cov(x.T))
    values, directions = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(axis=0)) @ directions[:, ::-1][:, :4]
    got = np.array([r["projected"] for r in rows.orderBy("chunk_id").collect()])
    assert np.allclose(np.abs(got), np.abs(want)) and np.allclose(share, values[::-1][:4] / values.sum())
    axes = np.linalg.lstsq(x - x.mean(axis=0), got, rcond=None)[0]
    assert all(a[np.abs(a).argmax()] > 0 for a in axes.T)


def test_sample_is_the_same_for_any_partitions(spark):
    v = spark.range(5000).select(F.col("id").alias("chunk_id"), F.lit(1).alias("x"))
    ids = lambda df: {r["chunk_id"] for r in df.collect()}
    one, other = (ids(projection.subsample(v.repartition(k), 700)) for k in (2, 9))
    hashes = {r["chunk_id"]: r["h"] for r in v.select("chunk_id", F.xxhash64("chunk_id", F.lit(projection.SEED)).alias("h")).collect()}
    assert one == other == set(sorted(hashes, key=lambda i: (hashes[i], i))[:700])
    assert projection.subsample(v, 5000).count() == 5000


def test_layout_keeps_more_neighbours_than_components(spark):
    v, x = table(spark, n=600, copies=3)
    v = v.withColumn("channel_id", F.col("chunk_id") % 5)
    points = np.array([[r["x"], r["y"], r["z"]] for r in layout.layout(v, sample=400, epochs=100).orderBy("chunk_id").collect()])
    flat = np.array([[r["x"], r["y"], r["z"]] for r in projection.layout(v).orderBy("chunk_id").collect()])
    assert len(points) == 600 and abs(np.sqrt((points**2).sum(axis=1)).max() - 100) < 1e-6
    assert layout.trustworthiness(x, points, 10) > layout.trustworthiness(x, flat, 10)


def test_memberships_add_up():
    d = np.sort(np.random.default_rng(2).random((50, 8)), axis=1)
    d[0, 5:] = np.inf
    w = layout.memberships(d)
    assert np.allclose(w.sum(axis=1)[1:], 3.0, atol=1e-3) and (w[:, 0] == 1).all() and (w[0, 5:] == 0).all()
