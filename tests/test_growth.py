"""What differed or failed only on larger tables, on the smallest tables that show it."""

import datetime as dt

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from logweave import runs, warehouse
from logweave.operators import layout, lists, neighbours, projection, search, storage
from logweave.plans import chunking, vectors
from logweave.warehouse import Warehouse


def far_rows(spark, n=300, d=6):
    """Vectors whose times lie beyond those that pandas has."""
    x = np.random.default_rng(4).normal(size=(n, d))
    rows = spark.createDataFrame([(i * 10_000, i % 3, v.tolist()) for i, v in enumerate(x)], "chunk_id bigint, guild_id bigint, vector array<float>")
    return rows.withColumn("first_message_at", F.timestamp_seconds(F.lit(1704067200) + F.col("chunk_id") * 3600)), x


def test_index_holds_times_that_pandas_has_not(spark, tmp_path):
    v, x = far_rows(spark)
    index = lists.Index.build(v, str(tmp_path))
    assert index.rows().agg(F.max(F.unix_seconds("first_message_at"))).head()[0] == 1704067200 + 299 * 10_000 * 3600
    found, _ = index.top_k(x[7].tolist(), 20)
    assert [(r["chunk_id"], r["distance"]) for r in found.collect()] == [(r["chunk_id"], r["distance"]) for r in search.top_k(v, x[7].tolist(), 20).collect()]


def test_filtered_search_of_such_an_index(spark, tmp_path):
    v, x = far_rows(spark)
    found, _ = lists.Index.build(v, str(tmp_path)).top_k(x[7].tolist(), 20, guild_ids=[1, 2])
    want = search.top_k(v, x[7].tolist(), 20, guild_ids=[1, 2])
    assert [(r["chunk_id"], r["guild_id"], r["distance"]) for r in found.collect()] == [(r["chunk_id"], r["guild_id"], r["distance"]) for r in want.collect()]


def events(spark, folder, rows):
    """A table of events of one user; times are seconds after noon."""
    told = [(i, dt.datetime(2024, 1, 1, 12) + dt.timedelta(seconds=s), 1, "click", 1.0, '{"k": 1}') for i, s in rows]
    spark.createDataFrame(told, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_author_groups_round_seconds_as_sql_does(spark, tmp_path):
    rows = chunking.author_group_events_1h(spark, events(spark, tmp_path, [(1, 0.4), (2, 3600.6), (3, 7200.5)])).orderBy("start_message_id").collect()
    assert [(r["start_message_id"], r["end_message_id"]) for r in rows] == [(1, 1), (2, 3)]  # 0, 3601, 7200


def test_sessions_round_seconds_as_sql_does(spark, tmp_path):
    rows = chunking.author_sessions_gap_only(spark, events(spark, tmp_path, [(1, 0.4), (2, 3600.6), (3, 7200.5)])).orderBy("start_message_id").collect()
    assert [(r["start_message_id"], r["end_message_id"]) for r in rows] == [(1, 1), (2, 3)]


def test_sessions_of_rows_that_share_an_id(spark, tmp_path):
    # Both rows of id 2 begin a run: with the first alone, the second opens another, and id 3 belongs to that.
    rows = chunking.author_sessions_gap_only(spark, events(spark, tmp_path, [(1, 0), (2, 9000), (2, 18000), (3, 18100)])).collect()
    assert len(rows) == 3 and sum(r["n_messages"] for r in rows) == 4


def test_bounding_box_holds_every_point(spark):
    points = spark.range(25_001).select(F.col("id").alias("chunk_id"), *[F.when(F.col("id") == 12_345, k * 1000.0).otherwise(F.col("id") % 7).alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))])
    box = projection.bounding_box(points).head()
    assert [box[f"max_{c}"] for c in "xyz"] == [1000.0, 2000.0, 3000.0] and [box[f"min_{c}"] for c in "xyz"] == [0.0, 0.0, 0.0]


def test_graph_of_vectors_without_structure(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 400)
    x = np.random.default_rng(5).normal(size=(3000, 48))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id bigint, vector array<float>").repartition(3)
    edges = neighbours.graph(v, 5)
    assert neighbours.recall(v, edges, 5, every=20) >= 0.9 and edges.count() == 15_000


def test_exact_neighbours_in_blocks(spark):
    x = np.round(np.random.default_rng(6).normal(size=(700, 4)), 1)
    x[:90] = x[0]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id bigint, vector array<double>").repartition(3)
    for size in (None, 150):
        got = {}
        for r in search.knn_graph(v, 5, block_rows=size).collect():
            got.setdefault(r["chunk_id"], []).append((r["distance"], r["neighbor"]))
        for i in range(0, 700, 13):
            d = np.round(((x - x[i]) ** 2).sum(axis=1), 6)
            assert sorted(got[i]) == sorted((float(d[j]), j) for j in np.lexsort((np.arange(700), d)) if j != i)[:5]


def test_exact_neighbours_alike_in_six_places_are_taken_by_id(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 1e-5]), (2, [1.0, 0.0])]  # squared distances 1.0000000001 and 1
    near = search.knn_graph(spark.createDataFrame(rows, "chunk_id bigint, vector array<double>"), 1).where("chunk_id = 0").head()
    assert near["neighbor"] == 1


def test_both_ends_of_an_edge_are_pushed():
    points = np.vstack([np.zeros((2, 3)), np.full((30, 3), 0.5)])
    after = layout.moved(points, np.array([0]), np.array([1]), np.ones(1), epochs=1)
    assert (after[:2] < 0).all() and (after[2:] == 0.5).all()


def test_indexed_queries_over_ids_that_have_no_time(spark, tmp_path):
    x = np.random.default_rng(7).normal(size=(60, 6))
    rows = [(i * 1_000_000_000_000, v.tolist(), i % 4) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = sorted((round(float(((v.astype(np.float32).astype(float) - x[0].astype(np.float32)) ** 2).sum()), 6), i * 1_000_000_000_000) for i, v in enumerate(x) if i % 4)[:20]
    found = vectors.vector_index_topk_filtered(spark, str(tmp_path)).collect()
    assert [r["chunk_id"] for r in found] == [i for _, i in want]


def test_an_encoder_is_given_few_rows_at_once(spark, tmp_path):
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[float(len(texts)), float(texts.str.len().sum())]] * len(texts))

    wh = Warehouse(spark, str(tmp_path), buckets=1)
    ids = spark.range(5000).repartition(1)
    wh.merge("chunks", ids.selectExpr("'sliding_window' chunk_type", "7L channel_id", "id anchor_id", "id chunk_id", "1L guild_id", "array(1L) author_ids", "'pending' embedding_status", "0.0D first_message_s", "0.0D last_message_s"), ["chunk_id"])
    wh.merge("chunk_texts", ids.selectExpr("id chunk_id", "repeat('a', int(if(id < 2500, 4, 20000))) text", "if(id < 2500, 1L, 5000L) token_count"), ["token_count"])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert runs.embed(wh, F.pandas_udf(sizes, "array<float>")) == 5000
    rows, size = wh.read("vectors").agg(F.max(F.col("vector")[0]), F.max(F.col("vector")[1])).head()
    assert rows <= storage.BATCH_ROWS and size <= 2 * storage.BATCH_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_a_merge_shuffles_rows_once(spark):
    table, batch = (spark.range(n).selectExpr("id k", "id v", "id w", "id % 4 _bucket") for n in (50, 80))
    for mutable in (None, (), ("v",)):
        merged = warehouse.merged(warehouse.Rule(("k",), mutable), table, batch, ["w"], "_bucket")
        assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert merged.count() == 80


def test_a_run_rewrites_texts_once(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path), buckets=1)
    spark.range(1, 9).selectExpr("id message_id", "7L channel_id", "1L guild_id", "id % 2 author_id", "0 type", "if(id > 2, id - 2, null) ref_id", "'m' content", "double(id) created_s", "cast(array() as array<bigint>) mentions", "false has_attachments", "'m' line", "120L cost").write.parquet(f"{wh.root}/log")
    assert min(runs.chunk(wh).values()) > 0
    assert wh.version("chunk_texts") == 1 and wh.read("chunk_texts").where("text is not null").count() == wh.read("chunks").count()


def _odd_rows(spark, path):
    x = np.random.default_rng(9).normal(size=(60, 6)).astype(np.float32).astype(float)
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(x)]
    rows += [(60, None, 1), (61, [float("nan"), *x[1][1:].tolist()], 1), (62, [None, *x[0][1:].tolist()], 1), (63, [float("inf")] * 6, 2), (64, [], 3), (65, [None] * 6, 1)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    # A component that one of both lacks does not count; rows without a distance come last.
    near = sorted((round(float(((v - x[0]) ** 2).sum()), 6), i) for i, v in enumerate(x))
    return [(0.0, 0), (0.0, 62), *near[1:], (np.inf, 63), (np.nan, 61), (None, 60), (None, 64), (None, 65)]


def test_indexed_query_over_rows_that_have_no_nearest_centre(spark, tmp_path):
    want = _odd_rows(spark, tmp_path)
    assert [r["chunk_id"] for r in vectors.vector_index_topk(spark, str(tmp_path)).collect()] == [i for _, i in want[:20]]
    v = spark.read.parquet(f"{tmp_path}/embeddings.parquet").selectExpr("vec_id chunk_id", "label guild_id", "embedding vector")
    query = v.where("chunk_id = 0").head()["vector"]
    index = lists.Index.build(v, f"{tmp_path}/index")
    found = [r["chunk_id"] for r in index.top_k(query, 70)[0].collect()]
    assert found == [i for _, i in want] == [r["chunk_id"] for r in search.top_k(v, query, 70).collect()]
    only = lists.Index.build(v.where("chunk_id in (60, 61)"), f"{tmp_path}/none")
    assert [r["chunk_id"] for r in only.top_k(query, 5)[0].collect()] == [61, 60]


def test_filtered_indexed_query_over_such_rows(spark, tmp_path):
    want = [i for _, i in _odd_rows(spark, tmp_path) if (i if i < 60 else (1, 1, 1, 2, 3, 1)[i - 60]) % 4 in (1, 2, 3)]
    assert [r["chunk_id"] for r in vectors.vector_index_topk_filtered(spark, str(tmp_path)).collect()] == want[:20]


def test_layout_moves_every_row_and_equal_vectors_together(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(500, 10))
    x[490:] = x[:10]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id bigint, vector array<double>").selectExpr("chunk_id", "1L guild_id", "2L channel_id", "vector")
    before = {}
    for sample in (5_000, 200):  # all in one task, and dealt to three
        p = np.array([[r["x"], r["y"], r["z"]] for r in layout.layout(v, sample=sample, epochs=40).orderBy("chunk_id").collect()])
        assert len(p) == 500 and (p[490:] == p[:10]).all() and len(np.unique(p, axis=0)) == 490
        before[sample] = layout.trustworthiness(x[:490], p[:490], 5)
    flat = np.array([[r["x"], r["y"], r["z"]] for r in projection.layout(v).orderBy("chunk_id").collect()])
    assert min(before.values()) > layout.trustworthiness(x[:490], flat[:490], 5) + 0.02
    assert sum(many for _, many in layout.rounds(200)) == 200


def test_neighbours_kept_are_those_of_asked_rows_with_all_rows(spark):
    rng = np.random.default_rng(8)
    x, p, q = rng.normal(size=(300, 8)), rng.normal(size=(300, 3)), rng.normal(size=(300, 3))
    rows = spark.createDataFrame([(i, *(v[i].tolist() for v in (x, p, q))) for i in range(300)], "chunk_id bigint, vector array<double>, p array<double>, q array<double>").repartition(3)
    assert np.allclose(layout.kept(rows, ["p", "q"], 5, every=1), [layout.trustworthiness(x, v, 5) for v in (p, q)])
    far = lambda v, i: [j for j in np.argsort(((v - v[i]) ** 2).sum(axis=1), kind="stable") if j != i]
    lost = sum(max(far(x, i).index(j) + 1 - 5, 0) for i in range(0, 300, 5) for j in far(p, i)[:5])
    assert np.isclose(layout.kept(rows, ["p"], 5)[0], 1 - 2 * lost / (60 * 5 * (2 * 300 - 16)))


def test_range_join_counts_without_pairs(spark, tmp_path):
    nan = float("nan")
    suppliers = [(1, 3, 100.0), (1, 3, 900.0), (2, 3, -500.0), (3, 4, 0.0), (4, None, 1.0), (5, 3, None), (6, 3, nan), (None, 3, 700.0), (7, 9, 5.0), (8, 4, 10_000.0)]
    customers = [(3, 600.0)] * 50 + [(3, -400.0), (3, 1400.0), (3, 1400.01), (3, 0.0), (3, -0.0), (4, 500.0), (4, -500.01), (3, nan), (None, 5.0), (3, None), (5, 5.0)]
    spark.createDataFrame(suppliers, "s_suppkey bigint, s_nationkey bigint, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(customers, "c_nationkey bigint, c_acctbal double").repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("supplier", "customer"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").createOrReplaceTempView(name)
    found = vectors.QUERIES["sql_range_join"](spark, str(tmp_path))
    want = spark.sql(vectors.SQL["sql_range_join"])
    assert found.dtypes == want.dtypes and sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert dict(want.collect())[1] == 53 + 51 and "c_acctbal" not in found._jdf.queryExecution().toString()
