import json

import pytest
from pyspark.sql import functions as F

from logweave import runs, warehouse
from logweave.operators import chunking, sqlguard
from logweave.streaming import stateful
from logweave.warehouse import Taken, Warehouse

LOG = "message_id bigint, channel_id bigint, guild_id bigint, author_id bigint, type int, ref_id bigint, content string, created_s double, mentions array<bigint>, has_attachments boolean, line string, cost bigint"


def log(spark, ids, channel=7):
    rows = [(i, channel, 1, i % 2 + 1, 0, i - 1 if i % 6 else None, f"m{i}", float(i * 20), [], False, f"m{i}", 120) for i in ids]
    return spark.createDataFrame(rows, LOG)


def chunks(wh):
    rows = wh.read("chunks").select("chunk_type", "channel_id", "anchor_id", "message_ids", "chunk_state").collect()
    return sorted((r[0], r[1], r[2], tuple(r[3]), r[4]) for r in rows)


def test_chunking_goes_on_where_it_ended(spark, tmp_path):
    whole, parts = (Warehouse(spark, str(tmp_path / n)) for n in ("whole", "parts"))
    log(spark, range(1, 24)).write.parquet(f"{whole.root}/log")
    counts = runs.chunk(whole)
    assert counts["reply_chain"] == 19 and counts["sliding_window"] == sum(c[0] == "sliding_window" for c in chunks(whole))
    log(spark, range(1, 11)).write.parquet(f"{parts.root}/log")
    runs.chunk(parts)
    assert runs.embed(parts) == len(chunks(parts))
    log(spark, range(11, 24)).write.mode("append").parquet(f"{parts.root}/log")
    runs.chunk(parts)
    assert chunks(parts) == chunks(whole)
    waiting = parts.read("chunks").where("embedding_status = 'pending'")
    assert 0 < waiting.count() < len(chunks(parts))
    assert all(max(r["message_ids"]) > 10 for r in waiting.select("message_ids").collect())
    runs.embed(parts)
    assert parts.read("vectors").count() == len(chunks(parts)) and runs.embed(parts) == 0
    assert [r["last_message_id"] for r in parts.read("chunking_checkpoints").collect()] == [23]


def test_a_broken_write_leaves_the_version_before(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path))
    wh.write("t", spark.range(5))
    with pytest.raises(Exception, match="stop"):
        wh.write("t", spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id")))
    assert wh.read("t").count() == 5
    assert wh.write("t", spark.range(6)).count() == 6 and not wh.has("u")


def payload(i, channel, count=1):
    user = {"id": str(i % 3 + 1), "username": f"u{i}"}
    return json.dumps({"id": str(i), "channel_id": str(channel), "author": user, "content": f"m{i}", "timestamp": "2024-01-01T00:00:00Z", "type": 0, "attachments": [{"id": str(100 + i), "filename": "a.png", "size": 1, "url": "u"}], "reactions": [{"count": count, "emoji": {"id": None, "name": "x"}}]})


def test_ingest_goes_back_and_then_on(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path))
    there = {1: list(range(1, 6)), 2: [7]}

    def pages(direction, bounds):
        rows = []
        for r in bounds.collect():
            for i in there.get(r["channel_id"], []):
                edge = r["message_id"]
                if edge is None or (i < edge if direction == "before" else i > edge):
                    rows.append((r["channel_id"], payload(i, r["channel_id"], count=len(there[1]))))
        return spark.createDataFrame(rows, "channel_id bigint, raw string")

    assert runs.ingest(wh, pages, [1, 2, 3], guild_id=9) == {1: 5, 2: 1, 3: 0}
    there[1] += [6, 8]
    assert runs.ingest(wh, pages, [1, 2], guild_id=9) == {1: 2, 2: 0}
    bounds = {r["channel_id"]: (r["oldest"], r["newest"], r["complete"]) for r in wh.read("bounds").collect()}
    assert bounds[1] == (1, 8, True) and bounds[2] == (7, 7, True) and runs.incomplete_backfills(wh).count() == 0
    assert wh.read("messages").count() == 8 and wh.read("attachments").count() == 8 and wh.read("users").count() == 3
    assert {r["count"] for r in wh.read("reactions").where("message_id <= 5").collect()} == {5}
    assert runs.persist_messages(wh, spark.createDataFrame([(payload(3, 1, count=50),)], "raw string"), 9) == 1
    assert wh.read("reactions").where("message_id = 3").head()["count"] == 50 and wh.read("messages").count() == 8


def test_limits_are_read_from_the_plan(spark):
    spark.range(2000).createOrReplaceTempView("many")
    count = lambda sql: sqlguard.query(spark, sql).count()
    assert count("select id from many") == 500
    assert count("select id from many limit 900;") == 900 and count("with a as (select id from many) select id from a order by id limit 700") == 700
    assert count("select a.id from (select id from many limit 900) a") == 500
    assert count("select id, 'limit 900' from many -- limit 900") == 500


def texts(wh):
    rows = wh.read("chunks").join(wh.read("chunk_texts"), "chunk_id", "left").select("chunk_type", "channel_id", "anchor_id", "text").collect()
    return sorted(tuple(r) for r in rows)


def test_a_log_in_any_order(spark, tmp_path):
    """More rows of a channel than an Arrow batch holds, in random files and order, some twice, and a restart between."""
    whole, parts = (Warehouse(spark, str(tmp_path / n), buckets=2) for n in ("whole", "parts"))
    n = 12_000
    rows = spark.range(1, n + 1).selectExpr("id as message_id", "cast(7 as bigint) channel_id", "cast(1 as bigint) guild_id", "id % 2 + 1 as author_id", "0 as type", "cast(null as bigint) ref_id", "'m' content", "cast(id * 20 as double) created_s", "cast(array() as array<bigint>) mentions", "false has_attachments", "concat('m', id) line", "cast(120 as bigint) cost")
    rows.write.parquet(f"{whole.root}/log")
    runs.chunk(whole)
    mixed = lambda df: df.repartition(4).sortWithinPartitions(F.xxhash64("message_id"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        for part in (rows.where("message_id <= 11000"), rows.where("message_id > 11000").unionByName(rows.where("message_id > 10990"))):
            mixed(part).write.mode("append").parquet(f"{parts.root}/log")
            runs.chunk(parts)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert chunks(parts) == chunks(whole) and texts(parts) == texts(whole)
    windows = [c for c in chunks(whole) if c[0] == "sliding_window"]
    assert len({i for c in windows for i in c[3]}) == n and all(t[3] for t in texts(parts))


def test_a_run_that_breaks_off_is_made_up_for(spark, tmp_path, monkeypatch):
    """Each step in turn breaks a run, and after each more is appended; in the end all is as if nothing had happened."""
    whole, parts = (Warehouse(spark, str(tmp_path / n), buckets=2) for n in ("whole", "parts"))
    log(spark, range(1, 31)).write.parquet(f"{whole.root}/log")
    runs.chunk(whole)

    def fail(*a, **b):
        raise RuntimeError("stop")

    for k, broken in enumerate(("chunking.texts", "chunking.describe", "states_author_group", "chunking_checkpoints")):
        log(spark, range(6 * k + 1, 6 * k + 7)).write.mode("append").parquet(f"{parts.root}/log")
        with monkeypatch.context() as m:
            if broken.startswith("chunking."):
                m.setattr(chunking, broken.split(".")[1], fail)
            else:
                merge = Warehouse.merge
                m.setattr(Warehouse, "merge", lambda self, name, *a, merge=merge, wanted=broken: fail() if name == wanted else merge(self, name, *a))
            with pytest.raises(Exception, match="stop"):
                runs.chunk(parts)
    log(spark, range(25, 31)).write.mode("append").parquet(f"{parts.root}/log")
    runs.chunk(parts)
    assert chunks(parts) == chunks(whole) and texts(parts) == texts(whole)


def test_one_channel_at_a_time(spark, tmp_path):
    whole, parts = (Warehouse(spark, str(tmp_path / n), buckets=2) for n in ("whole", "parts"))
    for wh in (whole, parts):
        log(spark, range(1, 12)).unionByName(log(spark, range(101, 112), channel=8)).write.parquet(f"{wh.root}/log")
    runs.chunk(whole)
    runs.chunk(parts, channel_id=8)
    assert {c[1] for c in chunks(parts)} == {8}
    assert runs.embed(parts, channel_id=7) == 0 and runs.embed(parts, guild_id=1) == len(chunks(parts))
    runs.chunk(parts)
    assert chunks(parts) == chunks(whole) and texts(parts) == texts(whole)


def test_late_messages_are_left_out(spark, tmp_path):
    rows = spark.createDataFrame([("a", 5, 10, 1.0), ("a", 7, 10, 2.0)], "key string, message_id bigint, cost bigint, created_s double")
    first, states = stateful.advance(rows, chunking.WINDOW, spark.createDataFrame([], stateful.STATE_ROWS))
    late = spark.createDataFrame([("a", 6, 10, 3.0), ("a", 7, 10, 3.0), ("a", 8, 10, 3.0), ("a", 8, 10, 3.0)], rows.schema)
    second, _ = stateful.advance(late, chunking.WINDOW, states)
    assert [r["message_ids"] for r in first.collect()] == [[5, 7]] and [r["message_ids"] for r in second.collect()] == [[5, 7, 8]]


RULE = warehouse.Rule(("k",), None)


def rows_of(wh):
    return {r["k"]: r["v"] for r in wh.read("t").collect()}


def test_merges_write_the_buckets_they_touch(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path), buckets=8)
    wh.merge("t", spark.range(100).selectExpr("id k", "id v"), ["k"], RULE)
    assert len(wh.rewritten("t")) == 8
    wh.merge("t", spark.range(1).selectExpr("id + 42 k", "id - 1 v"), ["k"], RULE)
    assert len(wh.rewritten("t")) == 1 and rows_of(wh) == {k: k for k in range(100)} | {42: -1}
    folders = lambda: [n for f in wh._names("t", "data") for n in wh._names("t", "data", f) if n.startswith("_bucket")]
    assert len(folders()) == 9
    wh.vacuum("t")
    assert len(folders()) == 8 and rows_of(wh)[42] == -1 and wh.version("t") == 2
    wh.rebucket("t", 3)
    assert len(wh.rewritten("t")) == 3 and len(rows_of(wh)) == 100 and wh.tables() == ["t"]
    with pytest.raises(ValueError, match="bucketed by"):
        wh.merge("t", spark.range(1).selectExpr("id k", "id v"), ["v"], warehouse.Rule(("v",), None))


def test_two_writers_keep_each_others_rows(spark, tmp_path, monkeypatch):
    one, two = (Warehouse(spark, str(tmp_path), buckets=2) for _ in range(2))
    one.merge("t", spark.range(3).selectExpr("id k", "id v"), ["k"], RULE)
    commit, between = Warehouse._commit, []

    def late(self, *a):
        if self is one and not between:
            between.append(1)
            two.merge("t", spark.range(2).selectExpr("id + 2 k", "id + 50 v"), ["k"], RULE)
        commit(self, *a)

    monkeypatch.setattr(Warehouse, "_commit", late)
    one.merge("t", spark.range(1).selectExpr("id + 9 k", "id + 9 v"), ["k"], RULE)
    assert rows_of(one) == {0: 0, 1: 1, 2: 50, 3: 51, 9: 9} and one.version("t") == 3
    between.clear()
    with pytest.raises(Taken):
        one.write("t", spark.range(1).selectExpr("id k", "id v"))


def test_a_half_written_manifest_is_no_version(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path), buckets=2)
    wh.merge("t", spark.range(3).selectExpr("id k", "id v"), ["k"], RULE)
    (tmp_path / "t/manifests/v=2").write_text('{"sche')
    assert len(rows_of(wh)) == 3
    with pytest.raises(Taken):  # its number stays taken until it is vacuumed
        wh.merge("t", spark.range(1).selectExpr("id k", "id v"), ["k"], RULE)
    wh.vacuum("t")
    wh.merge("t", spark.range(1).selectExpr("id + 7 k", "id v"), ["k"], RULE)
    assert len(rows_of(wh)) == 4
