import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.functions import mappers, scalars
from logweave.functions import permissions as P
from logweave.operators import merge, search, sqlguard
from logweave.sources import glxy, rest
from logweave.sources.settings import Settings

ALL_BITS = 0xFFFFFFFFFFFFFFFF


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_permissions(spark):
    base = lambda n: int(one(spark, P.unsigned(P.base(F.lit(n).cast("bigint")))))
    assert base(104324673 | 1024) == 104324673 | 1024 and base(8) == ALL_BITS
    assert int(one(spark, P.unsigned(P.bits_of(F.lit(str(ALL_BITS)))))) == ALL_BITS
    rows = [{"id": "1", "type": 0, "allow": None, "deny": "1024"}, {"id": "5", "type": 0, "allow": "1024", "deny": ""}, {"id": "9", "type": 1, "allow": "65536", "deny": "1024"}]
    df = spark.createDataFrame([(rows,)], "o array<struct<id:string,type:int,allow:string,deny:string>>")

    def bits(user, roles, start=1024):
        return df.select(P.in_channel(F.lit(start).cast("bigint"), "o", F.lit(user), F.array(*[F.lit(r).cast("bigint") for r in roles]), F.lit(1)).alias("x")).head()["x"]

    assert bits(2, [7]) == 0 and bits(2, [5]) == 1024 and bits(9, [5]) == 65536 and bits(2, [7], 8) == P.ALL


def test_scalars(spark):
    assert one(spark, F.date_format(scalars.id_to_time(F.lit(0).cast("bigint")), "yyyy-MM-dd HH:mm:ss")) == "2015-01-01 00:00:00"
    assert one(spark, scalars.time_to_id(scalars.id_to_time(F.lit(1191168944338108416)))) == 1191168944338108416
    assert [one(spark, F.unix_micros(scalars.iso_to_time(F.lit(x)))) for x in ("1970-01-01T00:00:01Z", "1970-01-01T01:00:00.000001+01:00", "", None)] == [10**6, 1, None, None]
    assert one(spark, scalars.without_nul(F.lit("a\u0000b\\u0000c"))) == "abc"
    assert one(spark, scalars.to_id(F.lit('"12"'))) == 12 and one(spark, scalars.to_id(F.lit(""))) is None
    assert [one(spark, scalars.emoji_key(F.lit(i), F.lit("x"))) for i in ("7", "0", None)] == ["custom:7", "unicode:x", "unicode:x"]


def test_mappers(spark):
    data = {"id": "5", "channel_id": "6", "author": {"id": "7", "username": "u"}, "content": "a\u0000b", "timestamp": "2024-01-15T12:00:00+00:00", "mentions": [{"id": "8", "username": "v"}], "message_reference": {"message_id": "4"},
            "attachments": [{"id": "1", "filename": "f.png", "size": 3, "url": "http://x/f"}], "reactions": [{"count": 2, "emoji": {"id": None, "name": "x"}}, {"emoji": {"id": "9", "name": "y"}}]}
    raw = spark.createDataFrame([(json.dumps(data),)], "raw string")
    m = mappers.messages(raw, 77).head()
    assert (m["message_id"], m["guild_id"], m["content"], m["type"], m["mentions"], m["referenced_message_id"]) == (5, 77, "ab", 0, [8], 4)
    assert [tuple(r) for r in mappers.reactions(raw).select("emoji_key", "count").collect()] == [("unicode:x", 2), ("custom:9", 1)]
    assert mappers.attachments(raw).head()["filename"] == "f.png"
    assert [r["user_id"] for r in mappers.users_of_messages(raw).orderBy("at").collect()] == [7, 8]
    with pytest.raises(Exception, match="payload without"):
        mappers.messages(spark.createDataFrame([('{"id":"1"}',)], "raw string")).collect()


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, w int")
    new = spark.createDataFrame([(2, "c", 21, 1), (2, None, 22, 2), (3, "d", 30, 1)], "k int, v string, w int, seq int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(merge.insert_ignore(old, new, ["k"], ["seq"])) == [(1, "a", 10), (2, "b", 20), (3, "d", 30)]
    assert rows(merge.update_all(old, new, ["k"], ["seq"])) == [(1, "a", 10), (2, None, 22), (3, "d", 30)]
    assert rows(merge.update_some(old, new, ["k"], ["v"], ["seq"])) == [(1, "a", 10), (2, None, 20), (3, "d", 30)]
    assert rows(merge.update_all(old, new.limit(0), ["k"], ["seq"])) == rows(old)
    state = spark.createDataFrame([(1, 50, 60, True), (2, None, None, False)], "channel_id bigint, oldest bigint, newest bigint, complete boolean")
    batch = spark.createDataFrame([(1, 55), (1, 70), (2, 5), (3, 9)], "channel_id bigint, message_id bigint")
    assert rows(merge.bounds(state, batch)) == [(1, 50, 70, True), (2, 5, 5, False), (3, 9, 9, False)]


def test_point_clouds(spark, tmp_path):
    points = spark.createDataFrame([(i % 3, i, i + 100, float(i), -float(i), 0.5) for i in range(50)], "guild_id bigint, chunk_id bigint, channel_id bigint, x double, y double, z double")
    glxy.write(points, f"{tmp_path}/p")
    back = {(r["guild_id"], r["chunk_id"], r["channel_id"], r["x"], r["y"], r["z"]) for r in glxy.read(spark, f"{tmp_path}/p").collect()}
    assert back == {tuple(r) for r in points.collect()}
    data = glxy.pack(np.zeros((2, 3)), np.array([1, 2]), np.array([3, 4]))
    assert len(data) == 16 + 2 * 28 and data[:4] == b"GLXY"
    for bad in (b"XXXX" + data[4:], data[:4] + b"\2" + data[5:], data[:-1]):
        with pytest.raises(ValueError):
            glxy.unpack(bad)


def test_point_cloud_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(glxy, "BLOCK_POINTS", 7)  # the driver deals the blocks; one guild has nearly all points
    made = [(5 if i % 20 else 6, 1000 - i // 2, i % 4, float(i), -float(i), 0.5) for i in range(300)]
    schema = "guild_id bigint, chunk_id bigint, channel_id bigint, x double, y double, z double"
    points = spark.createDataFrame([*made, (None, 1, 2, 0.0, 0.0, 0.0)], schema).repartition(3)
    assert glxy.encode(points).groupBy("guild_id").count().orderBy("guild_id").collect() == [(5, 41), (6, 3)]
    folder = tmp_path / "clouds"
    glxy.write_files(points, str(folder))
    assert sorted(f.name for f in folder.iterdir()) == ["5.bin", "6.bin"]
    for guild in (5, 6):
        want = sorted(r[1:] for r in made if r[0] == guild)
        xyz, chunks, channels = glxy.unpack((folder / f"{guild}.bin").read_bytes())
        assert [(c, h, *p) for c, h, p in zip(chunks.tolist(), channels.tolist(), xyz.tolist(), strict=True)] == want
        assert (folder / f"{guild}.bin").read_bytes() == glxy.pack(np.array([r[2:] for r in want]), np.array([r[0] for r in want]), np.array([r[1] for r in want]))
        assert sorted(tuple(r)[1:] for r in glxy.read_files(spark, f"file:{folder}", guild).collect()) == want
    spark.dataSource.register(glxy.PointClouds)
    parts = spark.read.format("point_clouds").option("points", 50).load(str(folder))
    assert sorted(tuple(r) for r in parts.collect()) == sorted(made) and parts.rdd.getNumPartitions() == 7
    # Guilds that are not written stay, unless all is overwritten.
    glxy.write_files(points.where("guild_id = 6").limit(2), str(folder))
    assert glxy.read_files(spark, str(folder)).groupBy("guild_id").count().orderBy("guild_id").collect() == [(5, 285), (6, 2)]
    glxy.write_files(points.where("guild_id = 6"), str(folder), "overwrite")
    assert [f.name for f in folder.iterdir()] == ["6.bin"]
    # A block that is missing leaves the files as they were.
    with pytest.raises(Exception, match="missing"):
        glxy.encode(points.where("guild_id = 5")).where("start > 0").write.format("point_clouds").mode("append").save(str(folder))
    assert [f.name for f in folder.iterdir()] == ["6.bin"]
    with pytest.raises(Exception, match="No such file"):
        glxy.read_files(spark, str(folder), 5).collect()
    glxy.write_files(points.limit(0), str(folder), "overwrite")
    assert glxy.read_files(spark, str(folder)).count() == 0
    with pytest.raises(Exception, match="mounted"):
        glxy.write_files(points, "hdfs://x/y")


def test_sql_guard(spark):
    spark.range(1000).createOrReplaceTempView("numbers")
    assert sqlguard.query(spark, "select * from numbers;").count() == 500
    assert sqlguard.query(spark, "select * from numbers limit 600").count() == 600
    assert sqlguard.as_payload(sqlguard.query(spark, "with a as (select 1 as x) select * from a")) == {"columns": ["x"], "rows": [[1]], "row_count": 1}
    for bad in ("drop view numbers", "insert into numbers select 1", "create table t as select 1 as a", "with a as (select 1) insert into numbers select * from a", "set x=1"):
        with pytest.raises(sqlguard.NotReadOnly):
            sqlguard.query(spark, bad)


def test_search(spark):
    rows = [(i, i % 3, [float(i), 0.0], [i]) for i in range(30)]
    v = spark.createDataFrame(rows, "chunk_id bigint, guild_id bigint, vector array<float>, author_ids array<bigint>")
    assert [r["chunk_id"] for r in search.top_k(v, [10.2, 0.0], 3).collect()] == [10, 11, 9]
    assert [r["chunk_id"] for r in search.top_k(v, [10.2, 0.0], 2, guild_ids=[0], author_id=9).collect()] == [9]
    assert search.fan_out(v, [0.0, 0.0], [0, 1], 4).count() == 4
    arrow = v.select(search.squared_distance_arrow([1.0, 0.0])("vector").alias("d")).agg(F.min("d")).head()[0]
    assert arrow == 0.0


def test_sync_rules(spark, tmp_path):
    assert rest.next_step(200, 0).action == "ok" and rest.next_step(404, 0).action == "fail"
    assert rest.next_step(429, 4, 2.5) == rest.Decision("wait", 2.5)
    assert [rest.next_step(500, i).seconds for i in range(4)] == [1, 2, 4, 8] and rest.next_step(None, 4).action == "fail"
    threads = {None: {"threads": [{"id": "1", "thread_metadata": {"archive_timestamp": "t1"}}], "has_more": True}, "t1": {"threads": [{"id": "2", "thread_metadata": {"archive_timestamp": "t0"}}], "has_more": False}}
    assert [t["id"] for t in rest.archived_threads(lambda _, p: threads[p.get("before")], 1)] == ["1", "2"]
    assert Settings.from_file(str(tmp_path / "none.toml")) == Settings()
