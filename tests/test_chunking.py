from pyspark.sql import functions as F

from logweave.functions import rendering as R
from logweave.operators import chunking as C

SCHEMA = "message_id bigint, channel_id bigint, author_id bigint, type int, ref_id bigint, content string, cost bigint, created_s double"


def log(spark, rows):
    return spark.createDataFrame([(r.get("id"), r.get("ch", 100), r.get("a", 1), r.get("type", 0), r.get("ref"), r.get("content", "x"), r.get("cost", 10), float(r.get("s", 0))) for r in rows], SCHEMA)


def chains(spark, rows, **kw):
    got = C.reply_chains(log(spark, rows), **kw).collect()
    return {r["leaf_message_id"]: (r["message_ids"], r["cross_channel_ref"]) for r in got}


def test_authors_are_apart_and_gaps_close(spark):
    rows = [{"id": 1, "a": 1, "s": 0}, {"id": 2, "a": 2, "s": 5}, {"id": 3, "a": 1, "s": 30}, {"id": 4, "a": 1, "s": 150}, {"id": 5, "a": 1, "type": 21, "s": 151}]
    got = {(r["author_id"], tuple(r["message_ids"]), r["chunk_state"]) for r in C.author_groups(log(spark, rows)).collect()}
    assert got == {(1, (1, 3), "closed"), (1, (4,), "open"), (2, (2,), "open")}


def test_reply_chains(spark):
    four = [{"id": 1}, {"id": 2, "ref": 1}, {"id": 3, "ref": 2}, {"id": 4, "ref": 3}]
    assert chains(spark, four)[4] == ([1, 2, 3, 4], None)
    assert chains(spark, four, max_depth=2)[4] == ([3, 4], None)
    assert chains(spark, four, max_cost=20)[4] == ([3, 4], None)
    assert chains(spark, [{"id": 2, "ref": 1}]) == {2: ([2], None)}
    assert chains(spark, [{"id": 1, "ch": 200}, {"id": 2, "ref": 1}]) == {2: ([2], 1)}
    assert chains(spark, [{"id": 1}, {"id": 2, "ref": 1, "type": 21}, {"id": 3, "ref": 2}])[3] == ([1, 3], None)
    assert chains(spark, [{"id": 1, "ref": 2}, {"id": 2, "ref": 1}]) == {1: ([2, 1], None), 2: ([1, 2], None)}
    assert chains(spark, [{"id": 1, "content": ""}, {"id": 2, "ref": 1, "content": ""}]) == {}
    assert chains(spark, [{"id": 1, "cost": 40_000}, {"id": 2, "ref": 1}]) == {}
    assert chains(spark, [{"id": 1}]) == {} == chains(spark, [{"id": 1, "ref": 0}])
    deep = [{"id": i, "ref": i - 1 if i > 1 else None} for i in range(1, 31)]
    assert chains(spark, deep)[30][0] == list(range(11, 31))


def test_texts(spark):
    rows = [{"id": 1, "content": "first"}, {"id": 2, "ref": 1, "content": ""}]
    told = log(spark, rows).withColumn("line", R.message_text(F.lit(None).cast("string"), "author_id", F.timestamp_seconds("created_s"), "content"))
    got = C.texts(C.reply_chains(told), told, ["leaf_message_id"], reply_chain=True).collect()
    assert [r["text"] for r in got] == ["[1] 1970-01-01\nfirst\n\n↳ [1] 1970-01-01"]


def lines(spark, column, values, schema):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(column).collect()]


def test_attachment_lines(spark):
    names = ["a.PNG", "noext", ".bashrc", "x." + "y" * 120, "n" * 120, "n" * 120 + ".txt", "end."]
    got = lines(spark, R.attachment_line("f"), names, "f string")
    assert got[:3] == ["[Image: a.PNG]", "[File: noext]", "[File: .bashrc]"]
    assert got[4] == "[File: " + "n" * 97 + "...]" and got[5] == "[Document: " + "n" * 93 + "....txt]" and got[6] == "[File: end.]"


def test_embed_lines(spark):
    from logweave import schemas

    full = {"title": "T", "description": "d" * 241, "author": {"name": "A"}, "fields": [{"name": f"n{i}", "value": "v" * (121 if i == 0 else 1)} for i in range(7)], "footer": {"text": "F"}}
    empty = {"title": "", "description": None, "author": None, "fields": None, "footer": None}
    got = lines(spark, R.embed_line("e"), [full, empty], f"e {schemas.EMBED}")
    assert got == ['[Embed: "T" - by A - ' + "d" * 240 + "... - n0: " + "v" * 120 + "... - n1: v - n2: v - n3: v - n4: v - F]", ""]


def test_token_counts(spark):
    assert lines(spark, R.count_tokens("t"), ["", None, "a", "abcd", "abcde"], "t string") == [0, 0, 1, 1, 2]


def test_counts_and_cuts_by_a_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({w: i for i, w in enumerate(["?", "a", "b", "c"])}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.save(path := str(tmp_path / "t.json"))
    texts = ["a b c", "", None, "a", "a b c a b", "zz"]
    assert lines(spark, R.tokenizer_counter(path)("t"), texts, "t string") == [3, 0, 0, 1, 5, 1]
    assert lines(spark, R.tokenizer_truncator(path, 3)("t"), texts, "t string") == ["a b c", "", None, "a", "a b c...", "zz"]
