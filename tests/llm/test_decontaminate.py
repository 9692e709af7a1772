import hashlib
import random
import re

from pyspark.sql import functions as F

from logweave.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items):
    windows = {}
    for i, text in items:
        w = plain_words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for doc_id, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= ids
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def random_tables():
    rnd = random.Random(5)
    w = lambda n: " ".join(rnd.choice(["alpha", "Beta", "é1", "x"]) for _ in range(n))
    items = [(i, w(rnd.choice([2, 5, 9, 10, 11, 25]))) for i in range(30)] + [(40, ""), (41, None), (42, "?!"), (43, "Alpha beta-é1, X!")]
    docs = []
    for i in range(120):
        text = w(rnd.randrange(40))
        if i % 3 == 0:
            text += " -- " + (items[i % 30][1] or "").upper().replace("É", "é") + "; " + w(5)
        docs.append((i, text))
    return [*docs, (200, None), (201, ""), (5, docs[5][1]), (None, items[3][1]), (202, "Z" * 200_000)], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = random_tables()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("_row", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, plain(docs, items)))
    total = sum(len(x[1] or "") for x in items)
    for size in (10**6, total // 2 - 1, total // 19):  # 1, 3 and 20 slices, a job each
        monkeypatch.setattr(d, "SLICE_BYTES", size)
        got = d.report(df, bench).collect()
        assert sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])) for r in got) == want
        kept = d.drop_contaminated(df, bench)
        assert kept.count() == sum(not x[5] for x in plain(docs, items)) and kept.columns == df.columns
    assert d.report(df, bench.limit(0)).where("contaminated").count() == 0
    assert d.report(df.limit(0), bench).count() == 0


def test_offsets_in_the_original():
    text = "“Ünder–the: BIG   tree” it stood"
    n, ranges, items = d.hits(d.build([("a", "big tree”")]), text)
    (s, e), = d.in_original(text, ranges)
    assert text[s:e] == "BIG   tree”" and items == {"a"} and n == 5


def test_items_without_an_id_are_looked_for(spark, monkeypatch):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"so {passage} it is"), (2, "clean words alone"), (3, f"{passage} and big trees")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (7, "Big trees"), (None, None)], "item_id long, text string")
    for size in (10**6, 30):
        monkeypatch.setattr(d, "SLICE_BYTES", size)
        got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in d.report(docs, bench).collect()}
        assert got == {1: (11, 0, True), 2: (0, 0, False), 3: (13, 1, True)}
        assert [r["doc_id"] for r in d.drop_contaminated(docs, bench).collect()] == [2]


def test_slices_join_hits_and_keep_large_ids(spark, monkeypatch):
    # Windows of two items that overlap in the text but are in different slices give one run.
    w = [f"w{i}" for i in range(30)]
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "Ah, " + " ".join(w) + " oh"), (None, "clean"), (big + 1, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w[i : i + 12])) for i in range(0, 18, 3)], "item_id long, text string")
    for size in (10**6, 20):
        monkeypatch.setattr(d, "SLICE_BYTES", size)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["spans"]) for r in d.report(docs, bench).collect()}
        assert got == {big: (32, 27, 6, f"4:{4 + len(' '.join(w[:27]))}"), None: (1, 0, 0, ""), big + 1: (0, 0, 0, "")}
