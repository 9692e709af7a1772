import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logweave.operators import chunking as C
from logweave.operators import segments as S


def windows(costs, budget=C.WINDOW):
    """A plain simulation: lists of 1-based positions, the open one last."""
    done, cur = [], []
    for i, t in enumerate(costs, 1):
        size = (len(cur) + 1) * max([t, *(costs[j - 1] for j in cur)]) if budget.mode == "max" else sum(costs[j - 1] for j in cur) + t
        if cur and (size > (budget.max_cost or 10**9) or (budget.max_rows and len(cur) + 1 > budget.max_rows)):
            done.append(cur)
            k = min(max(1, int(len(cur) * budget.overlap)), budget.max_overlap, len(cur)) if budget.overlap else 0
            cur = [*(cur[-k:] if k else []), i]
        else:
            cur = [*cur, i]
    by_start = {w[0]: w for w in [*done, cur] if w}
    return list(by_start.values())


def run(spark, costs, budget, times=None):
    rows = [("g", i, t, float(times[i] if times else 0)) for i, t in enumerate(costs)]
    df = spark.createDataFrame(rows, "g string, id bigint, cost bigint, at double")
    placed = S.greedy_segments(df, ["g"], ["id"], "cost", budget, "at")
    found = S.segments(placed, ["g"]).orderBy("seg_start").collect()
    return [(list(range(r["seg_start"], r["seg_end"] + 1)), r["state"]) for r in found]


@pytest.mark.parametrize(
    ("costs", "want"),
    [
        ([200, 200, 200, 50, 600, 10], [([1, 2], "closed"), ([2, 3, 4], "closed"), ([4, 5], "closed"), ([5, 6], "open")]),
        ([600, 10], [([1, 2], "open")]),
        ([500], [([1], "open")]),
        ([250, 250, 1], [([1, 2], "closed"), ([2, 3], "open")]),
        ([], []),
    ],
)
def test_windows(spark, costs, want):
    assert run(spark, costs, C.WINDOW) == want


def test_like_a_simulation(spark):
    rnd = random.Random(1)
    for _ in range(4):
        costs = [rnd.choice([5, 40, 200, 490, 700]) for _ in range(120)]
        for budget in (C.WINDOW, S.Budget(max_cost=500, overlap=0.5, max_overlap=2), S.Budget(max_cost=2000, max_rows=7, mode="max")):
            assert [w for w, _ in run(spark, costs, budget)] == windows(costs, budget)


def test_gap_and_hard_limit(spark):
    gap = S.Budget(max_cost=1000, max_gap_s=60)
    assert run(spark, [10, 10, 10], gap, [0, 60, 120.5]) == [([1, 2], "closed"), ([3], "open")]
    hard = S.Budget(max_cost=10**6, hard_cost=100)
    assert run(spark, [60, 200, 30, 50, 10], hard) == [([1, 2], "closed"), ([3], "open")]
    assert run(spark, [60, 50], hard) == [([1], "closed")]


def test_packing(spark):
    rows = [(i, t) for i, t in enumerate([50, 100, 200, 500])]
    df = spark.createDataFrame(rows, "chunk_id bigint, tokens bigint")
    packed = S.packed_batches(df, "tokens", "chunk_id", S.Budget(max_cost=1000, max_rows=32, mode="max"))
    assert sorted(r["count"] for r in packed.groupBy("batch").count().collect()) == [1, 3]
    same = spark.createDataFrame([(i, 100) for i in range(6)], "chunk_id bigint, tokens bigint")
    packed = S.packed_batches(same, "tokens", "chunk_id", S.Budget(max_cost=500, mode="max"))
    assert sorted(r["count"] for r in packed.groupBy("batch").count().collect()) == [1, 5]
    packed = S.packed_batches(same, "tokens", "chunk_id", S.Budget(max_cost=500, mode="max"), page_rows=2)
    assert [r["count"] for r in packed.groupBy("page", "batch").count().collect()] == [2, 2, 2]


def test_numbers(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("(id * 37) % 1000 as k")
    assert [r["number"] for r in S.numbered(df, ["k"]).orderBy("k").collect()] == list(range(1000))


def plain_fold(costs, times, budget, fold=None):
    fold = fold or S.Fold()
    return [fold.step(c, t, budget) for c, t in zip(costs, times, strict=True)], fold


BUDGETS = [
    C.WINDOW,
    C.AUTHOR,
    S.Budget(max_cost=60, overlap=0.4, max_overlap=3, hard_cost=75),
    S.Budget(max_cost=200, max_rows=6, overlap=0.5, max_overlap=4, max_gap_s=8),
    S.Budget(max_gap_s=9),
    S.Budget(max_cost=10**6, hard_cost=70),
    S.Budget(max_rows=5),
]


@pytest.mark.parametrize("k", range(len(BUDGETS)))
def test_pieces_of_a_long_group_equal_the_fold(spark, k):
    """Long groups in pieces of a few rows, short ones beside them, and from states, in one run and in two."""
    budget, rnd = BUDGETS[k], random.Random(k)
    rows, want = [], {}
    for g, n in (("hot", 400), ("warm", 61), ("cold", 9)):
        costs = [rnd.choice([0, 0, 1, 3, 20, 45, 80, 300] if g != "warm" else [0, 1, 30]) for _ in range(n)]
        times, t = [], 0.0
        for _ in range(n):
            t += rnd.choice([0.0, 1.0, 1.0, 2.0, 9.5])
            times.append(t)
        rows += [(g, i, c, x) for i, (c, x) in enumerate(zip(costs, times, strict=True))]
        got, _ = plain_fold(costs, times, budget)
        want |= {(g, i): x for i, x in enumerate(got) if x}
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, id bigint, cost bigint, at double").repartition(3)
    read = lambda found: {(r["g"], r["id"]): (r["pos"], r["seg_start"]) for r in found.where("state is null").collect()}
    assert read(S.folded(df, ["g"], ["id"], "cost", budget, "at", piece_rows=23)) == want
    first = S.folded(df.where("id < 137"), ["g"], ["id"], "cost", budget, "at", piece_rows=23)
    states = S.states_after(first, ["g"])
    second = S.folded(df.where("id >= 137"), ["g"], ["id"], "cost", budget, "at", states=states, piece_rows=23)
    assert read(first) | read(second) == want


def test_fold_is_dealt_to_many_tasks_however_few_its_bytes(spark):
    # Small shuffles are put together by their bytes, so that one task would fold all rows.
    df = spark.range(4000).select((F.col("id") % 40).alias("g"), "id", F.lit(1).alias("cost"))
    for size in (2, S.PIECE_ROWS):
        found = S.folded(df, ["g"], ["id"], "cost", S.Budget(max_cost=5), piece_rows=size)
        assert found.select(F.spark_partition_id()).distinct().count() >= 3


def test_pieces_of_many_groups_are_summed_up_in_one_pass():
    """One call for a partition, whose pieces may go on from batch to batch."""
    rows = pd.DataFrame([(g, p, 2 * p + r, g + r + 1, None, False) for g in range(9) for p in range(3) for r in range(2)], columns=["g", "_piece", "_rank", "_cost", "_time", "_halo"])
    run = S._summaries(["g", "_piece"], S.Budget(max_cost=5))
    for cuts in ([0, 54], [0, 1, 2, 31, 54]):
        got = pd.concat(run(rows.iloc[a:b] for a, b in zip(cuts, cuts[1:])))  # noqa: B905
        assert [(g, p, m, t) for g, p, m, t in zip(got["g"], got["_piece"], got["m"], got["total"], strict=True)] == [(g, p, 2, 2 * g + 3) for g in range(9) for p in range(3)]
