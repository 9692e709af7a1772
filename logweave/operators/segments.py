"""Greedy segmentation of ordered rows under a budget, the core of all chunkers and of batch packing.

A segment is known by the position of its first row. The fold reads each group's rows in order in one pass
and keeps a bounded number of running values; rows are not gathered: a task sorts its partition and
streams it. A long group is cut into pieces that are folded at once, see ``folded``. Only keys, order, cost and time travel; texts
are joined afterwards.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


@dataclass(frozen=True)
class Budget:
    """When a segment ends. ``mode`` sum: the costs of its rows add up; max: its rows times their largest cost."""

    max_cost: int | None = None
    max_rows: int | None = None
    max_gap_s: float | None = None
    mode: str = "sum"
    #: Share of a full segment that the next one repeats, and at most so many rows; no overlap without a share.
    overlap: float | None = None
    max_overlap: int = 10
    #: A row that would take a segment beyond this ends it and is itself left out.
    hard_cost: int | None = None


@dataclass
class Fold:
    """State of one group: the open segment's first position, size and costs."""

    position: int = 0
    start: int = 0
    total: int = 0
    largest: int = 0
    last_time: float | None = None
    recent: deque | None = None

    def step(self, cost: int, time: float | None, b: Budget) -> tuple[int | None, int] | None:
        """Take a row; its position and the first position of its segment.

        A row that is left out has no position, and the segment that it ended; None if it ended none.
        """
        n = self.position - self.start + 1 if self.start else 0
        if b.hard_cost is not None and (cost > b.hard_cost or (n and self.total + cost > b.hard_cost)):
            ended = self.start if n and cost <= b.hard_cost else 0
            if ended:
                self.start, self.total, self.largest = 0, 0, 0
            return (None, ended) if ended else None
        size = (n + 1) * max(self.largest, cost) if b.mode == "max" else self.total + cost
        over = n > 0 and ((b.max_cost is not None and size > b.max_cost) or (b.max_rows is not None and n + 1 > b.max_rows) or (b.max_gap_s is not None and time is not None and self.last_time is not None and time - self.last_time > b.max_gap_s))
        self.position += 1
        if self.recent is None:
            self.recent = deque(maxlen=max(b.max_overlap, 1))
        if n and not over:
            self.total, self.largest = self.total + cost, max(self.largest, cost)
        else:
            again = min(max(1, int(n * b.overlap)), b.max_overlap, n) if over and b.overlap is not None else 0
            kept = list(self.recent)[len(self.recent) - again :] if again else []
            self.start, self.total, self.largest = self.position - again, cost + sum(kept), max([cost, *kept])
        self.recent.append(cost)
        self.last_time = time
        return self.position, self.start


#: What a fold knows between two rows of a group.
STATE = "struct<position:bigint,start:bigint,total:bigint,largest:bigint,last_time:double,recent:array<bigint>>"
#: Rows of a group that one task folds; a longer group is folded in pieces of so many rows, all at once.
PIECE_ROWS = 200_000


def _began(state, budget: Budget) -> Fold:
    recent, time = deque((int(c) for c in state["recent"]), maxlen=max(budget.max_overlap, 1)), state["last_time"]
    return Fold(int(state["position"]), int(state["start"]), int(state["total"]), int(state["largest"]), None if time is None or time != time else float(time), recent)


def _told(fold: Fold) -> dict:
    return {"position": fold.position, "start": fold.start, "total": fold.total, "largest": fold.largest, "last_time": fold.last_time, "recent": [int(c) for c in fold.recent] if fold.recent is not None else []}


def _folded(keys: list[str], columns: list[str], budget: Budget):
    """Rows by key and order, a key's state (if there is one) before them; after a key's rows comes its new state."""

    def told(ended: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame([k for k, _ in ended], columns=keys).reindex(columns=columns)
        none = pd.array([None] * len(ended), "Int64")
        return rows.assign(pos=none, seg_start=none, state=pd.Series([_told(f) for _, f in ended], dtype=object))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, fold = None, Fold()
        for pdf in batches:
            out, positions, starts, ended = [], [], [], []
            times, costs, states = pdf["_time"].tolist(), pdf["_cost"].tolist(), pdf["_state"].tolist()
            for i, key in enumerate(zip(*[pdf[k].tolist() for k in keys], strict=True)):
                if key != group:
                    if group is not None:
                        ended.append((group, fold))
                    group, fold = key, Fold()
                if states[i] is not None:
                    fold = _began(states[i], budget)
                    continue
                got = fold.step(int(costs[i]), None if pd.isna(times[i]) else times[i], budget)
                if got:
                    out.append(i)
                    positions.append(got[0])
                    starts.append(got[1])
            yield pdf.iloc[out][columns].assign(pos=pd.array(positions, "Int64"), seg_start=pd.array(starts, "Int64"), state=None)
            if ended:
                yield told(ended)
        if group is not None:
            yield told([(group, fold)])

    return run


def _again(n, budget: Budget):
    """Rows of a full segment of ``n`` that the next one repeats."""
    return np.minimum(np.minimum(np.maximum(1, np.floor(n * budget.overlap).astype(np.int64)), budget.max_overlap), n) if budget.overlap is not None else np.zeros_like(n)


_SUMMARY = "m bigint, total bigint, first_time double, last_time double, gap bigint, head array<bigint>, recent array<bigint>, exit_n array<bigint>, exit_total array<bigint>, exit_drops array<bigint>"


def _summary(budget: Budget):
    """What a piece does to whatever segment it is entered with.

    A segment that begins in the piece is known by the row that ended the one before it and by how many rows it
    repeats; where it ends is a search in the running cost, for all of them at once, and the next one follows. Doubling these
    steps leads every such start to the segment that is open at the end of the piece. Only the rows at which an open segment may
    first end are told, with where each leads.
    """
    states = (budget.max_overlap if budget.overlap is not None else 0) + 1

    def run(costs: np.ndarray, times: np.ndarray, held: int) -> dict:
        times = times[held:]
        m, run_cost = len(times), np.concatenate([[0], np.cumsum(costs)])
        gap = np.zeros(m + 1, bool)
        if budget.max_gap_s is not None:
            gap[1:m] = np.diff(times) > budget.max_gap_s
        next_gap = np.minimum.accumulate(np.where(gap, np.arange(m + 1), m)[::-1])[::-1]
        first = np.repeat(np.arange(m), states)
        start = np.maximum(held + first - np.tile(np.arange(states), m), 0)
        base = run_cost[start]

        def past(limit: int, since) -> np.ndarray:
            return np.searchsorted(run_cost, since + limit, side="right") - 1 - held

        stops = [next_gap[first + 1]]
        if budget.max_cost is not None:
            stops.append(past(budget.max_cost, base))
        if budget.hard_cost is not None:
            stops.append(past(budget.hard_cost, base))
        if budget.max_rows is not None:
            stops.append(start + budget.max_rows - held)
        stop = np.minimum(np.maximum(np.minimum.reduce(stops), first + 1), m)
        at = np.minimum(stop, m - 1)
        hard = (stop < m) & (run_cost[held + at + 1] - base > budget.hard_cost) if budget.hard_cost is not None else np.zeros(len(stop), bool)
        fresh = m * states
        onward = np.where(hard, np.minimum((stop + 1) * states, fresh), np.where(stop < m, stop * states + _again(held + stop - start, budget), np.arange(fresh)))
        onward, drops = np.append(onward, fresh), np.append(hard.astype(np.int64), 0)
        while True:
            further = onward[onward]
            if (further == onward).all():
                break
            drops, onward = drops + drops[onward], further
        begin = np.append(start, held + m)[onward]
        after = [held]
        for limit in (budget.max_cost, budget.hard_cost):
            after += [int(past(limit, run_cost[held])) + held] if limit is not None else []
        last = min([m, int(next_gap[min(1, m)]), *(x - held for x in after[1:]), *([budget.max_rows - 1] if budget.max_rows is not None else [])])
        heads = min(last + 2, m) * states
        return {
            "m": m, "total": int(run_cost[-1] - run_cost[held]), "first_time": times[0], "last_time": times[-1], "gap": int(next_gap[min(1, m)]),
            "head": (run_cost[held + 1 :] - run_cost[held])[: last + 1].tolist(), "recent": costs[-max(budget.max_overlap, 1) :].tolist(),
            "exit_n": (held + m - begin)[:heads].tolist(), "exit_total": (run_cost[-1] - run_cost[begin])[:heads].tolist(), "exit_drops": drops[:-1][:heads].tolist(),
        }

    return run


def _summaries(by: list[str], budget: Budget):
    """Rows by piece and rank, those repeated from the piece before (``_halo``) first: a row for each piece. One piece at a time is held."""
    summary = _summary(budget)

    def told(key: tuple, parts: list[tuple]) -> dict:
        costs, times, halo = parts[0] if len(parts) == 1 else (np.concatenate(c) for c in zip(*parts, strict=True))
        return dict(zip(by, key, strict=True)) | summary(costs, times, int(halo.sum()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, parts = None, []
        for pdf in batches:
            if pdf.empty:
                continue
            names, out = [pdf[k].to_numpy() for k in by], []
            facts = pdf["_cost"].to_numpy(np.int64), pdf["_time"].to_numpy(float), pdf["_halo"].to_numpy(bool)
            edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(pdf)], strict=True):
                key = tuple(x[lo] for x in names)
                if key != piece:
                    if parts:
                        out.append(told(piece, parts))
                    piece, parts = key, []
                parts.append(tuple(f[lo:hi] for f in facts))
            if out:
                yield pd.DataFrame(out)
            parts = [tuple(f.copy() for f in part) for part in parts]
        if parts:
            yield pd.DataFrame([told(piece, parts)])

    return run


def _passed(fold: Fold, s, budget: Budget) -> Fold:
    """The state after a piece, by its summary."""
    n, m, head = fold.position - fold.start + 1 if fold.start else 0, int(s["m"]), np.asarray(s["head"])
    states = (budget.max_overlap if budget.overlap is not None else 0) + 1
    stop, again, drops = 0, 0, 0
    if n:
        broken = budget.max_gap_s is not None and fold.last_time is not None and s["first_time"] - fold.last_time > budget.max_gap_s
        stops = [m, 0 if broken else int(s["gap"])]
        stops += [int(np.searchsorted(head, limit - fold.total, side="right")) for limit in (budget.max_cost, budget.hard_cost) if limit is not None]
        stops += [max(0, budget.max_rows - n)] if budget.max_rows is not None else []
        stop = min(stops)
        if stop < m and budget.hard_cost is not None and fold.total + int(head[stop]) > budget.hard_cost:
            stop, drops = stop + 1, 1
        elif stop < m:
            again = int(_again(np.array(n + stop), budget))
        elif not drops:
            return Fold(fold.position + m, fold.start, fold.total + int(s["total"]), 0, s["last_time"], s["recent"])
    kept, total = 0, 0
    if stop < m:
        at = stop * states + again
        kept, total, drops = int(s["exit_n"][at]), int(s["exit_total"][at]), drops + int(s["exit_drops"][at])
    position = fold.position + m - drops
    return Fold(position, position - kept + 1 if kept else 0, total, 0, s["last_time"], s["recent"])


def _entered(keys: list[str], budget: Budget):
    """Summaries by key and piece, a key's state before them: the state that each piece is entered with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, fold = None, Fold()
        for pdf in batches:
            out, states = [], []
            for i, (key, s) in enumerate(zip(zip(*[pdf[k].tolist() for k in keys], strict=True), pdf.to_dict("records"), strict=True)):
                if key != group:
                    group, fold = key, Fold()
                if s["_state"] is not None:
                    fold = _began(s["_state"], budget)
                    continue
                out.append(i)
                states.append(_told(fold))
                fold = _passed(fold, s, budget)
            yield pdf.iloc[out][[*keys, "_piece"]].assign(_state=pd.Series(states, dtype=object, index=pdf.index[out]))

    return run


def _fields(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def _dealt(df: DataFrame) -> int:
    """Partitions of a fold. Its rows are few bytes but much work, and without a number Spark would put them together by their bytes."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _pieces(rows: DataFrame, keys: list[str], order: list[str], budget: Budget, states: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows of long groups with ``_piece``, and the state that each piece is entered with."""
    counted = numbered(rows, [*keys, *order])
    firsts = counted.groupBy(*keys).agg(F.min("number").alias("_first"))
    ranked = counted.join(firsts, keys).withColumn("_rank", F.col("number") - F.col("_first")).drop("number", "_first")
    ranked = stored(ranked.withColumn("_piece", F.floor(F.col("_rank") / size)), "pieces")
    repeated = budget.max_overlap if budget.overlap is not None else 0
    facts = [*keys, "_piece", "_rank", "_cost", "_time", "_halo"]
    own = ranked.withColumn("_halo", F.lit(False)).select(*facts)
    before = ranked.where(F.pmod("_rank", F.lit(size)) >= size - repeated).withColumn("_piece", F.col("_piece") + 1).withColumn("_halo", F.lit(True)).select(*facts)
    before = before.join(ranked.select(*keys, "_piece").distinct(), [*keys, "_piece"], "left_semi")
    recent = F.slice(F.col("_state.recent"), F.greatest(F.lit(1), F.size("_state.recent") - repeated + 1), F.lit(max(repeated, 1)))
    kept = states.where(F.lit(repeated > 0)).select(*keys, F.posexplode(recent).alias("_rank", "_cost"))
    kept = kept.select(*keys, F.lit(0).cast("bigint").alias("_piece"), (F.col("_rank") - 1000).cast("bigint").alias("_rank"), "_cost", F.lit(None).cast("double").alias("_time"), F.lit(True).alias("_halo"))
    by = [*keys, "_piece"]
    told = own.unionByName(before).unionByName(kept)
    named = _fields(ranked, by)
    summaries = told.repartition(_dealt(rows), *by).sortWithinPartitions(*by, "_rank").mapInPandas(_summaries(by, budget), f"{named}, {_SUMMARY}")
    chain = summaries.withColumn("_state", F.lit(None).cast(STATE)).unionByName(states.select(*keys, F.lit(-1).cast("bigint").alias("_piece"), "_state"), allowMissingColumns=True)
    entries = chain.repartition(_dealt(rows), *keys).sortWithinPartitions(*by).mapInPandas(_entered(keys, budget), f"{named}, _state {STATE}")
    return ranked.drop("_rank"), entries


def folded(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: Budget, time: str | None = None, states: DataFrame | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``greedy_segments`` that goes on from ``states`` (keys, state), with a row for each key of ``df`` that has its state afterwards.

    A group of more than ``piece_rows`` is cut into pieces, and each piece is folded by a task of its own: a first pass sums up
    what each piece does to a segment that is open before it, these summaries are passed through in order, and
    a second pass folds the pieces from the states so found.
    """
    columns = [*keys, *order]
    rows = df.select(*columns, F.col(cost).cast("bigint").alias("_cost"), (F.col(time).cast("double") if time else F.lit(None).cast("double")).alias("_time"))
    rows = rows if budget.hard_cost is None else rows.where(F.col("_cost") <= budget.hard_cost)
    none = df.sparkSession.createDataFrame([], f"{_fields(rows, keys)}, state {STATE}")
    before = (states if states is not None else none).select(*keys, F.col("state").alias("_state"))
    if states is not None:
        before = before.join(rows.select(*keys).distinct(), keys, "left_semi")
    rows = rows.withColumn("_piece", F.lit(0).cast("bigint"))
    if budget.mode == "sum":
        long = rows.groupBy(*keys).count().where(F.col("count") > piece_rows).select(*keys)
        if not long.isEmpty():
            long = stored(long, "long-groups")
            cut, entries = _pieces(rows.drop("_piece").join(long, keys, "left_semi"), keys, order, budget, before.join(long, keys, "left_semi"), piece_rows)
            rows = rows.join(long, keys, "left_anti").unionByName(cut)
            before = before.join(long, keys, "left_anti").withColumn("_piece", F.lit(0).cast("bigint")).unionByName(entries)
    rows = rows.withColumn("_state", F.lit(None).cast(STATE)).unionByName(before, allowMissingColumns=True).withColumn("_piece", F.coalesce("_piece", F.lit(0).cast("bigint")))
    by = [*keys, "_piece"]
    dealt = rows.repartition(_dealt(df), *by).sortWithinPartitions(*by, F.col("_state").isNull(), *order)
    out = dealt.mapInPandas(_folded(by, [*by, *order], budget), f"{_fields(rows, [*by, *order])}, pos bigint, seg_start bigint, state {STATE}")
    return out


def states_after(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state: what ``folded`` says that the next call may go on from."""
    return found.where("state is not null").groupBy(*keys).agg(F.max_by("state", "_piece").alias("state"))


def greedy_segments(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: Budget, time: str | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows of ``df`` (keys and order columns) with ``pos`` in their group and ``seg_start``, the first position of their segment.

    ``time`` is in seconds and needed for a gap. Of the rows that a hard limit leaves out, those that ended a
    segment have a null ``pos``; the others are absent.
    """
    found = folded(df, keys, order, cost, budget, time, piece_rows=piece_rows)
    return found.where("state is null").select(*keys, *order, "pos", "seg_start")


def segments(placed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seg_start, seg_end, state: each segment once, its last state wins; the last of a group is open
    unless a hard limit ended it."""
    ends = placed.groupBy(*keys, "seg_start").agg(F.max("pos").alias("seg_end"), F.bool_or(F.col("pos").isNull()).alias("_ended"))
    last = placed.groupBy(*keys).agg(F.max("seg_start").alias("_last"))
    return ends.join(last, keys).select(*keys, "seg_start", "seg_end", F.when((F.col("seg_start") == F.col("_last")) & ~F.col("_ended"), "open").otherwise("closed").alias("state"))


def members(placed: DataFrame, found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, seg_start, seg_end, state, pos and order columns: every row of every segment, by an equi-join."""
    spread = found.withColumn("pos", F.explode(F.sequence("seg_start", "seg_end")))
    return spread.join(placed.select(*keys, "pos", *order), [*keys, "pos"])


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``number``, the rank of each row from 0 over the whole table, without one task for all.

    Rows are dealt by ranges of the order and written, so that they are the same when they are counted and
    when they are numbered; the driver learns one count for each partition.
    """
    spark = df.sparkSession
    ordered = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ordered = stored(ordered, "numbered")
    before, starts = 0, []
    for r in sorted(ordered.groupBy("_part").count().collect()):
        starts.append((r["_part"], before))
        before += r["count"]
    base = F.broadcast(spark.createDataFrame(starts, "_part int, _base bigint"))  # a row for each partition
    return ordered.join(base, "_part").withColumn("number", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


#: Rows of a page of packing (a fixed value).
PAGE_ROWS = 5000


def packed_batches(df: DataFrame, cost: str, tie: str, budget: Budget, page_rows: int = PAGE_ROWS) -> DataFrame:
    """page, tie, cost, batch: rows by ascending cost, packed under rows times largest cost.

    Packing begins anew at every page of the whole order, and pages are packed in parallel: no fold sees more
    than ``page_rows`` rows, and at the end of a page there may be one batch that is not full.
    """
    rows = df.select(F.col(tie), F.col(cost).cast("bigint").alias(cost))
    rows = numbered(rows, [cost, tie]).withColumn("page", F.floor(F.col("number") / page_rows)).drop("number")
    placed = greedy_segments(rows, ["page"], [cost, tie], cost, budget)
    return placed.select("page", tie, cost, F.col("seg_start").alias("batch"))
