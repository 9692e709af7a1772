"""Cross-entropy difference between matched n-gram models (operator 5).

Two interpolated bigram models, one of the target texts and one of the background, are estimated with the
same vocabulary, the same smoothing and interpolation, and differ in their counts alone. A document's score
is the mean over its tokens of the target model's loss minus that of the background model: the lower, the
more the document is like the target.

Counts are exact and cover all documents: every word of the corpus and every pair of a word and the word
before it. A model gives ``BIGRAM`` times the share of the pair among the pairs of its first word, plus the
rest times the share of the word, to whose count ``ADD`` is added; after a word that the model has not
seen before another, the share of the word alone. So its probabilities of the corpus' words sum to one.
Every document is scored by what the others say: its own words and pairs are taken off the counts of the
models that they went into, and a target document gains nothing by being one. A copy of it is another one.

Neither model is held anywhere as a whole. Documents are taken in blocks of about ``BLOCK_TOKENS`` tokens.
A block counts its own words and pairs, deals them out by a hash to as many parts as the corpus needs, and
a part adds up what all blocks sent and answers each with the sums of what it sent: first for the words,
with their numbers, then for the pairs. A frequent word or pair is sent once by a block, however often it
occurs there, so none makes a part large.

A null or empty text has no tokens and null losses. Rows that repeat a doc_id count and are scored each;
a target id that is repeated counts once; a null doc_id is scored and never a target. Without target
documents the target model is uniform.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, maybe_broadcast, stored
from .decontaminate import words

#: Weight of the bigram in the interpolation, and what is added to each word's count.
BIGRAM, ADD = 0.6, 0.5
#: Tokens of a block of documents, except that a longer text is a block of its own.
BLOCK_TOKENS = 1_000_000
#: Words that blocks send to one part, and tokens whose pairs they send to one part, on average.
PART_WORDS, PART_TOKENS = 500_000, 3_000_000
#: Number of what stands before the first word; those of words are below.
START = (1 << 32) - 1

_BLOCKS = "block long, n_tokens long, n_target long, n_docs long, n_target_docs long, n_words long, head binary, tokens binary, words binary"
_SENT = "block long, part long, payload binary"
#: What a row for a block holds.
HEAD, TOKENS, NUMBERS, COUNTS, SUMS = range(5)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays, their bytes sorted by place and compressed."""
    out = []
    for x in arrays:
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
        out.append((x.dtype.str, len(x), pa.compress(raw, "zstd", asbytes=True) if raw else b""))
    return pickle.dumps(out)


def _unpacked(payload: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, data in pickle.loads(payload):
        width = np.dtype(kind).itemsize
        raw = np.frombuffer(pa.decompress(data, n * width, "zstd", asbytes=True) if n else b"", np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(width, n).T).reshape(-1).view(kind))
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _runs(sizes: np.ndarray) -> list[tuple[int, int]]:
    ends = np.cumsum(sizes)
    return list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))


def _table(rows: list[tuple], *kinds: tuple[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def _sent(rows: list[tuple]) -> pa.Table:
    return _table(rows, ("block", pa.int64()), ("part", pa.int64()), ("payload", pa.binary()))


def _blocks(block_tokens: int):
    """Documents in blocks, their words numbered within the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        made = 0

        def fresh() -> tuple[defaultdict, list, list]:
            index: defaultdict = defaultdict()
            index.default_factory = index.__len__
            return index, [], []

        def block() -> pa.RecordBatch:
            ids = np.concatenate([t for t, _, _ in held])
            sizes = np.array([len(t) for t, _, _ in held], np.int64)
            target = np.array([t for _, _, t in held], bool)
            known = np.array([d is not None for _, d, _ in held], bool)
            doc_ids = np.array([d or 0 for _, d, _ in held], np.int64)
            last = ids[np.cumsum(sizes)[sizes > 0] - 1]
            count = lambda x: np.bincount(x, minlength=len(index)).astype(np.int64)
            all_, of_target = count(ids), count(ids[np.repeat(target, sizes)])
            before, target_before = all_ - count(last), of_target - count(last[target[sizes > 0]])
            text = np.frombuffer(b" ".join(index), np.uint8)
            row = (
                first + made, len(ids), int(sizes[target].sum()), int((sizes > 0).sum()), int(((sizes > 0) & target).sum()), len(index),
                _packed(doc_ids, known, _narrow(sizes)), _packed(_narrow(ids), _narrow(sizes), target), _packed(text, *map(_narrow, (of_target, all_, target_before, before))),
            )
            kinds = [("block", pa.int64()), ("n_tokens", pa.int64()), ("n_target", pa.int64()), ("n_docs", pa.int64()), ("n_target_docs", pa.int64()), ("n_words", pa.int64()), ("head", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary())]
            return _table([row], *kinds).to_batches()[0]

        index, held, size = *fresh()[:2], 0
        for batch in batches:
            for doc_id, text, target in zip(batch["doc_id"].to_pylist(), batch["text"], batch["target"].to_pylist(), strict=True):
                ids = np.fromiter(map(index.__getitem__, words(text.as_py())), np.int64)
                held.append((ids.astype(np.int32), doc_id, target))
                size += len(ids)
                if size >= block_tokens:
                    yield block()
                    made += 1
                    index, held, size = *fresh()[:2], 0
        if held:
            yield block()

    return run


def _deal_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch["block"].to_pylist(), batch["words"], strict=True):
                text, *counts = _unpacked(payload.as_py())
                found = text.tobytes().split()
                if not found:
                    continue
                part = np.array(list(map(xxhash.xxh3_64_intdigest, found)), np.uint64) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                rows = []
                for k, (a, b) in enumerate(_runs(np.bincount(part.astype(np.int64), minlength=parts))):
                    if b > a:
                        of = order[a:b]
                        some = np.frombuffer(b" ".join([found[i] for i in of.tolist()]), np.uint8)
                        rows.append((block, k, _packed(_steps(of), some, *(c[of] for c in counts))))
                yield from _sent(rows).to_batches()

    return run


def _count_words(parts: int):
    """For one part of the words: their numbers and counts in the corpus, as each block needs them."""

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        got = [_unpacked(p) for p in table["payload"].to_pylist()]
        found = [w for x in got for w in x[1].tobytes().split()]
        coded = pa.array(found, pa.binary()).dictionary_encode()
        at, n = coded.indices.to_numpy(), len(coded.dictionary)
        if n * parts >= START:
            raise ValueError(f"{n} words in each of {parts} parts are more than can be numbered")
        totals = []
        for k in range(2, 6):
            total = np.zeros(n, np.int64)
            np.add.at(total, at, np.concatenate([x[k] for x in got]).astype(np.int64))
            totals.append(total)
        rows = []
        for i, (block, x, (a, b)) in enumerate(zip(table["block"].to_pylist(), got, _runs(np.array([len(x[0]) for x in got])), strict=True)):
            some = at[a:b]
            rows.append((block, part, _packed(x[0], _narrow(some.astype(np.int64) * parts + part)), _packed(*(_narrow(t[some]) for t in totals)), 0 if i else n))
        return _table(rows, ("block", pa.int64()), ("part", pa.int64()), ("numbers", pa.binary()), ("counts", pa.binary()), ("n_words", pa.int64()))

    return run


class _Block:
    """The tokens of a block and their pairs, made from the rows that hold them."""

    def __init__(self, table: pa.Table, parts: int):
        self.id = table["block"][0].as_py()
        self.sent: dict[int, dict[int, list[np.ndarray]]] = {k: {} for k in range(5)}
        for kind, part, payload in zip(table["kind"].to_pylist(), table["part"].to_pylist(), table["payload"], strict=True):
            self.sent[kind][part] = _unpacked(payload.as_py())
        tokens, numbers = self.sent[TOKENS][0], sorted(self.sent[NUMBERS].items())
        self.ids, self.sizes, self.target = tokens[0].astype(np.int64), tokens[1].astype(np.int64), tokens[2]
        self.local = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(x[0], dtype=np.int64) for _, x in numbers)])
        number = np.full(len(self.local) + 1, START, np.uint64)
        number[self.local] = np.concatenate([np.zeros(0, np.uint64), *(x[1].astype(np.uint64) for _, x in numbers)])
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.previous = np.empty_like(self.ids)
        self.previous[1:] = self.ids[:-1]
        self.previous[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = len(self.local)
        self.pairs, self.first, self.pair = np.unique((number[self.previous] << np.uint64(32)) | number[self.ids], return_index=True, return_inverse=True)
        mixed = (self.pairs ^ (self.pairs >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        part = (((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        #: The pairs of each part, ascending.
        self.of_part = [order[a:b] for a, b in _runs(np.bincount(part, minlength=parts))]


def _deal_pairs(parts: int):
    """The pairs of a block and how often they occur in it and in its target documents."""

    def run(table: pa.Table) -> pa.Table:
        b = _Block(table, parts)
        counts = [np.bincount(b.pair[some], minlength=len(b.pairs)) for some in (slice(None), b.target[b.doc])]
        return _sent([(b.id, k, _packed(_steps(b.pairs[s]), *(_narrow(c[s]) for c in counts))) for k, s in enumerate(b.of_part) if len(s)])

    return run


def _count_pairs(table: pa.Table) -> pa.Table:
    """For one part of the pairs: their counts in the corpus and in the target, for each block in its order."""
    got = [_unpacked(p) for p in table["payload"].to_pylist()]
    distinct, at = np.unique(np.concatenate([np.cumsum(x[0]) for x in got]), return_inverse=True)
    totals = []
    for k in (1, 2):
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, at, np.concatenate([x[k] for x in got]).astype(np.int64))
        totals.append(total)
    runs = _runs(np.array([len(x[0]) for x in got]))
    return _sent([(block, part, _packed(*(_narrow(t[at[a:b]]) for t in totals))) for block, part, (a, b) in zip(table["block"].to_pylist(), table["part"].to_pylist(), runs, strict=True)])


def _scores(parts: int, n_words: int, n_docs: tuple[int, int], n_tokens: tuple[int, int]):
    """The mean losses of a block's documents under the models of the target and of all documents."""

    def run(table: pa.Table) -> pa.Table:
        b = _Block(table, parts)
        doc_ids, known, _ = b.sent[HEAD][0]
        n = len(b.local)
        of_pair = np.zeros((2, len(b.pairs)), np.int64)
        for k, (total, of_target) in b.sent[SUMS].items():
            of_pair[:, b.of_part[k]] = of_target, total
        of_word, before = np.zeros((2, n + 1), np.int64), np.zeros((2, n + 1), np.int64)
        if n:
            for k, to in enumerate((of_word[0], of_word[1], before[0], before[1])):
                to[b.local] = np.concatenate([x[k] for _, x in sorted(b.sent[COUNTS].items())])
        before[:, n] = n_docs
        # What a document has itself: pairs, words, and words before another.
        entry, own_pair = np.unique(b.doc * max(len(b.pairs), 1) + b.pair, return_counts=True)
        doc, pair = entry // max(len(b.pairs), 1), entry % max(len(b.pairs), 1)
        held, own = np.unique(b.doc * (n + 1) + b.ids, return_counts=True)
        has = lambda word: own[np.minimum(np.searchsorted(held, doc * (n + 1) + word), len(own) - 1)]
        word, context = b.ids[b.first[pair]], b.previous[b.first[pair]]
        last = np.full(len(b.sizes), -1)
        last[b.sizes > 0] = b.ids[np.cumsum(b.sizes)[b.sizes > 0] - 1]
        own_word = has(word) if n else word
        own_before = np.where(context == n, 1, has(context) - (last[doc] == context)) if n else context
        means = []
        for k, inside in enumerate((b.target[doc].astype(np.int64), np.ones(len(doc), np.int64))):
            alone = (of_word[k, word] - inside * own_word + ADD) / (n_tokens[k] - inside * b.sizes[doc] + ADD * n_words)
            seen = before[k, context] - inside * own_before
            p = np.where(seen > 0, BIGRAM * (of_pair[k, pair] - inside * own_pair) / np.maximum(seen, 1) + (1 - BIGRAM) * alone, alone)
            means.append(np.bincount(doc, weights=-np.log(p) * own_pair, minlength=len(b.sizes)) / np.maximum(b.sizes, 1))
        none = b.sizes == 0
        return pa.table({"doc_id": pa.array(doc_ids, mask=~known), "n_tokens": b.sizes, "target_loss": pa.array(means[0], mask=none), "background_loss": pa.array(means[1], mask=none)})

    return run


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference for every row of ``docs``, the target being the rows whose id is in ``target_ids``."""
    ids = target_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("target", F.lit(True))
    marked = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(maybe_broadcast(stored(ids, "targets")), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    blocks = stored(marked.mapInArrow(_blocks(BLOCK_TOKENS), _BLOCKS), "blocks")
    n_tokens, n_target, n_docs, n_target_docs, n_sent = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_target", "n_docs", "n_target_docs", "n_words"))).first()
    parts = n_sent // PART_WORDS + 1
    dealt = blocks.select("block", "words").mapInArrow(_deal_words(parts), _SENT)
    known = stored(dealt.groupBy("part").applyInArrow(_count_words(parts), "block long, part long, numbers binary, counts binary, n_words long"), "words")
    n_words = known.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]

    def rows(df: DataFrame, kind: int, payload: str = "payload", part=None) -> DataFrame:
        return df.select("block", F.lit(kind).alias("kind"), (F.lit(0).cast("long") if part is None else F.col(part)).alias("part"), F.col(payload).alias("payload"))

    tokens = rows(blocks, TOKENS, "tokens").union(rows(known, NUMBERS, "numbers", "part"))
    parts = n_tokens // PART_TOKENS + 1
    pairs = tokens.groupBy("block").applyInArrow(_deal_pairs(parts), _SENT)
    sums = pairs.groupBy("part").applyInArrow(_count_pairs, _SENT)
    every = tokens.union(rows(blocks, HEAD, "head")).union(rows(known, COUNTS, "counts", "part")).union(rows(sums, SUMS, part="part"))
    losses = every.groupBy("block").applyInArrow(_scores(parts, n_words, (n_target_docs, n_docs), (n_target, n_tokens)), "doc_id long, n_tokens long, target_loss double, background_loss double")
    return losses.withColumn("difference", F.round(F.col("target_loss") - F.col("background_loss"), 6)).withColumns({c: F.round(c, 6) for c in ("target_loss", "background_loss")})
