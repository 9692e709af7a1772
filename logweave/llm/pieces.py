"""SentencePiece encoding and decoding by a Viterbi search over an Aho-Corasick automaton (operator 6).

The pieces and scores come from a SentencePiece model file; nothing is trained. The automaton holds all
pieces. It reads a string once; at each position its output links give every piece that ends there, and
each relaxes what is best for the prefix up to that position.

For a unigram model the best is the sum of scores; of equal sums the path whose last piece is longest wins.
The scores of a BPE model are not to be summed: they are the order in which pieces are merged. There a
prefix has one last piece, the one that the merges leave beside the last piece of the prefix before it.
Whether they do is seen by taking both apart again, the latest merge first: no merge across the place
between them may come before the one that is undone. The ids are then those of the library.

A character at which no piece ends is written as its UTF-8 bytes, which have pieces of their own and, in
a unigram model, score below any other.

A space becomes the mark U+2581, and one is put before a text. No piece has a mark after another
character (this is checked when the model is loaded), so the path of a text is made of those of its
mark-led units, and a unit is searched once for as long as it is cached. A literal U+2581 is written as
bytes, where the library takes it for a space, so that decoding gives back every text exactly.

A null or empty text has no ids, and decodes to an empty text. Repeated rows are each encoded, a null
doc_id is kept, very long texts and words are searched in time linear in their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, held

MARK = "▁"
_LITERAL = "￾"  # stands for a literal mark while matching; no piece has it
#: Units, and pairs of pieces, that a worker keeps.
CACHE_UNITS, CACHE_PAIRS = 200_000, 200_000
#: Texts whose ids a task holds at once.
AT_ONCE = 500
_NONE = -float("inf")
#: Last piece of a prefix whose last character is written as bytes, or that is empty.
_APART = -1
#: Two pieces are one number, the first shifted by so many bits.
_PAIR_BITS = 24


def merged(parts: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Pieces that merging by rank leaves, the leftmost of equals first, and the two parts of the last merge."""
    last = None
    while len(parts) > 1:
        ranks = [rank.get(a + b, len(rank)) for a, b in zip(parts, parts[1:])]  # noqa: B905
        k = min(range(len(ranks)), key=ranks.__getitem__)
        if ranks[k] == len(rank):
            break
        last = parts[k], parts[k + 1]
        parts = [*parts[:k], parts[k] + parts[k + 1], *parts[k + 2 :]]
    return parts, last


class Codec:
    """``bpe``: whether the model is a BPE one; None: it is if its scores are the whole numbers that training gives merges."""

    def __init__(self, path: str, bpe: bool | None = None):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.bytes = np.full(256, -1, np.int64)
        self.text: list[bytes] = [b""] * self.size
        pieces: dict[str, int] = {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK) or _LITERAL in piece:
                    raise ValueError(f"piece {i} has a mark inside: {piece!r}")
                pieces[piece] = i
                self.text[i] = piece.replace(MARK, " ").encode()
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces")
        self.score = {i: model.get_score(i) for i in pieces.values()}
        self.bpe = all(x == int(x) for x in self.score.values()) if bpe is None else bpe
        self.byte_score = min(self.score.values()) - 10.0
        if self.bpe:
            pieces = self._take_apart(pieces)
        self.matcher = ahocorasick.Automaton()
        for piece, i in pieces.items():
            self.matcher.add_word(piece, (i, len(piece)))
        self.matcher.make_automaton()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def _take_apart(self, pieces: dict[str, int]) -> dict[str, int]:
        """Sets how each piece came about; gives the pieces that merges can reach, and the characters they begin with."""
        rank = {p: k for k, p in enumerate(sorted((p for p in pieces if len(p) > 1), key=lambda p: (-self.score[pieces[p]], pieces[p])))}
        ids = dict(pieces)
        for c in sorted({c for p in pieces for c in p} - set(pieces)):  # part of pieces without being one
            ids[c] = self.size + len(ids) - len(pieces)
        made = {p: last for p, (left, last) in ((p, merged(list(p), rank)) for p in rank) if len(left) == 1}
        out = {p: i for p, i in ids.items() if len(p) == 1 or p in made}
        n = max(ids.values()) + 1
        self.rank, self.left, self.right = [-1] * n, [_APART] * n, [_APART] * n
        self.joined: dict[int, int] = {}
        for p, (a, b) in made.items():
            i = ids[p]
            self.rank[i], self.left[i], self.right[i] = rank[p], ids[a], ids[b]
            if max(self.rank[ids[a]], self.rank[ids[b]]) > rank[p] or len(a) > 1 and a not in made or len(b) > 1 and b not in made:
                raise ValueError(f"piece {i} is merged before its parts are")
        for p in made:
            for k in range(1, len(p)):
                if p[:k] in out and p[k:] in out:
                    self.joined[ids[p[:k]] << _PAIR_BITS | ids[p[k:]]] = rank[p]
        return out

    def beside(self, a: int, b: int) -> bool:
        """Whether merges leave pieces a and b side by side."""
        pair = a << _PAIR_BITS | b
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._beside(a, b)
        return known

    def _beside(self, a: int, b: int) -> bool:
        rank, before = self.rank, len(self.rank)  # merges of a lower rank than ``before`` would have come first
        while True:
            if self.joined.get(a << _PAIR_BITS | b, before) < before:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                before, a = rank[a], self.right[a]
            else:  # of two equal merges the right one is the later, and one across them would have come before it
                before, b = rank[b] + 1, self.left[b]

    def search(self, original: str) -> list[int]:
        """Ids of a string, its spaces read as marks and its own marks as bytes."""
        unit = original.replace(MARK, _LITERAL).replace(" ", MARK)
        size_of, id_of = self._merges(unit) if self.bpe else self._best(unit, original)
        out: list[int] = []
        e = len(unit)
        while e:
            size, i = size_of[e], id_of[e]
            if 0 <= i < self.size:
                out.append(i)
            else:
                out.extend(int(self.bytes[b]) for b in reversed(original[e - 1].encode("utf-8", "surrogatepass")))
            e -= size
        return out[::-1]

    def _merges(self, unit: str) -> tuple[list[int], list[int]]:
        """For each prefix the size and the id of its last piece, for a BPE model."""
        n = len(unit)
        size_of, id_of = [1] * (n + 1), [_APART] * (n + 1)
        for end, (i, size) in self.matcher.iter(unit):
            last = id_of[end + 1 - size]
            if last == _APART or self.beside(last, i):
                size_of[end + 1], id_of[end + 1] = size, i
        return size_of, id_of

    def _best(self, unit: str, original: str) -> tuple[list[int], list[int]]:
        """For each prefix the size and the id of its last piece on the path of the best sum of scores."""
        n = len(unit)
        best = [0.0] + [_NONE] * n  # score of each prefix
        size_of, id_of = [1] * (n + 1), [_APART] * (n + 1)
        done = 0  # prefixes up to here have their final score
        for end, (i, size) in self.matcher.iter(unit):
            start = end + 1 - size
            while done < start:  # a character that ends no piece
                done += 1
                if best[done] == _NONE:
                    best[done] = best[done - 1] + self.byte_score * len(original[done - 1].encode("utf-8", "surrogatepass"))
            score = self.score[i] + best[start]
            if score > best[end + 1]:
                best[end + 1], size_of[end + 1], id_of[end + 1] = score, size, i
        return size_of, id_of

    def ids_of(self, unit: str) -> bytes:
        ids = np.array(self.search(" " + unit), self.dtype).tobytes()
        if len(unit) <= 64:
            if len(self.cache) >= CACHE_UNITS:
                self.cache.clear()
            self.cache[unit] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        units = text.split(" ")
        if "" in units:  # a run of spaces belongs to what follows
            merged, lead = [], ""
            for u in units[:-1]:
                if u:
                    merged.append(lead + u)
                    lead = ""
                else:
                    lead += " "
            units = [*merged, lead + units[-1]]
        got = list(map(self.cache.get, units))
        if None in got:
            for k, v in enumerate(got):
                if v is None:
                    got[k] = self.cache.get(units[k]) or self.ids_of(units[k])
        return np.frombuffer(b"".join(got), self.dtype).astype(np.int32)

    def decode(self, ids) -> str:
        return b"".join(map(self.text.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def codec(path: str) -> Codec:
    kept = held("pieces")
    if path not in kept:
        kept.clear()
        kept[path] = Codec(path)
    return kept[path]


def decode_column(path: str):
    """A column function from ids to their text; null for null."""

    def decode(ids: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([None if x is None else c.decode(x.tolist() if isinstance(x, np.ndarray) else x) for x in ids], index=ids.index, dtype=object)

    return F.pandas_udf(decode, T.StringType())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text, ids for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for pdf in batches:
            for part in (pdf.iloc[i : i + AT_ONCE] for i in range(0, len(pdf), AT_ONCE)):
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "text": part["text"].array, "ids": [c.encode(x) for x in part["text"]]})

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with a column decoded."""
    return encoded.withColumn("decoded", decode_column(path)("ids"))


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), round_trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in (batch.slice(i, AT_ONCE) for i in range(0, batch.num_rows, AT_ONCE)):
                texts = [x or "" for x in part["text"].to_pylist()]
                ids = [c.encode(x) for x in texts]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                same = [c.decode(x.tolist()) == text for x, text in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(map(len, ids), pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
