"""Packing documents into training sequences by vector best fit.

A document's tokens are followed by an end token.  Longer ones than a sequence
are cut into full sequences; what is left over, the first piece, may be shorter.
Every piece takes three resources of a sequence: tokens, a place (document
count), and attention cost (the square of its length).  Pieces go, largest
first, to the open sequence that fits best under all three: either with the
smallest weighted norm of what would remain (``residual``), or with the largest
weighted dot product of piece and room (``dot``).

Full pieces need no search.  The others are dealt into buckets by a hash, so
many that each has about ``bucket_pieces`` pieces; buckets are packed in
parallel, and only piece lengths are shuffled, never texts.

Defined results: null text is the empty text, so its one piece is the end token
alone.  Rows that repeat an id are packed one by one.  An empty table gives an
empty table.  Pieces of equal size go in order of id, so a rerun packs alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm._shared import text_or_empty, written
from panelspark.llm.pretokens import pretokens

#: Pieces that one bucket is meant to have.
BUCKET_PIECES = 40_000
#: Pre-tokens whose ids a worker remembers; it starts afresh beyond that.
MOST_REMEMBERED = 300_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Bytes that print in Latin-1 stand for themselves; the others take the code
    points from 256 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Ids(dict):
    """Pre-token to its ids as little-endian bytes, filled by the tokenizer's model on demand.

    Merges never cross pre-tokens, so a text's ids are those of its pre-tokens in
    a row; most words of a corpus are frequent ones and are looked up once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = _byte_alphabet()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MOST_REMEMBERED:
            self.clear()
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))
        ids = self[piece] = b"".join([t.id.to_bytes(4, "little") for t in found])
        return ids

    def of(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # special tokens cut across pre-tokens
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, pretokens(text)))


@lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _ids(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = ids_of.of(text) + end
                n = len(ids) // 4
                first = n % capacity or capacity
                starts = [0, *range(first, n, capacity)]
                ends = [*starts[1:], n]
                out[0] += [doc_id] * len(starts)
                out[1] += range(len(starts))
                out[2] += starts
                out[3] += [b - a for a, b in zip(starts, ends)]
                out[4] += [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, ends)]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(cut, PIECES)


class _Open:
    """Open sequences by the tokens they have room for, with the used rooms as bits of one number."""

    def __init__(self) -> None:
        self.by_room: dict[int, list[int]] = {}
        self.bits = 0

    def add(self, room: int, sequence: int) -> None:
        self.by_room.setdefault(room, []).append(sequence)
        self.bits |= 1 << room

    def remove(self, room: int, sequence: int) -> None:
        there = self.by_room[room]
        there.remove(sequence)
        if not there:
            del self.by_room[room]
            self.bits ^= 1 << room

    def tightest(self, least: int) -> Iterator[int]:
        """Rooms of ``least`` or more, smallest first."""
        bits = self.bits >> least
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1 + least
            bits ^= low

    def widest(self, least: int) -> Iterator[int]:
        """Rooms of ``least`` or more, largest first."""
        bits = self.bits >> least
        while bits:
            top = bits.bit_length() - 1
            yield top + least
            bits ^= 1 << top


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str = "residual") -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, packed in the given order.

    ``capacity`` and ``weights``: tokens, documents, attention cost.  Sequences
    are visited from the best token room on, and the search ends when tokens
    alone rule out anything better: the choice is the best of all open sequences.
    """
    tokens, places, attention = capacity
    w0, w1, w2 = (w / c / c for w, c in zip(weights, capacity))
    if rule not in ("residual", "dot"):
        raise ValueError("rule must be residual or dot")
    if len(lengths) and (lengths.max() > tokens or int(lengths.max()) ** 2 > attention or places < 1):
        raise ValueError("a piece is larger than a sequence")
    open_, free, cost = _Open(), [], []  # by sequence: places left, attention left
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        best, best_room, least_bad = -1, tokens, float("inf")
        for room in open_.tightest(n) if rule == "residual" else open_.widest(n):
            bad = w0 * (room - n) ** 2 if rule == "residual" else -w0 * n * room - weights[1] / places - w2 * n * n * attention
            if bad >= least_bad:
                break
            for s in open_.by_room[room]:
                if free[s] < 1 or cost[s] < n * n:
                    continue
                if rule == "residual":
                    bad = w0 * (room - n) ** 2 + w1 * (free[s] - 1) ** 2 + w2 * (cost[s] - n * n) ** 2
                else:
                    bad = -w0 * n * room - w1 * free[s] - w2 * n * n * cost[s]
                if bad < least_bad:
                    best, best_room, least_bad = s, room, bad
        if best < 0:
            best = len(free)
            free.append(places)
            cost.append(attention)
        else:
            open_.remove(best_room, best)
        sequence[i], offset[i] = best, tokens - best_room
        free[best] -= 1
        cost[best] -= n * n
        if best_room > n and free[best] and cost[best]:
            open_.add(best_room - n, best)
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = 1024, most_documents: int | None = None, most_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "residual", bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    Without ``most_documents`` and ``most_attention`` these two limits are those
    that ``capacity`` tokens imply, so tokens alone bind.
    """
    tops = (capacity, most_documents or capacity, most_attention or capacity**2)
    pieces = written(pieces, "pieces")
    full = F.col("length") == capacity
    buckets = max(1, round(pieces.where(~full).count() / bucket_pieces))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = best_fit(group["length"].to_numpy(), tops, weights, rule)
        return group.assign(sequence_id=sequence * buckets + group["bucket"], offset=offset).drop(columns="bucket")

    bucket = F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(buckets)).alias("bucket")
    packed = pieces.where(~full).select("*", bucket).groupBy("bucket").applyInPandas(fill, f"{PIECES}, sequence_id long, offset long")
    alone = pieces.where(full).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
