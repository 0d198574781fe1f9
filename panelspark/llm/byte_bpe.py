"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves every pre-token
that is itself a vocabulary entry.  Each entry has a slot of its own and there
are no empty slots; a lookup is two array reads and one comparison of bytes.
Second tier: other pre-tokens are merged as a doubly linked list of bytes with a
heap of candidate merges, lowest rank first, in O(n log n) for n bytes.  Results
of both tiers are remembered per worker, up to a fixed number.

Defined results: null text is the empty text, which has no ids.  Ids above the
vocabulary cannot be decoded and raise ``KeyError``.  Rows that repeat an id are
encoded one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm._shared import text_or_empty
from panelspark.llm.pretokens import pretokens

#: Pre-tokens whose ids a worker remembers; it starts afresh beyond that.
MOST_REMEMBERED = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a rank file: one base-64 entry and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings, by hash and displace.

    Keys are dealt into buckets by one hash.  Buckets, largest first, search the
    seed whose second hash sends all their keys to free slots; buckets of one key
    take a free slot directly, stored as a negative number.
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = len(keys)
        self.n_buckets = max(1, n // 3)
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        whole = [xxhash.xxh3_128_intdigest(k) for k in keys]
        for i, h in enumerate(whole):
            buckets[(h >> 64) % self.n_buckets].append(i)
        self.seeds = [0] * self.n_buckets
        taken, slots = bytearray(n), [0] * n
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        free = 0
        for b in order:
            members = buckets[b]
            if not members:
                break
            if len(members) == 1:
                while taken[free]:
                    free += 1
                self.seeds[b], at = -free - 1, [free]
            else:
                seed = 1
                while True:
                    at = [self._slot(whole[i], seed) for i in members]
                    if len(set(at)) == len(at) and not any(taken[s] for s in at):
                        break
                    seed += 1
                self.seeds[b] = seed
            for i, s in zip(members, at):
                taken[s], slots[i] = 1, s
        self.keys: list[bytes] = [b""] * n
        for i, s in enumerate(slots):
            self.keys[s] = keys[i]

    def _slot(self, h: int, seed: int) -> int:
        return (((h & 0xFFFFFFFFFFFFFFFF) ^ (seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93 >> 24 & 0xFFFFFFFFFF) % self.n

    def slot(self, key: bytes) -> int:
        """Slot of the key, or -1 if the set does not have it."""
        h = xxhash.xxh3_128_intdigest(key)
        seed = self.seeds[(h >> 64) % self.n_buckets]
        at = -seed - 1 if seed < 0 else self._slot(h, seed)
        return at if self.keys[at] == key else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: a heap of merges over linked bytes, leftmost of the lowest rank first."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, left, to = heappop(heap)
        right = after[left]
        if end[left] < 0 or right >= n or end[right] != to:
            continue  # one of the two has been merged since
        end[left], end[right] = to, -1
        after[left] = nxt = after[right]
        if nxt < n:
            before[nxt] = left
            if (rank := ranks.get(piece[left : end[nxt]])) is not None:
                heappush(heap, (rank, left, end[nxt]))
        prev = before[left]
        if prev >= 0 and (rank := ranks.get(piece[prev:to])) is not None:
            heappush(heap, (rank, prev, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class ByteBPE:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.entries = {rank: entry for entry, rank in ranks.items()}
        self.hash = PerfectHash(list(ranks))
        self.slot_id = [ranks[k] for k in self.hash.keys]

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        at = self.hash.slot(raw)
        return [self.slot_id[at]] if at >= 0 else merge_bytes(raw, self.ranks)

    def encode(self, text: str) -> list[int]:
        return [i for p in pretokens(text) for i in self.piece(p)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


class _Remembered(dict):
    """Pre-token to its ids as little-endian bytes."""

    def __init__(self, bpe: ByteBPE) -> None:
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MOST_REMEMBERED:
            self.clear()
        ids = self[piece] = np.array(self.bpe.piece(piece), "<u4").tobytes()
        return ids


@lru_cache(maxsize=2)
def _remembered(path: str) -> _Remembered:
    return _Remembered(ByteBPE(read_ranks(path)))


def encode_documents(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, ids`` (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _remembered(ranks)
        for batch in batches:
            ids = [b"".join(map(known.__getitem__, pretokens(t))) for t in batch.column(1).to_pylist()]
            yield _id_batch(batch.column(0), ids)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def _id_batch(doc_id: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("i4")
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
    return pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """One row per row of :func:`encode_documents`: ``doc_id, bytes`` (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _remembered(ranks).bpe
        for batch in batches:
            raw = [bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Both directions run in one pass over a batch, so neither ids nor decoded
    bytes leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _remembered(ranks)
        entry = known.bpe.entries.__getitem__
        shown = _decimals(known)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(map(known.__getitem__, pretokens(text))), "<u4").tolist()
                counts.append(len(ids))
                coded.append(hashlib.sha256(" ".join(map(shown, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(entry, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _decimals(known: _Remembered):
    """Decimal form of each id of the vocabulary."""
    return {i: str(i) for i in known.bpe.entries}.__getitem__
