"""Katz backoff language model, counted, stored and applied in Spark.

Tokens are lower-cased words (A to Z only) and one end per text; a text's first
token follows start marks.  Counts are discounted by Good-Turing up to
``GOOD_TURING`` occurrences, each order with its own factors.  A seen n-gram has
probability d(c) c / c(h); an unseen one backs off to weight(h) times its
probability in the order below, and so on down to single words, with the weight
that makes each context sum to 1 exactly.  A word's own probability is discounted
in the same way; what that frees is the probability of all unknown words
together.  Contexts that discounting frees nothing from (all their counts are
high) count one event more, so no probability is zero.  An unseen context leaves
the probability to the order below.

Texts are read once: every scan task cuts its rows into blocks and writes their
tokens as block-wide codes, with the codes' 64-bit hashes.  No text is shuffled
or copied.  Count tables are partitioned by hashed key; blocks and partitions
exchange packed arrays:

1. Blocks send their different words; partitions add up and reply with counts.
   A word's number follows from its count and its place among the words of that
   count: frequent words have small numbers, which pack well, and the count can
   be read off the number.
2. For each order, blocks send their different n-grams, grouped by context, as
   word numbers, with the count of the n-gram's last n - 1 words; partitions add
   up and reply with n-gram counts and, per context, the followers by count and
   their probability in the order below.  As a seen n-gram's last words were seen,
   too, that probability is a count times a factor, divided by the block.
3. Blocks score their texts, token by token, from these replies.

No task holds more than a block, or a partition of different keys.  A frequent
n-gram arrives once a block.  A context with many occurrences is split by its
followers over several partitions, and blocks add up the replies.  Messages are
one a block and partition with something to say, and so never more than the
contexts of all blocks.

Defined results: null text is the empty text, which has one token, the end.  A
null id is never held out.  Rows that repeat an id are counted and scored one by
one.  Without training tokens every score is that of an unknown word; an empty
table gives an empty table.  Words, and contexts of two words or more, are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm._shared import bucketed, discard, text_or_empty, written

#: Highest count that is discounted.
GOOD_TURING = 5
#: Bytes of text that a block is meant to have, and whose n-grams a partition of a count table is meant to take.
#: Both bound a task's memory (some 60 bytes a byte); larger ones mean fewer messages, so they should grow with the executors.
BLOCK_BYTES, BUCKET_BYTES = 4_000_000, 4_000_000
#: Partitions of the written blocks; more blocks than that share them, and a task deals with its own one after the other.
MOST_PARTITIONS = 50_000
#: Tokens that a row of a block is meant to have.
PART_TOKENS = 100_000
#: Occurrences of a context that one partition takes; a more frequent context is split.
PIECE = 500_000
#: Bytes of text whose words are hashed together.
CHUNK_BYTES = 1 << 20

_START = np.uint64(2**64 - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers from others (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_END = _mix(np.array([0x656E64], np.uint64))[0]
_BYTES = np.arange(256)
_BLANK = (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13)
#: A number for each byte, the same for A to Z as for a to z.
_VALUE = _mix(np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint64) + np.uint64(1))


class WordHashes:
    """64-bit hashes of all words of a byte string at once.

    A word's hash is the sum of its bytes' numbers times powers of an odd base,
    counted from the word's start, and its length; sums of all bytes up to each
    place give it with one subtraction a word.
    """

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(0, np.uint64)

    def _grow(self, size: int) -> None:
        if size > len(self.powers):
            base = 0x9E3779B97F4A7C15 | 3
            for name, value in (("powers", base), ("inverse", pow(base, -1, 2**64))):
                steps = np.full(size, value, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words."""
        starts, hashes, at = [], [], 0
        while at < len(data):
            end = min(at + CHUNK_BYTES, len(data))
            while end < len(data) and not _BLANK[data[end]]:  # words are never cut
                end += 1
            part = data[at:end]
            self._grow(len(part) + 1)
            blank = np.concatenate([[True], _BLANK[part], [True]])
            begin, stop = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_VALUE[part] * self.powers[: len(part)], out=sums[1:])
            starts.append(begin + at)
            hashes.append(_mix((sums[stop] - sums[begin]) * self.inverse[begin] + (stop - begin).astype(np.uint64) * _M1))
            at = end
        return np.concatenate(starts or [np.zeros(0, int)]), np.concatenate(hashes or [np.zeros(0, np.uint64)])


def tokens(texts: Sequence[bytes], words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' tokens in a row, ends included, and the number of tokens a text."""
    size = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(size) - size
    starts, hashes = words(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
    n = np.diff(np.append(np.searchsorted(starts, begin), len(starts)))
    return np.insert(hashes, np.cumsum(n), _END), n + 1


def discounts(n: Sequence[int], k: int = GOOD_TURING) -> np.ndarray:
    """Good-Turing factors d(0) to d(k + 1) from ``n[r]``, the number of types seen r times.

    Counts above the cutoff have factor 1.  The cutoff is ``k``, or the highest one
    below it at which the counts of counts give factors between 0 and 1; if none
    does, as in tiny corpora, half a count is taken off each count up to ``k``.
    """
    for top in range(k, 1, -1):
        if not all(n[1 : top + 1]):
            continue
        common = (top + 1) * n[top + 1] / n[1]
        d = np.ones(k + 2)
        if common < 1:
            for c in range(1, top + 1):
                d[c] = ((c + 1) * n[c + 1] / (c * n[c]) - common) / (1 - common)
            if all(0 < d[c] < 1 for c in range(1, top + 1)):
                return d
    return np.array([1.0, *((c - 0.5) / c for c in range(1, k + 1)), 1.0])


@dataclass(frozen=True)
class Unigrams:
    """Numbers of training tokens and types, and the discounted probability of a word by its count."""

    tokens: int
    types: int
    factors: tuple[float, ...]
    freed: float

    @staticmethod
    def fit(tokens: int, types: int, n: Sequence[int]) -> Unigrams:
        d = discounts(n)
        freed = sum((1 - d[c]) * c * n[c] for c in range(1, GOOD_TURING + 1))
        return Unigrams(tokens, types, tuple(d), freed)

    def probability(self, count: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(count))
        d = np.array(self.factors)[np.minimum(count, GOOD_TURING + 1)]
        whole = self.tokens if self.freed > 0 else self.tokens + 1
        return np.where(count > 0, d * count / whole, (self.freed or 1.0) / whole)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + 1 * (self.types + 1)))


def _pack(x: np.ndarray) -> bytes:
    """Bytes of the numbers, all first bytes first, then all second ones: small numbers leave long runs of zeros."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _slices(to: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The partitions in use, and where each lies in the sorted ``to``."""
    used = np.unique(to)
    for b, low, high in zip(used, np.searchsorted(to, used), np.searchsorted(to, used, "right")):
        yield int(b), slice(int(low), int(high))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((_mix(key) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _by_count(total: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(total, GOOD_TURING + 2), minlength=GOOD_TURING + 3)[: GOOD_TURING + 2].tolist()


BLOCK = "block long, part int, ids binary, no_id binary, held_out binary, lengths binary, codes binary, keys binary, n binary"


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Blocks of (id, text, held out) rows: parts with whole texts, and a row of words with part -1."""
    words, got, size = WordHashes(), [], 0
    for batch in batches:
        ids, texts, held = batch.column(0), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        cut = 0
        while cut < len(texts):
            done = int(sizes[cut - 1]) if cut else 0
            end = max(cut + 1, int(np.searchsorted(sizes, done + block_bytes - size, "right")))
            h, n = tokens(texts.slice(cut, end - cut).to_pylist(), words)
            some = ids.slice(cut, end - cut)
            got.append((some.fill_null(0).to_numpy(), some.is_null().to_numpy(zero_copy_only=False), held[cut:end].astype(bool), n, h))
            size += int(sizes[end - 1]) - done
            cut = end
            if size >= block_bytes:
                yield _block_rows(got)
                got, size = [], 0
    if got:
        yield _block_rows(got)


def _block_rows(got: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    ids, no_id, held, lengths, token = (np.concatenate(x) for x in zip(*got))
    keys, code, n = np.unique(token, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    code, keys = rank[code], keys[order]
    n = np.bincount(code, weights=np.repeat(~held, lengths), minlength=len(keys)).astype("u4")
    block, ends = uuid.uuid4().int >> 65, np.cumsum(lengths)
    cuts = np.unique(np.append(np.flatnonzero(np.diff(ends // PART_TOKENS)) + 1, len(ends)))
    rows, a = [(block, -1, None, None, None, None, None, keys.tobytes(), _pack(n))], 0
    for part, b in enumerate(cuts):
        low = ends[a - 1] if a else 0
        rows.append((block, part, _pack(ids[a:b]), no_id[a:b].tobytes(), held[a:b].tobytes(), _pack(lengths[a:b].astype("u4")), _pack(code[low : ends[b - 1]]), None, None))
        a = b
    names = [c.split()[0] for c in BLOCK.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


@dataclass(frozen=True)
class Numbers:
    """How words are numbered: by falling count, then by place among a partition's words of that count."""

    counts: np.ndarray
    first: np.ndarray
    buckets: int

    @staticmethod
    def fit(counts: Sequence[int], most: Sequence[int], buckets: int) -> Numbers:
        """``counts``: the different counts, falling; ``most``: the most words of it that a partition has."""
        first = np.cumsum([0, *(m * buckets for m in most)])[:-1].astype(np.int64)
        return Numbers(np.array(counts, np.int64), first, buckets)

    def number(self, count: np.ndarray, place: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Numbers of words; those not seen in training have none, and get 0."""
        if not len(self.counts):
            return np.zeros(len(count), np.uint64)
        at = np.searchsorted(-self.counts, -np.maximum(count, self.counts[-1]))
        return np.where(count > 0, self.first[at] + place * self.buckets + bucket, 0).astype(np.uint64)

    def count(self, number: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.first, number.astype(np.int64), "right") - 1]


@dataclass
class _Order:
    """An order's n-grams in a block: their index at each token (-1: surely unseen), training counts and keys; wholes and scores at each token."""

    gram: np.ndarray
    count: np.ndarray
    key: np.ndarray
    whole: np.ndarray | None = None
    probability: np.ndarray | None = None


class _Asked:
    """What a block asks about the n-grams of an order: entries (a context, or a piece of one), and their followers."""

    def __init__(self, block: _Block, below: _Order) -> None:
        context = np.empty_like(below.gram)
        context[1:] = below.gram[:-1]
        context[block.begin] = len(below.count)
        self.below = below
        self.counts, keys = np.append(below.count, block.starts), np.append(below.key, _START)
        self.known = (context >= 0) & (self.counts[context] > 0)
        self.at = np.flatnonzero(self.known & (below.gram >= 0) & (below.count[below.gram] > 0))
        types = len(block.keys)
        each, first, self.inverse = np.unique(context[self.at] * np.int64(types) + block.codes[self.at], return_index=True, return_inverse=True)
        self.n = np.bincount(self.inverse, weights=block.train[self.at], minlength=len(each)).astype(np.int64)
        # a word's count can be read off its number
        self.low = np.zeros(0, np.int64) if below.whole is None else below.count[below.gram[self.at[first]]]
        self.contexts, self.first = np.unique(context[self.known], return_index=True)
        self.place = np.searchsorted(self.contexts, context[self.known])
        pieces = 1 + self.counts[self.contexts] // block.piece
        self.begin = np.cumsum(pieces) - pieces
        of, piece = np.repeat(self.contexts, pieces), np.arange(pieces.sum()) - np.repeat(self.begin, pieces)
        entry = np.where(piece == 0, keys[of], _mix(keys[of] + piece.astype(np.uint64) * _M2))
        to = _bucket(entry, block.buckets)
        self.entries = np.lexsort((entry, to))
        rank = np.empty(len(to), np.int64)
        rank[self.entries] = np.arange(len(to))
        self.entry, self.to = entry[self.entries], to[self.entries]
        self.context, number = each // types, block.numbers[each % types]
        at = np.searchsorted(self.contexts, self.context)
        place = rank[self.begin[at] + (_mix(number) % pieces[at].astype(np.uint64)).astype(np.int64)] if len(at) else at
        self.grams = np.lexsort((number, place))
        self.number = number[self.grams]
        self.followers = np.bincount(place, minlength=len(to)).astype("u4")
        self.key = _mix(keys[self.context] * _M1 + number)

    def messages(self, block: int, buckets: int) -> pd.DataFrame:
        ends = np.append(0, np.cumsum(self.followers, dtype=np.int64))
        n, out = self.n[self.grams].astype("u4"), []
        low = self.low[self.grams].astype("u8") if len(self.low) else self.low.astype("u8")
        for b, s in _slices(self.to, buckets):
            g = slice(ends[s.start], ends[s.stop])
            out.append((b, block, _pack(self.entry[s]), _pack(self.followers[s]), _pack(self.number[g]), _pack(n[g]), _pack(low[g])))
        return pd.DataFrame(out, columns=MESSAGE_NAMES)


MESSAGE = "bucket int, block long, entries binary, followers binary, numbers binary, n binary, low binary"
MESSAGE_NAMES = [c.split()[0] for c in MESSAGE.split(", ")]


class _Block:
    """A block with the replies it has so far."""

    def __init__(self, parts: pd.DataFrame, replies: pd.DataFrame, one: Unigrams, numbers: Numbers, starts: int, piece: int) -> None:
        parts = parts.sort_values("part")
        words, rows = parts[parts["part"] < 0], parts[parts["part"] >= 0]
        join = lambda column, kind: np.concatenate([_unpack(x, kind) for x in rows[column]])
        self.block, self.buckets, self.starts, self.one, self.piece = int(words["block"].iat[0]), numbers.buckets, starts, one, piece
        self.keys = np.frombuffer(words["keys"].iat[0], "u8")
        self.ids, self.lengths, self.codes = join("ids", "i8"), join("lengths", "u4").astype(np.int64), join("codes", "u4").astype(np.int64)
        flags = lambda column: np.frombuffer(b"".join(rows[column]), bool)
        self.no_id, self.held = flags("no_id"), flags("held_out")
        self.train = np.repeat(~self.held, self.lengths)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.replies = replies
        to = _bucket(self.keys, self.buckets)
        by = np.argsort(to, kind="stable")
        self.counts, place = np.zeros(len(to), np.int64), np.zeros(len(to), np.int64)
        self.counts[by], place[by] = self._gather(1, "counts", "u8"), self._gather(1, "more", "u8")
        self.numbers = numbers.number(self.counts, place, to)

    def _gather(self, order: int, column: str, kind: str) -> np.ndarray:
        """The replies' values in the order in which they were asked for."""
        mine = self.replies[self.replies["order"] == order].sort_values("bucket")
        return np.concatenate([np.zeros(0, kind), *[_unpack(x, kind) for x in mine[column]]])

    def _by_count(self, order: int) -> np.ndarray:
        """Followers of each entry, by count from 1 to ``GOOD_TURING``."""
        mine = self.replies[self.replies["order"] == order].sort_values("bucket")
        return np.concatenate([np.zeros((0, GOOD_TURING), "u4"), *[_unpack(x, "u4").reshape(GOOD_TURING, -1).T for x in mine["by_count"]]])

    def words(self) -> _Order:
        return _Order(self.codes, self.counts, self.numbers, None, self.one.probability(self.counts)[self.codes])

    def above(self, asked: _Asked, order: int, factors: np.ndarray) -> _Order:
        """The next order, by the replies to ``asked``."""
        below = asked.below
        count = np.empty(len(asked.grams), np.int64)
        count[asked.grams] = self._gather(order, "counts", "u8")
        mass, by_count = np.empty(len(asked.entry)), np.empty((len(asked.entry), GOOD_TURING))
        mass[asked.entries] = self._gather(order, "more", "f8")
        by_count[asked.entries] = self._by_count(order)
        add = lambda x: np.add.reduceat(x, asked.begin) if len(x) else x
        freed = add(by_count @ ((1 - factors[1 : GOOD_TURING + 1]) * np.arange(1, GOOD_TURING + 1)))
        plain = freed <= 0
        whole = asked.counts[asked.contexts] + plain
        under = 1.0 if below.whole is None else below.whole[np.flatnonzero(asked.known)[asked.first]]
        weight = np.where(plain, 1.0, freed) / whole / (1 - add(mass) / under)

        whole_at, gram = np.ones(len(self.codes)), np.full(len(self.codes), -1, np.int64)
        whole_at[asked.known] = whole[asked.place]
        gram[asked.at] = asked.inverse
        probability = below.probability.copy()
        probability[asked.known] *= weight[asked.place]
        c = count[asked.inverse]
        seen = asked.at[c > 0]
        c = c[c > 0]
        probability[seen] = factors[np.minimum(c, GOOD_TURING + 1)] * c / whole_at[seen]
        return _Order(gram, count, asked.key, whole_at, probability)


REPLY = "bucket int, block long, counts binary, more binary, by_count binary, entries binary, followers binary, numbers binary, of_count array<long>"
REPLY_NAMES = [c.split()[0] for c in REPLY.split(", ")]


def _add_words(group: pd.DataFrame) -> pd.DataFrame:
    """Counts of a partition's words, to every block that asked, and the table of those seen (block -1)."""
    keys = [np.frombuffer(x, "u8") for x in group["keys"]]
    each, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([_unpack(x, "u4") for x in group["n"]]), minlength=len(each)).astype(np.int64)
    order = np.lexsort((each, total))
    place = np.empty(len(each), np.int64)
    place[order] = np.arange(len(each)) - np.searchsorted(total[order], total[order])
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    bucket, seen = int(group["bucket"].iat[0]), total > 0
    out = [(bucket, int(b), _pack(c.astype("u8")), _pack(p.astype("u8"))) for b, c, p in zip(group["block"], np.split(total[inverse], cuts), np.split(place[inverse], cuts))]
    values, types = np.unique(total[seen], return_counts=True)
    rows = [(*x, None, None, None, None, None) for x in out]
    rows.append((bucket, -1, _pack(total[seen].astype("u8")), values.astype("u8").tobytes(), None, None, None, each[seen].tobytes(), types.tolist()))
    return pd.DataFrame(rows, columns=REPLY_NAMES).assign(values=[None] * len(out) + [values.tolist()])


def _add_grams(group: pd.DataFrame, value) -> pd.DataFrame:
    """Counts of a partition's n-grams, and what blocks need of its contexts.

    ``value``: the followers' probability in the order below, up to the context's whole.
    """
    entries, followers = [_unpack(x, "u8") for x in group["entries"]], [_unpack(x, "u4") for x in group["followers"]]
    numbers, low = np.concatenate([_unpack(x, "u8") for x in group["numbers"]]), np.concatenate([_unpack(x, "u8") for x in group["low"]])
    n = [_unpack(x, "u4") for x in group["n"]]
    entry, at = np.unique(np.concatenate(entries), return_inverse=True)
    of = np.repeat(at, np.concatenate(followers))
    _, first, inverse = np.unique(_mix(entry[of] * _M1 + numbers), return_index=True, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(n), minlength=len(first)).astype(np.int64)
    of, numbers, low = of[first], numbers[first], low[first] if len(low) else np.zeros(len(first), np.int64)
    seen = total > 0
    mass = np.bincount(of[seen], weights=value(numbers[seen], low[seen].astype(np.int64)), minlength=len(entry)) if seen.any() else np.zeros(len(entry))
    by_count = np.stack([np.bincount(of[total == c], minlength=len(entry)) for c in range(1, GOOD_TURING + 1)]).astype("u4")
    bucket, rows = int(group["bucket"].iat[0]), []
    grams, places = np.split(total[inverse], np.cumsum([len(x) for x in n])[:-1]), np.split(at, np.cumsum([len(x) for x in entries])[:-1])
    for b, c, p in zip(group["block"], grams, places):
        rows.append((bucket, int(b), _pack(c.astype("u8")), _pack(mass[p]), _pack(by_count[:, p].ravel()), None, None, None, None))
    order = np.lexsort((numbers, of))
    order = order[seen[order]]
    rows.append((bucket, -1, _pack(total[order].astype("u8")), None, None, _pack(entry), _pack(np.bincount(of[order], minlength=len(entry)).astype("u4")), _pack(numbers[order]), _by_count(total)))
    return pd.DataFrame(rows, columns=REPLY_NAMES)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, held_out, order: int = 2, id_col: str = "doc_id", text_col: str = "text", model_dir: str | None = None, block_bytes: int = BLOCK_BYTES, piece: int = PIECE) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``held_out``: a condition over the input's columns; the model learns from the
    other rows.  Scores are log10 probabilities.  ``model_dir``: where to leave
    the count tables, partitioned by order.  ``block_bytes`` and ``piece``: see
    :data:`BLOCK_BYTES` and :data:`PIECE`; results do not depend on them.
    """
    if order < 1:
        raise ValueError("order must be 1 at least")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_or_empty(text_col), "UTF-8").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("train")).first()
    blocks, buckets, starts = max(1, -(-(size["bytes"] or 0) // block_bytes)), max(8, -(-(size["bytes"] or 0) // BUCKET_BYTES)), size["train"]
    # Spark refuses a table of more buckets than this setting
    partitions = min(blocks, MOST_PARTITIONS, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    parts = bucketed(rows.mapInArrow(lambda batches: _blocks(batches, block_bytes), BLOCK), "katz_blocks", "block", partitions)
    try:
        scores, tables = _score(parts, order, buckets, starts, piece)
    finally:
        discard(parts)
    if model_dir:
        stored = [t.where("block = -1").select(F.lit(k).alias("order"), "bucket", "counts", "entries", "followers", "numbers") for k, t in enumerate(tables, 1)]
        for t in stored:
            t.write.mode("append").partitionBy("order").parquet(model_dir)
    discard(*tables)
    return scores


def _score(parts: DataFrame, order: int, buckets: int, starts: int, piece: int) -> tuple[DataFrame, list[DataFrame]]:
    """The scores, written, and the count tables of all orders with the replies."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, n in zip(*(c.to_pylist() for c in batch.columns)):
                keys, n = np.frombuffer(keys, "u8"), _unpack(n, "u4")
                to = _bucket(keys, buckets)
                by = np.argsort(to, kind="stable")
                out = [(b, block, keys[by[s]].tobytes(), _pack(n[by[s]])) for b, s in _slices(to[by], buckets)]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["bucket", "block", "keys", "n"])

    sent = parts.where("part = -1").select("block", "keys", "n").mapInArrow(words, "bucket int, block long, keys binary, n binary")
    tables = [written(sent.groupBy("bucket").applyInPandas(_add_words, REPLY + ", values array<long>"), "katz-words")]
    # as many different counts as there are, at most the root of twice the number of training tokens
    each = F.explode(F.arrays_zip(F.col("values").alias("value"), F.col("of_count").alias("types"))).alias("x")
    found = tables[0].where("block = -1").select(each).groupBy("x.value").agg(F.sum("x.types").alias("types"), F.max("x.types").alias("most")).orderBy(F.desc("value")).collect()
    types = {r["value"]: r["types"] for r in found}
    one = Unigrams.fit(sum(v * t for v, t in types.items()), sum(types.values()), [types.get(r, 0) for r in range(GOOD_TURING + 2)])
    numbers = Numbers.fit([r["value"] for r in found], [r["most"] for r in found], buckets)

    replies = lambda k: tables[k - 1].where("block <> -1").select(F.lit(k).alias("order"), "bucket", "block", "counts", "more", "by_count")
    factors: dict[int, np.ndarray] = {}

    def orders(pdf: pd.DataFrame, got: pd.DataFrame, most: int) -> tuple[_Block, _Order]:
        block = _Block(pdf, got, one, numbers, starts, piece)
        at = block.words()
        for k in range(2, most + 1):
            at = block.above(_Asked(block, at), k, factors[k])
        return block, at

    def told(k: int) -> DataFrame:
        out = replies(1)
        for j in range(2, k + 1):
            out = out.unionByName(replies(j))
        return out

    def asking(k: int):
        def ask(pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf):
                return pd.DataFrame([], columns=MESSAGE_NAMES)
            block, below = orders(pdf, got, k - 1)
            return _Asked(block, below).messages(block.block, buckets)

        return ask

    def adding(k: int):
        def add(group: pd.DataFrame) -> pd.DataFrame:
            if k == 2:
                return _add_grams(group, lambda number, low: one.probability(numbers.count(number)))
            return _add_grams(group, lambda number, low: factors[k - 1][np.minimum(low, GOOD_TURING + 1)] * low)

        return add

    for k in range(2, order + 1):
        sent = parts.groupBy("block").cogroup(told(k - 1).groupBy("block")).applyInPandas(asking(k), MESSAGE)
        tables.append(written(sent.groupBy("bucket").applyInPandas(adding(k), REPLY), f"katz-grams-{k}"))
        n = tables[-1].where("block = -1").agg(*[F.sum(F.get("of_count", F.lit(r))).alias(f"n{r}") for r in range(GOOD_TURING + 2)]).first()
        factors[k] = discounts([n[f"n{r}"] or 0 for r in range(GOOD_TURING + 2)])

    def score(pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in SCORES.split(", ")]
        if not len(pdf):
            return pd.DataFrame([], columns=names)
        block, at = orders(pdf, got, order)
        add = lambda x: np.add.reduceat(x, block.begin)
        ids = pd.array(block.ids, "Int64")
        ids[block.no_id] = pd.NA
        known, base = block.counts[block.codes] > 0, one.base(block.counts)[block.codes]
        return pd.DataFrame({"doc_id": ids, "held_out": block.held, "n_tokens": block.lengths, "n_known": add(known.astype(np.int64)), "train_tokens": one.tokens, "base_score": add(base), "score": add(np.log10(at.probability))}, columns=names)

    return written(parts.groupBy("block").cogroup(told(order).groupBy("block")).applyInPandas(score, SCORES), "katz-scores"), tables
