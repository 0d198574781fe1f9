"""Phrase collocation mining: frequent n-grams by mergeable Misra-Gries summaries, then exact counts.

Texts are lower-cased (A to Z only), split into pieces at punctuation and line
ends, and pieces into words; all that follows is done for each language by itself.

1. Tasks cut their rows into chunks, written as codes of words.  Chunks send the
   hashes and counts of their different n-grams (1 to ``longest`` words) to
   ranges of hashes, as steps from one hash to the next.  A task takes a range, and
   deals with one hash partition of it after the other.
2. A partition merges its chunks' counts into one Misra-Gries summary: counters of
   n-grams; when there are more than its capacity, the count next below the kept
   ones is taken off all of them.  The capacity exceeds the partition's mass divided
   by the threshold, so less than a threshold is ever taken off, and every n-gram
   that occurs ``least`` times survives.  The answer to a chunk is one bit for each
   n-gram that it sent.
3. Chunks count the surviving n-grams, now as words; these counts are added up, and
   those below the threshold go.  They are exact.
4. Joins on (language, phrase) bring the counts of each phrase's two parts, for all
   cuts; a longer phrase takes out the shorter ones inside that it explains.

Ranges are so many that each one's mass stays about ``TASK_MASS``.  Messages are one
a chunk and range with something to say; ``CHUNK_BYTES`` and ``TASK_MASS`` bound a
task's memory and should grow with the executors, as larger ones mean fewer
messages.  An n-gram arrives once a chunk, however frequent.

Defined results: null text is the empty text, which has no words; a null language is
``und``.  Rows that repeat an id count each.  Equal scores go by count, then by the
phrase's bytes.  Without words, and of an empty table, there are no phrases.
Counts may reach 10^15; beyond that, decimals overflow and the job fails.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm._shared import discard, text_or_empty, written

#: Bytes of text that a chunk is meant to have, and occurrences of n-grams that a task of partitions, and one partition, are meant to take.
CHUNK_BYTES, TASK_MASS, PARTITION_MASS = 3_000_000, 4_000_000, 1_000_000
#: Rows that a task turns into Python objects at a time.
SLICE = 256

#: Characters that end a piece, and those that separate words inside a piece.
PIECE_ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"

#: A byte that UTF-8 never has stands for the end of a piece.
_END = b"\xff"
_FOLD = bytes(0xFF if i in PIECE_ENDS else 32 if i in BLANKS else i + 32 if 65 <= i <= 90 else i for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    """A text's words and piece ends, in a row."""
    return text.translate(_FOLD).replace(_END, b" \xff ").split()


def _mix(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers from others (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


class Chunk:
    """A chunk's different n-grams of each length, exactly told apart, with counts and hashes.

    ``langs, lang``: the different languages, and each token's; ``words, codes``: the
    different words (the first is a piece's end), and each token's.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, words: list[bytes], codes: np.ndarray, longest: int) -> None:
        self.langs, self.words, self.codes, self.lang = langs, words, codes, lang
        n, hashed = len(words), _hashes(words)
        self.first: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        at = np.flatnonzero(codes != 0)
        key = lang[at] * np.int64(n) + codes[at]
        hash_of = lambda start: _mix(_hashes([x.encode() for x in langs])[lang[start]] ^ hashed[codes[start]])
        for k in range(longest):
            order = np.argsort(key)
            new = np.diff(key[order], prepend=-1) != 0
            place = np.flatnonzero(new)
            first = order[place]
            counts, start, inverse = np.diff(place, append=len(key)), at[first], np.empty(len(key), np.int64)
            inverse[order] = np.cumsum(new) - 1
            own = hash_of(start) if k == 0 else _mix((before[which[first]] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) + hashed[codes[start + k]])
            self.first.append(start)
            self.counts.append(counts)
            self.hashes.append(own)
            go = at + k + 1 < len(codes)
            go[go] = codes[at[go] + k + 1] != 0
            at, before, which = at[go], own, inverse[go]
            key = which * np.int64(n) + codes[at + k + 1]

    def phrases(self, k: int, some: np.ndarray) -> tuple[list[str], list[str]]:
        """Languages and words of some n-grams of ``k + 1`` words."""
        start = self.first[k][some]
        parts = [self.codes[start + j].tolist() for j in range(k + 1)]
        return [self.langs[i] for i in self.lang[start].tolist()], [b" ".join(map(self.words.__getitem__, x)).decode() for x in zip(*parts)]

    def sent(self, partitions: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lengths, places, hashes of so many bits and partitions of all n-grams, ordered by hash; partitions are ranges of hashes."""
        length = np.repeat(np.arange(len(self.first)), [len(x) for x in self.first])
        place = np.concatenate([np.arange(len(x)) for x in self.first])
        hashes = np.concatenate(self.hashes) >> np.uint64(64 - bits)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        ranges = [(i << bits) // partitions for i in range(1, partitions)]
        return length[order], place[order], hashes, np.searchsorted(np.array(ranges, np.uint64), hashes, "right")


def hash_bits(mass: int) -> int:
    """Bits of hash that leave few n-grams with another's hash: 8 values for each occurrence.

    Two n-grams of one hash only survive more easily; counts are exact in any case.
    """
    return min(63, max(24, mass.bit_length() + 3))


_squeeze, _expand = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _pack(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, the lowest first, without the highest ones that are all 0, compressed."""
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return _squeeze.compress(planes[: max(1, x.itemsize - next((i for i, p in enumerate(planes[::-1]) if p.any()), x.itemsize))].tobytes())


def _unpack(packed: bytes, n: int, kind: str) -> np.ndarray:
    planes = np.zeros((np.dtype(kind).itemsize, n), np.uint8)
    if n:
        some = np.frombuffer(_expand.decompress(packed), np.uint8).reshape(-1, n)
        planes[: len(some)] = some
    return planes.T.copy().view(kind).ravel()


def misra_gries(summary: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray], capacity: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """The merged summary of two (keys and counts), and what was taken off its counts.

    Keys of a part may repeat.  Counters beyond the capacity go, as the count next
    below the kept ones is taken off all; at least ``capacity + 1`` counters lose as
    much, so over any order of merges no more than mass / (capacity + 1) is lost.
    """
    keys, inverse = np.unique(np.concatenate([summary[0], more[0]]), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([summary[1], more[1]]), minlength=len(keys)).astype(np.int64)
    if len(keys) <= capacity:
        return (keys, counts), 0
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    kept = counts > off
    return (keys[kept], counts[kept] - off), off


def surviving(parts: list[tuple[np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, int]:
    """Keys that may occur ``least`` times in the parts, and what the summary has taken off; merged in batches of its capacity."""
    capacity = int(sum(int(c.sum()) for _, c in parts)) // least + 1
    summary, lost, batch, size = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0, [], 0

    def merged():
        return misra_gries(summary, tuple(np.concatenate(x) for x in zip(*batch)), capacity)

    for part in parts:
        batch.append(part)
        size += len(part[0])
        if size >= capacity:
            summary, off = merged()
            lost, batch, size = lost + off, [], 0
    if batch:
        summary, off = merged()
        lost += off
    return summary[0][summary[1] + lost >= least], lost


def answers(n_grams: Iterable[int], hashes: Iterable[bytes], counts: Iterable[bytes], least: int) -> list[tuple[int, bytes]]:
    """To each message of a range of hashes: how many n-grams it has, and a bit for each one, set if it survives."""
    sizes = list(n_grams)
    hashes, counts = [np.cumsum(_unpack(x, n, "<u8"), dtype=np.uint64) for x, n in zip(hashes, sizes)], [_unpack(x, n, "<u4") for x, n in zip(counts, sizes)]
    low, high = (f(int(h[i]) for h in hashes) for f, i in ((min, 0), (max, -1)))
    n = max(1, -(-sum(int(c.sum(dtype=np.int64)) for c in counts) // PARTITION_MASS))
    cuts = np.array([low + (high + 1 - low) * i // n for i in range(1, n)], np.uint64)
    at = [[0, *np.searchsorted(h, cuts).tolist(), len(h)] for h in hashes]
    kept: list[list[np.ndarray]] = [[] for _ in hashes]
    for i in range(n):
        own = [(h[a[i] : a[i + 1]], c[a[i] : a[i + 1]]) for h, c, a in zip(hashes, counts, at)]
        survivors, _ = surviving([x for x in own if len(x[0])], least)
        for k, (h, _) in zip(kept, own):
            place = np.searchsorted(survivors, h)
            k.append(survivors[np.minimum(place, len(survivors) - 1)] == h if len(survivors) else np.zeros(len(h), bool))
    return [(len(h), np.packbits(np.concatenate(k)).tobytes()) for h, k in zip(hashes, kept)]


#: A chunk: languages and words; each text's language and number of tokens; the tokens as codes of words.
CHUNK = "chunk long, langs array<string>, lang binary, tokens binary, words binary, codes binary, occurrences long"
COLUMNS = [c.split()[0] for c in CHUNK.split(", ")]


class _Codes(dict):
    """Words to numbers, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of (language, text) rows."""
    task, k = TaskContext.get().partitionId(), 0
    langs, words, codes, lang, tokens, size = _Codes(), _Codes({_END: 0}), [], [], [], 0

    def made() -> pa.RecordBatch:
        all_codes = np.concatenate(codes)
        values = [task << 32 | k, list(langs), np.array(lang, "<u4").tobytes(), np.array(tokens, "<u4").tobytes(), _squeeze.compress(b" ".join(words)), _pack(all_codes), int((all_codes != 0).sum())]
        kinds = [pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 4, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], COLUMNS)

    for batch in batches:
        for begin in range(0, len(batch), SLICE):
            some = batch.slice(begin, SLICE)
            for name, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                own = np.array([*map(words.__getitem__, words_of(text)), 0], "<u4")
                codes.append(own)
                lang.append(langs[name])
                tokens.append(len(own))
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield made()
                    k, langs, words, codes, lang, tokens, size = k + 1, _Codes(), _Codes({_END: 0}), [], [], [], 0
    if codes:
        yield made()


def _read(langs, lang, tokens, words, codes, longest: int) -> Chunk:
    tokens = np.frombuffer(tokens, "<u4").astype(np.int64)
    return Chunk(list(langs), np.repeat(np.frombuffer(lang, "<u4").astype(np.int64), tokens), _expand.decompress(words).split(b" "), _unpack(codes, int(tokens.sum()), "<u4").astype(np.int64), longest)


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Exact counts of all n-grams that occur ``least`` times (``lang, phrase, size, f``), and all words (``lang, n``); both written.

    ``size``: the number of words, from 1 to ``longest``.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.encode(text_or_empty(text_col), "UTF-8").alias("text"))
    chunks = written(rows.mapInArrow(_chunks, CHUNK), "chunks")
    mass = (chunks.agg(F.sum("occurrences")).first()[0] or 0) * longest
    partitions, bits = max(8, -(-mass // TASK_MASS)), hash_bits(mass)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                chunk, *parts = (batch.column(c)[i].as_py() for c in COLUMNS[:6])
                own = _read(*parts, longest)
                length, place, hashes, to = own.sent(partitions, bits)
                counts = np.concatenate(own.counts)[np.concatenate([[0], np.cumsum([len(x) for x in own.counts])])[length] + place]
                used, begin = np.unique(to, return_index=True)
                ends = np.append(begin[1:], len(to))
                steps, counts = np.diff(hashes, prepend=hashes[:1]), counts.astype("<u4")
                steps[begin] = hashes[begin]
                columns = [used.astype(np.int32), np.full(len(used), chunk), ends - begin, [_pack(steps[a:b]) for a, b in zip(begin, ends)], [_pack(counts[a:b]) for a, b in zip(begin, ends)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["partition", "chunk", "n", "hashes", "counts"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(p, c, n, kept) for p, c, (n, kept) in zip(group["partition"], group["chunk"], answers(group["n"], group["hashes"], group["counts"], least))], columns=["partition", "chunk", "n", "bits"])

    sent = chunks.select(*COLUMNS[:6]).mapInArrow(send, "partition int, chunk long, n long, hashes binary, counts binary")
    told = written(sent.groupBy("partition").applyInPandas(answer, "partition int, chunk long, n long, bits binary"), "survivors")

    def count(own: pd.DataFrame, answers: pd.DataFrame) -> Iterator[pd.DataFrame]:
        names = ["lang", "phrase", "size", "f"]
        if not len(own) or not len(answers):
            return pd.DataFrame([], columns=names)
        chunk = _read(*own.iloc[0][COLUMNS[1:6]], longest)
        length, place, *_ = chunk.sent(partitions, bits)
        answers = answers.sort_values("partition")
        kept = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)) for b, n in zip(answers["bits"], answers["n"])]).astype(bool)
        out = []
        for k in range(longest):
            some = np.sort(place[kept & (length == k)])
            langs, phrases = chunk.phrases(k, some)
            out.append(pd.DataFrame({"lang": langs, "phrase": phrases, "size": k + 1, "f": chunk.counts[k][some]}))
        return pd.concat(out)

    counted = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(count, "lang string, phrase string, size int, f long")
    exact = written(counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrase-counts")
    words = written(chunks.select("langs", "lang", "tokens", "codes").mapInArrow(_lang_words, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")), "lang-words")
    discard(chunks, told)
    return exact, words


def _lang_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for langs, lang, tokens, codes in zip(*(batch.column(c).to_pylist() for c in ("langs", "lang", "tokens", "codes"))):
            tokens = np.frombuffer(tokens, "<u4").astype(np.int64)
            of = np.repeat(np.frombuffer(lang, "<u4"), tokens)
            n = np.bincount(of[_unpack(codes, len(of), "<u4") != 0], minlength=len(langs))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(n, pa.int64())], ["lang", "n"])


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, most: int = 2000, share: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``most`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a``: the phrase's count; ``l, r``: those of its parts at the cut with the lowest
    score, floor(10^6 a a / (l r)); ``n``: the language's words.  A phrase goes if a
    longer one that contains it has ``share`` percent of its count.
    """
    exact, words = phrase_counts(docs, longest, least, text_col, lang_col)
    found = exact.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    whole = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    # runs of at least two words inside a longer phrase, with the highest count among the longer ones
    runs = F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> array_join(slice(w, i, k), ' '))))")
    inside = found.where("size > 2").select("lang", F.explode(runs).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stays = found.join(inside, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * share)
    cuts = stays.select("lang", "phrase", "size", "a", "w", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(0).alias("side"), whole(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), whole(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))).alias("x"))
    parts = exact.select("lang", F.col("phrase").alias("part"), "f")
    scored = sides.select("lang", "phrase", "a", "k", "x.*").join(parts, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(*[F.max(F.when(F.col("side") == s, F.col("f"))).alias(name) for s, name in ((0, "l"), (1, "r"))])
    score = F.expr("(cast(a as decimal(16, 0)) * cast(a as decimal(16, 0)) * cast(1000000 as decimal(7, 0))) div (cast(l as decimal(16, 0)) * cast(r as decimal(16, 0)))")
    lowest = scored.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = lowest.withColumn("rank", rank).where(F.col("rank") <= most)
    out = written(first.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrases")
    discard(exact, words)
    return out
