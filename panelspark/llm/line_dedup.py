"""Near-duplicate lines by a segment-partition edit join.

Two different lines are linked when their edit distance is at most ``most_edits``,
or at most one where the shorter of them is under ``least_chars``.
A line is cut into ``most_edits + 1`` even segments: lines within the distance have
one segment in common, at nearly the same place.  So every line is indexed under
its segments, and probes, for its own length and up to ``most_edits`` less, those
of its substrings that could be such a segment.  The places to try follow from the
edits that may lie on either side of the segment, about ``most_edits ** 2 / 2``
less than all shifts.

Segments of lines under ``least_chars`` would be a few characters that many lines
share.  Such lines, and those of just ``least_chars``, are indexed under all
strings that come from deleting one character: lines one edit apart share such a
string, or one of them is such a string of the other.  A string has no more
lines than it has places and the alphabet letters.

The keys of all lines are many and nearly all of them are alone, so tasks send
packed arrays of keys, each with the smallest and the largest line seen under it;
a key with one line only is gone before any line is looked at again.  The lines
under the remaining keys meet in a join, filtered by a parity sketch of their
character pairs, and are verified by a banded bit-parallel edit distance.
Only lines under shared keys are sketched and moved.

Lines are compared after each run of blanks became one space and the ends were
trimmed; lines without a word are left out.  Lines under ``short_chars`` are only
equal or different: an edit makes any word of that size another one.

Defined results: null and empty texts have no lines.  Equal lines are one class
from the start and are never paired.  Rows that repeat an id are separate: each
of their lines gets a row.  A class is named by its first line in order of
document and line; that line is kept.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm._shared import discard, filter_bits, key_filter, maybe_listed, squeezed, text_or_empty, written
from panelspark.llm.components import components

MOST_EDITS, LEAST_CHARS, SHORT_CHARS = 2, 24, 6
#: Lines whose keys one bucket of the key exchange is meant to take.
BUCKET_LINES = 30_000
#: Keys that a task gathers before it sends them.
MOST_KEYS = 2_000_000


def segments(size: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of ``parts`` even segments of a line; the longer ones last."""
    short, longer = divmod(size, parts)
    lengths = [short + (i >= parts - longer) for i in range(parts)]
    return [(sum(lengths[:i]), n) for i, n in enumerate(lengths)]


@dataclass(frozen=True)
class Bounds:
    """Edits that a pair may have, by the length of its shorter line."""

    most_edits: int = MOST_EDITS
    least_chars: int = LEAST_CHARS
    short_chars: int = SHORT_CHARS

    def edits(self, size: int) -> int:
        return self.most_edits if size >= self.least_chars else min(1, self.most_edits) if size >= self.short_chars else 0

    def deletes(self, size: int) -> bool:
        """Whether lines of ``size`` are indexed under the strings with a character less."""
        return self.most_edits > 0 and self.short_chars <= size <= self.least_chars

    def column(self, chars: Column) -> Column:
        """The same for lines that have ``short_chars`` at least."""
        return F.when(chars >= self.least_chars, self.most_edits).otherwise(min(1, self.most_edits))


def probes(size: int, bounds: Bounds) -> list[tuple[int, int, int, int]]:
    """Length, segment number, start and end of the substrings that a line of ``size`` tries.

    Before segment i (from 0) at most i edits may lie, and behind it at most the
    other line's edits less i, if the earlier segments are to have been in vain.
    """
    out = []
    for other in range(max(bounds.least_chars, size - bounds.most_edits), size + 1):
        more, most = size - other, bounds.edits(other)
        for i, (start, n) in enumerate(segments(other, most + 1)):
            behind = most - i
            first = max(0, start - i, start + more - behind)
            last = min(size - n, start + i, start + more + behind)
            out += [(other, i, at, at + n) for at in range(first, last + 1)]
    return out


class _Plan(dict):
    """Per line length: (salt, start, end) of its index keys and of its probe keys."""

    def __init__(self, bounds: Bounds) -> None:
        self.bounds = bounds

    def __missing__(self, size: int):
        salt = lambda other, i: (other * 64 + i) & 0xFFFFFFFFFFFF
        long = size >= self.bounds.least_chars
        own = [(salt(size, i), a, a + n) for i, (a, n) in enumerate(segments(size, self.bounds.edits(size) + 1))] if long else []
        tried = [(salt(other, i), a, b) for other, i, a, b in probes(size, self.bounds)]
        plan = self[size] = (own, [p for p in tried if p not in own])
        return plan


#: Salt of the strings with a character less; no length has it.
_DELETED = 1 << 60


def line_keys(line: str, plan: _Plan) -> tuple[list[int], list[int]]:
    """64-bit index keys and further probe keys of a line."""
    size = len(line)
    own, tried = plan[size]
    h = xxhash.xxh3_64_intdigest
    keys = [h(line[a:b], s) for s, a, b in own]
    if plan.bounds.deletes(size):
        less = {line[:i] + line[i + 1 :] for i in range(size)}
        keys += [h(x, _DELETED) for x in (less if size == plan.bounds.least_chars else less | {line})]
    return keys, [h(line[a:b], s) for s, a, b in tried]


def sketch(line: str) -> bytes:
    """256-bit parity sketch of the character pairs: an edit flips four bits at most."""
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    pairs = (codes[:-1] * np.uint64(0x9E3779B1) + codes[1:] * np.uint64(0x85EBCA77)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(56)
    return np.packbits(np.bincount(pairs.astype(np.int64), minlength=256) & 1).tobytes()


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance of two strings, or ``most + 1`` if it is larger.

    Common ends are cut off.  Then one machine word holds a diagonal band of
    ``2 * most + 1`` cells of the table: per column the vertical differences of
    the band are updated by additions and shifts, with the band moving down a
    row each time.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    while a and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    if not a:
        return len(b)
    width = 2 * most + 1
    full, middle = (1 << width) - 1, 1 << most
    # bit r of column j stands for row j - most + r; rows from 0 up to the left of the table count as row 0
    rises, falls, score = full & ~((middle << 1) - 1), 0, 0
    rows, at = len(a), {}
    for r, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << r
    for j, c in enumerate(b, 1):
        shift = j - most - 1  # bit r of the band is row j - most + r, character j - most + r - 1
        match = at.get(c, 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full
        # the band moves down a row: differences of the last column, one place lower
        up, down = rises >> 1 | 1 << (width - 1), falls >> 1
        diagonal = (((match & up) + up) ^ up) | match | down
        right_up = down | ~(diagonal | up)
        right_down = diagonal & up
        score += not diagonal >> most & 1
        shifted_up, shifted_down = right_up << 1, right_down << 1
        rises = (shifted_down | ~(diagonal | shifted_up)) & full
        falls = shifted_up & diagonal & full
        if score > most + len(b) - rows:
            return most + 1
    # score is the cell on the diagonal of row len(b); go up to row len(a)
    for row in range(len(b), rows, -1):
        r = most - (len(b) - row)
        score += (falls >> r & 1) - (rises >> r & 1)
    return min(score, most + 1)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a word: ``doc_id, line_no`` (from 0), ``line`` and its hash ``node``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("line_no", "raw"))
    # most lines have single spaces only, and need no pattern
    ragged = F.contains("raw", F.lit("  "))
    for blank in "\t\x0b\x0c\r":
        ragged = ragged | F.contains("raw", F.lit(blank))
    rows = rows.select("doc_id", "line_no", F.trim(F.when(ragged, squeezed("raw")).otherwise(F.col("raw"))).alias("line")).where("line <> ''")
    return rows.withColumn("node", F.unhex(F.md5(F.encode("line", "UTF-8"))))


def shared_keys(lines: DataFrame, bounds: Bounds, buckets: int) -> DataFrame:
    """``key``: the keys that an indexed line and another line have."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, seen, keys, nodes, counts = _Plan(bounds), set(), [], [], []
        for batch in batches:
            for node, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node in seen:
                    continue
                seen.add(node)
                own, tried = line_keys(line, plan)
                keys += own
                keys += tried
                nodes.append(int.from_bytes(node[:8], "little"))
                counts.append((len(own), len(tried)))
                if len(keys) >= MOST_KEYS:
                    yield _packed(keys, nodes, counts, buckets)
                    keys, nodes, counts, seen = [], [], [], set()
        if keys:
            yield _packed(keys, nodes, counts, buckets)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.concatenate([np.frombuffer(x, kind) for x in group[c]]) for c, kind in (("keys", "u8"), ("low", "u8"), ("high", "u8"), ("indexed", "u1"))]
        key, low, high, indexed = _per_key(*parts)
        return pd.DataFrame({"key": key[(low != high) & (indexed > 0)].view(np.int64)})

    packed = lines.select("node", "line").mapInArrow(send, "bucket int, keys binary, low binary, high binary, indexed binary")
    return packed.groupBy("bucket").applyInPandas(meet, "key long")


def _per_key(key: np.ndarray, low: np.ndarray, high: np.ndarray, indexed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, with the smallest and largest line and whether any was indexed."""
    order = np.argsort(key, kind="stable")
    key, low, high, indexed = key[order], low[order], high[order], indexed[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    if not len(starts):
        return key, low, high, indexed
    return key[starts], np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(indexed, starts)


def _packed(keys: list[int], nodes: list[int], counts: list[tuple[int, int]], buckets: int) -> pa.RecordBatch:
    key = np.array(keys, np.uint64)
    each = np.array(counts)
    line = np.repeat(np.array(nodes, np.uint64), each.sum(1))
    indexed = np.repeat(np.tile(np.array([1, 0], np.uint8), len(counts)), each.ravel())
    key, low, high, indexed = _per_key(key, line, line, indexed)
    to = (key >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    rows = [(b, order[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]
    columns = [pa.array([b for b, _ in rows], pa.int32())] + [pa.array([x[at].tobytes() for _, at in rows], pa.binary()) for x in (key, low, high, indexed)]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "low", "high", "indexed"])


def _members(lines: DataFrame, bounds: Bounds) -> DataFrame:
    """Per line: ``node, chars``, and ``keys``, of which the first ``own`` are index keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, seen = _Plan(bounds), set()
        for batch in batches:
            nodes, chars, first, keys, ends = [], [], [], [], [0]
            for node, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node in seen:
                    continue
                seen.add(node)
                own, tried = line_keys(line, plan)
                keys += own
                keys += tried
                ends.append(len(keys))
                nodes.append(node)
                chars.append(len(line))
                first.append(len(own))
            if len(seen) > 500_000:
                seen.clear()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(chars, pa.int32()), pa.array(first, pa.int32()), lists], ["node", "chars", "own", "keys"])

    return lines.select("node", "line").mapInArrow(run, "node binary, chars int, own int, keys array<long>")


def _sketched(texts: DataFrame) -> DataFrame:
    """``node, line`` with the sketch as ``s0 .. s3``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            four = np.frombuffer(b"".join(map(sketch, batch.column(1).to_pylist())), "<i8").reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(four[:, i])) for i in range(4)]], ["node", "line", "s0", "s1", "s2", "s3"])

    return texts.mapInArrow(run, "node binary, line string, s0 long, s1 long, s2 long, s3 long")


def edit_links(lines: DataFrame, most_edits: int = MOST_EDITS, least_chars: int = LEAST_CHARS, short_chars: int = SHORT_CHARS) -> DataFrame:
    """``a, b, distance``: all pairs of different lines within the distance, by their hashes.

    ``lines``: as from :func:`lines_of`, written, as they are read three times.
    """
    if least_chars <= most_edits:
        raise ValueError("least_chars must be above most_edits")
    if short_chars < 2:
        raise ValueError("short_chars must be 2 at least")
    bounds = Bounds(most_edits, least_chars, short_chars)
    buckets = max(8, lines.count() // BUCKET_LINES)
    lines = lines.where(F.length("line") >= min(short_chars, least_chars))
    shared = written(shared_keys(lines, bounds, buckets), "line-shared")
    members = _members(lines, bounds).select("node", "chars", "own", F.posexplode("keys").alias("at", "key"))
    members = _listed(members, "key", shared).join(shared, "key", "left_semi")
    members = written(members.groupBy("key", "node").agg(F.max("chars").alias("chars"), F.max(F.col("at") < F.col("own")).alias("indexed")), "line-members")
    nodes = written(members.select("node").distinct(), "line-nodes")
    texts = _listed(lines.select("node", "line"), "node", nodes).groupBy("node").agg(F.min("line").alias("line"))
    texts = written(_sketched(texts.join(nodes, "node", "left_semi")), "line-texts")
    sketches = members.join(texts.drop("line"), "node")

    left = sketches.where("indexed").alias("x")
    right = sketches.alias("y")
    flips = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(4)), F.lit(0))
    most = bounds.column(F.col("x.chars"))
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & F.col("y.chars").between(F.col("x.chars"), F.col("x.chars") + most) & (flips <= 4 * most)
    pairs = left.join(right, near).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    pairs = written(pairs.distinct(), "line-pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            most = [bounds.edits(min(len(x), len(y))) for x, y in both]
            far = [edit_distance(x, y, m) for (x, y), m in zip(both, most)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.int32())], ["a", "b", "distance"])
            yield out.filter(pa.array([d <= m for d, m in zip(far, most)], pa.bool_()))

    texts_only = texts.select("node", "line")
    both = pairs.join(texts_only.withColumnsRenamed({"node": "a", "line": "x"}), "a").join(texts_only.withColumnsRenamed({"node": "b", "line": "y"}), "b")
    links = written(both.select("a", "b", "x", "y").mapInArrow(verify, "a binary, b binary, distance int"), "line-links")
    discard(shared, members, nodes, texts, pairs)
    return links


def _listed(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``column`` may be in the written table ``keys``; a bitmap of bounded size lets some others through."""
    bits = filter_bits(keys.count())
    return maybe_listed(rows, [F.col(column)], key_filter(keys, [column], bits), bits, "maybe").where("maybe").drop("maybe")


def line_classes(docs: DataFrame, most_edits: int = MOST_EDITS, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", short_chars: int = SHORT_CHARS) -> DataFrame:
    """One row per line: ``doc_id, line_no, class_doc_id, class_line_no, class_size, n_links, kept``.

    ``n_links`` counts the different lines within the distance, ``class_size``
    all lines of the class with their copies.
    """
    lines = written(lines_of(docs, id_col, text_col), "line-table")
    links = edit_links(lines, most_edits, least_chars, short_chars)
    both = links.select("a").unionByName(links.select(F.col("b").alias("a")))
    counts = both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
    labels = components(links)
    linked = written(labels.select("node", "component").join(counts, "node"), "line-linked")
    rows = lines.select("doc_id", "line_no", "node").join(linked, "node", "left").select("doc_id", "line_no", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    rows = written(rows, "line-placed")
    discard(lines, links, labels, linked)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    classes = written(rows.groupBy("component").agg(F.min(first).alias("one"), F.count(F.lit(1)).alias("class_size")), "line-classes")
    out = rows.join(classes, "component")
    kept = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("line_no") == F.col("one.line_no"))
    return out.select("doc_id", "line_no", F.col("one.doc_id").alias("class_doc_id"), F.col("one.line_no").alias("class_line_no"), "class_size", "n_links", kept.alias("kept"))


def drop_near_lines(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the lines that ``judged`` (from :func:`line_classes`) does not keep."""
    gone = judged.where(~F.col("kept")).groupBy(F.col("doc_id").alias("__of")).agg(F.collect_set("line_no").alias("__gone"))
    left = F.filter(F.transform(F.split(text_or_empty(text_col), "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line"))), lambda x: ~F.array_contains("__gone", x["i"]))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda x: x["line"]), "\n"))
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__of")), "left").withColumn(text_col, text).drop("__of", "__gone")
