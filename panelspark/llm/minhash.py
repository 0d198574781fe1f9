"""Near duplicates by DartMinHash signatures and banded joining.

A text is a weighted set of its shingles of five words, weighted by how often
they occur; similarity is weighted Jaccard, the sum of minima over the sum of
maxima.  Texts under five words are one shingle of what words they have.

Signatures.  Picture every element as a strip as wide as its weight, along an
axis of ranks from 0 up.  Darts with hashed positions fall on the strips, one
per unit of area on average; the darts on a strip depend only on the element, so
two sets share the darts where their strips overlap.  Each dart belongs to a
hashed coordinate, and the earliest dart (lowest rank) of a coordinate is kept.
Two sets agree in a coordinate with probability equal to their similarity.  The
strips are walked in slabs of rising rank until every coordinate has a dart:
about k ln k darts for k coordinates, whatever the number of elements.

Candidates.  Signatures are cut into bands; sets that agree in a whole band meet
in a bucket.  In every bucket the members are compared with one leader.  Members
that then still belong to different components are compared with another leader;
what remains across components is compared pair by pair.  Members of one
component are never compared again, so a large group of close copies costs a few
comparisons a member.  A pair is only compared if its sizes allow the threshold
and a sketch of two bits a coordinate comes within 3.5 deviations of it, which
the join itself tests.  Buckets that are still large, as of copies that differ
from each other by more than the threshold, are cut into blocks; a task takes two
blocks, counts common shingles by an inverted index, and returns only the links
that join components, never the pairs.

Texts with equal shingles are one node from the start, so copies are never
expanded.  All comparisons are exact weighted Jaccard on the shingles.

Defined results: null and empty texts have no words; they are one class.  Rows
that repeat an id are separate rows; a class is named by its smallest id (null
if it has no other).  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm._shared import discard, filter_bits, key_filter, maybe_listed, text_or_empty, written
from panelspark.llm.components import components

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 6
#: Rounds of comparison with leaders before the rest is compared pair by pair.
ROUNDS = 2
#: Members up to which a bucket's remaining pairs go through a join; larger ones are compared in blocks of ``BLOCK``.
MOST_JOINED, BLOCK = 48, 1000
#: Deviations that the sketch's estimate may lie below the threshold.
SLACK = 3.5
#: Height of the first slab, as a power of two.
FIRST_SLAB = -6
#: Words that are hashed together, and elements whose darts are thrown together.
MOST_WORDS = 1_000_000
CHUNK = 200_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers from others (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_cells(text: bytes, hashes: dict, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit cells of a text: one for each occurrence of each shingle.

    The j-th occurrence of a shingle is a cell of its own, so that weighted
    Jaccard of two texts is plain Jaccard of their cells.
    """
    words = text.split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    if len(h) < width:
        h = np.concatenate([h, np.zeros(width - len(h), np.uint64)])
    x = np.zeros(n, np.uint64)
    for j in range(width):
        x = (x + h[j : j + n]) * _M1
        x ^= x >> np.uint64(29)
    x = np.sort(_mix(x))
    again = np.flatnonzero(x[1:] == x[:-1]) + 1
    if len(again):
        new = np.ones(n, bool)
        new[again] = False
        starts = np.flatnonzero(new)
        occurrence = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        x = np.where(occurrence > 0, _mix(x + occurrence.astype(np.uint64) * _M1), x)
        x.sort()
    return x


def dart_signatures(cells: np.ndarray, starts: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Signatures (sets x k) of the sets ``cells[starts[i]:starts[i + 1]]``, none of them empty.

    Slabs double in height; those higher than 1 are made of steps of height 1,
    and a step of height h holds Poisson(h) darts a cell.  A signature value is
    the dart's step and rank followed by its identity, so values agree only for
    the same dart.
    """
    sets = len(starts) - 1
    best = np.full(sets * k, np.iinfo(np.uint64).max, np.uint64)
    active, step, low = np.arange(sets), 0, 0.0
    mine, owner = cells, np.repeat(np.arange(sets), np.diff(starts))
    while len(active):
        slab = 2.0**FIRST_SLAB if step == 0 else low
        steps = max(1, round(slab))
        height = slab / steps
        walk = np.uint64(step) + np.arange(steps, dtype=np.uint64)
        base = _mix((mine[:, None] ^ ((walk + np.uint64(1)) * _M3 + np.uint64(seed))[None, :]).ravel())
        at_step, at_set = np.tile(walk, len(mine)), np.repeat(owner, steps)
        u = (base >> np.uint64(11)).astype(float) * 2.0**-53
        chance, total, j = np.exp(-height), np.exp(-height), 0
        at = np.flatnonzero(u >= total)
        while len(at):  # the cells with more than j darts
            dart = _mix(base[at] + np.array([j + 1], np.uint64) * _M1)
            rank = (dart >> np.uint64(34)).astype(np.uint64)  # 30 bits inside the slab
            identity = _mix(dart)
            value = (at_step[at] << np.uint64(50)) | (rank << np.uint64(20)) | (identity & np.uint64(0xFFFFF))
            coordinate = ((identity >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            np.minimum.at(best, at_set[at] * k + coordinate.astype(np.int64), value)
            j += 1
            chance *= height / j
            total += chance
            at = at[u[at] >= total] if chance > 1e-18 else at[:0]
        low += slab
        step += steps
        missing = (best.reshape(sets, k)[active] == np.iinfo(np.uint64).max).any(1)
        if not missing.all():
            active = active[missing]
            keep = np.zeros(sets, bool)
            keep[active] = True
            of = keep[owner]
            mine, owner = mine[of], owner[of]
    return best.reshape(sets, k)


def _band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _M2, parts.shape[:2]).copy()
    for r in range(rows):
        key = _mix(key * _M1 + parts[:, :, r])
    return key.view(np.int64)


def _sketches(signatures: np.ndarray) -> np.ndarray:
    """Two bits of every coordinate, 32 coordinates a long."""
    n, k = signatures.shape
    two = np.zeros((n, -(-k // 32) * 32), np.uint64)
    two[:, :k] = signatures & np.uint64(3)
    places = np.arange(32, dtype=np.uint64) * np.uint64(2)
    return (two.reshape(n, -1, 32) << places).sum(2, dtype=np.uint64).view(np.int64)


def most_mismatches(k: int, threshold: float) -> int:
    """Sketch coordinates that may differ: two bits agree with probability s + (1 - s) / 4."""
    agree = threshold + (1 - threshold) / 4
    return int(k * (1 - agree) + SLACK * (k * agree * (1 - agree)) ** 0.5)


def _chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Cells of the texts of a batch, some texts at a time: first row, and one array a text."""
    hashes, first, got, size = _WordHash(), 0, [], 0
    for i, value in enumerate(column):
        cells = shingle_cells(value.as_py(), hashes)
        got.append(cells)
        size += len(cells)
        if size >= most:
            yield first, got
            first, got, size = i + 1, [], 0
    if got:
        yield first, got


def set_bands(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, text_key, node`` (128-bit hash of the weighted set), ``cells``, ``bands``, ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, cells in _chunks(batch.column(2)):
                starts = np.cumsum([0, *map(len, cells)])
                signatures = dart_signatures(np.concatenate(cells), starts, bands * rows, seed)
                keys, sketches = _band_keys(signatures, bands, rows), _sketches(signatures)
                some = batch.slice(first, len(cells))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype="i4") * bands), pa.array(keys.ravel()))
                nodes = pa.array([xxhash.xxh3_128_digest(c.tobytes()) for c in cells], pa.binary())
                wide = sketches.shape[1]
                more = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype="i4") * wide), pa.array(sketches.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), nodes, pa.array(np.diff(starts)), lists, more], ["doc_id", "text_key", "node", "cells", "bands", "sketch"])

    text = text_or_empty(text_col)
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.encode(text, "UTF-8").alias("text"))
    return rows_in.mapInArrow(run, "doc_id long, text_key long, node binary, cells long, bands array<long>, sketch array<long>")


def _listed(rows: DataFrame, columns: list[str], keys: DataFrame, name: list[str]) -> DataFrame:
    """The rows whose ``columns`` may be among the ``name`` columns of the written table ``keys``.

    A bitmap of bounded size lets others through as well; what follows joins the keys themselves.
    """
    bits = filter_bits(keys.count())
    return maybe_listed(rows, [F.col(c) for c in columns], key_filter(keys, name, bits), bits, "maybe").where("maybe").drop("maybe")


def _elements(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, elements``: sorted 32-bit hashes of the cells, for one text of each node in ``wanted``.

    ``wanted``: ``doc_id, text_key, node``, written.  Two texts' elements meet by chance in
    one of 2**32, too rarely to move a similarity by more than a millionth.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, cells in _chunks(batch.column(1)):
                packed = [np.sort((c >> np.uint64(32)).astype(np.uint32)).tobytes() for c in cells]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(cells)), pa.array(packed, pa.binary())], ["node", "elements"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.encode(text, "UTF-8").alias("text"))
    rows = _listed(rows, ["doc_id", "text_key"], wanted, ["doc_id", "text_key"])
    key = F.xxhash64("doc_id", "text_key")
    found = rows.select(key.alias("of"), "text").join(wanted.select(key.alias("of"), "node"), "of").dropDuplicates(["of"])
    return written(found.select("node", "text").mapInArrow(run, "node binary, elements binary"), "near-elements")


def _similar(pairs: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """The pairs (``a, b``, a written table) whose texts are similar enough, written.

    Both joins have one row a node on the element side, and the pairs' side may
    be split, so a leader of a large group is no bottleneck.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                both = _common(x, y)
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep))

    nodes = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "near-asked")
    some = written(_listed(elements, ["node"], nodes, ["node"]), "near-some")
    discard(nodes)
    joined = pairs.join(some.withColumnsRenamed({"node": "b", "elements": "y"}), "b").join(some.withColumnsRenamed({"node": "a", "elements": "x"}), "a")
    found = written(joined.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary"), "near-links")
    discard(some)
    return found


def _block_links(rest: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` that join components inside large buckets.

    ``rest``: ``bucket, node, component, members``.  A bucket of n members has
    ``(n / BLOCK) ** 2 / 2`` pairs of blocks, a task each; a member goes to
    ``n / BLOCK`` of them.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = rest.select("bucket", "node", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("partner"))
    rows = rows.select("bucket", "node", "component", F.least("own", "partner").alias("i"), F.greatest("own", "partner").alias("j"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint32) for x in pdf["elements"]]
        size = np.array([len(x) for x in sets])
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        holder = np.repeat(np.arange(len(sets)), size)[np.argsort(code, kind="stable")]
        begin = np.concatenate([[0], np.cumsum(np.bincount(code))])
        mine = np.split(code, np.cumsum(size)[:-1])
        label = pd.factorize(pdf["component"])[0]
        out = []
        for x, codes in enumerate(mine):
            there = np.concatenate([holder[begin[c] : begin[c + 1]] for c in codes])
            both = np.bincount(there, minlength=len(sets))
            near = np.flatnonzero((both >= threshold * (size + size[x] - both) - 1e-9) & (label != label[x]))
            for y in near:
                if label[y] != label[x]:
                    label[label == label[y]] = label[x]
                    out.append((pdf["node"].iat[x], pdf["node"].iat[y]))
        return pd.DataFrame([(min(a, b), max(a, b)) for a, b in out], columns=["a", "b"])

    nodes = written(rest.select("node").distinct(), "near-asked")
    some = _listed(elements, ["node"], nodes, ["node"])
    return rows.join(some, "node").groupBy("bucket", "i", "j").applyInPandas(link, "a binary, b binary")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    z = np.concatenate([x, y])
    z.sort(kind="stable")
    same = z[1:] == z[:-1]
    if len(same) and (same[1:] & same[:-1]).any():  # a value more than twice: count with multiplicity
        a, n = np.unique(x, return_counts=True)
        b, m = np.unique(y, return_counts=True)
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        return int(np.minimum(n[i], m[j]).sum())
    return int(same.sum())


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, text_key, class_id, class_size, kept``.

    ``kept`` marks the row whose id names the class.
    """
    sets = written(set_bands(docs, bands, rows, seed, id_col, text_col), "near-sets")
    nodes = written(sets.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.max("cells").alias("cells"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch")), "near-nodes")
    sets_slim = written(sets.select("doc_id", "text_key", "node"), "near-sets")
    discard(sets)
    parts = [F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(-(-bands * rows // 32))]
    members = _bucket_members(nodes, parts)
    wanted = written(members.select("node").distinct().join(nodes, "node").select("one.doc_id", "one.text_key", "node"), "near-wanted")
    elements = _elements(docs, wanted, id_col, text_col)
    names = written(nodes.select("node", F.col("one.doc_id").alias("id")), "near-names")
    discard(nodes, wanted)

    sketch = [f"s{i}" for i in range(len(parts))]
    as_other = {c: f"other_{c}" for c in ("node", "cells", "component", *sketch)}
    differ = sum((F.bit_count((F.col(c).bitwiseXOR(F.col(f"other_{c}")).bitwiseOR(F.shiftrightunsigned(F.col(c).bitwiseXOR(F.col(f"other_{c}")), 1))).bitwiseAND(F.lit(0x5555555555555555))) for c in sketch), F.lit(0))
    fits = (F.col("component") != F.col("other_component")) & (F.least("cells", "other_cells") >= threshold * F.greatest("cells", "other_cells")) & (differ <= most_mismatches(bands * rows, threshold))
    links = members.sparkSession.createDataFrame([], "a binary, b binary")
    tested, labels, tables = links, None, []
    for turn in range(ROUNDS + 1):
        at = members.withColumn("component", F.col("node")) if labels is None else members.join(labels.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        at = at if labels is None else written(at, "near-placed")
        lead = F.min_by(F.struct("node", "cells", "component", *sketch), F.xxhash64("node", F.lit(turn)))
        mixed = written(at.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), lead.alias("lead")).where("least <> most"), "near-leaders")
        if turn < ROUNDS:
            other = mixed.select("bucket", "lead.*").withColumnsRenamed(as_other)
            pairs = at.join(other, (at["bucket"] == other["bucket"]) & fits)
        else:
            rest = at.join(mixed.select("bucket"), "bucket", "left_semi")
            rest = written(rest.join(rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")), "bucket"), "near-rest")
            few = rest.where(F.col("members") <= MOST_JOINED).drop("members")
            other = few.withColumnsRenamed(as_other | {"bucket": "other_bucket"})
            pairs = few.join(other, (F.col("bucket") == F.col("other_bucket")) & (F.col("node") < F.col("other_node")) & fits)
        pairs = pairs.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti") if turn else pairs, "near-pairs")
        found = _similar(pairs, elements, threshold)
        tables += [pairs, found]
        if turn == ROUNDS:
            found = written(found.unionByName(_block_links(rest.where(F.col("members") > MOST_JOINED), elements, threshold)), "near-links")
            tables += [found, rest]
        discard(mixed, at)
        tested = tested.unionByName(pairs)
        if not found.isEmpty():
            links = links.unionByName(found)
            discard(*([labels] if labels is not None else []))
            labels = components(links)
    discard(members, elements, *tables)

    named = names.join(labels.select("node", "component"), "node", "left") if labels is not None else names.withColumn("component", F.col("node"))
    named = written(named.select("node", F.coalesce("component", "node").alias("component")), "near-named")
    placed = written(sets_slim.join(named, "node").select("doc_id", "text_key", "component"), "near-rows")
    discard(sets_slim, named, names, *([labels] if labels is not None else []))
    classes = written(placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("one"), F.count(F.lit(1)).alias("class_size")), "near-classes")
    out = placed.join(classes, "component")
    kept = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("text_key") == F.col("one.text_key"))
    return out.select("doc_id", "text_key", F.col("one.doc_id").alias("class_id"), "class_size", kept.alias("kept"))


def _bucket_members(nodes: DataFrame, parts: list) -> DataFrame:
    """``bucket, node, cells`` and the sketch, for the buckets that hold two nodes or more.

    A bitmap keeps most lone bands from the exact join with the shared buckets,
    which moves two numbers a band; cells and sketches join afterwards, by node.
    """
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = written(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "near-shared")
    held = _listed(spread, ["bucket"], shared, ["bucket"]).join(shared, "bucket", "left_semi")
    members = written(held.join(nodes.select("node", "cells", *parts), "node").select("bucket", "node", "cells", *[f"s{i}" for i in range(len(parts))]), "near-members")
    discard(shared)
    return members


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows and columns, one row for each class.

    Rows that are alone in their class pass straight through; only the members
    of larger classes are shuffled, by id and text.
    """
    classes = written(near_classes(docs, id_col=id_col, text_col=text_col, **options).where("class_size > 1"), "near-copies")
    bits = filter_bits(classes.count())
    marks = key_filter(classes, ["doc_id", "text_key"], bits)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_key"))
    rows = maybe_listed(rows, [F.col("doc_id"), F.col("text_key")], marks, bits, "maybe")
    single = rows.where(~F.col("maybe")).select("row.*")
    verdict = classes.groupBy(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key")).agg(F.max("kept").alias("kept"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key"))
    again = rows.where("maybe").join(verdict, same, "left")
    alone = again.where("kept is null").select("row.*")
    one = again.where("kept").groupBy("doc_id", "text_key").agg(F.first("row").alias("row"))
    return single.unionByName(alone).unionByName(one.select("row.*"))
