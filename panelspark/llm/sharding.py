"""Uniform shuffle of rows into shards of exact sizes, with DataFrame functions only.

The rows lie in source partitions.  A communication matrix says how many rows of
each source partition go to each shard; drawn from the multivariate
hypergeometric law with the partition sizes as row sums and the shard sizes as
column sums, it has the law that a uniform permutation of all rows would give.
Each partition permutes its rows where they are read and deals them out by its
line of the matrix; then the rows are exchanged, once, and each shard permutes
what it got.  Both permutations are orders by a seeded hash, the first one a
sort inside the partition, the second one over sub-blocks of a shard, so no task
sorts a whole shard and no texts move.

The draws are in double precision: they leave out outcomes less likely than
1e-20 times the likeliest.

Defined results: a null text counts as empty.  Rows that agree in id and text
are interchangeable: both get a place, in either order.  An empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelspark.llm._shared import text_or_empty, written

#: Rows that one sub-block of a shard is meant to have.
BLOCK_ROWS = 50_000
#: Most source partitions, and so most lines of the matrix that the driver draws; more are read together.
MOST_PARTS = 4096


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among ``drawn`` of ``good + bad``.

    Inverts the distribution function over the outcomes within 10 deviations, and
    50 more, of the mode; neighbouring probabilities have a ratio of small fractions.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    share = good / (good + bad)
    reach = 50 + int(10 * (drawn * share * (1 - share)) ** 0.5)
    first, last = max(low, mode - reach), min(high, mode + reach)
    up = np.arange(mode, last, dtype=float)  # from k to k + 1
    down = np.arange(mode, first, -1, dtype=float)  # from k to k - 1
    above = np.cumprod((good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1)))
    below = np.cumprod(down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1)))
    ends = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return first + min(int(np.searchsorted(ends, rng.random() * ends[-1], side="right")), len(ends) - 1)


def communication_matrix(part_sizes: Sequence[int], shard_sizes: Sequence[int], seed: int = 0) -> list[list[int]]:
    """Rows of each source partition for each shard; line and column sums are exact."""
    if sum(part_sizes) != sum(shard_sizes):
        raise ValueError("partitions and shards must hold the same number of rows")
    rng, left, matrix = np.random.default_rng(seed), list(shard_sizes), []
    for size in part_sizes:
        line, rest, pool = [], size, sum(left)
        for room in left:
            pool -= room
            k = _hypergeometric(rng, room, pool, rest)
            line.append(k)
            rest -= k
        left = [a - b for a, b in zip(left, line)]
        matrix.append(line)
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that differ by one at most."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _matrix_frame(spark: SparkSession, parts: list[int], matrix: list[list[int]]) -> DataFrame:
    """Per partition, the running totals of its line: rank r goes to the first shard whose total is above r."""
    rows = []
    for part, line in zip(parts, matrix):
        total, ends = 0, []
        for k in line:
            total += k
            ends.append(total)
        rows.append((part, ends))
    return spark.createDataFrame(rows, T.StructType([T.StructField("part", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))]))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot``.

    Shards hold equally many rows, or one more; ``slot`` counts from 0 in each
    shard.  The matrix is broadcast: at most ``MOST_PARTS`` lines of ``shards``
    numbers.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    raw = docs.coalesce(MOST_PARTS).select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    spread = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")
    keyed = raw.withColumn("first", F.xxhash64(F.lit(seed + 1), spread)).withColumn("second", F.xxhash64(F.lit(seed + 2), spread))
    # the number of a row counts from 0 in its partition, whose own number stands above bit 33
    place = keyed.sortWithinPartitions("first", "doc_id", "text_crc32").withColumn("at", F.monotonically_increasing_id())
    keyed = written(place.select("doc_id", "size", "text_crc32", "second", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("rank")), "shard-rows")

    counts = sorted((r["part"], r["count"]) for r in keyed.groupBy("part").count().collect())  # MOST_PARTS rows at most
    total = sum(n for _, n in counts)
    sizes = shard_sizes(total, shards)
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    lines = _matrix_frame(spark, [p for p, _ in counts], matrix)

    dealt = keyed.join(F.broadcast(lines), "part")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda end: end <= F.col("rank"))))
    blocks = max(1, -(-total // (shards * BLOCK_ROWS)))
    dealt = dealt.withColumn("block", F.floor(F.pmod("second", F.lit(1 << 40)) / (1 << 40) * blocks))
    dealt = written(dealt.select("doc_id", "size", "text_crc32", "shard", "block", "second"), "shard-dealt")

    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    again = Window.partitionBy("shard", "block").orderBy("second", "doc_id", "text_crc32")
    placed = dealt.withColumn("within", F.row_number().over(again) - 1).join(starts, ["shard", "block"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"))
