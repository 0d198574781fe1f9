"""Exact duplicates by progressive refinement, with DataFrame functions only.

Texts are equal when they are identical after each run of blanks became one
space.  Three keys of growing cost narrow the rows down:

1. length of the squeezed text,
2. hash of its first ``prefix_chars`` characters, for lengths that occur twice,
3. SHA-256 of the whole squeezed text, for (length, prefix) pairs that occur
   twice.

Rows learn whether their key survived a level from a bitmap of fixed size
(:func:`~panelspark.llm._shared.key_filter`), so no text is shuffled to find
out.  Two keys on one bit let a row go on to the next level, where it falls out;
they never join two texts, as groups are made by the full hash.

Defined results: null text equals the empty text.  A null id sorts last, so a
group keeps a null id only if it has no other.  Rows that repeat both id and
text count in the group's size; all of them are marked as kept, and
:func:`drop_exact_copies` returns one of them.  An empty table gives an empty
table.  Extra columns of any name are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm._shared import key_filter, maybe_listed, squeezed, written

#: Bits of the bitmaps that mark surviving keys; 131072 words, whatever the input.
FILTER_BITS = 1 << 23


def _survivors(docs: DataFrame, text: str, prefix_chars: int, bits: int) -> DataFrame:
    """Bitmap of the (length, prefix hash) keys that more than one row has."""
    squeeze = docs.select(squeezed(text).alias("t"))
    keys = written(squeeze.select(F.length("t").alias("size"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("prefix")), "exact-keys")
    lengths = keys.groupBy("size").count().where("count > 1")
    alike = maybe_listed(keys, [F.col("size")], key_filter(lengths, ["size"], bits), bits, "again").where("again")
    pairs = alike.groupBy("size", "prefix").count().where("count > 1")
    return written(key_filter(pairs, ["size", "prefix"], bits), "exact-survivors")


def _hashed(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, bits: int) -> DataFrame:
    """Columns ``row`` (the input's row), ``id``, ``t`` (squeezed), and ``digest`` of survivors (else null)."""
    found = _survivors(docs, text_col, prefix_chars, bits)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), squeezed(text_col).alias("t"))
    key = [F.length("t"), F.xxhash64(F.substring("t", 1, prefix_chars))]
    marked = maybe_listed(rows, key, found, bits, "again")
    return marked.withColumn("digest", F.when(F.col("again"), F.sha2(F.encode("t", "UTF-8"), 256))).drop("again")


def _groups(hashed: DataFrame) -> DataFrame:
    """One row per digest that more than one row has."""
    return hashed.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, prefix_chars: int = 64, bits: int = FILTER_BITS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, digest``, and ``carry``.

    ``digest`` is null where a shorter key already told the text from all others.
    ``carry`` names further columns, made from the squeezed text ``t``.
    """
    carry = carry or {}
    rows = _hashed(docs, id_col, text_col, prefix_chars, bits)
    rows = written(rows.select("id", "digest", *[c.alias(n) for n, c in carry.items()]), "exact-rows")
    again = rows.where("digest is not null")
    groups = written(_groups(again), "exact-groups")
    single = rows.where("digest is null").select("id", "digest", *carry, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    found = again.join(groups, "digest", "left").select("id", "digest", *carry, F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    out = single.unionByName(found)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", *carry)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, bits: int = FILTER_BITS) -> DataFrame:
    """The input's rows and columns, one row for each distinct text: that with the smallest id.

    Texts that no other row can equal pass straight through; only possible
    copies are shuffled, by digest and id, which spreads even a group that
    holds a third of all rows.
    """
    rows = _hashed(docs, id_col, text_col, prefix_chars, bits)
    keep = written(rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("keep_id")), "exact-keep")
    single = rows.where("digest is null").select("row.*")
    again = rows.where("digest is not null").select("row", "id", "digest")
    found = again.join(keep.withColumnRenamed("digest", "kept_digest"), F.col("digest").eqNullSafe(F.col("kept_digest")) & F.col("id").eqNullSafe(F.col("keep_id")))
    one = found.groupBy("digest", "id").agg(F.first("row").alias("row"))
    return single.unionByName(one.select("row.*"))
