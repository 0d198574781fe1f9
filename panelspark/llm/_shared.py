"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"

#: Places of the tables of :func:`written` that are still there.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Names of those that :func:`bucketed` put into the session's catalog.
_NAMES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a new folder
    of its own under the temporary folder.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelspark-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new Parquet table in the shared folder and read it back.

    Later jobs then start from the table: a lost executor costs a reread, not a
    recomputation of all that came before.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[table] = path
    return table


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like :func:`written`, in ``buckets`` parts by the hash of ``key``: grouping by it needs no exchange."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    _PLACES[out], _NAMES[out] = path, table
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` or :func:`bucketed` that nothing will read again; other DataFrames are left alone."""
    for table in tables:
        name, place = _NAMES.pop(table, None), _PLACES.pop(table, None)
        if name is not None:
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if place is not None:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def squeezed(column: str | Column) -> Column:
    """The text with each run of blanks as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(column), BLANKS, " ")


def filter_bits(keys: int) -> int:
    """Bits of a bitmap for so many keys: 16 a key, from 2**16 up to 2**26.

    A bitmap has 1,048,576 words at most, whatever the input.  Beyond 2**22 keys
    it lets more and more other rows through, so an exact join has to follow.
    """
    return 1 << min(26, max(16, (16 * keys - 1).bit_length()))


def key_filter(keys: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """Bitmap of the hashed ``columns`` of ``keys``, as words of 64 bits: at most ``bits / 64`` rows.

    Its size depends on ``bits`` alone, never on the number of keys, so it may
    be broadcast.  Keys that share a bit only let more rows through.
    """
    at = F.pmod(F.xxhash64(*columns), F.lit(bits))
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    return keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))


def maybe_listed(df: DataFrame, columns: list[Column], bitmap: DataFrame, bits: int, flag: str) -> DataFrame:
    """``df`` with boolean ``flag``: false only if ``columns`` are surely not in ``bitmap``."""
    at = F.pmod(F.xxhash64(*columns), F.lit(bits))
    probe = df.withColumn("__at", at).withColumn("__word", F.shiftright("__at", 6))
    hit = F.coalesce(F.expr("shiftright(__bits, cast(__at & 63 as int)) & 1 = 1"), F.lit(False))
    return probe.join(F.broadcast(bitmap), "__word", "left").withColumn(flag, hit).drop("__word", "__bits", "__at")
