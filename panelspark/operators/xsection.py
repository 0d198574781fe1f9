"""Cross-section transforms: statistics of a month's rows, applied to the same rows.

Every function takes ``by``, the columns that make a cross-section, so that one
job serves all models, groups or methods.  Statistics are aggregates joined
back: one shuffle of the rows, and a small table on the other side.  Ranks and
quantiles come from one sort over many tasks, so that a cross-section may be
larger than a task; the sorted rows are written, as their places need two reads.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelspark.sources.scratch import discard, new_place, parts, spread, usual, written


def quantiles(column: str, at: Sequence[float]) -> Column:
    """Linearly interpolated quantiles as an array; for the groups of a cross-section, whose values one task holds."""
    return F.percentile(column, F.array(*[F.lit(float(a)) for a in at]))


#: Rank error of Spark's quantile sketch as a share of the rows, points asked of it, and rows of an interval that one task takes whole.
SKETCH_ACCURACY, POINTS, SMALL_GROUP = 10_000, 256, 20_000


@dataclass
class _Search:
    """A rank (from 0) of one group's values, known to lie in an open interval of values (None: without end)."""

    rank: int
    inside: int
    sketch: list[float] | None = None
    low: float | None = None
    high: float | None = None
    below: int = 0
    value: float | None = None

    def cuts(self) -> list[float]:
        """Where to cut the column next: the interval's ends, and two of its sketch's points around the rank."""
        inner = []
        if self.inside > SMALL_GROUP and self.sketch:
            at, slack = (self.rank - self.below + 0.5) / self.inside, 2 / SKETCH_ACCURACY + 1 / self.inside
            inner = [self.sketch[max(int((at - slack) * POINTS), 0)], self.sketch[min(int((at + slack) * POINTS) + 1, POINTS)]]
        return [c for c in (self.low, *inner, self.high) if c is not None]

    def expected(self) -> tuple[float | None, float | None]:
        """The open interval between cuts that probably holds the rank."""
        cuts = self.cuts()
        ends = (self.low is not None) + (self.high is not None)
        return (self.low, self.high) if len(cuts) == ends else (cuts[-3 if self.high is not None else -2], cuts[-2 if self.high is not None else -1])


def whole_quantiles(df: DataFrame, column: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by, q``: exact interpolated quantiles of whole columns, however many rows a group has.

    :func:`quantiles` holds all values of a group in one task; here none does, and
    nothing is sorted or ranked by a window.  Each pass cuts a column at a few of
    its values and is one aggregate of fixed size: it counts the values at and
    between the cuts, which tells the piece that holds a wanted rank, and sketches
    the pieces where ranks are expected, which gives the next cuts some hundred
    times closer; a piece of at most ``SMALL_GROUP`` values is sorted whole.  Counts
    alone decide, so a sketch that misses costs a pass, never the result.  Passes
    run when this is called: two for small columns, three up to some 10^6 values,
    four up to 10^8.  ``df`` is read by each, and the driver keeps a few numbers a
    group and rank: use it for few groups, such as the columns of a table.  Groups
    without values have a null ``q``, a whole column without values an array of nulls;
    null keys are a group.
    """
    at, by = [float(a) for a in at], list(by)
    spark, x = df.sparkSession, F.col(column)
    values = df.select(*by, x.cast("double").alias(column))
    shares = [i / POINTS for i in range(POINTS + 1)]
    sketch = lambda c: F.percentile_approx(c, shares, SKETCH_ACCURACY)
    first = values.groupBy(*by).agg(F.count(x).alias("__n"), sketch(x).alias("__s")).collect()
    sizes = {tuple(r[c] for c in by): r["__n"] for r in first}
    found: dict[tuple, dict[int, _Search]] = {}
    for r in first:
        n = r["__n"]
        ranks = {f((n - 1) * a) for a in at for f in (math.floor, math.ceil)} if n else set()
        found[tuple(r[c] for c in by)] = {k: _Search(k, n, r["__s"]) for k in ranks}
    keys = df.select(*by).schema.fields
    while todo := {g: some for g in found if (some := [s for s in found[g].values() if s.value is None])}:
        cuts = {g: sorted({c for s in some for c in s.cuts()}) for g, some in todo.items()}
        # piece 2j lies between cuts j and j + 1, piece 2j - 1 is the values equal to cut j (from 1)
        piece = {g: lambda low, c=c: 2 * (c.index(low) + 1) if low is not None else 0 for g, c in cuts.items()}
        modes = {g: [0] * (2 * len(c) + 1) for g, c in cuts.items()}
        for g, some in todo.items():
            for s in some:
                modes[g][piece[g](s.expected()[0])] = 2 if s.inside <= SMALL_GROUP else 1
        width = max(len(c) for c in cuts.values())
        schema = T.StructType([*[T.StructField(f"__k{i}", f.dataType) for i, f in enumerate(keys)], T.StructField("__mode", T.ArrayType(T.IntegerType())), *[T.StructField(f"__c{i}", T.DoubleType()) for i in range(width)]])
        table = F.broadcast(spark.createDataFrame([(*g, modes[g], *c, *[None] * (width - len(c))) for g, c in cuts.items()], schema))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)], F.lit(True))
        near = values.where(x.isNotNull())
        near = near.join(table, same) if by else near.crossJoin(table)
        passed = [F.coalesce(f(x, F.col(f"__c{i}")).cast("int"), F.lit(0)) for i in range(width) for f in (operator.gt, operator.ge)]
        near = near.withColumn("__piece", sum(passed, F.lit(0))).withColumn("__mode", F.get("__mode", "__piece"))
        counted = near.groupBy(*by, "__piece").agg(F.count(F.lit(1)).alias("n"), sketch(F.when(F.col("__mode") == 1, x)).alias("points"), F.sort_array(F.collect_list(F.when(F.col("__mode") == 2, x))).alias("all"))
        pieces: dict[tuple, list] = {}
        for r in sorted(counted.collect(), key=lambda r: r["__piece"]):
            pieces.setdefault(tuple(r[c] for c in by), []).append(r)
        for g, some in todo.items():
            below = 0
            for r in pieces[g]:
                j, n = divmod(r["__piece"], 2)[0], r["n"]
                for s in some:
                    if below <= s.rank < below + n:
                        if r["__piece"] % 2:
                            s.value = cuts[g][j]
                        elif r["all"]:
                            s.value = r["all"][s.rank - below]
                        else:
                            s.low, s.high = cuts[g][j - 1] if j else None, cuts[g][j] if j < len(cuts[g]) else None
                            s.below, s.inside, s.sketch = below, n, r["points"]
                below += n
    none = None if by else [None] * len(at)
    lines = [(*g, _interpolated(found[g], at, n) if n else none) for g, n in sizes.items()]
    schema = T.StructType([*keys, T.StructField("q", T.ArrayType(T.DoubleType()))])
    return spark.createDataFrame(lines, schema)


def _interpolated(searches: dict[int, _Search], at: Sequence[float], n: int) -> list[float]:
    places = [(n - 1) * a for a in at]
    pairs = [(p, searches[math.floor(p)].value, searches[math.ceil(p)].value) for p in places]
    return [low if high == low else (math.ceil(p) - p) * low + (p - math.floor(p)) * high for p, low, high in pairs]


def _in_order(df: DataFrame, columns: Sequence[Column | str]) -> DataFrame:
    """Rows sorted over all tasks, with ``__at``: number of the task (from bit 33 on) and row of the task."""
    n = parts(df)
    ranges = df.repartitionByRange(n, *columns) if n > usual(df.sparkSession) else df.repartitionByRange(*columns)
    return ranges.sortWithinPartitions(*columns).withColumn("__at", F.monotonically_increasing_id())


def _stretches(rows: DataFrame, by: Sequence[str], at: str = "__at", value: str | None = None) -> DataFrame:
    """The part of a cross-section in each task: its first row, its rows, those in tasks before, and those in all; with ``value``, also values in all."""
    some = F.count(F.lit(1) if value is None else F.col(value))
    one = rows.groupBy(*by, F.shiftright(at, 33).alias("__task")).agg(F.count(F.lit(1)).alias("__rows"), F.min(at).alias("__first"), some.alias("__some"))
    whole = Window.partitionBy(*by)
    before = F.sum("__rows").over(whole.orderBy("__task")) - F.col("__rows")
    return one.select(*by, "__task", "__rows", "__first", before.alias("__before"), F.sum("__rows").over(whole).alias("__all"), F.sum("__some").over(whole).alias("__values"))


def _placed(rows: DataFrame, by: Sequence[str], at: str = "__at", value: str | None = None) -> DataFrame:
    """``__place`` (from 0) of the row that ``at`` names in its cross-section, beside ``__all`` and ``__values``."""
    stretches = _stretches(rows, by, at, value).drop("__rows").withColumnsRenamed({c: f"__k{i}" for i, c in enumerate(by)})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)], F.shiftright(at, 33) == F.col("__task"))
    placed = rows.join(F.broadcast(stretches), same).withColumn("__place", F.col(at) - F.col("__first") + F.col("__before"))
    return placed.drop("__task", "__first", "__before", *[f"__k{i}" for i in range(len(by))])


def average_ranks(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows with ``<column>_rank``: rank from 1 in the cross-section, ties at the mean of their places; nulls rank first.

    As :func:`average_rank`, where a cross-section is more than a task should hold:
    only rows of one value meet in one.
    """
    n = parts(df)
    for c in columns:
        # Spark normalises doubles that it groups by, which no shuffle by the column itself answers to; their hash does
        ties = Window.partitionBy(*by, "__h", c)
        hashed = F.xxhash64(F.when(F.col(c) == 0, F.lit(0)).otherwise(F.col(c)))
        df = spread(_in_order(df, [*by, c]).withColumn("__h", hashed), *by, "__h", n=n).withColumn(f"__{c}_at", F.min("__at").over(ties)).withColumn(f"__{c}_ties", F.count(F.lit(1)).over(ties)).drop("__at", "__h")
    rows = written(df, "ranked")
    for c in columns:
        rank = F.col("__place") + 1 + (F.col(f"__{c}_ties") - 1) / 2
        rows = _placed(rows, by, f"__{c}_at").withColumn(f"{c}_rank", rank).drop("__place", "__all", "__values")
    return rows.drop(*[f"__{c}_{s}" for c in columns for s in ("at", "ties")])


def group_quantiles(df: DataFrame, column: str, at: Sequence[float], by: Sequence[str]) -> DataFrame:
    """``by, __q``: exact interpolated quantiles of each cross-section that has a value, one sort for all of them.

    As :func:`quantiles`, without all values of a cross-section in one task.  The
    sort runs when this is called; its rows are deleted, and the result, a row a
    cross-section, is written.
    """
    spark = df.sparkSession
    values = df.select(*by, F.col(column).cast("double").alias("__x")).where("__x is not null")
    place = new_place(spark, "sorted")
    ordered = _in_order(values, [*by, "__x"])
    ordered.write.parquet(place)
    rows = spark.read.schema(ordered.schema).parquet(place)
    stretches = _stretches(rows, by)
    # as Spark's percentile: a whole place is that row's value, others lie between two rows
    spot = lambda a: (F.col("__all") - 1) * F.lit(float(a))
    ends = F.array(*[f(spot(a)).cast("long") for a in at for f in (F.floor, F.ceil)])
    wanted = stretches.withColumn("__rank", F.explode(F.array_distinct(ends))).where("__rank >= __before and __rank < __before + __rows")
    wanted = wanted.select("__all", "__rank", (F.col("__first") + F.col("__rank") - F.col("__before")).alias("__at"))
    found = rows.join(F.broadcast(wanted), "__at").groupBy(*by, "__all").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__x"))).alias("__v"))

    def between(a: float) -> Column:
        low, high = F.floor(spot(a)).cast("long"), F.ceil(spot(a)).cast("long")
        x, y = F.col("__v")[low], F.col("__v")[high]
        return F.when(x == y, x).otherwise((high - spot(a)) * x + (spot(a) - low) * y)

    out = written(found.select(*by, F.array(*[between(a) for a in at]).alias("__q")), "quantiles")
    discard(spark, place)
    return out


def _with_quantiles(df: DataFrame, column: str, at: Sequence[float], by: Sequence[str], of: DataFrame | None = None) -> DataFrame:
    """Rows with ``__q``, the quantiles of their cross-section (in ``of``, if given); null where it has no value."""
    return df.na.drop(subset=list(by)).join(F.broadcast(group_quantiles(df if of is None else of, column, at, by)), list(by), "left")


def _cut(df: DataFrame, column: str, at: Sequence[float], by: Sequence[str]) -> DataFrame:
    return _with_quantiles(df, column, at, by)


def filter_small(df: DataFrame, size: str = "cap", at: float = 0.10, by: Sequence[str] = ("month",)) -> DataFrame:
    """Drops null sizes and rows strictly below the quantile of their cross-section."""
    df = df.where(F.col(size).isNotNull())
    return _cut(df, size, [at], by).where(F.col(size) >= F.get("__q", F.lit(0))).drop("__q")


def filter_illiquid(df: DataFrame, illiquidity: str = "illiq", at: float = 0.90, by: Sequence[str] = ("month",)) -> DataFrame:
    """Drops null illiquidity and rows strictly above the quantile; run it after :func:`filter_small`."""
    df = df.where(F.col(illiquidity).isNotNull())
    return _cut(df, illiquidity, [at], by).where(F.col(illiquidity) <= F.get("__q", F.lit(0))).drop("__q")


def to_long(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``keys, feature, x``: one sort by (month, feature) then serves all features."""
    return df.select(*keys, *features).unpivot(list(keys), list(features), "feature", "x")


def to_wide(long: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys).agg(*[F.first(F.when(F.col("feature") == f, F.col("x")), ignorenulls=True).alias(f) for f in features])


def impute_median(long: DataFrame, by: Sequence[str] = ("month",)) -> DataFrame:
    """Month median, then the median of the column so filled, then 0.

    Only columns with a cross-section that has no value at all need the second
    median.  A count finds them when this is called; what months fill of them is
    written for the passes of :func:`whole_quantiles` and deleted after those.
    """
    group = [*by, "feature"]
    filled = _with_quantiles(long, "x", [0.5], group).withColumn("x", F.coalesce("x", F.get("__q", F.lit(0)))).drop("__q")
    lacking = [r[0] for r in long.groupBy(*group).agg(F.count("x").alias("n")).where("n = 0").select("feature").distinct().collect()]
    if not lacking:
        return filled
    place = new_place(long.sparkSession, "filled")
    filled.where(F.col("feature").isin(lacking)).select("feature", "x").write.parquet(place)
    whole = whole_quantiles(long.sparkSession.read.schema(long.select("feature", "x").schema).parquet(place), "x", [0.5], ["feature"])
    discard(long.sparkSession, place)
    whole = whole.select("feature", F.get("q", F.lit(0)).alias("__g"))
    return filled.join(F.broadcast(whole), "feature", "left").withColumn("x", F.coalesce("x", "__g", F.lit(0.0))).drop("__g")


def winsorize(long: DataFrame, low: float = 0.01, high: float = 0.99, by: Sequence[str] = ("month",)) -> DataFrame:
    """Clips to two quantiles of the cross-section; all-null ones stay as they are."""
    group = [*by, "feature"]
    clipped = F.when(F.col("x").isNotNull(), F.least(F.greatest("x", F.get("__q", F.lit(0))), F.get("__q", F.lit(1))))
    return _with_quantiles(long, "x", [low, high], group).withColumn("x", clipped).drop("__q")


def average_rank(order: Column | str, by: Sequence[str], descending: bool = False) -> Column:
    """Rank from 1, ties at the mean of their places; for cross-sections that one task holds, see :func:`average_ranks`."""
    c = F.col(order) if isinstance(order, str) else order
    w = Window.partitionBy(*by).orderBy(c.desc() if descending else c.asc())
    ties = Window.partitionBy(*by, c)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2


def correlation(a: str, b: str) -> Column:
    """Correlation over the rows that have both; null without variance on either side, where ``corr`` would divide by 0."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def rank_transform(long: DataFrame, by: Sequence[str] = ("month",)) -> DataFrame:
    """Average ranks mapped to [-1, 1]; 0 where at most one value is."""
    group = [*by, "feature"]
    ranked = average_ranks(long.where("x is not null"), ["x"], group)
    n = F.broadcast(ranked.groupBy(*group).agg(F.count("x").alias("__n")))
    scaled = F.when(F.col("__n") <= 1, F.lit(0.0)).otherwise(2 * (F.col("x_rank") - 1) / (F.col("__n") - 1) - 1)
    return ranked.join(n, group).withColumn("x", scaled).drop("x_rank", "__n")


def normalise(df: DataFrame, keys: Sequence[str], features: Sequence[str], by: Sequence[str] = ("month",)) -> DataFrame:
    """Imputation, clipping and ranks of all features; other columns are kept beside.

    The rows are read several times: where they are the end of a long plan, hand in
    :func:`~panelspark.sources.scratch.written` rows and discard them after the result.
    """
    long = rank_transform(winsorize(impute_median(to_long(df, keys, features), by), by=by), by)
    n = parts(df)
    return spread(df.drop(*features), *keys, n=n).join(to_wide(spread(long, *keys, n=n), keys, features).hint("merge"), list(keys))


def decile(signal: str, n: int = 10, by: Sequence[str] = ("month",), tie: str = "entity") -> Column:
    """1 to ``n`` by equal-width cut of the ranks; null under ``n`` signals.

    Ties go by ``tie``.  Rank r of N rows falls into group
    ``max(1, ceil((r - 1) n / (N - 1)))``, in whole numbers.  One task holds a
    cross-section; :func:`deciles` gives the same for larger ones.
    """
    w = Window.partitionBy(*by, F.col(signal).isNull())
    r = F.row_number().over(w.orderBy(signal, tie))
    size = F.count(signal).over(w)
    return _decile_of(signal, r, size, n)


def _decile_of(signal: str, r: Column, size: Column, n: int) -> Column:
    place = F.greatest(F.lit(1), F.floor(((r - 1) * n + size - 2) / F.greatest(size - 1, F.lit(1))))
    return F.when(F.col(signal).isNotNull() & (size >= n), place.cast("int"))


def deciles(df: DataFrame, signal: str, n: int = 10, by: Sequence[str] = ("month",), tie: str = "entity", name: str = "decile") -> DataFrame:
    """Rows with :func:`decile` of their signal, from a sort over many tasks; the sorted rows are written when this is called."""
    rows = _placed(written(_in_order(df, [*by, signal, tie]), "deciles"), by, value=signal)
    r = F.col("__place") + 1 - (F.col("__all") - F.col("__values"))  # nulls come first
    return rows.withColumn(name, _decile_of(signal, r, F.col("__values"), n)).drop("__at", "__place", "__all", "__values")


def top_fraction(df: DataFrame, signal: str, target: str, share: float, by: Sequence[str] = ("month",), tie: str = "entity") -> DataFrame:
    """Rows whose descending rank is within ``share`` of their cross-section."""
    rows = df.where(F.col(signal).isNotNull() & F.col(target).isNotNull())
    rows = _placed(written(_in_order(rows, [*by, F.desc(signal), tie]), "fractions"), by)
    return rows.where((F.col("__place") + 1) / F.col("__all") <= share).drop("__at", "__place", "__all", "__values")


@dataclass(frozen=True)
class SizeGroups:
    """Names of the groups from small to large, and the cuts between them.

    ``kind``: ``percentile`` (cuts in (0, 1), per cross-section) or ``fixed``
    (amounts).  A name of None leaves that band out.
    """

    kind: str
    cuts: tuple[float, ...]
    names: tuple[str | None, ...]

    def __post_init__(self) -> None:
        if self.kind not in ("percentile", "fixed"):
            raise ValueError("kind must be percentile or fixed")
        if len(self.names) != len(self.cuts) + 1:
            raise ValueError("one more name than cuts is needed")
        if list(self.cuts) != sorted(set(self.cuts)):
            raise ValueError("cuts must rise")
        if self.kind == "percentile" and not all(0 < c < 1 for c in self.cuts):
            raise ValueError("percentiles lie between 0 and 1")
        named = [n for n in self.names if n is not None]
        if not named or len(named) != len(set(named)):
            raise ValueError("names must be there and differ")


MEDIAN = SizeGroups("percentile", (0.5,), ("small", "large"))
TERCILES = SizeGroups("percentile", (1 / 3, 2 / 3), ("small", "mid", "large"))
QUINTILES = SizeGroups("percentile", (0.2, 0.4, 0.6, 0.8), ("q1", "q2", "q3", "q4", "q5"))


def size_group(df: DataFrame, groups: SizeGroups, size: str = "cap", by: Sequence[str] = ("month",), universe: Sequence[str] | None = ("entity",)) -> DataFrame:
    """``size_group``: the first cut that the size does not pass, or the last name.

    Percentiles are taken over rows that differ in ``by`` and ``universe``; with
    None over all rows, once for each copy in a stacked table.
    """
    if groups.kind == "fixed":
        cuts = F.array(*[F.lit(float(c)) for c in groups.cuts])
        df = df.withColumn("__q", cuts)
    else:
        base = df if universe is None else spread(df.select(*dict.fromkeys([*by, *universe, size])), *by, *universe).dropDuplicates([*by, *universe])
        df = _with_quantiles(df, size, groups.cuts, by, base)
    out = F.lit(groups.names[-1])
    for i in reversed(range(len(groups.cuts))):
        out = F.when(F.col(size) <= F.get("__q", F.lit(i)), F.lit(groups.names[i])).otherwise(out)
    return df.withColumn("size_group", F.when(F.col(size).isNotNull(), out)).drop("__q")


def train_zscore(df: DataFrame, stats: DataFrame, columns: Sequence[str], on: Sequence[str] = ("window_id",)) -> DataFrame:
    """Scales by means and deviations of training rows, ``<c>_mean`` and ``<c>_std``; 0 where the deviation is 0."""
    joined = df.join(F.broadcast(stats), list(on))
    scaled = {c: F.when(F.col(f"{c}_std") > 0, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).otherwise(F.lit(0.0)) for c in columns}
    return joined.withColumns(scaled).drop(*[f"{c}_{s}" for c in columns for s in ("mean", "std")])
