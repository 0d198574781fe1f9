"""Quality rules: text statistics, and a decision list learned from labels.

All with DataFrame functions.  The list is learned by sequential covering: a
rule is a conjunction of threshold conditions on statistics, grown on two thirds
of the labelled rows condition by condition for the highest information gain
over the bad rows, then pruned on the other third.  Covered rows leave, and the
next rule is learned from what remains.  The result is an ordered Spark
conditional expression that says keep or reject.

Each growing step reads only counts per (statistic, bin), so the driver sees a
few hundred numbers, whatever the number of labelled rows.

Defined results: null text has no words and no lines; its statistics are 0.
Labels that are null are ignored; with no labelled bad rows the list is empty
and rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm._shared import BLANKS, text_or_empty, written

#: Labelled rows that the rules are learned from, at most.
MOST_LABELLED = 20_000
#: Candidate thresholds per statistic.
CUTS = 32

#: Statistics that rules may use, as expressions over the counts.
RATIOS = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "exclaim_per_word": "n_exclaims / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "words": "cast(n_words as double)",
}


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's columns in a struct ``row``, and the counts of its text.

    A 3-word window counts as repeated when the text has it twice or more.  The
    windows of a text are sorted as one number each, made of the window's hash
    and its place, so equal windows become neighbours without a shuffle.  The
    place takes as many bits as the text needs, the hash has the rest; neighbours
    with the same hash count as equal only if their words are.
    """
    text = text_or_empty(text_col)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("t"))
    df = df.select("row", "t", F.array_remove(F.split("t", BLANKS), "").alias("w"), F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    df = df.select(
        "row", "t", "w",
        F.size("w").cast("long").alias("n_words"),
        F.array_join("w", "").alias("joined"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("cast(ceil(log2(size(w) + 1)) as int)").alias("bits"),
    )
    window = "xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))"
    df = df.withColumn("keys", F.expr(f"sort_array(if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0, size(w) - 3), i -> shiftleft(shiftright({window}, bits), bits) | i)))"))
    place = "cast({} & (shiftleft(1L, bits) - 1) as int)".format  # of a key
    words = lambda other: " and ".join(f"get(w, {place('k')} + {i}) = get(w, {place(f'get(keys, {other})')} + {i})" for i in range(3))
    same = lambda other: f"(coalesce(shiftright(k, bits) = shiftright(get(keys, {other}), bits) and {words(other)}, false))"
    df = df.withColumn("twice", F.expr(f"sort_array(array_compact(transform(keys, (k, j) -> if({same('j - 1')} or {same('j + 1')}, k & (shiftleft(1L, bits) - 1), null))))"))
    covered = "aggregate(transform(twice, (p, j) -> coalesce(least(3L, get(twice, j + 1) - p), 3L)), 0L, (a, x) -> a + x)"
    shrunk = lambda pattern: F.length("joined") - F.length(F.regexp_replace("joined", pattern, ""))
    return df.select(
        "row", "n_words",
        F.length("joined").cast("long").alias("word_chars"),
        shrunk(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        "n_dup_lines",
        F.expr(covered).alias("n_repeat_words"),
        "n_lines",
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
        shrunk(r"\p{Lu}").cast("long").alias("n_capitals"),
        shrunk("!").cast("long").alias("n_exclaims"),
        shrunk(r"\p{Nd}").cast("long").alias("n_digits"),
    )


def base_failed() -> Column:
    """Fixed part of the verdict: too few words, or too many in repeated windows."""
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


@dataclass
class DecisionList:
    """Ordered rules; the first that fits rejects, and what none fits is kept."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def rejects(self) -> Column:
        """Condition over the statistics of :func:`text_statistics`, in rule order."""
        out = F.lit(False)
        for rule in reversed(self.rules):
            out = F.when(_all(rule), F.lit(True)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{n} {op} {v:.6g}" for n, op, v in r) for r in self.rules) or "reject nothing"


def _all(rule: list[tuple[str, str, float]]) -> Column:
    out = F.lit(True)
    for name, op, value in rule:
        x = F.expr(RATIOS[name])
        out = out & (x > F.lit(value) if op == ">" else x <= F.lit(value))
    return out


def _any(rules: list[list[tuple[str, str, float]]]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | _all(rule)
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gain of narrowing (p0, n0) to (p, n), weighted by the bad rows kept."""
    from math import log2

    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def labelled_statistics(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bad: int = 0, most: int = MOST_LABELLED) -> DataFrame:
    """Statistics of at most ``most`` labelled documents, with ``is_bad`` and ``held``.

    The labels taken are those with the smallest hash of the id: the same at
    every run, and spread over all documents.  Their number is bounded, so they
    are broadcast and only labelled texts are looked at.
    """
    known = labels.select(F.col(id_col).alias("label_id"), (F.col(label_col) == bad).alias("is_bad")).where("label_id is not null and is_bad is not null")
    known = known.groupBy("label_id").agg(F.max("is_bad").alias("is_bad")).orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("label_text")).join(F.broadcast(known), "label_id")
    stats = text_statistics(rows, "label_text")
    values = [F.expr(e).cast("double").alias(n) for n, e in RATIOS.items()]
    counts = [c for c in stats.columns if c != "row"]
    out = stats.select(*counts, *values, F.col("row.is_bad").alias("is_bad"), (F.pmod(F.xxhash64(F.lit("prune"), "row.label_id"), F.lit(3)) == 0).alias("held"))
    return written(out, "labelled-statistics")


def learn_rules(rows: DataFrame, most_rules: int = 12, most_conditions: int = 3, least_precision: float = 0.95, least_rows: int = 5) -> DecisionList:
    """Sequential covering over the rows of :func:`labelled_statistics`.

    A rule counts only if, after pruning, at least ``least_precision`` of what
    it rejects on the pruning rows is bad, and it rejects ``least_rows`` bad rows.
    One that does not is no rule, but its rows are set aside, too, so that the
    next one is grown elsewhere.
    """
    quantiles = rows.agg(*[F.percentile_approx(n, [i / (CUTS + 1) for i in range(1, CUTS + 1)], 10_000).alias(n) for n in RATIOS], *[F.percentile_approx(F.when(F.col("is_bad"), F.col(n)), [i / (CUTS + 1) for i in range(1, CUTS + 1)], 10_000).alias("bad_" + n) for n in RATIOS]).first()
    cuts = {n: sorted({*(quantiles[n] or []), *(quantiles["bad_" + n] or [])}) for n in RATIOS}
    bins = F.array(*[F.struct(F.lit(n).alias("name"), _bin(n, cuts[n]).alias("bin")) for n in RATIOS])
    rows = written(rows.withColumn("bins", bins), "binned-statistics")
    grow, prune = rows.where(~F.col("held")), rows.where("held")
    rules: list[list[tuple[str, str, float]]] = []
    done: list[list[tuple[str, str, float]]] = []
    while len(done) < most_rules:
        rule: list[tuple[str, str, float]] = []
        left = grow.where(~_any(done))
        while len(rule) < most_conditions:
            counts = left.where(_all(rule)).select(F.explode("bins").alias("b"), "is_bad").groupBy("b.name", "b.bin").agg(F.count_if("is_bad").alias("p"), F.count_if(~F.col("is_bad")).alias("n")).collect()  # statistics x bins rows
            found = _best_condition(counts, cuts)
            if found is None:
                break
            rule.append(found[0])
            if found[1] == 0:
                break
        if not rule:
            break
        pruned = _prune(prune.where(~_any(done)), rule)
        held_bad, held_good = _counts(prune.where(~_any(done)), [pruned])[0]
        all_bad, _ = _counts(rows.where(~_any(done)), [pruned])[0]
        done.append(pruned)
        if all_bad >= least_rows and held_bad and held_bad >= least_precision * (held_bad + held_good):
            rules.append(pruned)
    return DecisionList(rules)


def _bin(name: str, cuts: list[float]) -> Column:
    """Number of cuts below the value."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < F.col(name)))


def _best_condition(counts: list, cuts: dict[str, list[float]]) -> tuple[tuple[str, str, float], int] | None:
    """The threshold with the highest gain, and the good rows it still covers."""
    best, top = None, 1e-9
    for name, at in cuts.items():
        per_bin = {r["bin"]: (r["p"], r["n"]) for r in counts if r["name"] == name}
        p0, n0 = sum(p for p, _ in per_bin.values()), sum(n for _, n in per_bin.values())
        p = n = 0
        for i, cut in enumerate(at):  # bins 0 to i hold the values up to the cut
            p, n = p + per_bin.get(i, (0, 0))[0], n + per_bin.get(i, (0, 0))[1]
            for op, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                if (g := _gain(a, b, p0, n0) if p0 else 0.0) > top:
                    best, top = ((name, op, cut), b), g
    return best


def _counts(rows: DataFrame, rules: list[list[tuple[str, str, float]]]) -> list[tuple[int, int]]:
    """Bad and good rows that each rule covers."""
    got = rows.agg(*[F.count_if(_all(r) & (F.col("is_bad") == bad)).alias(f"c{i}{bad}") for i, r in enumerate(rules) for bad in (True, False)]).first()
    return [(got[f"c{i}True"], got[f"c{i}False"]) for i in range(len(rules))]


def _prune(rows: DataFrame, rule: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """The shortest beginning of the rule with the best (p - n) / (p + n) on the pruning rows."""
    heads = [rule[: i + 1] for i in range(len(rule))]
    worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in _counts(rows, heads)]
    return heads[max(range(len(heads)), key=lambda i: (worth[i], -i))]


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """Statistics with ``base_failed`` and ``kept``; the input's row in ``row``."""
    stats = text_statistics(docs, text_col).withColumn("base_failed", base_failed())
    return stats.withColumn("kept", ~F.col("base_failed") & ~rules.rejects())


def learn(docs: DataFrame, labels: DataFrame, **options) -> DecisionList:
    """Rules from labelled documents that the fixed part lets through."""
    rows = labelled_statistics(docs, labels, **options)
    return learn_rules(rows.where(~base_failed()))
