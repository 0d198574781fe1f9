"""Licence scan: a trained paragraph classifier, confirmed against templates.

A paragraph is a line with a word.  Its features are its word 1- to 3-grams from
a vocabulary learned from the training rows; a multinomial logistic regression
with an elastic-net penalty tells the licence families, other licence talk
(``unknown``) and plain text (``none``) apart.  Everything runs as DataFrame and
Spark ML operations.

Training rows: variants of the templates and of sentences that name no family,
the corpus's different lines of licence talk (a family if they contain a template
word for word, else ``unknown``), and plain lines; each kind is bounded, see the
constants.  A temperature is fitted on held-out rows so that probabilities are calibrated; a
family whose calibrated probability is under ``LEAST_PROBABILITY``, or which the
templates do not confirm, becomes ``unknown``.

The penalty leaves few n-grams with a weight.  A line without any of them has the
features of an empty line, so it is ``none``.  Each such n-gram has a word, its
cue, that plain lines have least often; only texts that contain a cue are split
into lines, and only lines with a cue among their words are scored.  That skips
work, not cases; should an empty line not be ``none``, all lines are scored.

Defined results: null and empty texts have no licence.  Of a document's licence
lines, a confirmed one speaks for it before others, then the most probable, then
the first.
Rows that repeat an id are judged one by one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm._shared import text_or_empty, written

#: Different corpus lines that become training rows, of each licence class and
#: plain, at most; and the documents that plain lines come from, on average.
MOST_FAMILY_LINES, MOST_PLAIN_LINES, MOST_PLAIN_DOCS = 500, 6000, 1000
#: N-grams that the classifier knows, at most.
MOST_NGRAMS = 4096
LEAST_PROBABILITY = 0.5
LEAST_OVERLAP = 0.6

#: Usual notices of licence families, in lower case without punctuation.
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license version 3", "licensed under the agpl v3", "spdx-license-identifier agpl-3.0-or-later", "spdx-license-identifier agpl-3.0-only", "http www.gnu.org licenses agpl-3.0.html"],
    "apache": ["licensed under the apache license version 2.0", "you may obtain a copy of the license at http www.apache.org licenses license-2.0", "http www.apache.org licenses license-2.0", "released under the apache license 2.0", "distributed under the apache 2.0 license", "apache license", "spdx-license-identifier apache-2.0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd license", "released under the bsd 3-clause license", "this software is provided by the copyright holders and contributors as is", "bsd license", "spdx-license-identifier bsd-3-clause", "spdx-license-identifier bsd-2-clause", "http opensource.org licenses bsd-3-clause"],
    "cc": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "licensed under cc by 4.0", "licensed under cc by-sa 4.0", "available under the creative commons attribution-sharealike license", "spdx-license-identifier cc-by-4.0", "spdx-license-identifier cc-by-sa-4.0", "http creativecommons.org licenses by 4.0"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license", "licensed under the gnu gpl v3", "released under the gnu general public license version 2", "licensed under gpl v3", "licensed under gplv3", "licensed under gplv2", "spdx-license-identifier gpl-3.0-or-later", "spdx-license-identifier gpl-2.0-only", "http www.gnu.org licenses gpl-3.0.html"],
    "lgpl": ["licensed under the gnu lesser general public license version 3", "licensed under lgpl v3", "licensed under lgplv3", "spdx-license-identifier lgpl-3.0-or-later", "spdx-license-identifier lgpl-2.1-only", "http www.gnu.org licenses lgpl-3.0.html"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit license", "spdx-license-identifier mit", "http opensource.org licenses mit"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "spdx-license-identifier mpl-2.0", "http mozilla.org mpl 2.0"],
}
#: Licence talk that names none of the families.
UNNAMED = ["all rights reserved", "licensed under the terms of the license agreement", "this work is licensed under the license", "released under the license", "distributed under a proprietary license", "see the license file for the terms of use", "use of this work is subject to the license", "licensed under an unnamed license version 1", "copyright 2020 isc license", "licensed under the isc license", "licensed under the eupl", "licensed under the eupl v1.2", "released under the zlib license", "released under the artistic license 2.0", "released under the boost software license", "licensed under the eclipse public license", "spdx-license-identifier isc", "spdx-license-identifier eupl-1.2", "spdx-license-identifier zlib", "spdx-license-identifier unlicense", "spdx-license-identifier epl-2.0", "http opensource.org licenses isc"]
#: Plain talk with the same words.
PLAIN = ["he lost his driving license on the way home", "she renewed her fishing license in spring", "the poet took license with the facts", "a licensed nurse was on duty", "the bar had no license to sell spirits", "we obtained a copy of the book", "the parking permit was granted free of charge", "the general public was invited to the version shown in spring", "the foundation supports public schools", "the apache helicopter landed", "mit students built the robot"]
#: How licence notices speak; corpus lines that do, but hold no template, are ``unknown`` training rows.
SPOKEN = r"(licen[cs]ed|released|distributed|available|redistributed?|modif(y|ied)) under |licen[cs]e-identifier|terms of (the|this) licen[cs]e|all rights reserved"

FAMILIES = sorted(TEMPLATES)
CLASSES = ["none", "unknown", *FAMILIES]


def _words(line: Column) -> Column:
    """Lower-case words of a line, without punctuation at their ends."""
    plain = F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}.+-]+|[.+-]+(?![\p{L}\p{N}])", " ")
    return F.array_remove(F.split(F.trim(plain), " +"), "")


def _ngrams(words: Column) -> Column:
    """The 1- to 3-grams of an array of words."""
    more = F.transform(words, lambda w, i: F.array(F.concat_ws(" ", w, F.get(words, i + 1)), F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2))))
    return F.concat(words, F.flatten(more))


def training_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``class, words, drawn, held, weight``: a bounded number of labelled lines, see the constants.

    ``drawn`` rows are lines of the corpus.  Whole templates are never held out.

    Equal corpus lines count once, and each class has a bound of its own, so that
    neither copies nor a common notice push other lines out, whatever the input.
    """
    spark = docs.sparkSession
    known = [(c, t) for c in FAMILIES for t in TEMPLATES[c]] + [("unknown", t) for t in UNNAMED] + [("none", t) for t in PLAIN]
    base = spark.createDataFrame(known, "class string, line string").withColumn("words", F.split("line", " "))
    # every variant of a longer notice drops other words, so that no single word decides
    variants = base.select("class", "words", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("v"))
    some = F.filter("words", lambda w, i: (F.col("v") == 0) | (F.size("words") < 5) | ((i * 5 + F.col("v")) % (F.col("v") + 3) != 0))
    variants = variants.select("class", some.alias("words"), F.lit(False).alias("drawn"), (some != F.col("words")).alias("may_hold")).where((F.size("words") > 2) | (F.col("v") < 4))

    text = docs.select(text_or_empty(text_col).alias("text"))
    cue = r"licen[cs]e|all rights reserved"
    lines = text.where(F.lower("text").rlike(cue)).select(F.explode(F.split("text", "\n")).alias("line")).where(F.lower("line").rlike(cue))
    lines = lines.select(F.array_join(_words(F.col("line")), " ").alias("line")).groupBy("line").count()
    said = F.concat(F.lit(" "), "line", F.lit(" "))
    family = F.coalesce(*[F.when(F.contains(said, F.lit(f" {t} ")), F.lit(c)) for c in FAMILIES for t in TEMPLATES[c]])
    lines = lines.withColumn("class", F.coalesce(family, F.when(F.col("line").rlike(SPOKEN), F.lit("unknown")))).where("class is not null")
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.xxhash64("line"), "line"))
    found = lines.withColumn("place", place).where(F.col("place") <= MOST_FAMILY_LINES).select("class", F.split("line", " ").alias("words"), F.lit(True).alias("drawn"), F.lit(True).alias("may_hold"))

    share = MOST_PLAIN_DOCS / max(1, docs.count())
    drawn = text.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < share * (1 << 40))
    plain = drawn.select(F.explode(F.split("text", "\n")).alias("line")).where(~F.lower("line").rlike("licen[cs]e|copyright|rights reserved"))
    plain = plain.select(F.lit("none").alias("class"), _words(F.col("line")).alias("words")).where(F.size("words") > 0).distinct().orderBy(F.xxhash64("words"), "words").limit(MOST_PLAIN_LINES).withColumns({"drawn": F.lit(True), "may_hold": F.lit(True)})
    empty = spark.range(20).select(F.lit("none").alias("class"), F.array().cast("array<string>").alias("words"), F.lit(False).alias("drawn"), F.lit(False).alias("may_hold"))
    rows = variants.unionByName(found).unionByName(plain).unionByName(empty)
    rows = rows.withColumn("held", F.col("may_hold") & (F.pmod(F.xxhash64("class", "words"), F.lit(4)) == 0)).drop("may_hold")
    # plain lines weigh half, the licence classes share the other half evenly
    each, mine = Window.partitionBy("class", "held"), F.count(F.lit(1))
    weight = F.when(F.col("class") == "none", 0.5).otherwise(0.5 / (len(CLASSES) - 1)) / mine.over(each)
    return written(rows.withColumn("weight", 1000 * weight), "licence-training")


def _vocabulary(rows: DataFrame) -> DataFrame:
    """N-grams that licence lines share and one drawn plain line in a thousand has at most."""
    rows = rows.where("class <> 'none' or drawn")
    plain = rows.where("class = 'none'").count()
    grams = rows.select("class", F.explode(F.array_distinct(_ngrams(F.col("words")))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count_if(F.col("class") != "none").alias("licence"), F.count_if(F.col("class") == "none").alias("plain"))
    good = counts.where((F.col("licence") >= 2) & (F.col("plain") <= 0.001 * plain))
    return good.orderBy(F.desc("licence"), "gram").limit(MOST_NGRAMS).select(F.array("gram").alias("grams"))


@dataclass
class Scanner:
    """A fitted classifier: n-gram counter, regression, temperature, and words to look for (None: score every line)."""

    counter: CountVectorizerModel
    model: LogisticRegressionModel
    temperature: float
    cues: list[str] | None

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``words``) and ``p``, the calibrated probability of each class.

        The scores are written first, so that no later expression runs the model again.
        """
        return _softmax(written(self._raw(rows), "licence-scores"), self.temperature)

    def _raw(self, rows: DataFrame) -> DataFrame:
        counted = self.counter.transform(rows.withColumn("grams", _ngrams(F.col("words"))))
        return self.model.transform(counted).withColumn("raw", vector_to_array("rawPrediction")).drop("grams", "features", "rawPrediction", "probability", "prediction")


def _softmax(rows: DataFrame, temperature: float) -> DataFrame:
    return rows.withColumn("p", F.transform("raw", lambda x: 1 / F.aggregate(F.transform("raw", lambda y: F.exp((y - x) / temperature)), F.lit(0.0), lambda a, b: a + b))).drop("raw")


def held_out(scanner: Scanner, rows: DataFrame) -> DataFrame:
    """Per class of the rows that training left out: ``n, n_right, mean_probability`` of the predicted class."""
    scored = scanner.probabilities(rows.where("held"))
    best = F.array_max("p")
    right = F.get(F.array(*map(F.lit, CLASSES)), F.array_position("p", best).cast("int") - 1) == F.col("class")
    return scored.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("n_right"), F.avg(best).alias("mean_probability"))


def fit(docs: DataFrame, text_col: str = "text") -> Scanner:
    """Trains and calibrates on :func:`training_rows` of the documents."""
    rows = training_rows(docs, text_col)
    rows = rows.withColumn("label", F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class")).cast("double") - 1)
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=MOST_NGRAMS).fit(_vocabulary(rows))
    train = counter.transform(rows.where("not held").withColumn("grams", _ngrams(F.col("words"))))
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=1e-3, elasticNetParam=0.5, standardization=False, weightCol="weight").fit(train)

    scanner = Scanner(counter, model, 1.0, [])
    held = written(scanner._raw(rows.where("held")), "licence-held")
    steps = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0]
    loss = lambda t: F.avg(F.log(F.aggregate(F.transform("raw", lambda x: F.exp((x - F.get("raw", F.col("label").cast("int"))) / t)), F.lit(0.0), lambda a, b: a + b)))
    losses = held.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(steps)]).first()
    scanner.temperature = min(steps, key=lambda t: losses[f"t{steps.index(t)}"] if losses[f"t{steps.index(t)}"] is not None else abs(t - 1))

    weights = model.coefficientMatrix.toArray()
    used = [g.split(" ") for j, g in enumerate(counter.vocabulary) if abs(weights[:, j]).max() > 0]
    listed = sorted({w for g in used for w in g})  # at most three for each n-gram known
    plain = rows.where("class = 'none'").select(F.explode("words").alias("w")).where(F.col("w").isin(listed)).groupBy("w").count()
    often = {r["w"]: r["count"] for r in plain.collect()}
    cues = {min(g, key=lambda w: (often.get(w, 0), -len(w), w)) for g in used}
    scanner.cues = sorted(cues) if model.interceptVector.toArray().argmax() == CLASSES.index("none") else None
    return scanner


def _overlap(words: Column, family: Column) -> Column:
    """Highest share of a template's or the line's 3-grams that the other has, whichever has fewer.

    A template of one or two words counts whole, where the line has it word for word.
    """
    line = _triples(words)
    said = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    out = F.lit(0.0)
    for c in FAMILIES:
        shares = []
        for t in TEMPLATES[c]:
            w = t.split(" ")
            if len(w) < 3:
                shares.append(F.contains(said, F.lit(f" {t} ")).cast("double"))
                continue
            there = F.array(*[F.lit(" ".join(w[i : i + 3])) for i in range(len(w) - 2)])
            shares.append(F.size(F.array_intersect(line, there)) / F.greatest(F.lit(1), F.least(F.size(line), F.lit(len(set(zip(w, w[1:], w[2:])))))))
        out = F.when(family == c, F.greatest(*shares)).otherwise(out)
    return out


def _triples(words: Column) -> Column:
    n = F.size(words)
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))


def _may_have(text: Column, cues: list[str]) -> Column:
    """False only if no word of the text is a cue."""
    out = F.lit(False)
    anywhere = [c for c in cues if len(c) > 4]
    for cue in anywhere:
        if not any(o != cue and o in cue for o in anywhere):  # else the shorter one is found where this one is
            out = out | F.contains(text, F.lit(cue))
    short = "|".join(re.escape(c) for c in cues if len(c) <= 4)
    return out | text.rlike(rf"(?<![\p{{L}}\p{{N}}])({short})(?![\p{{L}}\p{{N}}])") if short else out


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, licence, probability, confirmed, overlap, paragraph, n_licence_paragraphs``.

    ``licence``: a family, ``unknown``, or null where no line is licence talk.
    """
    text = text_or_empty(text_col)
    cues = F.array(*map(F.lit, scanner.cues or [])).cast("array<string>")
    worth = lambda x: F.size(x["words"]) > 0 if scanner.cues is None else F.arrays_overlap(x["words"], cues)
    lines = F.filter(F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("paragraph"), _words(line).alias("words"))), worth)
    rows = docs.select(F.monotonically_increasing_id().alias("at"), F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("at", "doc_id", F.when(F.lit(True) if scanner.cues is None else _may_have(F.lower("text"), scanner.cues), lines).alias("lines"))
    rows = written(rows, "licence-lines")

    each = rows.select("at", F.explode("lines").alias("x")).select("at", "x.paragraph", "x.words")
    scored = scanner.probabilities(each)
    best = F.array_max("p")
    scored = scored.select("at", "paragraph", "words", best.alias("probability"), F.get(F.array(*map(F.lit, CLASSES)), F.array_position("p", best).cast("int") - 1).alias("class")).where("class <> 'none'")
    scored = scored.withColumn("overlap", _overlap(F.col("words"), F.col("class")))
    sure = (F.col("class") != "unknown") & (F.col("probability") >= LEAST_PROBABILITY) & (F.col("overlap") >= LEAST_OVERLAP)
    scored = scored.withColumn("confirmed", sure).withColumn("licence", F.when(sure, F.col("class")).otherwise(F.lit("unknown")))
    of = scored.groupBy("at").agg(F.max_by(F.struct("licence", "probability", "confirmed", "overlap", "paragraph"), F.struct("confirmed", "probability", -F.col("paragraph"))).alias("best"), F.count(F.lit(1)).alias("n"))
    out = rows.select("at", "doc_id").join(of, "at", "left")
    return out.select("doc_id", "best.licence", "best.probability", F.coalesce("best.confirmed", F.lit(False)).alias("confirmed"), "best.overlap", "best.paragraph", F.coalesce("n", F.lit(0).cast("long")).alias("n_licence_paragraphs"))
