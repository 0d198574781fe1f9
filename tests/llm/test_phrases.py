"""Phrase mining against brute force, and Misra-Gries summaries against their guarantee."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from panelspark.llm import phrases


def brute_counts(rows, longest):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return f, n


def brute(rows, longest=3, least=10, most=2000):
    f, n = brute_counts(rows, longest)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= 50 * candidates[lang, w[i : i + k]]:
                    dropped.add((lang, w[i : i + k]))
    out = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in dropped:
            score, k, left, right = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return [(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:most], 1)]


EDGES = [(None, None), ("en", None), ("en", ""), ("en", " \t \n"), ("en", "a"), (None, "new york city. " * 12), ("", "new york city. " * 12), ("en", "New  York\tCITY, NEW york city! " * 30 + "new york " * 9), ("fr", "École Été école été é é x\x1cy " * 15), ("en", "a a a a a a a a a a a a a a"), ("en", "日本 日本 語 " * 11), ("de", ",".join(["a b"] * 10 + ["b c"] * 9)), ("de", "...a b;;c d")]


def some_rows(n, seed=0):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "é", "x", "y", ".", "\n", "the the"]
    return [(rng.choice(["en", "de", None]), " ".join(rng.choices(words, [9, 5, 3, 3, 2, 1, 1, 1, 2, 1, 1], k=rng.randint(0, 80)))) for _ in range(n)]


@pytest.mark.parametrize("longest,least,most,sizes", [(3, 10, 2000, None), (3, 10, 2000, (150, 60)), (2, 3, 5, (400, 200)), (4, 5, 2000, (1000, 50))])
def test_collocations(spark, monkeypatch, longest, least, most, sizes):
    """Nulls, a null language, overlaps, ties, clashing names; also many small chunks and partitions."""
    if sizes:
        monkeypatch.setattr(phrases, "CHUNK_BYTES", sizes[0])
        monkeypatch.setattr(phrases, "TASK_MASS", 8 * sizes[1])
        monkeypatch.setattr(phrases, "PARTITION_MASS", sizes[1])
    rows = EDGES + some_rows(80)
    docs = spark.createDataFrame([(lang, t, 1, "p", 2) for lang, t in rows], "lang string, text string, f int, phrase string, chunk int").repartition(3)
    got = phrases.collocations(docs, longest, least, most)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((c, "bigint") for c in ("a", "l", "r", "n", "score"))]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, longest, least, most))
    exact, words = phrases.phrase_counts(docs, longest, least)
    f, n = brute_counts(rows, longest)
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in exact.collect()} == {k: v for k, v in f.items() if v >= least}
    assert {r["lang"]: r["n"] for r in words.collect()} == dict(n)


def test_empty(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "")], empty.schema)).count() == 0


def test_products_beyond_64_bits(spark):
    """The score's arithmetic on counts near 10^15."""
    a, left, right = 999_999_999_999_937, 999_999_999_999_989, 999_999_999_999_990
    e = "(cast(a as decimal(16, 0)) * cast(a as decimal(16, 0)) * cast(1000000 as decimal(7, 0))) div (cast(l as decimal(16, 0)) * cast(r as decimal(16, 0)))"
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(e).first()[0]
    assert got == 10**6 * a * a // (left * right)


def test_misra_gries_keeps_every_frequent_key():
    """Over any order of merges, with far more keys than counters."""
    rng = np.random.default_rng(0)
    for seed in range(30):
        keys = np.concatenate([rng.zipf(1.3, 4000) % 5000, rng.integers(10_000, 10**9, 4000)]).astype(np.uint64)
        rng.shuffle(keys)
        parts = [np.unique(x, return_counts=True) for x in np.array_split(keys, rng.integers(1, 40))]
        true = Counter(keys.tolist())
        for least in (2, 10, 50):
            kept, lost = phrases.surviving(parts, least)
            assert lost < least
            assert {k for k, c in true.items() if c >= least} <= set(kept.tolist())
            assert len(kept) <= len(keys) // least + 1


def test_misra_gries_under_counts_by_what_it_lost():
    rng = np.random.default_rng(1)
    keys = rng.zipf(1.2, 20_000).astype(np.uint64) % np.uint64(3000)
    summary, lost = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0
    for part in np.array_split(keys, 13):
        summary, off = phrases.misra_gries(summary, np.unique(part, return_counts=True), 100)
        lost += off
    true = Counter(keys.tolist())
    assert 0 < lost <= len(keys) / 101 and len(summary[0]) <= 100
    assert all(true[k] - lost <= c <= true[k] for k, c in zip(*(x.tolist() for x in summary)))


def test_query_on_the_corpus(spark, sf):
    from panelspark.llm.queries import QUERIES

    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_phrases"](spark, sf).collect())) == sorted(brute(rows))
