"""Text operators on small fixtures, against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import byte_bpe, components, exact_dedup, katz_lm, license_scan, line_dedup, minhash, packing, quality_rules, sharding, url_filter
from panelspark.llm._shared import bucketed, discard, shared_dir
from panelspark.llm.pretokens import PATTERN
from panelspark.llm.queries import URL_RULES, vocabulary

public_tokenizers = pytest.importorskip("public_tokenizers")

LONG = "word " * 3000 + "x" * 5000
TEXTS = [None, "", " \t ", "one  two", "one two", "one\ttwo", LONG, LONG, "a\n\nb\nb", "Der Straße naïve 日本語 \U0001f600!", "one two three four five six", "one two three four five six"]


@pytest.fixture
def docs(spark):
    """Nulls, blanks, copies, a repeated row, and columns whose names clash with the operators' own."""
    rows = [(i, t, "r", "d", 1, "n") for i, t in enumerate(TEXTS)] + [(3, "one  two", "r", "d", 1, "n"), (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, digest string, at int, node string")


@pytest.fixture
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def squeezed(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_exact_groups(docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[squeezed(r["text"])].append(r["doc_id"])
    want = [(i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["keep_id"], r["group_size"])) for r in got)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_drop_exact_copies(docs, empty):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [squeezed(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({squeezed(r["text"]) for r in docs.collect()})
    assert exact_dedup.drop_exact_copies(docs, bits=64).count() == kept.count()  # a full bitmap changes nothing
    assert exact_dedup.drop_exact_copies(empty).count() == 0


def test_sharding_is_exact_and_even(docs, corpus, empty):
    for df, n in ((docs, docs.count()), (corpus, corpus.count())):
        got = sharding.shard_documents(df, shards=4).collect()
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert len(got) == n and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in corpus.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in got)
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_deals_partitions_by_the_matrix(spark):
    """Rows in seven partitions of different sizes: every shard gets its share of each, in no order of theirs."""
    df = spark.range(0, 4000, 1, 5).union(spark.range(4000, 4001, 1, 1)).union(spark.range(4001, 4400, 1, 1)).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert df.select(F.spark_partition_id()).distinct().count() == 7
    got = sharding.shard_documents(df, shards=4).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(4400))
    for shard in range(4):
        own = [r["doc_id"] for r in sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])]
        assert len(own) == 1100 and abs(np.corrcoef(own, np.arange(1100))[0, 1]) < 0.12
        for low in range(0, 4000, 800):
            assert sum(low <= i < low + 800 for i in own) == pytest.approx(200, abs=60)
    other = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(df, shards=4, seed=1).collect()}
    assert sum(other[r["doc_id"]] == (r["shard"], r["slot"]) for r in got) < 20
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(df, shards=4).collect()}


def test_hypergeometric_draws_of_large_tables():
    rng = np.random.default_rng(0)
    x = [sharding._hypergeometric(rng, 10**9, 15 * 10**9, 24_000_000) for _ in range(300)]
    sd = (24e6 / 16 * 15 / 16) ** 0.5
    assert np.mean(x) == pytest.approx(1.5e6, abs=4 * sd / 300**0.5) and np.std(x) == pytest.approx(sd, rel=0.15)
    assert {sharding._hypergeometric(rng, 3, 0, 2), sharding._hypergeometric(rng, 0, 3, 2)} == {2, 0}


def test_communication_matrix_follows_the_law():
    sizes, shards = [5, 3, 4], [6, 6]
    m = Counter()
    for seed in range(4000):
        x = sharding.communication_matrix(sizes, shards, seed)
        assert [sum(r) for r in x] == sizes and [sum(c) for c in zip(*x)] == shards
        m[x[0][0]] += 1
    from math import comb

    for k in range(6):
        assert m[k] / 4000 == pytest.approx(comb(6, k) * comb(6, 5 - k) / comb(12, 5), abs=0.03)


def brute_statistics(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_text_statistics(docs, corpus, empty):
    for df in (docs, corpus):
        for r in quality_rules.text_statistics(df).collect():
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_statistics(r["row"]["text"])
    assert quality_rules.text_statistics(empty).count() == 0


def test_rules_keep_clean_and_reject_bad(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = quality_rules.learn(docs, labels)
    verdict = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.judge(docs, rules).select("row.doc_id", "base_failed", "kept").collect()}
    known = [(verdict[r["doc_id"]], r["quality"]) for r in labels.collect() if not verdict[r["doc_id"]][0]]
    assert np.mean([kept for (_, kept), q in known if q == 1]) >= 0.99
    assert np.mean([not kept for (_, kept), q in known if q == 0]) >= 0.95
    none = quality_rules.learn(docs, labels.limit(0))
    assert none.rules == [] and str(none) == "reject nothing"
    assert quality_rules.judge(empty, rules).count() == 0


def test_perfect_hash_and_merges(corpus):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = byte_bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    bpe = byte_bpe.ByteBPE(ranks)
    assert sorted(bpe.hash.slot(k) for k in ranks) == list(range(len(ranks)))
    assert bpe.hash.slot(b"surely not an entry") == -1
    assert PATTERN == public_tokenizers.PATTERN
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in [r["text"] or "" for r in corpus.collect()] + [t or "" for t in TEXTS] + ["\x1c\x85\xa0 a　b", "''s're  \r\n x", "a" * 3000]:
        assert bpe.encode(t) == own.encode_ordinary(t)


def test_bpe_round_trip(docs, empty):
    path = vocabulary("byte_bpe_50k.tiktoken")
    got = byte_bpe.round_trip(docs, path).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r["decoded_sha256"] for r in got) == sorted(sha(r["text"]) for r in docs.collect())
    coded = byte_bpe.encode_documents(docs, path)
    back = byte_bpe.decode_documents(coded, path).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((r["text"] or "").encode() for r in docs.collect())
    assert {(r["doc_id"], r["n_tokens"]) for r in got} == {(r["doc_id"], len(r["ids"])) for r in coded.collect()}
    assert byte_bpe.round_trip(empty, path).count() == 0


def test_packing(docs, corpus, empty):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for df in (docs, corpus):
        got = packing.pack(packing.token_pieces(df, path)).collect()
        by_sequence = defaultdict(list)
        for p in got:
            by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        for pieces in by_sequence.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(by_sequence) <= sum(p["length"] for p in got) / 1024 * 1.05 + 2
    by_doc = defaultdict(list)
    for p in got:
        by_doc[p["doc_id"]].append(p)
    for r in corpus.collect():
        ids, at = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2], 0
        for p in sorted(by_doc[r["doc_id"]], key=lambda p: p["piece"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    assert packing.pack(packing.token_pieces(empty, path)).count() == 0


@pytest.mark.parametrize("rule", ["residual", "dot"])
def test_best_fit_respects_all_capacities(rule):
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 100, 400))[::-1]
    sequence, offset = packing.best_fit(lengths, (100, 3, 9801), (1.0, 0.1, 0.1), rule)
    for s in np.unique(sequence):
        own = lengths[sequence == s]
        assert own.sum() <= 100 and len(own) <= 3 and (own.astype(int) ** 2).sum() <= 9801
        assert sorted(offset[sequence == s]) == sorted(np.concatenate([[0], np.cumsum(own)[:-1]]))
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), (100, 3, 10_000), (1, 1, 1))


@pytest.mark.parametrize("rule", ["residual", "dot"])
@pytest.mark.parametrize("capacity", [(100, 3, 9801), (100, 100, 10_000), (100, 7, 10_000)])
def test_best_fit_against_a_scan_of_all_sequences(rule, capacity):
    weights = (1.0, 0.3, 0.2)
    w = [x / c / c for x, c in zip(weights, capacity)]
    lengths = np.random.default_rng(1).integers(1, 90, 300)
    sequence, _ = packing.best_fit(lengths, capacity, weights, rule)
    left = []
    for n, chosen in zip(lengths.tolist(), sequence.tolist()):
        need = (n, 1, n * n)
        bad = {i: sum(x * (r - q) ** 2 if rule == "residual" else -x * r * q for x, r, q in zip(w, room, need)) for i, room in enumerate(left) if all(r >= q for r, q in zip(room, need))}
        if bad:
            assert bad[chosen] == pytest.approx(min(bad.values()), abs=1e-12)
        else:
            assert chosen == len(left)
            left.append(capacity)
        left[chosen] = tuple(r - q for r, q in zip(left[chosen], need))


def test_special_token_text_is_left_to_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    text = "a<|endoftext|> b"
    got = packing.token_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), path).first()
    assert got["length"] == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids) + 1


def test_url_filter(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.example.NET/en/x?y"), (2, "http://example.net/de/"), (3, "http://x.org/fr/"), (4, "http://net"), (5, None), (6, "no scheme"), (7, "http://notexample.com/de/"), (8, "https://www.bad.io:443/p/?utm_source=a&b=2&a=1#f"), (8, "http://bad.io/p?a=1&b=2"), (9, "http://bad.io/p")],
        "page_id long, url string",
    ).withColumns({"host": F.lit("clash"), "at": F.lit(0), "verdict": F.lit("clash")})
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("http://bad.io/p/?b=2&a=1", "block"), (None, "block")], "url string, verdict string")
    got = [(r["page_id"], r["rule"], r["verdict"], r["host"]) for r in url_filter.judge_urls(pages, rules, listed, carry=["page_id"]).collect()]
    want = [
        (1, "example.net/en/", "allow", "a.example.net"), (2, "net/", "block", "example.net"), (3, "org/fr/", "allow", "x.org"), (4, None, "allow", "net"), (5, None, "allow", ""),
        (6, None, "allow", ""), (7, None, "allow", "notexample.com"), (8, None, "block", "www.bad.io:443"), (8, None, "block", "bad.io"), (9, None, "allow", "bad.io"),
    ]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert url_filter.judge_urls(pages.limit(0), rules, listed, carry=["page_id"]).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0), listed.limit(0), carry=["page_id"]).collect()} == {"allow"}
    whole = url_filter.judge_urls(pages, rules, listed)
    assert whole.columns == ["page_id", "url", "at", "host", "path", "canonical", "rule", "verdict"]
    assert sorted(map(str, whole.select("page_id", "rule", "verdict", "host").collect())) == sorted(f"Row(page_id={i}, rule={r!r}, verdict={v!r}, host={h!r})" for i, r, v, h in want)


def test_an_empty_canonical_form_lists_nothing(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://www./"), (4, "http://a/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    listed = spark.createDataFrame([("http://www./", "block"), ("http://a", "block")], "url string, verdict string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, rules, listed).collect()} == {1: "allow", 2: "allow", 3: "allow", 4: "block"}


def test_licence_scan(docs, corpus, empty):
    scanner = license_scan.fit(corpus)
    found = {r["doc_id"]: r for r in license_scan.scan(corpus, scanner).collect()}
    stated = {r["doc_id"]: re.search(r"(?i)licen[cs]e", r["text"] or "") for r in corpus.collect()}
    assert all(found[i]["confirmed"] == bool(m) for i, m in stated.items())
    new = corpus.sparkSession.createDataFrame([(1, "Hello.\nReleased under the MIT License."), (2, "All rights reserved"), (3, None), (4, "plain words only"), (5, "This program: you can redistribute it and/or modify it under the terms of the GNU General Public License.")], "doc_id long, text string")
    got = {r["doc_id"]: (r["licence"], r["confirmed"]) for r in license_scan.scan(new, scanner).collect()}
    assert got[1] == ("mit", True) and got[3] == (None, False) and got[4] == (None, False) and got[5] == ("gpl", True)
    assert got[2] == ("unknown", False)
    assert license_scan.scan(docs, scanner).count() == docs.count()
    assert license_scan.scan(empty, scanner).count() == 0


def test_licence_tags_addresses_and_other_licences(corpus):
    scanner = license_scan.fit(corpus)
    said = {
        "http://www.apache.org/licenses/LICENSE-2.0": "apache", "SPDX-License-Identifier: MIT": "mit", "The MIT License (MIT)": "mit", "Licensed under GPLv3": "gpl", "Licensed under LGPL v3": "lgpl",
        "Copyright 2020 ISC License": "unknown", "Licensed under the EUPL": "unknown", "SPDX-License-Identifier: ISC": "unknown",
        "She passed her license exam": None, "driver license": None, "the general public": None, "foundation of the house": None,
    }
    new = corpus.sparkSession.createDataFrame([*enumerate(said)], "doc_id long, text string")
    got = {list(said)[r["doc_id"]]: r["licence"] for r in license_scan.scan(new, scanner).collect()}
    assert got == said


def test_licence_training_rows(corpus):
    rows = license_scan.training_rows(corpus.unionByName(corpus)).collect()
    drawn = [tuple(r["words"]) for r in rows if r["drawn"]]
    assert len(drawn) == len(set(drawn))  # copies count once
    assert {r["class"] for r in rows} == set(license_scan.CLASSES)
    whole = {tuple(t.split(" ")) for c in license_scan.FAMILIES for t in license_scan.TEMPLATES[c]}
    assert not any(r["held"] and not r["drawn"] and tuple(r["words"]) in whole for r in rows)
    shares = {}
    for r in rows:
        if not r["held"]:
            shares[r["class"]] = shares.get(r["class"], 0) + r["weight"]
    assert shares["none"] == pytest.approx(500) and shares["mit"] == pytest.approx(500 / (len(license_scan.CLASSES) - 1))


def test_licence_cues_skip_work_not_cases(corpus):
    scanner = license_scan.fit(corpus)
    used = abs(scanner.model.coefficientMatrix.toArray()).max(0) > 0
    words = sorted({w for g, u in zip(scanner.counter.vocabulary, used) if u for w in g.split(" ")})
    said = ["Licensed to Acme Corp.", "Licensed under the ISC terms", "Copyright holders", *words, *(f"{w}x" for w in words), "a plain line"]
    new = corpus.sparkSession.createDataFrame([*enumerate(said), (-1, "\n".join(said))], "doc_id long, text string").unionByName(corpus.select("doc_id", "text"))
    with_cues, without = (sorted(map(str, license_scan.scan(new, x).collect())) for x in (scanner, replace(scanner, cues=None)))
    assert with_cues == without
    assert all(any(w in scanner.cues for w in g.split(" ")) for g, u in zip(scanner.counter.vocabulary, used) if u)


def test_katz_takes_more_blocks_than_spark_has_buckets(spark, corpus, monkeypatch):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scores = lambda: {r["doc_id"]: r["score"] for r in katz_lm.score_documents(corpus, held, 3, block_bytes=20_000).collect()}
    want, setting = scores(), "spark.sql.sources.bucketing.maxBuckets"
    known, made = spark.conf.get(setting), []
    monkeypatch.setattr(katz_lm, "bucketed", lambda *args: made.append((args[3], bucketed(*args))) or made[-1][1])
    monkeypatch.setattr(katz_lm, "discard", lambda *tables: None)
    spark.conf.set(setting, "3")
    try:
        assert scores() == pytest.approx(want)
    finally:
        spark.conf.set(setting, known)
    ((buckets, blocks),) = made
    assert buckets == 3 and blocks.select("block").distinct().count() > 10
    (name,) = (t.name for t in spark.catalog.listTables() if t.name.startswith("katz_blocks_"))
    place = Path(shared_dir(spark).removeprefix("file:")) / name
    assert place.exists()
    discard(blocks)
    assert not place.exists() and not spark.catalog.tableExists(name)


@pytest.mark.parametrize("order", [2, 3])
def test_katz_model(docs, corpus, empty, order, tmp_path):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {r["doc_id"]: r for r in katz_lm.score_documents(corpus, held, order, model_dir=str(tmp_path / "model"), block_bytes=40_000, piece=50).collect()}
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    words = {r["doc_id"]: (r["text"] or "").encode().translate(lower).split() + [b""] for r in corpus.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    seen = [Counter() for _ in range(order + 1)]  # by number of words
    after = [Counter() for _ in range(order)]  # contexts by number of words
    for i, w in words.items():
        if not out[i]:
            padded = [b" "] * (order - 1) + w
            for at in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    seen[k][tuple(padded[at - k + 1 : at + 1])] += 1
                    after[k - 1][tuple(padded[at - k + 1 : at])] += 1
    n, v = sum(seen[1].values()), len(seen[1])
    of = lambda c: [sum(x == r for x in c.values()) for r in range(7)]
    d = [None, *[katz_lm.discounts(of(c)) for c in seen[1:]]]
    freed = sum((1 - d[1][min(c, 6)]) * c for c in seen[1].values())
    mass, left = defaultdict(float), defaultdict(float)

    def p(h, w):
        c, k = seen[len(h) + 1][*h, w], len(h) + 1
        if not h:
            return d[1][min(c, 6)] * c / n if c else freed / n
        if not after[k - 1][h]:
            return p(h[1:], w)
        whole, spare = after[k - 1][h] + (left[h] <= 0), left[h] if left[h] > 0 else 1
        return d[k][min(c, 6)] * c / whole if c else spare / whole / (1 - mass[h]) * p(h[1:], w)

    for k in range(2, order + 1):
        for (*h, w), c in seen[k].items():
            mass[tuple(h)] += p(tuple(h[1:]), w)
            left[tuple(h)] += (1 - d[k][min(c, 6)]) * c
    for i, w in words.items():
        padded = [b" "] * (order - 1) + w
        assert got[i]["score"] == pytest.approx(sum(np.log10(p(tuple(padded[j : j + order - 1]), x)) for j, x in enumerate(w)))
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((seen[1][x,] + 1) / (n + v + 1)) for x in w))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["held_out"]) == (len(w), sum((x,) in seen[1] for x in w), n, out[i])
    for h in list(after[order - 1])[:3]:
        assert sum(p(h, w) for (w,) in seen[1]) + p(h, b"unknown word") == pytest.approx(1)
    stored = corpus.sparkSession.read.parquet(str(tmp_path / "model"))
    assert sum(len(r["counts"]) // 8 for r in stored.where(F.col("order") == order).collect()) == len(seen[order])
    assert not [t for t in corpus.sparkSession.catalog.listTables() if t.name.startswith("katz_")]
    if order == 2:
        edges = katz_lm.score_documents(docs, held).collect()
        assert sorted(str((r["doc_id"], r["n_tokens"])) for r in edges) == sorted(str((r["doc_id"], len((r["text"] or "").split()) + 1)) for r in docs.collect())
        assert katz_lm.score_documents(empty, held).count() == 0
        assert katz_lm.score_documents(docs, F.lit(True)).where("train_tokens = 0").count() == docs.count()


def test_word_hashes(monkeypatch):
    monkeypatch.setattr(katz_lm, "CHUNK_BYTES", 16)
    texts = [b"", b" \t", b"One tWo  three", b"two", "na\xefve \u65e5\u672c x".encode(), b"y" * 100]
    h, n = katz_lm.tokens(texts, katz_lm.WordHashes())
    assert n.tolist() == [1, 1, 4, 2, 4, 2]
    words = [w for t in texts for w in [*t.lower().split(), None]]
    assert len(words) == len(h) and len(set(words)) == len(set(h.tolist())) and all((words[i] == words[j]) == (h[i] == h[j]) for i in range(len(h)) for j in range(len(h)))


def test_edit_distance():
    random.seed(1)

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(3000):
        a = [random.choice("abc") for _ in range(random.randint(0, 14))]
        b = list(a)
        for _ in range(random.randint(0, 4)):
            at = random.randint(0, len(b))
            b[at : at + random.randint(0, 1)] = random.choice(["", "a", "b"])
        most = random.randint(1, 4)
        assert line_dedup.edit_distance("".join(a), "".join(b), most) == min(table(a, b), most + 1)


def test_line_classes(spark, docs, empty):
    random.seed(2)
    base = ["".join(random.choice("abcdefgh ") for _ in range(40)).strip("a ") + "z" for _ in range(12)]
    lines = []
    for x in base:
        lines += [x, x, x[:10] + "Q" + x[10:], x[:5] + x[6:20] + "Q" + x[21:], x[::-1]]
    lines += ["short", "shorp", "", " "]
    random.shuffle(lines)
    df = spark.createDataFrame([(i // 4, "\n".join(lines[i : i + 4])) for i in range(0, len(lines), 4)], "doc_id long, text string")
    got = line_dedup.line_classes(df).collect()
    text = {(i // 4, i % 4): re.sub(" +", " ", x).strip(" ") for i, x in enumerate(lines)}
    text = {k: x for k, x in text.items() if x}
    each = sorted(set(text.values()))
    link = {(a, b) for a in each for b in each if a != b and min(len(a), len(b)) >= 24 and line_dedup.edit_distance(a, b, 2) <= 2}
    group = {x: x for x in each}
    for a, b in link:
        old, new = group[b], group[a]
        group = {x: new if g == old else g for x, g in group.items()}
    first = {}
    for k in sorted(text):
        first.setdefault(group[text[k]], k)
    assert len(got) == len(text)
    for r in got:
        k = (r["doc_id"], r["line_no"])
        assert (r["class_doc_id"], r["class_line_no"]) == first[group[text[k]]]
        assert r["n_links"] == sum(a == text[k] for a, _ in link) and r["kept"] == (k == first[group[text[k]]])
    cleaned = line_dedup.drop_near_lines(df, line_dedup.line_classes(df))
    assert cleaned.columns == df.columns and cleaned.count() == df.count()
    assert line_dedup.line_classes(docs).count() > 0
    assert line_dedup.line_classes(empty).count() == 0


def test_short_lines_within_one_edit(spark):
    random.seed(4)
    lines = set()
    for size in [5, 6, 7, 9, 12, 17, 21, 22, 23, 24, 25, 26] * 3:
        x = "".join(random.choice("abcdefgh") for _ in range(size))
        at = random.randrange(size)
        lines |= {x, x[:at] + "Q" + x[at + 1 :], x[:at] + x[at + 1 :], x[:at] + "R" + x[at:], "S" + x[:at] + "T" + x[at:], x + "UV"}
    lines = sorted(lines)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    most = lambda a, b: 2 if min(len(a), len(b)) >= 24 else 1 if min(len(a), len(b)) >= 6 else 0
    links = [sum(a != b and abs(len(a) - len(b)) <= 2 and line_dedup.edit_distance(a, b, 2) <= most(a, b) for b in lines) for a in lines]
    assert [r["n_links"] for r in line_dedup.line_classes(df).orderBy("doc_id").collect()] == links
    assert sum(n > 0 and len(x) < 24 for n, x in zip(links, lines)) > 50


def test_dart_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 50, 600):
        cells, starts = [], [0]
        for _ in range(40):
            common = rng.integers(0, 2**63, round(1.6 * n / 1.8)).astype(np.uint64)
            for _ in range(2):
                cells.append(np.concatenate([common, rng.integers(0, 2**63, n - len(common)).astype(np.uint64)]))
                starts.append(starts[-1] + n)
        s = minhash.dart_signatures(np.concatenate(cells), np.array(starts), 144)
        true = len(common) / (2 * n - len(common))
        assert (s[::2] == s[1::2]).mean() == pytest.approx(true, abs=0.02)


def test_weighted_cells():
    a = minhash.shingle_cells(b"a b c d e a b c d e a b c d e", minhash._WordHash())
    assert len(a) == 11 and len(set(a.tolist())) == 11
    assert len(minhash.shingle_cells(b"", minhash._WordHash())) == 1


def near_truth(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").split()
        sets[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    group = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b:
                both = sum((sets[a] & sets[b]).values())
                if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both) and group[a] != group[b]:
                    old, new = max(group[a], group[b]), min(group[a], group[b])
                    group = {i: new if g == old else g for i, g in group.items()}
    return group


@pytest.mark.parametrize("blocks", [False, True])
def test_near_classes(spark, docs, empty, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(minhash, "MOST_JOINED", 1)
        monkeypatch.setattr(minhash, "BLOCK", 3)
    random.seed(5)
    base = [random.choice("abcdefghijklmnopqrst") * 2 + str(random.randint(0, 99)) for _ in range(120)]
    texts = {}
    for i in range(40):  # copies with few to many edits: their similarities lie on both sides of the threshold
        w = list(base)
        for _ in range(random.randint(0, 6)):
            w[random.randrange(len(w))] = str(random.random())
        texts[i] = " ".join(w)
    texts |= {40: " ".join(map(str, range(50))), 41: None, 42: "", 43: "one two", 44: "one  two"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(df).collect()}
    assert got == near_truth(texts)
    kept = minhash.drop_near_copies(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))
    if not blocks:
        assert minhash.near_classes(docs).count() == docs.count()
        assert minhash.drop_near_copies(docs).columns == docs.columns
        assert minhash.near_classes(empty).count() == 0 and minhash.drop_near_copies(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_rank_file():
    ranks = byte_bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    assert len(ranks) == 50256 and base64.b64encode(b"a") and ranks[b"a"] < 256
