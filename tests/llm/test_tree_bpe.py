"""Tree concatenation against the tokenizers library."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from panelspark.llm import tree_bpe
from panelspark.llm.queries import vocabulary

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

SPECIAL = "<|endoftext|>"
EDGES = ["", "a", SPECIAL, SPECIAL * 3, "<|endof", "a  " + SPECIAL + "  b", "we're they'll 'tis I'd'", "   x\n\n\n y  \t", "日本語テキスト" * 30, "naïve Straße \U0001f600!", "a" * 999, "ab" * 500, " " * 777, "'" * 300 + "s", "՘՘x \U0003fc3f", "12345 6 7.8e9", "x" * 130 + "é" * 90]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def bpe():
    return tree_bpe.TreeBPE(vocabulary("byte_bpe_50k.json"))


def want(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def ids(coded):
    return np.frombuffer(coded, "<u4").tolist()


def some_texts(n, seed=0):
    rng = random.Random(seed)
    pieces = ["a", "b", "the", "ing", " ", "  ", "\n", "'", "'s", "'re", "r", "e", "l", ".", "!!", "9", "é", "日", "　", SPECIAL, "<|", "end", "|>", "\U0001f600", "́", "zq" * 40]
    for _ in range(n):
        yield "".join(rng.choice(pieces) for _ in range(rng.randint(1, 120)))


def test_encode_equals_the_library(tokenizer, bpe):
    for text in [*EDGES, *some_texts(300)]:
        got = ids(bpe.encode(text))
        assert got == want(tokenizer, text), text
        assert bpe.decode(got).decode(errors="replace") == tokenizer.decode(got, skip_special_tokens=False)


def test_letters_newer_than_the_tokenizer(tokenizer, bpe):
    for c in [*range(0x80, 0x3400, 3), *range(0xA000, 0xD800, 41), *range(0xE000, 0x40000, 101), 0x1C89, 0x16FF6, 0x11DE0]:
        text = "a" + chr(c) + "1" + chr(c) + ". " + chr(c) * 2
        assert ids(bpe.encode(text)) == want(tokenizer, text), hex(c)


def test_joins_of_tokens(tokenizer, bpe):
    """Any two encodings, joined, are the encoding of both; also where windows must grow to the whole."""
    rng = random.Random(1)
    for alphabet in ("a", "ab", "th ein", "0123456789", "aé日"):
        for _ in range(150):
            raw = "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 400))).replace(" ", "x").encode()
            cut = rng.randint(1, len(raw) - 1)
            whole = bpe._by_heap([bpe.byte_id[b] for b in raw])
            assert bpe.join(bpe._merged(raw[:cut]), bpe._merged(raw[cut:])) == whole == bpe.encode_bytes(raw)
            assert bpe._by_scan([bpe.byte_id[b] for b in raw]) == whole


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40])
def test_leaves_of_every_size(tokenizer, bpe, size):
    for text in [*EDGES, *some_texts(120, size)]:
        if not text:
            continue
        parts = bpe.cuts(text, size)
        assert "".join(parts) == text and "" not in parts
        node = tree_bpe.join_tree(bpe, [tree_bpe.Node.of(list(map(bpe.piece, bpe.split(p)))) for p in parts])
        assert node.ids.tolist() == want(tokenizer, text), (size, text)
        starts = np.cumsum([0, *(len(bpe.piece(p)) // 4 for p in bpe.split(text))])[:-1]
        assert np.flatnonzero(node.begins).tolist() == starts.tolist()


def test_documents(spark, tokenizer):
    """Long texts take the way by leaves; nulls, repeated rows and clashing names do no harm."""
    rng = random.Random(2)
    long = ["".join(rng.choice("etaoin shrdlu.,\n'") for _ in range(n)) for n in (32768, 32769, 200_000)] + ["x" * 70_000, " " * 70_000 + "y", ("word's " + SPECIAL) * 9000]
    rows = [(i, t, 1, "k", 0) for i, t in enumerate([None, "", *EDGES, *long])]
    rows += [rows[-1], (rows[-1][0], rows[-2][1], 1, "k", 0), (None, long[0], None, None, None), (None, long[0], None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaf int, key string, copies int").repartition(3)
    found = Counter()
    for i, t, *_ in rows:
        code = want(tokenizer, t or "")
        found[i, len(code), hashlib.sha256(",".join(map(str, code)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(code, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, tree_bpe.round_trip(docs, vocabulary("byte_bpe_50k.json")).collect())) == found
    coded = tree_bpe.encode_documents(docs, vocabulary("byte_bpe_50k.json"))
    assert Counter((r[0], tuple(r[1])) for r in coded.collect()) == Counter((i, tuple(want(tokenizer, t or ""))) for i, t, *_ in rows)
    assert Counter(map(tuple, tree_bpe.decode_documents(coded, vocabulary("byte_bpe_50k.json")).collect())) == Counter((i, t or "") for i, t, *_ in rows)
    assert tree_bpe.round_trip(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_query_on_the_corpus(spark, sf, tokenizer):
    from panelspark.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_tree_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        code = want(tokenizer, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(code), hashlib.sha256(",".join(map(str, code)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
