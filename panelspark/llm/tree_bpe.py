"""BPE encoding and decoding of a tokenizers JSON vocabulary by tree concatenation.

A text is cut into leaves, which are encoded in parallel, each as if it stood
alone.  Neighbours are then concatenated pair by pair, up a tree.  At every join a
window around it is encoded anew and grows until its ends agree with what both
sides had; the rest of both sides stays as it is.  That happens at two levels:

- **Leaves of a text** (more than ``LEAF_CHARS`` characters): leaves are dealt to
  tasks of their own.  The window is made of whole pre-tokens.  The split before a
  window depends on nothing after it, as no match looks more than two matches
  ahead.  Behind it, a match depends only on what follows, so two equal matches at
  the window's end mean that everything after them is split as before.
- **Halves of a pre-token** (more than ``LEAF_BYTES`` bytes), and pre-tokens that
  leaves had cut: the window is made of tokens.  A sequence of tokens is the
  encoding of its bytes if and only if each two neighbours are the encoding of
  theirs.  So it is enough that the window's first and last tokens are the ones
  that stood there before: their outer neighbours then fit, too.

A vocabulary's merges make every entry in one way only; others are refused.  The
strings of special tokens inside a text are those tokens, as the library takes
them, and are never cut by leaves.

Defined results: null text is the empty text, which has no ids.  Unknown ids raise
``KeyError``; bytes that are no UTF-8 decode to U+FFFD.  Rows that repeat an id
give a row each; equal rows are encoded once and repeated.  An empty table gives an
empty table.  No limit on length but a row's; a join holds one text's ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import repeat
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm._shared import text_or_empty
from panelspark.llm.pretokens import PATTERN, pretokens

#: Characters of a leaf of a text, and bytes of a leaf of a pre-token.
LEAF_CHARS, LEAF_BYTES = 1 << 15, 64
#: Pre-tokens, and tokens, that a window takes from each side at first.
WINDOW_PIECES, WINDOW_TOKENS = 3, 4
#: Pre-tokens whose ids a worker remembers, and the longest of them; it starts afresh beyond that.
MOST_REMEMBERED, LONGEST_REMEMBERED = 400_000, 256

_NONE = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _is_latin(text: str) -> bool:
    """Whether all characters are below U+0100, where no letters are new."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _newer_letters(tokenizer_json: str) -> str:
    """Ranges of letters and numbers that the installed pattern engine knows, but the tokenizer's own tables do not yet."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_str(tokenizer_json).pre_tokenizer.pre_tokenize_str
    own = regex.compile(r"[\p{L}\p{N}]")
    unsure = [c for c in map(chr, range(0x80, 0x110000)) if category(c) == "Cn" and own.match(c)]
    newer = np.array([ord(c) for c in unsure if len(split("." + c)) == 1], np.int64)
    runs = np.split(newer, np.flatnonzero(np.diff(newer) > 1) + 1) if len(newer) else []
    return "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs)


class TreeBPE:
    """Encoder and decoder of one vocabulary.

    ``special``: whether special tokens are looked for in texts.
    """

    def __init__(self, vocabulary: str, special: bool = True) -> None:
        with open(vocabulary, encoding="utf-8") as file:
            source = file.read()
        spec = json.loads(source)
        model, letters = spec["model"], byte_letters()
        raw = {t: bytes(map(letters.__getitem__, t)) for t in model["vocab"]}
        self.entries: dict[int, bytes] = {i: raw[t] for t, i in model["vocab"].items()}
        self.byte_id = [0] * 256
        for t, i in model["vocab"].items():
            if len(raw[t]) == 1:
                self.byte_id[raw[t][0]] = i
        self.pairs: dict[tuple[int, int], int] = {}
        made_before: set[int] = set()
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = (model["vocab"][t] for t in (a, b, a + b))
            if made in made_before:
                raise ValueError("two merges make one entry")
            self.pairs[a, b] = rank << 24 | made
            made_before.add(made)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]} if special else {}
        self.entries |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        newer = _newer_letters(source)
        self._newer = re.compile(f"[{newer}]") if newer else None
        self.known = _Remembered(self)

    def split(self, text: str) -> list[str]:
        """Pre-tokens and special tokens, which together are the text."""
        if self._cut is not None and any(s in text for s in self.special):
            return [p for i, part in enumerate(self._cut.split(text)) for p in ([part] if i % 2 else self._matches(part))]
        return self._matches(text)

    def _matches(self, text: str) -> list[str]:
        if self._newer is None or _is_latin(text) or not self._newer.search(text):
            return pretokens(text)
        # an unassigned character stands in for letters that the tokenizer takes as no letters
        ends = np.cumsum([0, *map(len, regex.findall(PATTERN, self._newer.sub("͸", text)))]).tolist()
        return [text[a:b] for a, b in zip(ends, ends[1:])]

    def piece(self, piece: str) -> bytes:
        """Ids of a pre-token or special token, as little-endian 32-bit numbers."""
        return self.known[piece]

    def encode(self, text: str) -> bytes:
        """Ids of a text, pre-token by pre-token."""
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))

    def encode_bytes(self, raw: bytes) -> list[int]:
        """Ids of one pre-token: halves first, then their join."""
        if len(raw) <= LEAF_BYTES:
            return self._merged(raw)
        half = len(raw) // 2
        return self.join(self.encode_bytes(raw[:half]), self.encode_bytes(raw[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the bytes of ``left`` and ``right`` together; each is the encoding of its own."""
        if not left or not right:
            return left or right
        a = b = WINDOW_TOKENS
        while True:
            before, after = left[-a:], right[:b]
            window = self._merged(self.decode(before + after))
            fits_left = a >= len(left) or window[0] == before[0]
            fits_right = b >= len(right) or window[-1] == after[-1]
            if fits_left and fits_right:
                return left[:-a] + window + right[b:]
            a, b = a if fits_left else 2 * a, b if fits_right else 2 * b

    def _merged(self, raw: bytes) -> list[int]:
        ids = [self.byte_id[x] for x in raw]
        return self._by_scan(ids) if len(ids) <= LEAF_BYTES else self._by_heap(ids)

    def _by_scan(self, ids: list[int]) -> list[int]:
        """Merges of a short run, whose pairs are all looked through for the lowest rank."""
        get = self.pairs.get
        found = list(map(get, zip(ids, ids[1:]), repeat(_NONE)))
        while found:
            best = min(found)
            if best == _NONE:
                break
            i, made = found.index(best), best & 0xFFFFFF
            ids[i : i + 2] = [made]
            del found[i]
            if i < len(found):
                found[i] = get((made, ids[i + 1]), _NONE)
            if i:
                found[i - 1] = get((ids[i - 1], made), _NONE)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        """Merges of a long run: a heap of pairs over linked tokens."""
        n, pairs = len(ids), self.pairs
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(value, i, ids[i], ids[i + 1]) for i in range(n - 1) if (value := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapify(heap)
        while heap:
            value, i, a, b = heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = value & 0xFFFFFF, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (value := pairs.get((ids[i], ids[k]))) is not None:
                    heappush(heap, (value, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (value := pairs.get((ids[h], ids[i]))) is not None:
                heappush(heap, (value, h, ids[h], ids[i]))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return out

    def cuts(self, text: str, size: int) -> list[str]:
        """The text in leaves of about ``size`` characters, none of which cuts a special token."""
        out, at = [], 0
        while at < len(text):
            end = min(at + size, len(text))
            for token in self.special:
                found = text.find(token, max(at, end - len(token) + 1), end + len(token) - 1)
                if at <= found < end < found + len(token):
                    end = found if found > at else found + len(token)
            out.append(text[at:end])
            at = end
        return out


class Node:
    """The ids of a stretch of text, and which of them begin a pre-token."""

    def __init__(self, ids: np.ndarray, begins: np.ndarray) -> None:
        self.ids, self.begins = ids, begins

    @staticmethod
    def of(pieces: list[bytes]) -> Node:
        ids = np.frombuffer(b"".join(pieces), "<u4")
        begins = np.zeros(len(ids), bool)
        begins[np.cumsum([0, *(len(p) // 4 for p in pieces)])[:-1]] = True
        return Node(ids, begins)

    def ends(self) -> np.ndarray:
        """Places of pre-token starts, and the end."""
        return np.append(np.flatnonzero(self.begins), len(self.ids))


def join_nodes(bpe: TreeBPE, left: Node, right: Node) -> Node:
    """The node of two neighbouring stretches of one text."""
    if not len(left.ids) or not len(right.ids):
        return left if len(left.ids) else right
    ends_left, ends_right, n = left.ends(), right.ends(), WINDOW_PIECES
    shown = lambda node, ends: [(bpe.decode(x.tolist()).decode(), x) for x in np.split(node.ids[ends[0] : ends[-1]], (ends - ends[0])[1:-1])]
    while True:
        some_left, some_right = ends_left[-n - 1 :], ends_right[: n + 1]
        before, after = shown(left, some_left), shown(right, some_right)
        old = [t for t, _ in before + after]
        new = bpe.split("".join(old))
        if (some_left[0] == 0 or new[0] == old[0]) and (some_right[-1] == len(right.ids) or new[-2:] == old[-2:]):
            break
        n *= 2
    had, at = {}, 0
    for text, ids in before + after:
        had[at, at + len(text)] = ids
        at += len(text)
    cut, at, pieces = sum(len(t) for t, _ in before), 0, []
    for text in new:
        end = at + len(text)
        if (at, end) in had:
            pieces.append(had[at, end].astype("<u4").tobytes())
        elif (at, cut) in had and (cut, end) in had:
            pieces.append(np.array(bpe.join(had[at, cut].tolist(), had[cut, end].tolist()), "<u4").tobytes())
        else:
            pieces.append(bpe.piece(text))
        at = end
    middle = Node.of(pieces)
    head, tail = some_left[0], some_right[-1]
    return Node(np.concatenate([left.ids[:head], middle.ids, right.ids[tail:]]), np.concatenate([left.begins[:head], middle.begins, right.begins[tail:]]))


def join_tree(bpe: TreeBPE, leaves: list[Node]) -> Node:
    """All leaves of a text, joined pair by pair until one is left."""
    while len(leaves) > 1:
        leaves = [join_nodes(bpe, *leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


class _Remembered(dict):
    """Pre-token or special token to its ids as little-endian 32-bit numbers."""

    def __init__(self, bpe: TreeBPE) -> None:
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        special = self.bpe.special.get(piece)
        ids = np.array(self.bpe.encode_bytes(piece.encode()) if special is None else [special], "<u4").tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= MOST_REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(vocabulary: str, special: bool = True) -> TreeBPE:
    """A worker's encoder of a vocabulary file, with what it remembers."""
    return TreeBPE(vocabulary, special)


#: What becomes of a text's ids: the columns after ``doc_id``, as values and as a schema.
Finish = Callable[[TreeBPE, np.ndarray], tuple]


def _apply(docs: DataFrame, vocabulary: str, special: bool, finish: Finish, kinds: list[tuple[str, str, pa.DataType]], id_col: str, text_col: str) -> DataFrame:
    names, schema = ["doc_id", *(n for n, _, _ in kinds)], ", ".join(["doc_id long", *(f"{n} {k}" for n, k, _ in kinds)])

    def rows(doc_id: pa.Array, results: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*results)) if results else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([doc_id, *(pa.array(c, k) for c, (_, _, k) in zip(columns, kinds))], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, special)
        for batch in batches:
            yield rows(batch.column(0), [finish(bpe, np.frombuffer(bpe.encode(t), "<u4")) for t in batch.column(1).to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, special)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts, key = bpe.cuts(text, LEAF_CHARS), hashlib.sha256(text.encode()).digest()
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(parts), pa.int64()), pa.array([key] * len(parts), pa.binary()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["doc_id", "key", "leaf", "part"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, special)
        for batch in batches:
            done = [Node.of(list(map(bpe.piece, bpe.split(t)))) for t in batch.column("part").to_pylist()]
            ids, begins = pa.array([x.ids.tobytes() for x in done], pa.binary()), pa.array([np.packbits(x.begins).tobytes() for x in done], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "leaf", "copies")), ids, begins], ["doc_id", "key", "leaf", "copies", "ids", "begins"])

    def joined(group: pa.Table) -> pa.Table:
        bpe = encoder(vocabulary, special)
        order = np.argsort(group.column("leaf").to_numpy())
        ids, begins = group.column("ids"), group.column("begins")
        nodes = []
        for i in order:
            own = np.frombuffer(ids[i].as_py(), "<u4")
            nodes.append(Node(own, np.unpackbits(np.frombuffer(begins[i].as_py(), np.uint8), count=len(own)).astype(bool)))
        result, copies = finish(bpe, join_tree(bpe, nodes).ids), group.column("copies")[0].as_py()
        return pa.Table.from_batches([rows(pa.array([group.column("doc_id")[0].as_py()] * copies, pa.int64()), [result] * copies)])

    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    is_long = F.char_length("text") > LEAF_CHARS
    short = rows_in.where(~is_long).mapInArrow(whole, schema)
    parts = rows_in.where(is_long).mapInArrow(cut, "doc_id long, key binary, leaf int, part string")
    # one row a leaf, in tasks of their own; rows with the same id and text are one
    parts = parts.groupBy("doc_id", "key", "leaf", "part").agg(F.count(F.lit(1)).alias("copies"))
    coded = parts.mapInArrow(leaves, "doc_id long, key binary, leaf int, copies long, ids binary, begins binary")
    return short.unionByName(coded.groupBy("doc_id", "key").applyInArrow(joined, schema))


def encode_documents(docs: DataFrame, vocabulary: str, special: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, ids`` (array of int)."""
    return _apply(docs, vocabulary, special, lambda bpe, ids: (ids.astype(np.int32),), [("ids", "array<int>", pa.list_(pa.int32()))], id_col, text_col)


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row of :func:`encode_documents`: ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            texts = [bpe.decode(x).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; ids stay in the task."""

    def digest(bpe: TreeBPE, ids: np.ndarray) -> tuple:
        ids = ids.tolist()
        decoded = bpe.decode(ids)
        try:
            decoded.decode()
        except UnicodeDecodeError:
            decoded = decoded.decode(errors="replace").encode()
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    kinds = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _apply(docs, vocabulary, True, digest, kinds, id_col, text_col)
