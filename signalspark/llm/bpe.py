"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pieces of a task's texts form one long chain of symbols. An index maps every
mergeable pair, by its rank, to all its positions; the active ranks are applied in ascending
order, each to all its positions at once, and the lists of the pairs that a merge makes are
updated. A vocabulary file of a public tokenizer is read on the driver and shipped with the task.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.common import chunks
from signalspark.session import ship_package

#: Bytes of text that are cut into pieces before their distinct pieces are merged together.
GATHER = 24 * 1024 * 1024
#: Distinct pieces that a task remembers at most; beyond that it starts afresh.
REMEMBER = 600_000

# Fixed value: the splitting pattern of byte-level BPE tokenizers (with use_regex).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by the public rule:
    printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        before = spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") \
                or spec["normalizer"] or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: only plain byte-level BPE is read")
        ids, letters = model["vocab"], byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left, self.right, self.new = (np.array([ids[f(m)] for m in merges], np.int64) for f in (
            lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        rank_of = {int(n): r for r, n in enumerate(self.new)}
        if len(rank_of) < len(merges) or any(rank_of.get(int(x), -1) >= r for r, m in enumerate(zip(self.left, self.right, strict=True)) for x in m):
            raise ValueError(f"{path}: a merge uses a token that a later or another merge makes")
        self.size = max([*ids.values(), *(t["id"] for t in added)]) + 1
        key = self.left * self.size + self.right
        self.order = np.argsort(key)
        self.sorted = key[self.order]
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = ids[letter]
        self.tokens = [b""] * self.size
        for token, i in ids.items():
            self.tokens[i] = bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in added}
        for token, i in self.added.items():
            self.tokens[i] = token.encode()
        self.splitter = "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.spelled = np.frombuffer(b"".join(self.tokens), np.uint8)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 if no merge makes it."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
        return np.where(self.sorted[at] == key, self.order[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the tokens of each piece, merged through the pair occurrence index."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(sym)
        ends = np.cumsum(sizes)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends[sizes > 0] - 1] = -1
        prv[(ends - sizes)[sizes > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            r = self.ranks(sym[at], sym[nxt[at]])
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            by = np.argsort(r, kind="stable")
            at, r = at[by], r[by]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            heads = [0, *cuts.tolist(), len(r)]
            for x, a, b in zip(r[heads[:-1]].tolist(), heads, heads[1:], strict=False):
                if x in index:
                    index[x].append(at[a:b])
                else:
                    index[x] = [at[a:b]]
                    heapq.heappush(active, x)

        add(np.flatnonzero(nxt >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.sort(lists[0] if len(lists) == 1 else np.concatenate(lists))
            left, right, new = self.left[r], self.right[r], self.new[r]
            follow = nxt[at]
            at = at[(sym[at] == left) & (follow >= 0) & (sym[follow] == right)]  # others went into earlier merges
            if len(at) > 1:
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                if left == right:  # of overlapping positions the leftmost goes first
                    free, taken = [], -1
                    for p, q in zip(at.tolist(), nxt[at].tolist(), strict=True):
                        if p != taken:
                            free.append(p)
                            taken = q
                    at = np.array(free, np.int64)
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = new, -1
            nxt[at] = after
            held = after >= 0
            prv[after[held]] = at[held]
            before = prv[at]
            add(np.unique(np.concatenate([before[before >= 0], at[held]])))
        left = sym >= 0
        return sym[left], np.concatenate([[0], np.cumsum(left)])[np.concatenate([[0], ends])]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.tokens[i] for i in ids.tolist()])


class _Pieces(dict):
    """Numbers of distinct pieces, in order of appearance."""

    def __missing__(self, piece):
        n = self[piece] = len(self)
        return n


class Encoder:
    """Encodes texts; remembers the tokens of the pieces it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile(f"({vocabulary.splitter})").split if vocabulary.added else None
        self.fresh()

    def fresh(self) -> None:
        self.pieces = _Pieces()
        self.ids, self.offsets = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def cut(self, text: str) -> np.ndarray:
        """Numbers of the pieces of a text."""
        number = self.pieces.__getitem__
        if self.split and any(t in text for t in self.v.added):
            found = []
            for i, segment in enumerate(self.split(text)):
                found += [number((segment,))] if i % 2 else map(number, self.find(segment))
            return np.array(found, np.int32)
        return np.array(list(map(number, self.find(text))), np.int32)

    def learn(self) -> None:
        """Merge the pieces that are new."""
        known = len(self.offsets) - 1
        new = list(self.pieces)[known:]
        if not new:
            return
        ids, offsets = self.v.merge([b"" if isinstance(p, tuple) else p.encode() for p in new])
        marked = [i for i, p in enumerate(new) if isinstance(p, tuple)]
        if marked:  # an added token is a piece of its own, and one token
            ids = np.insert(ids, offsets[marked], [self.v.added[new[i][0]] for i in marked])
            offsets = offsets + np.searchsorted(np.array(marked), np.arange(len(new) + 1))
        self.offsets = np.concatenate([self.offsets, offsets[1:] + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])

    def tokens(self, numbers: np.ndarray) -> np.ndarray:
        size = self.offsets[numbers + 1] - self.offsets[numbers]
        at = np.repeat(self.offsets[numbers] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.ids[at].astype("<u4")


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, decode: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(vocabulary)
    held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
    size = 0

    def done() -> Iterator[pa.RecordBatch]:
        encoder.learn()
        for part, rows in held:
            ids = [encoder.tokens(x) for x in rows]
            cols = [*(part.column(c) for c in part.schema.names if c != "text"), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.tobytes() for x in ids], pa.binary())]
            names = [*(c for c in part.schema.names if c != "text"), "n_tokens", "ids"]
            if decode:
                cols.append(pa.array([vocabulary.decode(x).decode("utf-8", "replace") for x in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)
        held.clear()
        if len(encoder.pieces) > REMEMBER:
            encoder.fresh()

    for part in chunks(batches, "text"):
        held.append((part, [encoder.cut(t or "") for t in part.column("text").to_pylist()]))
        size += part.column("text").nbytes
        if size >= GATHER or len(encoder.pieces) > REMEMBER:
            yield from done()
            size = 0
    yield from done()


def _decode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if x is None else vocabulary.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_tokens, ids[, decoded]).

    ids are little-endian unsigned 32-bit integers in one binary value, decoded the text that
    they spell. Added tokens of the vocabulary are recognised inside texts, as the library does
    by default. A null text is empty; an empty text has no tokens. Repeated rows are encoded
    alike; other columns are ignored; an empty table gives an empty result. No shuffle."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids binary" + ", decoded string" * decode
    return texts.mapInArrow(partial(_encode, vocabulary=Vocabulary(path or default_path()), decode=decode), schema)


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids); null ids stay null, unknown ids fail."""
    ship_package(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, vocabulary=Vocabulary(path or default_path())), f"doc_id {kind}, decoded string")
