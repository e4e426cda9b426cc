"""Byte-pair encoding and decoding with a pair occurrence index.

A task cuts its texts at ASCII white space and encodes each distinct chunk of a
slice once. The pre-tokens of all new chunks are laid out in one symbol array;
an index maps each mergeable pair to all its positions there. Active ranks are
taken in ascending order: all live positions of the rank's pair merge at once,
and the pairs that this makes are added to the lists of their ranks.

The vocabulary is a tokenizers file of kind BPE with NFC, white space and lower
case normalisers and byte-level symbols with an end-of-word suffix; its path is
a parameter and is opened where tasks run. Null texts count as empty; an empty
text has no ids; very long texts are encoded whole. Repeated rows and rows without an
id are encoded each; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

#: Text bytes whose distinct chunks are encoded together, and the chunks a task remembers at most.
SLICE_BYTES, REMEMBERED = 4 << 20, 150_000
#: The file format's pre-token pattern, white space written out as the Unicode property.
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256))
    out = {b: chr(b) for b in shown}
    return [out.get(b) or chr(256 + next(hidden)) for b in range(256)]


class Vocabulary:
    """Symbols, merge ranks and special tokens of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for s, i in (ids | self.special).items():
            self.strings[i] = s.encode()
        symbols = _byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + suffix] for s in symbols], np.int64)
        left, right, new = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in model["merges"]), strict=True))
        self.left, self.right, self.new, self.width = left, right, new, len(self.strings)
        keys = left * self.width + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it never merges."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, offsets of the words)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - size] = -1
        alive = np.ones(n, bool)
        positions: dict[int, list[np.ndarray]] = defaultdict(list)  # the index: rank of a pair -> where it occurs
        active: list[int] = []

        def occur(at: np.ndarray) -> None:
            """Enter the pairs that begin at these positions."""
            at = at[after[at] >= 0]
            rank = self.ranks(symbols[at], symbols[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            first = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, part in zip(rank[first].tolist(), np.split(at, first[1:]), strict=False):
                if r not in positions:
                    heapq.heappush(active, r)
                positions[r].append(part)

        if n:
            occur(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            lists = positions.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            a, b = self.left[rank], self.right[rank]
            at = at[alive[at] & (symbols[at] == a) & (after[at] >= 0)]
            at = at[symbols[after[at]] == b]
            if a == b and len(at) > 1:  # of a run of overlapping places, every other one
                place = np.arange(len(at))
                start = np.concatenate(([True], after[at[:-1]] != at[1:]))
                at = at[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            follow = after[gone]
            symbols[at], alive[gone], after[at] = self.new[rank], False, follow
            before[follow[follow >= 0]] = at[follow >= 0]
            ahead = before[at]
            occur(np.unique(np.concatenate((at, ahead[ahead >= 0]))))
        return symbols[alive], np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pre_tokens(chunk: str) -> list[str]:
    """The normalised pre-tokens of a chunk without special tokens."""
    if not chunk.isascii():
        chunk = unicodedata.normalize("NFC", chunk)
    chunk = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()  # no final sigma
    return [chunk] if chunk.isalpha() else _PRE.findall(chunk)


class Encoder:
    """Encodes chunks, remembering those already seen in this task."""

    def __init__(self, path: str):
        self.vocab, self.known = vocabulary(path), {}

    def chunks(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text) of each chunk."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        cut = self.vocab.cut
        plan, words = [], {}
        for c in chunks:
            if c not in self.known:
                parts = []
                for piece in cut.split(c) if cut and "<" in c else (c,):
                    if piece in self.vocab.special:
                        parts.append(-1 - self.vocab.special[piece])
                    else:
                        parts += [words.setdefault(w, len(words)) for w in pre_tokens(piece)]
                plan.append((c, parts))
        ids, offsets = self.vocab.encode([w.encode() for w in words])
        strings, raw, offsets = self.vocab.strings, ids.astype("<u4").tobytes(), offsets.tolist()
        ids = ids.tolist()
        coded = [(raw[4 * a : 4 * z], b" ".join([strings[i] for i in ids[a:z]])) for a, z in zip(offsets, offsets[1:], strict=False)]
        for c, parts in plan:
            found = [coded[p] if p >= 0 else ((-1 - p).to_bytes(4, "little"), strings[-1 - p]) for p in parts]
            self.known[c] = found[0] if len(found) == 1 else (b"".join(x for x, _ in found), b" ".join(y for _, y in found))
        return [self.known[c] for c in chunks]


def _encode(path: str, digests: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            ids, decoded = [], []
            for _, _, texts in text.parts(batch, SLICE_BYTES):
                codes, chunks, offsets = text.coded_words(texts)
                known = encoder.chunks(chunks.to_pylist())
                codes, offsets = codes.tolist(), offsets.tolist()
                for i, k in zip(offsets, offsets[1:], strict=False):
                    own = [known[c] for c in codes[i:k]]
                    one, two = b"".join([x for x, _ in own]), b" ".join([y for _, y in own if y])
                    ids.append((len(one) // 4, hashlib.sha256(one).hexdigest()) if digests else (len(one) // 4, np.frombuffer(one, "<u4")))
                    decoded.append(hashlib.sha256(two).hexdigest() if digests else two.decode())
            kind = pa.string() if digests else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in ids], pa.int64()), pa.array([x for _, x in ids], kind), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return of


def encoded(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, decoded for each row; with digests, hex SHA-256 of the last two."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(path, digests), f"doc_id long, n_tokens long, ids {'string' if digests else 'array<int>'}, decoded string")
