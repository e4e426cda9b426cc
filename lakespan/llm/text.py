"""Vectorised text helpers that run inside Arrow batch functions.

Words are cut by Arrow's ASCII splitter (U+0020 and U+0009..U+000D), coded
against a dictionary for each slice, and hashed once for each distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes that one numpy step works on; a longer document is a step alone.
SLICE_BYTES = 4 << 20

_U = np.uint64


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about max_bytes of text each (at least a row)."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield start, stop
        start = stop


def parts(batch: pa.RecordBatch, max_bytes: int = SLICE_BYTES, name: str = "text") -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, end, texts as large_string with null as empty) of parts of a batch; memory goes back after each."""
    texts = batch.column(batch.schema.get_field_index(name))
    for start, stop in slices(texts, max_bytes):
        # copied first: a kernel misreads a slice whose offsets do not start at 0 once it is cast
        own = pa.concat_arrays([texts.slice(start, stop - start)])
        yield start, stop, pc.fill_null(own.cast(pa.large_string()), "")
        pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flat words of all texts, and where each text's words begin (n + 1 offsets)."""
    parts = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(parts.offsets).astype(np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        before = np.concatenate(([0], np.cumsum(full)))
        flat, offsets = flat.filter(pa.array(full)), before[offsets]
    return flat, offsets


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each word, distinct words, offsets of the texts)."""
    flat, offsets = split_words(texts)
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary, offsets


def hash_values(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(b, seed) for b in values.cast(pa.large_binary()).to_pylist()), np.uint64, len(values))


def word_hashes(texts: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the texts)."""
    codes, words, offsets = coded_words(texts)
    return hash_values(words, seed)[codes] if len(words) else np.zeros(0, np.uint64), offsets


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser with a seed."""
    z = x + _U((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of the words[i : i + size] for each i (over text borders too; mask those)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, _U(0x51ED270B0A1F39C1 + seed), np.uint64)
    for k in range(size):
        h = (h ^ words[k : k + n]) * _U(0x9FB21C651E98DF25)
        h ^= h >> _U(29)
    return h


def inside(offsets: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows of `size` words that lie within one text."""
    n = int(offsets[-1])
    if n < size:
        return np.zeros(0, np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n, dtype=np.int64)
    return at[at + size <= ends]


def owner(offsets: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
