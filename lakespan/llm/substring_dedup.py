"""Substring duplicates by level-wise doubling of repeated windows.

Words covered by a window of W words that also starts earlier (in a smaller
doc_id, or earlier in the document) are removed. Windows repeated at one length
alone are extended to twice that length:

short: windows of W / 4 words. Of the short windows inside each full window only
the one with the least hash (the leftmost of ties) is looked at, so equal full
windows look at equal short ones and none is missed, yet about one place in
nine is sent. Short windows that occur once drop out.

middle: a repeated short window is extended to W / 2 words, to the right where
the full window that looks at it has room there, else to the left. What occurs
once drops out again. If no candidate survives, nothing is removed.

full: full windows around a repeated middle window are compared by 128-bit
hashes of their words. The first place of each is found; all others are removed.
The levels end here because a longer window covers no word that its full
windows do not.

Places travel as packed arrays for each hash bucket, sorted and streamed bucket
by bucket. A slice of texts that holds a window twice knows it to be repeated:
it sends one row to tell others and extends its own places at once. So a passage,
line or phrase that very many documents share costs its bucket one row a slice.
The text is dealt by row key once, and both joins by it reuse that exchange; the
number of shares grows with the bytes of text, so a task's part does not.

Null and empty texts have no words; texts shorter than a window keep all words;
very long texts are a slice of their own. A row is known by a 64-bit hash of its
doc_id and text (row), and doc_id. A null doc_id counts as the largest; rows that
share a doc_id, null or not, with different texts are ordered by that hash. Rows
that repeat a doc_id and its text are judged alike: neither is earlier than the
other. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import text

WINDOW = 20
#: Text bytes whose windows are gathered before they are sent, documents for each hash bucket, text bytes and number of shares.
SLICE_BYTES, BUCKET_DOCS, SHARE_BYTES, MOST_SHARES = 4 << 20, 1500, 2 << 20, 100_000
_NO_ID = (1 << 63) - 1
_RIGHT, _LEFT = 1, 2


class Windows:
    """Full windows of some texts, the short window that each looks at, and the middle window around it."""

    def __init__(self, texts: pa.Array, window: int, seed: int = 0):
        self.codes, self.words, self.offsets = text.coded_words(texts)
        self.window, self.middle = window, -(-window // 2)
        self.short = -(-window // 4)
        self.hashes = text.hash_values(self.words, seed)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        self.starts = text.inside(self.offsets, window)
        self.short_hash = text.window_hashes(self.hashes, self.short)
        self.look = _least(self.short_hash, window - self.short + 1)[self.starts] if len(self.starts) else self.starts
        # the short window stands at the start of its middle window, or at the end of it
        self.left = self.look - self.starts > window - self.middle
        self.place = np.where(self.left, self.look - (self.middle - self.short), self.look)
        self.owner = text.owner(self.offsets)

    def candidates(self, places: pa.Array) -> np.ndarray:
        """Indices into starts whose middle window is among the places (a list of words for each text)."""
        flat, lists = _flat(places)
        mark = np.zeros(len(self.codes) + 1, bool)
        at = flat + self.offsets[:-1][np.repeat(np.arange(len(lists) - 1), np.diff(lists))]
        mark[at[at < len(self.codes)]] = True
        return np.flatnonzero(mark[self.place])


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The place of the least value (the leftmost of ties) in values[i : i + size], for each i; size doubles."""
    n, at, have = len(values), np.arange(len(values)), 1
    while have < size and n:
        step = min(have, size - have)
        ahead = at[np.minimum(np.arange(n) + step, n - 1)]
        at = np.where(values[ahead] < values[at], ahead, at)
        have += step
    return at


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column, null as empty."""
    lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(lists) else np.zeros(0, np.int64)
    return values.astype(np.int64), offsets - offsets[0]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _packets(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: the columns' values in it, one array after the other."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    edges = np.append(first, len(bucket))
    columns = [c[order] for c in columns]
    blobs = [b"".join(c[a:z].tobytes() for c in columns) for a, z in zip(edges, edges[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), kind), pa.int32()), pa.array(bucket[first], pa.int64()), pa.array(np.diff(edges), pa.int32()), pa.array(blobs, pa.binary())], ["kind", "bucket", "n", "blob"])


def _buckets(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket, from rows sorted by bucket."""
    last, parts = None, []

    def joined() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*parts, strict=True)]

    for batch in batches:
        for bucket, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != last and parts:
                yield joined()
                parts = []
            last, at, own = bucket, 0, []
            for kind in kinds:
                own.append(np.frombuffer(blob, kind, n, at))
                at += own[-1].nbytes
            parts.append(own)
    if parts:
        yield joined()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(kind, columns) of each bucket, from rows sorted by kind and bucket."""
    last, parts = None, []

    def joined() -> tuple[int, list[np.ndarray]]:
        return last[0], [np.concatenate(c) for c in zip(*parts, strict=True)]

    for batch in batches:
        for kind, bucket, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (kind, bucket) != last and parts:
                yield joined()
                parts = []
            last, at, own = (kind, bucket), 0, []
            for field in _FIELDS[kind]:
                own.append(np.frombuffer(blob, field, n, at))
                at += own[-1].nbytes
            parts.append(own)
    if parts:
        yield joined()


#: Columns of a packet by kind: short windows (hash, row, place, sides, check of each side), middle windows
#: (hash, row, place, known to be repeated), places of repeated middle windows (row, place), full windows
#: (hash, other hash, id, row, place).
_SHORT, _MIDDLE, _PLACES, _FULL = range(4)
_FIELDS = {_SHORT: ("<u8", "<i8", "<i4", "u1", "<u4", "<u4"), _MIDDLE: ("<u8", "<i8", "<i4", "?"), _PLACES: ("<i8", "<i4"), _FULL: ("<u8", "<u8", "<i8", "<i8", "<i4")}


def _by_row(rows: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """One row for each row key: its places."""
    order = np.lexsort((places, rows))
    rows, places = rows[order], places[order]
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)), pa.int32()), pa.array(places, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(rows[first], pa.int64()), lists], ["row", "places"])


def _sides(w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(places looked at, sides to which they are extended)."""
    at, back = np.unique(w.look, return_inverse=True)
    sides = np.zeros(len(at), np.uint8)
    np.bitwise_or.at(sides, back, np.where(w.left, _LEFT, _RIGHT).astype(np.uint8))
    return at, sides


def _extended(short: np.ndarray, side: int, check: np.ndarray) -> np.ndarray:
    """Hash of a middle window: that of its short window, the side, and 32 bits of its own words."""
    return text.mix(short ^ (check.astype(np.uint64) << np.uint64(7)), 10 + side) ^ check.astype(np.uint64)


def _middle_packets(hashes: np.ndarray, rows: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Middle windows of a slice: one row of each, and the places of those that the slice holds twice."""
    if not len(hashes):
        return
    _, first, back, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    again = count[back] > 1
    sent = np.sort(first)
    yield _packets(_MIDDLE, (hashes[sent] % np.uint64(buckets)).astype(np.int64), hashes[sent], rows[sent], places[sent], again[sent])
    if again.any():
        known = np.flatnonzero(again)
        yield _packets(_PLACES, (text.mix(rows[known].view(np.uint64), 5) % np.uint64(buckets)).astype(np.int64), rows[known], places[known])


def _short_windows(window: int, buckets: int):
    """Packets of the short windows looked at; those that a slice holds twice are extended at once."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _column(batch, "row")
            for a, z, texts in text.parts(batch, SLICE_BYTES):
                w = Windows(texts, window)
                if not len(w.starts):
                    continue
                at, sides = _sides(w)
                shift = w.middle - w.short
                doc = w.owner[at]
                row, place = keys[a:z][doc], (at - w.offsets[doc]).astype(np.int32)
                own = text.window_hashes(w.hashes, w.middle, seed=3)
                check = {side: np.where(sides & side, own[np.clip(at - (shift if side == _LEFT else 0), 0, len(own) - 1)] >> np.uint64(32), 0).astype(np.uint32) for side in (_RIGHT, _LEFT)}
                h = w.short_hash[at]
                _, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                again = count[back] > 1
                told = np.where(again, 0, sides).astype(np.uint8)
                sent = np.sort(first)
                yield _packets(_SHORT, (h[sent] % np.uint64(buckets)).astype(np.int64), h[sent], row[sent], place[sent], told[sent], check[_RIGHT][sent], check[_LEFT][sent])
                yield from _middle_packets(*_both_sides(h, row, place, np.where(again, sides, 0), check[_RIGHT], check[_LEFT], shift), buckets)

    return of


def _both_sides(h, row, place, sides, right, left, shift) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place) of the middle windows of some short ones."""
    r, t = np.flatnonzero(sides & _RIGHT), np.flatnonzero(sides & _LEFT)
    hashes = np.concatenate((_extended(h[r], _RIGHT, right[r]), _extended(h[t], _LEFT, left[t])))
    return hashes, np.concatenate((row[r], row[t])), np.concatenate((place[r], place[t] - shift)).astype(np.int32)


def _longer(window: int, buckets: int):
    """Middle windows of the short ones that several slices hold; packets of other kinds pass."""
    shift = -(-window // 2) - -(-window // 4)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, columns in _buckets(batches):
            if kind == _SHORT:
                h, row, place, sides, right, left = columns
                _, back, count = np.unique(h, return_inverse=True, return_counts=True)
                stays = count[back] > 1
                hashes, rows, places = _both_sides(h, row, place, np.where(stays, sides, 0), right, left, shift)
                yield from _middle_packets(hashes, rows, places, buckets)
            else:
                hashes = columns[0] if kind == _MIDDLE else text.mix(columns[0].view(np.uint64), 5)
                yield _packets(kind, (hashes % np.uint64(buckets)).astype(np.int64), *columns)

    return of


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, places of the repeated middle windows."""
    for kind, columns in _buckets(batches):
        if kind == _PLACES:
            yield _by_row(*columns)
            continue
        h, row, place, again = columns
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        stays = (count[back] > 1) | again
        if stays.any():
            yield _by_row(row[stays], place[stays])


def _full_windows(window: int, buckets: int):
    """Packets of the full windows to compare, by the bucket of their middle window."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = _column(batch, "id"), _column(batch, "row")
            lists = batch.column(batch.schema.get_field_index("places"))
            for a, z, texts in text.parts(batch, SLICE_BYTES):
                w = Windows(texts, window)
                at = w.candidates(lists.slice(a, z - a))
                if not len(at):
                    continue
                start = w.starts[at]
                other = text.hash_values(w.words, 1)[w.codes]
                one, two = _at(w.hashes, start, window, 0), _at(other, start, window, 7)
                doc = w.owner[start]
                own, row, place = ids[a:z][doc], keys[a:z][doc], (start - w.offsets[doc]).astype(np.int32)
                sent = np.sort(_first(one, two, own, row, place))
                bucket = (one[sent] % np.uint64(buckets)).astype(np.int64)
                yield _packets(_FULL, bucket, one[sent], two[sent], own[sent], row[sent], place[sent])

    return of


def _at(words: np.ndarray, starts: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of the windows of `size` words at some starts."""
    h = np.full(len(starts), np.uint64(0x51ED270B0A1F39C1 + seed), np.uint64)
    for k in range(size):
        h = (h ^ words[starts + k]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return h


def _first(one: np.ndarray, two: np.ndarray, own: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Indices of the first place of each distinct window."""
    order = np.lexsort((place, row, own, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    return order[new]


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, row, places: the first place of each distinct window."""
    for _, (one, two, own, row, place) in _buckets(batches):
        first = _first(one, two, own, row, place)
        order = first[np.lexsort((place[first], row[first], own[first]))]
        new = np.flatnonzero(np.concatenate(([True], (own[order][1:] != own[order][:-1]) | (row[order][1:] != row[order][:-1]))))
        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(own[order][new], pa.int64()), pa.array(row[order][new], pa.int64()), lists], ["id", "row", "places"])


def _kept(window: int, digests: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, first = (batch.column(batch.schema.get_field_index(c)) for c in ("places", "firsts"))
            for a, z, own in text.parts(batch, SLICE_BYTES):
                flat, offsets = text.split_words(own)
                keep = np.ones(len(flat), bool)
                some = np.flatnonzero(pc.list_value_length(places.slice(a, z - a)).fill_null(0).to_numpy(zero_copy_only=False) > 0)
                if len(some):
                    w = Windows(own.take(pa.array(some)), window)
                    at = w.starts[w.candidates(places.slice(a, z - a).take(pa.array(some)))]
                    spared, lists = _flat(first.slice(a, z - a).take(pa.array(some)))
                    mark = np.zeros(len(w.codes) + 1, bool)
                    mark[at] = True
                    mark[spared + w.offsets[:-1][np.repeat(np.arange(len(some)), np.diff(lists))]] = False
                    start = np.flatnonzero(mark)
                    edges = np.bincount(start, minlength=len(mark) + window) - np.bincount(start + window, minlength=len(mark) + window)
                    covered = np.cumsum(edges)[: len(w.codes)] > 0
                    keep[np.arange(len(covered)) + np.repeat(offsets[some] - w.offsets[:-1], np.diff(w.offsets))] = ~covered
                before = np.concatenate(([0], np.cumsum(keep)))
                rest = flat if keep.all() else flat.filter(pa.array(keep))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(before[offsets], pa.int32()), rest), pa.scalar(" ", pa.large_string()))
                removed = np.diff(offsets) - np.diff(before[offsets])
                out = pa.array([hashlib.sha256(x).hexdigest() for x in joined.cast(pa.large_binary()).to_pylist()], pa.string()) if digests else joined.cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(np.diff(offsets)), pa.array(removed), out], ["doc_id", "n_words", "n_removed", "kept"])

    return of


def repeated_places(docs: DataFrame, window: int, buckets: int, shares: int) -> DataFrame:
    """row, places: where the middle windows stand that survive both levels. docs has row and text."""

    def dealt(packets: DataFrame) -> DataFrame:
        return packets.repartition(shares, "kind", "bucket").sortWithinPartitions("kind", "bucket")

    packet = "kind int, bucket long, n int, blob binary"
    short = dealt(docs.mapInArrow(_short_windows(window, buckets), packet))
    middle = dealt(short.mapInArrow(_longer(window, buckets), packet))
    places = middle.mapInArrow(_repeated, "row long, places array<int>")
    return scratch.written(places.groupBy("row").agg(F.flatten(F.collect_list("places")).alias("places")), "places")


def without_repeats(docs: DataFrame, window: int = WINDOW, digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space; with digests, its hex SHA-256)."""
    if window < 2:
        raise ValueError("a window has two words at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets, shares = max(64, rows // BUCKET_DOCS), max(64, min(MOST_SHARES, size // SHARE_BYTES))
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    places = repeated_places(keyed.select("row", "text"), window, buckets, shares)
    out = "doc_id long, n_words long, n_removed long, kept string"
    none = F.lit(None).cast("array<int>")
    if places.isEmpty():  # no candidates survive
        return keyed.select("doc_id", "text", none.alias("places"), none.alias("firsts")).mapInArrow(_kept(window, digests), out)

    apart = keyed.withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID))).repartition(shares, "row")
    joined = apart.join(places.hint("merge"), "row", "left").select("doc_id", "text", "places", "id", "row")
    full = joined.where("places IS NOT NULL").mapInArrow(_full_windows(window, buckets), "kind int, bucket long, n int, blob binary")
    full = full.repartition(shares, "kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_firsts, "id long, row long, places array<int>")
    firsts = full.groupBy("row").agg(F.collect_list(F.struct("id", "places")).alias("firsts"))
    own = F.flatten(F.transform(F.filter("firsts", lambda f: f["id"] == F.col("id")), lambda f: f["places"]))
    both = joined.join(firsts.hint("merge"), "row", "left").select("doc_id", "text", "places", own.alias("firsts"))
    return both.mapInArrow(_kept(window, digests), out)


#: The same removal by brute force over all windows, for DuckDB.
ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
later AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY x ORDER BY r, i) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM later),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
stay AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN stay USING (r)
"""
