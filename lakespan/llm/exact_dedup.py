"""Exact duplicates through a log-structured merge index of digests.

Each task streams its documents' digests into a memtable; a full memtable is
flushed as a run sorted by digest, cut into buckets by digest. A bucket's task
takes its runs as they come: runs of like size are merged, `fanout` at a time,
keeping the smallest identifier of each digest and adding the counts. What
stays, a few runs a bucket, is written to the shared folder with a filter for
each run. A lookup of a digest asks the filters of a bucket's runs first, then
the runs that may hold it; digests with more than one row are hits. The bytes of
hits are compared with those of the row that stays, and a digest whose bytes
differ is grouped by its bytes.

A task holds a memtable, or the runs of one bucket of about BUCKET_ROWS rows; a
text of which very many rows are copies is one entry of each run.

Identifiers are ~doc_id when the largest doc_id is to stay. A null text counts
as empty; a null doc_id is the last choice of its group; repeated rows count one
by one; a very long text is hashed whole; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import text
from .skew import join_counted, left_counted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a group that one salted share of the byte verification holds, about.
SALT_ROWS = 512
#: Digests of a memtable, runs that are merged at a time, and rows for each bucket of the index.
MEMTABLE_ROWS, FANOUT, BUCKET_ROWS = 50_000, 6, 200_000
_LAST = (1 << 63) - 1


def prefixes(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two 8-byte numbers of each digest; a short digest is padded."""
    width = digests.dtype.itemsize
    raw = np.frombuffer(digests.tobytes(), np.uint8).reshape(len(digests), width)
    raw = np.ascontiguousarray(np.pad(raw, ((0, 0), (0, max(0, 16 - width))))[:, :16]).view(">u8")
    return raw[:, 0].astype(np.uint64), raw[:, 1].astype(np.uint64)


class Bloom:
    """A filter of 10 bits a digest, probed four times."""

    def __init__(self, digests: np.ndarray | None = None, bits: bytes = b""):
        if digests is None:
            self.bits = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
            return
        self.bits = np.zeros(-(-max(64, 10 * len(digests)) // 8) * 8, bool)
        for at in self._places(digests):
            self.bits[at] = True

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    def _places(self, digests: np.ndarray) -> Iterator[np.ndarray]:
        a, b = prefixes(digests)
        for k in range(4):
            yield (text.mix(a, k) ^ b) % np.uint64(len(self.bits))

    def maybe(self, digests: np.ndarray) -> np.ndarray:
        out = np.ones(len(digests), bool)
        for at in self._places(digests):
            out &= self.bits[at]
        return out


@dataclass
class Run:
    """A sorted run: distinct digests, their smallest identifiers, their counts, and a filter."""

    digests: np.ndarray
    idents: np.ndarray
    counts: np.ndarray
    bloom: Bloom | None = None

    def filter(self) -> Bloom:
        if self.bloom is None:
            self.bloom = Bloom(self.digests)
        return self.bloom

    @classmethod
    def of(cls, digests: np.ndarray, idents: np.ndarray, counts: np.ndarray) -> Run:
        order = np.lexsort((idents, digests))
        d = digests[order]
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1]))) if len(d) else np.zeros(0, np.int64)
        sums = np.add.reduceat(counts[order], first) if len(d) else counts
        return cls(d[first], idents[order][first], sums)

    def find(self, digests: np.ndarray) -> tuple[np.ndarray, int]:
        """(index of each digest in this run, or -1; how many the filter let through)."""
        out = np.full(len(digests), -1)
        if not len(self.digests) or not len(digests):
            return out, 0
        ask = np.flatnonzero(self.filter().maybe(digests))
        at = np.minimum(np.searchsorted(self.digests, digests[ask]), len(self.digests) - 1)
        hit = self.digests[at] == digests[ask]
        out[ask[hit]] = at[hit]
        return out, len(ask)


class DigestLsm:
    """Memtable, sorted runs in tiers of like size, and compaction."""

    def __init__(self, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT):
        self.memtable_rows, self.fanout = memtable_rows, fanout
        self.memtable: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.tiers: list[list[Run]] = []

    @property
    def runs(self) -> list[Run]:
        return [r for tier in self.tiers for r in tier]

    def put(self, digests: np.ndarray, idents: np.ndarray) -> bool:
        """Whether the memtable is full."""
        self.memtable.append((digests, idents))
        self.held += len(digests)
        return self.held >= self.memtable_rows

    def flushed(self) -> Run:
        """The memtable as a run; it is empty then."""
        digests, idents = (np.concatenate(x) for x in zip(*self.memtable, strict=True))
        self.memtable, self.held = [], 0
        return Run.of(digests, idents, np.ones(len(digests), np.int64))

    def add(self, run: Run) -> None:
        """Take a run in; `fanout` runs of a tier become one of the next."""
        tier = 0
        while True:
            if tier == len(self.tiers):
                self.tiers.append([])
            self.tiers[tier].append(run)
            if len(self.tiers[tier]) < self.fanout:
                return
            run = self._merged(self.tiers[tier])
            self.tiers[tier] = []
            tier += 1

    @staticmethod
    def _merged(runs: list[Run]) -> Run:
        return Run.of(*(np.concatenate([getattr(r, k) for r in runs]) for k in ("digests", "idents", "counts")))

    def repeated(self) -> tuple[Run, np.ndarray]:
        """(digests with more than one row, over all runs; lookups asked, let through by filters, found)."""
        runs, seen = self.runs, np.zeros(3, np.int64)
        out = [Run(r.digests[:0], r.idents[:0], r.counts[:0]) for r in runs[:1]]
        for k, run in enumerate(runs):
            idents, counts, first = run.idents.copy(), run.counts.copy(), np.ones(len(run.digests), bool)
            for j, other in enumerate(runs):
                if j == k:
                    continue
                at, passed = other.find(run.digests)
                hit = at >= 0
                seen += (len(run.digests), passed, int(hit.sum()))
                idents[hit] = np.minimum(idents[hit], other.idents[at[hit]])
                counts[hit] += other.counts[at[hit]]
                if j < k:  # an earlier run tells of it
                    first &= ~hit
            many = first & (counts > 1)
            out.append(Run(run.digests[many], idents[many], counts[many]))
        return self._merged(out) if out else Run(np.zeros(0, "S32"), np.zeros(0, np.int64), np.zeros(0, np.int64)), seen


def _digests(width: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [hashlib.sha256(b).digest()[:width] for _, _, texts in text.parts(batch) for b in pc.ascii_lower(texts).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "digest"])

    return of


_RUN = "bucket long, run int, n int, width int, digests binary, idents binary, counts binary, filter binary"


def _rows(runs: list[tuple[int, int, Run]], filters: bool) -> pa.RecordBatch:
    """Runs as rows: (bucket, number, run)."""
    columns = [
        pa.array([b for b, _, _ in runs], pa.int64()), pa.array([k for _, k, _ in runs], pa.int32()), pa.array([len(r.digests) for _, _, r in runs], pa.int32()),
        pa.array([r.digests.dtype.itemsize for _, _, r in runs], pa.int32()), *(pa.array([getattr(r, c).tobytes() for _, _, r in runs], pa.binary()) for c in ("digests", "idents", "counts")),
        pa.array([r.filter().packed() if filters else None for _, _, r in runs], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _RUN.split(", ")])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, Run]]:
    """(bucket, run) of each row."""
    for bucket, _, n, width, digests, idents, counts, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        run = Run(np.frombuffer(digests, f"S{width}", n), np.frombuffer(idents, np.int64, n), np.frombuffer(counts, np.int64, n))
        run.bloom = Bloom(bits=bits) if bits is not None else None
        yield bucket, run


def _flushed(buckets: int):
    """Runs of full memtables, cut into buckets."""

    def cut(run: Run) -> pa.RecordBatch:
        bucket = (prefixes(run.digests)[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        return _rows([(int(bucket[a]), 0, Run(run.digests[a:z], run.idents[a:z], run.counts[a:z])) for a, z in zip(edges, edges[1:], strict=False)], False)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lsm = DigestLsm()
        for batch in batches:
            if batch.num_rows:
                digests = batch.column(0).to_pylist()
                if lsm.put(np.array(digests, f"S{len(digests[0])}"), batch.column(1).to_numpy(zero_copy_only=False)):
                    yield cut(lsm.flushed())
        if lsm.held:
            yield cut(lsm.flushed())

    return of


def _by_bucket(batches: Iterator[pa.RecordBatch], fanout: int) -> Iterator[tuple[int, DigestLsm]]:
    """The index of each bucket, from rows sorted by bucket."""
    last, lsm = None, DigestLsm(fanout=fanout)
    for batch in batches:
        for bucket, run in _runs(batch):
            if bucket != last and last is not None:
                yield last, lsm
                lsm = DigestLsm(fanout=fanout)
            last = bucket
            lsm.add(run)
    if last is not None:
        yield last, lsm


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, lsm in _by_bucket(batches, FANOUT):
        yield _rows([(bucket, k, run) for k, run in enumerate(lsm.runs)], True)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, ident, n of hits; and a row without a digest that counts a bucket's lookups."""
    for _, lsm in _by_bucket(batches, 1 << 30):
        hits, seen = lsm.repeated()
        width = hits.digests.dtype.itemsize
        raw = [hits.digests.tobytes()[i : i + width] for i in range(0, width * len(hits.digests), width)]
        counts = [pa.array([None] * len(raw) + [int(x)], pa.int64()) for x in seen]
        yield pa.RecordBatch.from_arrays([pa.array([*raw, None], pa.binary()), pa.array([*hits.idents, None], pa.int64()), pa.array([*hits.counts, None], pa.int64()), *counts], ["digest", "ident", "n", "asked", "passed", "found"])


def index(digests: DataFrame, total: int) -> DataFrame:
    """The runs of each bucket with their filters, in the shared folder. digests has digest and ident."""
    buckets = max(1, -(-total // BUCKET_ROWS))
    runs = digests.select("digest", "ident").mapInArrow(_flushed(buckets), _RUN)
    runs = runs.repartition(min(buckets, 20_000), "bucket").sortWithinPartitions("bucket").mapInArrow(_compacted, _RUN)
    return scratch.written(runs, "digest-runs")


def lookups(runs: DataFrame, buckets: int) -> DataFrame:
    """digest, ident, n of the digests with more than one row; rows without a digest count lookups (asked, passed, found)."""
    dealt = runs.repartition(min(buckets, 20_000), "bucket").sortWithinPartitions("bucket", "run")
    return scratch.written(dealt.mapInArrow(_looked_up, "digest binary, ident long, n long, asked long, passed long, found long"), "digest-hits")


def normalised(column: str | Column = "text") -> Column:
    """The text with A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), UPPER, LOWER)


def exact_groups(docs: DataFrame, keep: str = "largest", digest_bytes: int = 32, counts: dict | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row for each row of docs.

    keep is "largest" or "smallest" (doc_id). digest_bytes below 32 shortens the
    digest, which tests use to force collisions. counts, if given, gets the
    numbers of lookups: asked of runs, let through by filters, found.
    """
    spark, start = docs.sparkSession, scratch.mark()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digests = scratch.written(docs.mapInArrow(_digests(digest_bytes), "doc_id long, digest binary"), "digests")
    total = digests.count()
    flip = F.bitwise_not if keep == "largest" else lambda c: c
    ident = F.coalesce(flip(F.col("doc_id")), F.lit(_LAST))
    found = lookups(index(digests.withColumn("ident", ident), total), max(1, -(-total // BUCKET_ROWS)))
    if counts is not None:
        counts |= found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("asked", "passed", "found"))).first().asDict()
    hits = found.where("digest IS NOT NULL").select("digest", F.col("n").alias("group_size"), flip(F.when(F.col("ident") != _LAST, F.col("ident"))).alias("keep_id"))

    differing = scratch.written(_differing(docs, join_counted(digests, hits, "digest", "group_size", total)), "digests-differing")
    alone = F.col("group_size").isNull()
    found = left_counted(digests, hits, "digest", "group_size", total)
    found = found.select("digest", "doc_id", F.coalesce("group_size", F.lit(1)).alias("group_size"), F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"))
    if not differing.isEmpty():
        whole = found.join(differing, "digest", "left_anti")
        texts = docs.withColumn("text", normalised()).withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, digest_bytes)).join(differing, "digest", "left_semi")
        best = F.max if keep == "largest" else F.min
        parts = texts.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
        split = texts.join(parts, ["digest", "text"]).select("digest", "doc_id", "group_size", "keep_id")
        found = whole.unionByName(split)
    scratch.clear(spark, start, keep=("digests", "digest-hits", "digests-differing"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def _differing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Digests under which some hit's bytes differ from those of the row that stays.

    The texts of hits, and of no other rows, are kept after one join by doc_id,
    which is a merge join at every size. A large group's kept text is repeated
    for each of its salted shares, so that no task gets a whole group.
    """
    multi = found.where("group_size > 1 AND keep_id IS NOT NULL AND doc_id IS NOT NULL").withColumn("shares", F.ceil(F.col("group_size") / SALT_ROWS).cast("int"))
    hits = multi.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int")).select("doc_id", "digest", "keep_id", "share", "shares").distinct()
    texts = scratch.written(docs.join(hits.hint("merge"), "doc_id").select("doc_id", "digest", "keep_id", "share", "shares", normalised().alias("text")), "digest-texts")
    kept = texts.where("doc_id = keep_id").select("digest", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("text").alias("kept_text"))
    return texts.where("doc_id != keep_id").join(kept, ["digest", "share"]).where("text != kept_text").select("digest").distinct()


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of equal texts the one with the largest doc_id; all columns.

    Rows that repeat a kept doc_id and its text stay too; they are one document.
    """
    kept = exact_groups(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"]), "left_semi")
