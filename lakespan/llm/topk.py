"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components are floor(1024 x). Rows are dealt to clusters (centres fitted on a
bounded sample; every row is indexed) and packed in blocks of about BLOCK rows.
A block's index has a posting list for each dimension and sign: row numbers by
descending impact, the magnitude without its lowest bits. A query reads, in
steps, all postings whose impact times its own component reaches a falling
level, and adds them to the rows' partial scores. By Cauchy-Schwarz the unread
part of a score is at most the norm of what is unread of the row times the norm
of the query over the dimensions unread there, and the cut-off bits at most
their norm times the query's. Rows whose upper bound is below a proven threshold
(the k-th best lower bound of the block, or the k-th best score already found)
cannot belong. Reading stops on that proof, when the rows left cost less to
rescore than the postings left cost to read; they are rescored exactly.

A query meets one block of its own cluster first, which gives it a threshold.
Then it is held against the centres and radii of all blocks, and only blocks
that may hold a better row are searched. In a search a block is read once, and
the groups of queries that survived pass by it.

Vectors that are null or hold a null, NaN or infinite component take no part;
missing components of a shorter vector count as zero. A query's own rows, by
vec_id, are no candidates; of rows that share a query's vec_id the one with the
smallest vector asks. Null vec_ids take no part. Repeated rows each count as
candidates. An empty table gives no rows; other columns are ignored. Integer
scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

#: Rows of a block, queries of a group, groups that pass by one copy of a block, and block summaries of a group.
BLOCK, QUERIES, GROUPS, SUMMARIES = 8192, 256, 64, 1024
#: Dropped low bits at least, levels of impact at most, and by what the level of a step falls.
QUANT, LEVELS, STEP = 2, 1023, 0.7
#: Clusters at most, and what their centres are fitted on: rows, and components over all rows.
CLUSTERS, FIT_ROWS, FIT_COMPONENTS = 64, 4096, 1 << 21
MOST_TASKS = 20_000
#: Float sums are off by far less than this share of the norms' product.
_MARGIN = 1e-9


def integers(vector: str = "embedding") -> Column:
    """floor(1024 x) of each component as double; null if any is null or not finite."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * 1024).cast("long")))


def _lists(lists: pa.Array, wide: int) -> np.ndarray:
    """The lists as rows of a matrix, shorter ones filled up with zeros."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), wide), values.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


def _matrix(rows: pa.Array, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, integer matrix) of a list of (vec_id, x)."""
    return rows.field(0).to_numpy(zero_copy_only=False), _lists(rows.field(1), wide)


class ImpactIndex:
    """Posting lists of a block: for each dimension and sign, rows by descending impact."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        size = np.abs(self.values)
        self.shift = max(QUANT, int(size.max(initial=0)).bit_length() - LEVELS.bit_length())
        impact = size >> self.shift
        row, dim = np.nonzero(impact)
        own = impact[row, dim]
        lists = 2 * dim + (self.values[row, dim] < 0)
        self.row_count, self.list_count = len(self.ids), 2 * values.shape[1]
        order = np.lexsort((row, -own, lists))
        self.rows, self.impacts = row[order], own[order]
        # at_least[list, m]: where the postings with impact m or more end
        counts = np.zeros((self.list_count, LEVELS + 2), np.int64)
        np.add.at(counts, (lists, own), 1)
        held = counts.sum(axis=1)
        self.begin = np.cumsum(held) - held
        self.at_least = self.begin[:, None] + np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        whole = (impact << self.shift).astype(float)
        self.norm2 = (whole * whole).sum(axis=1)
        self.rest = np.sqrt(((size - whole) ** 2).sum(axis=1))
        self.read = self.total = self.rescored = 0

    def search(self, query: np.ndarray, own: int, k: int, known: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, exact scores) of the best k rows of those that reach `known`, a proven threshold."""
        may = np.flatnonzero(self.ids != own)
        if len(may) > 2 * k:
            may = self._possible(query.astype(float), may, k, known)
        self.rescored += len(may)
        score = self.values[may] @ query
        stays = score >= known
        may, score = may[stays], score[stays]
        # ids ascend, so a stable order by score takes the smaller id of a tie
        best = np.argsort(-score, kind="stable")[:k]
        return self.ids[may[best]], score[best]

    def _possible(self, q: np.ndarray, may: np.ndarray, k: int, known: float) -> np.ndarray:
        """Rows that are not proven to be outside."""
        size, norm = np.abs(q), float(np.sqrt((q * q).sum()))
        # list 2 d has the positive values of dimension d, list 2 d + 1 the negative ones
        signed, both = np.stack((q, -q), axis=1).reshape(-1), np.repeat(size, 2)
        partial, read_x, read_q = (np.zeros(self.row_count) for _ in range(3))
        slack = norm * (self.rest + _MARGIN * np.sqrt(self.norm2)) + 1e-6
        unit, at = float(1 << self.shift), self.begin.copy()
        self.total += len(self.rows)
        level, read = float(both.max(initial=0)) * int(self.impacts.max(initial=1)), 0
        while True:
            least = np.full(self.list_count, LEVELS + 1)
            some = both > 0
            least[some] = np.clip(np.ceil(level / both[some]), 1, LEVELS + 1).astype(np.int64)
            if level < float(both[some].min(initial=np.inf)):
                least[some] = 1
            end = np.maximum(at, self.at_least[np.arange(self.list_count), least])
            sizes = end - at
            if sizes.any():
                which = np.repeat(np.arange(self.list_count), sizes)
                place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(at, sizes)
                rows, impact = self.rows[place], self.impacts[place] * unit
                partial += np.bincount(rows, signed[which] * impact, self.row_count)
                read_x += np.bincount(rows, impact * impact, self.row_count)
                read_q += np.bincount(rows, both[which] ** 2, self.row_count)
                read += len(which)
                self.read += len(which)
                at = end
                unread = np.sqrt(np.maximum(self.norm2 - read_x, 0) * np.maximum(norm * norm - read_q, 0)) + slack
                threshold = max(known, float(np.partition((partial - unread)[may], len(may) - k)[len(may) - k]))
                may = may[(partial + unread)[may] >= threshold]
                # what is left costs less to rescore than to read on
                if len(may) <= k or len(may) * self.list_count // 2 <= len(self.rows) - read:
                    return may
            if (least[some] <= 1).all():
                return may
            level *= STEP


def _searched(k: int, wide: int):
    """Top rows of the groups of queries that pass by each block; a block's rows come before its queries."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            for r in range(batch.num_rows):
                held = batch.column(0)[r]
                if held.is_valid:
                    index = ImpactIndex(*_matrix(held.values, wide))
                    continue
                asked = batch.column(1)[r].values
                own, queries = _matrix(asked, wide)
                known = asked.field(2).to_numpy(zero_copy_only=False)
                found = [index.search(q, o, k, t) for q, o, t in zip(queries, own, known, strict=True)] if index is not None else []
                ids = np.concatenate([np.full(len(f), o) for o, (f, _) in zip(own, found, strict=False)]) if found else np.zeros(0, np.int64)
                ids, vecs, scores = (pa.array(x, pa.int64()) for x in (ids, np.concatenate([f for f, _ in found]) if found else ids, np.concatenate([s for _, s in found]) if found else ids))
                yield pa.RecordBatch.from_arrays([ids, vecs, scores], ["query_id", "vec_id", "score"])

    return of


def _centres(rows: DataFrame, total: int, wide: int) -> np.ndarray:
    """Cluster centres by Lloyd's steps on a sample of bounded size, chosen by a hash of vec_id."""
    number = max(1, min(CLUSTERS, -(-total // BLOCK)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(number, min(FIT_ROWS, FIT_COMPONENTS // max(1, wide)))).select("x").collect()
    data = np.zeros((len(sample), wide))
    for i, r in enumerate(sample):
        data[i, : len(r.x)] = r.x
    if len(data) <= number:
        return data if len(data) else np.zeros((1, wide))
    centres = data[np.random.default_rng(5).permutation(len(data))[:number]]
    for _ in range(8):
        near = _nearest(data, centres)
        for c in range(number):
            if (near == c).any():
                centres[c] = data[near == c].mean(axis=0)
    return centres


def _nearest(data: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * (data @ centres.T), axis=1)


def _clustered(centres: np.ndarray):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _nearest(_lists(batch.column(2), centres.shape[1]).astype(float), centres) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], [*batch.schema.names, "cluster"])

    return of


def _summaries(wide: int):
    """block, centre, radius of each packed block."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                _, values = _matrix(batch.column(1)[r].values, wide)
                centre = values.mean(axis=0)
                radius = float(np.sqrt(((values - centre) ** 2).sum(axis=1).max()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.array([centre], pa.list_(pa.float64())), pa.array([radius])], ["block", "centre", "radius"])

    return of


def _surviving(wide: int):
    """block, asked: of a group of queries, those that a block may hold a better row for; rows are pairs of groups."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                asked, blocks = batch.column(0)[r].values, batch.column(1)[r].values
                home, known = asked.field(3).to_numpy(zero_copy_only=False), asked.field(2).to_numpy(zero_copy_only=False)
                q = _lists(asked.field(1), wide).astype(float)
                numbers, centre, radius = blocks.field(0).to_numpy(zero_copy_only=False), _lists(blocks.field(1), wide), blocks.field(2).to_numpy(zero_copy_only=False)
                norm = np.sqrt((q * q).sum(axis=1))
                most = q @ centre.T + norm[:, None] * radius[None, :] * (1 + _MARGIN)
                most += 1e-6 + _MARGIN * norm[:, None] * np.sqrt((centre * centre).sum(axis=1))[None, :]
                may = (most >= known[:, None]) & (home[:, None] != numbers[None, :])
                for b in np.flatnonzero(may.any(axis=0)):
                    some = asked.take(pa.array(np.flatnonzero(may[:, b])))
                    lists = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
                    yield pa.RecordBatch.from_arrays([pa.array([numbers[b]], pa.int64()), lists], ["block", "asked"])

    return of


_ASKED = "array<struct<vec_id: bigint, x: array<bigint>, known: double, home: bigint>>"


def _pass(blocks: DataFrame, asked: DataFrame, k: int, wide: int, tasks: int) -> DataFrame:
    """query_id, vec_id, score: asked(block, asked) held against blocks(block, rows).

    A block with very many groups is copied once for each GROUPS of them.
    """
    salted = asked.withColumn("salt", F.floor((F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("asked"))) - 1) / GROUPS).cast("int"))
    copies = salted.groupBy("block").agg(F.max("salt").alias("salts"))
    held = blocks.join(copies, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts"))).alias("salt"), "rows", F.lit(None).cast(_ASKED).alias("asked"))
    both = held.unionByName(salted.select("block", "salt", F.lit(None).cast("array<struct<vec_id: bigint, x: array<bigint>>>").alias("rows"), "asked"))
    dealt = both.repartition(tasks, "block", "salt").sortWithinPartitions("block", "salt", F.col("rows").isNull())
    return dealt.select("rows", "asked").mapInArrow(_searched(k, wide), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores, ties to the smaller vec_id. is_query is a condition on vec_id."""
    start = scratch.mark()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers().alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    total, wide = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    wide = max(1, wide)
    centres = _centres(rows, total, wide)
    rows = scratch.written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x").mapInArrow(_clustered(centres), "row long, vec_id long, x array<long>, cluster int"), "vectors")
    sizes = {r.cluster: r["count"] for r in rows.groupBy("cluster").count().collect()}
    shares = F.coalesce(F.create_map(*(F.lit(v) for c, n in (sizes or {0: 1}).items() for v in (c, -(-n // BLOCK))))[F.col("cluster")], F.lit(1))
    block = F.col("cluster") + F.pmod(F.xxhash64("row"), shares) * len(centres)
    blocks = scratch.written(rows.groupBy(block.alias("block")).agg(F.collect_list(F.struct("vec_id", "x")).alias("rows")), "vector-blocks")

    asks = scratch.written(rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("x", "cluster")).alias("q")).select("vec_id", "q.x", "q.cluster"), "vector-queries")
    groups = max(1, -(-asks.count() // QUERIES))

    def packed(queries: DataFrame) -> DataFrame:
        """Groups of queries of like clusters."""
        part = F.pmod(F.xxhash64("vec_id"), F.lit(groups))
        return queries.groupBy("home", part.alias("part")).agg(F.collect_list(F.struct("vec_id", "x", "known", "home")).alias("asked"))

    tasks = max(1, min(MOST_TASKS, sum(-(-n // BLOCK) for n in sizes.values()) * 2))
    home = F.col("cluster").cast("long").alias("home")
    first = packed(asks.select("vec_id", "x", F.lit(float("-inf")).alias("known"), home)).select(F.col("home").alias("block"), "asked")
    one = scratch.written(_pass(blocks, first, k, wide, tasks), "vector-firsts")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    known = one.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("known"))
    second = packed(asks.join(known, "vec_id", "left").select("vec_id", "x", F.coalesce("known", F.lit(float("-inf"))).alias("known"), home))

    most = max(1, -(-blocks.count() // SUMMARIES))
    summaries = blocks.mapInArrow(_summaries(wide), "block long, centre array<double>, radius double")
    summaries = summaries.groupBy(F.pmod(F.xxhash64("block"), F.lit(most)).cast("int").alias("g")).agg(F.collect_list(F.struct("block", "centre", "radius")).alias("blocks"))
    met = second.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).join(summaries, "g").select("asked", "blocks")
    able = scratch.written(met.mapInArrow(_surviving(wide), f"block long, asked {_ASKED}"), "vector-pairs")
    found = scratch.written(one.unionByName(_pass(blocks, able, k, wide, tasks)), "vector-found")
    scratch.clear(vectors.sparkSession, start, keep=("vector-found",))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
