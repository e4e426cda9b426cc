"""Near duplicates: fast similarity sketches, banding and exact verification.

A document's set holds its distinct five-word shingles (A-Z lower-cased). The
sketch of t coordinates is filled in rounds: in round i < t each element falls
into a hashed coordinate with the value (i, hash), and a coordinate keeps its
least value; round t + j puts every element into coordinate j. So each
coordinate is full after at most 2t rounds, and after one round for large sets,
and the share of equal coordinates of two sketches concentrates around the
Jaccard similarity. With 32 bands of four coordinates a pair at similarity 0.75
shares no band with probability below 6e-6.

Equal sets are first merged into classes, so a large group of copies is one row
from there on. In each band bucket, members are verified against a leader; only
pairs that are still in different components are verified after that, so a group
of near copies costs a few pairs for each member and still no link between
different components is lost. Of a bucket that holds several components then,
only the members outside its most frequent one are held against the others, by
classes of like size, and in large buckets only those that can still be similar
by what is known of their intersections. Verification intersects the full sets.

Empty texts, null texts and texts without words have an empty set and link to
nothing; very long texts are taken whole. Of rows that share a doc_id with
different texts the text with the least hash is compared; all of them get its
component. Rows with a null doc_id link to nothing: they are kept, with a null
component_id, though their text may have copies. An empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import text
from .components import extended
from .skew import join_counted

SHINGLE, COORDINATES, BANDS = 5, 128, 32
#: Members of a bucket whose pairs are listed at once; larger buckets are thinned first, exactly.
SMALL_BUCKET = 16
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, offsets); a shorter text is one shingle."""
    words, offsets = text.word_hashes(pc.ascii_lower(texts))
    n = np.diff(offsets)
    starts = text.inside(offsets, size)
    found, doc = text.window_hashes(words, size)[starts] if len(starts) else np.zeros(0, np.uint64), text.owner(offsets)[starts]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            found = np.concatenate((found, text.window_hashes(words, k, seed=k)[offsets[short]]))
            doc = np.concatenate((doc, short))
    order = np.argsort(found)
    order = order[np.argsort(doc[order], kind="stable")]
    found, doc = found[order], doc[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[keep], doc[keep]
    return found, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(n)))))


def sketches(elements: np.ndarray, offsets: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The sketch of each set, one row of t values; rows of empty sets stay unfilled."""
    out = np.full((len(offsets) - 1, t), _FULL)
    flat, doc = out.reshape(-1), text.owner(offsets)
    for i in range(2 * t):
        x = text.mix(elements, i + 1)
        at = (x >> np.uint64(56)) % np.uint64(t) if i < t else np.uint64(i - t)
        value = (np.uint64(i) << np.uint64(56)) | (x & np.uint64((1 << 56) - 1))
        np.minimum.at(flat, doc * t + at.astype(np.int64), value)
        open_ = (out == _FULL).any(axis=1)[doc]
        if not open_.any():
            break
        elements, doc = elements[open_], doc[open_]
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, z, texts in text.parts(batch):
            elements, offsets = shingle_sets(texts)
            sketch = sketches(elements, offsets).reshape(z - a, BANDS, -1)
            bands = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (z - a, BANDS)).copy()
            for k in range(sketch.shape[2]):
                bands = text.mix(bands ^ sketch[:, :, k], k + 1)
            digests = [hashlib.blake2b(elements[i:k].tobytes(), digest_size=16).digest() for i, k in zip(offsets, offsets[1:], strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (z - a) + 1, BANDS), pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), batch.column(2).slice(a, z - a), pa.array(np.diff(offsets)), pa.array(digests, pa.binary()), lists], ["doc_id", "hash", "n_shingles", "digest", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, z, texts in text.parts(batch):
            elements, offsets = shingle_sets(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), lists], ["rep", "elements"])


def _near(a: str | Column, b: str | Column, percent: int) -> Column:
    """The sizes alone allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def near_groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; links are at least `percent` similar."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("hash"))
    signed = scratch.written(docs.mapInArrow(_signatures, "doc_id long, hash long, n_shingles long, digest binary, bands array<long>"), "signatures")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    mains = scratch.written(full.groupBy("doc_id").agg(F.min(F.struct("hash", "digest")).alias("m"), F.max("hash").alias("last"), F.count(F.lit(1)).alias("rows")).select("doc_id", "m.hash", "m.digest", "last", "rows"), "mains")
    reps = mains.groupBy("digest").agg(F.min(F.struct("doc_id", "hash")).alias("r"), F.sum("rows").alias("rows")).select("digest", F.col("r.doc_id").alias("rep"), "r.hash", "rows")
    classes = scratch.written(reps, "classes")
    reps = classes.select("digest", "rep", "rows")
    wanted = classes.select(F.col("rep").alias("doc_id"), F.col("hash").alias("own"))
    # joined by doc_id alone, so that rows that repeat it lie together already
    buckets = full.join(wanted, "doc_id").where("hash = own").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = scratch.written(buckets.join(shared, "bucket"), "shared-buckets")
    degrees = buckets.groupBy("rep").agg(F.sum("members").alias("degree"))
    buckets = scratch.written(buckets.drop("members").join(degrees, "rep"), "buckets")

    wanted = wanted.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = scratch.written(docs.join(wanted.hint("merge"), "doc_id").where("hash = own").dropDuplicates(["doc_id"]).select("doc_id", "text").mapInArrow(_sets, "rep long, elements array<long>"), "sets")
    leaders = scratch.written(_leaders(buckets, percent), "leaders")
    tried = comps = pivots = None
    for step in ("first", "mixed", "rest"):
        pairs = _ordered(leaders) if step == "first" else _pairs(buckets, comps, sets, pivots, step, percent)
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        found = scratch.written(_verified(pairs, sets, percent), "verified")
        if tried is None:
            chosen = leaders.select("rep", "leader", F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b"))
            pivots = chosen.join(found, ["a", "b"]).select("rep", F.col("leader").alias("pivot"), "common")
        tried = found if tried is None else tried.unionByName(found)
        comps = extended(comps, found.where("linked").select("a", "b"))

    by_digest = reps.join(comps, F.col("rep") == F.col("node"), "left").select("digest", "rows", F.coalesce("component", "rep").alias("component"))
    by_digest = scratch.written(by_digest, "class-components")
    # rows of a doc_id with several texts stand where its compared text does
    several = scratch.written(mains.where("hash != last").select("doc_id", F.col("digest").alias("main")), "several")
    rows = full.select("doc_id", "n_shingles", "digest").join(several, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("main", "digest").alias("digest"))
    out = join_counted(rows, by_digest, "digest", "rows", signed.count()).select("doc_id", "n_shingles", "component")
    out = out.unionByName(signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    component = F.col("component")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _split(buckets: DataFrame) -> DataFrame:
    """The buckets that hold different components."""
    split = buckets.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members")).where("x != y")
    return buckets.join(split.select("bucket", "members"), "bucket")


def _bounded(buckets: DataFrame, sets: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Members that may be similar to another, with what bounds their intersections.

    shared: shingles that some other member has too. pivot, inside: a document
    that the member was compared with, and the shared shingles inside that
    document; the other shared shingles lie outside of it. A pivot's own shared
    shingles are all inside. buckets: where the member is, a few dozen at most.
    """
    reps = buckets.groupBy("rep", "n", "component").agg(F.collect_list("bucket").alias("buckets")).join(pivots, "rep", "left")
    counted = reps.select("rep").unionByName(reps.where("pivot IS NOT NULL").select(F.col("pivot").alias("rep"))).distinct()
    single = sets.join(counted, "rep").select("rep", F.explode("elements").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("rep")).where("c = 1")
    alone = single.groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
    shared = F.col("n") - F.coalesce("own", F.lit(0))
    able = reps.join(alone, "rep", "left").withColumn("shared", shared).where(F.col("shared") * 100 >= F.col("n") * percent)
    return able.select("rep", "n", "component", "buckets", "shared", F.coalesce("pivot", "rep").alias("pivot"), F.coalesce("common", "shared").alias("inside"), F.explode("buckets").alias("key"))


def _cross(members: DataFrame, able: Column, percent: int) -> DataFrame:
    """Pairs a < b of members that share a key, of like size and in different components, for which able (over columns numbered 1 and 2) holds.

    The members of a key's most frequent component are not held against each
    other: one side has only those of other components. Sizes are joined by class.
    """
    width = math.log(max(100 / percent, 1.01)) * 1.0001
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("key", F.col("top.component").alias("main"))
    rows = members.join(main, "key").withColumn("size", F.floor(F.log("n") / width).cast("int"))
    names = [c for c in members.columns if c != "key"]
    left = rows.select("key", "size", (F.col("component") == F.col("main")).alias("of_main"), *(F.col(c).alias(f"{c}1") for c in names))
    right = rows.where("component != main").select("key", F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1)).alias("size"), *(F.col(c).alias(f"{c}2") for c in names))
    met = left.join(right, ["key", "size"]).where((F.col("of_main") | (F.col("rep1") < F.col("rep2"))) & (F.col("component1") != F.col("component2")) & able)
    return met.select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")).distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    """a < b of pairs (rep, leader)."""
    return pairs.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()


def _met(buckets: DataFrame, order: Column, percent: int) -> DataFrame:
    """rep, leader, votes: in how many buckets a member meets a leader (first in order) of like size in another component."""
    one = F.min(F.struct(order.alias("o"), "rep", "n", "component")).alias("l")
    leaders = buckets.groupBy("bucket").agg(one).select("bucket", F.col("l.rep").alias("leader"), F.col("l.n").alias("m"), F.col("l.component").alias("other"))
    met = buckets.join(leaders, "bucket").where((F.col("rep") != F.col("leader")) & (F.col("component") != F.col("other")) & _near(F.col("n"), F.col("m"), percent))
    return met.groupBy("rep", "leader").agg(F.count(F.lit(1)).alias("votes"))


def _leaders(buckets: DataFrame, percent: int) -> DataFrame:
    """rep, leader: the leader that each member meets in most buckets.

    A bucket is led by the member with most company over all its buckets: of a
    group of near copies that is the text that they were made from, if any, so
    one comparison settles most members and bounds the others well.
    """
    met = _met(buckets.withColumn("component", F.col("rep")), F.struct(-F.col("degree"), F.col("rep")), percent)
    return met.groupBy("rep").agg(F.max(F.struct("votes", (-F.col("leader")).alias("o"), "leader")).alias("best")).select("rep", "best.leader")


def _pairs(buckets: DataFrame, comps: DataFrame, sets: DataFrame, pivots: DataFrame, step: str, percent: int) -> DataFrame:
    """Candidate pairs a < b that the step verifies.

    mixed: members with leaders of another order, where components still differ;
    rest: pairs of a bucket that are in different components; in large buckets,
    those of them that can still be similar by what is known of their
    intersections with the rest and with their pivots.
    """
    comps = comps.withColumnsRenamed({"node": "rep"})
    buckets = _split(buckets.drop("degree").join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    if step == "mixed":
        return _ordered(_met(buckets, F.xxhash64("rep"), percent))
    buckets = scratch.written(buckets, "split-buckets")
    near = _near(F.col("n1"), F.col("n2"), percent)
    small = _cross(buckets.where(F.col("members") <= SMALL_BUCKET).select("rep", "n", "component", F.col("bucket").alias("key")), near, percent)
    able = scratch.written(_bounded(buckets.where(F.col("members") > SMALL_BUCKET), sets, pivots, percent), "large-buckets")
    outside = F.least(F.col("shared1") - F.col("inside1"), F.col("shared2") - F.col("inside2"))
    most = F.least("shared1", "shared2", F.when(F.col("pivot1") == F.col("pivot2"), F.least("inside1", "inside2") + outside))
    # a pair that meets in several buckets is listed in the least of them only
    once = F.array_min(F.array_intersect("buckets1", "buckets2")) == F.col("key")
    large = _cross(able, near & (most * 100 >= (F.col("n1") + F.col("n2") - most) * percent) & once, percent)
    return small.unionByName(large).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, common, linked: the sizes of the intersections of the full sets, and whether they suffice."""
    one = pairs.join(sets.select(F.col("rep").alias("b"), F.col("elements").alias("eb")), "b")
    two = one.join(sets.select(F.col("rep").alias("a"), F.col("elements").alias("ea")), "a")
    both = two.select("a", "b", F.size(F.array_intersect("ea", "eb")).cast("long").alias("common"), (F.size("ea") + F.size("eb")).cast("long").alias("sizes"))
    return both.select("a", "b", "common", (F.col("common") * 100 >= (F.col("sizes") - F.col("common")) * percent).alias("linked"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the document with the smallest doc_id; all columns."""
    kept = near_groups(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"]), "left_semi")
