"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's share is its weight over the sum W of all, in whole numbers. Its block
k is released at floor(k / share) and due by ceil((k + 1) / share); in each slot
the released block that is due first is placed (ties: the source first in
order). So after any number of slots t a source has had share t blocks, less or
more than one, as long as no source has run out.

The schedule is a fold over the blocks: its state is the next block of each
source and the slot, STEPS blocks are placed by a row of the fold, and each row
is written to the shared folder and read as the start of the next one. A block
has BLOCK_ROWS rows however many rows there are, so the fold has a step for each
BLOCK_ROWS of them; a caller that sets MOST_BLOCKS gets larger blocks instead.
Rows then meet slots by source and block; a key has the rows of a block at most.

A source's rows are numbered in the order of (share, hash of doc_id, doc_id):
within small hashed shares, whose sizes are added up before in two levels, so
that a source with a third of all rows is never in one task. Every row is
placed; a source that runs out leaves slots empty when no other block is
released. A null source is a source of its own, under the empty name; a null
doc_id is numbered by a hash of its own; repeated rows are placed each; texts are
not read; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import scratch

BLOCK_ROWS, SHARE_ROWS, STEPS = 16, 2000, 4096
#: No bound by default: the schedule must not depend on how many rows there are.
MOST_BLOCKS: int | None = None
#: Shares of a top share, and the largest sum of weights; other weights are rounded to that many units.
TOP, MOST_UNITS = 1024, 1 << 40


def numbered(docs: DataFrame, total: int) -> DataFrame:
    """doc_id, source, number: from 0 within each source."""
    shares = max(1, -(-total // SHARE_ROWS))
    key = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.md5(F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")).cast("binary")))
    # written, as the rows are read twice and an invented key must be the same each time
    rows = scratch.written(docs.select("doc_id", "source", key.alias("h")), "mixing-keys")
    rows = rows.withColumn("share", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % shares)
    sizes = rows.groupBy("source", "share").agg(F.count(F.lit(1)).alias("n")).withColumn("top", F.floor(F.col("share") / TOP))

    def before(key: list[str], order: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    tops = sizes.groupBy("source", "top").agg(F.sum("n").alias("n")).select("source", "top", before(["source"], "top").alias("above"))
    sizes = sizes.withColumn("before", before(["source", "top"], "share")).join(tops, ["source", "top"]).select("source", "share", (F.col("before") + F.col("above")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("source", "share").orderBy("h", "doc_id"))
    return rows.withColumn("inner", inner).join(sizes, ["source", "share"]).select("doc_id", "source", (F.col("before") + F.col("inner") - 1).alias("number"))


def whole(weights: list[float]) -> list[int]:
    """The weights as whole numbers: in exactly the same proportions, or rounded to MOST_UNITS units of at least one each."""
    exact = [Fraction(w) for w in weights]
    unit = math.lcm(*(w.denominator for w in exact))
    if sum(exact) * unit <= MOST_UNITS:
        return [int(w * unit) for w in exact]
    total = sum(exact)
    return [max(1, round(w * MOST_UNITS / total)) for w in exact]


def slots(spark: SparkSession, names: list[str], blocks: list[int], weights: list[int], steps: int = STEPS) -> DataFrame:
    """source, block, release, deadline, slot of each block, earliest deadline first."""
    sources = F.array(*(F.struct(F.lit(s).alias("source"), F.lit(n).cast("long").alias("n"), F.lit(w).cast("long").alias("w")) for s, n, w in zip(names, blocks, weights, strict=True)))
    total = sum(weights)
    state = spark.range(1).select(sources.alias("s"), F.transform(sources, lambda _: F.lit(0).cast("long")).alias("next"), F.lit(0).cast("long").alias("t"))
    given = "array<struct<j: int, block: bigint, release: bigint, deadline: bigint, slot: bigint>>"
    # releases of the next blocks; the slot; the released block that is due first; the state after it
    fold = f"""aggregate(sequence(1, {{count}}), named_struct('next', next, 't', t, 'given', cast(array() AS {given})),
        (st, i) -> transform(array(transform(s, (x, j) -> if(st.next[j] < x.n, st.next[j] * {total}L div x.w, NULL))), r ->
            transform(array(greatest(st.t, array_min(r))), t ->
                transform(array(array_min(transform(s, (x, j) -> if(r[j] <= t, named_struct('due', ((st.next[j] + 1) * {total}L + x.w - 1) div x.w, 'j', j), NULL)))), c ->
                    named_struct('next', transform(st.next, (n, j) -> n + if(j = c.j, 1L, 0L)), 't', t + 1,
                        'given', concat(st.given, array(named_struct('j', c.j, 'block', st.next[c.j], 'release', r[c.j], 'deadline', c.due, 'slot', t)))))[0])[0])[0])"""
    paths, left = [], sum(blocks)
    while left > 0:
        count = min(steps, left)
        row = scratch.written(state.selectExpr("s", f"{fold.format(count=count)} AS st"), "slots")
        paths.append(scratch.mark())
        state, left = row.selectExpr("s", "st.next AS next", "st.t AS t"), left - count
    if not paths:
        return spark.sql("SELECT '' AS source, 0L AS block, 0L AS release, 0L AS deadline, 0L AS slot WHERE false")
    # read as one table, so that the plan does not grow with the rows of the fold
    every = spark.read.schema(row.schema).parquet(*paths)
    return every.selectExpr("s", "inline(st.given)").selectExpr("s[j].source AS source", "block", "release", "deadline", "slot")


def scheduled(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, source, block, release, deadline, slot, place: slot orders the blocks, place the rows of a block.

    weights(source, weight) are the target weights; by default a source's weight
    is 1024 times its number of rows to the given power, cut to a whole number,
    which lifts small sources. A source with rows needs a weight above 0. Weights
    that are no whole numbers of a sum up to 2**40 are rounded to 2**-40 of the sum.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    counts = own.groupBy("source").agg(F.count(F.lit(1)).alias("rows")).withColumn("weight", F.floor(F.pow(F.col("rows").cast("double"), F.lit(power)) * 1024))
    rows = {r["source"]: (r["rows"], r["weight"]) for r in counts.collect()}
    total = sum(n for n, _ in rows.values())
    given = {s: w for s, (_, w) in rows.items()}
    if weights is not None:
        given = {r[0] or "": r[1] for r in weights.select(F.col("source").cast("string"), F.col("weight").cast("double")).collect()}
    bad = sorted(s for s in rows if not 0 < (given.get(s) or 0) < math.inf)
    if bad:
        raise ValueError(f"sources without a weight above 0: {bad[:10]}")
    given = {s: w for s, w in given.items() if w and 0 < w < math.inf}
    names = sorted(given)
    size = max(block_rows, -(-total // MOST_BLOCKS)) if MOST_BLOCKS else block_rows
    blocks = [-(-rows[s][0] // size) if s in rows else 0 for s in names]
    placed = slots(spark, names, blocks, whole([given[s] for s in names]))
    numbers = numbered(own, total).withColumn("block", F.expr(f"number div {size}"))
    return numbers.join(placed, ["source", "block"]).selectExpr("doc_id", "source", "block", "release", "deadline", "slot", f"cast(number % {size} AS int) AS place")


def mixed(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """All rows and columns of docs, in files ordered by slot.

    Rows that share a doc_id and source are placed each; the schedule is joined by both.
    """
    plan = scheduled(docs, weights).groupBy("doc_id", "source").agg(F.min(F.struct("slot", "place")).alias("at"))
    own = F.coalesce(docs["source"].cast("string"), F.lit(""))
    joined = docs.join(plan, docs["doc_id"].cast("long").eqNullSafe(plan["doc_id"]) & (own == plan["source"]))
    return joined.repartitionByRange(plan["at"]).sortWithinPartitions(plan["at"]).select(*(docs[c] for c in docs.columns))


#: The same schedule, a row of a recursion for each block, for DuckDB; for as many rows as blocks of BLOCK_ROWS hold.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
s AS MATERIALIZED (SELECT source, count(*) AS rows, CAST(floor(sqrt(CAST(count(*) AS DOUBLE)) * 1024) AS BIGINT) AS w, CAST(ceil(count(*) / {BLOCK_ROWS}) AS BIGINT) AS n FROM d GROUP BY source),
a AS MATERIALIZED (SELECT list(source ORDER BY source) AS names, list(n ORDER BY source) AS n, list(w ORDER BY source) AS w, CAST(sum(w) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS blocks FROM s),
f AS (
  SELECT CAST(0 AS BIGINT) AS i, list_transform(n, lambda x: CAST(0 AS BIGINT)) AS nxt, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS release, CAST(0 AS BIGINT) AS deadline FROM a
  UNION ALL
  SELECT i + 1, list_transform(nxt, lambda x, k: x + CASE WHEN k = c.j THEN 1 ELSE 0 END), pos + 1, c.j, nxt[c.j], r[c.j], c.due FROM (
    SELECT *, list_min(list_filter(list_transform(range(1, len(n) + 1), lambda k: CASE WHEN r[k] <= pos THEN {{'due': ((nxt[k] + 1) * total + w[k] - 1) // w[k], 'j': k}} END), lambda x: x IS NOT NULL)) AS c FROM (
      SELECT *, greatest(t, list_min(list_filter(r, lambda x: x IS NOT NULL))) AS pos FROM (
        SELECT f.i, f.nxt, f.t, a.n, a.w, a.total, list_transform(range(1, len(a.n) + 1), lambda k: CASE WHEN f.nxt[k] < a.n[k] THEN f.nxt[k] * a.total // a.w[k] END) AS r FROM f, a WHERE f.i < a.blocks)))),
placed AS (SELECT names[j] AS source, block, release, deadline, t - 1 AS slot FROM f, a WHERE i > 0),
p AS (SELECT greatest(1, CAST(ceil(count(*) / {SHARE_ROWS}) AS BIGINT)) AS shares FROM d),
numbers AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY CAST('0x' || h[1:8] AS BIGINT) % shares, h, doc_id) - 1 AS number FROM d, p)
SELECT doc_id, source, number // {BLOCK_ROWS} AS block, release, deadline, slot, CAST(number % {BLOCK_ROWS} AS INTEGER) AS place
FROM (SELECT *, number // {BLOCK_ROWS} AS block FROM numbers) JOIN placed USING (source, block)
"""
