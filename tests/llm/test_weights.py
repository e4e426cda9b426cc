"""Target weights over more slots than one period."""

import heapq
from collections import Counter

import pytest

from lakespan.llm import mixing


def test_deviation_from_the_given_weights(spark):
    given = {f"s{i:02}": 1.0 + i / 7 for i in range(20)} | {"hot": 9.3}
    total = sum(given.values())
    rows = [(i, s) for s, w in given.items() for i in range(int(w / total * 12000))]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    out = mixing.scheduled(docs, spark.createDataFrame(list(given.items()), "source string, weight double"), block_rows=4).collect()
    assert len(out) == len(rows) and all(r.release <= r.slot < r.deadline for r in out)
    at = {r.slot: r.source for r in out}
    ends = min(max(r.slot for r in out if r.source == s) for s in given)
    assert ends > 2500
    seen = Counter()
    for t in range(ends):
        seen[at[t]] += 1
        assert all(abs(seen[s] - w / total * (t + 1)) < 1 + 1e-9 for s, w in given.items())


def _placed(blocks, weights, total):
    """(source, block, release, deadline, slot), earliest deadline first, a heap step each."""
    nth, ready, t = [0] * len(blocks), [], 0
    waiting = [(0, j) for j, n in enumerate(blocks) if n]
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            release, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(nth[j] + 1) * total // weights[j]), j, release))
        due, j, release = heapq.heappop(ready)
        yield j, nth[j], release, due, t
        nth[j] += 1
        if nth[j] < blocks[j]:
            heapq.heappush(waiting, (nth[j] * total // weights[j], j))
        t += 1


@pytest.mark.parametrize("sources", [1, 7, 150])
def test_fold_against_a_walk(spark, sources):
    weights = mixing.whole([1.0 + (k * k % 17) / 3 for k in range(sources)])
    blocks = [(k * 7) % 13 for k in range(sources)] if sources > 1 else [9]
    names = [f"s{k:04}" for k in range(sources)]
    got = sorted((names.index(r.source), r.block, r.release, r.deadline, r.slot) for r in mixing.slots(spark, names, blocks, weights, steps=100).collect())
    assert got == sorted(_placed(blocks, weights, sum(weights)))
    assert all(r <= t < d for _, _, r, d, t in got)


def test_weights_become_whole():
    assert mixing.whole([0.5, 1.5, 2.0]) == [1, 3, 4]
    odd = mixing.whole([0.1, 1e-15, 3.3])
    assert min(odd) == 1 and abs(odd[0] / sum(odd) - 0.1 / 3.4) < 1e-11


def test_blocks_grow_when_there_would_be_too_many(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    docs = spark.createDataFrame([(k if k % 9 else None, f"s{k % 3}" if k % 4 else "hot") for k in range(3000)], "doc_id long, source string")
    out = mixing.scheduled(docs).collect()
    assert len(out) == 3000 and len({(r.slot, r.place) for r in out}) == 3000 and len({r.slot for r in out}) <= 54


def test_blocks_are_as_large_however_many_rows_there_are(spark, monkeypatch):
    asked = []

    def stop(_, names, blocks, weights):
        asked.extend(blocks)
        raise StopIteration

    monkeypatch.setattr(mixing, "slots", stop)
    with pytest.raises(StopIteration):
        mixing.scheduled(spark.range(5_000_000).selectExpr("id AS doc_id", "'s' AS source"))
    assert asked == [5_000_000 // mixing.BLOCK_ROWS]


def test_plan_of_the_slots_does_not_grow_with_its_rounds(spark):
    out = mixing.slots(spark, ["a", "b"], [20, 30], [1, 2], steps=5)
    assert out.count() == 50 and "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
