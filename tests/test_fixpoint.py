"""Components and labels go on until nothing changes."""

import pytest

from lakespan.operators import components, entities


def test_a_chain_of_more_than_thirty_links(spark):
    chain = [(k, k + 1) for k in range(33)]
    nodes, links = spark.createDataFrame([(k,) for k in range(34)], "node long").coalesce(1), spark.createDataFrame(chain, "a long, b long").coalesce(1)
    assert {r.label for r in entities._labels(nodes, links, None).collect()} == {0}
    with pytest.raises(RuntimeError):
        entities._labels(nodes, links, 2)
    with pytest.raises(RuntimeError):
        components.components(links, rounds=1)
