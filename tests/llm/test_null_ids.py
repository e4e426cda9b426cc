"""Rows without an id, and weights over long inputs."""

from lakespan.llm import substring_dedup


def test_substring_rows_that_share_an_id(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    longer = " ".join(f"l{k}" for k in range(40)) + " " + passage
    last = passage + " end"
    rows = [(None, passage + " one"), (None, passage + " two"), (None, longer), (None, last), (3, passage + " three"), (3, "other " + passage), (None, "x"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.n_removed) for r in substring_dedup.without_repeats(docs).collect()]
    assert len(got) == len(rows)
    # the passage stays once: in the first of the two rows with id 3
    assert sorted(n for i, n in got if i == 3) == [0, 25]
    assert sorted(n for i, n in got if i is None) == [0, 0, 25, 25, 25, 25]


def test_substring_null_ids_alone(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(None, passage + " one"), (None, passage + " two"), (None, " ".join(f"l{k}" for k in range(300)) + " " + passage)]
    got = sorted(r.n_removed for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert got == [0, 25, 25]
