"""The registered queries against their SQL on the smallest tables, and the pipeline's stages on odd tables."""

import glob
import os
import pathlib

import duckdb
import pandas as pd
import pytest

from lakespan.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {pathlib.Path(path).stem} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    return (int(v) if v == int(v) else round(v, 9)) if isinstance(v, float) else v


def _rows(frame):
    return sorted(repr(tuple(_plain(v) for v in r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, DIR).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert _rows(got) == _rows(want)


def test_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    words = " ".join(f"w{k}" for k in range(40)) + "."
    rows = [(1, words, "en", "a", 1), (1, words, "en", "a", 1), (2, words.upper(), None, None, None), (3, None, "en", "b", 0), (4, "", "en", "b", 0), (None, words, "en", "a", 1), (5, "word " * 20_000, "en", "c", 9), (6, words + " end", "en", "a", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "component string, kept string, row string, hash string, digest string, slot string, bucket string"
    wide = spark.createDataFrame([(*r, *"abcdefg") for r in rows], f"{schema}, {extra}")
    spark.createDataFrame([(1, 1, 0), (6, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (wide, wide.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            got = out.collect()
            if name != "BPE encoding and decoding":
                assert out.columns == docs.columns
            assert len(got) <= docs.count()
        if name == "exact dedup":
            # of the equal texts, in any case, the row with the largest id stays; a null id is the last choice
            assert sorted(str(r.doc_id) for r in stage(spark, wide, str(tmp_path)).collect()) == ["2", "4", "5", "6"]
        if name == "MinHash near-dedup":
            assert sorted(str(r.doc_id) for r in stage(spark, wide, str(tmp_path)).collect()) == ["1", "1", "3", "4", "5", "None"]
        if name in ("mixing sources", "BPE encoding and decoding"):
            assert stage(spark, wide, str(tmp_path)).count() == len(rows)


def test_substring_hot_phrase_and_no_candidates(spark):
    from lakespan.llm import substring_dedup

    phrase = "one two three four five six seven eight"
    rows = [(i, " ".join(f"a{i}x{k}" for k in range(15)) + f" {phrase} " + " ".join(f"b{i}x{k}" for k in range(15))) for i in range(300)]
    out = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(out) == 300 and all(r.n_removed == 0 and r.n_words == 38 for r in out)
    long = [(i, rows[i][1] + " " + " ".join(f"c{k}" for k in range(25))) for i in range(300)]
    out = substring_dedup.without_repeats(spark.createDataFrame(long, "doc_id long, text string").repartition(6)).collect()
    assert {r.doc_id: r.n_removed for r in out} == {i: 0 if i == 0 else 25 for i in range(300)}
