"""Checks, normalisers, similarity and search rules on invented vectors."""

import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from lakespan.functions import checks, normalize, similarity
from lakespan.functions.spans import spans
from lakespan.operators import detect, search


def _map(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", column(F.col("v")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (checks.luhn, ["4111111111111111", "4111 1111-1111 1111", "378282246310005"], ["4111111111111112", "411111111111", "0" * 20]),
        (checks.card_prefix, ["4111", "5105", "2221", "2720", "3412", "6011", "6500", "3528", "6200"], ["2220", "2721", "6012", "9999", "411"]),
        (checks.npi, ["1234567893"], ["1234567890", "123456789"]),
        (checks.dea, ["AB1234563", "XZ0000000"], ["AB1234564", "IB1234563", "A12345678"]),
        (checks.aba, ["021000021", "011401533"], ["021000022", "991000021", "131000029"]),
        (checks.ssn, ["212-45-6789", "899 12 3456"], ["000-12-3456", "666-12-3456", "900-12-3456", "212-00-6789", "212-45-0000", "078-05-1120", "111-11-1111"]),
        (checks.itin, ["912-70-1234", "900-50-0000", "999-99-9999"], ["912-66-1234", "912-89-1234", "912-93-1234"]),
        (checks.ein, ["12-3456789", "01-0000000"], ["07-1234567", "97-1234567", "12-345678"]),
        (checks.passport, ["A12345678", "AB123456", "e12345678"], ["A1", "ABCD"]),
        (checks.calendar, ["02/29/1984", "1-1-00", "12.31.2030", "2/28/31"], ["02/29/1983", "13/01/1999", "4/31/2000", "1/1/2031", "1/1/1899"]),
    ],
)
def test_checks(spark, check, good, bad):
    assert _map(spark, good + bad, check) == [True] * len(good) + [False] * len(bad)


def test_spans_give_character_places(spark):
    text = "😀 12 x12y 345é12"
    rows = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(spans(F.col("t"), r"[0-9]+").alias("s")).collect()
    assert [(x.start, x.matched) for x in rows[0].s] == [(2, "12"), (6, "12"), (10, "345"), (14, "12")]
    assert all(text[x.start : x.start + len(x.matched)] == x.matched for x in rows[0].s)
    assert rows[1].s == []


def test_normalisers(spark):
    assert _map(spark, ["ﬁne ﬀ Ⅷ", "plain", None], normalize.normalized) == ["fine ff VIII", "plain", None]
    assert _map(spark, ["“a”–b", "x"], normalize.smart_punctuation) == ['"a"-b', "x"]
    assert _map(spark, ["1-2 3.4/5,6"], normalize.separator_map) == [[0, 2, 4, 6, 8, 10]]
    assert _map(spark, ["café", "é́x"], normalize.fold_diacritics) == ["cafe", "ex"]
    assert _map(spark, ["éa" + unicodedata.normalize("NFD", "é")], normalize.fold_map) == [[0, 1, 2]]
    assert _map(spark, [" José  O'Neil-2 "], normalize.canonical) == ["joséoneil2"]
    assert _map(spark, ["1OO-23", "B0X O1", "Il 5", "l1ne", "none"], normalize.confusions_repaired) == ["100-23", "BOX OI", "11 5", "lIne", "none"]
    assert _map(spark, ["FBI MET JOHN."], normalize.title_case) == ["FBI Met John."]
    assert _map(spark, ["abcd", "abcdef"], normalize.masked) == ["…", "ab…ef"]
    assert _map(spark, ["=1", "@x", "ok"], normalize.neutralised) == ["'=1", "'@x", "ok"]


def test_similarity(spark):
    assert similarity.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert similarity.jaro_winkler("", "a") == 0 and similarity.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-6)
    rows = spark.createDataFrame([("J.S.", "John Smith"), ("John Smith", "JS"), ("John", "Jane"), ("Smith, John", "John Smith")], "a string, b string")
    got = rows.select(similarity.initials(F.col("a"), F.col("b")).alias("i"), similarity.token_sort(F.col("a"), F.col("b")).alias("t")).collect()
    assert [r.i for r in got] == [0.8, 0.8, 0.0, 0.0] and got[3].t == 1.0


@pytest.mark.parametrize("pattern", ["(a+)+", "(a|b)*c", "([a-z]+x)*", "((ab)*c)+", "(x{2,})+", "a*", "(", "", "x" * 201])
def test_unsafe_patterns(pattern):
    assert search.unsafe(pattern)


@pytest.mark.parametrize("pattern", [r"\d{3}-\d{2}", "(ab)+", "a+b+", "(a|b)c", r"(\w{2,4}) x", "[(+*]+x"])
def test_safe_patterns(pattern):
    assert search.unsafe(pattern) is None


def test_terms_and_saved_searches():
    assert search.checked_terms([" a ", "A", "b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        search.checked_terms([" "])
    assert search.SavedSearch.of({"mode": "regex", "terms": ["x"]}).mode == "regex"
    with pytest.raises(ValueError):
        search.SavedSearch.of({"mode": "regex", "terms": [], "more": 1})


def test_detectors_survive_odd_rows(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (None, "a@b.co"), (4, "é" * 100_000), (5, "1" * 50_000), (6, "a." * 50_000), (7, "Mr. " * 20_000), (8, "12 Main " * 10_000), (9, "x@" * 30_000)], "doc_id long, text string")
    rows = detect.detected(texts).collect()
    assert [(r.doc_id, r.matched) for r in rows if r.category == "email"] == [(None, "a@b.co")]
    assert detect.detected(texts.limit(0)).count() == 0


def test_one_scan_feeds_all_detectors(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = detect.detected(texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("pattern", [r"(.*,){11}P", "(a*){30}b", "(a?){30}a{30}", r"\d+\d+\d+\d+\d+z", "(a|b)*c", ".*.*.*.*x", "([a-z]+ ?){2}", "((ab)+c){5}", "x{2000}", "(a+)+"])
def test_heavy_patterns_are_refused(pattern):
    assert search.unsafe(pattern)


@pytest.mark.parametrize("pattern", [r"\p{Lu}\w+", r"[0-9]{4}-[0-9]{3,7}", r"(?:\d{3}-)?\d{3}-\d{4}", r"\d+-\d+-\d+-\d+-\d+", "(ab){2,3}", r"[^\]x]+y", r"(?i)total:\s*\$?\d+", r"(?<![0-9])\d{9}(?![0-9])"])
def test_plain_patterns_pass(pattern):
    assert search.unsafe(pattern) is None and not search.slow(pattern)


def test_sentinel_breaks_slow_patterns_off():
    assert search.slow("(a?){30}a{30}", 0.5) and len(search.sentinel()) == 10_240


def test_zip_prefixes_and_own_table(spark):
    prefixes = checks.zip_prefixes()
    assert prefixes["100"] == "NY" and prefixes["941"] == "CA" and len(prefixes) > 800
    row = spark.createDataFrame([("94105", "00000", "12")], "a string, b string, c string").select(
        checks.zip_state(F.col("a")), checks.zip_state(F.col("a"), {"94105": "XX"}), checks.zip_state(F.col("b")), checks.zip_state(F.col("c"))
    ).first()
    assert tuple(row) == ("CA", "XX", None, None)


def test_shadow_keeps_length_and_parts_words(spark):
    rows = ["INDN:DELIA MARY-JANE O'BRIEN, IRS/ATM\nplain Text", "", "É\tÉCOLE a", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(normalize.shadow(F.col("t"))).collect()]
    assert got == ["Indn Delia Mary-Jane O'Brien  IRS Atm\nplain Text", "", "É\tÉcole a", None]


def test_many_hits_in_one_text(spark):
    from lakespan.operators import search as s

    texts = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("ab, fox 1 "), 100_000).alias("text"))
    began = time.time()
    row = s.literal(texts, "fox").agg(F.count(F.lit(1)).alias("n"), F.max("start").alias("last"), F.count_if(F.col("matched") == "fox").alias("good")).first()
    assert (row.n, row.last, row.good) == (100_000, 999_994, 100_000)
    # linear: a fold that copies its result at each hit would take minutes
    assert time.time() - began < 60
