"""Names by gazetteers: texts are read once, and a shadow is made only where it tells more than its text."""

from pyspark.sql import functions as F

from lakespan.functions import normalize
from lakespan.operators import scan

TEXTS = [
    "INDN:ROY BEAN,PAID", "Roy,Bean and Jane:Bean", "Mr Roy Bean, of Doe;Smith", "roy bean", "To ROY BEAM / Roy Beam", "ǅord Ǆ Bean", "25A 25AB ⅧⅧ ⒶⒷ ΣΑΣ", "A, B; C: D", "ÉCOLE de Roy", "O'BEAN-DOE x", "", "\tRoy  Bean\nRoy",
    "Roy Bean Jr, Jane", "a b c", "iPhone of McBean", "ß ªB ᾈ", "Roy:Bean:Roy", "BEAN.", "Jane, Roy / Bean; Doe",
]


def test_texts_are_read_once(spark):
    texts = spark.createDataFrame([(1, "we met Roy Bean")], "doc_id long, text string").withColumn("text", F.concat("text", F.lit(" today")))
    out = scan.names(texts, spark.createDataFrame([("bean",)], "word string"), spark.createDataFrame([("roy",)], "word string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "today" not in plan
    assert [(r.start, r.matched) for r in out.collect()] == [(7, "Roy Bean")]


def test_shadow_without_a_capital_to_change_has_spaces_only(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = rows.select("text", normalize.shadow(F.col("text")).alias("s"), F.translate("text", ":;,/", "    ").alias("spaced"), normalize.shadow_recases(F.col("text")).alias("may")).collect()
    assert all(r.may or r.s == r.spaced for r in got) and {r.may for r in got} == {True, False}


def test_names_do_not_change_when_every_shadow_is_made(spark, monkeypatch):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    dims = [spark.createDataFrame([(w,) for w in words], "word string") for words in (["Bean", "Doe", "Smith"], ["roy", "jane"])]
    got = sorted(map(tuple, scan.names(texts, *dims).collect()))
    monkeypatch.setattr(normalize, "shadow_recases", lambda text: F.lit(True))
    assert got == sorted(map(tuple, scan.names(texts, *dims).collect())) and len(got) > 15
