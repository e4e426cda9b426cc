"""Queries that run over all categories."""

from pyspark.sql import functions as F

from lakespan.operators import detect, scoring
from lakespan.plans import catalog
from lakespan.sources.tables import corpus

DIR = "/root/testdata/sf0.001"
OUTSIDE = ["name", "address", "passport", "driversLicense", "dea", "licensePlate"]


def test_redaction_covers_all_categories(spark):
    left = scoring.thresholded(detect.detected(corpus(spark, DIR), OUTSIDE), scoring.preset("balanced")).select("doc_id", "start", "len", "category")
    assert left.select("category").distinct().count() > 3
    out = catalog.queries()["redact_text_all"](spark, DIR)
    cut = left.join(out, "doc_id").select(F.substring("text", F.col("start") + 1, F.col("len")).alias("t"), "len")
    assert cut.where(F.col("t") != F.expr("repeat('█', len)")).count() == 0 and cut.count() == left.count()
    verdicts = {r.doc_id for r in catalog.queries()["verify_layers_all"](spark, DIR).collect()}
    assert {r.doc_id for r in left.select("doc_id").distinct().collect()} <= verdicts


def test_overlaps_meet_over_all_categories(spark):
    winners = {r.category for r in catalog.queries()["overlap_scan_all"](spark, DIR).select("category").distinct().collect()}
    assert winners & set(OUTSIDE)
    counts = {r.category: r.suppressed for r in catalog.queries()["overlap_suppressed_all"](spark, DIR).collect()}
    fewer = {r.category: r.suppressed for r in catalog.queries()["overlap_suppressed"](spark, DIR).collect()}
    assert counts != fewer
