"""Scoring, overlaps, entities, redaction, reports, sources, sinks and streams on small rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lakespan.operators import detect, doctype, entities, overlap, redact, report, scoring, search, terms
from lakespan.sources import scratch, sinks, tables
from lakespan.streaming import live


def _spans(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, category string, rule string, start int, len int, matched string, confidence double")


def test_islands_part_touching_spans(spark):
    rows = _spans(spark, [(1, "ssn", "a", 0, 9, "x", 0.9), (1, "ein", "b", 3, 3, "y", 0.9), (1, "phone", "c", 9, 3, "z", 0.6), (1, "email", "d", 20, 2, "w", 0.9)])
    got = {(r.start, r.island_start, r.island_end) for r in overlap.islands(rows).collect()}
    assert got == {(0, 0, 9), (3, 0, 9), (9, 9, 12), (20, 20, 22)}


def test_winner_rule_is_not_transitive(spark):
    rows = _spans(spark, [(1, "ssn", "a", 0, 9, "x", 0.50), (1, "phone", "b", 1, 9, "y", 0.515), (1, "account", "c", 2, 9, "z", 0.53)])
    best = overlap.survivors(overlap.resolved_by_confidence(rows)).collect()
    assert [(r.category, r.start, r.len) for r in best] == [("account", 0, 11)]
    lost = {r.category: r.suppressed for r in overlap.suppressed_counts(overlap.resolved_by_confidence(rows)).collect()}
    assert lost == {"ssn": 1, "phone": 1}


def test_greedy_keeps_the_strongest(spark):
    rows = _spans(spark, [(1, "name", "a", 0, 5, "x", 0.6), (1, "name", "b", 4, 5, "y", 0.9), (1, "name", "c", 8, 4, "z", 0.7), (1, "name", "d", 20, 2, "w", 0.1)])
    assert sorted(r.matched for r in overlap.greedy(rows).collect()) == ["w", "y"]


def test_scores(spark):
    row = spark.range(1).select(
        scoring.posterior(F.lit(0.8), F.lit(0.5), F.lit(0.0)).alias("same"), scoring.posterior(F.lit(0.8), F.lit(0.1), F.lit(0.0)).alias("low"),
        scoring.suppressed(F.lit(0.8), [("case", 0.5), ("docket", 1.0)], F.lit("the docket"), F.lit(0.1)).alias("s"), scoring.logit(F.lit(1.0)).alias("l"),
    ).first()
    assert row.same == pytest.approx(0.8) and row.low == pytest.approx(1 / (1 + math.exp(-(math.log(4) + math.log(0.35 / 0.65)))))
    assert row.s == pytest.approx(0.2) and math.isfinite(row.l)
    assert scoring.preset("balanced", {"ssn": 7.0})["ssn"] == 1.0


def test_class_of_a_text_without_evidence_is_the_first(spark):
    rows = {r.doc_id: r for r in doctype.classified(spark.createDataFrame([(1, "zzz"), (2, "patient hospital surgery"), (3, None)], "doc_id long, text string")).collect()}
    assert rows[1].primary == "court" and rows[3].primary == "court" and rows[2].primary == "medical"
    assert sum(rows[2].probabilities) == pytest.approx(1.0)


def test_name_clusters(spark):
    names = [(1, "John Smith"), (2, "J. Smith"), (3, "Zed Smith"), (4, "Mary Jones"), (5, " ")] + [(100 + i, "Brown") for i in range(16)]
    got = {r.id: (r.cluster, r.ambiguous) for r in entities.clusters(spark.createDataFrame(names, "id long, name string")).collect()}
    assert got[1][0] == got[2][0] == 1 and got[4] == (4, False) and 5 not in got
    assert all(got[100 + i] == (100, True) for i in range(16))


def test_redaction_round(spark):
    texts = spark.createDataFrame([(1, "call 212-45-6789 now"), (2, "clean"), (3, None)], "doc_id long, text string")
    found = _spans(spark, [(1, "ssn", "r", 5, 11, "212-45-6789", 0.9), (1, "ein", "r", 9, 2, "45", 0.9)])
    out = redact.redacted(texts, found)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == "call " + redact.BLOCK * 11 + " now" and (rows[1].excluded, rows[1].surviving) == (11, 9)
    assert rows[2].text == "clean" and rows[3].text == ""
    assert {r.doc_id: r.text for r in redact.redacted(texts, found, halo=1).collect()}[1] == "call" + redact.BLOCK * 13 + "now"
    kept = scratch.written(out, "test-redacted")
    layers = redact.layers(texts, found, kept, scratch.written(redact.digest(texts, kept), "test-digest"), ["clean", "ab"])
    assert {r.doc_id: r.status for r in redact.verdict(layers).collect()} == {1: "pass", 2: "attention", 3: "pass"}
    wrong = kept.withColumn("text", F.replace("text", F.lit(redact.BLOCK), F.lit("x")))
    assert {r.doc_id: r.status for r in redact.verdict(redact.layers(texts, found, wrong, redact.digest(texts, kept), [])).collect()}[1] == "fail"
    assert redact.same_count(texts, out).first().status == "pass"


def test_verdicts(spark):
    rows = [("a", "pass"), ("a", "warn"), ("b", "skipped"), ("c", "skipped"), ("c", "pass"), ("d", "info"), ("e", "fail"), ("e", "attention")]
    got = {r.doc_id: r.status for r in redact.verdict(spark.createDataFrame(rows, "doc_id string, status string")).collect()}
    assert got == {"a": "warn", "b": "skipped", "c": "warn", "d": "pass", "e": "fail"}


def test_search_options(spark):
    texts = spark.createDataFrame([(1, "Café-au-lait CAFE"), (2, "Ünïcode “quoted” words")], "doc_id long, text string")
    found = search.literal(texts, "cafeaulait", search.Options(fold_diacritics=True, strip_separators=True)).collect()
    assert [(r.start, r.len, r.matched) for r in found] == [(0, 12, "Café-au-lait")]
    assert search.literal(texts, "CAFE", search.Options(case_sensitive=True)).count() == 1
    assert search.literal(texts, '"quoted"', search.Options(smart_punctuation=True)).count() == 1
    assert search.literal(texts, "word", search.Options(whole_word=True)).count() == 0
    hits, more = search.capped(search.literal(texts, "a"), ["doc_id", "start"], 2)
    assert hits.count() == 2 and more.first().saturated
    with pytest.raises(ValueError):
        search.regex(texts, "(a+)+")


def test_user_terms(spark):
    found = _spans(spark, [(1, "name", "r", 0, 4, "John  Smith", 0.6), (1, "phone", "r", 5, 4, "555-0147", 0.6), (1, "email", "r", 9, 4, "a@b.co", 0.6)])
    assert [r.category for r in terms.never_flagged(found, ["john smith"], [r"[0-9-]+"]).collect()] == ["email"]
    assert terms.stored(spark, [("always", " x ", False), ("always", "X", False), ("never", "(a+)+", True)]).count() == 1


def test_priors_streak_and_merge(spark):
    rows = [("a", i, i, True) for i in range(9)] + [("a", 20, 20, False), ("b", 1, 1, False)]
    got = {r.category: (r.alpha, r.beta) for r in report.priors(spark.createDataFrame(rows, "category string, ts long, id long, accepted boolean")).collect()}
    assert got == {"a": (6.0, 2.0), "b": (1.0, 2.0)}
    a = spark.createDataFrame([("a", 40.0, 5.0)], "category string, alpha double, beta double")
    assert report.merged_priors(a, a).first().alpha == pytest.approx(79 * 50 / 88)


def test_reports_hide_text(spark):
    found = detect.detected(tables.fixture(spark), ["email", "ssn"])
    rows = [json.loads(x) for x in report.audit(found).toJSON().collect()]
    assert rows and all("jane.doe" not in json.dumps(r) and "212-45" not in json.dumps(r) for r in rows)
    assert report.run_difference(found, found).where("change != 'unchanged'").count() == 0
    text = spark.range(1).select(report.sanitised(F.lit("regex(x); userAlwaysFlag(secret); ctx+(0.9)")).alias("s")).first().s
    assert "secret" not in text


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, head in {"a": b"%PDF-1.7 rest", "b": b"\xff\xd8\xff\xe0rest of it", "c": b"plain text here", "d": b"RIFF\0\0\0\0WEBPxx", "e": b"\0\0\0\x18ftypheic"}.items():
        (tmp_path / "in" / name).write_bytes(head)
    kinds = {r.path[-1]: r.kind for r in tables.files(spark, str(tmp_path / "in")).collect()}
    assert kinds == {"a": "pdf", "b": "jpeg", "c": "unknown", "d": "webp", "e": "heif"}
    records = report.audit(detect.detected(tables.fixture(spark), ["email"]))
    sinks.audit_csv(records, str(tmp_path / "csv"), "r1")
    sinks.audit_json(records, str(tmp_path / "json"), "r1")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == records.count()
    import hashlib

    path = tmp_path / "in" / "a"
    assert tables.checked(spark, str(path), hashlib.sha256(path.read_bytes()).hexdigest()) and not tables.checked(spark, str(path), "0")
    with pytest.raises(ValueError):
        tables.versioned({"version": 3}, "x", 1, 2)


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    out = live.drained(live.event_counts(stream, "1 hour", late="3650 days"), "t_counts", "complete")
    assert out.agg(F.sum("n")).first()[0] == events.count()
    decisions = events.select(F.col("event_type").alias("category"), "ts", F.col("event_id").alias("id"), (F.col("event_id") % 3 > 0).alias("accepted"))
    decisions.orderBy("ts", "id").coalesce(1).write.parquet(str(tmp_path / "decisions"))
    stream = spark.readStream.schema(decisions.schema).parquet(str(tmp_path / "decisions"))
    got = {r.category: (round(r.alpha, 6), round(r.beta, 6)) for r in live.drained(live.priors(stream), "t_priors", "update").collect()}
    want = {r.category: (round(r.alpha, 6), round(r.beta, 6)) for r in report.priors(decisions).collect()}
    assert got == want
    sessions = live.drained(live.sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), "10 minutes", "3650 days"), "t_sessions", "complete")
    assert sessions.agg(F.sum("n")).first()[0] == events.count()


def test_search_finds_composed_forms_and_cuts_the_original(spark):
    texts = spark.createDataFrame([(1, "the \ufb01le is \u201cquoted\u201d cafe\u0301 \u00bd"), (2, "plain file"), (3, "of\ufb01ce-42 ofice")], "doc_id long, text string")
    hits = lambda term, **o: sorted((r.doc_id, r.start, r.len, r.matched) for r in search.literal(texts, term, search.Options(**o)).collect())
    assert hits("file") == [(1, 4, 3, "\ufb01le"), (2, 6, 4, "file")]
    assert hits("file", normalize_unicode=False) == [(2, 6, 4, "file")]
    assert hits('"quoted"', smart_punctuation=True) == [(1, 11, 8, "\u201cquoted\u201d")]
    assert hits("cafe", fold_diacritics=True) == [(1, 20, 5, "cafe\u0301")] and hits("caf\u00e9") == [(1, 20, 5, "cafe\u0301")]
    assert hits("fice42", strip_separators=True) == [(3, 2, 6, "\ufb01ce-42")]
    assert hits("fi", exact_match=True) == [] and hits("ofice", exact_match=True) == [(3, 9, 5, "ofice")]
    assert len(search.multi(texts, ["file", "ofice"]).collect()) == 3
