"""Results, whole scans, negative context, names, verification sweeps, audit documents and terms on small rows."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from lakespan.operators import address, doctype, entities, redact, report, results, scan, sweep, terms
from lakespan.sources import sinks, tables


def _spans(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, category string, rule string, start int, len int, matched string, confidence double")


ROWS = [(1, "phone", "phone.regex", 0, 12, "415-555-2671", 0.8), (1, "account", "account.regex", 4, 8, "555-2671", 0.95), (2, "ssn", "ssn.regex", 3, 11, "212-45-6789", 0.75), (2, "email", "email.regex", 30, 5, "a@b.c", None)]


def test_filters_orders_and_selection(spark):
    found = _spans(spark, ROWS).withColumn("applied", F.col("start") == 3).withColumn("source", F.lit("textLayer"))
    assert results.filtered(found, ["ssn", "email"]).count() == 2 and results.filtered(found, least=0.8).count() == 2
    assert results.filtered(found, applied=True).count() == 1 and results.filtered(found, sources=["ocr"]).count() == 0
    assert [r.category for r in results.ordered(found, "confidence").collect()] == ["account", "phone", "ssn", "email"]
    assert [r.start for r in results.ordered(found).collect()] == [0, 4, 3, 30]
    pick = lambda *a, **k: results.selected(found, *a, **k).where("selected").count()
    assert (pick("high"), pick("very high"), pick("category", "ssn"), pick("all", doc_id=1), pick("none")) == (3, 1, 1, 2, 0)
    with pytest.raises(ValueError):
        results.ordered(found, "size")
    with pytest.raises(ValueError):
        results.selected(found, "odd")
    capped = results.highlights(found, cap=1).collect()
    assert [(r.doc_id, r.saturated) for r in sorted(capped, key=lambda r: r.doc_id)] == [(1, True), (2, True)]


def test_sweep_encodings_boundaries_and_states(spark):
    texts = {1: "see Jane Doe here", 2: "JANE DOES", 3: "nothing", 4: None, 5: "jane doe", 6: "xxJane Doe"}
    rows = [(i, None if t is None else t.encode("utf-16-le" if i == 5 else "utf-8")) for i, t in texts.items()]
    out = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "doc_id long, content binary")
    hits = {(r.doc_id, r.encoding): r.hits for r in sweep.swept(out, ["Jane Doe", "of"]).collect()}
    assert hits == {(1, "UTF-8"): 1, (2, "UTF-8"): 1, (5, "UTF-16LE"): 1, (6, "UTF-8"): 1}
    whole = {r.doc_id for r in sweep.swept(out, ["Jane Doe"], boundary=True).collect()}
    assert whole == {1, 5}
    assert {r.doc_id: r.status for r in sweep.sweep_status(out, ["Jane Doe"]).collect()} == {1: "fail", 2: "fail", 3: "pass", 4: "pass", 5: "fail", 6: "fail"}
    assert {r.status for r in sweep.sweep_status(out, []).collect()} == {"info"} and {r.status for r in sweep.sweep_status(out, ["ab"]).collect()} == {"warn"}
    assert {r.status for r in sweep.sweep_status(out, [f"{k:0300}" for k in range(2000)]).collect()} == {"warn"}
    assert {(r.searched, r.found) for r in sweep.known_terms(out, ["Jane Doe", "abc"]).collect()} == {(1, 1), (1, 0)}
    marks = {r.doc_id: r.status for r in sweep.end_marks(spark.createDataFrame([(1, bytearray(b"%%EOF a %%EOF")), (2, bytearray(b"%%EOF <x:xmpmeta")), (3, bytearray(b"%%EOF"))], "doc_id long, content binary")).collect()}
    assert marks == {1: "fail", 2: "warn", 3: "pass"}
    again = sweep.extracted_again(spark.createDataFrame([(1, "Ja ne█D oe"), (2, "Jan Doe")], "doc_id long, text string"), ["Jane Doe"])
    assert [r.doc_id for r in again.collect()] == [1]
    assert {r.doc_id: r.status for r in sweep.readable(spark.createDataFrame([(1, "██ █\n"), (2, "█a")], "doc_id long, text string")).collect()} == {1: "pass", 2: "fail"}


def test_scan_in_its_order(spark):
    texts = spark.createDataFrame([(1, "call 415-555-2671 or jane@example.com"), (2, "ssn 212-45-6789, never me@example.com"), (3, "keep this phrase"), (4, None)], "doc_id long, text string")
    out = scan.scanned(texts, ["phone", "email", "ssn"], {"phone": 0.99}, (["me@example.com"], []), (["phrase"], [])).collect()
    assert sorted((r.doc_id, r.category) for r in out) == [(1, "email"), (2, "ssn"), (3, "user")]


def test_negative_context_by_scope(spark):
    found = spark.createDataFrame([(1, "ssn", "court", "case no", "1", "x", 0.8), (2, "ssn", "generic", "case no", "1", "x", 0.8), (3, "ssn", "court", "plain", "1", "x", 0.8), (4, "phone", "court", "case no", "1", "x", 0.8), (5, "ssn", "court", "case docket", "1", "", 0.3)], "doc_id long, category string, doctype string, before string, matched string, after string, confidence double")
    words = spark.createDataFrame([("ssn", "court", "Case", 0.4), ("ssn", "court", "docket", 1.0)], "category string, doctype string, keyword string, weight double")
    got = {r.doc_id: (round(r.confidence, 6), r.suppressed_by) for r in scan.suppressed(found, words).collect()}
    assert got == {1: (0.56, "case"), 2: (0.8, None), 3: (0.8, None), 4: (0.8, None), 5: (0.25, "docket")}
    row = spark.createDataFrame([("the phone or the fax",)], "w string").select(scan.shares(F.col("w"), ["fax", "phone", "cell"], F.lit(0.1)).alias("s")).first()
    assert [(x.keyword, round(x.share, 6)) for x in row.s] == [("fax", 0.05), ("phone", 0.05)]


NAMES = [
    ("Roy Bean", 0.15, False), ("Xyz Bean", 0.10, False), ("Bean", 0.10, False), ("Roy Bean Jr.", 0.15, False), ("Roy Smith-Bean", 0.15, False), ("Ann Smith-Jones", 0.05, False), ("Ann Beam", 0.05, False),
    ("Ann Bea", 0.05, False), ("Ann Srnith", 0.05, False), ("Ann Zzzz", 0.0, False), ("Roy", 0.0, True), ("Bob Bean", 0.15, False), ("Smiht", 0.0, False),
]


def test_gazetteer_verdicts(spark):
    rows = spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(NAMES)], "id long, name string")
    dims = [spark.createDataFrame([(w,) for w in words], "word string") for words in (["Bean", "smith"], ["roy", "robert"])]
    got = {r.id: (r.boost, r.given_only) for r in entities.gazetteer_verdict(rows, *dims, spark.createDataFrame([("bob", "Robert")], "alias string, canonical string")).collect()}
    assert got == {i: (boost, only) for i, (_, boost, only) in enumerate(NAMES)}


def test_names_without_a_prefix(spark):
    texts = spark.createDataFrame([(1, "yesterday Roy Bean paid"), (2, "INDN:ROY BEAN,PAID"), (3, "the Old House"), (4, "we met Roy today"), (5, None), (6, "to ROY BEAM")], "doc_id long, text string")
    out = scan.names(texts, spark.createDataFrame([("bean",)], "word string"), spark.createDataFrame([("roy",)], "word string"))
    assert sorted((r.doc_id, r.start, r.matched, round(r.confidence, 2)) for r in out.collect()) == [(1, 10, "Roy Bean", 0.85), (2, 5, "ROY BEAN", 0.85), (4, 7, "Roy", 0.70), (6, 3, "ROY BEAM", 0.75)]


def test_audit_documents(spark, tmp_path):
    found = _spans(spark, [(1, "ssn", "ssn.regex", 0, 11, "=12-45-6789", 0.9), (2, "phone", "phone.regex", 5, 12, 'a,"b"', 0.5)]).withColumn("base", F.lit(0.5)).withColumn("term", F.lit("secret"))
    records = report.audit_records(found, {"ssn": 0.5})
    assert records.columns == report.AUDIT_COLUMNS and len(records.columns) == 19
    rows = {r.piiCategory: r for r in records.collect()}
    assert rows["ssn"].matchedText == "'=1…89" and rows["ssn"].term == "ssn" and rows["ssn"].ruleVersion == "pii.ssn.state_machine.v1" and rows["phone"].appliedThreshold == ""
    sinks.audit_document_csv(report.audit_records(found, {}, sensitive=True), str(tmp_path / "csv"), {"run": "r1"})
    text = b"".join(open(p, "rb").read() for p in sorted(glob.glob(str(tmp_path / "csv/part-*")))).decode()
    lines = text.split("\r\n")
    assert lines[0] == "# run: r1" and lines[1] == ",".join(report.AUDIT_COLUMNS) and len(lines) == 5 and any('"a,""b"""' in x for x in lines[2:]) and any("'=12-45-6789" in x for x in lines[2:])
    sinks.audit_document_json(records, str(tmp_path / "json"), {"run": "r1"})
    doc = json.loads("".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "json/part-*")))))
    assert doc["metadata"] == {"run": "r1"} and len(doc["records"]) == 2 and list(doc["records"][0]) == sorted(report.AUDIT_COLUMNS)


def test_apply_skips_what_is_covered(spark):
    texts = spark.createDataFrame([(1, "call 415-555-2671 now")], "doc_id long, text string")
    wanted = _spans(spark, [(1, "phone", "r", 5, 12, "415-555-2671", 0.9), (1, "account", "r", 18, 3, "now", 0.9)])
    out, regions = redact.applied(texts, wanted, _spans(spark, [(1, "phone", "r", 5, 12, "", 0.9)]))
    assert out.first().text == "call " + redact.BLOCK * 12 + " " + redact.BLOCK * 3
    assert {(r.category, r.state) for r in regions.collect()} == {("phone", "covered"), ("account", "applied")}


def test_templates_cities_classes_and_sizes(spark, tmp_path):
    own = terms.stored(spark, [("never", "Foo", False)])
    more = spark.createDataFrame([("never", " foo ", False), ("never", "bar", False), ("always", "foo", False), ("never", "bar", False), ("never", " ", False)], "list string, pattern string, is_regex boolean")
    assert sorted((r.list, r.pattern) for r in terms.with_template(own, more).collect()) == [("always", "foo"), ("never", "Foo"), ("never", "bar")]
    texts = spark.createDataFrame([(1, "12 Main Street\nAlbany, NY 12207"), (2, "12 Main Street\nNowhere, NY 12207")], "doc_id long, text string")
    got = {r.doc_id: round(r.confidence, 2) for r in address.assembled(texts, spark.createDataFrame([("Albany",)], "word string")).collect()}
    assert got == {1: 0.80, 2: 0.60}
    row = doctype.explained(doctype.classified(texts)).first()
    assert len(row.top) == 3 and row.top[0].name == row.primary and len(row.top_keywords) <= 5
    pages = spark.createDataFrame([(1, 612.0, 792.0), (2, 5001.0, 1.0), (3, 0.0, 5.0), (4, None, 5.0)], "page_id long, width double, height double")
    assert {r.page_id for r in tables.sized(pages).where("accepted").collect()} == {1}
    path = tmp_path / "dim.json"
    path.write_text('[{"word": "a"}]')
    import hashlib

    rows, degraded = tables.gated(spark, str(path), hashlib.sha256(path.read_bytes()).hexdigest(), "word string")
    assert rows.count() == 1 and not degraded
    rows, degraded = tables.gated(spark, str(path), "0" * 64, "word string")
    assert rows.count() == 0 and degraded
