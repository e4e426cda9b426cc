"""Reverse rationale: every reason, in its order."""

from lakespan.functions import fixed
from lakespan.operators import rationale


def test_reasons(spark):
    texts = spark.createDataFrame([(1, "SSN 212-45-6789 and jane@example.com, call 415-555-2671", "court"), (2, "nothing here", None), (3, None, None)], "doc_id long, text string, cls string")
    asked = spark.createDataFrame([(1, "212-45-6789"), (1, "jane@example.com"), (1, "415-555-2671"), (1, "absent"), (1, ""), (2, "here"), (3, "x")], "doc_id long, snippet string")
    out = rationale.explained(texts, asked, {"ssn": 2.0}, "cls", (["JANE@example.com"], []), (["jane@example.com"], [r"415-[0-9-]+"]))
    got = {(r.doc_id, r.snippet, r.category): (r.reason, r.confidence) for r in out.collect()}
    assert len(got) == 7 * len(fixed.RANKS)
    assert got[1, "212-45-6789", "ssn"][0] == "belowThreshold" and got[1, "212-45-6789", "email"] == ("noMatch", None)
    assert got[1, "212-45-6789", "npi"] == ("doctypeGated", None) and got[1, "jane@example.com", "npi"][0] == "doctypeGated"
    assert got[1, "212-45-6789", "dob"][0] == "noMatch"
    assert got[1, "jane@example.com", "email"] == ("suppressedByUserTerm", None)
    assert got[1, "415-555-2671", "name"] == ("matchedAlwaysFlag", 1.0)
    assert {got[k][0] for k in got if k[1] in ("absent", "", "x")} == {"snippetNotInContext"}
    assert got[2, "here", "mrn"][0] == "noMatch"
    plain = {(r.snippet, r.category): r.reason for r in rationale.explained(texts, asked, {}).where("doc_id = 1").collect()}
    assert plain["jane@example.com", "email"] == "aboveThreshold" and plain["212-45-6789", "npi"] == "noMatch"
