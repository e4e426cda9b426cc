"""The whole library of saved patterns against Python's matcher."""

import re

from lakespan.functions import fixed
from lakespan.plans import catalog
from lakespan.sources.tables import corpus

DIR = "/root/testdata/sf0.001"


def test_whole_library(spark):
    texts = {r.doc_id: r.text for r in corpus(spark, DIR).collect() if r.text and r.text.isascii()}
    want = {(i, k, m.start(), m.group()) for i, t in texts.items() for k, p in fixed.SAVED.items() for m in re.finditer(p, t)}
    got = {(r.doc_id, r.label, r.start, r.matched) for r in catalog.queries()["saved_patterns_all"](spark, DIR).collect() if r.doc_id in texts}
    assert got == want and {"ssn", "ein", "itin", "abaRouting", "accountNumber"} <= {k for _, k, _, _ in got}
