"""Numbers right behind others: a pattern's look-arounds find them, which SQL without look-around passes over."""

import pytest

from lakespan.operators import detect, redact, scoring

CARD = "call +1 (208) 555-1177 4284896609045836 now"


@pytest.mark.parametrize(
    ("category", "text", "matched"),
    [("creditCard", CARD, "4284896609045836"), ("dob", "host 102.9.19.31 up", "9.19.31")],
)
def test_number_behind_another_is_found(spark, category, text, matched):
    got = detect.detected(spark.createDataFrame([(1, text)], "doc_id long, text string"), [category]).collect()
    assert [(r.start, r.matched) for r in got] == [(text.index(matched), matched)]


def test_card_behind_a_phone_is_redacted(spark):
    texts = spark.createDataFrame([(1, CARD)], "doc_id long, text string")
    found = scoring.thresholded(detect.detected(texts, ["creditCard"]), scoring.preset("balanced"))
    assert redact.redacted(texts, found).first().text == CARD.replace("4284896609045836", "█" * 16)
