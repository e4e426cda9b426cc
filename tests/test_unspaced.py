"""Whole words in texts without spaces."""

from lakespan.operators import search


def test_whole_word_is_off_for_unspaced_texts(spark):
    texts = spark.createDataFrame([(1, "私は東京都に住んでいます"), (2, "서울특별시에서 삽니다"), (3, "in xTokyox 東京 Tokyo"), (4, "我住在北京市")], "doc_id long, text string")
    hits = lambda t: {r.doc_id for r in search.literal(texts, t, search.Options(whole_word=True)).collect()}
    assert hits("東京") == {1, 3} and hits("서울") == {2} and hits("北京") == {4}
    assert len(search.literal(texts, "Tokyo", search.Options(whole_word=True)).collect()) == 1
    assert {r.doc_id for r in search.regex(texts, "東京", whole_word=True).collect()} == {1, 3}
