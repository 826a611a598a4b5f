"""The language stage where no language can be learned."""

from lexivane.llm import language_id


def test_nothing_learned_keeps_what_has_letters(spark):
    rows = [(1, "la casa verde", None), (2, "12 ... !!", None), (3, None, None), (4, "é", None)]
    kept = language_id.known_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert kept.columns == ["doc_id", "text", "lang"] and sorted(r.doc_id for r in kept.collect()) == [1, 4]
