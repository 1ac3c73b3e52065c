"""Keys of word runs in phrase containment."""

from evidgrid.operators import suite as su


def test_runs_are_keyed_by_numbers_of_words(spark):
    texts = spark.createDataFrame(
        [(1, "A few more words stand here, and more"), (2, "more words"), (3, "few"), (4, ""), (5, None), (6, "xfew  MORE wordsy")],
        "text_id int, text string",
    )
    phrases = spark.createDataFrame(
        [(1, "few more words stand here"), (2, "w more w"), (3, "more words"), (4, "stand here, and"), (5, "?"), (6, "")],
        "phrase_id int, phrase string",
    )
    found = su.contained_phrases(texts, phrases)
    assert {(r.text_id, r.phrase_id) for r in found.collect()} == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 3), (6, 2), (6, 3)}
    assert "slice(" not in found._jdf.queryExecution().optimizedPlan().toString()
