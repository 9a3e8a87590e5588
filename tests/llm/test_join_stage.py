"""Which rows the pipeline's n-gram join keeps: null ids and ids of two texts are rows like any other."""

from catalogcheck.llm import ngram_join

A, B, C, D = ("one two three four five six seven", "red green blue white black brown grey", "a text of a null id alone", "a null id again with other words")


def kept(spark, rows):
    out = ngram_join.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "unused")
    return sorted(map(tuple, out.collect()), key=repr)


def test_rows_of_null_and_shared_ids(spark):
    rows = [
        (1, A, "en"), (5, A.upper(), "en"), (5, B, "en"),  # of id 5, one text is a copy of document 1, one is nobody's
        (None, C, "en"), (None, D, "en"), (None, A, "en"), (None, None, "en"), (None, "", "en"),
        (9, B, "en"), (8, None, "en"), (8, "", "en"), (5, B, "en"),
    ]
    want = [(1, A, "en"), (5, B, "en"), (None, C, "en"), (None, D, "en"), (None, None, "en"), (None, "", "en"), (8, None, "en"), (8, "", "en")]
    assert kept(spark, rows) == sorted(want, key=repr)


def test_the_same_row_whatever_the_order(spark):
    rows = [(3, A, "en"), (3, A.upper(), "fr"), (3, A, "de")]
    assert len(kept(spark, rows)) == 1
    assert kept(spark, rows) == kept(spark, rows[::-1])
