"""Functions of users: one of each kind, and what is refused before it runs."""

import pytest
from pyspark.sql import functions as F

from catalogcheck.operators import extensions as X
from catalogcheck.plans import registry


@pytest.mark.parametrize("name", sorted(X.QUERIES))
def test_query_equals_sql(name, same):
    same(registry.queries()[name], registry.oracles()[name])


def test_kinds_in_their_order(spark):
    k = X.Kinds().register("low", lambda c: F.when(c == F.lower(c), c)).register("any", lambda c: F.upper(c))
    got = k.normalised(spark.createDataFrame([("a",), ("B",), (None,)], "v string"), "v").collect()
    assert [tuple(r) for r in got] == [("a", "low", "a"), ("B", "any", "B"), (None, None, None)]
    with pytest.raises(ValueError, match="already"):
        k.register("low", F.upper)
    with pytest.raises(TypeError):
        k.register("size", F.length).normalised(spark.range(1).select(F.lit("a").alias("v")), "v")


@pytest.mark.parametrize("schema", ["doc_id long, gold string", "doc_id long, p struct<catalogValue:string>", "doc_id long, rows array<struct<TruthLabels:int>>"])
def test_an_extractor_sees_no_answers(spark, schema):
    with pytest.raises(ValueError, match="must not see"):
        X.extracted(spark.createDataFrame([], schema), lambda page: page, "doc_id long")


def test_an_extractor_takes_no_answers(spark):
    def function(page, expected):
        return page

    with pytest.raises(ValueError, match="expected"):
        X.blind(spark.createDataFrame([], "doc_id long, records_of string"), function)
    X.blind(spark.createDataFrame([], "doc_id long, text string, goldfish string"), lambda page: page)


def test_selectors(spark):
    rows = [("q", "a", 0.9), ("q", "b", 0.5), ("r", "c", 0.4), ("s", "d", 1.0)]
    c = spark.createDataFrame(rows, "query string, item string, score double")
    say = {"q": "b", "r": "made up", "s": None}
    got = {r.query: (r.choice, r.margin, r.reason) for r in X.selected(c, lambda f: say[f["query"][0]]).collect()}
    assert got == {"q": ("b", 0.4, "chosen"), "r": (None, 0.0, "not_shown"), "s": (None, 0.0, "declined")}
    many = spark.createDataFrame([("q", str(i), 0.1) for i in range(6)], "query string, item string, score double")
    with pytest.raises(Exception, match="5 candidates at most"):
        X.selected(many, lambda f: None).collect()
