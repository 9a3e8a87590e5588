"""Mappings closed over two trees, by hand, and the account of all codes."""

import pytest

from catalogcheck.operators import crosswalk as C
from catalogcheck.plans import registry


@pytest.mark.parametrize("name", sorted(C.QUERIES))
def test_query_equals_sql(name, same):
    same(registry.queries()[name], registry.oracles()[name])


def frames(spark):
    codes = [("A11", ["A11", "A1", "A"]), ("A12", ["A12", "A1", "A"]), ("A21", ["A21", "A2", "A"]), ("B11", ["B11", "B1", "B"]), ("B12", ["B12", "B1", "B"]), ("B21", ["B21", "B2", "B"]), ("C11", ["C11", "C1", "C"])]
    mappings = [
        ("A11", 5, "x/1", "exact"), ("A11", 6, "x/2", "narrower"), ("A1", 1, "y/1", "broader"), ("A", 0, None, "no_match"), ("B11", 2, "x/1", "declined"), ("B12", 3, "z/1", "exact"),
        ("B2", 4, "x/1", "exact"), ("B2", 5, None, "no_match"),
    ]
    classes = [("x/1", ["x/1", "x"]), ("x/2", ["x/2", "x"]), ("y/1", ["y/1", "y"]), ("z/1", ["z/1", "z"])]
    features = [("x", "poles"), ("x/1", "poles"), ("x/1", "curve"), ("x/2", "width"), ("y/1", "mass")]
    return {
        "codes": spark.createDataFrame(codes, "code string, ancestors array<string>"), "mappings": spark.createDataFrame(mappings, "code string, ord long, class_id string, relation string"),
        "classes": spark.createDataFrame(classes, "class_id string, ancestors array<string>"), "features": spark.createDataFrame(features, "class_id string, feature string"),
    }


def test_nearest_mapping_and_first_feature(spark):
    got = sorted(map(tuple, C.attributes(**frames(spark)).collect()))
    assert got == [
        ("A11", "curve", "x/1", "x/1", "exact"), ("A11", "poles", "x/1", "x/1", "exact"), ("A11", "width", "x/2", "x/2", "narrower"), ("A12", "mass", "y/1", "y/1", "broader"),
        ("B21", "curve", "x/1", "x/1", "exact"), ("B21", "poles", "x/1", "x/1", "exact"),
    ]


def test_every_code_once(spark):
    got = {r.code: (r.status, r.features) for r in C.accounted(**frames(spark)).collect()}
    assert got == {"A11": ("mapped", 3), "A12": ("mapped", 1), "A21": ("no_match", 0), "B11": ("declined", 0), "B12": ("delivers_nothing", 0), "B21": ("contradictory", 2), "C11": ("unmapped", 0)}


def test_the_count_adds_up(spark):
    from shared import SMALL

    for d in (SMALL, SMALL.replace("0.001", "0.01")):
        rows = registry.queries()["join_crosswalk_refusals"](spark, d)
        kinds = {r.status: r["count"] for r in rows.groupBy("status").count().collect()}
        assert sum(kinds.values()) == spark.read.parquet(f"{d}/supplier.parquet").count() == rows.select("code").distinct().count()
    assert set(kinds) >= {"mapped", "declined", "no_match", "unmapped"}
