"""Value semantics on hand-written cases."""

import uuid

import pytest
from pyspark.sql import functions as F

from catalogcheck.functions import values as V

PAIRS = [
    ("rated_current", "10 A", "10 A", "equivalent"),
    ("rated_current", "10 A", "10000 mA", "equivalent_unit_frame"),
    ("rated_current", "10 A", "10.4 A", "equivalent"),
    ("rated_current", "10.0 A", "10.4 A", "contradiction"),
    ("rated_current", "63 A", "6 A", "contradiction"),
    ("rated_current", "10 A", "10 kg", "incomparable"),
    ("rated_current", "n/a", "10 A", "incomparable"),
    ("weight", "125 g", "0.125 kg", "equivalent_unit_frame"),
    ("weight", "500 g", "0.125 kg", "contradiction"),
    ("poles", "1", "1P", "equivalent_vocabulary"),
    ("poles", "2P", "1P", "contradiction"),
    ("packaging_uom", "EA", "Each", "equivalent_vocabulary"),
    ("packaging_uom", "Each", "Box of 10", "contradiction"),
    ("packaging_uom", "Box of 10", "box of 10", "equivalent"),
    ("packaging_uom", "pallet maybe", "EA", "incomparable"),
]


def test_relations(spark):
    d = spark.createDataFrame(PAIRS, "attr string, a string, b string, want string")
    d = d.withColumns({"x": V.normalised(F.col("attr"), F.col("a")), "y": V.normalised(F.col("attr"), F.col("b"))})
    got = d.withColumn("got", V.relation(F.col("x"), F.col("y"), F.col("a"), F.col("b"))).select("attr", "a", "b", "got").collect()
    assert [tuple(r) for r in got] == PAIRS


@pytest.mark.parametrize(
    ("catalog", "proposed", "want"),
    [
        ("", "10 A", "blank_cell"),
        ("10 A", "", "no_proposal"),
        ("125 A", "12.5 A", "order_of_magnitude"),
        ("36 A", "63 A", "digit_transposition"),
        ("10 A", "10 kg", "dimension_mismatch"),
        ("red", "blue", "value_substitution"),
        ("10 A", "16 A", "value_substitution"),
    ],
)
def test_defect_shapes(spark, catalog, proposed, want):
    d = spark.createDataFrame([(catalog, proposed)], "a string, b string")
    assert d.select(V.defect_shape(F.col("a"), F.col("b"))).first()[0] == want


def test_identifiers_are_version_five(spark):
    space = "2d9f6e01-4a5b-5c6d-8e7f-90a1b2c3d4e5"
    keys = ["", "a|b", "größe", "x" * 300]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(V.uuid5(space, F.col("k"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(space), k)) for k in keys]


def test_missing_column_is_not_a_blank_cell(spark):
    d = spark.createDataFrame([(None,), ("",), ("0",), (" n/a ",)], "v string")
    assert [r[0] for r in d.select(V.present(F.col("v"))).collect()] == [None, False, True, False]
