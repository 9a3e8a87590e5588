"""Designations against values written down by hand, through Spark."""

import pytest

from catalogcheck.functions import grammar as G

MM = 10**6
WANT = {  # raw: (kind, unit, intervals, id, refusal)
    "12.5 mm ± 0.3": ("quantity", "mm", [(12_200_000, 12_800_000)], None, None),
    "12.5 mm +0.3/-0.1": ("quantity", "mm", [(12_400_000, 12_800_000)], None, None),
    "100 mm ±5%": ("quantity", "mm", [(95 * MM, 105 * MM)], None, None),
    "3/8 in": ("quantity", "in", [(9_525_000, 9_525_000)], None, None),
    "½ in": ("quantity", "in", [(12_700_000, 12_700_000)], None, None),
    "1 3/8 in": ("quantity", "in", [(34_925_000, 34_925_000)], None, None),
    "230/400 V": ("quantity_set", "V", [(229_500_000_000, 230_500_000_000), (399_500_000_000, 400_500_000_000)], None, None),
    "10..20 mm": ("range", "mm", [(9_500_000, 10_500_000), (19_500_000, 20_500_000)], None, None),
    "10 – 20 mm": ("range", "mm", [(9_500_000, 10_500_000), (19_500_000, 20_500_000)], None, None),
    "2 to 4 mm": ("range", "mm", [(1_500_000, 2_500_000), (3_500_000, 4_500_000)], None, None),
    "20..10 mm": (None, None, None, None, "malformed"),
    "10 mm .. 2 cm": (None, None, None, None, "malformed"),
    "1 5/0 in": (None, None, None, None, "malformed"),
    "1,5 A": ("quantity", "A", [(1_450_000_000, 1_550_000_000)], None, None),
    "1,500 A": (None, None, None, None, "ambiguous_number"),
    "1,234.5 A": ("quantity", "A", [(1_234_450_000_000, 1_234_550_000_000)], None, None),
    "2,000,000 mA": ("quantity", "mA", [(1_999_999_500_000, 2_000_000_500_000)], None, None),
    "9999999 kA": (None, None, None, None, "out_of_range"),
    "123456789012345678901234567890 mA": (None, None, None, None, "out_of_range"),
    "25 °C": ("quantity", "degC", [(297_650_000_000, 298_650_000_000)], None, None),
    "16": ("quantity", "", [(16 * 10**9, 16 * 10**9)], None, None),
    "b": (None, None, None, None, "ambiguous_term"),
    "C curve": ("term", None, None, "tripping/c", None),
    "stainless steel": ("generic", None, None, "stainless_steel", None),
    "1.4401": ("material", None, None, "metal/steel/stainless/1.4401", None),
    "Ja": ("boolean", None, None, "true", None),
    "": (None, None, None, None, "no_grammar_match"),
    "5 mm ±0.1 in": (None, None, None, None, "malformed"),
    "5 mm +0.1/-0.2 cm": (None, None, None, None, "malformed"),
    "5 mm ±0.1 mm": ("quantity", "mm", [(4_900_000, 5_100_000)], None, None),
    "foo 12": (None, None, None, None, "no_grammar_match"),
}
#: (catalog, document, relation)
RELATED = [
    ("230/400 V", "400/230 V", "equivalent_unit_frame"), ("230 V", "230/400 V", "a_more_specific"), ("230/400 V", "500 V", "contradiction"), ("230/400 V", "230/500 V", "incomparable"),
    ("10..20 mm", "12..15 mm", "b_more_specific"), ("10..20 mm", "1..2 cm", "equivalent_unit_frame"), ("10..20 mm", "50..60 mm", "contradiction"), ("10..20 mm", "15..30 mm", "incomparable"), ("15 mm", "10..20 mm", "a_more_specific"), ("10..20 mm", "5 V", "incomparable"),
    ("A4", "1.4401", "equivalent_vocabulary"), ("A4", "a4", "equivalent"), ("steel", "A4", "b_more_specific"), ("A4", "A2", "contradiction"), ("A4", "zinc plated", "incomparable"),
    ("stainless steel", "A4", "b_more_specific"), ("brass", "stainless steel", "contradiction"), ("metal", "stainless", "b_more_specific"), ("any curve", "C curve", "b_more_specific"), ("any curve", "Class F", "incomparable"),
    ("yes", "TRUE", "equivalent"), ("yes", "no", "contradiction"), ("C", "type-c", "equivalent_vocabulary"), ("C curve", "D curve", "contradiction"), ("C curve", "panel", "incomparable"), ("1,500 A", "1500 A", "incomparable"), ("25 °C", "77 °F", "equivalent_unit_frame"),
]


@pytest.fixture(scope="module")
def norm(spark):
    raws = sorted({*WANT, *(x for a, b, _ in RELATED for x in (a, b))})
    spark.createDataFrame([(r,) for r in [*raws, None]], "raw string").createOrReplaceTempView("grammar_raws")
    got = spark.sql(f"WITH {G.parsed(G.SPARK, 'SELECT raw FROM grammar_raws')} SELECT * FROM norm").cache()
    got.createOrReplaceTempView("grammar_norm")
    return got


def test_values(norm):
    got = {r["raw"]: r for r in norm.collect()}
    for raw, (kind, unit, intervals, id_, refusal) in WANT.items():
        r = got[raw]
        assert (r["kind"], r["refusal"]) == (kind, refusal), raw
        if kind:
            assert r["unit"] == unit and r["id"] == id_, raw
        if intervals:
            assert [(r[f"lo{i}"], r[f"hi{i}"]) for i in (1, 2, 3) if r[f"lo{i}"] is not None] == intervals, raw


def test_relations(spark, norm):
    spark.createDataFrame(RELATED, "a string, b string, want string").createOrReplaceTempView("grammar_pairs")
    rows = spark.sql(f"SELECT p.*, {G.relation()} AS relation FROM (SELECT a AS x, b AS y, want FROM grammar_pairs) p JOIN grammar_norm a ON p.x = a.raw JOIN grammar_norm b ON p.y = b.raw").collect()
    assert len(rows) == len(RELATED)
    assert [(r["x"], r["y"], r["relation"]) for r in rows if r["relation"] != r["want"]] == []


def test_large_numbers_are_refused(spark):
    from catalogcheck.functions import values as V
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("99999999 kA",), ("12345678901 kV",), ("16 A",)], "value string")
    got = {r["value"]: r["refusal"] for r in d.select("value", V.normalised(F.lit("rated_current"), F.col("value"))["refusal"].alias("refusal")).collect()}
    assert got == {"99999999 kA": "out_of_range", "12345678901 kV": "out_of_range", "16 A": None}
