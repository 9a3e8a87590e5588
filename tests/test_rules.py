"""Rules broken in one pass, the gate, and who has signed what."""

import pytest
from pyspark.sql import functions as F

from catalogcheck.operators import rules as R
from catalogcheck.plans import registry


@pytest.mark.parametrize("name", sorted(R.QUERIES))
def test_query_equals_sql(name, same):
    same(registry.queries()[name], registry.oracles()[name])


def test_redlines_by_hand(spark):
    rows = [
        ("fine", "contradiction", "colour", "5", "accept", 1, []), ("two", "contradiction", "rated_current", "5", "accept", 2, []), ("one", "contradiction", "ns:Rated-Current", "5", "keep", 1, ["single_signature_on_safety_class"]),
        ("open", "contradiction", "rated_current", "5", None, None, []), ("same", "agreement", "colour", "5", None, None, ["class_raises_no_finding"]), ("null", None, "colour", "5", None, None, ["class_raises_no_finding"]),
        ("blank", "precision_mismatch", "colour", " ", "accept", 2, ["accepted_without_a_value"]), ("kept", "precision_mismatch", "colour", None, "keep", 1, []), ("odd", "agreement", "rated_voltage", None, "shrug", 1, ["class_raises_no_finding", "single_signature_on_safety_class", "unknown_decision"]),
    ]
    frame = spark.createDataFrame([r[:6] for r in rows], "id string, cls string, attr string, proposed string, decision string, signers long")
    got = {}
    for r in R.broken(frame, R.redline_rules(), ["id"]).collect():
        got.setdefault(r.id, []).append(r.rule)
    assert got == {r[0]: r[6] for r in rows if r[6]}
    fine, refused = R.sorted_out(frame, R.redline_rules())
    assert {r.id for r in fine.collect()} == {r[0] for r in rows if not r[6]}
    assert {r.id: r.broken for r in refused.collect()} == got


def test_signers_of_the_latest_decision(spark):
    rows = [("s", "keep", 1, 1, "a"), ("s", "keep", 2, 2, "b"), ("s", "accept", 3, 3, "a"), ("s", "accept", 4, 4, "a"), ("t", "keep", 1, 5, "a"), ("t", "accept", 2, 6, "c"), ("t", "keep", 2, 7, "b"), ("u", "keep", 1, 8, None)]
    got = {r.sku: (r.decision, r.signers, r.signer) for r in R.signed(spark.createDataFrame(rows, "sku string, kind string, ts long, event_id long, signer string"), ["sku"]).collect()}
    assert got == {"s": ("accept", 1, "a"), "t": ("keep", 2, "b"), "u": ("keep", 1, None)}


def test_a_rule_that_gives_null_is_broken(spark):
    assert R.broken(spark.range(1), {"unsure": F.lit(None).cast("boolean")}, ["id"]).count() == 1
