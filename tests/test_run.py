"""Both tiers in one queue, and what the judgement of documents covers."""

import pytest

from catalogcheck.operators import run as R
from catalogcheck.plans import registry
from shared import SMALL


@pytest.mark.parametrize("name", ["audit_run", "agg_run_tiers", "audit_judge", "set_union_tiers", "audit_derive", "agg_signature_clusters", "prj_queue_sentence"])
def test_query_equals_sql(name, same):
    same(registry.queries()[name], registry.oracles()[name])


def test_queue_holds_both_tiers_and_every_cell_is_judged(spark):
    q = R.audit_run(spark, SMALL).toPandas()
    assert set(q.tier) == {"T0", "T1"} and q["rank"].tolist() and sorted(q["rank"]) == list(range(1, len(q) + 1))
    assert q.severity.notna().all() and len(q) == registry.queries()["set_union_tiers"](spark, SMALL).count()
    judged = registry.queries()["audit_judge"](spark, SMALL)
    assert judged.count() == registry.queries()["src_cells_long"](spark, SMALL).count()
    assert {r.attr for r in judged.select("attr").distinct().collect()} == {"rated_current", "poles", "weight", "packaging_uom"}
