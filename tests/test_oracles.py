"""Registered queries against their SQL over the smallest tables."""

import pytest

from catalogcheck.plans import registry

#: One or more of every family; the driver compares all of them.
CHOSEN = (
    "src_cells_long agg_modal_value t0_structural_run norm_job cmp_attribute cmp_swap_symmetry audit_run agg_run_manifest agg_groundable_fraction "
    "win_risk_coverage win_selective_accuracy agg_cohen_kappa win_largest_remainder win_drift_window agg_latest_decision audit_claim_chains audit_chain_depth "
    "win_revision_chain agg_reviewer_report join_text_window audit_class_resolve join_merged_cell udf_embedding_retrieve stream_latest_decision stream_drift_alarm "
    "norm_dispatch cmp_dispatch cmp_quantity_set join_generic_subsumption audit_derive audit_judge set_union_tiers top_rerank_k sink_ledger_append audit_reverse_batch stream_late_chain set_distinct_claims eval_budget_allocate agg_platt_fit audit_calibrate"
).split()


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(name, same):
    same(registry.queries()[name], registry.oracles()[name])


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())


def test_outcomes_do_not_depend_on_row_order(spark):
    from catalogcheck.operators import structural as S
    from catalogcheck.sources import tables as T

    cells = T.view(spark, "/root/testdata/sf0.001", "cat_cells").filter("mpn < 'P12'")
    one = sorted(map(tuple, S.all_outcomes(cells).collect()), key=repr)
    two = sorted(map(tuple, S.all_outcomes(cells.repartition(7, "value").orderBy("sku")).collect()), key=repr)
    assert one == two
