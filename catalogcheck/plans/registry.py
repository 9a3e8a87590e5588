"""All queries of the catalog operators and their oracle SQL, gathered from the modules that define them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import boxes, catalog, claims, crosswalk, designations, evidence, extensions, guard, judgement, ledger, measure, metrics, opinions, rules, rulings, run, semantics, shortlists, splits, structural, triage
from ..streaming import ledger as stream

MODULES = (catalog, structural, semantics, designations, triage, measure, ledger, evidence, judgement, opinions, boxes, guard, rulings, crosswalk, rules, metrics, shortlists, splits, claims, run, extensions, stream)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog to ranked review queue: structural and document checks, identities, clusters, expected value, rank."""
    return run.audit_run(spark, sf_dir)
