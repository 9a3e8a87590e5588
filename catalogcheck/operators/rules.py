"""Rules over the rows of a frame, checked in one pass: a row for each rule that is broken, and a gate before any sink.

A rule is a name and a condition that must hold; null counts as broken. Redlines are the first user: only classes that
raise a finding become one, and a decision on an attribute that can hurt needs two different signers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources import tables as T
from . import ledger as L

FINDING_CLASSES = sorted({c for c, raises, _ in V.RELATIONS.values() if raises} | {"catalog_null_evidence_present"})


def broken(rows: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """keys and ``rule`` for every rule that a row breaks; one projection, no exchange."""
    names = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items())))
    return rows.select(*keys, F.explode(names).alias("rule"))


def sorted_out(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that keep all rules, and the others with the rules that they break (``broken``)."""
    names = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items())))
    marked = rows.withColumn("broken", names)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)


def signed(decisions: DataFrame, keys: list[str], signer: str = "signer") -> DataFrame:
    """The latest decision of each finding, who made it, and how many different people have signed that same decision."""
    latest = F.max_by(F.struct("kind", signer), F.struct("ts", "event_id"))
    # one row for each finding, decision and signer before they meet
    per = decisions.groupBy(*keys, "kind", signer).agg(F.max("ts").alias("ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    per = per.groupBy(*keys, "kind").agg(F.count("*").alias("signers"), F.max(F.struct("ts", "event_id")).alias("at"), latest.alias("last"))
    best = per.groupBy(*keys).agg(F.max_by(F.struct("kind", "signers", F.col(f"last.{signer}").alias(signer)), "at").alias("d"))
    return best.select(*keys, F.col("d.kind").alias("decision"), "d.signers", f"d.{signer}")


def redline_rules() -> dict[str, Column]:
    """What a redline (cls, attr, decision or null, signers, proposed) has to keep."""
    undecided = F.col("decision").isNull()
    return {
        "class_raises_no_finding": F.col("cls").isin(FINDING_CLASSES),
        "single_signature_on_safety_class": ~V.is_safety(F.col("attr")) | undecided | (F.col("signers") >= 2),
        "accepted_without_a_value": undecided | (F.col("decision") != "accept") | (F.trim("proposed") != ""),
        "unknown_decision": undecided | F.col("decision").isin(list(L.DECISIONS)),
    }


def redlines(s, d) -> DataFrame:
    """Findings with their class and latest decision."""
    e = T.view(s, d, "fx_signed")
    claims = e.filter("kind = 'claim'").groupBy("sku", "attr").agg(F.max_by(F.struct("cls", "proposed"), "event_id").alias("c")).select("sku", "attr", "c.cls", "c.proposed")
    return claims.join(signed(e.filter("kind <> 'claim'"), ["sku", "attr"]), ["sku", "attr"], "left")


def recorded(s, d) -> DataFrame:
    """Decided redlines, recorded if they keep the rules and refused otherwise, with the first rule that they break."""
    fine, refused = sorted_out(redlines(s, d).filter("decision IS NOT NULL"), redline_rules())
    out = fine.select("sku", "attr", "decision", "signers", F.lit("recorded").alias("result"))
    return out.unionByName(refused.select("sku", "attr", "decision", "signers", F.concat(F.lit("refused_"), F.col("broken")[0]).alias("result")))


QUERIES = {
    "flt_redline_valid": lambda s, d: broken(redlines(s, d), redline_rules(), ["sku", "attr", "cls", "decision", "signers"]),
    "audit_adjudicate": recorded,
}

_FINDING = ", ".join(f"'{c}'" for c in FINDING_CLASSES)
_SAFETY = ", ".join(f"'{a}'" for a in V.SAFETY)
_KINDS = ", ".join(f"'{k}'" for k in L.DECISIONS)
_RED = f"""claims AS (SELECT sku, attr, cls, proposed FROM fx_signed WHERE kind = 'claim' QUALIFY row_number() OVER (PARTITION BY sku, attr ORDER BY event_id DESC) = 1),
made AS (SELECT sku, attr, kind, ts, event_id, signer FROM fx_signed WHERE kind <> 'claim'),
latest AS (SELECT sku, attr, kind AS decision FROM made QUALIFY row_number() OVER (PARTITION BY sku, attr ORDER BY ts DESC, event_id DESC) = 1),
red AS (SELECT c.sku, c.attr, cls, proposed, decision, CASE WHEN decision IS NOT NULL THEN (SELECT count(DISTINCT signer) FROM made m WHERE m.sku = c.sku AND m.attr = c.attr AND m.kind = l.decision) END AS signers FROM claims c LEFT JOIN latest l ON l.sku = c.sku AND l.attr = c.attr),
bad AS (SELECT *, list_filter([CASE WHEN coalesce(cls, '') NOT IN ({_FINDING}) THEN 'class_raises_no_finding' END, CASE WHEN attr IN ({_SAFETY}) AND decision IS NOT NULL AND signers < 2 THEN 'single_signature_on_safety_class' END,
  CASE WHEN decision = 'accept' AND coalesce(trim(proposed), '') = '' THEN 'accepted_without_a_value' END, CASE WHEN decision IS NOT NULL AND decision NOT IN ({_KINDS}) THEN 'unknown_decision' END], lambda x: x IS NOT NULL) AS rules FROM red)"""

ORACLES = {k: T.with_views(q) for k, q in {
    "flt_redline_valid": f"WITH {_RED} SELECT sku, attr, cls, decision, signers, unnest(rules) AS rule FROM bad",
    "audit_adjudicate": f"WITH {_RED} SELECT sku, attr, decision, signers, CASE WHEN len(rules) = 0 THEN 'recorded' ELSE 'refused_' || rules[1] END AS result FROM bad WHERE decision IS NOT NULL",
}.items()}
