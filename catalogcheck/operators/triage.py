"""From outcomes to a ranked review queue: inventory, clusters, blast radius, cost, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources import tables as T
from . import structural as S
from .numbering import numbered

#: Name spaces of identifiers (fixed values).
REDLINE_SPACE = "b6c4e2a1-7f38-5d90-a1b2-c3d4e5f60718"
SIGNATURE_SPACE = "7a1c3e5d-2b4f-5068-9a7b-1c2d3e4f5061"
STATUSES = ("groundable", "document_named_not_supplied", "document_unreadable", "no_document_named")
SAFETY_FACTOR, NEUTRAL = 25.0, 0.5


def inventory(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The document that each record names by its path's last part, and whether it can serve as evidence."""
    named = rows.select("sku", F.when(F.trim("datasheet") != "", F.element_at(F.split("datasheet", "/"), -1)).alias("doc"))
    known = docs.select("doc", (F.length(F.trim("layer")) > 0).alias("readable"))
    status = F.when(F.col("doc").isNull(), STATUSES[3]).when(F.col("readable").isNull(), STATUSES[1]).when(~F.col("readable"), STATUSES[2]).otherwise(STATUSES[0])
    return named.join(known, "doc", "left").select("sku", "doc", status.alias("status"))


def status_counts(inv: DataFrame) -> DataFrame:
    """Records per status, absent ones with 0, and the exact share as numerator and denominator."""
    spark = inv.sparkSession
    names = spark.sql("SELECT explode(array({})) AS status".format(", ".join(f"'{s}'" for s in STATUSES)))
    counted = names.join(inv.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return counted.withColumn("total", F.sum("n").over(Window.partitionBy()))  # four rows


def signed(found: DataFrame) -> DataFrame:
    """Findings, or kinds of them, with attribute uri, shape, fingerprint and signature id."""
    f = found.withColumn("uri", F.concat(F.lit("customer:"), F.col("attr")))
    f = f.withColumn("shape", V.defect_shape(F.col("value"), F.col("proposed")))
    f = f.withColumn("fingerprint", F.concat_ws("|", "cls", "uri", "shape", "source", "attr", "tier"))
    return f.withColumn("signature_id", V.uuid5(SIGNATURE_SPACE, F.col("fingerprint")))


def keyed(found: DataFrame) -> DataFrame:
    """Findings with their content-addressed id."""
    return found.withColumn("redline_id", V.uuid5(REDLINE_SPACE, F.concat_ws("|", "source", "sku", "uri", "value", F.coalesce("proposed", F.lit("")))))


def identified(found: DataFrame) -> DataFrame:
    """Findings (sku, attr, value, proposed, cls, source, tier, ...) with content-addressed id, attribute uri, shape, fingerprint and
    signature id."""
    return keyed(signed(found))


def findings(cells: DataFrame) -> DataFrame:
    """Findings of the first tier, identified."""
    return identified(S.all_outcomes(cells).filter("outcome = 'finding'").withColumns({"source": F.lit("feed"), "tier": F.lit("T0")}))


def clusters(found: DataFrame) -> DataFrame:
    """Findings by error signature; members stay in their own long table, so no unbounded list is built."""
    return found.groupBy("signature_id", "fingerprint").agg(F.count("*").alias("size"), F.countDistinct("sku").alias("skus"), F.min("redline_id").alias("first_member"))


def queue(found: DataFrame) -> DataFrame:
    """Findings with their factors and expected review value; those that come with the size of their cluster aren't counted again."""
    out = found if "size" in found.columns else found.join(clusters(found).select("signature_id", "size"), "signature_id")
    safety = F.when(V.is_safety(F.col("uri")), F.lit(SAFETY_FACTOR)).otherwise(1.0)
    out = out.withColumns({"safety": safety, "multiplicity": F.greatest(F.lit(1), "size")})
    return out.withColumn("expected", NEUTRAL * F.col("safety") * F.col("multiplicity"))


def ranked(q: DataFrame) -> DataFrame:
    """Ranks by expected value and id."""
    return numbered(q, ("expected", "redline_id", "sku", "check"), ("expected",)).withColumnRenamed("place", "rank")


def _cells(s, d):
    return T.view(s, d, "cat_cells")


def _inv(s, d):
    return inventory(T.view(s, d, "cat_rows"), T.view(s, d, "fx_docs"))


def _found(s, d):
    """The first tier's findings of the feed."""
    from .faults import findings as found  # it needs this module

    return found(s, d, documents=False)


def defect_shapes(s, d):
    """The differences that findings name, each once: from what is said of values, without a look at the cells that have them."""
    from . import faults

    norm = S.dictionary(T.stated(s, d))
    said = faults.verdicts(s, d, norm).select("value", F.explode("outcomes").alias("o")).filter("o.outcome = 'finding'").select("value", "o.proposed")
    said = said.union(faults.alone(s, d, norm).select("value", F.lit(None).cast("string")))
    each = T.written(said.distinct(), "differences")
    return each.withColumn("shape", V.defect_shape(F.col("value"), F.col("proposed")))


def verdict_cells(s, d):
    """Cells that a check speaks to, by attribute, and datasheets of groundable records: a cell is of one record, so the cells that
    have a value are counted and not named."""
    from . import faults

    norm = S.dictionary(T.stated(s, d))
    told = faults.verdicts(s, d, norm).select("attr", "n").unionByName(faults.alone(s, d, norm).select("attr", "n"))
    cells = told.groupBy("attr").agg(F.sum("n").alias("cells"))
    readable = T.view(s, d, "fx_docs").filter("length(trim(layer)) > 0").select("doc").distinct()
    # with turn, the rows are those that the verdicts read, dealt once
    named = T.alike(s, d).select("n", "turn", F.when(F.trim("datasheet") != "", F.element_at(F.split("datasheet", "/"), -1)).alias("doc")).groupBy("doc", "turn").agg(F.sum("n").alias("n"))
    sheets = named.join(readable, "doc").agg(F.sum("n").alias("cells")).filter("cells IS NOT NULL").select(F.lit("datasheet").alias("attr"), "cells")
    return T.written(cells.unionByName(sheets), "verdict-cells")


def agg_coverage(s, d):
    """Judged cells of all stated cells."""
    o = S.all_outcomes(S.written_cells(s, d)).filter("outcome <> 'declined'").select("sku", "attr").distinct()
    a = o.agg(F.count("*").alias("judged"))
    b = _cells(s, d).filter("value IS NOT NULL").agg(F.count("*").alias("considered"))
    return a.crossJoin(b).select("judged", "considered", F.round(F.col("judged") / F.col("considered"), 6).alias("coverage"))  # one row each


def agg_run_manifest(s, d):
    rows = T.view(s, d, "cat_rows").agg(F.count("*").alias("records"), F.countDistinct("mpn").alias("parts"))
    o = S.outcome_counts(_cells(s, d)).agg(*[F.coalesce(F.sum(F.when(F.col("outcome") == x, F.col("n"))), F.lit(0)).alias(x) for x in ("finding", "resolved", "declined")])
    g = _inv(s, d).agg(F.count_if(F.col("status") == "groundable").alias("groundable"))
    return rows.crossJoin(o).crossJoin(g)  # one row each


def agg_tier_cost(s, d):
    """Records entering and units of work of the tiers, priced by a rate per unit."""
    m = agg_run_manifest(s, d)
    rate = {"T0": 0.000001, "T1": 0.00002, "T2": 0.001, "T3": 0.01}
    units = {"T0": F.col("finding") + F.col("resolved") + F.col("declined"), "T1": F.col("groundable") * 4, "T2": F.lit(0).cast("bigint"), "T3": F.col("finding")}
    rows = F.array(*[F.struct(F.lit(t).alias("tier"), u.cast("bigint").alias("units"), F.lit(rate[t]).alias("rate")) for t, u in units.items()])
    return m.select(F.explode(rows).alias("r")).select("r.tier", "r.units", F.round(F.col("r.units") * F.col("r.rate"), 6).alias("cost"))


def prj_queue_sentence(s, d):
    q = _found(s, d)
    said = F.concat_ws(" ", F.concat("sku", F.lit(":")), "attr", F.lit("states"), F.concat(F.lit("'"), "value", F.lit("',")), F.coalesce(F.concat(F.lit("siblings state '"), "proposed", F.lit("'")), F.lit("no sibling value")), F.concat(F.lit("("), F.replace("shape", F.lit("_"), F.lit(" ")), F.lit(")")))
    return q.select("redline_id", "sku", "check", said.alias("sentence"))


_SHAPE = r"""CASE WHEN trim(coalesce(value, '')) = '' THEN 'blank_cell' WHEN trim(coalesce(proposed, '')) = '' THEN 'no_proposal' WHEN na = '' OR nb = '' THEN 'value_substitution'
  WHEN ta <> '' AND tb <> '' AND ta <> tb THEN 'dimension_mismatch'
  WHEN xb <> 0 AND xa <> xb AND sign(xa) = sign(xb) AND regexp_replace(regexp_replace(regexp_replace(na, '[.,-]', '', 'g'), '^0+', ''), '0+$', '') = regexp_replace(regexp_replace(regexp_replace(nb, '[.,-]', '', 'g'), '^0+', ''), '0+$', '') THEN 'order_of_magnitude'
  WHEN da = db AND xa <> xb THEN 'digit_transposition' ELSE 'value_substitution' END"""


def _uuid_sql(space: str, key: str) -> str:
    h = f"sha1(unhex('{space.replace('-', '')}') || encode({key}))"
    return f"""(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr({h}, 17, 1)) AS INT) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"""


#: CTEs from ``told`` (findings with source and tier) to identified and valued findings.
IDENTIFIED_SQL = rf"""found0 AS (SELECT *, 'customer:' || attr AS uri, regexp_extract(trim(value), '-?[0-9]+([.,][0-9]+)?') AS na, regexp_extract(trim(coalesce(proposed, '')), '-?[0-9]+([.,][0-9]+)?') AS nb FROM told),
found1 AS (SELECT *, lower(trim(substr(trim(value), strpos(trim(value), na) + length(na)))) AS ta, lower(trim(substr(trim(coalesce(proposed, '')), strpos(trim(coalesce(proposed, '')), nb) + length(nb)))) AS tb,
  try_cast(replace(na, ',', '.') AS DECIMAL(38, 9)) AS xa, try_cast(replace(nb, ',', '.') AS DECIMAL(38, 9)) AS xb,
  array_to_string(list_sort(string_split(regexp_replace(na, '[^0-9]', '', 'g'), '')), '') AS da, array_to_string(list_sort(string_split(regexp_replace(nb, '[^0-9]', '', 'g'), '')), '') AS db FROM found0),
found2 AS (SELECT *, {_SHAPE} AS shape FROM found1),
found3 AS (SELECT *, concat_ws('|', cls, uri, shape, source, attr, tier) AS fingerprint FROM found2),
found AS (SELECT *, {_uuid_sql(REDLINE_SPACE, "concat_ws('|', source, sku, uri, value, coalesce(proposed, ''))")} AS redline_id, {_uuid_sql(SIGNATURE_SPACE, "fingerprint")} AS signature_id FROM found3),
sized AS (SELECT *, count(*) OVER (PARTITION BY signature_id) AS multiplicity FROM found),
valued AS (SELECT *, 0.5 * (CASE WHEN attr IN ('rated_current', 'packaging_uom') THEN 25.0 ELSE 1.0 END) * multiplicity AS expected FROM sized)"""
FINDINGS_SQL = f"{S.OUTCOMES_SQL}, told AS (SELECT *, 'feed' AS source, 'T0' AS tier FROM outcomes WHERE outcome = 'finding'), {IDENTIFIED_SQL}"

_INV = """inv AS (SELECT sku, r.doc, CASE WHEN r.doc IS NULL THEN 'no_document_named' WHEN d.doc IS NULL THEN 'document_named_not_supplied' WHEN length(trim(layer)) = 0 THEN 'document_unreadable' ELSE 'groundable' END AS status
  FROM (SELECT sku, CASE WHEN trim(datasheet) <> '' THEN string_split(datasheet, '/')[-1] END AS doc FROM cat_rows) r LEFT JOIN fx_docs d ON r.doc = d.doc)"""
_MANIFEST = f"""WITH {S.OUTCOMES_SQL}, {_INV}, m AS (SELECT (SELECT count(*) FROM cat_rows) AS records, (SELECT count(DISTINCT mpn) FROM cat_rows) AS parts, (SELECT count(*) FROM outcomes WHERE outcome = 'finding') AS finding,
  (SELECT count(*) FROM outcomes WHERE outcome = 'resolved') AS resolved, (SELECT count(*) FROM outcomes WHERE outcome = 'declined') AS declined, (SELECT count(*) FROM inv WHERE status = 'groundable') AS groundable)"""

QUERIES = {
    "join_document_inventory": _inv,
    "audit_groundable": lambda s, d: _inv(s, d).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("docs")),
    "agg_groundable_counts": lambda s, d: status_counts(_inv(s, d)).select("status", "n"),
    "agg_groundable_fraction": lambda s, d: status_counts(_inv(s, d)).select("status", F.col("n").alias("num"), F.col("total").alias("den")),
    "agg_recovery_leads": lambda s, d: _inv(s, d).filter("status = 'document_named_not_supplied'").groupBy("doc").agg(F.count("*").alias("unlocks")),
    "agg_declined_by_reason": lambda s, d: S.all_outcomes(S.written_cells(s, d)).filter("outcome = 'declined'").select("reason").unionByName(_inv(s, d).filter("status <> 'groundable'").select(F.col("status").alias("reason"))).groupBy("reason").agg(F.count("*").alias("n")),
    "agg_coverage": agg_coverage,
    "agg_signature_clusters": lambda s, d: clusters(_found(s, d)),
    "srt_cluster_order": lambda s, d: clusters(_found(s, d)).select("fingerprint", "size", F.row_number().over(Window.orderBy(F.desc("size"), "fingerprint")).alias("place")),
    "agg_by_severity": lambda s, d: _found(s, d).rollup("severity", "cls").agg(F.count("*").alias("n")),
    "cmp_defect_shape": defect_shapes,
    "audit_blast_radius": lambda s, d: queue(_found(s, d)).select("redline_id", "sku", "check", "safety", "multiplicity", "expected"),
    "audit_triage": lambda s, d: queue(_found(s, d)).groupBy("expected", "safety", "multiplicity").agg(F.count("*").alias("n")),
    "win_rank_queue": lambda s, d: ranked(queue(_found(s, d))).select("rank", "redline_id", "expected"),
    "top_queue_n": lambda s, d: queue(_found(s, d)).orderBy(F.desc("expected"), "redline_id", "sku", "check").limit(25).select("redline_id", "sku", "expected"),
    "agg_run_manifest": agg_run_manifest,
    "agg_tier_cost": agg_tier_cost,
    "prj_queue_sentence": prj_queue_sentence,
    "flt_safety_class": lambda s, d: _cells(s, d).filter(V.is_safety(F.col("attr"))).groupBy("attr").agg(F.count("*").alias("cells")),
    "flt_presence": lambda s, d: _cells(s, d).groupBy("attr", V.present(F.col("value")).alias("present")).agg(F.count("*").alias("cells")),
    "set_verdict_cells_union": verdict_cells,
    "join_audit_document": lambda s, d: _inv(s, d).filter("status IN ('groundable', 'document_unreadable')").select("sku", "doc"),
}

ORACLES = {k: T.with_views(q) for k, q in {
    "join_document_inventory": f"WITH {_INV} SELECT * FROM inv",
    "audit_groundable": f"WITH {_INV} SELECT status, count(*) AS n, count(DISTINCT doc) AS docs FROM inv GROUP BY 1",
    "agg_groundable_counts": f"WITH {_INV} SELECT s.status, count(inv.sku) AS n FROM (VALUES ('groundable'), ('document_named_not_supplied'), ('document_unreadable'), ('no_document_named')) s(status) LEFT JOIN inv USING (status) GROUP BY 1",
    "agg_groundable_fraction": f"WITH {_INV} SELECT s.status, count(inv.sku) AS num, (SELECT count(*) FROM inv) AS den FROM (VALUES ('groundable'), ('document_named_not_supplied'), ('document_unreadable'), ('no_document_named')) s(status) LEFT JOIN inv USING (status) GROUP BY 1",
    "agg_recovery_leads": f"WITH {_INV} SELECT doc, count(*) AS unlocks FROM inv WHERE status = 'document_named_not_supplied' GROUP BY 1",
    "agg_declined_by_reason": f"WITH {S.OUTCOMES_SQL}, {_INV} SELECT reason, count(*) AS n FROM (SELECT reason FROM outcomes WHERE outcome = 'declined' UNION ALL SELECT status FROM inv WHERE status <> 'groundable') GROUP BY 1",
    "agg_coverage": f"WITH {S.OUTCOMES_SQL}, j AS (SELECT count(*) AS judged FROM (SELECT DISTINCT sku, attr FROM outcomes WHERE outcome <> 'declined')), c AS (SELECT count(*) AS considered FROM cat_cells WHERE value IS NOT NULL) SELECT judged, considered, round(judged / considered, 6) AS coverage FROM j, c",
    "agg_signature_clusters": f"WITH {FINDINGS_SQL} SELECT signature_id, fingerprint, count(*) AS size, count(DISTINCT sku) AS skus, min(redline_id) AS first_member FROM found GROUP BY 1, 2",
    "srt_cluster_order": f"WITH {FINDINGS_SQL} SELECT fingerprint, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, fingerprint) AS place FROM found GROUP BY 1",
    "agg_by_severity": f"WITH {FINDINGS_SQL} SELECT severity, cls, count(*) AS n FROM found GROUP BY ROLLUP (severity, cls)",
    "cmp_defect_shape": f"WITH {FINDINGS_SQL} SELECT DISTINCT value, proposed, shape FROM found",
    "audit_blast_radius": f"WITH {FINDINGS_SQL} SELECT redline_id, sku, \"check\", CASE WHEN attr IN ('rated_current', 'packaging_uom') THEN 25.0 ELSE 1.0 END AS safety, multiplicity, expected FROM valued",
    "audit_triage": f"WITH {FINDINGS_SQL} SELECT expected, CASE WHEN attr IN ('rated_current', 'packaging_uom') THEN 25.0 ELSE 1.0 END AS safety, multiplicity, count(*) AS n FROM valued GROUP BY ALL",
    "win_rank_queue": f"WITH {FINDINGS_SQL} SELECT row_number() OVER (ORDER BY expected DESC, redline_id, sku, \"check\") AS rank, redline_id, expected FROM valued",
    "top_queue_n": f"WITH {FINDINGS_SQL} SELECT redline_id, sku, expected FROM valued ORDER BY expected DESC, redline_id, sku, \"check\" LIMIT 25",
    "agg_run_manifest": f"{_MANIFEST} SELECT * FROM m",
    "agg_tier_cost": f"{_MANIFEST}, t AS (SELECT 'T0' AS tier, finding + resolved + declined AS units, 0.000001 AS rate FROM m UNION ALL SELECT 'T1', groundable * 4, 0.00002 FROM m UNION ALL SELECT 'T2', 0, 0.001 FROM m UNION ALL SELECT 'T3', finding, 0.01 FROM m) SELECT tier, units, CAST(round(units * rate, 6) AS DOUBLE) AS cost FROM t",
    "prj_queue_sentence": f"WITH {FINDINGS_SQL} SELECT redline_id, sku, \"check\", sku || ': ' || attr || ' states ''' || value || ''', ' || coalesce('siblings state ''' || proposed || '''', 'no sibling value') || ' (' || replace(shape, '_', ' ') || ')' AS sentence FROM found",
    "flt_safety_class": "SELECT attr, count(*) AS cells FROM cat_cells WHERE attr IN ('rated_current', 'packaging_uom') GROUP BY 1",
    "flt_presence": f"SELECT attr, lower(trim(value)) NOT IN ({S._NULLISH}) AS present, count(*) AS cells FROM cat_cells GROUP BY ALL",
    "set_verdict_cells_union": f"WITH {S.OUTCOMES_SQL}, {_INV} SELECT attr, count(*) AS cells FROM (SELECT sku, attr FROM outcomes UNION SELECT sku, 'datasheet' FROM inv WHERE status = 'groundable') GROUP BY 1",
    "join_audit_document": f"WITH {_INV} SELECT sku, doc FROM inv WHERE status IN ('groundable', 'document_unreadable')",
}.items()}
