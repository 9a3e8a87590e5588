"""What may leave: payloads walked to any depth, every place that names a record, and the canonical text of a payload.

Payloads are VARIANT values. A level of all payloads is one lateral explosion of the containers that the level before let
through; the walk ends with the deepest payload, whatever its depth, and each level is written before the next begins.
Below a field that isn't known to describe the run nothing is looked at, as the field alone refuses the payload.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tables as T
from . import triage

# The fields that name one record or one finding, the fields that describe a run, and the shapes of identifiers.
RECORD_FIELDS = (
    "sku", "sku_id", "mpn", "record_id", "attribute_id", "redline_id", "claim_id", "abstention_id", "catalog_value", "value_raw", "evidence_value",
    "proposed_value", "snippet", "char_span", "bbox", "evidence", "row_header", "table_cell", "datasheet", "description", "entries", "findings_detail", "queue",
)
RUN_FIELDS = (
    "batch_id", "catalog", "feed_sha256", "records", "findings", "clusters", "groundable_fraction", "policy_version", "attribute_map_version", "etim_release",
    "scale_version", "audit_version", "structural_version", "started_utc", "notes", "severity_counts", "declined_counts", "cost_report", "priced_cost",
    "versus_extractbench", "residency", "rate_card_id", "currency", "machine", "measured", "total_cents", "total_seconds", "cents_per_record",
    "cents_per_page_processed", "cents_per_error", "tiers", "tier", "seconds", "work_units", "cents", "basis", "caveats", "reference_cents_per_page",
    "reference_source", "pages_processed", "catalog_records", "note",
)
IDENTIFIER = r"^[\w.-]+::[\w.-]+$|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def field_kind(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.isin(list(RECORD_FIELDS)), "record").when(low.isin(list(RUN_FIELDS)), "aggregate").otherwise("unknown")


def _is_container(node: Column) -> Column:
    return F.schema_of_variant(node).rlike("^(OBJECT|ARRAY)")


def _names_a_record(node: Column) -> Column:
    return F.coalesce((F.schema_of_variant(node) == "STRING") & F.variant_get(node, "$", "string").rlike(IDENTIFIER), F.lit(False))


def offending(payloads: DataFrame, key: str = "id") -> DataFrame:
    """(key, path, kind) of every place of a JSON text ``payload`` that may not leave: a field that names a record, one that
    nobody has classified, a string in a list that looks like a record's identifier, or a text that isn't JSON."""
    spark = payloads.sparkSession
    node = F.try_parse_json("payload")
    first = F.when(F.col("node").isNull(), "unreadable").when(_names_a_record(F.col("node")), "identifier")
    level = payloads.filter("payload IS NOT NULL").select(key, F.lit("").alias("path"), node.alias("node")).withColumn("kind", first)
    levels = []
    while True:
        level = T.written(level.select(key, "path", "kind", F.when(F.col("kind").isNull() & _is_container(F.col("node")), F.col("node")).alias("node")), "payload-level")
        levels.append(level.filter("kind IS NOT NULL").select(key, "path", "kind"))
        inside = level.filter("node IS NOT NULL")
        if inside.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        inside = inside.withColumnsRenamed({"path": "above", "node": "held"}).drop("kind")
        child = spark.sql("SELECT w.*, e.pos, e.key AS field, e.value AS node FROM {w} AS w, LATERAL variant_explode(w.held) AS e", w=inside)
        path = F.when(F.col("field").isNull(), F.concat("above", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("above") == "", F.col("field")).otherwise(F.concat_ws(".", "above", "field"))
        named = F.when(F.col("field").isNull(), F.when(_names_a_record(F.col("node")), "identifier")).otherwise(F.nullif(field_kind(F.col("field")), F.lit("aggregate")))
        level = child.select(key, path.alias("path"), "node", named.alias("kind"))


def guarded(payloads: DataFrame, key: str = "id") -> DataFrame:
    """The payloads, unchanged; an error names up to 20 places if any of them may not leave."""
    found = offending(payloads, key).orderBy("path").limit(20).collect()
    if found:
        raise PermissionError("this payload may not leave: " + "; ".join(f"{r['path'] or 'payload'} ({r['kind']})" for r in found))
    return payloads


def canonical(payload: Column) -> Column:
    """The same JSON value always as the same text: fields by name at every depth, no white space."""
    return F.to_json(F.try_parse_json(payload))


def run_payload(s, d) -> DataFrame:
    """The run-level fields that may leave, built by naming them, as one JSON text that the guard has passed."""
    m = triage.agg_run_manifest(s, d)
    notes = F.array(F.concat(F.lit("resolved "), F.col("resolved").cast("string")), F.concat(F.lit("declined "), F.col("declined").cast("string")))
    one = F.struct(F.lit("tenant_local").alias("residency"), "records", F.col("finding").alias("findings"), notes.alias("notes"))
    return guarded(T.written(m.select(F.lit(1).alias("id"), F.to_json(one).alias("payload")), "payload"))


def prj_aggregate_payload(s, d) -> DataFrame:
    p = run_payload(s, d).withColumn("v", F.parse_json("payload"))
    fields = s.sql("SELECT e.key AS field, to_json(e.value) AS value FROM {p} AS p, LATERAL variant_explode(p.v) AS e", p=p)
    return fields.select("field", "value")


QUERIES = {
    "flt_egress_guard": lambda s, d: offending(T.view(s, d, "fx_payloads")),
    "prj_aggregate_payload": prj_aggregate_payload,
}


def _in(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _id(node: str) -> str:
    return f"(json_type({node}) = 'VARCHAR' AND regexp_matches({node} ->> '$', '{IDENTIFIER}'))"


ORACLES = {
    "flt_egress_guard": f"""WITH RECURSIVE fx AS ({T.FX_PAYLOADS.replace("{orders}", "orders")}),
w AS (SELECT id, '' AS path, CASE WHEN json_valid(payload) THEN json(payload) END AS node, CASE WHEN NOT json_valid(payload) THEN 'unreadable' WHEN {_id("json(payload)")} THEN 'identifier' END AS kind FROM fx
UNION ALL SELECT w.id, CASE WHEN json_type(w.node) = 'ARRAY' THEN w.path || '[' || e.key || ']' WHEN w.path = '' THEN e.key ELSE w.path || '.' || e.key END, e.value,
  CASE WHEN json_type(w.node) = 'ARRAY' THEN CASE WHEN {_id("e.value")} THEN 'identifier' END
    WHEN lower(e.key) IN ({_in(RECORD_FIELDS)}) THEN 'record' WHEN lower(e.key) IN ({_in(RUN_FIELDS)}) THEN CASE WHEN json_type(e.value) NOT IN ('OBJECT', 'ARRAY') THEN 'trusted' END ELSE 'unknown' END
  FROM w, json_each(w.node) e WHERE w.kind IS NULL AND json_type(w.node) IN ('OBJECT', 'ARRAY'))
SELECT id, path, kind FROM w WHERE kind IS NOT NULL AND kind <> 'trusted'""",
    "prj_aggregate_payload": T.with_views(f"""{triage._MANIFEST} SELECT unnest(['residency', 'records', 'findings', 'notes']) AS field,
  unnest(['"tenant_local"', CAST(records AS VARCHAR), CAST(finding AS VARCHAR), '["resolved ' || resolved || '","declined ' || declined || '"]']) AS value FROM m"""),
}
