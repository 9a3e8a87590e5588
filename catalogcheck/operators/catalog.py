"""Feeds and their dimensions: records, cells, units, vocabularies, codes, pairs of labelled values, policy."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources import tables as T
from . import structural as S

IDENTITY = ("sku", "mpn", "manufacturer", "datasheet")
ATTRIBUTES = ("rated_current", "poles", "packaging_uom", "weight")
#: alias -> (group, family): materials by folded alias (a small own table).
MATERIALS = {
    "316": ("1.4401", "steel"), "a4": ("1.4401", "steel"), "1.4401": ("1.4401", "steel"), "316ss": ("1.4401", "steel"),
    "304": ("1.4301", "steel"), "a2": ("1.4301", "steel"), "brass": ("brass", "copper"), "copper": ("copper", "copper"),
    "nickel": ("nickel", "nickel"), "tin": ("tin", "tin"), "steel": ("steel", "steel"),
}


def shared(spark, name: str) -> str:
    return f"{T.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _rows(s, d):
    return T.view(s, d, "cat_rows")


def _cells(s, d):
    return T.view(s, d, "cat_cells")


def records(rows: DataFrame) -> DataFrame:
    """Identity columns by name, all other columns as a map; null stays out of the map, a blank cell is kept."""
    names = [c for c in rows.columns if c.lower() not in IDENTITY and c not in ("feed_row", "feed_line")]
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in sorted(names)])
    kept = F.filter(pairs, lambda p: p["value"].isNotNull())
    return rows.select("sku", "mpn", "manufacturer", F.map_from_entries(kept).alias("attributes"))


def csv_feed(s, d) -> DataFrame:
    """The feed written as delimited text and read back as strings, nothing inferred."""
    path = shared(s, "feed")
    _rows(s, d).select("sku", "mpn", "rated_current", "weight").write.option("header", True).option("nullValue", "\\N").csv(path)
    back = s.read.option("header", True).option("inferSchema", False).option("nullValue", "\\N").schema("sku string, mpn string, rated_current string, weight string").csv(path)
    return back


def json_feed(s, d) -> DataFrame:
    path = shared(s, "feed")
    _rows(s, d).select("sku", "mpn", "rated_current").write.json(path)
    return s.read.schema("sku string, mpn string, rated_current string").json(path)


def feed_spans(s, d) -> DataFrame:
    """Where each cell of a delimited line begins and ends: a cursor moves along the line with the cells."""
    cells = F.array("sku", "mpn", F.coalesce("weight", F.lit("")))
    start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() AS array<struct<start: int, end: int>>)").alias("spans"))

    def step(acc, c):
        here = F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(c)).alias("end")))
        return F.struct((acc["at"] + F.length(c) + 1).alias("at"), F.concat(acc["spans"], here).alias("spans"))

    return _rows(s, d).select("sku", F.posexplode(F.aggregate(cells, start, step)["spans"]).alias("cell", "p")).select("sku", "cell", "p.start", "p.end")


def composed_units(s, d) -> DataFrame:
    """A bare number takes the unit that its column's header states; a value with a unit stays as it is."""
    headers = {"rated_current": "Rated current [A]", "weight": "Weight (kg)", "poles": "Poles", "packaging_uom": "Unit"}
    unit = F.regexp_extract(V.lookup(headers, F.col("attr")), r"[\[(]([A-Za-z]+)[\])]", 1)
    bare = F.col("value").rlike(r"^[0-9]+(\.[0-9]+)?$")
    return _cells(s, d).filter("value IS NOT NULL").select("attr", "value").distinct().select("attr", "value", F.when(bare & (unit != ""), F.concat_ws(" ", "value", unit)).otherwise(F.col("value")).alias("composed"))


def canonical_uris(s, d) -> DataFrame:
    """Any alias of an attribute to its one uri; unknown terms say that they are the customer's own."""
    alias = {"rated current": "etim:EF000227", "rated_current": "etim:EF000227", "in": "etim:EF000227", "poles": "etim:EF000003", "number of poles": "etim:EF000003"}
    return _cells(s, d).groupBy("attr").agg(F.count("*").alias("cells")).select("attr", "cells", F.coalesce(V.lookup(alias, F.lower("attr")), F.concat(F.lit("customer:"), "attr")).alias("uri"))


def closed_list(s, d) -> DataFrame:
    """Values outside the attribute's permitted list, where it has one."""
    allowed = s.sql("SELECT 'packaging_uom' AS attr, explode(array('EA', 'Each', 'Box of 10')) AS value UNION ALL SELECT 'poles', explode(array('1', '2', '3', '4', '1P', '2P', '3P', '4P'))")
    listed = allowed.select("attr").distinct()
    stated = _cells(s, d).filter(F.trim("value") != "").join(listed, "attr", "left_semi")
    return stated.join(allowed, ["attr", "value"], "left_anti").groupBy("attr", "value").agg(F.count("*").alias("n"))


def materials(s, d) -> DataFrame:
    """The last word of a part's type as a material: group and family by folded alias."""
    key = V.folded(F.element_at(F.split("p_type", " "), -1))
    return T.table(s, d, "part").groupBy(key.alias("alias")).agg(F.count("*").alias("parts")).select("alias", "parts", V.lookup({k: g for k, (g, _) in MATERIALS.items()}, F.col("alias")).alias("grp"), V.lookup({k: f for k, (_, f) in MATERIALS.items()}, F.col("alias")).alias("family"))


def labelled_pairs(s, d) -> DataFrame:
    """Pairs of values built with a known relation: equal in another unit, ten times as much, another dimension."""
    p = T.table(s, d, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("n"))
    pairs = F.explode(F.array(
        F.struct(F.concat("n", F.lit(" A")).alias("a"), F.concat((F.col("n") * 1000).cast("string"), F.lit(" mA")).alias("b"), F.lit("agree").alias("expect")),
        F.struct(F.concat("n", F.lit(" A")).alias("a"), F.concat((F.col("n") * 10).cast("string"), F.lit(" A")).alias("b"), F.lit("finding").alias("expect")),
        F.struct(F.concat("n", F.lit(" A")).alias("a"), F.concat("n", F.lit(" kg")).alias("b"), F.lit("abstain").alias("expect")),
    )).alias("q")
    out = p.select("p_partkey", pairs).select("p_partkey", "q.*").withColumn("attr", F.lit("rated_current"))
    out = out.withColumns({"x": V.normalised(F.col("attr"), F.col("a")), "y": V.normalised(F.col("attr"), F.col("b"))})
    rel = V.relation(F.col("x"), F.col("y"), F.col("a"), F.col("b"))
    got = F.when(rel == "incomparable", "abstain").when(rel == "contradiction", "finding").otherwise("agree")
    return out.select("p_partkey", "a", "b", "expect", got.alias("got"))


def suite_outcomes(s, d) -> DataFrame:
    p = labelled_pairs(s, d)
    outcome = F.when(F.col("got") == F.col("expect"), "pass").when(F.col("got") == "abstain", "unexpected_abstention").when(F.col("expect") == "finding", "false_negative").when(F.col("got") == "finding", "false_positive").otherwise("over_resolved")
    return p.groupBy("expect", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def independent_quantity(s, d) -> DataFrame:
    """A second opinion by whole-number cross multiplication: equal iff n1 * f1 = n2 * f2."""
    p = labelled_pairs(s, d)
    n = lambda c: F.regexp_extract(c, "^([0-9]+)", 1).cast("bigint")
    u = lambda c: F.regexp_extract(c, "([A-Za-z]+)$", 1)
    f = lambda c: F.when(u(c) == "mA", 1).otherwise(1000)
    judge = F.when((u("a") == "kg") | (u("b") == "kg"), "cannot_judge").when(n("a") * f("a") == n("b") * f("b"), "equal").otherwise("different")
    return p.select("a", "b", judge.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


def in_range(s, d) -> DataFrame:
    """Sibling quantities within ten percent of the part's declared current: an interval predicate on whole numbers."""
    cells = T.written(_cells(s, d).filter("attr = 'rated_current' AND value IS NOT NULL"), "currents")
    cells = cells.join(S.dictionary(cells), ["attr", "value"]).filter("v.dim = 'current'")
    centre = (6 + F.pmod(F.regexp_extract("mpn", "^P([0-9]+)", 1).cast("bigint"), F.lit(10)) * 4) * 10**9
    inside = (F.col("v.mag") + F.col("v.half") >= centre * 9 / 10) & (F.col("v.mag") - F.col("v.half") <= centre * 11 / 10)
    return cells.groupBy(inside.alias("inside")).agg(F.count("*").alias("n"))


def policy(s, d) -> DataFrame:
    """One claim per part and attribute wins: agreement, then the majority (rank), safety attributes never by themselves."""
    g = S.modal_values(_cells(s, d))
    rule = (
        F.when(F.col("n_values") == 1, "single_claim").when(V.is_safety(F.col("attr")), "safety_escalation")
        .when(F.col("modal_n") > F.col("runner_up"), "rank").otherwise("abstain")
    )
    return g.groupBy("attr", rule.alias("rule")).agg(F.count("*").alias("n"))


def volatile_free(s, d) -> DataFrame:
    """A digest of the outcomes without their ids and clocks that doesn't depend on row order."""
    o = S.all_outcomes(S.written_cells(s, d)).select("attr", "check", "outcome", "value", "proposed")
    return o.groupBy("check").agg(F.count("*").alias("n"), F.sum(F.conv(F.substr(F.md5(F.concat_ws("|", "attr", "outcome", "value", F.coalesce("proposed", F.lit("")))), F.lit(1), F.lit(8)), 16, 10).cast("bigint")).alias("digest"))


QUERIES = {
    "src_record_from_row": lambda s, d: records(_rows(s, d)).select("sku", F.size("attributes").alias("n_attributes"), F.element_at("attributes", "weight").alias("weight")),
    "src_catalog_delimited": csv_feed,
    "src_catalog_json": json_feed,
    "src_feed_spans": feed_spans,
    "src_distribution": lambda s, d: T.view(s, d, "fx_classes").select("class_id", F.coalesce("parent_id", F.lit("")).alias("parent"), "skus"),
    "src_eval_corpus": lambda s, d: T.view(s, d, "fx_eval").select("id", F.format_string("%d:%d", F.col("gx0").cast("int"), F.col("gy0").cast("int")).alias("box")).select("id", F.split("box", ":")[0].cast("double").alias("x0"), F.split("box", ":")[1].cast("double").alias("y0")),
    "src_gold_annotations": lambda s, d: T.view(s, d, "fx_eval").groupBy("method").agg(F.count("*").alias("annotations"), F.min("id").alias("first")),
    "src_reviewer_sessions": lambda s, d: T.view(s, d, "fx_ledger").filter("kind IN ('accept', 'keep', 'escalate')").select("event_id", "sku", F.coalesce(F.when(F.col("attr") == "a1", "expert"), F.lit("implementer")).alias("role"), "seconds"),
    "flt_audited_attributes": lambda s, d: _cells(s, d).filter("value IS NOT NULL").select("attr").distinct(),
    "prj_attribute_uri": canonical_uris,
    "prj_canonical_uri": lambda s, d: canonical_uris(s, d).select("attr", "uri"),
    "flt_vocabulary_violations": lambda s, d: canonical_uris(s, d).filter("NOT (uri LIKE 'etim:%')").select("attr", "uri"),
    "prj_compose_unit": composed_units,
    "flt_closed_list": closed_list,
    "flt_evidence_required": lambda s, d: _rows(s, d).groupBy((F.coalesce(F.trim("datasheet"), F.lit("")) != "").alias("has_evidence")).agg(F.count("*").alias("records")),
    "prj_blind_query": lambda s, d: _rows(s, d).select("sku", F.lower(F.concat_ws(" ", "mpn", "description")).alias("query")),
    "fx_blind_packet": lambda s, d: labelled_pairs(s, d).select("p_partkey", "a", "b"),
    "join_alias_lookup": materials,
    "norm_material": materials,
    "join_quantity_in_range": in_range,
    "agg_suite_outcomes": suite_outcomes,
    "cmp_independent_quantity": independent_quantity,
    "audit_modal_policy": policy,
    "prj_volatile_strip": volatile_free,
    "top_limit_records": lambda s, d: _rows(s, d).orderBy("feed_row", "feed_line").limit(100).select("sku", "mpn"),
}

_PAIR = "p AS (SELECT p_partkey, a, b, expect FROM (SELECT p_partkey, p_size || ' A' AS a, CAST(p_size AS BIGINT) * 1000 || ' mA' AS b, 'agree' AS expect FROM part UNION ALL SELECT p_partkey, p_size || ' A', CAST(p_size AS BIGINT) * 10 || ' A', 'finding' FROM part UNION ALL SELECT p_partkey, p_size || ' A', p_size || ' kg', 'abstain' FROM part))"
_SUITE = f"""{_PAIR}, strings AS (SELECT 'rated_current' AS attr, a AS value FROM p UNION ALL SELECT 'rated_current', b FROM p), {S.norm_sql("strings")},
rel AS (SELECT p.*, {S.relation_sql("x", "y")} AS relation FROM p JOIN norm x ON x.value = p.a JOIN norm y ON y.value = p.b),
got AS (SELECT *, CASE relation WHEN 'incomparable' THEN 'abstain' WHEN 'contradiction' THEN 'finding' ELSE 'agree' END AS got FROM rel),
suite AS (SELECT expect, CASE WHEN got = expect THEN 'pass' WHEN got = 'abstain' THEN 'unexpected_abstention' WHEN expect = 'finding' THEN 'false_negative' WHEN got = 'finding' THEN 'false_positive' ELSE 'over_resolved' END AS outcome, count(*) AS n FROM got GROUP BY 1, 2)"""
_URI = "u AS (SELECT attr, count(*) AS cells, CASE attr WHEN 'rated_current' THEN 'etim:EF000227' WHEN 'poles' THEN 'etim:EF000003' ELSE 'customer:' || attr END AS uri FROM cat_cells GROUP BY 1)"
_FOLD = r"regexp_replace(lower(string_split(p_type, ' ')[-1]), '[\s\-_]+', '', 'g')"
_MAT = ", ".join(f"('{k}', '{g}', '{f}')" for k, (g, f) in MATERIALS.items())
_MATERIAL = f"SELECT x.alias, parts, grp, family FROM (SELECT {_FOLD} AS alias, count(*) AS parts FROM part GROUP BY 1) x LEFT JOIN (VALUES {_MAT}) m(alias, grp, family) ON x.alias = m.alias"

ORACLES = {k: T.with_views(q) for k, q in {
    "src_record_from_row": "SELECT sku, CAST((description IS NOT NULL)::INT + (rated_current IS NOT NULL)::INT + (poles IS NOT NULL)::INT + (packaging_uom IS NOT NULL)::INT + (weight IS NOT NULL)::INT AS INT) AS n_attributes, weight FROM cat_rows",
    "prj_volatile_strip": f"""WITH {S.OUTCOMES_SQL} SELECT "check", count(*) AS n, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', attr, outcome, value, coalesce(proposed, ''))), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM outcomes GROUP BY 1""",
    "src_catalog_delimited": "SELECT sku, mpn, rated_current, weight FROM cat_rows",
    "src_catalog_json": "SELECT sku, mpn, rated_current FROM cat_rows",
    "src_feed_spans": "WITH c AS (SELECT sku, length(sku) AS a, length(mpn) AS b, length(coalesce(weight, '')) AS w FROM cat_rows) SELECT sku, 0 AS cell, 1 AS start, 1 + a AS \"end\" FROM c UNION ALL SELECT sku, 1, 2 + a, 2 + a + b FROM c UNION ALL SELECT sku, 2, 3 + a + b, 3 + a + b + w FROM c",
    "src_distribution": "SELECT class_id, coalesce(parent_id, '') AS parent, skus FROM fx_classes",
    "src_eval_corpus": "SELECT id, gx0 AS x0, gy0 AS y0 FROM fx_eval",
    "src_gold_annotations": "SELECT method, count(*) AS annotations, min(id) AS first FROM fx_eval GROUP BY 1",
    "src_reviewer_sessions": "SELECT event_id, sku, CASE attr WHEN 'a1' THEN 'expert' ELSE 'implementer' END AS role, seconds FROM fx_ledger WHERE kind IN ('accept', 'keep', 'escalate')",
    "flt_audited_attributes": "SELECT DISTINCT attr FROM cat_cells WHERE value IS NOT NULL",
    "prj_attribute_uri": f"WITH {_URI} SELECT * FROM u",
    "prj_canonical_uri": f"WITH {_URI} SELECT attr, uri FROM u",
    "flt_vocabulary_violations": f"WITH {_URI} SELECT attr, uri FROM u WHERE uri NOT LIKE 'etim:%'",
    "prj_compose_unit": r"SELECT DISTINCT attr, value, CASE WHEN regexp_matches(value, '^[0-9]+(\.[0-9]+)?$') AND attr IN ('rated_current', 'weight') THEN value || CASE attr WHEN 'weight' THEN ' kg' ELSE ' A' END ELSE value END AS composed FROM cat_cells WHERE value IS NOT NULL",
    "flt_closed_list": "SELECT attr, value, count(*) AS n FROM cat_cells WHERE trim(value) <> '' AND (attr = 'packaging_uom' AND value NOT IN ('EA', 'Each', 'Box of 10') OR attr = 'poles' AND value NOT IN ('1', '2', '3', '4', '1P', '2P', '3P', '4P')) GROUP BY 1, 2",
    "flt_evidence_required": "SELECT coalesce(trim(datasheet), '') <> '' AS has_evidence, count(*) AS records FROM cat_rows GROUP BY 1",
    "prj_blind_query": "SELECT sku, lower(mpn || ' ' || description) AS query FROM cat_rows",
    "fx_blind_packet": f"WITH {_PAIR} SELECT p_partkey, a, b FROM p",
    "join_alias_lookup": _MATERIAL,
    "norm_material": _MATERIAL,
    "join_quantity_in_range": f"WITH {S.norm_sql('cat_cells')}, q AS (SELECT mag, half, (6 + CAST(regexp_extract(mpn, '^P([0-9]+)', 1) AS BIGINT) % 10 * 4) * 1000000000 AS c FROM cat_cells JOIN norm USING (attr, value) WHERE attr = 'rated_current' AND dim = 'current') SELECT mag + half >= c * 9 / 10 AND mag - half <= c * 11 / 10 AS inside, count(*) AS n FROM q GROUP BY 1",
    "agg_suite_outcomes": f"WITH {_SUITE} SELECT * FROM suite",
    "cmp_independent_quantity": f"WITH {_PAIR}, q AS (SELECT split_part(a, ' ', 1)::BIGINT * CASE split_part(a, ' ', 2) WHEN 'mA' THEN 1 WHEN 'A' THEN 1000 END AS x, split_part(b, ' ', 1)::BIGINT * CASE split_part(b, ' ', 2) WHEN 'mA' THEN 1 WHEN 'A' THEN 1000 END AS y FROM p) SELECT CASE WHEN x = y THEN 'equal' WHEN x <> y THEN 'different' ELSE 'cannot_judge' END AS verdict, count(*) AS n FROM q GROUP BY 1",
    "audit_modal_policy": f"WITH {S.MODAL_SQL} SELECT attr, CASE WHEN n_values = 1 THEN 'single_claim' WHEN attr IN ('rated_current', 'packaging_uom') THEN 'safety_escalation' WHEN modal_n > runner_up THEN 'rank' ELSE 'abstain' END AS rule, count(*) AS n FROM modal GROUP BY 1, 2",
    "top_limit_records": "SELECT sku, mpn FROM cat_rows ORDER BY feed_row, feed_line LIMIT 100",
}.items()}
