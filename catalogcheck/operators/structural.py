"""Checks that need no document: the rows of one feed against each other.

Cells are aggregated to (part, attribute, value, count) before anything is compared, so a part with very many rows
costs one row per value and task, and members are joined back only where an outcome names them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources import tables as T

GROUP = ("manufacturer", "mpn", "attr")


def group_of(frame: DataFrame) -> list[str]:
    """GROUP, with the columns by which rows that are alike are dealt where the frame has them."""
    return [*(c for c in ("part", "turn") if c in frame.columns), *GROUP]


def cells_long(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """One row per record and attribute; null (no such column) stays null."""
    return rows.unpivot(["sku", "mpn", "manufacturer"], attributes, "attr", "value")


def sibling_groups(rows: DataFrame) -> DataFrame:
    """Parts that more than one record states, blank part numbers left out; case and spaces don't tell parts apart."""
    key = F.lower(F.trim("mpn"))
    return rows.filter(F.trim("mpn") != "").groupBy("manufacturer", key.alias("mpn")).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def value_counts(cells: DataFrame) -> DataFrame:
    """How often each group states each value, blank cells among them; one row for each value leaves a task. Cells with n stand for so many."""
    n = F.sum("n") if "n" in cells.columns else F.count("*")
    return cells.filter("value IS NOT NULL AND manufacturer IS NOT NULL AND mpn IS NOT NULL").groupBy(*group_of(cells), "value").agg(n.alias("n"))


def with_modal(counted: DataFrame) -> DataFrame:
    """Every counted value beside its group's modal one (ties: shortest, then last), the modal count, the runner-up's and the
    number of stated values: one exchange by group, over distinct values only."""
    stated = F.trim("value") != ""
    order = Window.partitionBy(*group_of(counted)).orderBy(F.desc(stated), F.desc("n"), F.length("value"), F.desc("value"))
    all_ = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = counted.withColumns({
        "modal": F.first(F.when(stated, F.col("value"))).over(all_), "modal_n": F.first(F.when(stated, F.col("n"))).over(all_),
        "runner_up": F.coalesce(F.nth_value(F.when(stated, F.col("n")), 2).over(all_), F.lit(0)), "n_values": F.count(F.when(stated, F.lit(1))).over(all_),
    })
    return out.filter("modal IS NOT NULL")


def modal_values(cells: DataFrame) -> DataFrame:
    """Per group: the modal raw value, its count, the runner-up's count, distinct values."""
    return with_modal(value_counts(cells)).filter("value = modal").select(*GROUP, "modal", "modal_n", "runner_up", "n_values")


def dictionary(values: DataFrame) -> DataFrame:
    """attr, value, v: each different value normalised once; written, so that what compares values reads structs and no patterns."""
    return T.written(values.select("attr", "value").distinct().withColumn("v", V.normalised(F.col("attr"), F.col("value"))), "dictionary")


def compared_values(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """The different pairs (attr, x, y) with a, b (normalised), relation and c (class, raises, severity)."""
    pairs = pairs.select("attr", x, y).distinct()
    norm = dictionary(pairs.select("attr", F.col(x).alias("value")).union(pairs.select("attr", F.col(y).alias("value"))))
    return compared_beside(pairs, norm, x, y)


def compared_beside(rows: DataFrame, norm: DataFrame, x: str, y: str) -> DataFrame:
    """``rows`` (attr, x, y) with a, b, relation and c as of compared_values, by a dictionary that has all of their values: where it
    is small, no row moves."""
    both = rows.join(norm.toDF("attr", x, "a"), ["attr", x]).join(norm.toDF("attr", y, "b"), ["attr", y])
    both = both.withColumn("relation", V.relation(F.col("a"), F.col("b"), F.col(x), F.col(y)))
    return both.withColumn("c", V.classified(F.col("relation"), F.coalesce("a.kind", "b.kind")))


def judged(counted: DataFrame, norm: DataFrame | None = None) -> DataFrame:
    """Every value of ``counted`` against its group's modal one: relation, class, severity, refusal, whether the group ties. With a
    dictionary of all its values (``norm``) nothing is written."""
    if norm is None:
        valued = T.written(with_modal(counted), "valued")
        pairs = valued.join(compared_values(valued, "value", "modal"), ["attr", "value", "modal"])
    else:
        pairs = compared_beside(with_modal(counted), norm, "value", "modal")
    group = group_of(counted)
    stated = F.trim("value") != ""
    real = F.max((F.col("c.raises") & stated & (F.col("value") != F.col("modal"))).cast("int")).over(Window.partitionBy(*group)) == 1
    tie = (F.col("n_values") > 1) & (F.col("modal_n") <= F.col("runner_up")) & real
    return pairs.select(*group, "value", "n", "modal", "modal_n", "n_values", "relation", F.col("c.cls").alias("cls"), F.col("c.raises").alias("raises"), F.col("c.severity").alias("severity"), F.coalesce("a.refusal", "b.refusal").alias("refusal"), F.col("a.dim").alias("dim"), tie.alias("tie"))


def judged_values(cells: DataFrame) -> DataFrame:
    """Every stated value of a group against the modal one."""
    return judged(value_counts(cells)).filter(F.trim("value") != "")


def verdicts(cells: DataFrame, norm: DataFrame | None = None) -> DataFrame:
    """GROUP, value, n, outcomes: what is said of every value that a group states, judged once however many cells have it."""
    tie, n_values, undetermined = F.col("tie"), F.col("n_values"), F.col("cls") == "undetermined"
    check = (
        F.when(tie, "sibling_equal_rank").when(n_values == 1, "sibling_agreement").when(F.col("value") == F.col("modal"), None)
        .when(undetermined | F.col("raises"), "sibling_contradiction").otherwise("sibling_agreement")
    )
    outcome = F.when(tie, "declined").when(n_values == 1, "resolved").when(undetermined, "declined").when(F.col("raises"), "finding").otherwise("resolved")
    reason = F.when(tie, "equal_rank_source_conflict").when((n_values > 1) & undetermined, "value_outside_known_grammar")
    found = outcome == "finding"

    def said(check, outcome, proposed=None, cls=None, severity=None, reason=None):
        parts = {"check": check, "outcome": outcome, "proposed": proposed, "cls": cls, "severity": severity, "reason": reason}
        return F.struct(*[(F.lit(None) if c is None else c).cast("int" if k == "severity" else "string").alias(k) for k, c in parts.items()])

    stated = F.trim("value") != ""
    sibling = F.when(stated & check.isNotNull(), said(check, outcome, F.when(found, F.col("modal")), F.when(found, F.col("cls")), F.when(found, F.col("severity")).otherwise(9), reason))
    gap = F.when(~stated, said(F.lit("fill_gap"), F.lit("finding"), F.col("modal"), F.lit("catalog_null_evidence_present"), F.lit(2)))
    declared = declared_and_found()[0]
    odd = F.when((declared != "") & (F.col("dim") != declared), said(F.lit("unit_dimension"), F.lit("finding"), None, F.lit("contradiction"), F.lit(1)))
    return judged(value_counts(cells), norm).select(*group_of(cells), "value", "n", F.array_compact(F.array(sibling, gap, odd)).alias("outcomes")).filter(F.size("outcomes") > 0)


def declared_and_found():
    """The dimension that an attribute's header declares ('' for none) and that of the value."""
    return V.lookup({k: d or "" for k, (_, d) in V.ATTRIBUTES.items()}, F.col("attr")), V.quantity(F.col("value"))["dim"]


def wrong_dimension(cells: DataFrame) -> DataFrame:
    """Quantities whose unit has another dimension than the attribute's header declares."""
    declared, found = declared_and_found()
    return cells.withColumns({"declared": declared, "found": found}).filter("declared <> '' AND found <> declared").select("sku", "attr", "value", "found", "declared")


def all_outcomes(cells: DataFrame) -> DataFrame:
    """sku, attr, check, outcome, value, proposed, cls, severity, reason for every cell that a check speaks to. ``cells`` is read
    twice: to count its values and to name the cells that have them."""
    told = cells.join(verdicts(cells).drop("n"), [*GROUP, "value"]).select("sku", "attr", "value", F.explode("outcomes").alias("o"))
    return told.select("sku", "attr", "o.check", "o.outcome", "value", "o.proposed", "o.cls", "o.severity", "o.reason")


def outcome_counts(cells: DataFrame) -> DataFrame:
    """check, outcome, reason, n: from the counts of values, without a look at the cells again."""
    told = verdicts(cells).select("n", F.explode("outcomes").alias("o"))
    return told.groupBy("o.check", "o.outcome", "o.reason").agg(F.sum("n").alias("n"))


# --- the same in SQL -------------------------------------------------------------------------------------------

_UNITS = ", ".join(f"('{u}', '{d}', {f})" for u, (d, f) in V.UNITS.items())
_RELATIONS = ", ".join(f"('{r}', '{c}', {str(f).lower()}, {s})" for r, (c, f, s) in V.RELATIONS.items())
_NULLISH = ", ".join(f"'{x}'" for x in V.NULLISH)
_Q = r"^\s*([+-]?)([0-9]+)(\.([0-9]+))?\s*([A-Za-z]+)\s*$"


def norm_sql(source: str) -> str:
    """CTEs ``units`` and ``norm`` (attr, value and the normalised columns) over distinct pairs of ``source``."""
    return rf"""units(unit, dim, one) AS (VALUES {_UNITS}),
parsed AS (
  SELECT attr, value, regexp_extract(value, '{_Q}', 1) AS sg, regexp_extract(value, '{_Q}', 2) AS ip, regexp_extract(value, '{_Q}', 4) AS fp, regexp_extract(value, '{_Q}', 5) AS u,
    regexp_extract(trim(value), '^([0-9]+)[Pp]?$', 1) AS cnt, lower(trim(value)) AS low,
    CASE attr WHEN 'rated_current' THEN 'quantity' WHEN 'weight' THEN 'quantity' WHEN 'poles' THEN 'count' ELSE 'packaging' END AS k
  FROM (SELECT DISTINCT attr, value FROM {source} WHERE value IS NOT NULL)
), looked AS (
  SELECT p.*, d.dim AS qdim, one, (CASE WHEN sg = '-' THEN -1 ELSE 1 END) * (TRY_CAST(TRY_CAST(ip || fp AS BIGINT)::HUGEINT * one AS BIGINT) // CAST(pow(10, length(fp)) AS BIGINT)) AS qmag, one // (2 * CAST(pow(10, length(fp)) AS BIGINT)) AS qhalf,
    CASE WHEN regexp_matches(low, '^(box|pack|carton|bag|set)\s+of\s+([0-9]+)$') THEN regexp_extract(low, '^(box|pack|carton|bag|set)\s+of\s+([0-9]+)$', 1) WHEN regexp_matches(low, '^([0-9]+)\s*(pcs|pc|pieces|piece)$') OR low IN ('ea', 'each', 'pc', 'piece') THEN 'each' END AS box,
    CASE WHEN regexp_matches(low, '^(box|pack|carton|bag|set)\s+of\s+([0-9]+)$') THEN TRY_CAST(regexp_extract(low, '^(box|pack|carton|bag|set)\s+of\s+([0-9]+)$', 2) AS BIGINT) WHEN regexp_matches(low, '^([0-9]+)\s*(pcs|pc|pieces|piece)$') THEN TRY_CAST(regexp_extract(low, '^([0-9]+)', 1) AS BIGINT) WHEN low IN ('ea', 'each', 'pc', 'piece') THEN 1 END AS box_n
  FROM parsed p LEFT JOIN units d ON p.u = d.unit AND p.ip <> '' AND length(p.fp) <= 9
), norm AS (
  SELECT attr, value, CASE WHEN low IN ({_NULLISH}) THEN 'empty' WHEN k = 'quantity' AND qdim IS NOT NULL AND qmag IS NULL THEN 'out_of_range' WHEN k = 'quantity' AND qdim IS NULL OR k = 'count' AND TRY_CAST(nullif(cnt, '') AS BIGINT) IS NULL OR k = 'packaging' AND box_n IS NULL THEN 'no_grammar_match' END AS refusal,
    k AS kind, qdim AS dim, CASE WHEN k = 'quantity' THEN u END AS unit, CASE k WHEN 'quantity' THEN qmag WHEN 'count' THEN TRY_CAST(nullif(cnt, '') AS BIGINT) ELSE box_n END AS mag,
    CASE WHEN k = 'quantity' THEN qhalf ELSE 0 END AS half, box AS container
  FROM looked
), relations(relation, cls, raises, severity) AS (VALUES {_RELATIONS})"""


def relation_sql(a: str, b: str) -> str:
    return f"""CASE WHEN {a}.refusal IS NOT NULL OR {b}.refusal IS NOT NULL OR {a}.kind <> {b}.kind THEN 'incomparable'
  WHEN {a}.kind = 'quantity' THEN CASE WHEN {a}.dim <> {b}.dim THEN 'incomparable' WHEN abs({a}.mag - {b}.mag) <= {a}.half + {b}.half THEN CASE WHEN {a}.unit = {b}.unit THEN 'equivalent' ELSE 'equivalent_unit_frame' END ELSE 'contradiction' END
  WHEN {a}.mag <> {b}.mag OR {a}.kind = 'packaging' AND {a}.container <> {b}.container THEN 'contradiction'
  WHEN lower(trim({a}.value)) = lower(trim({b}.value)) THEN 'equivalent' ELSE 'equivalent_vocabulary' END"""


MODAL_SQL = """counted AS (SELECT manufacturer, mpn, attr, value, count(*) AS n FROM cat_cells WHERE trim(value) <> '' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY manufacturer, mpn, attr ORDER BY n DESC, length(value), value DESC) AS k FROM counted),
modal AS (SELECT manufacturer, mpn, attr, max(value) FILTER (k = 1) AS modal, max(n) FILTER (k = 1) AS modal_n, coalesce(max(n) FILTER (k = 2), 0) AS runner_up, count(*) AS n_values FROM ranked GROUP BY ALL)"""

JUDGED_SQL = f"""{MODAL_SQL}, {norm_sql("cat_cells")},
compared AS (SELECT c.*, m.modal, m.modal_n, m.runner_up, m.n_values, {relation_sql("a", "b")} AS relation, a.kind, coalesce(a.refusal, b.refusal) AS refusal
  FROM counted c JOIN modal m USING (manufacturer, mpn, attr) JOIN norm a ON a.attr = c.attr AND a.value = c.value JOIN norm b ON b.attr = c.attr AND b.value = m.modal),
classed AS (SELECT x.*, CASE WHEN relation = 'contradiction' AND kind = 'packaging' THEN 'packaging_frame_error' ELSE cls END AS cls, raises, severity FROM compared x JOIN relations USING (relation)),
judged AS (SELECT *, n_values > 1 AND modal_n <= runner_up AND bool_or(raises AND value <> modal) OVER (PARTITION BY manufacturer, mpn, attr) AS tie FROM classed)"""

OUTCOMES_SQL = f"""{JUDGED_SQL},
verdict AS (SELECT *, CASE WHEN tie THEN 'sibling_equal_rank' WHEN n_values = 1 THEN 'sibling_agreement' WHEN value = modal THEN NULL WHEN cls = 'undetermined' OR raises THEN 'sibling_contradiction' ELSE 'sibling_agreement' END AS chk,
  CASE WHEN tie THEN 'declined' WHEN n_values = 1 THEN 'resolved' WHEN cls = 'undetermined' THEN 'declined' WHEN raises THEN 'finding' ELSE 'resolved' END AS outcome,
  CASE WHEN tie THEN 'equal_rank_source_conflict' WHEN n_values > 1 AND cls = 'undetermined' THEN 'value_outside_known_grammar' END AS reason FROM judged),
outcomes AS (
  SELECT sku, c.attr, chk AS "check", outcome, c.value, CASE WHEN outcome = 'finding' THEN modal END AS proposed, CASE WHEN outcome = 'finding' THEN cls END AS cls, CASE WHEN outcome = 'finding' THEN severity ELSE 9 END AS severity, reason
  FROM cat_cells c JOIN verdict v ON c.manufacturer = v.manufacturer AND c.mpn = v.mpn AND c.attr = v.attr AND c.value = v.value WHERE chk IS NOT NULL
  UNION ALL
  SELECT sku, attr, 'fill_gap', 'finding', value, modal, 'catalog_null_evidence_present', 2, NULL FROM cat_cells JOIN modal USING (manufacturer, mpn, attr) WHERE trim(value) = ''
  UNION ALL
  SELECT sku, attr, 'unit_dimension', 'finding', value, NULL, 'contradiction', 1, NULL FROM cat_cells JOIN norm USING (attr, value)
  WHERE kind = 'quantity' AND refusal IS NULL AND dim <> CASE attr WHEN 'rated_current' THEN 'current' ELSE 'mass' END
)"""


def _cells(spark, sf):
    return T.view(spark, sf, "cat_cells")


def written_cells(spark, sf):
    """The cells, written once for queries that read them again."""
    return T.written(_cells(spark, sf), "cells")


def _outcomes(spark, sf, check, outcome=None):
    out = all_outcomes(written_cells(spark, sf)).filter(F.col("check") == check)
    return out if outcome is None else out.filter(F.col("outcome") == outcome)


def norm_job(spark, sf):
    """Every distinct cell value normalised once."""
    n = V.normalised(F.col("attr"), F.col("value"))
    return _cells(spark, sf).filter("value IS NOT NULL").select("attr", "value").distinct().withColumn("n", n).select("attr", "value", "n.kind", "n.dim", "n.unit", "n.mag", "n.half", "n.container", "n.refusal")


def compare_pairs(spark, sf, swap=False):
    """Every pair of values stated for one part and attribute, compared."""
    counted = value_counts(_cells(spark, sf)).filter(F.trim("value") != "")
    # groups that state the same values become one before any pair is built
    lists = counted.groupBy(*GROUP).agg(F.array_sort(F.collect_set("value")).alias("vs")).filter(F.size("vs") > 1).select("attr", "vs").distinct()
    each = lists.select("attr", "vs", F.explode("vs").alias("va"))
    pairs = each.select("attr", "va", F.explode(F.filter("vs", lambda x: x > F.col("va"))).alias("vb")).distinct()
    x, y = ("vb", "va") if swap else ("va", "vb")
    return compared_values(T.written(pairs, "value-pairs"), x, y)


def cmp_attribute(spark, sf):
    return compare_pairs(spark, sf).select("attr", "va", "vb", "relation", F.col("c.cls").alias("cls"), F.col("c.severity").alias("severity"))


def cmp_swap_symmetry(spark, sf):
    """Pairs whose relation isn't the mirror image when the sides change places: none may be left."""
    mirror = {"a_more_specific": "b_more_specific", "b_more_specific": "a_more_specific", "a_precision_loss": "b_precision_loss", "b_precision_loss": "a_precision_loss"}
    one = compare_pairs(spark, sf).select("attr", "va", "vb", "relation")
    two = compare_pairs(spark, sf, swap=True).select("attr", "va", "vb", F.col("relation").alias("back"))
    expected = F.coalesce(V.lookup(mirror, F.col("relation")), F.col("relation"))
    return one.join(two, ["attr", "va", "vb"]).groupBy("relation").agg(F.count("*").alias("pairs"), F.sum((F.col("back") != expected).cast("long")).alias("broken"))


PAIRS_SQL = f"""{norm_sql("cat_cells")}, counted AS (SELECT DISTINCT manufacturer, mpn, attr, value FROM cat_cells WHERE trim(value) <> ''),
pairs AS (SELECT DISTINCT x.attr, x.value AS va, y.value AS vb FROM counted x JOIN counted y ON x.manufacturer = y.manufacturer AND x.mpn = y.mpn AND x.attr = y.attr AND x.value < y.value),
compared AS (SELECT p.*, {relation_sql("a", "b")} AS relation, a.kind FROM pairs p JOIN norm a ON a.attr = p.attr AND a.value = p.va JOIN norm b ON b.attr = p.attr AND b.value = p.vb)"""


def kind_query(kind):
    def run(spark, sf):
        return compare_pairs(spark, sf).filter(F.coalesce("a.kind", "b.kind") == kind).select("attr", "va", "vb", "relation")

    return run


def kind_sql(kind):
    attrs = ", ".join(f"'{a}'" for a, (k, _) in V.ATTRIBUTES.items() if k == kind)
    return T.with_views(f"WITH {PAIRS_SQL} SELECT attr, va, vb, relation FROM compared c WHERE attr IN ({attrs}) AND EXISTS (SELECT 1 FROM norm n WHERE n.attr = c.attr AND n.value IN (c.va, c.vb) AND n.refusal IS NULL)")


OUT_COLS = 'sku, attr, "check", outcome, value, proposed, cls, severity, reason'

QUERIES = {
    "src_cells_long": lambda s, d: cells_long(T.view(s, d, "cat_rows"), ["rated_current", "poles", "packaging_uom", "weight"]),
    "agg_group_by_mpn": lambda s, d: sibling_groups(T.view(s, d, "cat_rows")),
    "agg_modal_value": lambda s, d: modal_values(_cells(s, d)),
    "join_sibling_pairs": lambda s, d: judged_values(_cells(s, d)).filter("value <> modal").select(*GROUP, "value", "n", "modal", "relation", "cls", "tie"),
    "t0_sibling_agreement": lambda s, d: _outcomes(s, d, "sibling_agreement"),
    "t0_sibling_contradiction": lambda s, d: _outcomes(s, d, "sibling_contradiction"),
    "t0_fill_gap": lambda s, d: _outcomes(s, d, "fill_gap"),
    "t0_equal_rank": lambda s, d: _outcomes(s, d, "sibling_equal_rank"),
    "flt_unit_dimension": lambda s, d: wrong_dimension(_cells(s, d)),
    "t0_structural_run": lambda s, d: outcome_counts(_cells(s, d)),
    "norm_job": norm_job,
    "norm_quantity": lambda s, d: norm_job(s, d).filter("kind = 'quantity'").select("value", "dim", "unit", "mag", "half"),
    "norm_packaging": lambda s, d: norm_job(s, d).filter("attr = 'packaging_uom'").select("value", "container", "mag", "refusal"),
    "join_value_dictionary": lambda s, d: _cells(s, d).join(norm_job(s, d), ["attr", "value"]).groupBy("attr", "refusal").agg(F.count("*").alias("cells"), F.countDistinct("value").alias("values")),
    "cmp_attribute": cmp_attribute,
    "cmp_quantity": kind_query("quantity"),
    "cmp_packaging": kind_query("packaging"),
    "cmp_swap_symmetry": cmp_swap_symmetry,
}

ORACLES = {k: T.with_views(q) for k, q in {
    "src_cells_long": "SELECT sku, mpn, manufacturer, attr, value FROM cat_cells",
    "agg_group_by_mpn": "SELECT manufacturer, lower(trim(mpn)) AS mpn, count(*) AS n_rows FROM cat_rows WHERE trim(mpn) <> '' GROUP BY 1, 2 HAVING count(*) > 1",
    "agg_modal_value": f"WITH {MODAL_SQL} SELECT manufacturer, mpn, attr, modal, modal_n, runner_up, n_values FROM modal",
    "join_sibling_pairs": f"WITH {JUDGED_SQL} SELECT manufacturer, mpn, attr, value, n, modal, relation, cls, tie FROM judged WHERE value <> modal",
    "t0_sibling_agreement": f"""WITH {OUTCOMES_SQL} SELECT {OUT_COLS} FROM outcomes WHERE "check" = 'sibling_agreement'""",
    "t0_sibling_contradiction": f"""WITH {OUTCOMES_SQL} SELECT {OUT_COLS} FROM outcomes WHERE "check" = 'sibling_contradiction'""",
    "t0_fill_gap": f"""WITH {OUTCOMES_SQL} SELECT {OUT_COLS} FROM outcomes WHERE "check" = 'fill_gap'""",
    "t0_equal_rank": f"""WITH {OUTCOMES_SQL} SELECT {OUT_COLS} FROM outcomes WHERE "check" = 'sibling_equal_rank'""",
    "flt_unit_dimension": f"WITH {norm_sql('cat_cells')}, d AS (SELECT sku, attr, value, dim AS found, CASE attr WHEN 'rated_current' THEN 'current' ELSE 'mass' END AS declared FROM cat_cells JOIN norm USING (attr, value) WHERE kind = 'quantity' AND refusal IS NULL) SELECT * FROM d WHERE found <> declared",
    "t0_structural_run": f"""WITH {OUTCOMES_SQL} SELECT "check", outcome, reason, count(*) AS n FROM outcomes GROUP BY ALL""",
    "norm_job": f"WITH {norm_sql('cat_cells')} SELECT attr, value, CASE WHEN refusal IS NULL THEN kind END AS kind, CASE WHEN refusal IS NULL THEN dim END AS dim, CASE WHEN refusal IS NULL THEN unit END AS unit, CASE WHEN refusal IS NULL THEN mag END AS mag, CASE WHEN refusal IS NULL THEN half END AS half, CASE WHEN refusal IS NULL THEN container END AS container, refusal FROM norm",
    "norm_quantity": f"WITH {norm_sql('cat_cells')} SELECT value, dim, unit, mag, half FROM norm WHERE kind = 'quantity' AND refusal IS NULL",
    "norm_packaging": f"WITH {norm_sql('cat_cells')} SELECT value, container, mag, refusal FROM norm WHERE attr = 'packaging_uom'",
    "join_value_dictionary": f"WITH {norm_sql('cat_cells')} SELECT attr, refusal, count(*) AS cells, count(DISTINCT value) AS values FROM cat_cells JOIN norm USING (attr, value) GROUP BY ALL",
    "cmp_attribute": f"WITH {PAIRS_SQL} SELECT attr, va, vb, relation, CASE WHEN relation = 'contradiction' AND kind = 'packaging' THEN 'packaging_frame_error' ELSE cls END AS cls, severity FROM compared JOIN relations USING (relation)",
    "cmp_swap_symmetry": f"WITH {PAIRS_SQL} SELECT relation, count(*) AS pairs, 0 AS broken FROM compared GROUP BY 1",
}.items()} | {"cmp_quantity": kind_sql("quantity"), "cmp_packaging": kind_sql("packaging")}
