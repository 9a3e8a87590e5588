"""What documents say about a catalog's cells, and what follows: derivation, judgement, reranking, the ledger's writes, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources import tables as T
from . import evidence as E
from . import ledger as L
from . import structural as S
from . import triage

#: attribute -> how its column headers look.
HEADERS = {"rated_current": "%rated current%", "poles": "%poles%", "weight": "%weight%"}
#: The attribute that documents state beside an anchor in their text.
WINDOWED = "packaging_uom"
CLAIM_SPACE = "5f0c1b2d-3e4a-5b6c-8d7e-9f0a1b2c3d4e"
DRAIN, SHORTLIST, KEPT = 200, 50, 5
RATES = {"T0": 0.000001, "T1": 0.00002, "T3": 0.01}


def header_attribute(header: Column) -> Column:
    """The attribute that a column header belongs to, null for none."""
    out = F.lit(None).cast("string")
    for attr, pattern in HEADERS.items():
        out = F.when(F.lower(header).like(pattern), attr).otherwise(out)
    return out


def header_unit(header: Column) -> Column:
    return F.split_part(F.split_part(header, F.lit("["), F.lit(2)), F.lit("]"), F.lit(1))


def derive_cell(cells: DataFrame) -> DataFrame:
    """doc, key_cell, attr, value, merged: table cells under a known header, with the header's unit; a missing cell takes the
    nearest text above it in its column."""
    known = cells.withColumns({"attr": header_attribute(F.col("header")), "unit": header_unit(F.col("header"))}).filter("attr IS NOT NULL")
    above = Window.partitionBy("doc", "attr").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    text = F.last("cell", ignorenulls=True).over(above)
    full = known.select("doc", "key_cell", "attr", F.col("cell").isNull().alias("merged"), "unit", text.alias("text")).filter("text IS NOT NULL")
    return full.select("doc", "key_cell", "attr", F.when(F.col("unit") != "", F.concat_ws(" ", "text", "unit")).otherwise(F.col("text")).alias("value"), "merged")


def _derived(s, d) -> DataFrame:
    return derive_cell(T.view(s, d, "fx_doc_cells"))


def judge(s, d) -> DataFrame:
    """Every cell of the feed against what its document's table says of it, or its text where no table has that attribute; pairs of
    values are compared once each."""
    rows = T.view(s, d, "cat_rows")
    doc = F.when(F.trim("datasheet") != "", F.element_at(F.split("datasheet", "/"), -1))
    wide = rows.select("sku", F.split_part("mpn", F.lit("-"), F.lit(1)).alias("key_cell"), doc.alias("doc"), *HEADERS, WINDOWED)
    cells = wide.unpivot(["sku", "key_cell", "doc"], [*HEADERS, WINDOWED], "attr", "value")
    docs = T.view(s, d, "fx_docs").select("doc", (F.length(F.trim("layer")) > 0).alias("readable"))
    told = cells.join(docs, "doc", "left").join(_derived(s, d).select("doc", "key_cell", "attr", F.col("value").alias("by_cell")), ["doc", "key_cell", "attr"], "left")
    told = told.join(windows(s, d).select("doc", F.lit(WINDOWED).alias("attr"), F.col("value").alias("by_window")), ["doc", "attr"], "left").withColumn("proposed", F.coalesce("by_cell", "by_window"))
    told = T.written(told.select("sku", "attr", "value", "proposed", "doc", "readable"), "told")
    pairs = S.compared_values(told.filter("value IS NOT NULL AND proposed IS NOT NULL"), "value", "proposed").select("attr", "value", "proposed", "c")
    out = told.join(pairs, ["attr", "value", "proposed"], "left")
    status = F.when(F.col("doc").isNull(), triage.STATUSES[3]).when(F.col("readable").isNull(), triage.STATUSES[1]).when(~F.col("readable"), triage.STATUSES[2])
    why = status.otherwise(F.when(F.col("proposed").isNull(), "no_evidence").when((F.trim("value") != "") & (F.col("c.cls") == "undetermined"), "value_outside_known_grammar"))
    absent, blank = F.col("value").isNull(), F.trim("value") == ""
    outcome = F.when(absent, "not_in_feed").when(why.isNotNull(), "declined").when(blank | F.col("c.raises"), "finding").otherwise("resolved")
    cls = F.when(outcome == "finding", F.when(blank, "catalog_null_evidence_present").otherwise(F.col("c.cls")))
    return out.select("sku", "attr", outcome.alias("outcome"), F.when(outcome == "declined", why).alias("reason"), cls.alias("cls"), "value", F.when(outcome == "finding", F.col("proposed")).alias("proposed"))


def union_tiers(s, d) -> DataFrame:
    """Findings of siblings (T0) and of documents (T1)."""
    from .faults import findings  # it needs this module

    return findings(s, d, documents=True).select("sku", "attr", "cls", "value", "proposed", "tier")


def windows(s, d) -> DataFrame:
    """doc, value: the one value beside an anchor in each readable document, of the first anchor that has just one."""
    readable = T.view(s, d, "fx_docs").filter("length(trim(layer)) > 0").select("doc", "doc_id")
    near = E.nearest(E._window(s, d)).filter("candidates = 1").groupBy("doc_id").agg(F.min_by("value", "anchor_pos").alias("value"))
    return near.join(readable, "doc_id").select("doc", "value")


def derive(s, d) -> DataFrame:
    """doc, key_cell, attr, value, method: table cells first; where a document has none for its key, the one value beside an anchor."""
    readable = T.view(s, d, "fx_docs").filter("length(trim(layer)) > 0").select("doc")
    cell = _derived(s, d).join(readable, "doc", "left_semi").select("doc", "key_cell", "attr", "value", F.lit("table_cell").alias("method"))
    window = windows(s, d).select("doc", F.lit(None).cast("string").alias("key_cell"), F.lit(WINDOWED).alias("attr"), "value", F.lit("text_window").alias("method"))
    return cell.unionByName(window)


def table_blind(s, d) -> DataFrame:
    """The baseline that sees no table: of each anchor the nearest value, competition or not, with the confidence of its distance."""
    near = E._window(s, d).groupBy("doc_id", "anchor_pos").agg(F.min(F.struct("distance", "pos", "word")).alias("m"))
    return near.select("doc_id", "anchor_pos", F.col("m.word").alias("value"), F.round(0.6 * 0.5 / (1 + 0.25 * F.col("m.distance")), 6).alias("confidence"))


def rerank(s, d) -> DataFrame:
    """The first five classes by 0.6 of the retrieval score, 0.3 of the class's tokens that the query has, 0.1 for all of them."""
    classes, queries = T.table(s, d, "benchmark"), E._queries(s, d)
    short = T.written(E.retrieve(queries, classes, SHORTLIST).select("doc_id", "item_id", "score"), "shortlist")
    c = E.tokens(classes, "item_id")
    size = c.groupBy("item_id").agg(F.count("*").alias("size"))
    met = short.select("doc_id", "item_id").join(c, "item_id").join(E.tokens(queries, "doc_id"), ["doc_id", "token"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("met"))
    out = short.join(met, ["doc_id", "item_id"]).join(size, "item_id")
    # in whole hundred-thousandths, so that ties don't hang on the last bit
    full = 6 * F.round(F.col("score") * 10000).cast("bigint") + F.call_function("div", 30000 * F.col("met"), F.col("size")) + 10000 * (F.col("met") == F.col("size")).cast("int")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("rank_score"), "item_id"))  # SHORTLIST rows at most
    return out.select("doc_id", "item_id", full.alias("rank_score")).withColumn("place", place).filter(F.col("place") <= KEPT)


def _declared(s, d) -> DataFrame:
    """class_id, attr: the attributes that a class declares, those that two of its parts or more have a document row for."""
    p = T.table(s, d, "part").select(F.concat("p_type", F.lit("/"), "p_brand").alias("class_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("key_cell"))
    return p.join(_derived(s, d).filter("NOT merged"), "key_cell").groupBy("class_id", "attr").agg(F.countDistinct("key_cell").alias("parts")).filter("parts > 1").select("class_id", "attr")


def feature_intersection(s, d) -> DataFrame:
    """Per part and its class: attributes that its records state, and those of them that the class declares."""
    stated = T.view(s, d, "cat_cells").filter(F.trim("value") != "").select(F.split_part("mpn", F.lit("-"), F.lit(1)).alias("key_cell"), "attr").distinct()
    p = T.table(s, d, "part").select(F.concat("p_type", F.lit("/"), "p_brand").alias("class_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("key_cell"))
    both = stated.join(p, "key_cell").join(_declared(s, d).withColumn("hit", F.lit(1)), ["class_id", "attr"], "left")
    return both.groupBy("key_cell", "class_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("declared"))


def drain(s, d) -> DataFrame:
    """The first DRAIN findings of the queue, by worth, and what became of them."""
    q, done = L._open(s, d)
    head = q.orderBy(F.desc_nulls_last("worth"), "sku", "attr").limit(DRAIN)  # a batch of decisions is this many
    return head.join(done.select("sku", "attr", "kind"), ["sku", "attr"], "left").groupBy(F.coalesce("kind", F.lit("open")).alias("result")).agg(F.count("*").alias("n"))


def append(folder: str, batch: DataFrame) -> int:
    """Appends the rows of ``batch`` whose id the ledger doesn't hold yet, by kind; the number of rows written."""
    spark = batch.sparkSession
    new = batch.dropDuplicates(["id"])
    if _exists(spark, folder):
        new = new.join(spark.read.parquet(folder).select("id"), "id", "left_anti")
    new = T.written(new, "append")
    new.write.mode("append").partitionBy("kind").parquet(folder)
    return new.count()


def _exists(spark, folder: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(folder)
    except AnalysisException:
        return False
    return True


def event_batch(s, d) -> DataFrame:
    key = F.concat_ws("|", "kind", "sku", "attr", F.col("event_id").cast("string"))
    return L._events(s, d).select(V.uuid5(L.EVENT_SPACE, key).alias("id"), "event_id", "sku", "attr", "kind")


def ledger_append(s, d) -> DataFrame:
    """A ledger after the same batch was sent twice: each event is there once."""
    folder = f"{T.shared_folder(s)}/ledger-{T.uuid.uuid4().hex}"
    for _ in range(2):
        append(folder, event_batch(s, d))
    return s.read.parquet(folder).select("id", "event_id")


def reverse_batch(s, d) -> DataFrame:
    """Claims that supersede accepted findings which no later batch has touched, appended to a ledger; asked twice, they are
    written once."""
    claim = V.uuid5(CLAIM_SPACE, F.concat_ws("|", "sku", "attr", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    claims = L.join_reversal(s, d).select(claim.alias("id"), "sku", "attr", F.lit("reversal").alias("kind"))
    folder = f"{T.shared_folder(s)}/reversals-{T.uuid.uuid4().hex}"
    for _ in range(2):
        append(folder, claims)
    return s.read.parquet(folder).select("id", "sku", "attr", "kind")


def priced_cost(s, d) -> DataFrame:
    """Cost of each tier, and what it is per record, document and finding (0 without any)."""
    m = triage.agg_run_manifest(s, d)
    units = {"T0": F.col("finding") + F.col("resolved") + F.col("declined"), "T1": F.col("groundable") * len(HEADERS), "T3": F.col("finding")}
    each = F.array(*[F.struct(F.lit(t).alias("tier"), u.alias("units"), F.lit(RATES[t]).alias("rate")) for t, u in units.items()])
    r = m.select("records", "groundable", "finding", F.explode(each).alias("r")).withColumn("cost", F.col("r.units") * F.col("r.rate"))
    per = {f"per_{n}": F.round(F.coalesce(F.try_divide("cost", c), F.lit(0.0)), 9) for n, c in (("record", "records"), ("document", "groundable"), ("finding", "finding"))}
    return r.select("r.tier", F.round("cost", 6).alias("cost"), *[c.alias(k) for k, c in per.items()])


def report(s, d) -> DataFrame:
    """The sections of a run's report, written as JSON lines and read back."""
    outcomes = S.outcome_counts(T.view(s, d, "cat_cells"))
    run = outcomes.groupBy(F.col("outcome").alias("key")).agg(F.sum("n").alias("value")).select(F.lit("outcomes").alias("section"), "key", "value")
    checks = outcomes.groupBy(F.col("check").alias("key")).agg(F.sum("n").alias("value")).select(F.lit("checks").alias("section"), "key", "value")
    inv = triage._inv(s, d).groupBy(F.col("status").alias("key")).agg(F.count("*").alias("value")).select(F.lit("documents").alias("section"), "key", "value")
    folder = f"{T.shared_folder(s)}/report-{T.uuid.uuid4().hex}"
    run.union(checks).union(inv).write.json(folder)
    return s.read.schema("section string, key string, value long").json(folder)


def words_in_span(s, d) -> DataFrame:
    """Words that overlap a span of characters, one span for each document."""
    low = F.col("doc_id") % 7 * 50
    w = E.word_offsets(T.table(s, d, "documents")).filter((F.col("start") < low + 60) & (F.col("end") > low))
    return w.groupBy("doc_id").agg(F.count("*").alias("words"), F.min("pos").alias("first"), F.max("pos").alias("last"))




QUERIES = {
    "flt_header_match": lambda s, d: T.view(s, d, "fx_doc_cells").groupBy("header").agg(F.count("*").alias("cells")).select("header", header_attribute(F.col("header")).alias("attr"), header_unit(F.col("header")).alias("unit"), "cells"),
    "audit_derive_cell": _derived,
    "audit_derive": derive,
    "audit_tableblind": table_blind,
    "audit_judge": judge,
    "set_union_tiers": union_tiers,
    "top_rerank_k": rerank,
    "join_schema_fit": lambda s, d: feature_intersection(s, d).select("key_cell", "class_id", F.round(F.col("declared") / F.col("wanted"), 6).alias("fit")),
    "set_feature_intersection": feature_intersection,
    "join_words_in_span": words_in_span,
    "join_column_band": lambda s, d: E._words(s, d).groupBy("doc_id", "page", F.floor(F.col("x0") / 125).cast("int").alias("band")).agg(F.count("*").alias("words")),
    "audit_drain": drain,
    "sink_ledger_append": ledger_append,
    "audit_reverse_batch": reverse_batch,
    "agg_priced_cost": priced_cost,
    "sink_report": report,
}

_DERIVED = """known AS (SELECT doc, row_no, key_cell, cell, split_part(split_part(header, '[', 2), ']', 1) AS unit, CASE WHEN lower(header) LIKE '%weight%' THEN 'weight' WHEN lower(header) LIKE '%poles%' THEN 'poles' WHEN lower(header) LIKE '%rated current%' THEN 'rated_current' END AS attr FROM fx_doc_cells),
filled AS (SELECT *, cell IS NULL AS merged, last_value(cell IGNORE NULLS) OVER (PARTITION BY doc, attr ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS txt FROM known WHERE attr IS NOT NULL),
derived AS (SELECT doc, key_cell, attr, CASE WHEN unit <> '' THEN txt || ' ' || unit ELSE txt END AS value, merged FROM filled WHERE txt IS NOT NULL)"""
_JUDGE = f"""{_DERIVED}, feed AS (SELECT c.sku, split_part(c.mpn, '-', 1) AS key_cell, CASE WHEN trim(datasheet) <> '' THEN string_split(datasheet, '/')[-1] END AS doc, attr, value FROM cat_cells c JOIN cat_rows r ON c.sku = r.sku),
beside AS (SELECT * FROM (WITH {E._W}, {E._A}, n AS (SELECT doc_id, anchor_pos, min(word) AS value FROM f GROUP BY 1, 2 HAVING count(DISTINCT word) = 1), o AS (SELECT doc_id, arg_min(value, anchor_pos) AS value FROM n GROUP BY 1)
  SELECT doc, value FROM o JOIN fx_docs USING (doc_id) WHERE length(trim(layer)) > 0) q),
told AS (SELECT f.*, coalesce(v.value, e.value) AS proposed, CASE WHEN f.doc IS NULL THEN 'no_document_named' WHEN x.doc IS NULL THEN 'document_named_not_supplied' WHEN length(trim(layer)) = 0 THEN 'document_unreadable' END AS status
  FROM feed f LEFT JOIN fx_docs x ON f.doc = x.doc LEFT JOIN derived v ON f.doc = v.doc AND f.key_cell = v.key_cell AND f.attr = v.attr LEFT JOIN beside e ON f.doc = e.doc AND f.attr = 'packaging_uom'),
strings AS (SELECT attr, value FROM told UNION ALL SELECT attr, proposed FROM told),
{S.norm_sql("strings")}, compared AS (SELECT t.*, {S.relation_sql("a", "b")} AS relation FROM told t LEFT JOIN norm a ON a.attr = t.attr AND a.value = t.value LEFT JOIN norm b ON b.attr = t.attr AND b.value = t.proposed),
why AS (SELECT c.*, CASE WHEN c.relation = 'contradiction' AND attr = 'packaging_uom' THEN 'packaging_frame_error' ELSE r.cls END AS cls, r.raises, coalesce(status, CASE WHEN proposed IS NULL THEN 'no_evidence' WHEN trim(value) <> '' AND cls = 'undetermined' THEN 'value_outside_known_grammar' END) AS why FROM compared c LEFT JOIN relations r ON c.relation = r.relation AND c.value IS NOT NULL AND c.proposed IS NOT NULL),
judged1 AS (SELECT *, CASE WHEN value IS NULL THEN 'not_in_feed' WHEN why IS NOT NULL THEN 'declined' WHEN trim(value) = '' OR raises THEN 'finding' ELSE 'resolved' END AS outcome FROM why),
judged2 AS (SELECT sku, attr, outcome, CASE WHEN outcome = 'declined' THEN why END AS reason, CASE WHEN outcome = 'finding' THEN CASE WHEN trim(value) = '' THEN 'catalog_null_evidence_present' ELSE cls END END AS cls, value, CASE WHEN outcome = 'finding' THEN proposed END AS proposed FROM judged1)"""
_FIT = f"""{_DERIVED}, p AS (SELECT concat(p_type, '/', p_brand) AS class_id, concat('P', CAST(p_partkey AS VARCHAR)) AS key_cell FROM part),
declared AS (SELECT class_id, attr FROM p JOIN derived USING (key_cell) WHERE NOT merged GROUP BY 1, 2 HAVING count(DISTINCT key_cell) > 1),
stated AS (SELECT DISTINCT split_part(mpn, '-', 1) AS key_cell, attr FROM cat_cells WHERE trim(value) <> ''),
fit AS (SELECT key_cell, class_id, count(*) AS wanted, count(d.attr) AS declared FROM stated s JOIN p USING (key_cell) LEFT JOIN declared d USING (class_id, attr) GROUP BY 1, 2)"""
_RERANK = f"""{E._R}, tok AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM documents), size AS (SELECT item_id, count(*) AS size FROM c GROUP BY 1),
met AS (SELECT r.doc_id, r.item_id, score, count(*) AS met FROM r JOIN c ON r.item_id = c.item_id JOIN tok ON tok.doc_id = r.doc_id AND tok.token = c.token WHERE place <= 50 GROUP BY 1, 2, 3),
full_ AS (SELECT doc_id, item_id, 6 * CAST(round(score * 10000) AS BIGINT) + 30000 * met // size + 10000 * CAST(met = size AS INT) AS rank_score FROM met JOIN size USING (item_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank_score DESC, item_id) AS place FROM full_)"""
_COST = triage._MANIFEST + """, u AS (SELECT records, groundable, finding, unnest(['T0', 'T1', 'T3']) AS tier, unnest([(finding + resolved + declined) * 0.000001::DOUBLE, groundable * 3 * 0.00002::DOUBLE, finding * 0.01::DOUBLE]) AS cost FROM m)
SELECT tier, round(cost, 6) AS cost, round(coalesce(cost / nullif(records, 0), 0), 9) AS per_record, round(coalesce(cost / nullif(groundable, 0), 0), 9) AS per_document, round(coalesce(cost / nullif(finding, 0), 0), 9) AS per_finding FROM u"""

ORACLES = {k: T.with_views(q) for k, q in {
    "flt_header_match": "SELECT header, CASE header WHEN 'Rated current [A]' THEN 'rated_current' WHEN 'No. of poles' THEN 'poles' WHEN 'Net weight [g]' THEN 'weight' END AS attr, split_part(split_part(header, '[', 2), ']', 1) AS unit, count(*) AS cells FROM fx_doc_cells GROUP BY header",
    "audit_derive_cell": f"WITH {_DERIVED} SELECT * FROM derived",
    "audit_derive": f"WITH {_DERIVED}, {E._W}, {E._A}, n AS (SELECT doc_id, anchor_pos, min(word) AS value FROM f GROUP BY 1, 2 HAVING count(DISTINCT word) = 1), o AS (SELECT doc_id, arg_min(value, anchor_pos) AS value FROM n GROUP BY 1), r AS (SELECT doc, doc_id FROM fx_docs WHERE length(trim(layer)) > 0) SELECT doc, key_cell, attr, value, 'table_cell' AS method FROM derived WHERE doc IN (SELECT doc FROM r) UNION ALL SELECT doc, NULL, 'packaging_uom', value, 'text_window' FROM o JOIN r USING (doc_id)",
    "audit_tableblind": f"WITH {E._W}, {E._A} SELECT doc_id, anchor_pos, arg_min(word, (distance, pos)) AS value, round(0.3 / (1 + 0.25 * min(distance)), 6) AS confidence FROM f GROUP BY 1, 2",
    "audit_judge": f"WITH {_JUDGE} SELECT * FROM judged2",
    "top_rerank_k": f"WITH {_RERANK} SELECT * FROM best WHERE place <= 5",
    "join_schema_fit": f"WITH {_FIT} SELECT key_cell, class_id, round(declared / wanted, 6) AS fit FROM fit",
    "set_feature_intersection": f"WITH {_FIT} SELECT * FROM fit",
    "join_words_in_span": f"WITH {E._W}, o AS (SELECT doc_id, pos, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS e, length(word) AS n FROM w) SELECT doc_id, count(*) AS words, min(pos) AS first, max(pos) AS last FROM o WHERE e - n < doc_id % 7 * 50 + 60 AND e > doc_id % 7 * 50 GROUP BY 1",
    "join_column_band": f"WITH {E._W} SELECT doc_id, CAST(floor(pos / 200) AS INT) AS page, CAST(floor(pos % 10 * 50 / 125) AS INT) AS band, count(*) AS words FROM w GROUP BY 1, 2, 3",
    "audit_drain": f"{L._QUEUE}, h AS (SELECT * FROM q ORDER BY worth DESC NULLS LAST, sku, attr LIMIT 200) SELECT coalesce(kind, 'open') AS result, count(*) AS n FROM h LEFT JOIN ({L._LATEST}) l USING (sku, attr) GROUP BY 1",
    "sink_ledger_append": f"SELECT {triage._uuid_sql(L.EVENT_SPACE, "concat_ws('|', kind, sku, attr, CAST(event_id AS VARCHAR))")} AS id, event_id FROM fx_ledger",
    "audit_reverse_batch": f"WITH l AS ({L._LATEST}), r AS (SELECT sku, attr, ts FROM l WHERE kind = 'accept' AND NOT EXISTS (SELECT 1 FROM fx_ledger b WHERE b.kind = 'batch' AND b.sku = l.sku AND b.attr = l.attr AND b.ts > l.ts)) SELECT {triage._uuid_sql(CLAIM_SPACE, "concat_ws('|', sku, attr, strftime(ts, '%Y-%m-%d %H:%M:%S.%f'))")} AS id, sku, attr, 'reversal' AS kind FROM r",
    "agg_priced_cost": _COST,
    "sink_report": f"WITH {S.OUTCOMES_SQL}, {triage._INV} SELECT 'outcomes' AS section, outcome AS key, count(*) AS value FROM outcomes GROUP BY 2 UNION ALL SELECT 'checks', \"check\", count(*) FROM outcomes GROUP BY 2 UNION ALL SELECT 'documents', status, count(*) FROM inv GROUP BY 2",
}.items()}
ORACLES["set_union_tiers"] = T.with_views(
    f"WITH t0 AS (SELECT * FROM (WITH {S.OUTCOMES_SQL} SELECT sku, attr, cls, value, proposed, 'T0' AS tier FROM outcomes WHERE outcome = 'finding') a), t1 AS (SELECT * FROM (WITH {_JUDGE} SELECT sku, attr, cls, value, proposed, 'T1' AS tier FROM judged2 WHERE outcome = 'finding') b) SELECT * FROM t0 UNION ALL SELECT * FROM t1"
)
