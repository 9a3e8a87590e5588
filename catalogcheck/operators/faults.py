"""Findings of rows that are alike, judged once, and given to the rows that have them at the end.

Whether a cell has a finding depends on what its row states, on its part's siblings and on its part's document, and not on
its sku. So rows that are alike are counted, dealt by part once, and judged there; a finding then is a few whole numbers
(the row's key and the number of its kind) until it is put out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources import tables as T
from . import judgement as J
from . import structural as S
from . import triage
from .numbering import numbered

#: What tells findings of one row apart, and with the same in all of these they are of one kind.
KIND = ("tier", "source", "attr", "check", "cls", "severity", "value", "proposed")
ROW = ("part", "turn", "h", "manufacturer")

#: class -> severity; the errors of a frame weigh like contradictions.
SEVERITY = {cls: severity for cls, raises, severity in V.RELATIONS.values() if raises} | {"packaging_frame_error": 1, "catalog_null_evidence_present": 2}


def verdicts(s, d, norm: DataFrame | None = None) -> DataFrame:
    """What is said of every value that the siblings of a part state, with n, the number of cells that have it."""
    norm = S.dictionary(T.stated(s, d)) if norm is None else norm
    return S.verdicts(T.cells_of(T.alike(s, d), "part", "turn", "n", "manufacturer", "mpn"), norm)


def alone(s, d, norm: DataFrame) -> DataFrame:
    """ROW, n, attr, value of quantities with another dimension than their header declares in rows that no manufacturer groups: the
    one thing that is said of a value without siblings."""
    cells = T.cells_of(T.alike(s, d).filter("manufacturer IS NULL"), *ROW, "n").join(norm, ["attr", "value"])
    declared = S.declared_and_found()[0]
    return cells.filter((declared != "") & (F.col("v.dim") != declared)).select(*ROW, "n", "attr", "value")


def by_siblings(s, d, norm: DataFrame) -> DataFrame:
    """ROW, n and KIND of the first tier's findings."""
    said = verdicts(s, d, norm).select("part", "turn", "manufacturer", "attr", "value", F.explode(F.filter("outcomes", lambda o: o["outcome"] == "finding")).alias("o"))
    wrong = said.groupBy("part", "turn", "manufacturer").agg(F.collect_list(F.struct("attr", "value", "o.check", "o.cls", "o.severity", "o.proposed")).alias("wrong"))
    met = T.alike(s, d).join(wrong, ["part", "turn", "manufacturer"]).select(*ROW, "n", *T.ATTRIBUTES, F.explode("wrong").alias("w"))
    own = F.coalesce(*(F.when(F.col("w.attr") == a, F.col(a)) for a in T.ATTRIBUTES))
    t0 = [F.lit("T0").alias("tier"), F.lit("feed").alias("source")]
    grouped = met.filter(own == F.col("w.value")).select(*ROW, "n", *t0, *(f"w.{c}" for c in KIND[2:]))
    wrong = {"check": F.lit("unit_dimension"), "cls": F.lit("contradiction"), "severity": F.lit(1), "proposed": F.lit(None).cast("string")}
    return grouped.unionByName(alone(s, d, norm).select(*ROW, "n", *t0, "attr", "value", *(c.alias(k) for k, c in wrong.items())))


def evidence(s, d) -> DataFrame:
    """What the readable document of each part says of its attributes: a list for each, of one value mostly."""
    derived = J._derived(s, d).groupBy("doc", "key_cell").agg(*(F.collect_list(F.when(F.col("attr") == a, F.col("value"))).alias(a) for a in J.HEADERS))
    readable = T.view(s, d, "fx_docs").filter("length(trim(layer)) > 0").select("doc")
    beside = J.windows(s, d).groupBy("doc").agg(F.collect_list("value").alias(J.WINDOWED))
    return derived.join(readable, "doc").join(beside, "doc", "left").withColumn("part", F.substring("key_cell", 2, 20).try_cast("bigint")).filter("part IS NOT NULL")


def by_documents(s, d, said: DataFrame, norm: DataFrame) -> DataFrame:
    """ROW, n and KIND of the second tier's findings; ``said`` is the evidence."""
    told = said.withColumnsRenamed({c: f"said_{c}" for c in ("doc", "key_cell", *T.ATTRIBUTES)})
    rows = T.alike(s, d).withColumn("doc", F.when(F.trim("datasheet") != "", F.element_at(F.split("datasheet", "/"), -1)))
    met = rows.join(told, "part")
    own = F.col("doc") == F.col("said_doc")  # no filter, see alike
    key = own & (F.split_part("mpn", F.lit("-"), F.lit(1)) == F.col("said_key_cell"))
    each = [F.struct(F.lit(a).alias("attr"), F.col(a).alias("value"), F.when(own if a == J.WINDOWED else key, F.col(f"said_{a}")).alias("by")) for a in T.ATTRIBUTES]
    cells = met.select(*ROW, "n", F.inline(F.array(*each))).filter("value IS NOT NULL").select(*ROW, "n", "attr", "value", F.explode("by").alias("proposed"))
    blank = F.trim("value") == ""
    found = S.compared_beside(cells, norm, "value", "proposed").filter(blank | F.col("c.raises"))
    cls = F.when(blank, "catalog_null_evidence_present").otherwise(F.col("c.cls"))
    return found.select(*ROW, "n", F.lit("T1").alias("tier"), F.lit("document").alias("source"), "attr", F.lit("document").alias("check"), cls.alias("cls"), V.lookup(SEVERITY, cls).alias("severity"), "value", "proposed")


def faults(s, d, documents: bool) -> DataFrame:
    """ROW, n and KIND of the findings of siblings and, if wanted, of documents, written: kinds, counts and names read them again."""
    if not documents:
        return T.written(by_siblings(s, d, S.dictionary(T.stated(s, d))), "faults", dealt=True)
    said = T.written(evidence(s, d), "evidence")
    values = reduce(DataFrame.union, (said.select(F.lit(a).alias("attr"), F.explode(a).alias("value")) for a in T.ATTRIBUTES), T.stated(s, d))
    norm = S.dictionary(values)
    return T.written(by_siblings(s, d, norm).unionByName(by_documents(s, d, said, norm)), "faults", dealt=True)


def kinds(found: DataFrame) -> DataFrame:
    """Every kind of finding once with its number, shape, signature and the number of findings with that signature, written. Numbers
    follow the check's name."""
    each = triage.signed(T.written(found.groupBy(*KIND).agg(F.sum("n").alias("n")), "counts"))
    size = each.groupBy("signature_id").agg(F.sum("n").alias("size"))
    full = each.join(F.broadcast(size), "signature_id").drop("n")  # a row for each attribute, class and shape
    return T.written(full.orderBy("check").withColumn("kind", F.monotonically_increasing_id()), "kinds")


def named(s, d, found: DataFrame, every: DataFrame) -> DataFrame:
    """l_orderkey, rn and kind of every finding, written."""
    same = reduce(lambda x, y: x & y, (found[c].eqNullSafe(every[c]) for c in KIND))
    rows, by = T.lines(s, d)
    least = F.lit(-1000)  # of no h
    short = found.join(every, same).select(*(found[c] for c in by if c != "h"), F.coalesce(found["h"], least).alias("h"), every["kind"])
    rows = rows.withColumn("h", F.coalesce("h", least))
    alike = reduce(lambda x, y: x & y, (rows[c].eqNullSafe(short[c]) if c == "manufacturer" else rows[c] == short[c] for c in by))
    return T.written(rows.join(short, alike).select("l_orderkey", "rn", "kind"), "findings")


def findings(s, d, documents: bool) -> DataFrame:
    """Every finding with sku, KIND, uri, shape, fingerprint, signature_id, size and redline_id."""
    found = faults(s, d, documents)
    every = kinds(found)
    return triage.keyed(sku(named(s, d, found, every).join(every, "kind")))


def sku(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sku", F.concat(F.lit("S"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("rn").cast("string")))


def ranked(s, d, documents: bool) -> DataFrame:
    """The findings with factors, expected value and rank. Rows are dealt to ranges as whole numbers with the sixteen bytes of their
    id; equal ids are of one sku, as both are made of it, and their kinds' numbers follow the check."""
    found = faults(s, d, documents)
    every = triage.queue(kinds(found))
    rows = triage.keyed(sku(named(s, d, found, every).join(every, "kind")))
    short = rows.select("l_orderkey", "rn", "kind", "expected", F.unhex(F.replace("redline_id", F.lit("-"), F.lit(""))).alias("id"))
    placed = numbered(short, ("expected", "id", "kind"), ("expected",)).withColumnRenamed("place", "rank").drop("expected")
    return triage.keyed(sku(placed.join(every, "kind")))
