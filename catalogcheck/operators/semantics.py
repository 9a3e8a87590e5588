"""Designations parsed, normalised and compared: every different string is parsed once, every different pair compared once.

The parse table is one row for each different string of the input, built by projections over it, so that the cost of patterns
follows the dictionary and not the rows; results meet the rows by joins on the string.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..functions import grammar as G
from ..functions import values as V
from ..sources import tables as T

STRINGS = "SELECT a AS raw FROM {0} UNION ALL SELECT b AS raw FROM {0}"
_CLASSES = G.values_table([(r, c, s) for r, (c, f, s) in V.RELATIONS.items()], "r, c, s")
_FRAMES = "('range', 'quantity_set', 'quantity')"

#: query -> (what it selects from ``norm``)
PARSES = {
    "norm_canonical_text": "SELECT raw, text FROM norm",
    "norm_number_commas": "SELECT raw, text, refusal FROM norm WHERE {comma}",
    "norm_fraction_vs_set": "SELECT raw, kind, unit, lo1, hi1, lo2, hi2, lo3, hi3 FROM norm WHERE {slash}",
    "norm_tolerance": "SELECT raw, unit, lo1, hi1 FROM norm WHERE tol AND kind = 'quantity'",
    "norm_range": "SELECT raw, unit, lo1, hi1, lo2, hi2, refusal FROM norm WHERE kind = 'range' OR refusal = 'malformed'",
    "norm_interval": "SELECT raw, unit, lo1, hi1 FROM norm WHERE kind = 'quantity' AND NOT tol",
    "norm_unit_convert": "SELECT raw, unit, dim, lo1, hi1 FROM norm WHERE dim IS NOT NULL AND dim <> 'none'",
    "norm_term": "SELECT raw, id, refusal FROM norm WHERE kind = 'term' OR refusal = 'ambiguous_term'",
    "norm_generic": "SELECT raw, id, covers, cover FROM norm WHERE kind = 'generic'",
    "norm_boolean": "SELECT raw, id FROM norm WHERE kind = 'boolean'",
    "norm_dispatch": "SELECT raw, kind, dim, unit, id, refusal FROM norm",
}
#: query -> (columns, condition) over compared pairs
PAIRS = {
    "cmp_quantity_set": ("a, b, relation", "a_kind = 'quantity_set' AND b_kind = 'quantity_set'"),
    "cmp_range": ("a, b, relation", "a_kind = 'range' AND b_kind = 'range'"),
    "cmp_material": ("a, b, relation", "a_kind = 'material' AND b_kind = 'material'"),
    "cmp_term": ("a, b, relation", "a_kind = 'term' AND b_kind = 'term'"),
    "cmp_boolean": ("a, b, relation", "a_kind = 'boolean' AND b_kind = 'boolean'"),
    "cmp_cross_kind": ("a, b, a_kind, b_kind, relation", "a_kind <> b_kind AND a_kind <> 'generic' AND b_kind <> 'generic'"),
    "join_quantity_in_set": ("a, b, relation", "a_kind = 'quantity_set' AND b_kind = 'quantity' OR a_kind = 'quantity' AND b_kind = 'quantity_set'"),
    "join_generic_subsumption": ("a, b, a_kind, b_kind, relation", "a_kind = 'generic' OR b_kind = 'generic'"),
    "cmp_dispatch": ("a, b, a_kind, b_kind, relation", "TRUE"),
    "cmp_classify": ("a, b, relation, cls, severity", "TRUE"),
}


def normalised(d: G.Dialect, pairs: str, norm: str | None) -> str:
    """CTEs up to ``norm``, from the strings or from a table of them that is there already."""
    return f"norm AS (SELECT * FROM {norm})" if norm else G.parsed(d, STRINGS.format(pairs))


def compared(d: G.Dialect, pairs: str, norm: str | None = None) -> str:
    """CTEs up to ``compared``: every different pair (a, b) with the kinds, refusals and relation, its class and severity."""
    return f"""{normalised(d, pairs, norm)}, classes(relation, cls, severity) AS (SELECT * FROM {_CLASSES}),
related AS (SELECT p.a, p.b, a.kind AS a_kind, b.kind AS b_kind, a.refusal AS a_refusal, b.refusal AS b_refusal, {G.relation()} AS relation
  FROM (SELECT DISTINCT a, b FROM {pairs}) AS p JOIN norm a ON p.a = a.raw JOIN norm b ON p.b = b.raw),
compared AS (SELECT r.*, c.cls, c.severity FROM related r JOIN classes c ON r.relation = c.relation)"""


def parse_sql(name: str, d: G.Dialect, pairs: str, norm: str | None = None) -> str:
    body = PARSES[name].replace("{comma}", d.match("raw", "[0-9],[0-9]")).replace("{slash}", d.match("text", "[0-9]/[0-9]"))
    return f"WITH {normalised(d, pairs, norm)} {body}"


def pair_sql(name: str, d: G.Dialect, pairs: str, norm: str | None = None) -> str:
    columns, condition = PAIRS[name]
    return f"WITH {compared(d, pairs, norm)} SELECT {columns} FROM compared WHERE {condition}"


def set_sql(d: G.Dialect, pairs: str, norm: str | None = None) -> str:
    """How often alternatives stand to each other in each way, over all rows: pairs are compared once and counted by a join."""
    return f"WITH {compared(d, pairs, norm)} SELECT relation, count(*) AS n FROM {pairs} p JOIN compared c ON p.a = c.a AND p.b = c.b WHERE a_kind = 'quantity_set' AND b_kind = 'quantity_set' GROUP BY relation"


def run(build):
    def query(spark, sf) -> DataFrame:
        # patterns have braces, so frames go into the statements by name; what is read twice is written once
        names = [f"fx_{uuid.uuid4().hex}" for _ in range(2)]
        T.written(T.view(spark, sf, "fx_pairs").select("a", "b"), "pairs").createTempView(names[0])
        try:
            norm = spark.sql(f"WITH {G.parsed(G.SPARK, STRINGS.format(names[0]))} SELECT * FROM norm")
            T.written(norm, "norm").createTempView(names[1])
            return spark.sql(build(G.SPARK, *names))
        finally:
            for n in names:
                spark.catalog.dropTempView(n)

    return query


_BUILD = (
    {n: (lambda d, p, norm=None, n=n: parse_sql(n, d, p, norm)) for n in PARSES}
    | {n: (lambda d, p, norm=None, n=n: pair_sql(n, d, p, norm)) for n in PAIRS}
    | {"set_quantity_set_relation": set_sql}
)
QUERIES = {n: run(b) for n, b in _BUILD.items()}
ORACLES = {n: T.with_views(b(G.DUCK, "fx_pairs")) for n, b in _BUILD.items()}
