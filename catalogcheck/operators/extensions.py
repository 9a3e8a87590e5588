"""Where users put functions of their own: kinds of values, extractors of documents, selectors of shortlists.

A kind is a function from Column to Column, so it stays in the plan. An extractor gets the rows of one document and a selector
those of one query, as pandas frames; what they get and give is checked on the schema before anything runs, and the size of
a shortlist before the function sees it. An extractor that could see a column with the answer isn't called.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import tables as T

#: What a selector is shown, at most, and words of names that would give an extractor the answer (fixed values).
SHOWN = 5
FORBIDDEN = ("gold", "catalog", "expected", "answer", "truth", "label", "target", "record", "entry", "hint", "context")


class Kinds:
    """Kinds of values in the order of their registration; a value is of the first one whose function gives it a normal form."""

    def __init__(self):
        self.functions: dict[str, Callable[[Column], Column]] = {}

    def register(self, name: str, function: Callable[[Column], Column]) -> Kinds:
        if name in self.functions:
            raise ValueError(f"there is a kind {name} already")
        self.functions[name] = function
        return self

    def normalised(self, values: DataFrame, column: str) -> DataFrame:
        """The frame with kind and norm, both null for values of no kind; all kinds must give one type."""
        if not self.functions:
            raise ValueError("no kind is registered")
        forms = {name: function(F.col(column)) for name, function in self.functions.items()}
        types = {name: values.select(form.alias("norm")).schema["norm"].dataType for name, form in forms.items()}
        if len(set(types.values())) > 1:
            raise TypeError(f"kinds of different types: {types}")
        kind = F.coalesce(*(F.when(form.isNotNull(), F.lit(name)) for name, form in forms.items()))
        return values.withColumns({"kind": kind, "norm": F.coalesce(*forms.values())})


def _words(name: str) -> set[str]:
    return set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()))


def blind(documents: DataFrame, function: Callable) -> None:
    """Refuses columns (of structs too) and parameters whose name has a forbidden word."""

    def names(t, path=""):
        if hasattr(t, "elementType"):
            yield from names(t.elementType, path)
        for f in t.fields if isinstance(t, StructType) else ():
            yield path + f.name
            yield from names(f.dataType, f"{path}{f.name}.")

    seen = [*names(documents.schema), *inspect.signature(function).parameters]
    bad = [n for n in seen if any(w in FORBIDDEN or w.removesuffix("s") in FORBIDDEN for w in _words(n))]
    if bad:
        raise ValueError(f"an extractor must not see {', '.join(bad)}")


def extracted(documents: DataFrame, function: Callable, schema: str, key: str = "doc_id") -> DataFrame:
    """What the function says of each document, a frame of the schema for a frame of the rows with one key."""
    blind(documents, function)
    return documents.groupBy(key).applyInPandas(function, schema)


def selected(candidates: DataFrame, function: Callable) -> DataFrame:
    """query, choice, margin, reason, from candidates (query, item, score) and a function from a frame of one query's candidates,
    best first, to an item or None. More than SHOWN candidates are an error; an item that wasn't shown is no choice."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    c = candidates.select("query", "item", F.col("score").cast("double").alias("score")).withColumn("place", place)
    c = c.withColumn("place", F.when(F.col("place") > SHOWN, F.raise_error(F.lit(f"a selector is shown {SHOWN} candidates at most"))).otherwise(F.col("place")))
    kinds = {f.name: f.dataType.simpleString() for f in c.schema}

    def choose(frame):
        frame = frame.sort_values("place")
        choice = function(frame[["query", "item", "score"]].reset_index(drop=True))
        return frame[["query"]].head(1).assign(said=[choice])

    said = c.groupBy("query").applyInPandas(choose, f"query {kinds['query']}, said {kinds['item']}")
    best = c.groupBy("query").agg(F.round(F.max(F.when(F.col("place") == 1, F.col("score"))) - F.coalesce(F.max(F.when(F.col("place") == 2, F.col("score"))), F.lit(0.0)), 6).alias("gap"), F.collect_list("item").alias("shown"))  # SHOWN items at most
    known = F.coalesce(F.array_contains("shown", F.col("said")), F.lit(False))
    reason = F.when(F.col("said").isNull(), "declined").when(~known, "not_shown").otherwise("chosen")
    return said.join(best, "query").select("query", F.when(known, F.col("said")).alias("choice"), F.when(known, F.col("gap")).otherwise(0.0).alias("margin"), reason.alias("reason"))


def user_kinds(s, d) -> DataFrame:
    """Designations by three registered kinds, each different one once."""
    v = T.view(s, d, "fx_cases").select(F.col("a").alias("value")).union(T.view(s, d, "fx_cases").select("b")).distinct()

    def part(pattern, form):
        return lambda c: F.when(c.rlike(pattern), form(c))

    kinds = Kinds().register("protection", part("^IP[0-9X][0-9]K?$", lambda c: F.concat(F.lit("ip:"), F.substring(c, 3, 9))))
    kinds.register("metric", part("^M[0-9]+(x[0-9.]+)?$", lambda c: F.concat(F.lit("m:"), F.split_part(F.substring(c, 2, 99), F.lit("x"), F.lit(1)))))
    kinds.register("length", part("^[0-9.]+ m?m$", lambda c: F.concat(F.lit("mm:"), F.round(F.split_part(c, F.lit(" "), F.lit(1)).cast("double") * F.when(c.endswith(" mm"), 1).otherwise(1000)).cast("bigint").cast("string"))))
    return kinds.normalised(v, "value")


def user_extractor(s, d) -> DataFrame:
    """The first number of each document and how many it has, by a function over its rows."""

    def numbers(page):
        import pandas as pd

        found = [re.findall("[0-9]+", t or "") for t in page["text"]]
        return pd.DataFrame({"doc_id": page["doc_id"], "first": [f[0] if f else None for f in found], "n": [len(f) for f in found]})

    return extracted(T.table(s, d, "documents").select("doc_id", "text"), numbers, "doc_id long, first string, n long")


def user_selector(s, d) -> DataFrame:
    """Of each nation's five richest suppliers the one with the least key, if the first leads by less than a thousand."""
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    c = T.table(s, d, "supplier").select(F.col("s_nationkey").alias("query"), F.col("s_suppkey").alias("item"), F.col("s_acctbal").cast("double").alias("score"), F.row_number().over(w).alias("at")).filter(F.col("at") <= SHOWN)

    def least(frame):
        return int(frame["item"].min()) if len(frame) > 1 and frame["score"][0] - frame["score"][1] < 1000 else None

    return selected(c, least)


QUERIES = {"udf_value_kinds": user_kinds, "udf_extractor": user_extractor, "udf_selector": user_selector}
ORACLES = {k: T.with_views(q) for k, q in {
    "udf_value_kinds": "SELECT value, CASE WHEN regexp_matches(value, '^IP[0-9X][0-9]K?$') THEN 'protection' WHEN regexp_matches(value, '^M[0-9]+(x[0-9.]+)?$') THEN 'metric' WHEN regexp_matches(value, '^[0-9.]+ m?m$') THEN 'length' END AS kind, CASE kind WHEN 'protection' THEN 'ip:' || substr(value, 3) WHEN 'metric' THEN 'm:' || split_part(substr(value, 2), 'x', 1) WHEN 'length' THEN 'mm:' || CAST(CAST(round(CAST(split_part(value, ' ', 1) AS DOUBLE) * CASE WHEN value LIKE '% mm' THEN 1 ELSE 1000 END) AS BIGINT) AS VARCHAR) END AS norm FROM (SELECT a AS value FROM fx_cases UNION SELECT b FROM fx_cases)",
    "udf_extractor": "SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), '[0-9]+'), '') AS first, len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS n FROM documents",
    "udf_selector": "WITH c AS (SELECT s_nationkey AS query, s_suppkey AS item, CAST(s_acctbal AS DOUBLE) AS score, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier), g AS (SELECT query, min(item) AS least, max(score) FILTER (place = 1) - max(score) FILTER (place = 2) AS lead FROM c WHERE place <= 5 GROUP BY 1) SELECT query, CASE WHEN lead < 1000 THEN least END AS choice, CASE WHEN lead < 1000 THEN round(lead, 6) ELSE 0 END AS margin, CASE WHEN lead < 1000 THEN 'chosen' ELSE 'declined' END AS reason FROM g",
}.items()}
