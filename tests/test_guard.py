"""The walk over payloads against a recursive one, refusals, and canonical text."""

import json
import re

import pytest
from pyspark.sql import functions as F

from catalogcheck.operators import guard as G
from catalogcheck.plans import registry


@pytest.mark.parametrize("name", sorted(G.QUERIES))
def test_query_equals_sql(name, same):
    same(registry.queries()[name], registry.oracles()[name])


def walked(value, path=""):
    if isinstance(value, dict):
        for k, v in value.items():
            here = f"{path}.{k}" if path else k
            if k.lower() in G.RECORD_FIELDS:
                yield here, "record"
            elif k.lower() not in G.RUN_FIELDS:
                yield here, "unknown"
            elif isinstance(v, (dict, list)):
                yield from walked(v, here)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walked(v, f"{path}[{i}]")
    elif isinstance(value, str) and re.match(G.IDENTIFIER, value):
        yield path, "identifier"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, payload string")


def test_any_depth_and_kind(spark):
    deep = {"records": 1}
    for i in range(40):
        deep = {"records": deep} if i % 2 else {"notes": [deep]}
    deep["notes" if "notes" in deep else "records"] = [deep.copy(), {"records": [[[["a::b"]]]], "sku": []}]
    values = [deep, [], {}, "a::b", "plain", 5, None, [[["x.y::z-1"]]], {"clusters": 12}, {"clusters": [{"size": 1}, {"sku_id": 2}, 3]}, {"batch_id": "a::b", "notes": ["a::b c", "ok"]}, {"MPN": {"sku": 1}, "Tiers": [{"Tier": 1}]}, {"": 1}]
    texts = [json.dumps(v) for v in values]
    got = sorted(map(tuple, G.offending(frame(spark, [*texts, None, "", "{", "nul"])).collect()))
    want = sorted((i, *w) for i, v in enumerate(values) for w in walked(v))
    n = len(values)
    assert got == [*want, (n + 1, "", "unreadable"), (n + 2, "", "unreadable"), (n + 3, "", "unreadable")]


def test_refuses_and_lets_through(spark):
    fine = frame(spark, ['{"records": 3}'])
    assert G.guarded(fine) is fine
    with pytest.raises(PermissionError, match=r"clusters\[0\]\.sku \(record\)"):
        G.guarded(frame(spark, ['{"clusters": [{"sku": 1}]}', '{"records": 3}']))
    assert G.offending(frame(spark, ["1"]).limit(0)).count() == 0


def test_canonical_text(spark):
    values = [{"b": [1, {"z": None, "a": True}], "a": {"é": "x y", "aa": {}}}, [], "t", {"B": 1, "a": 2, "A": 3}]
    rows = frame(spark, [json.dumps(v, ensure_ascii=False, indent=3) for v in values] + ["{"])
    got = [r[0] for r in rows.orderBy("id").select(G.canonical(F.col("payload"))).collect()]
    assert got == [*(json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for v in values), None]
