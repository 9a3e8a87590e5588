"""Overlap joins on the grid against all pairs, shares and overlaps by hand, and what verification finds."""

import random

import pytest
from pyspark.sql import functions as F

from catalogcheck.operators import boxes as B
from catalogcheck.plans import registry


@pytest.mark.parametrize("name", sorted(B.QUERIES))
def test_query_equals_sql(name, same):
    same(registry.queries()[name], registry.oracles()[name])


def test_grid_join_finds_each_pair_once(spark):
    rng = random.Random(1)

    def some(n, widest):
        out = []
        for i in range(n):
            x, y = rng.uniform(-200, 900), rng.uniform(-100, 500)
            out.append((i, rng.randint(0, 1), x, y, x + rng.uniform(0, widest), y + rng.uniform(0, widest / 2)))
        return out

    a, b = some(150, 60), [*some(60, 900), (60, 0, 120.0, 60.0, 240.0, 120.0), (61, 0, 5.0, 5.0, 5.0, 5.0)]
    left = spark.createDataFrame(a, "a int, page int, x0 double, y0 double, x1 double, y1 double")
    right = spark.createDataFrame(b, "b int, page int, x0 double, y0 double, x1 double, y1 double")
    got = [(r.a, r.b, round(r.shared, 6)) for r in B.overlapping(left, right, ["page"]).collect()]
    want = []
    for i, p, *u in a:
        for j, q, *v in b:
            shared = max(0, min(u[2], v[2]) - max(u[0], v[0])) * max(0, min(u[3], v[3]) - max(u[1], v[1]))
            if p == q and shared > 0:
                want.append((i, j, round(shared, 6)))
    assert len(want) > 300 and sorted(got) == sorted(want)


def test_overlap_by_hand(spark):
    rows = [((0, 0, 10, 10), [(0, 0, 10, 10)], 1.0), ((0, 0, 10, 10), [(5, 0, 15, 10)], 1 / 3), ((0, 0, 10, 10), [(5, 5, 15, 15), (0, 0, 10, 20)], 0.5), ((3, 3, 3, 9), [(0, 0, 10, 10)], 0.0), ((0, 0, 1, 1), [], 0.0)]
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    frame = spark.createDataFrame([(tuple(map(float, b)), [tuple(map(float, g)) for g in gs], w) for b, gs, w in rows], f"box {box}, gold array<{box}>, want double")
    for r in frame.select(B.best_iou(F.col("box"), F.col("gold")).alias("got"), "want").collect():
        assert r.got == pytest.approx(r.want)


def test_verification_by_hand(spark):
    words = spark.createDataFrame(
        [(1, 0, 0, "rated", 0.0, 0.0, 20.0, 10.0), (1, 0, 1, "16", 25.0, 0.0, 33.0, 10.0), (1, 0, 2, "A", 35.125, 0.0, 39.0, 10.0), (1, 1, 3, "A", 35.125, 0.0, 39.0, 10.0)],
        "doc_id long, page int, pos int, word string, x0 double, y0 double, x1 double, y1 double",
    )
    rated, number, unit = (0.0, 0.0, 20.0, 10.0), (25.0, 0.0, 33.0, 10.0), (35.125, 0.0, 39.0, 10.0)
    near = (25.004, 0.0, 32.996, 10.0)
    rows = [
        ("ok", 1, 0, [unit, number], "16 A", None), ("spaces", 1, 0, [number, unit, unit], "  16\tA ", None), ("rounded", 1, 0, [near], "16", None),
        ("order", 1, 0, [unit, number], "A 16", "spells_otherwise"), ("off", 1, 0, [rated, (25.01, 0.0, 33.0, 10.0)], "rated 16", "box_not_a_word"),
        ("page", 1, 1, [number], "16", "box_not_a_word"), ("gone", 7, 0, [number], "16", "document_absent"), ("empty", 1, 0, [], "", None), ("nothing", 1, 0, [], "16", "spells_otherwise"),
    ]
    box = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    frame = spark.createDataFrame([r[:5] for r in rows], f"record_id string, doc_id long, page int, boxes {box}, value string")
    assert {r.record_id: r.problem for r in B.gold_verified(frame, words).collect()} == {r[0]: r[5] for r in rows}


def test_each_defect_is_found(spark):
    w = B.word_boxes(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    kinds = {r.problem: r["count"] for r in B.gold_verified(B.annotations(w), w).groupBy("problem").count().collect()}
    assert set(kinds) == {None, "box_not_a_word", "spells_otherwise", "document_absent"} and kinds[None] > 5 * kinds["box_not_a_word"]
