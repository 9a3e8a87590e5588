"""Shortlists with bounds against scores in full, whatever share of tokens counts as common."""

import math
import random
import re
from collections import Counter

import pytest

from catalogcheck.operators import shortlists as S
from catalogcheck.plans import registry


def test_query_equals_sql(same):
    same(registry.queries()["agg_topk_accuracy"], registry.oracles()["agg_topk_accuracy"])


def plain(queries, classes, k):
    def bag(text):
        return set(re.findall("[a-z0-9]+", (text or "").lower()))

    own = {i: bag(t) for i, t in classes}
    df = Counter(t for b in own.values() for t in b)
    w = {t: round(math.log(1 + len(classes) / n) * 1e6) for t, n in df.items()}
    out = set()
    for q, text in queries:
        known = bag(text) & set(w)
        total = sum(w[t] for t in known)
        scores = sorted(((-round(sum(w[t] for t in known & b) / total, 4), i) for i, b in own.items() if known & b)) if total else []
        out |= {(q, i, -s, p) for p, (s, i) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("common", [0.0, 0.1, 0.4, 1.0])
def test_any_bound_gives_the_full_result(spark, common):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(120)]

    def text(n):
        return " ".join(vocabulary[min(int(rng.expovariate(0.05)), 119)] for _ in range(n))

    classes = [(i, text(rng.randint(1, 12))) for i in range(60)] + [(60, ""), (61, None)]
    queries = [(i, text(rng.randint(1, 20))) for i in range(80)] + [(80, "unheard of"), (81, None), (82, "")] + [(100 + i, classes[i][1]) for i in range(10)]
    a, b = spark.createDataFrame(queries, "doc_id long, text string"), spark.createDataFrame(classes, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.score, r.place) for r in S.shortlist(a, b, 3, common).collect()}
    assert got == plain(queries, classes, 3)


def test_counts_by_hand(spark):
    classes = spark.createDataFrame([(1, "circuit breaker"), (2, "circuit switch"), (3, "cable gland")], "item_id long, text string")
    rows = [(1, "cable gland", 3), (2, "circuit", 2), (3, "circuit breaker", 2), (4, "unknown words", None), (5, "cable gland", None), (6, None, 1)]
    got = {r.metric: (r.numerator, r.denominator) for r in S.accuracy(spark.createDataFrame(rows, "doc_id long, text string, gold long"), classes, 2).collect()}
    assert got == {"top_1": (1, 4), "top_2": (3, 4), "abstained": (2, 4), "must_abstain_held": (1, 2)}
