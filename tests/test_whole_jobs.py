"""Registered queries over rows that a smaller job would leave out."""

import pytest

from catalogcheck.plans import registry


@pytest.fixture
def folder(spark, tmp_path):
    def put(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def run(spark, name, folder):
    return [r.asDict() for r in registry.queries()[name](spark, folder).collect()]


def test_class_words_behind_the_thirtieth(spark, folder):
    late = "word " * 40 + "residual current breaker"
    d = folder(documents=([(1, late), (2, "terminal block"), (3, None)], "doc_id long, text string"), benchmark=([("b", "Residual current breaker"), ("c", "terminal block")], "item_id string, text string"))
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in run(spark, "audit_class_retrieve", d)} == {(1, "b", 1.0), (2, "c", 1.0)}
    assert {(r["doc_id"], r["candidates"], r["best"]) for r in run(spark, "top_retrieve_k", d)} == {(1, 1, 1.0), (2, 1, 1.0)}
    assert {(r["doc_id"], r["margin"]) for r in run(spark, "win_select_margin", d)} == {(1, 1.0), (2, 1.0)}
    assert {(r["doc_id"], r["item_id"], r["reason"]) for r in run(spark, "audit_class_resolve", d)} == {(1, "b", None), (2, "c", None)}


def test_whole_texts_against_sql(spark, duck):
    """The oracle's formula over all tokens of a text."""
    small = "/root/testdata/sf0.001"
    sql = """WITH c AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM benchmark),
    idf AS (SELECT token, round(ln(1 + (SELECT count(*) FROM benchmark) / count(*)), 6) AS idf FROM c GROUP BY 1),
    q AS (SELECT doc_id, token, idf FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM documents) JOIN idf USING (token)),
    sc AS (SELECT doc_id, item_id, round(sum(idf) / any_value(weight), 4) AS score FROM q JOIN c USING (token) JOIN (SELECT doc_id, sum(idf) AS weight FROM q GROUP BY 1) USING (doc_id) GROUP BY 1, 2)
    SELECT doc_id, item_id, score FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) <= 5"""
    got = {(r["doc_id"], r["item_id"], r["score"]) for r in run(spark, "audit_class_retrieve", small)}
    assert got == set(duck.execute(sql).fetchall())


def test_history_of_every_sku(spark, folder):
    rows = [(3, "2024-01-02 00:00:00", "view", 8, 1.0), (1, "2024-01-03 00:00:00", "click", 7, 1.0), (2, "2024-01-01 00:00:00", "purchase", 8, 1.0)]
    d = folder(events=(rows, "event_id long, ts string, event_type string, user_id long, value double"))
    assert [(r["sku"], r["event_id"], r["kind"]) for r in run(spark, "audit_history", d)] == [("U7", 1, "claim"), ("U8", 2, "accept"), ("U8", 3, "keep")]


def test_leaks_of_every_label(spark, folder):
    d = folder(documents=([(5, "s"), (6, "s"), (7, "t"), (8, "t")], "doc_id long, source string"), labels=([(5,), (6,), (7,)], "doc_id long"))
    assert {r["source"]: r["leaks"] for r in run(spark, "join_split_leak", d)} == {"s": 2, "t": 1}


def test_chains_of_any_depth(spark, folder):
    """A line of 150 turns, a fork of two lines, and a cycle, which no root reaches."""
    turns = [(10, t) for t in range(150)] + [(7, t) for t in range(100)] + [(13, t) for t in range(131)]
    d = folder(conversations=(turns, "conv_id long, turn long"))
    got = {r["conv_id"]: (r["depth"], r["reached"]) for r in run(spark, "audit_chain_depth", d)}
    assert got == {10: (150, 150), 13: (66, 131)}


def test_a_cycle_and_a_missing_target_end_the_walk(spark):
    from catalogcheck.operators import ledger

    rows = [(1, "a", None), (1, "b", "a"), (1, "c", "d"), (1, "d", "e"), (1, "e", "c"), (1, "f", "e"), (1, "g", "nowhere"), (1, "h", "h"), (2, "b", "a")]
    out = ledger.chain_depths(spark.createDataFrame(rows, "conv_id long, claim string, supersedes string"))
    assert sorted(map(tuple, out.collect())) == [(1, "a", 1), (1, "b", 2)]
