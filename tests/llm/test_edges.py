"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns: no crash, and the stated results."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalogcheck.llm import chat, graph, ngram_join, packing, pieces, pii, quality, repeats, toxicity, urls, weighted
from catalogcheck.llm import textkit as tk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, n_words int"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
ROWS = [
    (1, None, None, None, None, 0.5, True, 1),
    (2, "", "en", "s", 0, 0.5, True, 1),
    (None, "a short text", "en", "s", 12, None, None, None),
    (4, LONG, "en", "s", len(LONG), 0.5, True, 1),
    (5, "one two three four five six seven", "en", "s", 33, 0.5, True, 1),
    (5, "one two three four five six seven", "en", "s", 33, 0.5, True, 1),
    (6, "One two THREE four five six seven", "en", "s", 33, 0.5, True, 1),
    (7, "mail a.b@c.org or 10.0.0.1", "en", "s", 26, 0.5, True, 1),
]


def field(texts):
    return pii.fit(texts)


RUNS = {
    "quality": lambda d: quality.quality_rules(d),
    "toxicity": lambda d: toxicity.toxicity(d, *(toxicity.train(__import__("pyarrow").array(["you idiot"] * 3 + ["fine day"] * 3), __import__("numpy").array([1, 1, 1, 0, 0, 0])) or (None, None))),
    "ngram": lambda d: ngram_join.near_duplicates(d),
    "weighted": lambda d: weighted.fingerprints(d),
    "repeats": lambda d: repeats.dedup(d, ["doc_id"], True),
    "pieces": lambda d: pieces.digests(d),
    "pii": lambda d: pii.personal_data(d, field(["mail a.b@c.org", "at 10.0.0.1"])),
    "packing": lambda d: packing.packed(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, name):
    tk.bounded_arrow(spark)
    d = spark.createDataFrame(ROWS, SCHEMA)
    out = RUNS[name](d)
    rows = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}
    else:
        assert len(rows) == len(ROWS)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    if name == "quality":
        assert by_id[1][0]["n_words"] == 0 and not by_id[1][0]["kept"] and by_id[5][0] == by_id[5][1]
    if name == "ngram":
        assert by_id[1][0]["n_shingles"] == 0 and by_id[1][0]["component_id"] == 1
        assert [r["component_id"] for r in by_id[6]] == [5]
    if name == "repeats":
        assert by_id[4][0]["n_removed"] == len(LONG) and by_id[1][0]["n_bytes"] == 0
    if name == "pii":
        assert (by_id[7][0]["n_email"], by_id[7][0]["n_ip"], by_id[1][0]["spans"]) == (1, 1, "")
    if name == "pieces":
        assert all(r["round_trip"] for r in rows)
    if name == "weighted":
        assert by_id[5][0]["fingerprint"] == by_id[5][1]["fingerprint"] == by_id[6][0]["fingerprint"]


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", "hi", "x"), (1, None, None, "</turn>\n### User: ", "x"), (None, 1, "assistant", "", "x"), (2, 0, "robot:#", "\\b", "x"), (2, 0, "robot:#", "\\b", "x")]
    out = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, state string"))).collect()
    assert sum(len(r["read_turns"]) for r in out) == len(rows)
    said = {(r["conv_id"], t["role"], t["text"]) for r in out for t in r["read_turns"]}
    assert said == {(c, role or "", text or "") for c, _, role, text, _ in rows}
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_odd_urls(spark):
    pages = spark.createDataFrame([(1, None, "h"), (2, "", "h"), (3, "no scheme", "h"), (4, "https://A.EXAMPLE.net/en/x?q", "h"), (5, "https://example.net", "h"), (6, "http://x.org/fr/#a://b", "h"), (6, "http://x.org/fr/#a://b", "h")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, None, None), (4, 0, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, labels).collect()}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[5] == ("example.net", "", None, "allow")
    assert got[6] == ("x.org", "/fr/", "org/fr/", "allow")
    assert urls.judge(pages.limit(0), labels.limit(0)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (200, 200), (59, 7), (300, 299)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[102] == 100 and got[200] == 200 and got[300] == 299


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "unused")
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.collect()


def test_stages_without_a_length_column(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).drop("n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "unused").columns == docs.columns, name


@pytest.mark.parametrize("rows", [ROWS, []])
def test_run_on_odd_tables(spark, tmp_path, rows):
    """Nulls, repeated and empty rows, extra columns, and no rows at all: the packed pieces of what is kept."""
    prose = "Every lamp on the quiet street was lit before the rain began to fall upon the old stone bridge near our house tonight"
    more = [(9, prose, "en", "s", len(prose), 0.1, None, 3), (None, prose.replace("lamp", "door").replace("rain", "snow").replace("old", "new"), "en", "s", 1, None, None, None)] if rows else []
    spark.createDataFrame(rows + more, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} >= ({9, None} if rows else set()) and all(0 < r["length"] <= 4096 for r in out)
    assert bool(out) == bool(rows)
    last = packing.stage(spark, spark.createDataFrame(rows, SCHEMA), "unused").collect()
    assert sorted(str(r["doc_id"]) for r in last if r["piece"] == 0) == sorted(str(r[0]) for r in rows)


def test_pipeline_by_hand(spark):
    """run() against its stages' plain versions: kept documents, one of each group, cut and masked texts."""
    from test_brute_force import plain_components

    small = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    import pyarrow as pa

    kept = {i: t for (i, t), k in zip(docs.items(), quality.measure(pa.array(docs.values()))[-1].to_pylist(), strict=True) if k}
    one = {i: kept[i] for i, (_, c) in plain_components(kept).items() if c == i}
    seen = {}
    for i, t in one.items():
        b = t.encode()
        for j in range(len(b) - 199):
            seen[b[j : j + 200]] = seen.get(b[j : j + 200], 0) + 1
    lengths = {}
    encoder = packing.WordEncoder(packing.tokenizer_path())
    cut = {}
    for i, t in one.items():
        b = t.encode()
        cover = bytearray(len(b))
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                cover[j : j + 200] = b"\1" * 200
        cut[i] = bytes(x for x, c in zip(b, cover, strict=True) if not c).decode("utf-8", "ignore")
    for i, t in cut.items():
        lengths[i] = len(encoder.ids(pa.array([pii.masked(t, pii.patterns(t))]))[0])
    rows = corpus_pipeline.run(spark, small).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == lengths
