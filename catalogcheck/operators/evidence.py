"""Evidence from documents: words in boxes and windows, table cells, class retrieval, embeddings, crosswalks.

Band joins always carry an equality key (document and page, plus a bucket of the position), so that no inequality is
joined alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables as T

WINDOW = 8
PAGE = 200
#: Queries and vectors that one task of the embedding search holds, about.
BLOCK, SHARD = 512, 20_000


def words(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 0), word, page, char span and box of every word between single spaces."""
    w = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("pos", "word"))
    line = F.floor(F.pmod("pos", F.lit(PAGE)) / 10)
    return w.select(
        "doc_id", "pos", "word", F.floor(F.col("pos") / PAGE).cast("int").alias("page"),
        (F.pmod("pos", F.lit(10)) * 50).alias("x0"), (F.pmod("pos", F.lit(10)) * 50 + 4 * F.length("word")).alias("x1"), (line * 12).alias("y0"),
    )


def word_offsets(docs: DataFrame) -> DataFrame:
    """First and last character of each word: running lengths within the document."""
    w = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("pos", "word"))
    end = F.sum(F.length("word") + 1).over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return w.withColumn("end", end).select("doc_id", "pos", (F.col("end") - F.length("word")).alias("start"), "end", "word")


def near_anchor(w: DataFrame, anchor: str, shape: str, reach: int = WINDOW) -> DataFrame:
    """Value-shaped words within ``reach`` words of an anchor on the same page: anchors are filed in both buckets that
    their reach touches, and matched by bucket."""
    size = 2 * reach + 1
    a = w.filter(F.lower(F.regexp_replace("word", "[.,]", "")) == anchor).select("doc_id", "page", F.col("pos").alias("anchor_pos"))
    a = a.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor((F.col("anchor_pos") - reach) / size), F.floor((F.col("anchor_pos") + reach) / size)))))
    v = w.filter(F.regexp_replace("word", "[.,]", "").rlike(shape)).withColumn("bucket", F.floor(F.col("pos") / size))
    out = v.join(a, ["doc_id", "page", "bucket"]).filter((F.abs(F.col("pos") - F.col("anchor_pos")) <= reach) & (F.col("pos") != F.col("anchor_pos")))
    return out.select("doc_id", "anchor_pos", "pos", "word", F.abs(F.col("pos") - F.col("anchor_pos")).cast("int").alias("distance"))


def nearest(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "anchor_pos").agg(F.min_by("word", F.struct("distance", "pos")).alias("value"), F.countDistinct("word").alias("candidates"))


def tokens(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0))).alias("token"))


def retrieve(queries: DataFrame, classes: DataFrame, k: int = 5) -> DataFrame:
    """Classes by IDF-weighted overlap with each query, over the query's weight; the first k.

    A query is its distinct known tokens, dealt once by document: weights, scores and places then need no further exchange.
    """
    c = tokens(classes, "item_id")
    n = classes.count()
    idf = c.groupBy("token").agg(F.round(F.log(1 + F.lit(n) / F.count("*")), 6).alias("idf"))
    q = tokens(queries, "doc_id").join(idf, "token").repartition("doc_id")
    weight = q.groupBy("doc_id").agg(F.sum("idf").alias("weight"))
    score = q.join(c, "token").groupBy("doc_id", "item_id").agg(F.sum("idf").alias("s")).join(weight, "doc_id")
    score = score.select("doc_id", "item_id", F.round(F.col("s") / F.col("weight"), 4).alias("score"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "item_id"))
    return score.withColumn("place", place).filter(F.col("place") <= k)


def _queries(s, d):
    """The whole text of every document as a class query."""
    return T.table(s, d, "documents").select("doc_id", "text")


def resolve_class(s, d) -> DataFrame:
    """Commit to the best class when it leads by 0.15, else abstain with a reason."""
    r = retrieve(_queries(s, d), T.table(s, d, "benchmark"), 2)
    best = r.groupBy("doc_id").agg(F.max(F.when(F.col("place") == 1, F.col("item_id"))).alias("item_id"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("score"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    margin = F.round(F.col("score") - F.col("second"), 4)
    return best.select("doc_id", F.when(margin >= 0.15, F.col("item_id")).alias("item_id"), margin.alias("margin"), F.when(margin < 0.15, "margin_too_small").alias("reason"))


def embedding_search(vectors: DataFrame, k: int = 5) -> DataFrame:
    """Cosine neighbours of every vector whose id is divisible by 20, against all vectors (ties: the lesser id).

    The query set is dealt to blocks of about BLOCK and the vectors to shards of about SHARD; a task holds one block and one
    shard and keeps each query's k best of it, so what is exchanged after that is k rows for each query and shard.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    q = v.filter("vec_id % 20 = 0")
    sizes = v.agg(F.count("*").alias("rows"), F.count_if(F.col("vec_id") % 20 == 0).alias("queries")).first()
    blocks, shards = -(-max(1, sizes["queries"]) // BLOCK), -(-max(1, sizes["rows"]) // SHARD)

    def dealt(frame: DataFrame, own: str, own_count: int, other: str, other_count: int) -> DataFrame:
        number = F.pmod(F.xxhash64("vec_id"), F.lit(own_count)).cast("int")
        return frame.select("*", number.alias(own), F.explode(F.sequence(F.lit(0), F.lit(other_count - 1))).alias(other))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "cosine": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if not len(left) or not len(right):
            return empty
        x, y = (np.stack(f["embedding"].to_numpy()) for f in (left, right))
        x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        cosine, ids = np.round(x @ y.T, 4), right["vec_id"].to_numpy()
        out = []
        for i, one in enumerate(left["vec_id"]):
            row = np.where(ids == one, -np.inf, cosine[i])
            first = np.lexsort((ids, -row))[:k]
            out += [(one, ids[j], row[j]) for j in first if ids[j] != one]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "cosine"]) if out else empty

    left, right = dealt(q, "block", blocks, "shard", shards), dealt(v, "shard", shards, "block", blocks)
    pairs = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(best, "query_id long, vec_id long, cosine double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return pairs.withColumn("place", place).filter(F.col("place") <= k)


def table_cells(s, d) -> DataFrame:
    """Orders as table rows of their customer's document: headers are columns; some first cells are merged downwards."""
    o = T.table(s, d, "orders")
    return o.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("row"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.lit(h).alias("header"), F.col(c).cast("string").alias("text")) for i, (h, c) in enumerate((("status", "o_orderstatus"), ("priority", "o_orderpriority"), ("key", "o_orderkey")))])).alias("c"),
    ).select("doc_id", "row", "c.col", "c.header", F.when((F.col("c.col") == 0) & (F.col("row") % 3 == 1), None).otherwise(F.col("c.text")).alias("text"))


def merged_cells(cells: DataFrame) -> DataFrame:
    """A missing cell takes the text of the nearest row above that has one in its column."""
    w = Window.partitionBy("doc_id", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return cells.select("doc_id", "row", "col", "header", F.last("text", ignorenulls=True).over(w).alias("text"), F.col("text").isNull().alias("merged"))


def table_lookup(s, d) -> DataFrame:
    """The cell of a wanted header in the row whose key cell equals the key."""
    c = merged_cells(table_cells(s, d))
    key = c.filter("header = 'key'").select("doc_id", "row", F.col("text").alias("key"))
    return c.filter("header = 'status'").join(key, ["doc_id", "row"]).select("doc_id", "key", "text", "merged")


_W = "w AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS word, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) - 1 AS pos FROM documents)"
_A = r"a AS (SELECT doc_id, pos AS anchor_pos FROM w WHERE lower(regexp_replace(word, '[.,]', '', 'g')) = 'from'), v AS (SELECT doc_id, pos, word FROM w WHERE regexp_matches(regexp_replace(word, '[.,]', '', 'g'), '^[a-z]{2}$')), f AS (SELECT v.doc_id, anchor_pos, pos, word, abs(pos - anchor_pos) AS distance FROM v JOIN (SELECT doc_id, anchor_pos, unnest(range(anchor_pos - 8, anchor_pos + 9)) AS at FROM a) b ON v.doc_id = b.doc_id AND v.pos = b.at WHERE pos <> anchor_pos AND floor(pos / 200) = floor(anchor_pos / 200))"
_R = """c AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM benchmark),
idf AS (SELECT token, round(ln(1 + (SELECT count(*) FROM benchmark) / count(*)), 6) AS idf FROM c GROUP BY 1),
q AS (SELECT doc_id, token, idf FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM documents) JOIN idf USING (token)),
sc AS (SELECT doc_id, item_id, round(sum(idf) / any_value(weight), 4) AS score FROM q JOIN c USING (token) JOIN (SELECT doc_id, sum(idf) AS weight FROM q GROUP BY 1) USING (doc_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS place FROM sc)"""
_CELLS = """cells AS (SELECT o_custkey AS doc_id, o_orderkey AS row, col, header, CASE WHEN col = 0 AND o_orderkey % 3 = 1 THEN NULL ELSE CASE col WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderpriority ELSE CAST(o_orderkey AS VARCHAR) END END AS text FROM orders, (VALUES (0, 'status'), (1, 'priority'), (2, 'key')) h(col, header)),
m AS (SELECT doc_id, row, col, header, last_value(text IGNORE NULLS) OVER (PARTITION BY doc_id, col ORDER BY row ROWS UNBOUNDED PRECEDING) AS text, text IS NULL AS merged FROM cells)"""


def _words(s, d):
    return words(T.table(s, d, "documents"))


def _window(s, d):
    return near_anchor(_words(s, d), "from", "^[a-z]{2}$")


def window_digest(found: DataFrame) -> DataFrame:
    """What was found in each document: pairs, different words, and sums that no order changes but any other pair would."""
    mark = (F.col("anchor_pos") * 7919 + F.col("pos") * 104729 + F.length("word") * 31) % 1000003
    return found.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.countDistinct("word").alias("different"), F.sum("distance").cast("long").alias("distances"), F.sum(mark).cast("long").alias("mark"))


QUERIES = {
    "win_word_offsets": lambda s, d: word_offsets(T.table(s, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("words"), F.max("end").alias("last_end"), F.sum("start").cast("long").alias("starts")),
    "agg_document_readability": lambda s, d: _words(s, d).groupBy("doc_id").agg(F.count_if(F.col("word") != "").alias("words"), (F.max("page") + 1).cast("int").alias("pages")).select("doc_id", "words", "pages", (F.col("words") / F.col("pages") < 20).alias("sparse")),
    "join_text_window": lambda s, d: window_digest(_window(s, d)),
    "win_nearest_value": lambda s, d: nearest(_window(s, d)),
    "audit_derive_window": lambda s, d: nearest(_window(s, d)).select("doc_id", "anchor_pos", F.when(F.col("candidates") == 1, F.col("value")).alias("value"), F.when(F.col("candidates") > 1, "several_values").alias("declined")),
    "audit_raw_confidence": lambda s, d: _window(s, d).withColumn("c", F.count("*").over(Window.partitionBy("doc_id", "anchor_pos"))).select("doc_id", "anchor_pos", "pos", F.round(0.6 * 0.5 / (1 + 0.25 * F.col("distance")) / F.sqrt("c"), 6).alias("confidence")),
    "join_counter_evidence": lambda s, d: (lambda f: f.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "anchor_pos").orderBy("distance", "pos"))).filter("k <= 3").select("doc_id", "anchor_pos", "pos", "distance"))(near_anchor(_words(s, d), "from", "^(with|avec|mit|con)$", 40)),
    "join_merged_cell": lambda s, d: merged_cells(table_cells(s, d)),
    "join_table_cell": table_lookup,
    "audit_class_retrieve": lambda s, d: retrieve(_queries(s, d), T.table(s, d, "benchmark")).select("doc_id", "item_id", "score"),
    "top_retrieve_k": lambda s, d: retrieve(_queries(s, d), T.table(s, d, "benchmark"), 50).groupBy("doc_id").agg(F.count("*").alias("candidates"), F.max("score").alias("best")),
    "win_select_margin": lambda s, d: resolve_class(s, d).select("doc_id", "margin"),
    "audit_class_resolve": resolve_class,
    "udf_embedding_retrieve": lambda s, d: embedding_search(T.table(s, d, "embeddings")).select("query_id", "vec_id", "place"),
    "src_code_hierarchy": lambda s, d: T.table(s, d, "nation").join(T.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.format_string("%02d%02d", "r_regionkey", "n_nationkey").alias("code"), F.format_string("%02d", "r_regionkey").alias("parent"), F.col("n_name").alias("title")),
    "join_crosswalk_validate": lambda s, d: T.table(s, d, "supplier").join(T.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.when(F.col("n_nationkey").isNull(), "unknown_code").when(F.col("s_acctbal") < 0, "one_sided").alias("problem")).filter("problem IS NOT NULL"),
    "join_split_leak": lambda s, d: T.table(s, d, "documents").select("doc_id", "source").join(T.table(s, d, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("leaks")),
    "set_run_diff": lambda s, d: (lambda a, b: a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second"))))(T.table(s, d, "part").select("p_partkey", "p_size"), T.table(s, d, "part").select("p_partkey", (F.col("p_size") + (F.col("p_partkey") % 50 == 0).cast("int")).alias("p_size"))),
}

ORACLES = {
    "win_word_offsets": f"WITH {_W}, o AS (SELECT doc_id, pos, length(word) AS n, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(word) - 1 AS start FROM w) SELECT doc_id, count(*) AS words, CAST(max(start + n) AS BIGINT) AS last_end, CAST(sum(start) AS BIGINT) AS starts FROM o GROUP BY 1",
    "agg_document_readability": f"WITH {_W} SELECT *, words / pages < 20 AS sparse FROM (SELECT doc_id, count_if(word <> '') AS words, CAST(floor(max(pos) / 200) + 1 AS INT) AS pages FROM w GROUP BY 1)",
    "join_text_window": f"WITH {_W}, {_A} SELECT doc_id, count(*) AS pairs, count(DISTINCT word) AS different, CAST(sum(distance) AS BIGINT) AS distances, CAST(sum((anchor_pos * 7919 + pos * 104729 + length(word) * 31) % 1000003) AS BIGINT) AS mark FROM f GROUP BY 1",
    "win_nearest_value": f"WITH {_W}, {_A} SELECT doc_id, anchor_pos, arg_min(word, (distance, pos)) AS value, count(DISTINCT word) AS candidates FROM f GROUP BY 1, 2",
    "audit_derive_window": f"WITH {_W}, {_A} SELECT doc_id, anchor_pos, CASE WHEN count(DISTINCT word) = 1 THEN min(word) END AS value, CASE WHEN count(DISTINCT word) > 1 THEN 'several_values' END AS declined FROM f GROUP BY 1, 2",
    "audit_raw_confidence": f"WITH {_W}, {_A} SELECT doc_id, anchor_pos, pos, round(0.3 / (1 + 0.25 * distance) / sqrt(count(*) OVER (PARTITION BY doc_id, anchor_pos)), 6) AS confidence FROM f",
    "join_counter_evidence": f"WITH {_W}, {_A.replace('^[a-z]{2}$', '^(with|avec|mit|con)$').replace('range(anchor_pos - 8, anchor_pos + 9)', 'range(anchor_pos - 40, anchor_pos + 41)')} SELECT doc_id, anchor_pos, pos, distance FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, anchor_pos ORDER BY distance, pos) <= 3",
    "join_merged_cell": f"WITH {_CELLS} SELECT * FROM m",
    "join_table_cell": f"WITH {_CELLS} SELECT m.doc_id, k.text AS key, m.text, m.merged FROM m JOIN m k ON m.doc_id = k.doc_id AND m.row = k.row AND k.header = 'key' WHERE m.header = 'status'",
    "audit_class_retrieve": f"WITH {_R} SELECT doc_id, item_id, score FROM r WHERE place <= 5",
    "top_retrieve_k": f"WITH {_R} SELECT doc_id, count(*) AS candidates, max(score) AS best FROM r WHERE place <= 50 GROUP BY 1",
    "win_select_margin": f"WITH {_R} SELECT doc_id, round(max(score) FILTER (place = 1) - coalesce(max(score) FILTER (place = 2), 0), 4) AS margin FROM r WHERE place <= 2 GROUP BY 1",
    "audit_class_resolve": f"WITH {_R}, b AS (SELECT doc_id, max(item_id) FILTER (place = 1) AS item_id, round(max(score) FILTER (place = 1) - coalesce(max(score) FILTER (place = 2), 0), 4) AS margin FROM r WHERE place <= 2 GROUP BY 1) SELECT doc_id, CASE WHEN margin >= 0.15 THEN item_id END AS item_id, margin, CASE WHEN margin < 0.15 THEN 'margin_too_small' END AS reason FROM b",
    "udf_embedding_retrieve": "WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 4) AS cosine FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id) SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS place FROM p QUALIFY place <= 5",
    "src_code_hierarchy": "SELECT printf('%02d%02d', r_regionkey, n_nationkey) AS code, printf('%02d', r_regionkey) AS parent, n_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_crosswalk_validate": "SELECT s_suppkey, CASE WHEN n_nationkey IS NULL THEN 'unknown_code' WHEN s_acctbal < 0 THEN 'one_sided' END AS problem FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey IS NULL OR s_acctbal < 0",
    "join_split_leak": "SELECT source, count(*) AS leaks FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1",
    "set_run_diff": "WITH a AS (SELECT p_partkey, p_size FROM part), b AS (SELECT p_partkey, CAST(p_size + CASE WHEN p_partkey % 50 = 0 THEN 1 ELSE 0 END AS INT) AS p_size FROM part) SELECT *, 'first' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
}
