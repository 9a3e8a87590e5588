"""Shortlists of classes for queries, rare tokens first, and how often they hold the right class.

Only tokens that few classes have are joined at first. A class that shares none of them can gain no more than the weight
of the query's common tokens; where that can't reach the k-th best partial score, the shortlist lies among the classes
already met, and of those only the ones whose bound still reaches it are completed, by looking into their own tokens. The
few queries that are left open are scored in full. Weights are whole millionths, so every order of adding gives one sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables as T
from . import evidence as E

#: Share of the classes beyond which a token is common.
COMMON = 0.1
#: Lead of the best score at which a choice is made (fixed value), and how far rounding can move a score.
MARGIN, SLACK = 0.15, 1e-4


def weights(classes: DataFrame) -> DataFrame:
    """token, how many classes have it, and its weight in millionths."""
    n = F.lit(classes.count())
    return E.tokens(classes, "item_id").groupBy("token").agg(F.count("*").alias("df")).withColumn("w", F.round(F.log(1 + n / F.col("df")) * 1e6).cast("long"))


def shortlist(queries: DataFrame, classes: DataFrame, k: int = 5, common: float = COMMON) -> DataFrame:
    """doc_id, item_id, score, place: the first k classes of each query by shared weight over the query's own."""
    most = max(1, int(common * classes.count()))
    has = E.tokens(classes, "item_id")
    known = T.written(E.tokens(queries, "doc_id").join(weights(classes), "token"), "query-tokens")
    rare = F.col("df") <= most
    whole = known.groupBy("doc_id").agg(F.sum("w").alias("weight"), F.coalesce(F.sum(F.when(~rare, F.col("w"))), F.lit(0)).alias("rest"), F.collect_list(F.when(~rare, F.struct("token", "w"))).alias("commons"))
    met = known.filter(rare).select("doc_id", "token", "w").join(has, "token").groupBy("doc_id", "item_id").agg(F.sum("w").alias("s"))
    ranked = met.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("s"), "item_id")))
    kth = ranked.filter(F.col("at") == k).select("doc_id", F.col("s").alias("kth"))
    # closed: nothing unseen can come in, however the scores are rounded
    state = T.written(whole.join(kth, "doc_id", "left").withColumn("closed", F.coalesce(F.col("rest") < F.col("kth") - SLACK * F.col("weight"), F.lit(False))), "query-state")
    closed = state.filter("closed")
    live = ranked.join(closed, "doc_id").filter(F.col("s") + F.col("rest") >= F.col("kth") - SLACK * F.col("weight"))
    common_of = has.join(weights(classes).filter(~rare).select("token"), "token").groupBy("item_id").agg(F.collect_list("token").alias("own"))
    gained = F.aggregate(F.filter("commons", lambda t: F.array_contains("own", t["token"])), F.lit(0).cast("long"), lambda a, t: a + t["w"])
    full = live.join(common_of, "item_id", "left").select("doc_id", "item_id", "weight", (F.col("s") + F.coalesce(gained, F.lit(0))).alias("s"))
    left = known.join(state.filter("NOT closed").select("doc_id", "weight"), "doc_id").select("doc_id", "weight", "token", "w")
    full = full.unionByName(left.join(has, "token").groupBy("doc_id", "item_id").agg(F.first("weight").alias("weight"), F.sum("w").alias("s")).select("doc_id", "item_id", "weight", "s"))
    scored = full.select("doc_id", "item_id", F.round(F.col("s") / F.col("weight"), 4).alias("score"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "item_id"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def accuracy(labelled: DataFrame, classes: DataFrame, k: int = 5) -> DataFrame:
    """Counts over queries (doc_id, text, gold or null): a choice that is right, a shortlist that holds the class whether a
    choice is made or not, choices not made, and queries without a class for which none is made."""
    s = shortlist(labelled.select("doc_id", "text"), classes, k)
    per = s.groupBy("doc_id").agg(F.collect_list("item_id").alias("items"), F.max(F.when(F.col("place") == 1, F.struct("item_id", "score"))).alias("best"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    chosen = F.when(F.round(F.col("best.score") - F.col("second"), 4) >= MARGIN, F.col("best.item_id"))
    j = labelled.select("doc_id", "gold").join(per.select("doc_id", "items", chosen.alias("chosen")), "doc_id", "left")
    has, no = F.col("gold").isNotNull(), F.col("chosen").isNull()
    counts = {
        "top_1": (F.coalesce(F.col("chosen") == F.col("gold"), F.lit(False)), has), f"top_{k}": (F.coalesce(F.array_contains("items", F.col("gold")), F.lit(False)), has),
        "abstained": (no, has), "must_abstain_held": (no, ~has),
    }
    sums = j.agg(*(c for m, (hit, of) in counts.items() for c in (F.count_if(hit & of).alias(f"n_{m}"), F.count_if(of).alias(f"d_{m}"))))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("numerator"), F.col(f"d_{m}").alias("denominator")) for m in counts))))


def labelled_queries(s, d) -> DataFrame:
    """Every class asked for by two words of three of its own text, and every document, which has no class."""
    words = F.split("text", " ")
    kept = F.array_join(F.filter(words, lambda w, i: i % 3 != 1), " ")
    own = T.table(s, d, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), kept.alias("text"), F.col("item_id").alias("gold"))
    return own.unionByName(T.table(s, d, "documents").select("doc_id", "text", F.lit(None).cast("long").alias("gold")))


QUERIES = {"agg_topk_accuracy": lambda s, d: accuracy(labelled_queries(s, d), T.table(s, d, "benchmark"))}

ORACLES = {
    "agg_topk_accuracy": f"""WITH lq AS (SELECT -item_id - 1 AS doc_id, list_aggregate([w for w, i in string_split(text, ' ') if (i - 1) % 3 <> 1], 'string_agg', ' ') AS text, item_id AS gold FROM benchmark UNION ALL SELECT doc_id, text, NULL FROM documents),
c AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM benchmark),
wt AS (SELECT token, CAST(round(ln(1 + (SELECT count(*) FROM benchmark) / count(*)) * 1000000) AS BIGINT) AS w FROM c GROUP BY 1),
q AS (SELECT doc_id, token, w FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM lq) JOIN wt USING (token)),
sc AS (SELECT doc_id, item_id, round(sum(w) / any_value(weight), 4) AS score FROM q JOIN c USING (token) JOIN (SELECT doc_id, sum(w) AS weight FROM q GROUP BY 1) USING (doc_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS place FROM sc QUALIFY place <= 5),
b AS (SELECT doc_id, list(item_id) AS items, CASE WHEN round(max(score) FILTER (place = 1) - coalesce(max(score) FILTER (place = 2), 0), 4) >= {MARGIN} THEN max(item_id) FILTER (place = 1) END AS chosen FROM r GROUP BY 1),
j AS (SELECT gold, items, chosen FROM lq LEFT JOIN b USING (doc_id))
SELECT 'top_1' AS metric, count_if(chosen = gold) AS numerator, count(gold) AS denominator FROM j UNION ALL SELECT 'top_5', count_if(list_contains(items, gold)), count(gold) FROM j
UNION ALL SELECT 'abstained', count_if(gold IS NOT NULL AND chosen IS NULL), count(gold) FROM j UNION ALL SELECT 'must_abstain_held', count_if(gold IS NULL AND chosen IS NULL), count_if(gold IS NULL) FROM j"""
}
