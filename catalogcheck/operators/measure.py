"""Measurement: intervals, grounding scores, risk and coverage, calibration, agreement, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables as T
from .numbering import numbered

Z = 1.96


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson interval of k successes of n; (0, 0) without trials."""
    p = k / n
    mid = p + Z * Z / (2 * n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    d = 1 + Z * Z / n
    low = F.greatest(F.lit(0.0), (mid - half) / d)
    high = F.least(F.lit(1.0), (mid + half) / d)
    return F.when(n == 0, 0.0).otherwise(F.round(low, 6)), F.when(n == 0, 0.0).otherwise(F.round(high, 6))


def iou(dx: Column, width: float = 60.0, height: float = 10.0) -> Column:
    """Overlap of two equal boxes shifted by dx against their union; 0 without area."""
    inter = F.greatest(F.lit(0.0), F.lit(width) - dx) * height
    return inter / (2 * width * height - inter)


def graded(rows: DataFrame) -> DataFrame:
    """Evaluated fields with overlap, whether grounded, and whether the answer was right."""
    over = F.when(~F.col("abstained"), F.round(iou(F.col("shift") * 8.0), 6))
    out = rows.withColumn("iou", over)
    return out.withColumns({"grounded": F.coalesce(F.col("iou") >= 0.5, F.lit(False)), "right": F.when(~F.col("abstained"), F.col("value_equal"))})


def f1(rows: DataFrame, hit: Column, by: list[str]) -> DataFrame:
    """Precision over answers, recall over all, and their harmonic mean, per group."""
    agg = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col("abstained")).alias("answered"), F.count_if(hit).alias("hits"))
    p, r = F.try_divide("hits", "answered"), F.col("hits") / F.col("n")
    return agg.withColumns({"precision": F.round(F.coalesce(p, F.lit(0.0)), 6), "recall": F.round(r, 6), "f1": F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6)})


def ordered_prefix(rows: DataFrame) -> DataFrame:
    """Rows with their place by confidence (descending, then id) and the running number of wrong ones."""
    wrong = (~F.coalesce("right", F.lit(False))).cast("long")
    out = numbered(rows.withColumn("bad", wrong), ("confidence", "id"), ("confidence",), ("bad",))
    return out.select("id", "confidence", "right", "flagged", "wrong", "place", F.col("sum_bad").alias("errors"))


def _eval(s, d):
    return graded(T.view(s, d, "fx_eval"))


def _answered(s, d):
    return _eval(s, d).filter("NOT abstained")


def risk_coverage(s, d):
    """Error rate at every hundredth of coverage."""
    o = ordered_prefix(_answered(s, d))
    total = o.agg(F.count("*").alias("total"))
    step = o.crossJoin(total).withColumn("step", F.ceil(F.col("place") * 100 / F.col("total")))  # one row
    last = step.groupBy("step").agg(F.max(F.struct("place", "errors")).alias("m"))
    return last.select(F.col("step").cast("long").alias("coverage"), F.round(F.col("m.errors") / F.col("m.place"), 6).alias("risk"))


def selective(s, d):
    """Accuracy within the most confident 20, 40 and 60 percent, with intervals."""
    o = ordered_prefix(_answered(s, d))
    total = o.agg(F.count("*").alias("total"))
    shares = F.explode(F.array(F.lit(20), F.lit(40), F.lit(60))).alias("percent")
    cut = o.crossJoin(total).select("*", shares).filter(F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("total") * F.col("percent") / 100)))  # one row
    agg = cut.groupBy("percent").agg(F.count("*").alias("n"), F.count_if("right").alias("hits"), F.count_if("flagged").alias("raised"), F.count_if(F.col("flagged") & F.col("wrong")).alias("true_raised"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return agg.select("percent", "n", F.round(F.col("hits") / F.col("n"), 6).alias("accuracy"), low.alias("low"), high.alias("high"), F.round(F.col("true_raised") / F.col("raised"), 6).alias("precision"))


def reliability(rows: DataFrame, by: list[str], bins: int = 5) -> DataFrame:
    """Equal bins of a score against the share of positive labels; the last bin is closed, empty ones are left out."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("score").cast("double")), 6).alias("predicted"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("observed"))


def ece(s, d):
    r = reliability(T.view(s, d, "fx_labels"), ["lang"])
    return r.groupBy("lang").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))) / F.sum("n"), 5).alias("ece"))


def kappa(s, d):
    """Agreement of the two labels beyond chance, per language and over all."""
    n = T.view(s, d, "fx_labels").rollup("lang").agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == F.col("toxic")).alias("same"), F.sum(F.col("quality").cast("long")).alias("q"), F.sum(F.col("toxic").cast("long")).alias("t")
    )
    po = F.col("same") / F.col("n")
    pe = (F.col("q") * F.col("t") + (F.col("n") - F.col("q")) * (F.col("n") - F.col("t"))) / (F.col("n") * F.col("n"))
    return n.select("lang", "n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(F.when(pe == 1, 0.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def platt_fit(rows: DataFrame, steps: int = 25) -> tuple[float, float]:
    """Two-parameter logistic fit by Newton steps; every step is one distributed aggregate of five sums."""
    a, b = 0.0, 0.0
    x, y = F.col("score"), F.col("quality")
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(a * x + b)))
        r = rows.agg(*[F.sum(c) for c in ((y - p) * x, y - p, p * (1 - p) * x * x, p * (1 - p) * x, p * (1 - p))]).first()
        if r[0] is None:
            return a, b
        g0, g1, h00, h01, h11 = r[0] - 1e-6 * a, r[1] - 1e-6 * b, r[2] + 1e-6, r[3], r[4] + 1e-6
        det = h00 * h11 - h01 * h01
        da, db = (g0 * h11 - g1 * h01) / det, (g1 * h00 - g0 * h01) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def agg_platt_fit(s, d):
    a, b = platt_fit(T.view(s, d, "fx_labels"))
    return s.range(1).select(F.lit(round(a, 6)).alias("slope"), F.lit(round(b, 6)).alias("intercept"))


def audit_calibrate(s, d):
    a, b = platt_fit(T.view(s, d, "fx_labels"))
    return T.view(s, d, "fx_labels").select("doc_id", F.round(1 / (1 + F.exp(-(a * F.col("score") + b))), 6).alias("probability"))


def drift(s, d):
    """Daily windows of events: bins of a score against an outcome, tripped where the interval leaves the bin."""
    e = T.table(s, d, "events").select(F.window("ts", "1 day")["start"].alias("day"), (F.pmod("event_id", F.lit(100)) / 100.0).alias("score"), (F.col("event_type") == "purchase").cast("long").alias("hit"))
    b = e.groupBy("day", F.floor(F.col("score") * 5).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    b = b.withColumns({"low": low, "high": high})
    return b.select("day", "bin", "n", "hits", "low", "high", ((F.col("high") < F.col("bin") / 5) | (F.col("low") > (F.col("bin") + 1) / 5)).alias("tripped"))


def largest_remainder(s, d, budget: int = 1000):
    """A budget shared among classes by size in whole labels; the rest goes to the largest remainders."""
    c = T.view(s, d, "fx_classes")
    c = c.crossJoin(c.agg(F.sum("skus").alias("total")))  # one row
    c = c.withColumns({"base": F.floor(F.lit(budget) * F.col("skus") / F.col("total")).cast("long"), "left": F.pmod(F.lit(budget) * F.col("skus"), F.col("total"))})
    c = c.crossJoin(c.agg((F.lit(budget) - F.sum("base")).alias("rest")))  # one row
    k = F.row_number().over(Window.orderBy(F.desc("left"), "class_id"))  # one row per class
    return c.select("class_id", (F.col("base") + (k <= F.col("rest")).cast("long")).alias("labels"))


def greedy(s, d, budget: int = 600, floor_: int = 15):
    """Largest classes first, each its floor, while the budget lasts."""
    c = T.view(s, d, "fx_classes").withColumn("k", F.row_number().over(Window.orderBy(F.desc("skus"), "class_id")))  # one row per class
    return c.select("class_id", "skus", F.when((F.col("skus") >= 2) & (F.col("k") * floor_ <= budget), floor_).otherwise(0).alias("labels"))


def budget_sweep(s, d):
    c = T.view(s, d, "fx_classes").withColumn("k", F.row_number().over(Window.orderBy(F.desc("skus"), "class_id")))  # one row per class
    budgets = F.explode(F.array(*[F.lit(b) for b in (150, 300, 600, 1200)])).alias("budget")
    given = c.select("*", budgets).withColumn("cleared", F.col("k") * 15 <= F.col("budget"))
    return given.groupBy("budget").agg(F.count_if("cleared").alias("classes"), F.sum(F.when(F.col("cleared"), F.col("skus")).otherwise(0)).alias("skus"))


_PRE = """WITH e AS (SELECT *, CASE WHEN NOT abstained THEN round(greatest(0.0, 60.0 - shift * 8.0) * 10.0 / (1200.0 - greatest(0.0, 60.0 - shift * 8.0) * 10.0), 6) END AS iou FROM fx_eval),
g AS (SELECT *, coalesce(iou >= 0.5, false) AS grounded, CASE WHEN NOT abstained THEN value_equal END AS right_ FROM e)"""
_ORDER = f"""{_PRE}, o AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, id) AS place, sum(CASE WHEN right_ THEN 0 ELSE 1 END) OVER (ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING) AS errors, count(*) OVER () AS total FROM g WHERE NOT abstained)"""


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    p, z = f"({k} / {n}::DOUBLE)", "1.96"
    mid, half, d = f"({p} + {z} * {z} / (2 * {n}))", f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n})))", f"(1 + {z} * {z} / {n}::DOUBLE)"
    return f"round(greatest(0.0, ({mid} - {half}) / {d}), 6)", f"round(least(1.0, ({mid} + {half}) / {d}), 6)"


def _f1_sql(hit: str, by: str) -> str:
    g = f"SELECT {by + ', ' if by else ''}count(*) AS n, count_if(NOT abstained) AS answered, count_if({hit}) AS hits FROM g {'GROUP BY ' + by if by else ''}"
    return f"{_PRE}, a AS ({g}) SELECT *, round(coalesce(hits / nullif(answered, 0), 0), 6) AS precision, round(hits / n, 6) AS recall, round(coalesce(2 * (hits / nullif(answered, 0)) * (hits / n) / nullif(hits / nullif(answered, 0) + hits / n, 0), 0), 6) AS f1 FROM a"


_LOW, _HIGH = _wilson_sql("hits", "n")
_REL = "SELECT lang, CAST(least(floor(score * 5), 4) AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS predicted, round(avg(CAST(quality AS DOUBLE)), 6) AS observed FROM fx_labels GROUP BY 1, 2"

QUERIES = {
    "join_gold_pred": lambda s, d: _eval(s, d).select("id", "method", "abstained", "right"),
    "agg_grounding_f1": lambda s, d: f1(_eval(s, d), F.col("grounded") & F.coalesce("right", F.lit(False)), []),
    "agg_value_f1": lambda s, d: f1(_eval(s, d), F.coalesce("right", F.lit(False)), []),
    "agg_stratified_score": lambda s, d: f1(_eval(s, d), F.coalesce("right", F.lit(False)), ["method"]),
    "agg_score_by_attribute": lambda s, d: f1(_eval(s, d).withColumn("bucket", F.pmod("h", F.lit(7))), F.col("grounded"), ["bucket"]),
    "agg_wilson": lambda s, d: _eval(s, d).groupBy("method").agg(F.count("*").alias("n"), F.count_if("grounded").alias("hits")).select("method", "n", "hits", wilson(F.col("hits"), F.col("n"))[0].alias("low"), wilson(F.col("hits"), F.col("n"))[1].alias("high")),
    "win_risk_coverage": risk_coverage,
    "win_aurc": lambda s, d: risk_coverage(s, d).withColumn("before", F.lag("risk").over(Window.orderBy("coverage"))).agg(F.round(F.sum((F.col("risk") + F.col("before")) / 200), 5).alias("aurc")),
    "win_selective_accuracy": lambda s, d: selective(s, d).select("percent", "n", "accuracy", "low", "high"),
    "win_precision_at_coverage": lambda s, d: selective(s, d).select("percent", "precision"),
    "top_coverage_slice": lambda s, d: (lambda o: o.crossJoin(o.agg(F.count("*").alias("total"))).filter(F.col("place") <= F.ceil(F.col("total") / 10)).select("id", "place"))(ordered_prefix(_answered(s, d))),
    "eval_operating_point": lambda s, d: selective(s, d).select("percent", "accuracy", "precision", F.when(F.col("low") > 0.8, "usable").otherwise("not yet").alias("verdict")),
    "agg_defect_rate_by_kind": lambda s, d: _eval(s, d).cube("method", "flagged").agg(F.count("*").alias("n"), F.count_if("wrong").alias("wrong")),
    "agg_reliability_bins": lambda s, d: reliability(T.view(s, d, "fx_labels"), ["lang"]),
    "agg_ece": ece,
    "agg_cohen_kappa": kappa,
    "agg_platt_fit": agg_platt_fit,
    "audit_calibrate": audit_calibrate,
    "win_drift_window": drift,
    "agg_class_histogram": lambda s, d: T.view(s, d, "fx_classes").select("class_id", "parent_id", "skus"),
    "agg_coverage_point": lambda s, d: T.view(s, d, "fx_classes").groupBy("parent_id").agg(F.count_if(F.col("skus") >= 5).alias("cleared"), F.count_if(F.col("skus") < 5).alias("unreachable"), F.sum("skus").alias("skus")),
    "win_largest_remainder": largest_remainder,
    "top_greedy_allocation": greedy,
    "eval_budget_sweep": budget_sweep,
}

ORACLES = {k: T.with_views(q) for k, q in {
    "join_gold_pred": f"{_PRE} SELECT id, method, abstained, right_ AS \"right\" FROM g",
    "agg_grounding_f1": _f1_sql("grounded AND coalesce(right_, false)", ""),
    "agg_value_f1": _f1_sql("coalesce(right_, false)", ""),
    "agg_stratified_score": _f1_sql("coalesce(right_, false)", "method"),
    "agg_score_by_attribute": _f1_sql("grounded", "bucket").replace("FROM g GROUP", "FROM (SELECT *, h % 7 AS bucket FROM g) GROUP"),
    "agg_wilson": f"{_PRE}, a AS (SELECT method, count(*) AS n, count_if(grounded) AS hits FROM g GROUP BY 1) SELECT *, {_LOW} AS low, {_HIGH} AS high FROM a",
    "win_risk_coverage": f"{_ORDER} SELECT CAST(ceil(place * 100 / total) AS BIGINT) AS coverage, round(max_by(errors, place) / max(place), 6) AS risk FROM o GROUP BY 1",
    "win_aurc": f"{_ORDER}, r AS (SELECT CAST(ceil(place * 100 / total) AS BIGINT) AS coverage, round(max_by(errors, place) / max(place), 6) AS risk FROM o GROUP BY 1) SELECT round(sum((risk + b) / 200), 5) AS aurc FROM (SELECT *, lag(risk) OVER (ORDER BY coverage) AS b FROM r)",
    "win_selective_accuracy": f"{_ORDER}, a AS (SELECT percent, count(*) AS n, count_if(right_) AS hits FROM o, (VALUES (20), (40), (60)) p(percent) WHERE place <= greatest(1, ceil(total * percent / 100)) GROUP BY 1) SELECT percent, n, round(hits / n, 6) AS accuracy, {_LOW} AS low, {_HIGH} AS high FROM a",
    "win_precision_at_coverage": f"{_ORDER} SELECT percent, round(count_if(flagged AND wrong) / count_if(flagged), 6) AS precision FROM o, (VALUES (20), (40), (60)) p(percent) WHERE place <= greatest(1, ceil(total * percent / 100)) GROUP BY 1",
    "top_coverage_slice": f"{_ORDER} SELECT id, place FROM o WHERE place <= ceil(total / 10)",
    "eval_operating_point": f"{_ORDER}, a AS (SELECT percent, count(*) AS n, count_if(right_) AS hits, count_if(flagged) AS raised, count_if(flagged AND wrong) AS tr FROM o, (VALUES (20), (40), (60)) p(percent) WHERE place <= greatest(1, ceil(total * percent / 100)) GROUP BY 1) SELECT percent, round(hits / n, 6) AS accuracy, round(tr / raised, 6) AS precision, CASE WHEN {_LOW} > 0.8 THEN 'usable' ELSE 'not yet' END AS verdict FROM a",
    "agg_defect_rate_by_kind": f"{_PRE} SELECT method, flagged, count(*) AS n, count_if(wrong) AS wrong FROM g GROUP BY CUBE (method, flagged)",
    "agg_reliability_bins": _REL,
    "agg_ece": f"SELECT lang, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(predicted - observed)) / sum(n), 5) AS ece FROM ({_REL}) GROUP BY 1",
    "agg_cohen_kappa": "WITH a AS (SELECT lang, count(*) AS n, count_if(quality = toxic) AS same, sum(quality) AS q, sum(toxic) AS t FROM fx_labels GROUP BY ROLLUP (lang)), b AS (SELECT *, same / n AS po, (q * t + (n - q) * (n - t)) / (n * n) AS pe FROM a) SELECT lang, n, round(po, 6) AS observed, round(pe, 6) AS expected, round(CASE WHEN pe = 1 THEN 0.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM b",
    "win_drift_window": f"WITH b AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, CAST(floor(event_id % 100 / 100.0 * 5) AS INT) AS bin, count(*) AS n, count_if(event_type = 'purchase') AS hits FROM events GROUP BY 1, 2), c AS (SELECT *, {_LOW} AS low, {_HIGH} AS high FROM b) SELECT *, high < bin / 5 OR low > (bin + 1) / 5 AS tripped FROM c",
    "agg_class_histogram": "SELECT class_id, parent_id, skus FROM fx_classes",
    "agg_coverage_point": "SELECT parent_id, count_if(skus >= 5) AS cleared, count_if(skus < 5) AS unreachable, CAST(sum(skus) AS BIGINT) AS skus FROM fx_classes GROUP BY 1",
    "win_largest_remainder": "WITH a AS (SELECT class_id, 1000 * skus // sum(skus) OVER () AS base, 1000 * skus % sum(skus) OVER () AS rest FROM fx_classes), b AS (SELECT *, 1000 - sum(base) OVER () AS extra, row_number() OVER (ORDER BY rest DESC, class_id) AS k FROM a) SELECT class_id, CAST(base + CASE WHEN k <= extra THEN 1 ELSE 0 END AS BIGINT) AS labels FROM b",
    "top_greedy_allocation": "SELECT class_id, skus, CASE WHEN skus >= 2 AND row_number() OVER (ORDER BY skus DESC, class_id) * 15 <= 600 THEN 15 ELSE 0 END AS labels FROM fx_classes",
    "eval_budget_sweep": "SELECT budget, count_if(k * 15 <= budget) AS classes, CAST(coalesce(sum(skus) FILTER (k * 15 <= budget), 0) AS BIGINT) AS skus FROM (SELECT *, row_number() OVER (ORDER BY skus DESC, class_id) AS k FROM fx_classes), (VALUES (150), (300), (600), (1200)) b(budget) GROUP BY 1",
}.items()}

#: Fifteen Newton steps of the fit; they settle after fewer than ten.
_NEWTON = """WITH pts AS (SELECT doc_id, CAST(score AS DOUBLE) AS x, quality AS y FROM fx_labels),
it(k, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT k + 1, a + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01), b + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01)
  FROM (SELECT k, a, b, sum((y - p) * x) - 1e-6 * a AS g0, sum(y - p) - 1e-6 * b AS g1, sum(p * (1 - p) * x * x) + 1e-6 AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p)) + 1e-6 AS h11
    FROM (SELECT k, a, b, x, y, 1 / (1 + exp(-(a * x + b))) AS p FROM it, pts WHERE k < 15) GROUP BY k, a, b))"""
for _name, _tail in {
    "agg_platt_fit": "SELECT round(a, 6) AS slope, round(b, 6) AS intercept FROM it WHERE k = 15",
    "audit_calibrate": "SELECT doc_id, round(1 / (1 + exp(-(a * x + b))), 6) AS probability FROM it, pts WHERE k = 15",
}.items():
    ORACLES[_name] = T.with_views(f"{_NEWTON} {_tail}").replace("WITH ", "WITH RECURSIVE ", 1)
