"""The append-only ledger: current state is always a query over events. Claims, chains, revisions, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources import tables as T
from .numbering import numbered

DECISIONS = ("accept", "keep", "escalate")
#: Name space of event identifiers (fixed value).
EVENT_SPACE = "2d9f6e01-4a5b-5c6d-8e7f-90a1b2c3d4e5"


def _events(s, d):
    return T.view(s, d, "fx_ledger")


def decisions(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind").isin(list(DECISIONS)))


def latest_decision(events: DataFrame) -> DataFrame:
    """The last decision per finding, by time and event id; one row per finding leaves each task."""
    return decisions(events).groupBy("sku", "attr").agg(F.max_by(F.struct("kind", "event_id", "ts"), F.struct("ts", "event_id")).alias("m"), F.count("*").alias("n")).select("sku", "attr", F.col("m.kind").alias("kind"), F.col("m.event_id").alias("event_id"), F.col("m.ts").alias("ts"), "n")


def chain_faults(claims: DataFrame) -> DataFrame:
    """Per chain: forks (a claim superseded twice), links to claims that don't exist, heads, roots."""
    c = claims.alias("c")
    forks = claims.filter("supersedes IS NOT NULL").groupBy("conv_id", "supersedes").agg(F.count("*").alias("n")).filter("n > 1").groupBy("conv_id").agg(F.count("*").alias("forks"))
    known = claims.select("conv_id", F.col("claim").alias("target"))
    dangling = c.filter("supersedes IS NOT NULL").join(known, (F.col("c.conv_id") == known["conv_id"]) & (F.col("c.supersedes") == known["target"]), "left_anti").groupBy("conv_id").agg(F.count("*").alias("dangling"))
    used = claims.filter("supersedes IS NOT NULL").select("conv_id", F.col("supersedes").alias("claim")).distinct()
    heads = claims.join(used, ["conv_id", "claim"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("heads"))
    base = claims.groupBy("conv_id").agg(F.count("*").alias("claims"), F.count_if(F.col("supersedes").isNull()).alias("roots"))
    out = base.join(forks, "conv_id", "left").join(dangling, "conv_id", "left").join(heads, "conv_id", "left")
    return out.fillna(0, ["forks", "dangling", "heads"])


def chain_depths(claims: DataFrame) -> DataFrame:
    """Depth of every claim reachable from a root; what a cycle or a missing claim holds is not reachable.

    Pointer jumping: each round every open claim takes over its target's target and steps, so rounds grow with the
    logarithm of the depth. Depths of a chain have no gaps, so a round that reaches no claim is the last. Each round is
    written to the shared folder.
    """
    state = T.written(claims.select("conv_id", "claim", F.col("supersedes").alias("up"), F.lit(1).cast("long").alias("depth")), "chains")
    while True:
        x, y = state.filter("up IS NOT NULL").alias("x"), state.alias("y")
        met = x.join(y, (F.col("x.conv_id") == F.col("y.conv_id")) & (F.col("x.up") == F.col("y.claim")))
        moved = T.written(met.select("x.conv_id", "x.claim", "y.up", (F.col("x.depth") + F.col("y.depth")).alias("depth")), "chains")
        found = moved.filter("up IS NULL")
        if found.isEmpty():
            return state.filter("up IS NULL").select("conv_id", "claim", "depth")
        state = state.filter("up IS NULL").union(moved)


def revisions(docs: DataFrame) -> DataFrame:
    """Per source, documents in arrival order; bytes seen before are no new revision, each new one supersedes the last."""
    hashed = docs.select("source", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    first = hashed.groupBy("source", "sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("fetches"))
    placed = T.written(numbered(first, ("source", "doc_id", "sha")), "revisions")
    ends = placed.groupBy("source").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    before = placed.select((F.col("place") + 1).alias("place"), F.col("source").alias("of"), F.col("sha").alias("last"))
    out = placed.join(ends, placed["source"].eqNullSafe(ends["source"])).drop(ends["source"]).join(before, "place", "left")
    supersedes = F.when(F.col("source").eqNullSafe(F.col("of")), F.col("last"))
    return out.select("source", "doc_id", "sha", "fetches", supersedes.alias("supersedes"), (F.col("place") - F.col("low") + 1).cast("int").alias("revision"), (F.col("place") == F.col("high")).alias("is_current"))


def session_gaps(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Sessions of one user's decisions, cut at gaps."""
    w = Window.partitionBy("sku").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w)) > minutes * 60 * 10**6
    e = decisions(events).withColumn("new", F.coalesce(gap, F.lit(True)).cast("int"))
    e = e.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("sku", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def reviewer_report(events: DataFrame) -> DataFrame:
    """Seconds per decision by kind: mean, median and the rule of exclusive quartiles by rank."""
    e = decisions(events).filter("seconds IS NOT NULL")
    e = numbered(e, ("kind", "seconds", "event_id"))
    kinds = e.groupBy("kind").agg(F.min("place").alias("low"), F.count("*").alias("n"))  # a row for each of DECISIONS
    e = e.join(F.broadcast(kinds), "kind").withColumn("k", F.col("place") - F.col("low") + 1).filter("n >= 3")

    def at(q: float):
        pos = (F.col("n") + 1) * q
        low = F.floor(pos)
        return F.max(F.when(F.col("k") == low, F.col("seconds"))), F.max(F.when(F.col("k") == low + 1, F.col("seconds"))), F.max(pos - low)

    cols = {}
    for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        a, b, part = at(q)
        cols[name] = F.round(a + (F.coalesce(b, a) - a) * part, 6)
    return e.groupBy("kind").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in cols.items()])


def identifier_scan(docs: DataFrame) -> DataFrame:
    """How often strings shaped like dictionary identifiers occur, per source."""
    found = docs.select("source", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{4}-[0-9]{4,}|AKIA[A-Z0-9]{12,}|[0-9]{12,19}"), 0)).alias("x"))
    return found.groupBy("source").agg(F.count("*").alias("hits"), F.countDistinct("x").alias("different"))


_LATEST = "SELECT sku, attr, max_by(kind, (ts, event_id)) AS kind, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, count(*) AS n FROM fx_ledger WHERE kind IN ('accept', 'keep', 'escalate') GROUP BY 1, 2"
_REV = "WITH h AS (SELECT source, sha256(coalesce(text, '')) AS sha, min(doc_id) AS doc_id, count(*) AS fetches FROM documents GROUP BY 1, 2)"
_QUEUE = "WITH q AS (SELECT sku, attr, max(seconds) AS worth FROM fx_ledger WHERE kind = 'claim' GROUP BY 1, 2)"


def _open(s, d):
    q = _events(s, d).filter("kind = 'claim'").groupBy("sku", "attr").agg(F.max("seconds").alias("worth"))
    return q, latest_decision(_events(s, d))


def join_open_queue(s, d):
    q, done = _open(s, d)
    return q.join(done, ["sku", "attr"], "left_anti")


def join_queue_decisions(s, d):
    q, done = _open(s, d)
    return q.join(done.select("sku", "attr", "kind"), ["sku", "attr"], "left")


def agg_progress(s, d):
    j = join_queue_decisions(s, d)
    return j.agg(F.count("kind").alias("decided"), F.count("*").alias("total"))


def join_reversal(s, d):
    """Accepted findings without a later batch event of their own: they can still be reversed."""
    done = latest_decision(_events(s, d)).filter("kind = 'accept'").select("sku", "attr", "ts")
    later = _events(s, d).filter("kind = 'batch'").select("sku", "attr", F.col("ts").alias("later"))
    return done.join(later, (done["sku"] == later["sku"]) & (done["attr"] == later["attr"]) & (F.col("later") > F.col("ts")), "left_anti")


QUERIES = {
    "src_ledger_read": lambda s, d: _events(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")),
    "agg_latest_decision": lambda s, d: latest_decision(_events(s, d)),
    "join_open_queue": join_open_queue,
    "join_queue_decisions": join_queue_decisions,
    "agg_progress": agg_progress,
    "join_reversal": join_reversal,
    "audit_history": lambda s, d: _events(s, d).select("sku", "event_id", "ts", "kind", "attr").orderBy("sku", "ts", "event_id"),
    "audit_claim_chains": lambda s, d: chain_faults(T.view(s, d, "fx_chain")),
    "audit_chain_depth": lambda s, d: chain_depths(T.view(s, d, "fx_chain")).groupBy("conv_id").agg(F.max("depth").alias("depth"), F.count("*").alias("reached")),
    "win_revision_chain": lambda s, d: revisions(T.table(s, d, "documents")),
    "win_revision_integrity": lambda s, d: T.table(s, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).agg(F.countDistinct("source").alias("sources"), F.count("*").alias("n")).filter("sources > 1"),
    "win_dup_sku_first": lambda s, d: T.view(s, d, "cat_rows").groupBy("mpn").agg(F.min(F.struct("feed_row", "feed_line")).alias("m"), F.count("*").alias("n")).select("mpn", F.col("m.feed_row").alias("feed_row"), F.col("m.feed_line").alias("feed_line"), (F.col("n") - 1).alias("repeats")),
    "agg_session_by_role": lambda s, d: session_gaps(_events(s, d)),
    "agg_reviewer_report": lambda s, d: reviewer_report(_events(s, d)),
    "agg_calibration_labels": lambda s, d: _events(s, d).filter("kind IN ('accept', 'keep')").select("event_id", F.coalesce("seconds", F.lit(0.5)).alias("score"), (F.col("kind") == "accept").cast("int").alias("label")),
    "agg_calibration_state": lambda s, d: _events(s, d).agg(F.count_if(F.col("kind").isin("accept", "keep")).alias("usable"), F.count_if(F.col("kind") == "accept").alias("accepted"), F.count_if(F.col("kind") == "keep").alias("kept")).withColumn("fit_possible", (F.col("accepted") > 0) & (F.col("kept") > 0)),
    "flt_identifier_scan": lambda s, d: identifier_scan(T.table(s, d, "documents")),
}

ORACLES = {k: T.with_views(q) for k, q in {
    "src_ledger_read": "SELECT kind, count(*) AS n, min(ts) AS first, max(ts) AS last FROM fx_ledger GROUP BY 1",
    "agg_latest_decision": _LATEST,
    "join_open_queue": f"{_QUEUE} SELECT * FROM q ANTI JOIN ({_LATEST}) l USING (sku, attr)",
    "join_queue_decisions": f"{_QUEUE} SELECT q.*, kind FROM q LEFT JOIN ({_LATEST}) l USING (sku, attr)",
    "agg_progress": f"{_QUEUE} SELECT count(kind) AS decided, count(*) AS total FROM q LEFT JOIN ({_LATEST}) l USING (sku, attr)",
    "join_reversal": f"WITH l AS ({_LATEST}) SELECT sku, attr, ts FROM l WHERE kind = 'accept' AND NOT EXISTS (SELECT 1 FROM fx_ledger b WHERE b.kind = 'batch' AND b.sku = l.sku AND b.attr = l.attr AND b.ts > l.ts)",
    "audit_history": "SELECT sku, event_id, ts, kind, attr FROM fx_ledger",
    "audit_claim_chains": "SELECT conv_id, count(*) AS claims, count_if(supersedes IS NULL) AS roots, (SELECT count(*) FROM (SELECT supersedes FROM fx_chain f WHERE f.conv_id = c.conv_id AND supersedes IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS forks, (SELECT count(*) FROM fx_chain f WHERE f.conv_id = c.conv_id AND supersedes IS NOT NULL AND supersedes NOT IN (SELECT claim FROM fx_chain g WHERE g.conv_id = c.conv_id)) AS dangling, (SELECT count(*) FROM fx_chain f WHERE f.conv_id = c.conv_id AND claim NOT IN (SELECT supersedes FROM fx_chain g WHERE g.conv_id = c.conv_id AND supersedes IS NOT NULL)) AS heads FROM fx_chain c GROUP BY conv_id",
    "audit_chain_depth": "WITH RECURSIVE fx AS (SELECT * FROM ({chain})), walk(conv_id, claim, depth) AS (SELECT conv_id, claim, 1 FROM fx WHERE supersedes IS NULL UNION ALL SELECT c.conv_id, c.claim, depth + 1 FROM fx c JOIN walk w ON c.conv_id = w.conv_id AND c.supersedes = w.claim) SELECT conv_id, max(depth) AS depth, count(*) AS reached FROM walk GROUP BY 1".replace("{chain}", T.FX_CHAIN.replace("{conversations}", "conversations")),
    "win_revision_chain": f"{_REV} SELECT source, doc_id, sha, fetches, lag(sha) OVER w AS supersedes, row_number() OVER w AS revision, lead(sha) OVER w IS NULL AS is_current FROM h WINDOW w AS (PARTITION BY source ORDER BY doc_id)",
    "win_revision_integrity": "SELECT sha256(coalesce(text, '')) AS sha, count(DISTINCT source) AS sources, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "win_dup_sku_first": "SELECT mpn, arg_min(feed_row, (feed_row, feed_line)) AS feed_row, arg_min(feed_line, (feed_row, feed_line)) AS feed_line, count(*) - 1 AS repeats FROM cat_rows GROUP BY 1",
    "agg_session_by_role": "WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY sku ORDER BY ts, event_id)) <= 1800000000 THEN 0 ELSE 1 END AS n0 FROM fx_ledger WHERE kind IN ('accept', 'keep', 'escalate')), f AS (SELECT *, sum(n0) OVER (PARTITION BY sku ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT sku, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM f GROUP BY 1, 2",
    "agg_reviewer_report": "WITH e AS (SELECT kind, seconds, row_number() OVER (PARTITION BY kind ORDER BY seconds, event_id) AS k, count(*) OVER (PARTITION BY kind) AS n FROM fx_ledger WHERE kind IN ('accept', 'keep', 'escalate') AND seconds IS NOT NULL), q AS (SELECT kind, count(*) AS n, list(seconds ORDER BY k) AS v FROM e WHERE n >= 3 GROUP BY 1) SELECT kind, n, " + ", ".join(f"round(v[CAST(floor((n + 1) * {q}) AS INT)] + (coalesce(v[CAST(floor((n + 1) * {q}) AS INT) + 1], v[CAST(floor((n + 1) * {q}) AS INT)]) - v[CAST(floor((n + 1) * {q}) AS INT)]) * ((n + 1) * {q} - floor((n + 1) * {q})), 6) AS {c}" for c, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))) + " FROM q",
    "agg_calibration_labels": "SELECT event_id, coalesce(seconds, 0.5) AS score, CASE kind WHEN 'accept' THEN 1 ELSE 0 END AS label FROM fx_ledger WHERE kind IN ('accept', 'keep')",
    "agg_calibration_state": "SELECT *, accepted > 0 AND kept > 0 AS fit_possible FROM (SELECT count_if(kind IN ('accept', 'keep')) AS usable, count_if(kind = 'accept') AS accepted, count_if(kind = 'keep') AS kept FROM fx_ledger)",
    "flt_identifier_scan": "SELECT source, count(*) AS hits, count(DISTINCT x) AS different FROM (SELECT source, unnest(regexp_extract_all(text, '[0-9]{4}-[0-9]{4,}|AKIA[A-Z0-9]{12,}|[0-9]{12,19}')) AS x FROM documents) GROUP BY 1",
}.items()}
