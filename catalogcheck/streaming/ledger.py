"""Ledger operators as Structured Streaming queries, each drained once (available now) into a written table.

Sources are the event files; checkpoints and results live in the folder that the cluster shares. A drained stream gives
what the batch operator gives on the same rows, which is how the results are checked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import measure as M
from ..sources import tables as T

#: Schema tags that the ledger reads, and observations below which a window has no verdict (fixed value).
TAGS = ("ledger/1", "ledger/2")
LEAST = 100


def shared(spark: SparkSession, name: str) -> str:
    return f"{T.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files, with a proper event time."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern, so that a table of one file will do as well as a folder of files
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over everything available and returns the written result.

    An update stream keeps one row per key and batch; readers take the latest batch of each key.
    """
    spark = stream.sparkSession
    out, log = shared(spark, name), shared(spark, f"{name}-log")
    schema = stream.schema
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    else:

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", log).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(schema).parquet(out)
    return spark.read.option("basePath", out).parquet(out)


def ingested(stream: DataFrame, name: str, delay: str = "2 days") -> tuple[DataFrame, DataFrame]:
    """A stream of events (event_id, ts, tag, ...) in two tables, accepted and refused, each batch in both under one number.

    Refused are events without a known schema tag, events later than the watermark (the newest event time of the batches before,
    less the delay), and repeats of an id; each with its reason, none is dropped. Only accepted events newer than the watermark
    are looked at for repeats, by days, as older ones can't be repeated. A batch that is tried again replaces itself in both.
    """
    spark, out = stream.sparkSession, shared(stream.sparkSession, name)
    schema = stream.schema

    def table(kind: str, number: int | None = None) -> DataFrame:
        found = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, reason string, day date, batch long").option("basePath", f"{out}/{kind}").parquet(f"{out}/{kind}")
        return found if number is None else found.filter(F.col("batch") < number)

    def keep(batch: DataFrame, number: int) -> None:
        low = table("accepted", number).agg((F.max("ts") - F.expr(f"INTERVAL {delay}")).alias("low")).first()["low"] if number else None
        late = F.col("ts") < F.lit(low) if low is not None else F.lit(False)
        reason = F.when(F.col("tag").isNull(), "no_schema_tag").when(~F.col("tag").isin(list(TAGS)), "unknown_schema_tag").when(late, "later_than_watermark")
        rows = batch.withColumn("reason", reason).withColumn("day", F.to_date("ts"))
        order = Window.partitionBy("event_id", F.col("reason").isNull()).orderBy("ts", *[c for c in batch.columns if c not in ("event_id", "ts")])
        rows = rows.withColumn("again", F.row_number().over(order) > 1)
        if low is not None:
            before = table("accepted", number).filter(F.col("day") >= F.to_date(F.lit(low))).select("event_id", F.lit(True).alias("had")).distinct()
            rows = rows.join(before, "event_id", "left").withColumn("again", F.col("again") | F.coalesce("had", F.lit(False))).drop("had")
        rows = T.written(rows.withColumn("reason", F.coalesce("reason", F.when(F.col("again"), "repeated"))).drop("again"), f"{name}-batch")
        for kind, part in (("accepted", rows.filter("reason IS NULL")), ("refused", rows.filter("reason IS NOT NULL"))):
            part.write.mode("overwrite").partitionBy("day").parquet(f"{out}/{kind}/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", shared(spark, f"{name}-log")).trigger(availableNow=True).start().awaitTermination()
    return table("accepted"), table("refused")


def stream_ledger_ingest(spark, sf_dir: str) -> DataFrame:
    """Events in, by tag, event time and id; what was accepted and what was refused and why, by kind, read back when drained."""
    kind = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "view", "keep").when(F.col("event_type") == "error", "escalate").when(F.col("event_type") == "click", "claim").otherwise("batch")
    tag = F.when(F.col("event_id") % 23 == 0, None).when(F.col("event_id") % 19 == 0, "ledger/9").otherwise(F.concat(F.lit("ledger/"), (1 + F.col("event_id") % 2).cast("string")))
    accepted, refused = ingested(event_stream(spark, sf_dir).select("event_id", "ts", tag.alias("tag"), kind.alias("kind"), "user_id"), "ingest")
    both = accepted.unionByName(refused)
    return both.groupBy(F.coalesce("reason", F.lit("accepted")).alias("result"), "kind").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


def stream_latest_decision(spark, sf_dir: str) -> DataFrame:
    """The latest decision per finding as state of an aggregation in update mode."""
    e = event_stream(spark, sf_dir)
    kind = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "view", "keep").when(F.col("event_type") == "error", "escalate")
    e = e.select("event_id", "ts", kind.alias("kind"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("sku"), F.concat(F.lit("a"), (F.col("event_id") % 5).cast("string")).alias("attr")).filter("kind IS NOT NULL")
    state = e.groupBy("sku", "attr").agg(F.max(F.struct("ts", "event_id", "kind")).alias("m"))
    last = drained(state, "latest", "update").groupBy("sku", "attr").agg(F.max_by("m", "batch").alias("m"))
    return last.select("sku", "attr", F.col("m.kind").alias("kind"), F.col("m.event_id").alias("event_id"))


def stream_drift_alarm(spark, sf_dir: str) -> DataFrame:
    """Sliding windows of two days of event time, each with its verdict: too few observations, drifted if the outcomes of a bin
    leave what it promised, or stable."""
    e = event_stream(spark, sf_dir).withWatermark("ts", "1 day")
    score = (F.col("event_id") % 100) / 100.0
    bins = e.groupBy(F.window("ts", "2 days", "1 day").alias("w"), F.floor(score * 5).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "purchase").cast("long")).alias("hits"))
    out = drained(bins, "drift", "update").groupBy("w", "bin").agg(F.max_by(F.struct("n", "hits"), "batch").alias("m"))
    out = out.select(F.col("w.start").alias("start"), "bin", F.col("m.n").alias("n"), F.col("m.hits").alias("hits"))
    low, high = M.wilson(F.col("hits"), F.col("n"))
    out = out.withColumn("tripped", (high < F.col("bin") / 5) | (low > (F.col("bin") + 1) / 5))
    whole = out.groupBy("start").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.count_if("tripped").alias("tripped"))
    return whole.withColumn("verdict", F.when(F.col("n") < LEAST, "insufficient_data").when(F.col("tripped") > 0, "drifted").otherwise("stable"))


def stream_reviewer_sessions(spark, sf_dir: str) -> DataFrame:
    """Session windows of one user's decisions, closed by thirty quiet minutes."""
    e = event_stream(spark, sf_dir).filter("event_type IN ('purchase', 'view', 'error')").withWatermark("ts", "1 hour")
    s = e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    out = drained(s, "sessions", "complete").filter("batch IS NOT NULL")
    newest = out.agg(F.max("batch")).first()[0]
    out = out.filter(F.col("batch") == newest)
    return out.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("sku"), F.col("w.start").alias("first"), "n")


def stream_late_chain(spark, sf_dir: str) -> DataFrame:
    """Chains of claims that arrive late or out of order: each batch is stored, and only the chains that it touches are
    evaluated again, from all that is stored of them."""
    path = f"{sf_dir}/conversations.parquet"
    raw = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/conversations.parque[t]")
    claims = spark.sql(T.FX_CHAIN, conversations=raw).select("conv_id", "claim", "supersedes")
    store, out, log = (shared(spark, f"chain-{x}") for x in ("claims", "depths", "log"))

    def evaluate(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")  # a batch that is tried again replaces itself
        own = spark.read.parquet(f"{store}/batch={number}").select("conv_id").distinct()
        known = spark.read.option("basePath", store).parquet(store).filter(F.col("batch") <= number)
        depths = L.chain_depths(known.join(own, "conv_id", "left_semi").select("conv_id", "claim", "supersedes"))
        depths.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.count("*").alias("reached")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    claims.writeStream.foreachBatch(evaluate).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.option("basePath", out).parquet(out).groupBy("conv_id").agg(F.max_by(F.struct("depth", "reached"), "batch").alias("m"))
    return last.select("conv_id", "m.depth", "m.reached")


_LOW, _HIGH = M._wilson_sql("hits", "n")

QUERIES = {"stream_ledger_ingest": stream_ledger_ingest, "stream_latest_decision": stream_latest_decision, "stream_drift_alarm": stream_drift_alarm, "stream_reviewer_sessions": stream_reviewer_sessions, "stream_late_chain": stream_late_chain}
ORACLES = {k: T.with_views(q) for k, q in {
    "stream_ledger_ingest": """WITH e AS (SELECT event_id, kind, CASE WHEN event_id % 23 = 0 THEN 'no_schema_tag' WHEN event_id % 19 = 0 THEN 'unknown_schema_tag' END AS reason, row_number() OVER (PARTITION BY event_id ORDER BY ts, kind, sku) AS k FROM fx_ledger)
SELECT coalesce(reason, CASE WHEN k > 1 THEN 'repeated' END, 'accepted') AS result, kind, count(*) AS n, count(DISTINCT event_id) AS ids FROM e GROUP BY 1, 2""",
    "stream_latest_decision": f"SELECT sku, attr, kind, event_id FROM ({L._LATEST})",
    "stream_drift_alarm": f"""WITH b AS (SELECT (date_trunc('day', ts) - to_days(CAST(i AS INT)))::TIMESTAMP AS start, CAST(floor(event_id % 100 / 100.0 * 5) AS INT) AS bin, count(*) AS n, count_if(event_type = 'purchase') AS hits FROM events, (VALUES (0), (1)) t(i) GROUP BY 1, 2),
c AS (SELECT *, {_LOW} AS low, {_HIGH} AS high FROM b), w AS (SELECT start, CAST(sum(n) AS BIGINT) AS n, CAST(sum(hits) AS BIGINT) AS hits, count_if(high < bin / 5 OR low > (bin + 1) / 5) AS tripped FROM c GROUP BY 1)
SELECT *, CASE WHEN n < {LEAST} THEN 'insufficient_data' WHEN tripped > 0 THEN 'drifted' ELSE 'stable' END AS verdict FROM w""",
    "stream_reviewer_sessions": "WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY sku ORDER BY ts, event_id)) < 1800000000 THEN 0 ELSE 1 END AS n0 FROM fx_ledger WHERE kind IN ('accept', 'keep', 'escalate')), f AS (SELECT *, sum(n0) OVER (PARTITION BY sku ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT sku, min(ts) AS first, count(*) AS n FROM f GROUP BY sku, session",
}.items()}
ORACLES["stream_late_chain"] = L.ORACLES["audit_chain_depth"]
