"""Streams that keep what they refuse: both tables read back, over several batches, and verdicts of sliding windows."""

import datetime as dt

import pytest

from catalogcheck.plans import registry
from catalogcheck.streaming import ledger as L


@pytest.mark.parametrize("name", ["stream_ledger_ingest", "stream_drift_alarm"])
def test_query_equals_sql(name, same):
    same(registry.queries()[name], registry.oracles()[name])


def test_late_and_repeated_over_batches(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d, 12)
    schema = "event_id long, ts timestamp, tag string, n int"
    batches = [
        [(1, day(1), "ledger/1", 0), (2, day(5), "ledger/2", 0), (2, day(5), "ledger/2", 1), (3, day(5), "ledger/3", 0), (4, day(5), None, 0)],
        [(5, day(2), "ledger/1", 0), (6, day(4), "ledger/1", 0), (2, day(5), "ledger/1", 2), (3, day(5), "ledger/1", 0), (7, day(9), "ledger/1", 0)],
        [(8, day(6), "ledger/1", 0), (7, day(9), "ledger/1", 1), (9, day(8), "ledger/1", 0)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    accepted, refused = L.ingested(stream, "ingest-test")
    assert sorted((r.batch, r.event_id, r.n) for r in accepted.collect()) == [(0, 1, 0), (0, 2, 0), (1, 3, 0), (1, 6, 0), (1, 7, 0), (2, 9, 0)]
    got = sorted((r.batch, r.event_id, r.n, r.reason) for r in refused.collect())
    assert got == [
        (0, 2, 1, "repeated"), (0, 3, 0, "unknown_schema_tag"), (0, 4, 0, "no_schema_tag"), (1, 2, 2, "repeated"), (1, 5, 0, "later_than_watermark"), (2, 7, 1, "repeated"), (2, 8, 0, "later_than_watermark"),
    ]
