"""Operators against numpy or by their own laws."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from shared import SMALL

from catalogcheck.operators import judgement, ledger, measure, numbering
from catalogcheck.sources import tables as T


def fitted(x, y):
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([((y - p) * x).sum() - 1e-6 * a, (y - p).sum() - 1e-6 * b])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-6, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        a, b = np.array([a, b]) + np.linalg.solve(h, g)
    return a, b


def test_platt_fit_and_calibration(spark):
    rows = T.view(spark, SMALL, "fx_labels").select("doc_id", F.col("score").cast("double"), "quality").toPandas()
    a, b = fitted(rows.score.to_numpy(), rows.quality.to_numpy())
    got = measure.agg_platt_fit(spark, SMALL).first()
    assert (got["slope"], got["intercept"]) == (pytest.approx(a, abs=1e-4), pytest.approx(b, abs=1e-4))
    out = {r["doc_id"]: r["probability"] for r in measure.audit_calibrate(spark, SMALL).collect()}
    for i, x in zip(rows.doc_id, rows.score, strict=True):
        assert out[i] == pytest.approx(1 / (1 + np.exp(-(a * x + b))), abs=1e-4)


def test_a_ledger_takes_each_event_once(spark, tmp_path):
    folder, batch = str(tmp_path / "ledger"), judgement.event_batch(spark, SMALL)
    half = batch.filter("event_id % 2 = 0")
    n, all_ = half.count(), batch.count()
    assert [judgement.append(folder, x) for x in (half, half, batch, batch, batch.limit(0))] == [n, 0, all_ - n, 0, 0]
    assert spark.read.parquet(folder).count() == all_


def test_places_over_all_rows(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("worth"), F.lit(1).alias("one"))
    got = [tuple(r) for r in numbering.numbered(rows, ("worth", "id"), ("worth",), ("one",)).orderBy("place").select("worth", "id", "place", "sum_one").collect()]
    assert got == [(w, i, k, k) for k, (w, i) in enumerate(sorted(((x % 3, x) for x in range(500)), key=lambda p: (-p[0], p[1])), 1)]
    assert numbering.numbered(rows.limit(0), ("worth", "id")).count() == 0


def test_a_long_chain_is_followed_to_its_end(spark):
    claims = spark.createDataFrame([(1, f"c{i}", f"c{i - 1}" if i else None) for i in range(150)], "conv_id long, claim string, supersedes string")
    assert max(r["depth"] for r in ledger.chain_depths(claims).collect()) == 150
