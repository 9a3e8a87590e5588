"""The whole run: findings of both tiers, identified, clustered and ranked in one queue.

The first tier holds records against their siblings, the second against the documents that they name. A cell that both
find wrong has two findings, as each has evidence of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables as T
from . import faults, triage
from . import judgement as J
from . import structural as S
from .faults import SEVERITY


def audit_run(s, d) -> DataFrame:
    """The flagship: catalog and documents to a ranked queue, one row per finding."""
    q = faults.ranked(s, d, documents=True)
    return q.select("rank", "redline_id", "tier", "sku", "attr", "check", "cls", "severity", "value", "proposed", "shape", "signature_id", "multiplicity", "expected")


def tiers(s, d) -> DataFrame:
    """Findings, records, cells and signatures of each tier, of both together, and the cells that both find wrong.

    Rows that are alike have the same findings, so each stands for n records; none is named.
    """
    f = faults.faults(s, d, documents=True)
    t0, t1 = F.col("tier") == "T0", F.col("tier") == "T1"
    cell = f.groupBy(*faults.ROW, "attr").agg(F.first("n").alias("n"), F.count_if(t0).alias("f0"), F.count_if(t1).alias("f1"))
    x, y = (F.col("f0") > 0), (F.col("f1") > 0)
    row = cell.groupBy(*faults.ROW).agg(F.first("n").alias("n"), F.sum("f0").alias("f0"), F.sum("f1").alias("f1"), F.count_if(x).alias("c0"), F.count_if(y).alias("c1"), F.count_if(x & y).alias("both"))
    total = lambda c: F.coalesce(F.sum(F.col("n") * c), F.lit(0))
    one = lambda c: c.cast("long")
    parts = {
        "T0": (F.col("f0"), one(x), F.col("c0")), "T1": (F.col("f1"), one(y), F.col("c1")),
        "all": (F.col("f0") + F.col("f1"), one(x | y), F.col("c0") + F.col("c1") - F.col("both")),
    }
    sums = row.agg(*(total(c).alias(f"{k}_{m}") for k, cs in parts.items() for m, c in zip(("findings", "records", "cells"), cs)), total(F.col("both")).alias("cells_of_both"))
    signs = triage.signed(f.select(*faults.KIND).distinct()).agg(*(F.countDistinct(F.when(hit, F.col("signature_id"))).alias(k) for k, hit in (("T0", t0), ("T1", t1), ("all", F.lit(True)))))
    lines = F.array(*(F.struct(F.lit(k).alias("tier"), *(F.col(f"{k}_{m}").alias(m) for m in ("findings", "records", "cells")), F.col(k).alias("signatures")) for k in parts))
    out = sums.crossJoin(signs).select(F.inline(lines), "cells_of_both")  # one row each
    return out.filter("tier = 'all' OR findings > 0").select("tier", "findings", "records", "cells", "signatures", "cells_of_both")


QUERIES = {"audit_run": audit_run, "agg_run_tiers": tiers}

_SEVERITIES = " ".join(f"WHEN '{c}' THEN {n}" for c, n in SEVERITY.items())
_BOTH = f"""t0 AS (SELECT * FROM (WITH {S.OUTCOMES_SQL} SELECT sku, attr, "check", cls, severity, value, proposed FROM outcomes WHERE outcome = 'finding') a),
t1 AS (SELECT * FROM (WITH {J._JUDGE} SELECT sku, attr, 'document' AS "check", cls, CASE cls {_SEVERITIES} END AS severity, value, proposed FROM judged2 WHERE outcome = 'finding') b),
told AS (SELECT *, 'feed' AS source, 'T0' AS tier FROM t0 UNION ALL SELECT *, 'document', 'T1' FROM t1), {triage.IDENTIFIED_SQL}"""
ORACLES = {
    "audit_run": T.with_views(f"""WITH {_BOTH} SELECT row_number() OVER (ORDER BY expected DESC, redline_id, sku, "check") AS rank, redline_id, tier, sku, attr, "check", cls, severity, value, proposed, shape, signature_id, multiplicity, expected FROM valued"""),
    "agg_run_tiers": T.with_views(f"WITH {_BOTH} SELECT coalesce(tier, 'all') AS tier, count(*) AS findings, count(DISTINCT sku) AS records, count(DISTINCT (sku, attr)) AS cells, count(DISTINCT signature_id) AS signatures, (SELECT count(*) FROM (SELECT 1 FROM found GROUP BY sku, attr HAVING count(DISTINCT tier) = 2)) AS cells_of_both FROM found GROUP BY ROLLUP (tier)"),
}
