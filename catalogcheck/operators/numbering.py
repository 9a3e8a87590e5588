"""Places in one order over all rows, without a window that holds them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables as T


def numbered(rows: DataFrame, keys: tuple[str, ...], descending: tuple[str, ...] = (), sums: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their ``place`` (from 1) in the order of ``keys``, and ``sum_x`` for each x of ``sums``: the running sum up to and with the row.

    Rows are dealt to ranges of the order, written once, counted per range, and numbered inside it; ranges hold
    about as many rows each, however often a single key comes. The keys together should tell rows apart.
    Without sums a row's number is where its sorted range has it as it is written, and no row moves again.
    """
    spark = rows.sparkSession
    order = [F.desc(k) if k in descending else F.asc(k) for k in keys]
    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(count, *order)
    if sums:
        dealt = T.written(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    else:
        at = F.monotonically_increasing_id()  # the partition, and below it 33 bits for the row
        dealt = T.written(dealt.sortWithinPartitions(*order).withColumn("at", at), "ranges")
        dealt = dealt.withColumns({"range": F.shiftright("at", 33), "place": F.col("at").bitwiseAND(F.lit(2**33 - 1)) + 1}).drop("at")
    per = dealt.groupBy("range").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"n_{x}") for x in sums])
    ahead = Window.orderBy("range")  # one row for each range
    before = per.select("range", *[(F.coalesce(F.sum(n).over(ahead), F.lit(0)) - F.coalesce(n, F.lit(0))).alias(f"before_{n}") for n in ("n", *[f"n_{x}" for x in sums])])
    own = dealt
    if sums:
        inside = Window.partitionBy("range").orderBy(*order)
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        own = dealt.withColumns({"place": F.row_number().over(inside)} | {f"sum_{x}": F.sum(x).over(upto) for x in sums})
    out = own.join(F.broadcast(before), "range")  # as many rows as there are ranges
    out = out.withColumns({"place": F.col("place") + F.col("before_n")} | {f"sum_{x}": F.col(f"sum_{x}") + F.col(f"before_n_{x}") for x in sums})
    return out.drop("range", "before_n", *[f"before_n_{x}" for x in sums])
