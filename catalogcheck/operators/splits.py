"""Frozen sets of ids: membership, complement, and a digest as the root of a hash tree over ranges of hashed ids.

An id's place is given by its SHA-256, so leaves fill evenly whatever the ids look like. A leaf digests its ids in that
order; sixteen leaves make a node, and so on to the root. Two sets are compared by their leaves: only ids of leaves that
differ are looked at, and no task sorts more than a leaf.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables as T

#: Ids of a leaf, about.
LEAF = 64


def depth_of(n: int) -> int:
    """Hex digits of a leaf's prefix: as few as keep leaves at about LEAF ids."""
    depth = 0
    while n > LEAF * 16**depth:
        depth += 1
    return depth


def leaves(ids: DataFrame, depth: int) -> DataFrame:
    """prefix, n and digest of each leaf of the different ids (column id)."""
    h = F.sha2(F.col("id").cast("string"), 256)
    placed = ids.filter("id IS NOT NULL").select(F.col("id").cast("string").alias("id")).distinct().withColumn("h", h)
    own = F.array_sort(F.collect_list(F.struct("h", "id")))
    joined = F.array_join(F.transform(own, lambda x: x["id"]), ",")
    return placed.groupBy(F.substring("h", 1, depth).alias("prefix")).agg(F.count("*").alias("n"), F.sha2(joined, 256).alias("digest"))


def above(level: DataFrame) -> DataFrame:
    """The nodes over a level: each digests its sixteen children at most, in order."""
    up = F.col("prefix").substr(F.lit(1), F.length("prefix") - 1)
    children = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
    return level.groupBy(up.alias("prefix")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(children, lambda x: x["digest"]), ""), 256).alias("digest"))


def root(ids: DataFrame) -> DataFrame:
    """n, depth and digest of a set of ids; one row, none for no ids."""
    depth = depth_of(ids.filter("id IS NOT NULL").select(F.col("id").cast("string")).distinct().count())
    level = leaves(ids, depth)
    for _ in range(depth):
        level = above(level)
    return level.select("n", F.lit(depth).alias("depth"), "digest")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """id and side (removed, added) of what differs between two sets, found in the leaves that differ."""
    depth = depth_of(max(before.count(), after.count()))
    a, b = leaves(before, depth), leaves(after, depth)
    odd = a.select("prefix", F.col("digest").alias("x")).join(b.select("prefix", F.col("digest").alias("y")), "prefix", "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select("prefix")

    def inside(ids: DataFrame, name: str) -> DataFrame:
        texts = ids.filter("id IS NOT NULL").select(F.col("id").cast("string").alias("id")).distinct()
        return texts.withColumn("prefix", F.substring(F.sha2("id", 256), 1, depth)).join(odd, "prefix", "left_semi").select("id", F.lit(True).alias(name))

    both = inside(before, "was").join(inside(after, "is"), "id", "full")
    return both.filter("was IS NULL OR is IS NULL").select("id", F.when(F.col("is").isNull(), "removed").otherwise("added").alias("side"))


def verified(ids: DataFrame, recorded: str) -> DataFrame:
    """The ids, if their root is the recorded one; a set whose contents have moved isn't frozen."""
    got = root(ids).first()
    if (got["digest"] if got else None) != recorded:
        raise ValueError(f"the set hashes to {got['digest'] if got else None}, recorded is {recorded}")
    return ids


def frozen_split(s, d) -> DataFrame:
    """The frozen ids and what is left of the documents without them, each with its size and digest."""
    frozen = T.table(s, d, "labels").select(F.col("doc_id").alias("id"))
    rest = T.table(s, d, "documents").select(F.col("doc_id").alias("id")).join(frozen, "id", "left_anti")
    return root(frozen).withColumn("side", F.lit("frozen")).unionByName(root(rest).withColumn("side", F.lit("held_out")))


QUERIES = {"set_frozen_split": frozen_split}

_UP = "SELECT side, depth, CASE WHEN p = '' THEN p ELSE substr(p, 1, length(p) - 1) END AS p, sum(n) AS n, CASE WHEN max(length(p)) = 0 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d FROM {} GROUP BY ALL"
ORACLES = {
    "set_frozen_split": f"""WITH ids AS (SELECT DISTINCT 'frozen' AS side, CAST(doc_id AS VARCHAR) AS id FROM labels UNION ALL SELECT DISTINCT 'held_out', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
sized AS (SELECT side, id, sha256(id) AS h, count(*) OVER (PARTITION BY side) AS m FROM ids), deep AS (SELECT *, CASE WHEN m <= 64 THEN 0 WHEN m <= 1024 THEN 1 WHEN m <= 16384 THEN 2 WHEN m <= 262144 THEN 3 ELSE 4 END AS depth FROM sized),
l0 AS (SELECT side, depth, substr(h, 1, depth) AS p, count(*) AS n, sha256(string_agg(id, ',' ORDER BY h, id)) AS d FROM deep GROUP BY ALL), l1 AS ({_UP.format("l0")}), l2 AS ({_UP.format("l1")}), l3 AS ({_UP.format("l2")}), l4 AS ({_UP.format("l3")})
SELECT side, CAST(n AS BIGINT) AS n, depth, d AS digest FROM l4""",
}
