"""The hash tree's root against a plain one, and changes found leaf by leaf."""

import hashlib

import pytest

from catalogcheck.operators import splits as S
from catalogcheck.plans import registry


def test_query_equals_sql(same):
    same(registry.queries()["set_frozen_split"], registry.oracles()["set_frozen_split"])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(ids):
    ids = {str(i) for i in ids}
    depth = S.depth_of(len(ids))

    def node(prefix):
        own = sorted((sha(i), i) for i in ids if sha(i).startswith(prefix))
        if not own:
            return ""
        return sha(",".join(i for _, i in own)) if len(prefix) == depth else sha("".join(node(prefix + x) for x in "0123456789abcdef"))

    return (len(ids), depth, node(""))


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string").repartition(3)


@pytest.mark.parametrize("n", [1, 64, 65, 1500])
def test_root(spark, n):
    ids = [f"doc-{i}" for i in range(n)]
    assert tuple(S.root(frame(spark, [*ids, *ids[:3], None])).first()) == plain_root(ids)


def test_changes(spark):
    ids = [str(i) for i in range(2000)]
    moved = [i for i in ids if i not in ("17", "1999")] + ["x"]
    assert sorted(map(tuple, S.changed(frame(spark, ids), frame(spark, moved)).collect())) == [("17", "removed"), ("1999", "removed"), ("x", "added")]
    assert S.changed(frame(spark, ids), frame(spark, ids[::-1])).count() == 0
    assert S.changed(frame(spark, []), frame(spark, ["a"])).collect() == [("a", "added")] and S.root(frame(spark, [])).count() == 0
    digest = S.root(frame(spark, ids)).first()["digest"]
    assert S.verified(frame(spark, ids), digest).count() == 2000
    with pytest.raises(ValueError, match="recorded"):
        S.verified(frame(spark, moved), digest)
