from collections import defaultdict

import numpy as np
import pytest

from gridloom.llm import sharding as S


def test_growth_moves_rows_into_the_new_shard_only():
    keys = np.arange(-20_000, 40_000)
    before = S.assign(keys, S.topology(5))
    for n in range(6, 40):
        after = S.assign(keys, S.topology(n))
        assert set(after[after != before]) == {n - 1}
        shares = np.bincount(after, minlength=n) / len(keys)
        assert np.abs(shares * n - 1).max() < 0.2
        before = after


def test_a_changed_weight_moves_rows_of_that_shard_only():
    keys = np.arange(50_000)
    tree = S.topology(24)
    light = tuple(S.Shard(s.number, s.region, s.rack, 0.5) if s.number == 7 else s for s in tree)
    a, b = S.assign(keys, tree), S.assign(keys, light)
    assert set(a[a != b]) == {7}
    assert abs((b == 7).mean() * 23.5 / 0.5 - 1) < 0.15


def test_slots_have_no_gaps(spark, awkward, nothing):
    rows = S.shard(awkward, S.topology(3), S.topology(4)).collect()
    assert len(rows) == awkward.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 3)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    assert len({r.shard for r in rows if r.doc_id == 8}) == 1
    assert S.shard(nothing, S.topology(3)).count() == 0


def test_a_null_beside_large_ids_moves_nothing(spark):
    ids = [2**53 + 1, 2**53 + 3, 2**60 + 7, -(2**61) - 5]
    tree = S.topology(24)
    alone = {r.doc_id: r.shard for r in S.shard(spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1), tree).collect()}
    beside = {r.doc_id: r.shard for r in S.shard(spark.createDataFrame([(None,), *((i,) for i in ids), (None,)], "doc_id long").coalesce(1), tree).collect()}
    assert {i: beside[i] for i in ids} == alone == dict(zip(ids, S.assign(np.array(ids), tree).tolist(), strict=True))


def test_clashing_columns_and_bad_weights(spark):
    rows = spark.createDataFrame([(1, "a", 5, 7), (2, "b", 6, 8)], "doc_id long, slot string, _block int, _at int")
    got = S.shard(rows, S.topology(3), S.topology(4)).collect()
    assert {(r.doc_id, r["_block"], r["_at"]) for r in got} == {(1, 5, 7), (2, 6, 8)} and all(isinstance(r.slot, int) for r in got)
    for weight in (0.0, -1.0, 2.0):
        with pytest.raises(ValueError, match="weights"):
            S.assign(np.array([1]), (S.Shard(0, 0, 0, weight),))
