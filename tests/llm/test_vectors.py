import time

import numpy as np

from gridloom.llm import embedding_dedup as E
from gridloom.llm import vector_search as V

BAD = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] + [1.0] * 15), (9005, [float("inf")] * 16), (9006, [None] + [1.0] * 15), (9007, [1.0, 2.0])]


def table(spark, seed=0, n=300):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 16))
    base[50:90] = base[10] + 0.12 * rng.standard_normal((40, 16))
    base[100:104] = base[99]
    base[110] = 3 * base[111]
    rows = [(int(k), [float(np.float32(x)) for x in v]) for k, v in enumerate(base)]
    return rows, spark.createDataFrame([(i, v, "x") for i, v in [*rows, *BAD]], "vec_id long, embedding array<float>, rank string").repartition(3)


def test_links_against_all_pairs(spark):
    rows, df = table(spark)
    v = np.array([x for _, x in rows])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(v))
    for _ in range(len(v)):
        new = np.minimum(label, np.where(near, label[None, :], len(v)).min(1))
        if (new == label).all():
            break
        label = new
    got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(BAD)
    for k in range(len(v)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (near[k].sum(), label[k], label[k] == k)
    for k, _ in BAD[:6]:
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_bounds_hold():
    x = np.random.default_rng(1).standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, scale, length, error = E.quantised(x)
    rough = (q * scale[:, None]) @ (q * scale[:, None]).T
    assert (np.abs(x @ x.T - rough) <= length[:, None] * error[None, :] + error[:, None] + 1e-12).all()


def test_search_recall_and_order(spark):
    rows, df = table(spark, 3, 900)
    v = np.array([x for _, x in rows])
    asks = df["vec_id"] % 20 == 0
    found = {}
    for r in V.search(df, asks).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    assert set(found) == {k for k in range(900) if k % 20 == 0}
    for q, got in found.items():
        score = v @ v[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(len(v)), -score))[:20]
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and q not in [g[1] for g in got]
        assert all(np.isclose(g[2], score[g[1]]) for g in got) and [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        hits += len({g[1] for g in got} & set(want.tolist()))
    assert hits / (20 * len(found)) >= 0.9
    few = V.search(df.where("vec_id < 5"), df["vec_id"] == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert V.search(df.limit(0), df["vec_id"] == 0).count() == 0


def test_several_blocks_give_what_one_gives(spark, monkeypatch):
    """Blocks as a large table has them: every pair of blocks is compared, no row is lost or met twice."""
    _, df = table(spark, 5, 400)
    links = {tuple(r) for r in E.near_duplicates(df).collect()}
    found = {tuple(r) for r in V.search(df, df["vec_id"] % 20 == 0, verified=1.0).collect()}
    monkeypatch.setattr(E, "numbered", lambda rows, *_: (rows.count(), 4))
    assert {tuple(r) for r in E.near_duplicates(df).collect()} == links
    blocks = iter((3, 2))
    monkeypatch.setattr(V, "numbered", lambda rows, *_: (rows.count(), next(blocks)))
    assert {tuple(r) for r in V.search(df, df["vec_id"] % 20 == 0, verified=1.0).collect()} == found


def collisions(index, query, least):
    """What collides with a query in three fifths of the arrays, counted from the projections as they are."""
    x = np.column_stack([index.vectors / index.longest, np.sqrt(np.maximum(0, 1 - (index.vectors**2).sum(axis=1) / index.longest**2))])
    apart, half = np.abs((x - np.append(query / np.linalg.norm(query), 0)) @ index.directions), V.START
    while (found := np.flatnonzero((apart <= half).sum(axis=1) >= np.ceil(V.COLLIDE * V.PROJECTIONS))).size < least:
        half *= V.WIDEN
    return found.tolist()


def test_candidates_are_the_colliding_rows(monkeypatch):
    """In one slice, a full one and several, with copies, whatever queries were asked before."""
    for n, ranked in ((1, 65_536), (40, 65_536), (3000, 65_536), (3000, 1000), (3000, 1024), (65_536, 65_536), (65_537, 65_536)):
        monkeypatch.setattr(V, "RANKED", ranked)
        v = np.random.default_rng(n).standard_normal((n, 16)) * np.linspace(0.2, 2, n)[:, None]
        v[n // 2 : n // 2 + n // 5] = v[n // 2]
        index = V.CollisionIndex(v, float(np.sqrt((v * v).sum(axis=1)).max()))
        queries, least = v[:: max(1, n // 5)], max(1, n // 8)
        want = [collisions(index, q, least) for q in queries]
        assert {k: found.tolist() for k, found in index.candidates(queries, least)} == dict(enumerate(want))
        assert {k: found.tolist() for k, found in index.candidates(queries[::-1], least)} == dict(enumerate(want[::-1]))


def test_counting_costs_less_than_a_step_for_each_collision():
    """Counting row numbers out of the windows, as it was done, is the sum of bincount's time and more."""
    n, q = 40_000, 64
    v = np.random.default_rng(2).standard_normal((n, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    index = V.CollisionIndex(v, 1.0)
    times, sums = [], []
    for _ in range(3):
        began = time.process_time()
        assert len(list(index.candidates(v[:q], n // 8))) == q
        times.append(time.process_time() - began)
        inside = np.random.default_rng(3).integers(0, n, V.PROJECTIONS * n // 2).astype(np.int32)
        began = time.process_time()
        for _ in range(q):
            np.bincount(inside, minlength=n)
        sums.append(time.process_time() - began)
    assert min(times) < 1.2 * min(sums)
