import re

import numpy as np

from gridloom.llm import near_dedup as N


def classes(texts, threshold=0.8):
    """Components of exact similarities of all pairs."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    return label


def test_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(12):
        base = [f"w{v}" for v in rng.integers(0, 4000, int(rng.integers(30, 300)))]
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(1, 9))):
            w = list(base)
            for k in rng.integers(0, len(w), int(rng.integers(0, max(1, len(w) // 25) + 1))):
                w[k] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    texts += ["", None, "a b", "a b", "a  b", "a b c d e f", "short", " "]
    rows = list(enumerate(texts))
    want = classes(texts)
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {r.doc_id: r.class_id for r in found}
    smallest = {v: min(k for k, x in enumerate(want) if x == v) for v in want}
    assert got == {k: smallest[v] for k, v in enumerate(want)}
    for r in found:
        assert r.class_size == sum(c == r.class_id for c in got.values())


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    value = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    one, two = rng.integers(0, 4, 300), rng.integers(0, 4, 300)
    of = np.concatenate([np.zeros((one > 0).sum(), dtype=int), np.ones((two > 0).sum(), dtype=int)])
    sig = N.signatures(of, np.concatenate([value[one > 0], value[two > 0]]), np.concatenate([one[one > 0], two[two > 0]]), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(one, two).sum() / np.maximum(one, two).sum()) < 0.05
    assert (sig != 0).all()


def test_awkward_rows(spark, awkward, nothing):
    got = N.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    assert {(r.doc_id, r.class_id) for r in got if r.doc_id in (7, 8)} == {(7, 7), (8, 7)}
    assert all(r.class_id == r.doc_id for r in got if r.doc_id not in (7, 8))
    assert N.near_duplicates(nothing).count() == 0
    kept = N.deduplicated(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 8").count() == 0 and kept.where("doc_id is null").count() == 1


def test_one_row_of_each_class_is_kept(spark):
    text = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    rows = [
        (1, text("a")), (1, text("a")), (2, text("a")), (3, text("b")), (3, text("b")), (4, text("a")), (4, text("c")), (None, text("d")), (None, text("d")),
        (None, text("b")), (5, text("e")), (5, text("f")), (6, text("f")), (7, ""), (7, ""), (None, None), (8, text("g")), (8, text("h")), (9, text("h", 41)),
    ]
    kept = [tuple(r) for r in N.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    want = [(1, "a"), (3, "b"), (4, "c"), (None, "d"), (5, "e"), (5, "f"), (8, "g"), (8, "h")]
    assert sorted(kept, key=repr) == sorted([*((i, text(name)) for i, name in want), (7, ""), (7, ""), (None, None)], key=repr)


def crowd(rng, n, length, most):
    """Texts of one base with 0 to most words replaced, dropped or put in."""
    base = [f"w{v}" for v in rng.integers(0, 500, length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, most + 1))):
            k, kind = int(rng.integers(0, len(w))), rng.integers(0, 4)
            w[k : k + 1] = [f"x{rng.integers(0, 30 if kind == 1 else 10**6)}"] if kind < 2 else [] if kind == 2 else [w[k], "w1"]
        out.append(" ".join(w))
    return out


def test_a_crowd_that_is_not_all_alike(spark):
    rng = np.random.default_rng(11)
    texts = crowd(rng, 150, 80, 8) + crowd(rng, 60, 30, 4) + crowd(rng, 40, 400, 30)
    want = classes(texts)
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert got == dict(enumerate(want)) and 20 < len(set(want)) < len(texts)


def test_filters_lose_no_pair(spark):
    """All texts in one bucket, none linked: every pair at the threshold is a candidate, few others are."""
    rng = np.random.default_rng(3)
    texts = list(dict.fromkeys(crowd(rng, 120, 60, 8) + crowd(rng, 40, 9, 2) + ["a b c d e", "a b c d e f", "one", "two"]))
    of, value, _, _ = N.shingles(texts)
    own = [set(value[of == k].tolist()) for k in range(len(texts))]
    sets = spark.createDataFrame([(k, bytearray(np.sort(np.array(list(s), dtype="<u8")).tobytes())) for k, s in enumerate(own)], "cid long, set binary")
    for threshold in (0.8, 0.55, 1.0):
        open_ = spark.createDataFrame([(k, k, len(s)) for k, s in enumerate(own)], "cid long, part long, size int")
        got = {(r.a, r.b) for r in N._ordered(N._prefix_pairs(open_, sets, threshold)).collect()}
        want = {(a, b) for b in range(len(own)) for a in range(b) if len(own[a] & own[b]) >= threshold * len(own[a] | own[b]) - 1e-9}
        assert want <= got and len(got) < len(own) * (len(own) - 1) / 2
