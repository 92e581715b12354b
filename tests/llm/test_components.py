import numpy as np

from gridloom.llm.components import connected


def found(links):
    return {r.node: r.component for r in connected(links).collect()}


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, 100 + k) for k in range(1, 50)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (300, 299), (5, 4)], "a long, b long")
    assert found(links) == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(50)}, 299: 299, 300: 299}
    assert connected(links.limit(0)).count() == 0


def test_long_chains_end(spark):
    """Chains whose smallest node is at one end while all others fall towards the other, or rise and fall."""
    falling = [1000, *range(1, 1000)][::-1]
    up = list(range(2001, 3001, 2))
    mountain = [*up, *(k + 1 for k in reversed(up)), 2000]
    pairs = [*zip(falling, falling[1:], strict=False), *zip(mountain, mountain[1:], strict=False), (1000, 0)]
    got = found(spark.createDataFrame(pairs, "a long, b long"))
    assert got == {**{k: 0 for k in [0, *falling]}, **{k: 2000 for k in mountain}}


def test_hubs_and_random_links(spark):
    rng = np.random.default_rng(4)
    hub = spark.range(1, 100_001).selectExpr("1000000 as a", "id as b")
    assert connected(hub).where("component = 1").count() == 100_001
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))]
    label = list(range(400))
    for _ in range(400):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert found(spark.createDataFrame(pairs, "a long, b long")) == {k: label[k] for k in {x for p in pairs if p[0] != p[1] for x in p}}
