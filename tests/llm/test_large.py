"""The branches that only large tables take give the same results: joins by shuffling instead of broadcasts."""

import numpy as np

from gridloom.llm import common, language, near_dedup, substring_dedup
from pyspark.sql import functions as F


def texts(seed, n=60):
    rng = np.random.default_rng(seed)
    base = [f"w{v}" for v in rng.integers(0, 300, 90)]
    out = []
    for k in range(n):
        w = list(base) if k % 2 else [f"v{v}" for v in rng.integers(0, 900, int(rng.integers(5, 80)))]
        for at in rng.integers(0, len(w), k % 7):
            w[at] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return [*out, None, "", out[3], out[5]]


def test_near_duplicates_by_shuffling(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts(1))), "doc_id long, text string")
    want = {tuple(r) for r in near_dedup.near_duplicates(docs).collect()}
    kept = {tuple(r) for r in near_dedup.deduplicated(docs).collect()}
    monkeypatch.setattr(near_dedup, "BROADCAST_KEYS", 0)
    assert {tuple(r) for r in near_dedup.near_duplicates(docs).collect()} == want
    assert {tuple(r) for r in near_dedup.deduplicated(docs).collect()} == kept


def test_substrings_by_shuffling(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts(2))), "doc_id long, text string")
    want = {tuple(r) for r in substring_dedup.remove_repeats(docs).collect()}
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in substring_dedup.remove_repeats(docs).collect()} == want


def test_hosts_by_shuffling(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    evidence = {"text": F.col("text"), "declared": F.col("lang"), "host": F.col("source"), "suffix": F.lit(None).cast("string")}
    model = language.fit(docs)
    rows = lambda: {(r.doc_id, r.language, round(r.confidence, 9)) for r in language.identify(docs, model, **evidence).collect()}
    want = rows()
    monkeypatch.setattr(language, "BROADCAST_ROWS", 0)
    assert rows() == want


def test_stored_folders_can_be_removed(spark):
    from pathlib import Path

    common.clear(spark)
    df = common.stored(spark.range(3))
    place = Path(common.WRITTEN[-1].removeprefix("file://"))
    assert df.count() == 3 and place.exists()
    assert common.clear(spark) == 1 and not place.exists() and common.clear(spark) == 0
