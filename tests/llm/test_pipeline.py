"""The pipeline's stages, each against plain Python on what the stage before it kept."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as C
import numpy as np
import pytest

from gridloom.llm import toxicity
from gridloom.llm.common import stored

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of the small table beside near copies, repeated passages, shared and missing ids, nulls and empty texts."""
    path, rng = str(tmp_path_factory.mktemp("corpus")), np.random.default_rng(6)
    base = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and length(text) > 400 and doc_id < 120").toPandas()
    rows = [(int(r.doc_id), r.text, r.lang, r.source, int(r.n_chars)) for r in base.itertuples()]
    texts = [r[1] for r in rows if r[2] == "en"]
    passage = " ".join(texts[0].split()[:50])
    for k, text in enumerate(texts[:12]):
        w = text.split()
        w[int(rng.integers(0, len(w)))] = f"changed{k}"
        rows += [(1000 + k, " ".join(w), "en", "copies", 1), (1000 + k, " ".join(w), "en", "copies", 1), (2000, text + " and so on", "en", "shared", 1)]
        rows.append((3000 + k, " ".join(texts[20 + k].split()[:60]) + " " + passage, "en", "passages", 1))
    rows += [(None, texts[3], "en", None, None), (None, "no id but words enough for a shingle and more", "en", None, None), (4000, None, "en", "a", 1), (4001, "", None, "a", 1), (4002, " \n", "en", None, 1), (4003, "12 34 -- !!", "en", "a", 1)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage_against_plain_python(spark, corpus):
    before = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = before.columns
    for name, stage in C.STAGES:
        given = before.collect()
        after = stored(stage(spark, before, corpus))
        kept = after.collect()
        if name != "packing":
            assert after.columns == columns
        if name in ("language", "toxicity", "near_dedup"):
            assert not Counter(map(tuple, kept)) - Counter(map(tuple, given))
        if name == "language":
            assert {4000, 4001, 4002, 4003} & {r.doc_id for r in kept} == set() and len(kept) == len(given) - 4
        if name == "toxicity":
            labels = spark.read.parquet(f"{corpus}/labels.parquet").where(~toxicity.held_out())
            scores = toxicity.score_texts(toxicity.fit(before, labels), [r.text for r in given])
            assert Counter(map(tuple, kept)) == Counter(tuple(r) for r, s in zip(given, scores, strict=True) if s < C.MOST_TOXIC)
        if name == "near_dedup":
            texts = sorted({" ".join(WORD.findall(r.text)) for r in given})
            sets, label = [shingles(t) for t in texts], list(range(len(texts)))
            for a in range(len(texts)):
                for b in range(a):
                    if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                        x, y = sorted((label[a], label[b]))
                        label = [x if v == y else v for v in label]
            part = dict(zip(texts, label, strict=True))
            best = defaultdict(list)
            for r in given:
                best[part[" ".join(WORD.findall(r.text))]].append(r.doc_id)
            want = Counter((k, min((i for i in ids if i is not None), default=None)) for k, ids in best.items())
            assert Counter((part[" ".join(WORD.findall(r.text))], r.doc_id) for r in kept) == want and len(kept) < len(given)
        if name == "substring_dedup":
            words = [WORD.findall(r.text or "") for r in given]
            seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
            gone = [{k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)} for w in words]
            want = Counter((r.doc_id, " ".join(x for k, x in enumerate(w) if k not in g)) for r, w, g in zip(given, words, gone, strict=True))
            assert Counter((r.doc_id, r.text) for r in kept) == want and any(gone) and all(r.n_chars == len(r.text) for r in kept)
        if name == "packing":
            ends = Counter()
            for r in kept:
                ends[r.sequence_id] += r.length
            assert max(ends.values()) <= 1024 and len({r.doc_id for r in kept}) == len({r.doc_id for r in given}) and sum(r.piece == 0 for r in kept) == len(given)
        before = after


def test_stages_take_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        after = stage(spark, docs, corpus)
        assert after.count() == 0 and (name == "packing" or after.columns == docs.columns)


def test_run_gives_the_stages_result(spark):
    assert C.run(spark, SF).count() > 0
