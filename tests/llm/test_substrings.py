import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from gridloom.llm import fm_index
from gridloom.llm import substring_dedup as S


def plain(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((" ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return out


def test_index_counts_like_a_scan():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 4, 3000)
    text[rng.integers(0, 3000, 40)] = 0
    index = fm_index.FMIndex(text, 8)
    seen = Counter(tuple(text[i : i + 8]) for i in range(len(text) - 7))
    edges = np.concatenate([[-1], np.flatnonzero(np.append(text, 0) == 0)])
    spans = [(a + 1, z - a - 8) for a, z in zip(edges, edges[1:], strict=False) if z - a - 8 > 0]
    piece, window = index.repeated(text, np.array([s for s, _ in spans]), np.array([n for _, n in spans]), 8)
    got = {int(spans[p][0] + w) for p, w in zip(piece, window, strict=True)}
    assert got == {s + k for s, n in spans for k in range(n) if seen[tuple(text[s + k : s + k + 8])] > 1}


@pytest.mark.parametrize("route_pieces", [4000, 2])
def test_against_plain_python(spark, awkward, monkeypatch, route_pieces):
    monkeypatch.setattr(S, "ROUTE_PIECES", route_pieces)
    rng = np.random.default_rng(1)
    word = lambda n, k: [f"w{v}" for v in rng.integers(0, k, n)]
    passage, other = word(60, 500), word(36, 500)
    texts = [" ".join(word(int(n), 5000)) for n in rng.integers(0, 200, 30)]
    texts += [" ".join(word(20, 900) + passage + word(int(n), 900)) for n in rng.integers(0, 50, 12)]
    texts += [" ".join(word(9, 900) + other[:35] + word(9, 900)), " ".join(other[:35]), " ".join(other[:34]), " ".join(other + other), "a b " * 60, "a b " * 40, texts[0], texts[3], texts[31], "\t".join(passage)]
    texts += [None, "", " ", "one"]
    rows = [(k if k % 9 else None, t, k) for k, t in enumerate(texts)] + [(5, texts[5], len(texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int").repartition(3)
    want = Counter(plain([t for _, t, _ in rows], S.WINDOW))
    got = Counter((r.text, r.n_words, r.n_removed) for r in S.remove_repeats(docs).collect())
    assert got == want


def test_awkward_rows(spark, awkward, nothing):
    got = S.remove_repeats(awkward).collect()
    assert len(got) == awkward.count()
    assert Counter((r.text, r.n_words, r.n_removed) for r in got) == Counter(plain([r.text for r in awkward.collect()], S.WINDOW))
    assert S.remove_repeats(nothing).count() == 0


def test_a_long_passage_is_one_run(spark):
    """What is repeated goes to the texts as runs: an entry a window outgrew the bound for broadcasting, and all texts were shuffled."""
    passage, own = " ".join(f"p{k}" for k in range(400)), " ".join(f"o{k}" for k in range(40))
    texts = {1: f"{own} {passage}", 2: f"{passage} end", 3: f"{passage.replace('p200', 'else')} {own}", 4: own}
    runs = S.repeated_windows(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert sorted(r.runs for r in runs) == sorted([[0, 6, 40, 366], [0, 366], [0, 166, 201, 165, 400, 6], [0, 6]])
    assert S._runs(pd.Series([np.array([40, 5, 0, 3, 2, 1, 100, 2**61])])).tolist()[0].tolist() == [0, 3, 40, 1, 42, 1, 161, 1]
