import tracemalloc
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from gridloom.llm import packing as P
from gridloom.llm.queries import vocabulary

VOCABULARY = vocabulary("byte_bpe_50k.json")


def test_ids_and_places(spark, awkward, nothing):
    rows = P.pack_documents(awkward.where("doc_id is not null"), vocabulary=VOCABULARY, keep=("doc_id", "text")).collect()
    library = Tokenizer.from_file(VOCABULARY)
    by_text, places = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r.length <= 1024 and len(r.ids) == 4 * r.length
        by_text[r.doc_id, r.text].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for (_, text), own in by_text.items():
        want = library.encode(text or "", add_special_tokens=False).ids + [2]
        whole, at = [], 0
        copies = sum(r.piece == 0 for r in own)
        for r in sorted(own, key=lambda r: r.piece)[::copies]:
            assert r.start == at and (r.piece == 0 or r.length == 1024)
            whole += np.frombuffer(r.ids, dtype="<u4").tolist()
            at += r.length
        assert whole == want
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert P.pack_documents(nothing, vocabulary=VOCABULARY).count() == 0


def test_plans_cover_the_histogram_close_to_the_bound():
    rng = np.random.default_rng(3)
    for n in (1, 7, 500, 20_000):
        histogram = {int(k): int(c) for k, c in zip(*np.unique(np.minimum(1024, rng.lognormal(5.5, 1.0, n).astype(int) + 1), return_counts=True), strict=True)}
        plan = P.solve(histogram)
        got, filled = defaultdict(int), defaultdict(int)
        starts = defaultdict(list)
        for length, first, each, sequence, offset in plan.runs:
            starts[length].append((first, each, sequence, offset))
        for length, runs in starts.items():
            runs.sort()
            for k, (first, each, sequence, _) in enumerate(runs):
                last = runs[k + 1][0] if k + 1 < len(runs) else histogram[length]
                got[length] += last - first
                for r in range(last - first):
                    filled[sequence + r // each] += length
        assert dict(got) == histogram
        assert max(filled.values()) <= 1024 and set(filled) == set(range(plan.sequences))
        assert plan.sequences <= np.ceil(plan.lower_bound) * 1.02 + 2
        assert n < 500 or plan.by_program >= 0.25 * plan.sequences


def test_small_plans_are_optimal():
    assert P.solve({512: 2, 1024: 1}).sequences == 2
    assert P.solve({600: 3, 424: 3}).sequences == 3
    assert P.solve({342: 1, 341: 2}).sequences == 1
    assert P.solve({}).sequences == 0


def test_mixtures_cover_every_need_once():
    rng = np.random.default_rng(8)
    lengths = np.sort(rng.choice(np.arange(1, 1025), 150, replace=False))
    for most in (3, 1000, 10**9):
        need = rng.integers(1, most + 1, 150)
        mix = P._mixture(lengths, need, 1024, 0.5, 8)
        assert np.allclose(sum(u * x for u, x in mix), need) and all((u * lengths).sum() <= 1024 and x > 0 for u, x in mix)
        assert len(mix) < 20_000


def test_mixtures_stay_small_and_their_plans_whole():
    """The driver holds thousands of configurations at once; their narrow counts must not overflow where ranks are added up."""
    rng = np.random.default_rng(12)
    lengths = np.sort(rng.choice(np.arange(1, 1025), 120, replace=False))
    need = rng.integers(70_000, 10**6, 120)
    tracemalloc.start()
    plan = P.solve(dict(zip(lengths.tolist(), need.tolist(), strict=True)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6, peak
    starts = sorted({r[3] for r in plan.runs}) + [plan.sequences]
    times = dict(zip(starts, np.diff(starts).tolist(), strict=False))
    given, volume = Counter(), Counter()
    for length, rank, each, sequence, _ in plan.runs:
        assert rank == given[length]
        given[length] += each * times[sequence]
        volume[sequence] += each * length
    assert given == dict(zip(lengths.tolist(), need.tolist(), strict=True)) and max(volume.values()) <= 1024


def test_ids_are_those_of_the_library():
    """The faster library with its altered pattern, against the JSON file's own tokenizer."""
    rng, encode, library = np.random.default_rng(9), P._encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    parts = ["the", " cat", "'s", " 12", "345", "  ", "\n", "\t", " \n ", "é", "中文", "😀", "!?", " ...", "\u00a0", "\u2003", "<|endoftext|>", "don't", "\x00", "_", "ﬁ", "\r\n", "I'LL", "x" * 50]
    for _ in range(3000):
        text = "".join(rng.choice(parts, int(rng.integers(0, 12))))
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
