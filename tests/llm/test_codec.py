import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import sentencepiece_codec as S
from gridloom.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return S.Codec(MODEL)


def ids(codec, texts):
    return [np.frombuffer(x, dtype="<u4").tolist() for x in codec.encode(texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aab,.'e \n\t▁_²thTe中é😀-0"), max_size=40), min_size=1, max_size=5))
def test_same_ids_as_the_library(codec, library, texts):
    assert ids(codec, texts) == library.encode(texts)


def test_documents_like_the_library(spark, codec, library):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert ids(codec, texts) == library.encode(texts)


def test_unigram_scores_are_the_greatest():
    """A unigram reading of the same pieces, against every segmentation of short words."""
    codec = S.Codec(MODEL, unigram=True)

    def best(word):
        if not word:
            return 0.0
        return max(codec.scores.get(word[:k], codec.least if k == 1 else -np.inf) + best(word[k:]) for k in range(1, len(word) + 1))

    pieces = {v: k for k, v in codec.ids.items()}
    for word in ("hello", "there", "unhappy", "abcabc"):
        found = [pieces[i] for i in ids(codec, [word])[0]]
        assert "".join(found) == "▁" + word
        assert np.isclose(sum(codec.scores[p] for p in found), best("▁" + word))


def test_round_trip_and_awkward_rows(spark, awkward, nothing, library):
    coded = S.encode(awkward, MODEL, into="score")
    back = S.decode(coded, MODEL, ids="score", into="lang").collect()
    assert len(back) == awkward.count()
    for r in back:
        assert r.lang == (r.text or "")
        assert np.frombuffer(r.score, dtype="<u4").tolist() == library.encode(r.text or "")
    assert S.encode(nothing, MODEL).count() == 0
