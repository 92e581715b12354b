"""Toxicity by compression distance: two zstandard dictionaries, one per class, and calibrated window lengths.

A text is cut into windows of a few words, each window is compressed twice, once with a dictionary trained on ordinary
text and once with a dictionary that holds, before that same ordinary content, the beginnings of those words which
toxic text uses in many contexts and ordinary text does not. This list stands in for a dictionary trained on toxic
windows, which does far worse here (README); phrases, and words that stand after few distinct words in the toxic
sample, are not in it and are no evidence. Windows that shrink more with the toxic dictionary are
evidence; how far they must shrink, and how many of them a text of some length needs, is learned by a logistic
calibration on labelled texts that the dictionaries have not seen. The calibration weighs the classes as if a fixed share
of texts, `prior`, were toxic: what a score means depends neither on the sample's bounds nor on the table's size.

The fit uses at most `max_toxic` and `max_ordinary` labelled rows (smallest hash of their id first) and a single driver
process; scoring is one Arrow pass over whole texts without a shuffle.

Texts of any length are scored whole. Null and empty texts have no windows: their features are all zero and they get the calibrated base score of such texts.
Ties, repeated rows and extra columns pass through; an input column named like an output column is replaced.
If the labels name no row of one of the classes there is nothing to learn: every score is the share of toxic labels
(0.0 without any label).
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cached, release, small_batches

WINDOW = 8
DICTIONARY = 4096
TOXIC_DICTIONARY = 2048
#: The share of toxic texts that scores reckon with; above the usual one, as a toxic text missed weighs more than a false alarm.
PRIOR = 0.2


@dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs: the two dictionaries' content and the calibration."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    base: float


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    words = text.lower().split()
    return [" ".join(words[i : i + size]).encode("utf-8", "replace") for i in range(0, len(words), size)]


def _compressor(content: bytes):
    params = zstandard.ZstdCompressionParameters(
        window_log=16, hash_log=12, chain_log=12, search_log=3, min_match=4, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress


def _features(texts, ordinary, toxic) -> np.ndarray:
    """Per text: means and maxima of the windows' gains, and the text's length."""
    out = np.zeros((len(texts), 8))
    for row, text in enumerate(texts):
        cut = windows(text or "")
        if not cut:
            continue
        gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in cut], dtype=float)
        n = len(gain)
        over = [np.maximum(gain - k, 0).sum() for k in (1, 3, 5)]
        out[row] = (gain.mean(), over[0] / n, over[1] / n, over[2] / n, np.log1p(over[1]), np.log1p(over[2]), gain.max(), np.log(n))
    return out


def _expand(x: np.ndarray) -> np.ndarray:
    """A constant, the features, and their products with each other."""
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
    return np.column_stack([np.ones(len(x)), x, *pairs])


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary's content; where the distinct samples fit into it as they are, those, the commonest last."""
    distinct = [x for x, _ in Counter(samples).most_common()]
    if sum(map(len, distinct)) <= size:
        return b"".join(reversed(distinct))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size * 3 // 4 :]
    except zstandard.ZstdError:
        return b"".join(distinct)[-size:]


def _starts(word: str) -> list[str]:
    """What a word is counted by: itself and its beginnings of four to seven characters."""
    return [word[:n] for n in range(4, min(8, len(word)))] + [word]


def _contexts(texts: list[str], wanted: set[str]) -> dict[str, int]:
    """How many distinct words stand before each wanted word or beginning: copies of a text add nothing."""
    place = {part: k for k, part in enumerate(sorted(wanted))}
    seen, fresh = np.zeros(0, dtype=np.uint64), array("Q")
    for text in texts:
        before = 0
        for word in text.lower().split():
            for part in _starts(word):
                if (k := place.get(part)) is not None:
                    fresh.append(k << 32 | before)
            before = zlib.crc32(word.encode("utf-8", "replace"))
        if len(fresh) > 2_000_000:
            seen, fresh = np.union1d(seen, np.frombuffer(fresh, dtype=np.uint64)), array("Q")
    seen = np.union1d(seen, np.frombuffer(fresh, dtype=np.uint64)) if fresh else seen
    return dict(zip(place, np.bincount((seen >> np.uint64(32)).astype(np.int64), minlength=len(place)).tolist(), strict=True))


def _telling(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Words and beginnings that toxic text uses in many contexts and ordinary text, for its length, in few."""
    often = Counter(part for text in toxic for word in text.lower().split() for part in _starts(word))
    least = 6 + len(toxic) // 100
    bad = _contexts(toxic, {part for part, n in often.items() if n >= least})
    bad = {part: n for part, n in bad.items() if n >= least}
    del often
    good = _contexts(ordinary, set(bad))
    n_bad, n_good = (max(1, sum(len(t.split()) for t in side)) for side in (toxic, ordinary))
    return {part for part, n in bad.items() if n / n_bad > 12 * (good[part] + 1) / n_good}


def _shares(sizes: list[int], most: int) -> list[int]:
    """How many of its samples each text gives, `most` in all: the same number each, or all where a text has fewer."""
    out = [0] * len(sizes)
    for done, k in enumerate(sorted(range(len(sizes)), key=lambda k: sizes[k])):
        out[k] = min(sizes[k], most // (len(sizes) - done))
        most -= out[k]
    return out


def _spread(groups: Iterable[list], sizes: list[int], most: int) -> list:
    """At most `most` samples of all groups, evenly spaced over each; sizes are the groups' lengths."""
    return [own[i * len(own) // n] for own, n in zip(groups, _shares(sizes, most), strict=True) for i in range(n)]


def train(toxic: list[str], ordinary: list[str], *, most_windows: int = 60_000, most_beginnings: int = 200_000, prior: float = PRIOR) -> ToxicityModel:
    """Dictionaries from seven tenths of the texts of either class, the calibration from the rest.

    The ordinary dictionary is trained on at most most_windows windows of eight words and the toxic one on at most
    most_beginnings beginnings of words, both spread over all of these texts.
    """
    base = len(toxic) / max(1, len(toxic) + len(ordinary))
    if not toxic or not ordinary:
        return ToxicityModel(b"", b"", (), (), (), base)
    a, b = max(1, len(toxic) * 7 // 10), max(1, len(ordinary) * 7 // 10)
    telling = _telling(toxic[:a], ordinary[:b])
    heads = {w: next((s for s in sorted(_starts(w), key=len) if s in telling and (len(s) > 4 or s == w)), None) for t in toxic[:a] for w in t.lower().split()}
    samples = [[f" {heads[w]}".encode("utf-8", "replace") for w in t.lower().split() if heads[w]] for t in toxic[:a]]
    cut = [-(-len(t.split()) // 8) for t in ordinary[:b]]
    common = _trained(DICTIONARY, _spread((windows(t, 8) for t in ordinary[:b]), cut, most_windows)) or b" "
    special = _trained(TOXIC_DICTIONARY, _spread(samples, [len(x) for x in samples], most_beginnings)) or b" "
    rest_bad, rest_good = toxic[a:] or toxic, ordinary[b:] or ordinary
    x = _features([*rest_bad, *rest_good, ""], _compressor(common), _compressor(special + common))
    y = np.array([1.0] * len(rest_bad) + [0.0] * len(rest_good) + [0.0])
    counts = len(y) * np.where(y == 1, prior / y.sum(), (1 - prior) / (len(y) - y.sum()))
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = _expand((x - mean) / spread)
    w = np.zeros(z.shape[1])
    for _ in range(40):  # Newton steps of a ridge-regularised logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (counts * (p * (1 - p) + 1e-6))[:, None]).T @ z + np.eye(len(w))
        w = w + np.linalg.solve(h, z.T @ (counts * (y - p)) - w)
    return ToxicityModel(special + common, common, tuple(w), tuple(mean), tuple(spread), base)


def score_texts(model: ToxicityModel, texts) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), model.base)
    ordinary, toxic = cached(("toxicity", model.toxic, model.ordinary), lambda: (_compressor(model.ordinary), _compressor(model.toxic)))
    x = (_features(texts, ordinary, toxic) - np.array(model.mean)) / np.array(model.spread)
    return 1 / (1 + np.exp(-np.clip(_expand(np.clip(x, -6, 6)) @ np.array(model.weights), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", max_toxic: int = 2000, max_ordinary: int = 4000, most_windows: int = 60_000, most_beginnings: int = 200_000, prior: float = PRIOR) -> ToxicityModel:
    """Learns from the labelled rows given; at most max_toxic and max_ordinary of them reach the driver. The rest as in train."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("y")).distinct()
    sides = []
    for value, most in ((1, max_toxic), (0, max_ordinary)):
        ids = known.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id")
        found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
        rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most)
        sides.append([r.text for r in rows.select("text").toLocalIterator()])
    model = train(*sides, most_windows=most_windows, most_beginnings=most_beginnings, prior=prior)
    del sides
    release()
    return model


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the column `into`: how likely the whole text is toxic, 0 to 1."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        found = score_texts(model, texts.tolist())
        release()
        return pd.Series(found)

    return docs.withColumn(into, scored(F.col(text)))


def held_out() -> F.Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
