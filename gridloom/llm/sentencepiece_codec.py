"""SentencePiece encoding and decoding with forward scores shared along a trie of words.

A text is marked as the model does it (white space becomes U+2581, one is put in front) and cut into marked words: a run
of marks with the characters up to the next mark. No piece of such a model has a mark after another character, so words
are encoded on their own. A batch's distinct words, sorted, are the depth-first traversal of their trie: a word keeps the
forward states of the prefix it shares with the word before it and only computes those of its own characters.

The forward state of a prefix holds its best segmentation's last piece. For unigram models the best is the greatest sum
of scores. Merge (BPE) models define the segmentation by merges instead, and a greatest sum is not what they return;
there, a prefix's last piece is the one that stays apart from the piece before it when the merges run over the two
(each prefix has exactly one such piece), so the same pass gives the merges' own result. Which of the two holds is read
from the model file.

Null and empty texts have no ids; texts of any length are coded whole. Repeated rows and ties are encoded alike; an input column named like an output column
is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cached, release, small_batches
from gridloom.llm.wordhash import slices

MARK = "▁"
#: Words and pairs of pieces that a worker remembers between batches; beyond, it begins anew.
REMEMBERED, REMEMBERED_PAIRS = 1_000_000, 1_000_000
#: Bytes of a batch: words of more texts, sorted together, share more prefixes.
BATCH = 16 << 20


class Codec:
    """One model's pieces, with encoding and decoding of batches."""

    def __init__(self, model_file: str, unigram: bool | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.unknown = model.unk_id()
        plain = [k for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        self.ids = {model.id_to_piece(k): k for k in plain}
        self.scores = {model.id_to_piece(k): model.get_score(k) for k in plain}
        #: the longest piece that ends with these three characters
        self.reach: dict[str, int] = {}
        for piece in self.ids:
            self.reach[piece[-3:]] = max(len(piece), self.reach.get(piece[-3:], 1))
        self.cut = re.compile(f"{MARK}*{self._separate()}|{MARK}*[^{MARK}]+|{MARK}+").findall
        self.bytes = {int(model.id_to_piece(k)[3:5], 16): k for k in range(n) if model.is_byte(k)}
        self.unigram = (_model_type(model_file) == 1) if unigram is None else unigram
        self.least = min(self.scores.values()) - 10
        self.text = [b""] * n
        for piece, k in self.ids.items():
            self.text[k] = piece.replace(MARK, " ").encode()
        for value, k in self.bytes.items():
            self.text[k] = bytes([value])
        self.text[self.unknown] = " ⁇ ".encode()
        self.code = {piece: k.to_bytes(4, "little") for piece, k in self.ids.items()}
        self.words: dict[str, bytes] = {}
        #: by a piece and the piece before it; the empty one stands for a word's beginning
        self.pairs: dict[str, dict[str, bool]] = {}
        self.known = 0

    def _separate(self) -> str:
        """A pattern for letters and digits up to a punctuation mark that no piece has behind the last of them.

        No segmentation crosses such a place, so words are cut there too, and the same word with and without a comma is
        encoded once.
        """
        joined: dict[str, set[str]] = {mark: set() for mark in string.punctuation}
        for piece in self.ids:
            for a, b in zip(piece, piece[1:], strict=False):
                if b in joined and re.match(r"\w", a):
                    joined[b].add(a)
        marks = "".join(m for m, letters in joined.items() if len(letters) <= 8)
        kept = "".join(sorted(set().union(*(joined[m] for m in marks))))
        return rf"\w*[^\W{kept}](?=[{re.escape(marks)}])" if marks else r"(?!)"

    def _merged(self, text: str) -> list[str]:
        """The merges over a short string: the best-scored adjacent pair first, the leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, a: str, b: str) -> bool:
        """Whether the merges over a + b end with just these two pieces; without a, whether they build b at all."""
        found = self._merged(a + b) == ([a, b] if a else [b])
        if self.known > REMEMBERED_PAIRS:
            self.pairs.clear()
            self.known = 0
        self.pairs.setdefault(a, {})[b] = found
        self.known += 1
        return found

    def _learn(self, words: list[str]) -> None:
        """Encodes new words in sorted order; last[i] is the last piece of the current word's first i characters, and
        score[i], for unigram models, their greatest sum of scores."""
        scores, pairs, reach, code = self.scores, self.pairs, self.reach.get, self.code
        last, score, before = [""], [0.0], ""
        for word in sorted(words):
            shared, n = 0, len(word)
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            if self.unigram:
                del score[shared + 1 :]
            for end in range(shared + 1, n + 1):
                first = end - reach(word[max(0, end - 3) : end], 2)
                if self.unigram:
                    best, piece = score[end - 1] + scores.get(word[end - 1], self.least), word[end - 1]
                    for start in range(max(0, first), end - 1):
                        own = scores.get(word[start:end])
                        if own is not None and score[start] + own > best:
                            best, piece = score[start] + own, word[start:end]
                    score.append(best)
                    last.append(piece)
                    continue
                for start in range(first if first > 0 else 0, end):
                    piece = word[start:end]
                    if piece in scores or start == end - 1:
                        # a piece that the merges never build from its own characters doesn't occur
                        row = pairs.get(last[start])
                        apart = row.get(piece) if row is not None else None
                        if apart if apart is not None else self._apart(last[start], piece):
                            last.append(piece)
                            break
                else:
                    raise AssertionError("every prefix has a segmentation")
            parts, end = [], n
            while end:
                piece = last[end]
                parts.append(piece)
                end -= len(piece)
            parts.reverse()
            try:
                self.words[word] = b"".join([code[piece] for piece in parts])
            except KeyError:
                self.words[word] = self._with_unknown(parts)
            before = word

    def _with_unknown(self, parts: list[str]) -> bytes:
        """Ids where some characters are no piece: their bytes' pieces, or else one unknown id for each run of them."""
        ids: list[int] = []
        for part in parts:
            if part in self.ids:
                ids.append(self.ids[part])
            elif self.bytes:
                ids.extend(self.bytes[b] for b in part.encode("utf-8", "replace"))
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, four little-endian bytes an id."""
        marked = [self.cut((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        new = {w for ws in marked for w in ws}.difference(self.words)
        if new:
            self._learn(list(new))
        get = self.words.__getitem__
        return [b"".join(map(get, ws)) for ws in marked]

    def decode(self, ids) -> str:
        text = b"".join(map(self.text.__getitem__, ids))
        # the mark that was put in front
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def _model_type(model_file: str) -> int:
    """trainer_spec.model_type (field 2, then 3) of the model's protocol buffer: 1 unigram, 2 BPE."""

    def fields(data: bytes) -> Iterator[tuple[int, object]]:
        at = 0

        def varint() -> int:
            nonlocal at
            out = shift = 0
            while True:
                b = data[at]
                at += 1
                out |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return out

        while at < len(data):
            tag = varint()
            if tag & 7 == 0:
                yield tag >> 3, varint()
            elif tag & 7 == 2:
                n = varint()
                yield tag >> 3, data[at : at + n]
                at += n
            else:
                at += 8 if tag & 7 == 1 else 4

    with open(model_file, "rb") as f:
        trainer = next((v for k, v in fields(f.read()) if k == 2), b"")
    return next((v for k, v in fields(trainer) if k == 3), 1)


def encode(docs: DataFrame, model_file: str, *, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the ids of the whole text, as binary, four little-endian bytes an id."""
    small_batches(docs.sparkSession, BATCH)

    @F.pandas_udf("binary")
    def ids_of(texts: pd.Series) -> pd.Series:
        codec = cached(("sentencepiece", model_file), lambda: Codec(model_file))
        values, out = texts.tolist(), []
        for a, z in slices(values, 4_000_000):
            out += codec.encode(values[a:z])
        release()
        return pd.Series(out, dtype=object)

    return docs.withColumn(into, ids_of(F.col(text)))


def decode(docs: DataFrame, model_file: str, *, ids: str = "ids", into: str = "text") -> DataFrame:
    """docs with the text of the ids that encode wrote."""
    small_batches(docs.sparkSession, BATCH)

    @F.pandas_udf("string")
    def text_of(values: pd.Series) -> pd.Series:
        codec = cached(("sentencepiece", model_file), lambda: Codec(model_file))
        return pd.Series([codec.decode(np.frombuffer(v or b"", dtype="<u4").tolist()) for v in values])

    return docs.withColumn(into, text_of(F.col(ids)))
