"""Best-fit packing by a configuration linear program over the length histogram.

Texts become token pieces of at most `capacity` tokens, the first of a longer text being the shorter one. What the packer decides depends only on how many pieces have
each length: the histogram, at most `capacity` numbers, is all that reaches the driver. The program "fewest sequences,
each filled by a configuration of lengths, that cover the histogram" is solved by multiplicative weights: lengths carry
weights, a knapsack by dynamic programming prices configurations by them, those are used, and the weights of the lengths
they cover fall. The mixture's full configurations are rounded down to whole sequences; what is left over is packed by
best-fit decreasing, also on the histogram. Pieces then find their place by the rank among the pieces of their length.

Ranks need no sort: each tokenising task numbers its own pieces per length, and the running sums over tasks of the
counts per task and length make the numbers global.

Null and empty texts are documents of a single end token; texts of any length are read whole, a batch of texts at a time. Repeated rows are packed each on its own. An empty table gives
no piece. Extra columns are dropped, except those named in `keep`; names of output columns cannot be kept.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import cached, release, small_batches, stored

CAPACITY, END = 1024, 2
#: How strongly weights fall with cover; the mixtures' steps and lengths priced at a time; the shares of the volume that are tried.
WEIGHT_STEP, MIXTURES, SHARES = 0.1, ((0.1, 32), (0.5, 8)), (1.0, 0.8, 0.6, 0.45, 0.3)
VOCABULARY = "byte_bpe_50k.json"


def _encoder(vocabulary: str):
    """ids of a text as little-endian unsigned 32-bit numbers, by the byte-level vocabulary of that file.

    The merges of the JSON file and the ranks file beside it are the same vocabulary. Where the rank file is there, the
    faster of the two libraries reads it; a text without two white-space characters in a row gets the same pieces
    from a pattern without look-ahead, which is faster again.
    """
    import os

    ranks = re.sub(r"\.json$", ".tiktoken", vocabulary)
    if not os.path.exists(ranks):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(vocabulary)
        return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4")
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(vocabulary) as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    full = tiktoken.Encoding("full", pat_str=PATTERN, mergeable_ranks=table, special_tokens=special)
    plain = tiktoken.Encoding("plain", pat_str=PATTERN.replace(r"|\s+(?!\S)", ""), mergeable_ranks=table, special_tokens=special)
    double = re.compile(r"\s\s|\s$")
    return lambda text: (full if double.search(text) else plain).encode_to_numpy(text, allowed_special="all")


def pieces(docs: DataFrame, *, vocabulary: str, capacity: int = CAPACITY, end: int = END, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., piece, start, length, ids, block, rank): ids is binary, four bytes a token; block and rank place the piece."""
    if taken := {"piece", "start", "length", "ids", "block", "rank"} & {c.lower() for c in keep}:
        raise ValueError(f"columns of the result cannot be kept: {sorted(taken)}")
    small_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col("text").alias("_text"))
    schema = T.StructType([docs.schema[c] for c in keep])
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids", "binary"), ("block", "integer"), ("rank", "long")):
        schema = schema.add(name, kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = cached(("packing", vocabulary), lambda: _encoder(vocabulary))
        block, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                of, piece, start, length, ids = [], [], [], [], []
                for row, text in enumerate(batch.column("_text").to_pylist()):
                    tokens = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                    first = (len(tokens) - 1) % capacity + 1
                    for k, stop in enumerate(range(first, len(tokens) + 1, capacity)):
                        s = max(0, stop - capacity)
                        part = tokens[s:stop]
                        of.append(row), piece.append(k), start.append(s), length.append(len(part)), ids.append(part.tobytes())
                rank = np.empty(len(length), dtype=np.int64)
                for k, n in enumerate(length):
                    rank[k] = seen[n]
                    seen[n] += 1
                own = [batch.column(c).take(pa.array(of, pa.int32())) for c in keep]
                new = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(np.full(len(of), block, dtype=np.int32)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays([*own, *new], names=schema.names)
            release()

    return kept.mapInArrow(cut, schema)


@dataclass(frozen=True)
class Plan:
    """Runs of equal sequences, as rows (length, first rank, ranks per sequence, first sequence, offset of the first).

    by_program: how many of the sequences the program's configurations fill; the rest is best fit's.
    """

    runs: tuple[tuple[int, int, int, int, int], ...]
    sequences: int
    lower_bound: float
    by_program: int = 0


def _knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """For each room up to capacity, the length that a best filling of it takes first, or -1 for a unit left empty."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], n = best[room - 1], fits[room]
        if n:
            gain = best[room - lengths[:n]] + value[:n]
            k = int(gain.argmax())
            if gain[k] > best[room]:
                best[room], took[room] = gain[k], k
    return took


def _mixture(lengths: np.ndarray, need: np.ndarray, capacity: int, step: float, each: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, in the order in which they were found; every need is covered, none twice.

    A length's weight is its share of a sequence, times a factor that falls as its need gets covered. With these weights the
    knapsack prices configurations: for the `each` lengths whose cover lags most, the best one that holds each of them. A
    configuration is used for `step` of what its scarcest length still needs, and for all of it where that is little, so
    the number of rounds depends on the number of lengths and not on their needs. Thousands of configurations are kept at
    once, so their counts, of which none is above the capacity, take two bytes each.
    """
    covered, mix = np.zeros(len(need)), []
    need = need.astype(float)
    while (open_ := np.flatnonzero(covered < need * (1 - 1e-9))).size:
        share = covered[open_] / need[open_]
        weight = lengths[open_] * np.exp(-WEIGHT_STEP * (share - share.min()))
        took = _knapsack(lengths[open_], weight, capacity)
        for at in np.argsort(share - 1e-6 * lengths[open_], kind="stable")[:each]:
            left = need - covered
            if left[open_[at]] <= need[open_[at]] * 1e-9:
                continue
            use, room = np.zeros(len(need), dtype=np.int64), capacity - int(lengths[open_[at]])
            use[open_[at]] = 1
            while room > 0:
                if took[room] < 0:
                    room -= 1
                else:
                    use[open_[took[room]]] += 1
                    room -= int(lengths[open_[took[room]]])
            use[left <= need * 1e-9] = 0
            used = np.flatnonzero(use)
            scarce = used[np.argmin(left[used] / use[used])]
            times = left[scarce] / use[scarce]
            if times > 1 and left[scarce] > 0.01 * need[scarce]:
                times *= step
            mix.append((use.astype(np.uint16), times))
            covered = covered + use * times
    return mix


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The mixtures of two step sizes, each rounded up to several shares of the volume; the plan of fewest sequences wins, of
    equals the one that takes most from the program."""
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), dtype=np.int64)
    need = np.array([histogram[n] for n in lengths], dtype=np.int64)
    if not len(lengths):
        return Plan((), 0, 0.0)
    best = None
    for m in MIXTURES:
        mix = _mixture(lengths, need, capacity, *m)
        for share in SHARES:
            plan = _rounded(lengths, need, capacity, mix, share)
            if best is None or (plan.sequences, -plan.by_program) < (best.sequences, -best.by_program):
                best = plan
        del mix  # before the next one is made: the driver holds one mixture at a time
    return best


def _rounded(lengths: np.ndarray, need: np.ndarray, capacity: int, mix: list[tuple[np.ndarray, float]], share: float) -> Plan:
    """Whole sequences of the mixture's full configurations, in its order, up to a share of the volume; the rest by best fit.

    What rounding down leaves of a configuration is carried on to its next use. A configuration that leaves room would
    waste it in each of its sequences; best fit uses that room better.
    """
    left, runs, rank, sequence, volume = need.copy(), [], np.zeros(len(lengths), dtype=np.int64), 0, int((lengths * need).sum())

    def add(use: np.ndarray, times: int) -> None:
        nonlocal sequence, left
        offset = 0
        for k in np.flatnonzero(use)[::-1]:
            runs.append((int(lengths[k]), int(rank[k]), int(use[k]), sequence, offset))
            rank[k] += use[k] * times
            offset += int(lengths[k] * use[k])
        sequence += times
        left = left - use * times

    carried: dict[bytes, float] = {}
    for narrow, times in mix:
        use = narrow.astype(np.int64)
        if (use * lengths).sum() != capacity:
            continue
        if sequence * capacity >= share * volume:
            break
        used = np.flatnonzero(use)
        key = np.concatenate([used, use[used]]).astype("<u2").tobytes()
        carried[key] = carried.get(key, 0.0) + times
        whole = min(int(carried[key] + 1e-9), int((left[used] // use[used]).min()))
        if whole > 0:
            carried[key] -= whole
            add(use, whole)
    by_program = sequence
    while left.any():  # fill the sequence with the exact best fit for its largest piece, as often as the counts allow
        top = int(np.flatnonzero(left)[-1])
        use, room = np.zeros(len(lengths), dtype=np.int64), capacity - int(lengths[top])
        use[top] = 1
        use = use + _fill(lengths, left - use, room)
        add(use, int((left[use > 0] // use[use > 0]).min()))
    return Plan(tuple(runs), sequence, volume / capacity, by_program)


def _fill(lengths: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """Best fit: the largest length that fits, again and again."""
    use = np.zeros(len(lengths), dtype=np.int64)
    k = int(np.searchsorted(lengths, room, side="right")) - 1
    while k >= 0 and room > 0:
        n = min(int(left[k]), room // int(lengths[k]))
        if n > 0:
            use[k] = n
            room -= n * int(lengths[k])
        k = min(k - 1, int(np.searchsorted(lengths, room, side="right")) - 1)
    return use


def pack(cut: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """pieces (stored, as they are read three times) with sequence_id and offset; block and rank are used up."""
    counts = cut.groupBy("block", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = solve(histogram, capacity)
    release()
    by_length: dict[int, list[tuple[int, ...]]] = {}
    for length, *run in plan.runs:
        by_length.setdefault(length, []).append(tuple(run))
    tables = {n: np.array(runs, dtype=np.int64) for n, runs in by_length.items()}

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        out = np.empty((len(n), 2), dtype=np.int64)
        for own in np.unique(n):
            at, runs = np.flatnonzero(n == own), tables[int(own)]
            k = np.searchsorted(runs[:, 0], r[at], side="right") - 1
            first, each, sequence, offset = runs[k].T
            out[at, 0] = sequence + (r[at] - first) // each
            out[at, 1] = offset + (r[at] - first) % each * own
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    found = cut.join(starts, ["block", "length"]).withColumn("_place", place("length", F.col("_before") + F.col("rank")))
    return found.withColumn("sequence_id", F.col("_place.sequence_id")).withColumn("offset", F.col("_place.offset")).drop("_place", "_before", "block", "rank")


def pack_documents(docs: DataFrame, *, vocabulary: str, capacity: int = CAPACITY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The packed sequences' pieces with their token ids."""
    return pack(stored(pieces(docs, vocabulary=vocabulary, capacity=capacity, keep=keep)), capacity=capacity)
