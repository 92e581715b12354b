"""Exact substring dedup: windows of words that start anywhere else too, found with an FM-index per shard.

Candidates. In each window, the run of `anchor` words with the smallest hash (the leftmost of equals) is the window's
anchor. Equal windows have equal anchors at equal places, so a window whose anchor occurs nowhere else is unique. A pass
over the texts emits anchors, a count finds the repeated ones, and a table of them by text leads the second pass.

Pieces. Consecutive windows of a text with the same anchor are one piece, routed by the anchor's hash: windows that are
equal always meet on one route, and each window lies in exactly one piece. Equal pieces are counted before they move.

Index. A shard is some routes' distinct pieces; their FM-index (a wavelet matrix over the Burrows-Wheeler transform) is
searched backwards for the streamed pieces, and windows whose interval holds two or more places are repeated. Pieces that
occur more than once need no search. A route with more pieces than a shard may hold is split: its pieces are cut in two by
the anchor's place in the window, and as windows of either half share more words than the anchor, those words make new
routes. Splitting goes on until every route fits, at the latest when a route is a single window; all are searched alike.

Cover. Repeated windows come back to their texts as runs, each an interval of words to remove. Texts of the same words are one class
and take part once, with their number.

Words are compared by 64-bit hashes when anchors are chosen and by 48 of their bits inside a route.

Null and empty texts have no words and nothing to remove; texts shorter than a window keep all their words. Rows without
doc_id count like others, as do repeated rows. An empty table gives an empty result. The texts that come out have their
kept words joined by one space. Extra columns stay, and an input column named like an output column is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import release, small_batches, stored, text_key, unused
from gridloom.llm.fm_index import FMIndex
from gridloom.llm.wordhash import grams, mix, slices, word_keys, Words, words

WINDOW, ANCHOR = 35, 20
#: A shard's distinct pieces, and those of one route, at most.
SHARD_PIECES, ROUTE_PIECES = 6_000, 4_000
#: Bytes of a word's hash inside a piece.
WIDE = 6
#: Tables by text are broadcast up to so many rows and array entries; above, joined by shuffling.
BROADCAST_ROWS, BROADCAST_ENTRIES = 500_000, 4_000_000


def _pieces(w: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first window's place among all words, windows, anchor's hash, anchor's place) of the pieces of all texts in w."""
    empty = np.zeros(0, dtype=np.int64)
    if len(w.hash) < window:
        return empty, empty, empty, empty.view(np.uint64), empty
    g = grams(w.hash, anchor)
    lead = np.lib.stride_tricks.sliding_window_view(g, window - anchor + 1).argmin(axis=1) + np.arange(len(g) - (window - anchor))
    at = np.arange(len(lead))
    owner = np.searchsorted(w.first, at, side="right") - 1
    inside = at + window <= w.first[1:][owner]
    at, lead, owner = at[inside], lead[inside], owner[inside]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (lead[1:] != lead[:-1]) | (owner[1:] != owner[:-1])
    places = np.flatnonzero(new)
    return owner[places], at[places], np.diff(np.append(places, len(at))), g[lead[places]], lead[places]


def _by_text(docs: DataFrame, table: DataFrame, entries: str) -> DataFrame:
    """table, marked for broadcasting if its rows and its arrays' entries are few."""
    n, m = table.agg(F.count("*"), F.coalesce(F.sum(F.size(entries)), F.lit(0))).first()
    return F.broadcast(table) if n <= BROADCAST_ROWS and m <= BROADCAST_ENTRIES else table


def _anchored(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, raw, key, anchors) of texts with a window at least: raw stands for the whole text, key for its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts = whole.column("text").to_pylist()
            for a, z in slices(texts, 400_000):
                w = words(texts[a:z])
                owner, _, _, route, _ = _pieces(w, window, anchor)
                route = route.view(np.int64)
                cut = np.searchsorted(owner, np.arange(z - a + 1))
                lists = [route[p:q] for p, q in zip(cut[:-1], cut[1:], strict=True)]
                own = [whole.column(c).slice(a, z - a) for c in ("doc_id", "raw")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(word_keys(w), pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "raw", "key", "anchors"])
        release()

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("raw"), "text")
    return rows.mapInArrow(run, "doc_id long, raw binary, key binary, anchors array<long>").where("size(anchors) > 0")


def _emit(rows: DataFrame, window: int, anchor: int, bodies: bool) -> DataFrame:
    """Pieces on repeated anchors of rows(key, text, hot): with bodies, (pid, route, body, windows, lead, copies); else (key, pid, first).

    lead is the anchor's place in the piece.
    """
    names = ["pid", "route", "body", "windows", "lead", "copies"] if bodies else ["key", "pid", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts, hot = whole.column("text").to_pylist(), whole.column("hot")
            for a, z in slices(texts, 400_000):
                w = words(texts[a:z])
                owner, at, count, route, lead = _pieces(w, window, anchor)
                flat = hot.slice(a, z - a)
                wanted = np.repeat(np.arange(z - a, dtype=np.uint64), np.asarray(flat.value_lengths().fill_null(0)))
                with np.errstate(over="ignore"):
                    pair = lambda o, r: mix(r.view(np.uint64) + mix(o.astype(np.uint64)))
                    keep = np.isin(pair(owner, route), pair(wanted, flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
                owner, at, count, route, lead = owner[keep], at[keep], count[keep], route[keep], lead[keep]
                raw = np.ascontiguousarray(w.hash.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDE :]).tobytes()
                spans = [raw[WIDE * p : WIDE * (p + n + window - 1)] for p, n in zip(at.tolist(), count.tolist(), strict=True)]
                pid = pa.array([hashlib.blake2b(s, digest_size=12, key=r.tobytes()).digest() for s, r in zip(spans, route, strict=True)], pa.binary())
                of = pa.array(owner, pa.int64())
                if bodies:
                    copies = whole.column("copies").slice(a, z - a).take(of)
                    yield pa.RecordBatch.from_arrays([pid, pa.array(route.view(np.int64)), pa.array(spans, pa.binary()), pa.array(count.astype(np.int32)), pa.array((lead - at).astype(np.int32)), copies], names=names)
                else:
                    yield pa.RecordBatch.from_arrays([whole.column("key").slice(a, z - a).take(of), pid, pa.array((at - w.first[owner]).astype(np.int32))], names=names)
        release()

    if bodies:
        return rows.select("text", "hot", "copies").mapInArrow(run, "pid binary, route long, body binary, windows int, lead int, copies long")
    return rows.select("key", "text", "hot").mapInArrow(run, "key binary, pid binary, first int")


def _searcher(window: int):
    def search(shard: pa.Table) -> pa.Table:
        """The repeated windows of a shard's pieces that occur once, as bits."""
        bodies = shard["body"].to_pylist()
        sizes = np.array([len(b) // WIDE for b in bodies], dtype=np.int64)
        raw = np.frombuffer(b"".join(bodies), dtype=np.uint8).reshape(-1, WIDE)
        flat = np.zeros((len(raw), 8), dtype=np.uint8)
        flat[:, :WIDE] = raw
        _, symbol = np.unique(flat.view("<u8").ravel(), return_inverse=True)
        # a separator after each piece
        ends = np.cumsum(sizes)
        text = np.insert(symbol + 1, ends, 0)
        first = ends - sizes + np.arange(len(sizes))
        alone = np.flatnonzero(shard["n"].to_numpy() == 1)
        piece, k = FMIndex(text, window).repeated(text, first[alone], shard["windows"].to_numpy()[alone].astype(np.int64), window)
        bits = np.zeros(len(alone), dtype=np.int64)
        np.bitwise_or.at(bits, piece, np.int64(1) << k)
        some = np.flatnonzero(bits)
        release()
        return pa.table({"pid": shard["pid"].take(pa.array(alone[some])).combine_chunks(), "bits": pa.array(bits[some])}, schema=pa.schema([("pid", pa.binary()), ("bits", pa.int64())]))

    return search


def _halves(crowded: DataFrame, window: int, anchor: int) -> DataFrame:
    """(pid, base, part, route, body, windows, lead, low, high, n): pieces cut in two by the anchor's place in a window.

    The places of crowded's pieces lie from low to high. Windows with the anchor at or behind a place have that many words
    before it in common where they are equal, and likewise after it. base is a part's first window in its piece.
    """
    names = ["pid", "base", "part", "route", "body", "windows", "lead", "low", "high", "n"]
    kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    spare = window - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            out = []
            for pid, route, body, windows, lead, low, high, n in zip(*(whole.column(c).to_pylist() for c in ("pid", "route", "body", "windows", "lead", "low", "high", "n")), strict=True):
                middle = (low + high) // 2
                cut = min(max(lead - middle, 0), windows)
                for first, last, a, z in ((0, cut, middle + 1, high), (cut, windows, low, middle)):
                    if first == last:
                        continue
                    shared = body[WIDE * (lead - a) : WIDE * (lead + anchor + spare - z)]
                    own = hashlib.blake2b(shared, digest_size=8, key=route.to_bytes(8, "little", signed=True), person=bytes([a, z])).digest()
                    text = body[WIDE * first : WIDE * (last - 1 + window)]
                    part = hashlib.blake2b(text, digest_size=12, key=own).digest()
                    out.append((pid, first, part, int.from_bytes(own, "little", signed=True), text, last - first, lead - first, a, z, n))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)
        release()

    schema = "pid binary, base int, part binary, route long, body binary, windows int, lead int, low int, high int, n long"
    return crowded.select("pid", "route", "body", "windows", "lead", "low", "high", "n").mapInArrow(run, schema)


def _repeated(pieces: DataFrame, window: int, anchor: int, most: int) -> DataFrame:
    """(pid, bits): which windows of stored pieces(pid, route, body, windows, lead, low, high, n) start at two places or more.

    Routes of more than `most` pieces are split and their parts' bits come back to the pieces, shifted to their base.
    """
    everything = F.expr("shiftleft(1L, windows) - 1")
    by_route = pieces.groupBy("route").agg(F.count("*").alias("m"), F.min("low").alias("low"), F.max("high").alias("high"))
    crowded = stored(by_route.where((F.col("m") > most) & (F.col("low") < F.col("high"))).select("route"))
    total, many = pieces.count(), crowded.count()
    marked = F.broadcast(crowded) if many <= BROADCAST_ROWS else crowded
    narrow = pieces.join(marked, "route", "left_anti") if many else pieces
    shard = F.pmod(F.xxhash64("route"), F.lit(max(1, -(-total // SHARD_PIECES)))).alias("shard")
    found = narrow.select(shard, "pid", "body", "windows", "n").groupBy("shard").applyInArrow(_searcher(window), "pid binary, bits long")
    found = found.unionByName(pieces.where("n > 1").select("pid", everything.alias("bits")))
    if many:
        parts = stored(_halves(pieces.join(marked, "route"), window, anchor))
        deeper = parts.groupBy(F.col("part").alias("pid"), "route", "body", "windows").agg(F.min("lead").alias("lead"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        back = _repeated(stored(deeper), window, anchor, most).withColumnRenamed("pid", "part")
        found = found.unionByName(parts.select("part", "pid", "base").join(back, "part").select("pid", F.expr("shiftleft(bits, base)").alias("bits")))
    return stored(found.groupBy("pid").agg(F.bit_or("bits").alias("bits")))


def repeated_windows(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(raw, runs): by the key of a whole text, the runs of its windows that start anywhere else too.

    Runs are (first window's place, windows) one after another, sorted: a passage is two numbers, however long it is.

    A piece has at most window - anchor + 1 windows, so its windows' bits fit a long while that is below 63.
    """
    if not 0 < window - anchor < 62:
        raise ValueError("an anchor is shorter than a window, by 61 words at most")
    # texts of the same words first, by their whole texts: a class's row is that of its smallest text and that one's smallest id
    texts = stored(_anchored(docs, window, anchor))
    # a row without an id stands for its class only where no row of the smallest text has one
    ranked = F.struct("raw", F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("first"))
    classes = texts.groupBy("key").agg(F.min(ranked).alias("row"), F.count("*").alias("copies"), F.first("anchors").alias("anchors"))
    classes = stored(classes.select("key", "row.raw", "row.first", "copies", "anchors").withColumn("cid", F.monotonically_increasing_id()))
    placed = classes.select("cid", "copies", F.explode("anchors").alias("route"))
    repeated = placed.groupBy("route").agg(F.sum("copies").alias("n")).where("n > 1").select("route")
    repeated = stored(repeated)
    few = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    hot = placed.select("cid", "route").join(few, "route").groupBy("cid").agg(F.collect_set("route").alias("hot"))
    leads = stored(classes.select("cid", "raw", "key", "first", "copies").join(hot, "cid").drop("cid"))
    near = _by_text(docs, leads, "hot")
    lead = near.withColumnRenamed("raw", "lead")
    keyed = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("_doc"), "text", text_key(F.col("text")).alias("raw"))
    # a class's text once: from the rows of its smallest id; rows that repeat it whole count more, but are repeated anyway
    rows = keyed.join(lead, F.col("raw").eqNullSafe(F.col("lead")) & F.col("_doc").eqNullSafe(F.col("first")))
    if near is leads:  # joined by shuffling all texts: once, as both passes below read the few that are left
        rows = stored(rows.select("key", "text", "hot", "copies"))
    found = _emit(rows, window, anchor, True)
    per_class = found.groupBy("pid", "route", "body", "windows").agg(F.min("lead").alias("lead"), F.sum("copies").alias("n"))
    pieces = stored(per_class.withColumns({"low": F.lit(0), "high": F.lit(window - anchor)}))
    masks = _repeated(pieces, window, anchor, ROUTE_PIECES)
    occurs = _emit(rows, window, anchor, False).dropDuplicates()
    marked = occurs.join(masks, "pid").where("bits <> 0").groupBy("key").agg(F.flatten(F.collect_list(F.array(F.col("first").cast("long"), "bits"))).alias("marks"))
    runs = marked.select("key", F.pandas_udf(_runs, "array<int>")("marks").alias("runs"))
    return texts.select("raw", "key").distinct().join(runs, "key").select("raw", "runs")


def _runs(marks: pd.Series) -> pd.Series:
    """The runs of marks: (a piece's first window, the bits of its repeated windows) one after another, in any order."""
    out = []
    for flat in marks:
        first, bits = np.asarray(flat, dtype=np.int64).reshape(-1, 2).T
        at = np.unique(np.concatenate([first[piece] + k for k in range(62) for piece in [np.flatnonzero(bits >> k & 1)]]))
        new = np.flatnonzero(np.diff(at, prepend=at[0] - 2) > 1)
        out.append(np.column_stack([at[new], np.diff(np.append(new, len(at)))]).ravel().astype(np.int32))
    return pd.Series(out, dtype=object)


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs with text reduced to the kept words, and n_words, n_removed."""
    small_batches(docs.sparkSession)
    runs = stored(repeated_windows(docs, window=window, anchor=anchor))

    @F.pandas_udf("struct<text: string, n_words: long, n_removed: long>")
    def kept(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, runs, strict=True):
            found = text.encode("utf-8", "surrogatepass").split() if text else []
            n = len(found)
            if own is not None and len(own):
                at, windows = np.asarray(own, dtype=np.int64).reshape(-1, 2).T
                edge = np.zeros(n + 1, dtype=np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + windows - 1 + window, -1)
                keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                found = [found[k] for k in keep]
            out.append((b" ".join(found).decode("utf-8", "surrogatepass"), n, n - len(found)))
        release()
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed"])

    t = unused(docs.columns)
    keyed = docs.withColumn(f"{t}key", text_key(F.col("text")))
    met = keyed.join(_by_text(docs, runs, "runs").withColumnsRenamed({"raw": f"{t}key2", "runs": f"{t}runs"}), F.col(f"{t}key") == F.col(f"{t}key2"), "left")
    done = met.withColumn(f"{t}kept", kept("text", f"{t}runs"))
    return done.withColumns({c: F.col(f"{t}kept.{c}") for c in ("text", "n_words", "n_removed")}).drop(*[f"{t}{c}" for c in ("key", "key2", "runs", "kept")])
