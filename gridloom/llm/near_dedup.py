"""MinHash near-duplicates with DartMinHash signatures, banded joining and exact verification.

A text's elements are its distinct five-word shingles, of weight 1 (or the number of their occurrences). Darts are thrown
at each element from its hash alone: a dart has a rank, a coordinate and a height, and hits where the height lies below the
element's weight. Per coordinate the hit of smallest rank is the signature, so two texts agree in a coordinate with the
probability of their (weighted) Jaccard similarity, and a text throws about k ln k + 2k darts however many elements it has.

Rows of bands meet in buckets. A bucket does not compare all with all: in turns, its members are compared with a few pivots,
which change from turn to turn, and linked texts become components. Turns go on while each at least halves the pairs of
different components that share buckets. Among the members of the buckets that still hold several components, the rest of
the links is found by prefix and positional filters over their shingles, rare ones first. These lose no pair at or above the
threshold, and a crowd of alike texts that are not alike enough gives them few candidates. Comparisons are exact, on the
sets of 64-bit shingle hashes. With 24 bands of 5 rows a pair at 0.8 is missed with probability 7e-5, one at 0.85 with 2e-6.

Texts of the same words are one class before anything else; a class is compared once, whatever its copies. Null texts,
empty texts and those without words are no near-duplicates, each row being a class of its own; texts of fewer than five
words have one shingle, all their words. Very long texts are hashed one at a time. Rows without doc_id are classes of their
own too, with a null class. Other columns, whatever their names, are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import release, small_batches, stored, unused
from gridloom.llm.components import connected
from gridloom.llm.wordhash import grams, mix, slices, word_keys, words

SHINGLE, BANDS, ROWS = 5, 24, 5
#: Pivots of a bucket in a turn.
PIVOTS = 6
#: How many counters order shingles by how many texts have them; sharing a counter costs time, not links.
COUNTERS = 1 << 18
#: Sizes within a bin differ by this factor at most.
BIN = 1.03
#: Below so many keys a table of keys is broadcast; above, joined by shuffling.
BROADCAST_KEYS = 1_000_000
_CDF = np.cumsum([np.exp(-1.0)] + [np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(1, 16)])


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """(text, hash, weight) of the distinct shingles, sorted, and the key of each text's words, None without any."""
    w = words(texts)
    n = np.diff(w.first)
    g = grams(w.hash, size)
    at = np.arange(len(w.hash))
    owner = np.repeat(np.arange(len(n)), n)
    whole = (at + size <= w.first[1:][owner]) if len(at) else np.zeros(0, dtype=bool)
    of, value = owner[whole], g[at[whole]] if len(g) else np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((n > 0) & (n < size))
    extra = np.array([grams(w.hash[w.first[k] : w.first[k + 1]], int(n[k]))[0] ^ np.uint64(n[k]) for k in short], dtype=np.uint64)
    of, value = np.concatenate([of, short]), np.concatenate([value, extra])
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    places = np.flatnonzero(new)
    weight = np.diff(np.append(places, len(of)))
    return of[places], value[places], weight, word_keys(w)


def _darts(element: np.ndarray, weight: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All darts that hit: (index of the element, coordinate, rank, dart's hash). limit: the rank up to which each is asked for.

    Blocks of unit height and of ranks [r, r + 1) hold a Poisson(1) number of darts, whose places come from the hash of
    element and block: the same element throws the same darts in every text.
    """
    ranks = np.maximum(1, np.ceil(limit)).astype(np.int64)
    blocks = ranks * weight
    index = np.repeat(np.arange(len(element)), blocks)
    within = np.arange(len(index)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    r, height = within % ranks[index], within // ranks[index]
    with np.errstate(over="ignore"):
        block = mix(element[index] + mix((r + (height << 32)).astype(np.uint64) + np.uint64(0x51ED2701)))
    count = np.searchsorted(_CDF, (block >> np.uint64(11)).astype(float) / 2.0**53, side="right")
    one = np.repeat(np.arange(len(index)), count)
    nth = np.arange(len(one)) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        dart = mix(block[one] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    rank = r[one] + (dart >> np.uint64(24)).astype(float) / 2.0**40
    own = index[one]
    hit = rank < limit[own]
    dart, rank, own = dart[hit], rank[hit], own[hit]
    return own, (mix(dart) % np.uint64(k)).astype(np.int64), rank, dart


def signatures(of: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
    """texts x k numbers; rows of texts without elements are all zero."""
    out, best = np.zeros((texts, k), dtype=np.uint64), np.full((texts, k), np.inf)
    total = np.bincount(of, weights=weight, minlength=texts)
    asked, open_ = np.full(texts, k * (np.log(k) + 2.0)), total > 0
    while open_.any():
        mine = np.flatnonzero(open_[of])
        own, coordinate, rank, dart = _darts(value[mine], weight[mine], (asked / np.maximum(total, 1))[of[mine]], k)
        flat = of[mine][own] * k + coordinate
        order = np.lexsort((rank, flat))
        flat, first = flat[order], np.ones(len(order), dtype=bool)
        first[1:] = flat[1:] != flat[:-1]
        at = flat[first]
        out.reshape(-1)[at], best.reshape(-1)[at] = dart[order][first], rank[order][first]
        # a coordinate without a dart asks its text for darts of higher ranks
        open_ &= ~np.isfinite(best).all(axis=1)
        asked[open_] *= 2
    return out


def _band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
        for row in np.moveaxis(signature.reshape(len(signature), bands, -1), 2, 0):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + row)
    return h.view(np.int64)


def _signed(docs: DataFrame, bands: int, rows: int, weighted: bool) -> DataFrame:
    """(doc_id, key, size, buckets): key is null without words; size counts distinct shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts = whole.column("text").to_pylist()
            for a, z in slices(texts, 200_000):
                of, value, weight, keys = shingles(texts[a:z])
                sig = signatures(of, value, weight if weighted else np.ones_like(weight), z - a, bands * rows)
                sizes = np.bincount(of, minlength=z - a).astype(np.int32)
                lists = [h if n else [] for h, n in zip(_band_hashes(sig, bands), sizes, strict=True)]
                columns = [whole.column("doc_id").slice(a, z - a), pa.array(keys, pa.binary()), pa.array(sizes), pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "size", "buckets"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, key binary, size int, buckets array<long>")


def _keyed_sets():
    """Of a text, the key of its words and its sorted shingle hashes, eight bytes each.

    Both functions here are marked as not deterministic: a filter on their result would else be pushed below them, and they
    would be computed a second time, by a second Python worker.
    """

    @F.pandas_udf("struct<key: binary, set: binary>")
    def of(texts: pd.Series) -> pd.DataFrame:
        values, keys, sets = texts.tolist(), [], []
        for a, z in slices(values, 400_000):
            owner, value, _, own = shingles(values[a:z])
            keys += own
            sets += [part.tobytes() for part in np.split(value.astype("<u8"), np.searchsorted(owner, np.arange(1, z - a)))]
        release()
        return pd.DataFrame({"key": pd.Series(keys, dtype=object), "set": pd.Series(sets, dtype=object)})

    return of.asNondeterministic()


def _keys():
    """The key of a text's words, as of near_duplicates."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        values, out = texts.tolist(), []
        for a, z in slices(values, 400_000):
            out += word_keys(words(values[a:z]))
        release()
        return pd.Series(out, dtype=object)

    return of.asNondeterministic()


def _similar(threshold: float):
    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), dtype=bool)
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
            if min(len(x), len(y)) >= threshold * max(len(x), len(y)) - 1e-9:
                both = np.sort(np.concatenate([x, y]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                out[k] = same >= threshold * (len(both) - same) - 1e-9
        return pd.Series(out)

    return similar


def _near(table: DataFrame, rows: int) -> DataFrame:
    """table, marked for broadcasting if its counted rows are few."""
    return F.broadcast(table) if rows <= BROADCAST_KEYS else table


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """(doc_id, class_id, class_size) a row of docs; class_id is the smallest doc_id that links of at least threshold lead to.

    weighted: signatures by shingle counts, which find candidates by weighted similarity; verification compares sets.
    """
    return _classed(docs, threshold=threshold, bands=bands, rows=rows, weighted=weighted).select("doc_id", "class_id", "class_size")


def _classed(docs: DataFrame, *, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """near_duplicates with the key of each row's words and the class itself, part: ids may stand in several classes."""
    small_batches(docs.sparkSession)
    signed = stored(_signed(docs, bands, rows, weighted))
    usable = signed.where("key is not null and doc_id is not null")
    classes = usable.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("size").alias("size"), F.min("buckets").alias("buckets"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()))
    members = classes.select("cid", "size", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low <> high").select("bucket")
    # the members of buckets of two or more: all that later steps need of the bands
    met = stored(members.join(shared, "bucket").select("bucket", "cid", "size"))
    involved = stored(met.select("cid").distinct().join(classes.select("cid", "key", "first"), "cid"))
    sets = stored(_shingle_sets(docs, involved))
    open_, tested, links, parts, before, turn, last = met.withColumn("part", F.col("cid")), None, None, None, None, 0, False
    while not last:
        # how many pairs of different components still share buckets
        sizes = open_.groupBy("bucket", "part").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
        crossed = sizes.agg(F.coalesce(F.sum((F.col("s").cast("double") * F.col("s") - F.col("q")) / 2), F.lit(0.0))).first()[0]
        if not crossed:
            break
        last = before is not None and crossed > before / 2
        fresh = _ordered(_prefix_pairs(open_, sets, threshold) if last else _pivot_pairs(open_, turn, threshold)).distinct()
        fresh = stored(fresh if tested is None else fresh.join(tested, ["a", "b"], "left_anti"))
        tested = fresh if tested is None else tested.unionByName(fresh)
        more = stored(_verified(fresh, sets, threshold))
        links = more if links is None else links.unionByName(more)
        parts = connected(links)
        before, turn = crossed, turn + 1
        if not last:
            joined = met.join(parts.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", "size", F.coalesce("component", "cid").alias("part"))
            split = joined.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("bucket")
            open_ = stored(joined.join(split, "bucket"))
    if parts is None:
        parts = met.select(F.col("cid").alias("node"), F.col("cid").alias("component")).limit(0)
    own = classes.select("key", "cid", "first", "copies").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("part", F.coalesce("component", "cid"))
    linked = own.where("component is not null").groupBy("part").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    found = own.join(linked, "part", "left").select("key", "part", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("class_size", "copies").alias("class_size"))
    met_ids = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(found, "key", "left")
    return met_ids.select("doc_id", "key", "part", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def _pivot_pairs(open_: DataFrame, turn: int, threshold: float) -> DataFrame:
    """Each member with some others of its bucket, which change from turn to turn, if their components differ and their
    sizes are not too far apart to be alike."""
    picks = []
    for k in range(PIVOTS // 2):
        ranked = F.struct(F.xxhash64("cid", F.lit(turn * PIVOTS + k)).alias("h"), F.col("cid"), F.col("part"), F.col("size"))
        picks += [F.min(ranked).alias(f"p{2 * k}"), F.max(ranked).alias(f"p{2 * k + 1}")]
    pivots = open_.groupBy("bucket").agg(*picks).select("bucket", F.array_distinct(F.array(*[f"p{k}" for k in range(len(picks))])).alias("ps"))
    near = lambda p: (p["part"] != F.col("part")) & (F.least(p["size"], "size") >= F.greatest(p["size"], "size") * threshold - 1e-9)
    met = open_.join(pivots, "bucket").select("cid", F.explode(F.filter("ps", near)).alias("p"))
    return met.select("cid", F.col("p.cid").alias("other"))


def _prefix_pairs(open_: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs of members of different components that may reach the threshold.

    Shingles are put in one order for all texts, those of few texts first. Two sets as alike as the threshold share a
    shingle among their first ones: among the first |y| - ceil(t |y|) + 1 of the larger, and the first
    |x| - ceil(2t / (1 + t) |x|) + 1 of the smaller; and where they first share one, what follows must suffice for the
    overlap that their sizes ask for. On a shingle, members of its commonest component meet only those of others, which
    look for partners in the bins of sizes that their place in the order allows.
    """
    t = threshold
    who = open_.select("cid", "part").distinct()
    found = sets.join(_near(who, who.count()), "cid")
    seen = _counts(found)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
            tokens, rows, places = [], [], []
            sizes = np.zeros(whole.num_rows, dtype=np.int32)
            for row, raw in enumerate(whole.column("set").to_pylist()):
                own = np.frombuffer(raw, dtype="<u8")
                sizes[row] = len(own)
                lead = own[np.lexsort((own, seen[own % np.uint64(COUNTERS)]))][: len(own) - int(np.ceil(t * len(own) - 1e-9)) + 1]
                tokens.append(lead), rows.append(np.full(len(lead), row)), places.append(np.arange(len(lead), dtype=np.int32))
            at = np.concatenate(rows)
            of = pa.array(at)
            columns = [pa.array(np.concatenate(tokens).view(np.int64)), whole.column("cid").take(of), whole.column("part").take(of), pa.array(sizes[at]), pa.array(np.concatenate(places))]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "cid", "part", "size", "at"])
        release()

    leads = stored(found.select("cid", "part", "set").mapInArrow(first, "token long, cid long, part long, size int, at int"))
    common = leads.groupBy("token", "part").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("part", F.struct("n", "part")).alias("major"), F.count("*").alias("several")).where("several > 1")
    met = stored(leads.join(common.drop("several"), "token").withColumn("early", F.expr(f"at < size - ceil({2 * t / (1 + t)!r}D * size - 1e-9D) + 1")))
    size_bin = lambda n: F.floor(F.log(n) / float(np.log(BIN))).cast("int")
    most = F.floor((F.col("size") - F.col("at")) * ((1 + t) / t) - F.col("size") + 1e-9)
    smaller = F.struct(F.lit(False).alias("larger"), F.ceil(F.col("size") * t - 1e-9).alias("low"), F.least("size", most).alias("high"))
    larger = F.struct(F.lit(True).alias("larger"), F.col("size").cast("long").alias("low"), F.least(F.floor(F.col("size") / t + 1e-9), most).alias("high"))
    few = met.where("part <> major").withColumn("p", F.explode(F.array(smaller, larger))).where("p.low <= p.high and (early or not p.larger)")
    few = few.select("token", "cid", "part", "size", "at", "p.larger", F.explode(F.sequence(size_bin(F.col("p.low")), size_bin(F.col("p.high")))).alias("bin")).alias("f")
    # a partner that is to be the smaller one has the shingle among its fewer first ones
    many = met.withColumn("larger", F.explode(F.array(F.lit(True), F.lit(False)))).where("larger or early").withColumn("bin", size_bin(F.col("size"))).alias("m")
    c = F.col
    ordered = F.when(c("f.larger"), c("m.size") >= c("f.size")).otherwise(c("m.size") <= c("f.size"))
    suffices = F.least(c("f.size") - c("f.at"), c("m.size") - c("m.at")) >= (c("f.size") + c("m.size")) * (t / (1 + t)) - 1e-9
    on = [c(f"f.{k}") == c(f"m.{k}") for k in ("token", "larger", "bin")]
    return few.join(many, [*on, c("f.part") != c("m.part"), ordered, suffices]).select(c("f.cid").alias("cid"), c("m.cid").alias("other"))


def _counts(found: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall on each of the counters: a table of fixed size, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, dtype=np.int64)
        for b in batches:
            for raw in b.column("set").to_pylist():
                np.add.at(seen, np.frombuffer(raw, dtype="<u8") % np.uint64(COUNTERS), 1)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], names=["counter", "n"])

    sums = found.select("set").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[sums["counter"].to_numpy()] = sums["n"].to_numpy()
    return out


def _ordered(pairs: DataFrame) -> DataFrame:
    low: Column = F.least("cid", "other")
    return pairs.select(low.alias("a"), F.greatest("cid", "other").alias("b"))


def _shingle_sets(docs: DataFrame, involved: DataFrame) -> DataFrame:
    """(cid, set) of the classes that share buckets, from one of each class's texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("first"), "text").where("text is not null")
    # an id that rows of different texts share names several classes; the digest of the words tells them apart
    ids = involved.select("first").distinct()
    found = texts.join(_near(ids, ids.count()), "first")
    keyed = found.select(_keyed_sets()("text").alias("s")).select("s.key", "s.set")
    return keyed.where("key is not null").groupBy("key").agg(F.first("set").alias("set")).join(involved.select("key", "cid"), "key").select("cid", "set")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    one = pairs.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("x")), "a")
    both = one.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("y")), "b")
    return both.where(_similar(threshold)("x", "y")).select("a", "b")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class, all columns kept: the one of smallest doc_id, of several such rows one.

    Rows are told apart by their doc_id and words, so of an id with two texts each goes or stays by its own class. Rows
    without doc_id are in classes too and stay only where no row with one is. Rows without words stay.
    """
    # an id for those without, above all usual ones; should one be met, the words still tell the rows apart
    made = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(2**62)
    t = unused(docs.columns)
    id_, key = f"{t}id", f"{t}key"
    own = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), made))
    classed = _classed(own.select(F.col(id_).alias("doc_id"), "text"), **options).where("key is not null")
    rows = stored(classed.groupBy("doc_id", "key").agg(F.first("part").alias("part"), F.count("*").alias("n")))
    best = rows.groupBy("part").agg(F.min(F.struct("doc_id", "key")).alias("best"), F.sum("n").alias("all")).where("all > 1").select("part", "best")
    met = stored(rows.join(best, "part").withColumn("stays", F.col("best") == F.struct("doc_id", "key")).where("not stays or n > 1").select(F.col("doc_id").alias(id_), F.col("key").alias(key), "stays"))
    gone, again = met.drop("stays"), met.where("stays").drop("stays")
    left = own.withColumn(key, _keys()("text")).join(_near(gone, gone.count()), [id_, key], "left_anti").select(docs.columns)
    ids, many = again.select(id_).distinct(), again.count()
    copies = own.join(_near(ids, many), id_, "left_semi").withColumn(key, _keys()("text")).join(_near(again, many), [id_, key], "left_semi")
    row = F.struct(*docs.columns)
    one = copies.groupBy(id_, key).agg(F.min_by(row, F.to_json(row)).alias("r")).select("r.*")
    return left.unionByName(one)
