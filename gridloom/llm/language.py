"""Language identification by Bayesian fusion of evidence.

A text's likelihood under each language comes from byte trigrams. To it are added what the markup declares, weighed by how
often declarations agree with the texts, and a prior for the host, which is smoothed towards its address suffix's, which is
smoothed towards the whole table's. Declarations and priors are counts over all rows by grouped aggregation; only the
trigram model is fitted on a bounded sample of labelled texts: of every language of the table at most `per_language`
distinct whole texts, smallest id hash first. They are counted where they lie; only the counts reach the driver.

Letters are those of any script; marks, digits, dashes and pictures are none. A text without letters has no evidence of its own: its language is null and its confidence 0. Null hosts, suffixes and
declarations are no evidence. Texts of any length are read whole, a long one alone. Ties go to the alphabetically first language. Rows repeat as they are given; extra columns
stay, and an input column named like an output column is replaced. Without labelled texts every language is null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import release, small_batches, stored, unused
from gridloom.llm.wordhash import slices

BITS = 16
#: In so many parts a language's sample is looked for.
PARTS = 64
#: How many trigrams of a text count as one independent observation.
TEMPER = 6.0
#: Below so many host rows the prior table is broadcast; above, joined by shuffling.
BROADCAST_ROWS = 50_000
#: What is no letter in any script.
_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class TrigramModel:
    """log-probabilities by trigram hash, for each language: the hashes its texts have, theirs, and that of all others."""

    languages: tuple[str, ...]
    codes: tuple[bytes, ...]
    logs: tuple[bytes, ...]
    floors: tuple[float, ...]

    def tables(self) -> Iterator[np.ndarray]:
        """Each language's whole table, one at a time; the next overwrites it."""
        row = np.empty(1 << BITS, dtype=np.float32)
        for codes, logs, floor in zip(self.codes, self.logs, self.floors, strict=True):
            row[:] = floor
            row[np.frombuffer(codes, dtype=np.uint16)] = np.frombuffer(logs, dtype=np.float32)
            yield row


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram hashes of all texts in a row, each text's first place, and its number of letters' bytes."""
    raw = [(" " + _OTHER.sub(" ", t.lower())).encode("utf-8", "replace") if t else b"" for t in texts]
    b = np.frombuffer(b"\0\0".join([*raw, b""]), dtype=np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(r) + 2 for r in raw), dtype=np.int64, count=len(raw))
    starts = np.cumsum(sizes) - sizes
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    letters = np.add.reduceat((b > 32).astype(np.int64), starts) if len(raw) else np.zeros(0, dtype=np.int64)
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), starts, letters


def fit(docs: DataFrame, *, per_language: int = 400) -> TrigramModel:
    """From the texts with a known `lang`, all of its values; at most per_language distinct whole texts of each."""
    small_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null and length(text) > 0").select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("t"), "text")
    # the first of each part of a language, then of these, whose number is bounded, the first of all
    part = F.pmod("h", F.lit(PARTS))
    first = known.select("lang", "h", "doc_id", "t", F.row_number().over(Window.partitionBy("lang", part).orderBy("h", "doc_id", "t")).alias("k")).where(F.col("k") <= per_language)
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "t")
    picked = first.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("lang", "h", "t").distinct()
    texts = known.join(F.broadcast(picked), ["lang", "h", "t"]).groupBy("lang", "h", "t").agg(F.first("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            names, values = whole.column("lang").to_pylist(), whole.column("text").to_pylist()
            for a, z in slices(values, 1_000_000):
                for name in sorted(set(names[a:z])):
                    code, n = np.unique(_trigrams([t for t, own in zip(values[a:z], names[a:z], strict=True) if own == name])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(code)), pa.array(code.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    found = texts.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    names, codes, logs, floors = [], [], [], []
    for name, own in found.sort_values(["lang", "code"]).groupby("lang"):
        total = own["n"].sum() + 0.05 * (1 << BITS)
        names.append(name)
        codes.append(own["code"].to_numpy(np.uint16).tobytes())
        logs.append(np.log((own["n"].to_numpy() + 0.05) / total).astype(np.float32).tobytes())
        floors.append(float(np.log(0.05 / total)))
    return TrigramModel(tuple(names), tuple(codes), tuple(logs), tuple(floors))


def likelihoods(model: TrigramModel, text: Column) -> Column:
    """An array of tempered log-likelihoods, a language each; null for texts without letters."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        values, out = texts.tolist(), []
        for a, z in slices(values, 1_000_000):
            code, starts, letters = _trigrams(values[a:z])
            if not len(code):
                out += [None] * (z - a)
                continue
            starts = np.minimum(starts, len(code) - 1)
            ll = np.stack([np.add.reduceat(row[code], starts, dtype=np.float64) for row in model.tables()], axis=1) / TEMPER
            out += [x if n else None for x, n in zip(ll, letters, strict=True)]
        release()
        return pd.Series(out, dtype=object)

    # else a filter on the result would be pushed below it and compute it a second time
    return of.asNondeterministic()(text)


def identify(rows: DataFrame, model: TrigramModel, *, text: Column, declared: Column, host: Column, suffix: Column, drop: tuple[str, ...] = ()) -> DataFrame:
    """rows without the columns `drop`, with language, confidence (its posterior) and text_language (by the text alone).

    The rows are read twice: once for the counts, once for the result.
    """
    small_batches(rows.sparkSession)
    names = list(model.languages)
    if not names:
        return rows.drop(*drop).withColumns({"language": F.lit(None).cast("string"), "confidence": F.lit(0.0), "text_language": F.lit(None).cast("string")})
    t = unused(rows.columns)
    lang = F.array(*map(F.lit, names))
    best = lambda x: F.element_at(lang, F.array_position(x, F.array_max(x)).cast("int"))
    base = rows.withColumns({f"{t}ll": likelihoods(model, text), f"{t}said": F.lower(F.regexp_extract(F.trim(declared), "^[A-Za-z]{2,8}(?=[-_]|$)", 0)), f"{t}host": host, f"{t}suffix": suffix}).drop(*drop)
    base = base.withColumn("text_language", F.when(F.col(f"{t}ll").isNotNull(), best(F.col(f"{t}ll"))))

    tally = [F.count_if(F.col("text_language") == n).alias(f"n{k}") for k, n in enumerate(names)]
    slim = base.select(f"{t}said", f"{t}host", f"{t}suffix", "text_language").where("text_language is not null")
    counts = stored(slim.groupBy(f"{t}said", f"{t}host", f"{t}suffix").agg(*tally))
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(len(names))]
    array = F.array(*[F.col(f"n{k}").cast("double") for k in range(len(names))]).alias("n")
    total = counts.agg(*sums).select(array).first().n
    total = [x or 0.0 for x in total]
    share = [(x + 1) / (sum(total) + len(names)) for x in total]

    def smoothed(n: Column, parent: Column, strength: float) -> Column:
        every = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, parent, lambda x, p: (x + strength * p) / (every + strength))

    top = F.array(*map(F.lit, share))
    by_suffix = counts.groupBy(f"{t}suffix").agg(*sums).select(f"{t}suffix", smoothed(array, top, 20.0).alias(f"{t}p"))
    by_host = counts.groupBy(f"{t}host", f"{t}suffix").agg(*sums).select(f"{t}host", f"{t}suffix", array)
    # hosts that stand in no row of their own suffix fall back to the suffix, and suffixes to the whole
    known = by_host.join(by_suffix, by_host[f"{t}suffix"].eqNullSafe(by_suffix[f"{t}suffix"]), "left").select(
        f"{t}host", by_host[f"{t}suffix"], smoothed(F.col("n"), F.coalesce(f"{t}p", top), 10.0).alias(f"{t}prior")
    )
    known = stored(known)
    said = {r[f"{t}said"]: [r[f"n{k}"] for k in range(len(names))] for r in counts.where(F.col(f"{t}said").isin(names)).groupBy(f"{t}said").agg(*sums).collect()}
    # P(declared | language): counts, smoothed towards declarations that are right nine times in ten
    told = {d: [float(np.log(((said.get(d) or [0] * len(names))[k] + 5 * (0.9 if n == d else 0.1 / max(1, len(names) - 1))) / (total[k] + 5))) for k, n in enumerate(names)] for d in names}
    zero = F.array(*[F.lit(0.0)] * len(names))
    # one constant, however many languages there are
    says = F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(told)), "map<string,array<double>>"), F.col(f"{t}said")), zero)

    small = known.count() <= BROADCAST_ROWS
    other = (F.broadcast(known) if small else known).withColumnsRenamed({f"{t}host": f"{t}h", f"{t}suffix": f"{t}s"})
    met = base.join(other, F.col(f"{t}host").eqNullSafe(F.col(f"{t}h")) & F.col(f"{t}suffix").eqNullSafe(F.col(f"{t}s")), "left")
    prior = F.transform(F.coalesce(f"{t}prior", top), lambda p: F.log(p))
    score = F.zip_with(F.zip_with(F.col(f"{t}ll"), prior, lambda a, b: a + b), says, lambda a, b: a + b)
    met = met.withColumn(f"{t}score", F.when(F.col(f"{t}ll").isNotNull(), score))
    most = F.array_max(f"{t}score")
    odds = F.aggregate(F.transform(f"{t}score", lambda x: F.exp(x - most)), F.lit(0.0), lambda a, x: a + x)
    done = met.withColumns({"language": F.when(F.col(f"{t}ll").isNotNull(), best(F.col(f"{t}score"))), "confidence": F.when(F.col(f"{t}ll").isNotNull(), 1 / odds).otherwise(0.0)})
    return done.drop(f"{t}ll", f"{t}said", f"{t}host", f"{t}suffix", f"{t}prior", f"{t}score", f"{t}h", f"{t}s")


def html_text(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments, tags and entities."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&#?\w+;", " ")


def html_lang(html: Column) -> Column:
    found = F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,8})(?![A-Za-z])""", 1)
    return F.when(found != "", F.lower(found))


def url_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def url_suffix(url: Column) -> Column:
    return F.substring_index(url_host(url), ".", -1)
