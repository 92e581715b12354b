"""Queries against plain Python over every row."""

import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from gridloom.llm import language, sharding, toxicity
from gridloom.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_sharding(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    ids = np.array([d["doc_id"] for d in docs])
    now, then = (sharding.assign(ids, sharding.topology(n)).tolist() for n in (24, 25))
    want = sorted((d["doc_id"], len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode()), "key", a, b) for d, a, b in zip(docs, now, then, strict=True))
    got = QUERIES["op3_sharding"](spark, SF).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for shard in set(now):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(now.count(shard)))
    assert all(b in (a, 24) for a, b in zip(now, then, strict=True)) and 24 in then


def test_toxicity_scores(spark):
    """The scores from the model's parts, the windows' lengths counted one by one."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    ordinary, toxic = toxicity._compressor(model.ordinary), toxicity._compressor(model.toxic)
    got = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, SF).collect()}
    for r in docs.collect():
        words = (r.text or "").lower().split()
        gains = [len(ordinary(w)) - len(toxic(w)) for w in (" ".join(words[k : k + 8]).encode() for k in range(0, len(words), 8))]
        x = np.zeros(8)
        if gains:
            over = [sum(max(g - k, 0) for g in gains) for k in (1, 3, 5)]
            x[:] = (np.mean(gains), *(o / len(gains) for o in over), np.log1p(over[1]), np.log1p(over[2]), max(gains), np.log(len(gains)))
        z = np.clip((x - np.array(model.mean)) / np.array(model.spread), -6, 6)
        terms = [1.0, *z, *(z[i] * z[j] for i in range(8) for j in range(i, 8))]
        want = 1 / (1 + np.exp(-np.clip(np.dot(terms, model.weights), -30, 30)))
        row = got[r.doc_id]
        assert abs(row.score - want) < 1e-9 and row.predicted == int(row.score >= 0.3) and row.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_language_posteriors(spark):
    """The evidence of every page put together by hand: trigrams, declarations, priors of hosts smoothed by suffix and whole."""
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    pages = pq.read_table(f"{SF}/pages.parquet", columns=["page_id", "html", "url"]).to_pylist()
    names = list(model.languages)
    tables = [t.copy() for t in model.tables()]
    rows = []
    for p in pages:
        html, url = p["html"] or "", p["url"] or ""
        bare = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ", html)
        text = re.sub(r"&#?\w+;", " ", re.sub(r"<[^>]*>", " ", bare), flags=re.ASCII)
        said = re.search(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,8})(?![A-Za-z])""", html)
        host = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url)
        raw = (" " + re.sub(r"[\W\d_]+", " ", text.lower())).encode()
        ll = None
        if p["html"] and any(b > 32 for b in raw):
            padded = raw + b"\0\0"
            codes = [((((padded[k] << 16 | padded[k + 1] << 8 | padded[k + 2]) * 0x9E3779B1) & 0xFFFFFFFF) >> 16) for k in range(len(raw))]
            ll = np.array([sum(float(t[c]) for c in codes) for t in tables]) / language.TEMPER
        host = host[1].lower() if host else None
        rows.append((p["page_id"], ll, said[1].lower() if said else None, host, host.rsplit(".", 1)[-1] if host else None))
    count = lambda which: np.array([sum(r[1] is not None and int(np.argmax(r[1])) == k and which(r) for r in rows) for k in range(len(names))], dtype=float)
    total = count(lambda r: True)
    top = (total + 1) / (total.sum() + len(names))
    smooth = lambda n, parent, strength: (n + strength * parent) / (n.sum() + strength)
    got = {r.page_id: r for r in QUERIES["op8_language_id"](spark, SF).collect()}
    suffixes, hosts = {}, {}
    for page, ll, said, host, suffix in rows:
        if ll is None:
            assert got[page].language is None and got[page].confidence == 0
            continue
        if suffix not in suffixes:
            suffixes[suffix] = smooth(count(lambda r: r[4] == suffix), top, 20.0)
        if host not in hosts:
            hosts[host] = smooth(count(lambda r: r[3] == host), suffixes[suffix], 10.0)
        score = ll + np.log(hosts[host])
        if said in names:
            n = count(lambda r: r[2] == said)
            score = score + np.log((n + 5 * np.array([0.9 if m == said else 0.1 / (len(names) - 1) for m in names])) / (total + 5))
        odds = np.exp(score - score.max())
        assert got[page].language == names[int(np.argmax(score))] and abs(got[page].confidence - 1 / odds.sum()) < 1e-4, page


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_like_its_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF):
        duck.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.fetchall())
