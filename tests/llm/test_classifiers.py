import zlib

import numpy as np

from gridloom.llm import language, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_languages_of_documents_and_pages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    sample = docs.where("doc_id % 5 = 0 and length(text) > 200")
    found = language.identify(sample, model, text=F.col("text"), declared=F.lit(None).cast("string"), host=F.lit(None).cast("string"), suffix=F.lit(None).cast("string"))
    right = found.agg(F.avg((F.col("language") == F.col("lang")).cast("int")), F.count("*")).first()
    assert right[0] > 0.97 and right[1] == sample.count()


def test_language_awkward_rows(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs)
    evidence = {"text": F.col("text"), "declared": F.col("lang"), "host": F.col("source"), "suffix": F.lit(None).cast("string")}
    got = language.identify(awkward, model, **evidence).collect()
    assert len(got) == awkward.count()
    assert all(r.language is None and r.confidence == 0 for r in got if r.doc_id in (1, 2, 3))
    assert language.identify(nothing, model, **evidence).count() == 0
    none = language.identify(awkward, language.fit(docs.limit(0)), **evidence).collect()
    assert all(r.language is None for r in none) and len(none) == awkward.count()


def test_html_and_url_parts(spark):
    row = spark.range(1).select(
        language.html_text(F.lit("<html lang='de'><script>var a='<p>';</script><p>Guten&nbsp;Tag</p><!-- no --></html>")).alias("t"),
        language.html_lang(F.lit('<!DOCTYPE html><HTML data-x="1" lang="EN-us">')).alias("l"), language.html_lang(F.lit("<html>")).alias("n"),
        language.url_host(F.lit("https://User@Www.Example.CO.UK:80/a?b")).alias("h"), language.url_suffix(F.lit("https://a.example.fr/x")).alias("s"),
    ).first()
    assert (row.t.split(), row.l, row.n, row.h, row.s) == (["Guten", "Tag"], "en", None, "www.example.co.uk", "fr")


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    rows = toxicity.score(docs.join(labels, "doc_id").where(toxicity.held_out()), model).select("doc_id", "toxic", "score").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    rank = np.argsort(np.argsort([r.score for r in rows])) + 1
    y = np.array([r.toxic for r in rows])
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / y.sum() / (len(y) - y.sum())
    assert auc > 0.8


def test_toxicity_awkward_rows(spark, awkward, nothing):
    bad, good = ["you vile idiot %d went out" % k for k in range(60)], ["a kind person %d went out" % k for k in range(90)]
    model = toxicity.train(bad, good)
    got = toxicity.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(nothing, model).count() == 0
    assert set(toxicity.score_texts(toxicity.train([], good), ["x", None])) == {0.0}


def test_common_words_of_skewed_samples_do_not_tell():
    texts = lambda n, side: [" ".join(f"{side}{k}q{i} with" for i in range(20)) for k in range(n)]
    assert "with" not in toxicity._telling(texts(30, "x"), texts(400, "y"))


def test_every_text_trains_the_ordinary_dictionary():
    long, short = " ".join(f"filler{k}" for k in range(2000)), [f"plain{k} words of text {k}" for k in range(12)]
    model = toxicity.train(["vile idiot"] * 20, [long, *short, *["the rest calibrates"] * 5], most_windows=40)
    assert all(f"plain{k} ".encode() in model.ordinary for k in range(11))
    assert toxicity._shares([5, 1, 100, 0], 10) == [4, 1, 5, 0]


def test_every_language_and_whole_texts_are_learned(spark):
    rng = np.random.default_rng(3)
    own = {f"l{k:02d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)] for k in range(40)}
    rows = [(n, " ".join(rng.choice(words, 30)), lang) for n, (lang, words) in enumerate((x for x in own.items() for _ in range(3)))]
    rows.append((999, " " * 25_000 + " ".join(["zqzqxzq"] * 200), "late"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.fit(docs)
    assert model.languages == tuple(sorted([*own, "late"]))
    none = F.lit(None).cast("string")
    found = language.identify(docs, model, text=F.col("text"), declared=none, host=none, suffix=none).select("lang", "language").collect()
    assert len(found) == len(rows) and all(r.lang == r.language for r in found)


def test_letterless_texts_and_clashing_columns(spark):
    texts = ["— … “”", "😀 👍", "123 456", "¡!", "", None, "the cat sat on the mat and the dog", "la casa está en la montaña más alta"]
    docs = spark.createDataFrame([(k, ["the cat is on the mat and the sun", "la niña está en la casa de su abuela"][k % 2], ["en", "es"][k % 2]) for k in range(20)], "doc_id long, text string, lang string")
    rows = spark.createDataFrame([(k, t, "kept", "kept too") for k, t in enumerate(texts)], "k int, text string, _ll string, _host string")
    none = F.lit(None).cast("string")
    found = language.identify(rows, language.fit(docs), text=F.col("text"), declared=none, host=none, suffix=none)
    got = {r.k: r for r in found.collect()}
    assert [got[k].language for k in range(8)] == [None] * 6 + ["en", "es"]
    assert [got[k].confidence for k in range(6)] == [0.0] * 6 and {r["_ll"] for r in got.values()} == {"kept"} and {r["_host"] for r in got.values()} == {"kept too"}


def test_declarations_and_hosts_by_their_primary_language(spark):
    html = spark.createDataFrame([('<html lang="en-GB">',), ("<html class=x lang=deu>",), ("<HTML LANG='fr'>",), ("<html>",), (None,)], "html string")
    assert [r[0] for r in html.select(language.html_lang(F.col("html"))).collect()] == ["en", "deu", "fr", None, None]
