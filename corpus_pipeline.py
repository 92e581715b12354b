"""From documents to packed training sequences: language, toxicity, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import language, near_dedup, packing, substring_dedup, toxicity
from gridloom.llm.common import stored
from gridloom.llm.queries import vocabulary

#: A document goes if no language is at least this likely, or if it is toxic with at least this likelihood.
LEAST_CONFIDENCE, MOST_TOXIC = 0.5, 0.5

#: The stages train models and hash; SQL can't express them.
ORACLE_SQL = None


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no certain language, among them those without letters."""
    model = language.fit(docs)
    found = language.identify(docs, model, text=F.col("text"), declared=F.col("lang"), host=F.col("source"), suffix=F.lit(None).cast("string"))
    return found.where(F.col("language").isNotNull() & (F.col("confidence") >= LEAST_CONFIDENCE)).select(docs.columns)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents, by labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels), into="_toxic")
    return scored.where(F.col("_toxic") < MOST_TOXIC).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each class."""
    return near_dedup.deduplicated(docs).select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of repeated passages; documents that lose all their words stay, empty."""
    done = substring_dedup.remove_repeats(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; of the token ids, their checksum."""
    cut = packing.pieces(docs, vocabulary=vocabulary("byte_bpe_50k.json"), keep=("doc_id",))
    return packing.pack(stored(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))


STAGES = [
    ("language", by_language),
    ("toxicity", by_toxicity),
    ("near_dedup", without_near_duplicates),
    ("substring_dedup", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
