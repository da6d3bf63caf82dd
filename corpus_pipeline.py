"""A training-data pipeline over ``documents``: language, copies, benchmark passages, personal data, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedline.llm import bpe, decontam, langid, nearcopies, pii
from feedline.llm.common import load, stored, unused
from feedline.session import new_scratch

ORACLE_SQL = None

# Least mean probability of the likeliest label; a text below it is in none of the languages.
# Clean documents of sf0.01 have 0.54 or more with four labels; chance is one over the labels.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages: those without text or letters go, and those no label fits.

    Where no row has a label there is no model, and every text with letters stays.
    """
    net = langid.fit(docs)
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    guess = unused(docs, "guess")
    labelled = docs.withColumn(guess, langid.labeller(net)(F.col("text")))
    known = F.col("text").rlike(r"\p{L}") & (F.col(f"{guess}.score") >= LEAST_SCORE)
    return labelled.filter(known).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, also where its row is repeated."""
    groups = stored(nearcopies.near_copies(docs), "groups")
    firsts = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).dropDuplicates(["root"])
    firsts = firsts.select(F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_text"))
    key = unused(docs, "key")
    texts = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    match = texts["doc_id"].eqNullSafe(firsts["first_id"]) & (texts[key] == firsts["first_text"])
    kept = texts.join(firsts, match, "left_semi")
    # Whole rows are only sorted for it where rows are repeated at all.
    if not groups.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", key])
    return kept.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows."""
    return decontam.remove_contaminated(docs, load(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced, and their new length."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of what they decode to.

    The ids are stored in between.  A task of both would hold two Python workers, and an
    executor keeps all of them, with their memory, for the stages that follow in its session.
    """
    coded = bpe.decode(stored(bpe.encode(docs), "ids"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("private", private),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
