"""The corpus pipeline: language ID, near-duplicate removal, benchmark
decontamination, secret redaction and packing over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows of the stage before
and, but for the last, returns the columns of ``documents``. Stages are written
to the shared scratch folder and read again in between.

Cases: a null or letterless text is rejected by the language stage; rows
without an id are never duplicates of each other; of near duplicates the
smallest id stays, and rows with one id are one document that stays or goes with all
of them; texts of any length are taken whole; empty tables give empty results; columns beyond those of
``documents`` pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm import decontam, langid, minhash, packing, secrets
from assaylake.llm.frames import written
from assaylake.llm.queries import tokenizer_file

#: a text whose best language has less than this probability is rejected
LEAST_LANG_SCORE = 0.3
#: a document with more than this share of its words in benchmark passages goes as a whole
MAX_COVERAGE = 0.5


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised."""
    net = langid.fit(docs, F.lit(True))
    found = langid.predict(docs, net, lang_col="__lang", score_col="__score", keep_text=True)
    return (found.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_LANG_SCORE))
            .select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, Jaccard 0.8)."""
    return minhash.keep_one(docs, n_words=5, percent=80).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages; drop documents made mostly of them."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _counted(decontam.decontaminate(docs, items, MAX_COVERAGE)).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets and linked credential parts."""
    return _counted(secrets.redact(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids."""
    return packing.packed(docs, tokenizer_file())


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("redact_secrets", redact_secrets), ("pack", pack)]

#: the stages hold a trained network and a tokenizer, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
