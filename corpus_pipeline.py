"""A corpus pipeline of five stages over ``documents``; each is written as Parquet and read by the next.

Every stage works on all that its predecessor kept.  All but the last return the columns of documents, the text
and n_chars as the stage leaves them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, jaccard_join, langid, mixing, quality, secret_scan
from strandloom.llm.tables import Workspace
from strandloom.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose main language has a smaller share of its letters is rejected, as is one without letters.
LEAST_SHARE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; the model learns from rows with a language outside every third fold."""
    ship(spark)
    model = langid.train(docs, quality.fold(F.col("doc_id"), 3) != 1)
    found = langid.identify(docs, model, keep=COLUMNS, spans=False)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each component of the exact n-gram Jaccard join."""
    ship(spark)
    return jaccard_join.keep_one_of_each(docs).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted anew; texts without secrets are unchanged."""
    masked = secret_scan.mask(secret_scan.find_secrets(docs.select(*COLUMNS)))
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources reach their target weights."""
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the hashes of the ids and of the decoded bytes, a row for each taken copy."""
    ship(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("encode", encode),
]

#: Language identification is learned, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.stash(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
