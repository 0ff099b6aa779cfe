"""A corpus pipeline of five operators: each stage takes what its predecessor kept, written as Parquet and read again.

language: documents that language identification rejects go. near_duplicates: one document of each class of near copies stays. secrets: spans are masked.
mix: sources are mixed to their target weights. tokens: what is left is encoded and decoded again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.25
"""A document whose grams its best language explains to a smaller part is in none of the languages learned."""


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, texts without letters, and those whose best language explains under LEAST_SCORE of their grams. lang stays as it was."""
    from terrace.llm.langid import UNDECIDED, fit, held_out, identify

    docs = docs.select(*COLUMNS)
    model = fit(docs.where(~held_out()))
    return identify(docs, model).where((F.col("lang_pred") != UNDECIDED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest id.

    Texts are linked if their five-word shingle sets are at a Jaccard similarity of 0.8 or more, verified on the sets.
    """
    from terrace.llm.simhash import keep_one

    return keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; base secrets and linked credential parts become [secret], and n_chars counts the new text."""
    from terrace.llm.secrets import redact, scan

    clean = redact(scan(docs.select(*COLUMNS)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of the mix: whole documents, some twice, and at block and quota edges parts of one, with n_chars of the new text."""
    from terrace.llm.mixing import mixed

    return mixed(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256, decoded_sha256 of each row, encoded with the word BPE vocabulary and decoded again."""
    from terrace.llm.bpe import round_trip
    from terrace.llm.queries import tokenizer_path

    out = round_trip(docs.select(*COLUMNS), tokenizer_path("word_bpe_49k.json"), keep=["doc_id", "source"])
    return out.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]

ORACLE_SQL = None
"""SQL has no near-duplicate classes, Bloom filter or BPE; the stages are tested against brute-force versions instead."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    from terrace.llm.common import shared_dir

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
