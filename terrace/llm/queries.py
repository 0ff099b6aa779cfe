"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    """The file's place on this machine and, as the package is installed alike, on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.bpe import round_trip

    out = round_trip(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), keep=["doc_id"])
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.fingerprint import edit_probe

    return edit_probe(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.sharding import shard

    return shard(documents(spark, sf_dir), 8)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.mixing import draw, taken_words

    return draw(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", taken_words().alias("taken"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.secrets import digest, scan

    return scan(documents(spark, sf_dir), keep=["doc_id"]).select("doc_id", *digest())


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.langid import fit, held_out, identify

    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    return identify(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.repeats import deduplicated

    return deduplicated(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm import store
    from terrace.llm.common import shared_dir

    out = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    store.write(documents(spark, sf_dir), out, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return store.digests(spark, out)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.llm.topk import search

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


QUERIES = {"op1_bpe": op1_bpe, "op2_mixing": op2_mixing, "op3_fingerprints": op3_fingerprints, "op4_repeats": op4_repeats, "op5_store": op5_store, "op6_sharding": op6_sharding, "op7_simhash": op7_simhash, "op8_secrets": op8_secrets, "op9_language": op9_language, "op10_topk": op10_topk}
ORACLE_SQL: dict[str, str] = {
    "op10_topk": """
        WITH sound AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
}
