"""Queries of the corpus operators over the driver's tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, encoding, exact_dedup, langid, line_dedup, lm, minhash, sharding, simhash, substring_dedup, token_counts, vector_codes
from ._common import documents, fold_of
from .vectors import embeddings


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = documents(spark, sf_dir).select("doc_id", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("text"))
    return minhash.near_duplicates(lowered, shingle=2)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(langid.training_rows(docs))
    told = langid.predict(docs.select("doc_id", "text"), model)
    return told.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "lang_pred", "score")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(lm.with_fold(documents(spark, sf_dir)))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows_evenly(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(documents(spark, sf_dir), _benchmark(spark, sf_dir))
    items = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return hits.select(
        "doc_id",
        "n_words",
        decontaminate.hit_words().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"))


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(documents(spark, sf_dir).select("doc_id", "text"), ids=False)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(*centroids.cluster(embeddings(spark, sf_dir)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(*vector_codes.encode(embeddings(spark, sf_dir)))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash, op2_langid, op3_substrings, op4_lm, op5_sharding, op6_decontaminate, op7_lines, op8_token_counts, op9_exact, op10_sentencepiece,
        op11_centroids, op12_vector_codes, op13_simhash,
    )
}

ORACLES = {
    "op1_minhash": minhash.SQL,
    "op3_substrings": substring_dedup.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op7_lines": line_dedup.SQL,
    "op9_exact": exact_dedup.SQL,
    "op11_centroids": centroids.sql(),
    "op12_vector_codes": vector_codes.sql(),
}
