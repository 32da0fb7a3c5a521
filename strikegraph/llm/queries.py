"""The thin queries of this subpackage and their SQL; ``__spark_entry__.py`` adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, decontam, divergence, langid, line_dedup, mixing, pii, quality, secrets, simhash, tokens, topk, whitening


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantize(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op3_pii_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.token_file_dir(spark, "op4")
    tokens.write_token_files(read(spark, sf_dir, "documents"), word_bpe(), out)
    return tokens.read_token_files(spark, out)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents")).select("doc_id", "quality", "weak_good", "keep")


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(read(spark, sf_dir, "documents"), words=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = backoff.score_corpus(docs, order=2)
    return scored.withColumn("log_score", F.round("log_score", 4) + F.lit(0.0))


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=4)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    kept = line_dedup.drop_lines(docs, line_dedup.index(docs, min_chars=40, min_docs=5))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), min_docs=30, top=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_mixture": op1_language_mixture,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_pii_segments": op3_pii_segments,
    "op4_token_files": op4_token_files,
    "op5_quality": op5_quality,
    "op6_secret_ownership": op6_secret_ownership,
    "op7_decontaminate": op7_decontaminate,
    "op8_simhash": op8_simhash,
    "op9_stupid_backoff": op9_stupid_backoff,
    "op10_poisson_mix": op10_poisson_mix,
    "op11_whiten": op11_whiten,
    "op12_line_dedup": op12_line_dedup,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_top_k": topk.TOP_K_SQL,
    "op9_stupid_backoff": backoff.SCORE_SQL,
    "op10_poisson_mix": mixing.MIX_SQL,
    "op12_line_dedup": line_dedup.LINES_SQL,
    "op13_source_divergence": divergence.AUDIT_SQL,
}
