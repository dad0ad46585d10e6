"""The registered queries of the numbered operators: whole tables in, full results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import (decontaminate, jaccard, katz, merkle, mixture, outliers, packing, patience, quality, quotes, resample, toxicity,
                          urlfilter)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(mod: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find_leaks(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = katz.score_texts(_t(spark, sf_dir, "documents"), _fold(7) != 2)
    return scores.select("doc_id", F.coalesce(_fold(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_t(spark, sf_dir, "pages"), urlfilter.rules_table(spark))


def op4_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patience.report(patience.scan(_t(spark, sf_dir, "documents")))


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(_t(spark, sf_dir, "conversations"))


def op6_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(_t(spark, sf_dir, "documents")).drop("lang", "source")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _t(spark, sf_dir, "labels").select("doc_id", "toxic")
    scores = toxicity.score_toxicity(_t(spark, sf_dir, "documents"), labels, _fold(4) != 2)
    return scores.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_t(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.tokenise(_t(spark, sf_dir, "documents"), path))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _t(spark, sf_dir, "labels").select("doc_id", "quality")
    scores = quality.score_quality(_t(spark, sf_dir, "documents"), labels, _fold(5) != 0)
    return scores.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"), "prior")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(merkle.build(_t(spark, sf_dir, "documents"), F.coalesce(_fold(5) == 0, F.lit(False))))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample.resample(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(_t(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_katz, op3_urlfilter, op4_patience, op5_quotes, op6_outliers,
                                   op7_toxicity, op8_jaccard, op9_packing, op10_quality, op11_merkle, op12_resample, op13_mixture)}
ORACLE: dict[str, str] = {"op3_urlfilter": urlfilter.ORACLE, "op11_merkle": merkle.ORACLE, "op12_resample": resample.ORACLE,
                          "op13_mixture": mixture.ORACLE}
