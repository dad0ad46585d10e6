"""The corpus pipeline: documents to packed sequences, each stage by one operator of ``lodestar.llm``.

Stages, in order: toxic documents go; documents failing the quality rules go; one document (the smallest
id) of each group of near duplicates stays; documents that hold a benchmark passage go; the rest is
packed into sequences. Each stage works on all that its predecessor kept and returns whole rows of
``documents``; the last returns one row per piece. What a stage keeps is written as Parquet in the shared
folder and read again as the next one's input. A filtering stage numbers the rows of its input (by file and
place in the file); the operator carries the number, and rejected rows leave by it.

Defined results: every row is judged by its own text, with or without a doc_id, and whatever other rows have its
id; of near duplicates rows without an id come last, and of one id the smallest text stays; null texts fail the quality
rules; empty tables give empty results; extra columns are kept by the filters and ignored by the packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, jaccard, outliers, packing, toxicity
from lodestar.llm.common import numbered, small_side, table

TOXIC = 0.3


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own in each row, the same for every reader, and the name of that column.

    Rows read from files are numbered by their file and their place in it, without a copy; the numbers of the files are
    one row per file. Other rows are written with a running number."""
    row = "__row"
    while any(c.startswith(row) for c in docs.columns):
        row += "_"
    try:
        at = docs.select("*", F.col("_metadata.file_path").alias(f"{row}f"), F.col("_metadata.row_index").alias(f"{row}i"))
    except AnalysisException:  # not read from Parquet files
        return table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row
    files = numbered(docs.select(F.col("_metadata.file_path").alias(f"{row}f")).distinct(), [F.col(f"{row}f")], f"{row}n")
    at = at.join(small_side(table(files, "files"), 400), f"{row}f")
    return at.withColumn(row, F.shiftleft(f"{row}n", 40) + F.col(f"{row}i")).drop(f"{row}f", f"{row}i", f"{row}n"), row


def _by_row(docs: DataFrame, row: str) -> DataFrame:
    """Numbered ``docs`` with the number as their id, for operators that only hand the id on."""
    return docs.withColumn("doc_id", F.col(row))


def _without(docs: DataFrame, row: str, rejected: DataFrame) -> DataFrame:
    """Numbered ``docs`` without the rows whose numbers ``rejected`` has; the numbers go."""
    rows = table(rejected.select(F.col(rejected.columns[0]).alias(row)).distinct(), "rejected")
    return docs.join(small_side(rows, 24), row, "left_anti").drop(row)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    docs, row = _numbered(docs)
    scores = toxicity.score_toxicity(docs, labels, train, row=row)
    return _without(docs, row, scores.where(F.col("score") >= TOXIC).select(row))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, row = _numbered(docs)
    return _without(docs, row, outliers.judge(_by_row(docs, row)).where("not kept").select("doc_id"))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, row = _numbered(docs)
    found = jaccard.near_duplicates(_by_row(docs, row)).select(F.col("doc_id").alias(row), F.col("component_id").alias("grp"))
    copies = table(found.where(F.col("grp") < F.col(row)), "copies")
    members = table(copies.unionByName(copies.select(F.col("grp").alias(row), "grp").distinct()), "members")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")), row)
    first = docs.select(row, "doc_id", "text").join(members, row).groupBy("grp").agg(F.min(order).alias("first"))
    stays = table(first.select(F.col(f"first.{row}").alias(row)), "first")
    return _without(docs, row, members.join(stays, row, "left_anti").select(row))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, row = _numbered(docs)
    leaks = decontaminate.find_leaks(_by_row(docs, row), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, row, leaks.where(F.size("starts") > 0).select("doc_id"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenise(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", toxicity_stage), ("quality_rules", quality_stage), ("near_duplicates", duplicates_stage),
          ("decontamination", benchmark_stage), ("packing", packing_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
