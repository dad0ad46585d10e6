"""JSON jobs: answer logs built from search results, path lookups, array-to-rows,
containment inside arrays, and vectors as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.config import ANSWER_ID_START
from lodestar.operators.relational import dense_index

DETAILS_SCHEMA = "mode string, closest_distance double, chunks array<struct<source string, score double>>"


def answer_log(results: DataFrame, questions: DataFrame, *, mode: str = "hybrid",
               id_start: int = ANSWER_ID_START, asked_at: Column | None = None) -> DataFrame:
    """One answer row per question: ``id`` from a sequence starting at ``id_start``, the question,
    and ``details`` = ``{"mode", "closest_distance", "chunks": [{"source", "score"}, ...]}`` as JSON text.

    ``results`` has ``qid, rank, source, score, closest``; chunks keep rank order. These columns are checkpointed, for
    the numbering reads them a second time."""
    per_q = (results.select("qid", "rank", "source", "score", "closest").checkpoint().groupBy("qid")
             .agg(F.min("closest").alias("closest_distance"),
                  F.sort_array(F.collect_list(F.struct("rank", "source", F.round("score", 4).alias("score"))))
                  .alias("_c")))
    details = F.to_json(F.struct(F.lit(mode).alias("mode"), F.col("closest_distance"),
                                 F.transform("_c", lambda c: F.struct(c["source"].alias("source"),
                                                                      c["score"].alias("score"))).alias("chunks")))
    logged = per_q.join(questions.select("qid", "question"), "qid").select("qid", "question", details.alias("details"))
    out = dense_index(logged, ["qid"], "id", id_start)
    return out.select("id", "qid", "question", (asked_at if asked_at is not None else F.current_timestamp()).alias("asked_at"),
                      "details")


def json_values(df: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """``JSON_VALUE``: scalar at a path, as text (null when missing)."""
    return df.select("*", *[F.get_json_object(F.col(column), p).alias(name) for name, p in paths.items()])


def explode_json_array(df: DataFrame, column: str, schema: str, field: str, keep=("id",)) -> DataFrame:
    """``OPENJSON … WITH (…)``: a typed array inside the JSON becomes rows."""
    parsed = df.select(*keep, F.from_json(F.col(column), schema).alias("_j"))
    return parsed.select(*keep, F.inline(F.col(f"_j.{field}")))


def json_array_contains(column: Column, schema: str, field: str, key: str, value) -> Column:
    """``JSON_CONTAINS(doc, value, '$.field[*].key')``."""
    parsed = F.from_json(column, schema)
    return F.exists(parsed[field], lambda e: e[key] == F.lit(value))


def vector_elements(df: DataFrame, vec: str = "embedding", keep=("id",)) -> DataFrame:
    """``OPENJSON`` over a vector's JSON text: ``key`` (0-based) and ``value`` per number."""
    parsed = df.select(*keep, F.from_json(F.to_json(F.col(vec)), "array<float>").alias("_v"))
    return parsed.select(*keep, F.posexplode("_v").alias("key", "value"))
