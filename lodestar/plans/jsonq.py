"""Registered JSON and vector-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.operators import jsonops as js
from lodestar.plans.registry import register
from lodestar.plans.retrieval import _index
from lodestar.plans.sqlparts import CORPUS, hybrid_ctes
from lodestar.operators.hybrid import hybrid_search
from lodestar.operators.halfprec import to_half
from lodestar.sources.tables import corpus, read_table

_LOG = """log AS (
  SELECT (999 + row_number() OVER (ORDER BY h.qid)) AS id, h.qid, q.question,
         to_json({'mode': 'hybrid', 'closest_distance': min(h.closest),
                  'chunks': list({'source': h.source, 'score': round(h.score, 4)} ORDER BY h.rank)}) AS details
  FROM hyb h JOIN questions q ON q.qid = h.qid GROUP BY h.qid, q.question)"""


def _log(spark, sf):
    c, q, stop, post = _index(spark, sf)
    return js.answer_log(hybrid_search(q, c, post, stopwords=stop), q)


@register("answer_log_json", f"WITH {hybrid_ctes()}, {_LOG} SELECT id, qid, question, details FROM log")
def answer_log_json(spark, sf):
    return _log(spark, sf).select("id", "qid", "question", "details")


@register("json_explode", f"""WITH {hybrid_ctes()}, {_LOG}
SELECT id, unnest(from_json(details, '{{"chunks": [{{"source": "VARCHAR", "score": "DOUBLE"}}]}}').chunks, recursive := true)
FROM log""")
def json_explode(spark, sf):
    return js.explode_json_array(_log(spark, sf), "details", js.DETAILS_SCHEMA, "chunks")


@register("json_contains", f"""WITH {hybrid_ctes()}, {_LOG}
SELECT id, qid FROM log
WHERE list_contains(list_transform(from_json(details, '{{"chunks": [{{"source": "VARCHAR"}}]}}').chunks, lambda c: c.source), 'src0')""")
def json_contains(spark, sf):
    log = _log(spark, sf)
    return log.where(js.json_array_contains(F.col("details"), js.DETAILS_SCHEMA, "chunks", "source", "src0")).select("id", "qid")


@register("json_value", """SELECT event_id, json_extract_string(props, '$.k') AS k,
  json_extract_string(props, '$.missing') AS missing FROM events""")
def json_value(spark, sf):
    ev = read_table(spark, sf, "events")
    return js.json_values(ev, "props", {"k": "$.k", "missing": "$.missing"}).select("event_id", "k", "missing")


@register("vector_json", f"""WITH {CORPUS},
el AS (SELECT id, generate_subscripts(embedding, 1) - 1 AS key, unnest(embedding) AS value FROM corpus)
SELECT id, count(*) AS dims, round(sum(value::DOUBLE), 6) AS total,
       '[' || string_agg(printf('%.4f', value), ',' ORDER BY key) || ']' AS rebuilt
FROM el GROUP BY id""")
def vector_json(spark, sf):
    el = js.vector_elements(corpus(spark, sf))
    return el.groupBy("id").agg(
        F.count(F.lit(1)).alias("dims"),
        F.round(F.sum(F.col("value").cast("double")), 6).alias("total"),
        F.concat(F.lit("["), F.expr("listagg(format_string('%.4f', value), ',') WITHIN GROUP (ORDER BY key)"),
                 F.lit("]")).alias("rebuilt"))


@register("vector_metrics", f"""WITH {CORPUS},
p AS (SELECT id, embedding AS a, lead(embedding) OVER (ORDER BY id) AS b FROM corpus)
SELECT id, round(list_cosine_distance(a::DOUBLE[], b::DOUBLE[]), 6) + 0.0 AS cosine,
       round(list_distance(a::DOUBLE[], b::DOUBLE[]), 6) + 0.0 AS euclidean,
       round(-list_dot_product(a::DOUBLE[], b::DOUBLE[]), 6) + 0.0 AS dot,
       len(a)::INTEGER AS dimensions, CASE typeof(a) WHEN 'FLOAT[]' THEN 'float32' WHEN 'DOUBLE[]' THEN 'float64' END AS base_type
FROM p WHERE b IS NOT NULL""")
def vector_metrics(spark, sf):
    c = corpus(spark, sf).select("id", F.col("embedding").alias("a"))
    # Neighbour by id: the next id is found by a range-partitioned lead per id block,
    # not a single-partition window (see lodestar.operators.relational.dense_index).
    from lodestar.operators.relational import dense_index
    idx = dense_index(c, ["id"], "_n")
    nxt = idx.select((F.col("_n") - 1).alias("_n"), F.col("a").alias("b"))
    p = idx.join(nxt, "_n")
    return p.select("id",
                    V.rounded(V.cosine_distance("a", "b")).alias("cosine"),
                    V.rounded(V.euclidean_distance("a", "b")).alias("euclidean"),
                    V.rounded(V.negative_dot("a", "b")).alias("dot"),
                    V.dims("a").alias("dimensions"), F.lit(V.base_type(c.schema["a"].dataType)).alias("base_type"))


@register("vector_normalize", f"""WITH {CORPUS},
p AS (SELECT id, list_transform(embedding, lambda x: x::DOUBLE * (1 + id % 7)) AS v FROM corpus),
n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS nb FROM p),
u AS (SELECT id, nb, list_transform(v, lambda x: (x / nb)::FLOAT::DOUBLE) AS u FROM n)
SELECT id, round(nb, 6) AS norm_before, round(sqrt(list_dot_product(u, u)), 5) AS norm_after, round(list_sum(u), 5) AS total FROM u""")
def vector_normalize(spark, sf):
    """Scaled copies of the embeddings (×1..×7 by id) normalised back to length 1."""
    c = corpus(spark, sf)
    v = c.select("id", F.transform("embedding", lambda x: x.cast("double") * (F.lit(1) + F.col("id") % 7)).alias("v"))
    unit = v.select("id", V.norm("v").alias("nb"), V.normalize("v").alias("u"))
    return unit.select("id", F.round("nb", 6).alias("norm_before"), F.round(V.norm("u"), 5).alias("norm_after"),
                       F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@register("vector_storage", f"""WITH {CORPUS}
SELECT count(*) AS vectors, sum(len(embedding) * 4)::BIGINT AS float32_bytes, sum(len(embedding) * 2)::BIGINT AS float16_bytes,
       round(sum(len(embedding) * 4) / 1048576.0, 4)::DOUBLE AS float32_mb, round(sum(len(embedding) * 2) / 1048576.0, 4)::DOUBLE AS float16_mb
FROM corpus""")
def vector_storage(spark, sf):
    c = corpus(spark, sf).select("embedding", to_half("embedding").alias("h"))
    f32 = F.sum(F.size("embedding") * 4).cast("long")
    f16 = F.sum(F.octet_length("h")).cast("long")
    return c.agg(F.count(F.lit(1)).alias("vectors"), f32.alias("float32_bytes"), f16.alias("float16_bytes"),
                 F.round(f32 / F.lit(1048576.0), 4).cast("double").alias("float32_mb"),
                 F.round(f16 / F.lit(1048576.0), 4).cast("double").alias("float16_mb"))

