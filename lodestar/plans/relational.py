"""Registered relational queries on the chunk table, usage and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.config import ANN_MIN_ROWS, MAX_DISTANCE
from lodestar.operators.embedding import hash_embedding
from lodestar.operators import relational as rel
from lodestar.operators import validate as va
from lodestar.operators.ingest import ingest_chunks, load_published
from lodestar.plans.common import chunks
from lodestar.plans.registry import register
from lodestar.plans.sqlparts import CHUNKS, WHOLE
from lodestar.session import data_tag, scratch_path
from lodestar.sources.tables import read_table, whole_corpus


@register("chunk_departments", f"""WITH {CHUNKS}
SELECT department, count(DISTINCT source) AS documents, count(*) AS chunks FROM chunks GROUP BY department""")
def chunk_departments(spark, sf):
    return rel.department_counts(chunks(spark, sf))


@register("chunks_per_source", f"WITH {CHUNKS} SELECT source, count(*) AS chunks FROM chunks GROUP BY source ORDER BY chunks DESC, source")
def chunks_per_source(spark, sf):
    return (chunks(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))
            .orderBy(F.col("chunks").desc(), "source"))


_STATS = """stats AS (SELECT source, department, count(*) AS chunks,
                     round(avg(length(content))::DOUBLE, 6) AS avg_chunk_length FROM chunks GROUP BY source, department)"""


@register("document_stats", f"WITH {CHUNKS}, {_STATS} SELECT * FROM stats")
def document_stats(spark, sf):
    return rel.document_stats(chunks(spark, sf))


@register("running_totals", f"""WITH {CHUNKS}, {_STATS}
SELECT department, source, chunks,
       sum(chunks) OVER (PARTITION BY department ORDER BY source ROWS UNBOUNDED PRECEDING) AS running_total_in_department,
       rank() OVER (ORDER BY chunks DESC) AS size_rank
FROM stats""")
def running_totals(spark, sf):
    return rel.running_totals(rel.document_stats(chunks(spark, sf)))


_USAGE = """docs AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS n, count(*) OVER () AS total
                 FROM (SELECT DISTINCT source FROM documents)),
usage AS (SELECT e.ts::DATE AS used_on, d.source, e.event_type AS mode,
                 CASE hour(e.ts) // 8 WHEN 0 THEN 'night' WHEN 1 THEN 'day' WHEN 2 THEN 'evening' END AS shift,
                 round(e.value, 2) AS duration_ms
          FROM events e LEFT JOIN docs d ON d.n = e.user_id % d.total)"""


def _usage(spark, sf):
    return rel.usage_rows(read_table(spark, sf, "events"), read_table(spark, sf, "documents"))


@register("usage_generate", f"WITH {_USAGE} SELECT used_on, source, mode, shift, duration_ms FROM usage")
def usage_generate(spark, sf):
    """The events as rows of usage: who used which document, when and how."""
    return _usage(spark, sf)


@register("usage_partitioned", f"""WITH {_USAGE}
SELECT date_trunc('month', used_on)::DATE AS month, count(*) AS rows, count(DISTINCT source) AS sources FROM usage GROUP BY 1""")
def usage_partitioned(spark, sf):
    """Write usage partitioned by month, then count rows and documents of each partition."""
    path = scratch_path(spark, f"search_usage_{data_tag(sf)}")
    usage = _usage(spark, sf).withColumn("month", F.trunc("used_on", "month"))
    usage.write.mode("overwrite").partitionBy("month").parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("source").alias("sources"))


@register("usage_by_month", f"""WITH {_USAGE},
seen AS (SELECT date_trunc('month', used_on)::DATE AS month, mode, count(*) AS searches, round(avg(duration_ms), 6) AS avg_ms
         FROM usage WHERE used_on IS NOT NULL AND mode IS NOT NULL GROUP BY 1, 2),
calendar AS (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM seen)
SELECT c.month, m.mode, coalesce(s.searches, 0) AS searches, s.avg_ms
FROM calendar c CROSS JOIN (SELECT DISTINCT mode FROM seen) m LEFT JOIN seen s ON s.month = c.month AND s.mode = m.mode ORDER BY 1, 2""")
def usage_by_month(spark, sf):
    return rel.usage_by_month(_usage(spark, sf))


@register("graph_two_hop", f"""WITH {CHUNKS},
edges AS (SELECT DISTINCT source AS src, department AS dst FROM chunks)
SELECT o2.src AS same_department, o1.dst AS department FROM edges o1 JOIN edges o2 ON o1.dst = o2.dst
WHERE o1.src = (SELECT min(source) FROM chunks) AND o2.src <> o1.src""")
def graph_two_hop(spark, sf):
    c = chunks(spark, sf)
    _, _, owned_by = rel.graph_edges(c)
    return rel.same_department_as(owned_by, c.select(F.min("source")).scalar())


@register("first_per_source", """SELECT source, doc_id, text AS question FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 ORDER BY doc_id LIMIT 4""")
def first_per_source(spark, sf):
    docs = read_table(spark, sf, "documents").withColumn("question", F.col("text"))
    return rel.first_per_group(docs, "source", "doc_id", "question", 4)


@register("chat_history", """SELECT conv_id, turn, role,
  coalesce(to_json(list({'role': role, 'content': text}) OVER (PARTITION BY conv_id ORDER BY turn
           ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)), '[]') AS history
FROM conversations""")
def chat_history(spark, sf):
    h = rel.chat_history(read_table(spark, sf, "conversations"))
    return h.withColumn("history", F.to_json("history"))


@register("corpus_status", f"""WITH {WHOLE}
SELECT count(*) AS chunks, min(id) AS min_id, max(id) AS max_id,
       CASE WHEN count(embedding) >= {ANN_MIN_ROWS} THEN 'approximate' ELSE 'exact' END AS vector_search,
       CASE WHEN count(embedding) >= {ANN_MIN_ROWS} THEN count(embedding) END AS indexed_vectors,
       CASE WHEN count(embedding) >= {ANN_MIN_ROWS} THEN max(len(embedding))::INTEGER END AS dimensions,
       {MAX_DISTANCE}::DOUBLE AS max_distance FROM corpus""")
def corpus_status(spark, sf):
    """The table, and what its manifest says of the vector index; the index itself gives rows and dimensions."""
    from lodestar.operators.ingest import published_index
    from lodestar.plans.scale import published
    index = published_index(spark, published(spark, sf))
    c = whole_corpus(spark, sf)
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.min("id").alias("min_id"), F.max("id").alias("max_id"),
                 F.lit("approximate" if index else "exact").alias("vector_search"),
                 F.lit(index.rows if index else None).cast("long").alias("indexed_vectors"),
                 F.lit(index.dims if index else None).cast("int").alias("dimensions"),
                 F.lit(MAX_DISTANCE).cast("double").alias("max_distance"))


@register("validate_rows", """WITH dup AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1),
parent AS (SELECT DISTINCT doc_id FROM documents)
SELECT l.doc_id, l.quality, l.toxic, concat_ws(';',
  CASE WHEN l.doc_id IS NULL OR l.quality IS NULL OR l.toxic IS NULL THEN 'NN_labels' END,
  CASE WHEN NOT coalesce(l.quality IN (0, 1), true) THEN 'CK_labels_quality' END,
  CASE WHEN NOT coalesce(l.toxic IN (0, 1), true) THEN 'CK_labels_toxic' END,
  CASE WHEN NOT coalesce(NOT (l.quality = 1 AND l.toxic = 1), true) THEN 'CK_labels_consistent' END,
  CASE WHEN l.doc_id IN (SELECT doc_id FROM dup) THEN 'UQ_labels_doc' END,
  CASE WHEN l.doc_id IS NOT NULL AND l.doc_id NOT IN (SELECT doc_id FROM parent) THEN 'FK_labels_documents' END) AS errors
FROM labels l""")
def validate_rows(spark, sf):
    labels = read_table(spark, sf, "labels")
    rules = [
        va.NotNull("NN_labels", ["doc_id", "quality", "toxic"]),
        va.Check("CK_labels_quality", F.col("quality").isin(0, 1)),
        va.Check("CK_labels_toxic", F.col("toxic").isin(0, 1)),
        va.Check("CK_labels_consistent", ~((F.col("quality") == 1) & (F.col("toxic") == 1))),
        va.Unique("UQ_labels_doc", ["doc_id"]),
        va.ForeignKey("FK_labels_documents", ["doc_id"], read_table(spark, sf, "documents"), ["doc_id"]),
    ]
    out = va.validate(labels, rules)
    return out.select("doc_id", "quality", "toxic", F.array_join("errors", ";").alias("errors"))


@register("ingest_chunks", f"""WITH {CHUNKS}
SELECT row_number() OVER (ORDER BY source, doc_id, chunk_no) AS id, source, content FROM chunks""")
def ingest_chunks_q(spark, sf):
    base = scratch_path(spark, f"chunks_{data_tag(sf)}")
    ingest_chunks(read_table(spark, sf, "documents"), base, embed_fn=hash_embedding())
    return load_published(spark, base).select("id", "source", "content")
