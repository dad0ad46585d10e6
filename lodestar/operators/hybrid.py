"""Hybrid retrieval for whole tables of questions.

vector top-N ∥ text top-N → FULL OUTER JOIN on (question, row) →
Σ 1/(60 + rank) → top-k, with the distance of the closest row (``closest``)
so a question nothing is close to can be refused. Everything is per question
(``PARTITION BY qid``); no global window, no collect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import MAX_DISTANCE, RRF_CANDIDATES, RRF_K, TOP_K
from lodestar.operators import vindex
from lodestar.operators.fulltext import text_top_k
from lodestar.operators.knn import knn_batch, top_k_per_query
from lodestar.operators.vindex import VectorIndex


def text_ranks(questions: DataFrame, postings: DataFrame, n: int = RRF_CANDIDATES, *,
               exclude_self: bool = True, stopwords: DataFrame | None = None,
               common_df: int | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Text top-n per question: ``qid, id, relevance, rank`` (exact, common words bounded)."""
    return text_top_k(questions, postings, n, stopwords=stopwords, exclude_self=exclude_self,
                      common_df=common_df, stats=stats)


def vector_ranks(questions: DataFrame, corpus: DataFrame, n: int = RRF_CANDIDATES, *,
                 exclude_self: bool = True) -> DataFrame:
    """Vector top-n per question: ``qid, id, distance, rank``; questions and rows without a vector take no part."""
    return knn_batch(questions.where("qvec is not null"), corpus.where("embedding is not null").select("id", "embedding"), n,
                     exclude="self" if exclude_self else None)


def fuse(vranks: DataFrame, franks: DataFrame, top_k: int = TOP_K, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings: ``qid, id, score, closest, rank``."""
    v = vranks.select("qid", "id", F.col("rank").alias("vrank"), "distance")
    f = franks.select("qid", "id", F.col("rank").alias("frank"))
    fused = v.join(f, ["qid", "id"], "full")
    part = lambda r: F.coalesce(F.lit(1.0).cast("double") / (F.lit(rrf_k) + F.col(r)), F.lit(0.0))
    fused = fused.select("qid", "id", (part("vrank") + part("frank")).alias("score"))
    closest = vranks.groupBy("qid").agg(F.min("distance").alias("closest"))
    top = top_k_per_query(fused, top_k, "score", descending=True)
    return top.join(closest, "qid", "left")


def hybrid_search(questions: DataFrame, corpus: DataFrame, postings: DataFrame, *, top_k: int = TOP_K,
                  candidates: int = RRF_CANDIDATES, exclude_self: bool = True,
                  stopwords: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """``qid, rank, id, source, score, closest`` for every question."""
    vr = vector_ranks(questions, corpus, candidates, exclude_self=exclude_self)
    fr = text_ranks(questions, postings, candidates, exclude_self=exclude_self, stopwords=stopwords, stats=stats)
    top = fuse(vr, fr, top_k)
    return top.join(corpus.select("id", "source"), "id").select("qid", "rank", "id", "source", "score", "closest")


def vector_search(questions: DataFrame, corpus: DataFrame, *, top_k: int = TOP_K,
                  exclude_self: bool = True, index: VectorIndex | None = None) -> DataFrame:
    """``qid, rank, id, source, score`` with score = cosine distance; through the vector index where there is one."""
    if index is not None:
        top = vindex.search(questions, index, top_k, exclude_self=exclude_self)
    else:
        top = vector_ranks(questions, corpus, top_k, exclude_self=exclude_self)
    return (top.join(corpus.select("id", "source"), "id")
            .select("qid", "rank", "id", "source", F.col("distance").alias("score")))


def retrieve(questions: DataFrame, corpus: DataFrame, postings: DataFrame | None, mode: str = "hybrid", *,
             top_k: int = TOP_K, max_distance: float = MAX_DISTANCE, candidates: int = RRF_CANDIDATES,
             exclude_self: bool = True, stopwords: DataFrame | None = None,
             stats: DataFrame | None = None, index: VectorIndex | None = None) -> DataFrame:
    """Rows to answer each question from, and the mode actually used.

    hybrid: all fused rows of a question are kept when its closest row is within
    ``max_distance`` (inclusive), otherwise none; vector: rows are cut one by one.
    Without a text index, hybrid falls back to vector and says so in ``mode_used``. ``index`` is the vector index
    of the corpus (``ingest.published_index``): vector mode searches it, and exactly where there is none; hybrid
    mode takes exact distances either way.
    A question with no rows left is ``refused``: one row with null ``id``.
    Output: ``qid, mode_used, n, id, source, score, refused``.
    """
    if mode not in ("hybrid", "vector"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "hybrid" and postings is not None:
        rows = hybrid_search(questions, corpus, postings, top_k=top_k, candidates=candidates,
                             exclude_self=exclude_self, stopwords=stopwords, stats=stats)
        rows = rows.where(F.col("closest") <= F.lit(max_distance)).drop("closest")
        used = "hybrid"
    else:
        rows = vector_search(questions, corpus, top_k=top_k, exclude_self=exclude_self, index=index)
        rows = rows.where(F.col("score") <= F.lit(max_distance))
        used = "vector"
    # Renumber after the cut so passages are 1..n.
    w = Window.partitionBy("qid").orderBy("rank")
    rows = rows.withColumn("n", F.row_number().over(w).cast("long")).drop("rank")
    out = questions.select("qid").distinct().join(rows, "qid", "left")
    return out.select("qid", F.lit(used).alias("mode_used"), "n", "id", "source", "score",
                      F.col("id").isNull().alias("refused"))


def passages(retrieved: DataFrame, corpus: DataFrame, digits: int = 4) -> DataFrame:
    """Numbered passages per question as ``array<struct<n, source, content, score>>``, score rounded."""
    rows = (retrieved.where(~F.col("refused"))
            .join(corpus.select("id", "content"), "id")
            .select("qid", "mode_used", F.struct(F.col("n"), F.col("source"), F.col("content"),
                                                 F.round("score", digits).alias("score")).alias("p")))
    return (rows.groupBy("qid", "mode_used")
            .agg(F.sort_array(F.collect_list("p")).alias("passages")))


def prompt_context(passage_rows: DataFrame) -> DataFrame:
    """``[n] (source)\\ncontent`` blocks joined by blank lines, in passage order."""
    block = lambda p: F.concat(F.lit("["), p["n"].cast("string"), F.lit("] ("), p["source"], F.lit(")\n"), p["content"])
    return passage_rows.select("qid", F.array_join(F.transform("passages", block), "\n\n").alias("context"))


def search_text(questions: DataFrame, rewrites: DataFrame) -> DataFrame:
    """What to search for: the rewritten follow-up when it is not blank, else the question.

    ``rewrites`` has ``qid, rewritten``; questions without a row keep their own text."""
    from lodestar.operators.chunking import strip_text
    joined = questions.join(rewrites, "qid", "left")
    text = F.coalesce(F.nullif(strip_text(F.col("rewritten")), F.lit("")), F.col("question"))
    return joined.select("qid", "question", text.alias("search_query"))
