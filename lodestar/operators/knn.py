"""Nearest-neighbour search.

* Single query (``knn_single``, ``similar_items``): the query vector is an
  uncorrelated scalar subquery, so the plan is a scan + projection +
  TakeOrderedAndProject (partial top-k per partition); no join at all.
* Many queries (``knn_batch``): exact top-k per query. The smaller side is sent to the
  other one, whole or part by part; where both are too large, they are cut into
  blocks by a hash of their id and every (query block, corpus block) pair meets in
  one ``cogroup`` task. A task runs matrix products in numpy (``TopK``) and emits only
  its local top-k per query. A ``row_number() <= k`` window merges them; Spark
  plans it as a partial WindowGroupLimit before the shuffle, so each task ships at
  most k rows per query. No pair of (query, vector) is ever a row.

Ties are broken by the lower id everywhere, distances rounded to
``DIST_DIGITS`` so results are stable across engines.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import BLOCK_BYTES, BROADCAST_QUERY_BYTES, DIST_DIGITS, DISTANCES, QUERY_BLOCK_BYTES
from lodestar.functions.vectors import cosine_distance, rounded
from lodestar.operators.fulltext import stored

TOPK_SCHEMA = "qid long, id long, distance double"
ROUNDS = 16                   # parts of a corpus that are sent to the questions one after the other


def first_vector(corpus: DataFrame, where: Column | None = None, vec: str = "embedding") -> Column:
    """The embedding of the lowest id (optionally among rows matching ``where``), as a scalar subquery."""
    src = corpus if where is None else corpus.where(where)
    return src.orderBy("id").select(vec).limit(1).scalar()


def knn_single(corpus: DataFrame, query_vec: Column, k: int = 5, *, exclude_id: Column | None = None,
               cols=("id", "source", "content")) -> DataFrame:
    """Top-k rows by cosine distance to one query vector (``score`` = distance)."""
    # The subquery is projected first: Spark evaluates it once, and it may not sit inside a lambda.
    scored = (corpus.select(*cols, "embedding", query_vec.alias("_q"))
              .select(*cols, rounded(cosine_distance("embedding", "_q")).alias("score")))
    if exclude_id is not None:
        scored = scored.where(F.col("id") != exclude_id)
    return scored.orderBy("score", "id").limit(k)


def similar_items(corpus: DataFrame, item_id, k: int = 5) -> DataFrame:
    """The k items closest to a given item, the item itself excluded."""
    item = F.lit(item_id) if not isinstance(item_id, Column) else item_id
    qvec = corpus.where(F.col("id") == item).select("embedding").limit(1).scalar()
    return (corpus.where(F.col("id") != item).select("id", "source", "embedding", qvec.alias("_q"))
            .select("id", "source", rounded(cosine_distance("embedding", "_q")).alias("distance"))
            .orderBy("distance", "id").limit(k))


# ---------------------------------------------------------------------------
# batched exact top-k


def _stack(values, decode) -> np.ndarray:
    if decode is not None:
        return np.vstack([decode(v) for v in values]).astype(np.float64)
    return np.vstack(values).astype(np.float64)


class TopK:
    """Running top-``k`` of questions over rows that come block by block; ties go to the lower id, distances are rounded first.

    Products are taken in single precision, and a row whose product, with the most that rounding can add, stays below what the k-th place
    asks for is passed over; only the others get their distance, in double precision. The result is that of double precision
    throughout. ``DISTANCES`` products are held at a time."""

    def __init__(self, vectors: np.ndarray, qids: np.ndarray, k: int, exclude: str | None, digits: int, groups: np.ndarray | None = None):
        n, dims = vectors.shape
        self.q, self.qids, self.k, self.exclude, self.digits, self.groups = vectors, qids, k, exclude, digits, groups
        self.norm, self.unit = unit_rows(vectors)
        self.d, self.i = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.slack = (dims + 8) * 2.0 ** -23 + 0.5 * 10.0 ** -digits + 1e-7
        self.least = np.full(n, -np.inf, np.float32)  # the product to reach

    def add(self, vectors: np.ndarray, ids: np.ndarray, groups: np.ndarray | None = None, *, rows: np.ndarray | None = None, ready=None) -> None:
        """Folds rows in, for the questions ``rows`` (their places) or for all; ``ready`` may pass ``unit_rows(vectors)``."""
        norm, unit = ready or unit_rows(vectors)
        rows = np.arange(len(self.q)) if rows is None else rows
        wide = min(2048, len(vectors))
        step = max(1, DISTANCES // max(1, wide))
        for lo in range(0, len(rows), step):
            w = rows[lo:lo + step]
            mine = self.unit[w]
            for a in range(0, len(vectors), wide):
                s = mine @ unit[a:a + wide].T
                self._begin(w, s, ids[a:a + wide], None if groups is None else groups[a:a + wide])
                hit = np.flatnonzero(s >= self.least[w, None])
                x, y = np.divmod(hit, s.shape[1])
                self._take(w[x], y + a, vectors, norm, ids, groups)

    def at_most(self, distance: np.ndarray) -> None:
        """Rows beyond these distances (one for each question, or not a number) are not wanted."""
        self.least = np.where(np.isnan(distance), self.least, (1.0 - distance - self.slack).astype(np.float32))

    def _begin(self, w, s, ids, groups) -> None:
        """Before a question has ``k`` rows, the k-th product of the block is what it asks for."""
        new = np.flatnonzero(np.isneginf(self.least[w]))
        if not len(new) or s.shape[1] < self.k:
            return
        t = s[new]
        t[np.isnan(t)] = -np.inf
        if self.exclude == "self":
            t[self.qids[w[new], None] == ids[None, :]] = -np.inf
        elif self.exclude == "group":
            t[self.groups[w[new], None] == groups[None, :]] = -np.inf
        self.least[w[new]] = np.partition(t, t.shape[1] - self.k, axis=1)[:, -self.k] - np.float32(2 * self.slack)

    def _take(self, w, c, vectors, norm, ids, groups) -> None:
        step = max(1, DISTANCES // max(1, self.q.shape[1]))
        for lo in range(0, len(w), step):
            x, y = w[lo:lo + step], c[lo:lo + step]
            with np.errstate(divide="ignore", invalid="ignore"):
                d = 1.0 - np.einsum("ij,ij->i", self.q[x], vectors[y].astype(np.float64)) / (self.norm[x] * norm[y])
            d, i = np.round(d, self.digits) + 0.0, ids[y]
            keep = np.isfinite(d) & ((d < self.d[x, -1]) | ((d == self.d[x, -1]) & (i < self.i[x, -1])))
            if self.exclude == "self":
                keep &= self.qids[x] != i
            elif self.exclude == "group":
                keep &= ~np.asarray(self.groups[x] == groups[y], bool)
            if keep.any():
                self._fold(x[keep], d[keep], i[keep])

    def _fold(self, x, d, i) -> None:
        rows = np.unique(x)
        x, d, i = np.r_[rows.repeat(self.k), x], np.r_[self.d[rows].ravel(), d], np.r_[self.i[rows].ravel(), i]
        o = np.lexsort((i, d, x))
        x, d, i = x[o], d[o], i[o]
        starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        first = np.arange(len(x)) - starts.repeat(np.diff(np.r_[starts, len(x)])) < self.k  # every question has k places
        self.d[rows], self.i[rows] = d[first].reshape(-1, self.k), i[first].reshape(-1, self.k)
        self.least[rows] = np.maximum(self.least[rows], (1.0 - self.d[rows, -1] - self.slack).astype(np.float32))

    def frame(self) -> pd.DataFrame:
        r, j = np.nonzero(np.isfinite(self.d))
        return pd.DataFrame({"qid": self.qids[r], "id": self.i[r, j], "distance": self.d[r, j]})


def unit_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of rows, and the rows divided by them in single precision (of length 0: not numbers)."""
    norm = np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))
    with np.errstate(divide="ignore", invalid="ignore"):
        return norm, (m / norm[:, None]).astype(np.float32)


def _block_topk(k: int, exclude: str | None, digits: int, decode=None):
    """The per-block kernel: local top-k of a (query block, corpus block) pair."""

    empty = pd.DataFrame({"qid": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"),
                          "distance": pd.Series([], dtype="float64")})

    def kernel(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(cpdf) == 0:
            return empty
        grouped = exclude == "group"
        best = TopK(_stack(qpdf["qvec"].to_numpy(), decode), qpdf["qid"].to_numpy(np.int64), k, exclude, digits,
                    qpdf["qgrp"].to_numpy() if grouped else None)
        best.add(_stack(cpdf["vec"].to_numpy(), decode), cpdf["id"].to_numpy(np.int64), cpdf["grp"].to_numpy() if grouped else None)
        return best.frame()

    return kernel


def block_counts(n_queries: int, n_corpus: int, dims: int, parallelism: int) -> tuple[int, int]:
    """Number of (query, corpus) blocks: corpus blocks bounded in bytes, and at least
    about twice the parallelism in block pairs so no single task holds the whole search."""
    crows = int(min(65536, max(1024, BLOCK_BYTES // max(1, dims * 8))))
    qrows = int(min(16384, max(256, QUERY_BLOCK_BYTES // max(1, dims * 8))))
    cb = max(1, math.ceil(n_corpus / crows))
    qb = max(1, math.ceil(n_queries / qrows))
    target = max(2, 2 * parallelism)
    if cb * qb < target:
        cb = max(cb, min(math.ceil(math.sqrt(target)), max(1, n_corpus)))
        qb = max(qb, min(math.ceil(target / cb), max(1, n_queries)))
    return qb, cb


def knn_batch(queries: DataFrame, corpus: DataFrame, k: int = 10, *, exclude: str | None = None,
              qid: str = "qid", qvec: str = "qvec", id: str = "id", vec: str = "embedding",
              qgroup: str | None = None, group: str | None = None,
              digits: int = DIST_DIGITS, blocks: tuple[int, int] | None = None,
              decode=None, dims: int | None = None, strategy: str = "auto") -> DataFrame:
    """Exact cosine top-k for every query: ``qid, id, distance, rank``.

    ``exclude="self"`` drops ``id == qid``; ``exclude="group"`` drops rows whose
    ``group`` equals the query's ``qgroup`` (e.g. a different document only).

    ``strategy="auto"`` broadcasts the question matrix when its size is within
    ``BROADCAST_QUERY_BYTES`` and scans the corpus where it lies (no corpus
    shuffle). Larger question sets stay where they lie while the corpus is sent to them in at most ``ROUNDS`` parts of
    ``BLOCK_BYTES`` (``"rounds"``); beyond that blocks of both sides meet (``"blocks"``).
    """
    spark = queries.sparkSession
    if strategy in ("auto", "broadcast", "rounds") and blocks is None:
        if dims is None:
            first = corpus.select(F.size(vec).alias("d")).limit(1).collect()
            dims = first[0]["d"] if first else 1
        if strategy == "broadcast" or (strategy == "auto" and fits_broadcast(queries, dims)):
            return _knn_broadcast(queries, corpus, k, exclude, qid, qvec, id, vec, qgroup, group, digits, decode)
    q, c = _prepare(queries, corpus, exclude, qid, qvec, id, vec, qgroup, group)
    if strategy in ("auto", "rounds") and blocks is None:
        c = stored(c, "knn_rows")
        rounds = max(1, math.ceil(c.count() * max(1, dims or 1) * 4 / BLOCK_BYTES))
        if strategy == "rounds" or rounds <= ROUNDS:
            return _knn_rounds(q, c, rounds, k, exclude, digits, decode)
    if blocks is None:
        n_q = queries.count()
        n_c = c.count()
        if dims is None:
            first = corpus.select(F.size(vec).alias("d")).limit(1).collect()
            dims = first[0]["d"] if first else 1
        blocks = block_counts(n_q, n_c, dims, spark.sparkContext.defaultParallelism)
    qb, cb = blocks
    q = (q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int"))
         .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1)))))
    c = (c.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(cb)).cast("int"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))))
    local = block_topk(q, c, ["qb", "cb"], k, exclude, digits, decode)
    return top_k_per_query(local, k, "distance")


def fits_broadcast(queries: DataFrame, dims: int, budget: int = BROADCAST_QUERY_BYTES) -> bool:
    """Whether the question matrix is within ``budget`` bytes; reads at most one row past it."""
    cap = max(1, budget // (max(1, dims) * 8))
    return queries.limit(cap + 1).count() <= cap


def _knn_broadcast(queries, corpus, k, exclude, qid, qvec, id, vec, qgroup, group, digits, decode) -> DataFrame:
    """Questions as a broadcast matrix (size checked by the caller); every corpus partition
    keeps a running top-k per question over its Arrow batches and emits it once."""
    spark = queries.sparkSession
    q, c = _prepare(queries, corpus, exclude, qid, qvec, id, vec, qgroup, group)
    qpdf = q.toPandas()  # bounded: n_questions × dims × 8 <= BROADCAST_QUERY_BYTES
    grouped = exclude == "group"
    vectors = _stack(qpdf["qvec"].to_numpy(), decode) if len(qpdf) else np.zeros((0, 1))
    sent = spark.sparkContext.broadcast((vectors, qpdf["qid"].to_numpy(np.int64), qpdf["qgrp"].to_numpy() if grouped else None))

    def run(batches):
        vectors, qids, groups = sent.value
        best = TopK(vectors, qids, k, exclude, digits, groups)
        for pdf in batches:
            if len(pdf) and len(qids):
                best.add(_stack(pdf["vec"].to_numpy(), decode), pdf["id"].to_numpy(np.int64), pdf["grp"].to_numpy() if grouped else None)
        yield best.frame()

    # A task goes through several partitions with one set of heaps: what is merged is k rows per question and task, and
    # there are two tasks per core however many partitions the table has.
    tasks = 2 * spark.sparkContext.defaultParallelism
    local = c.coalesce(tasks).mapInPandas(run, TOPK_SCHEMA)
    return top_k_per_query(local, k, "distance")


def _knn_rounds(q: DataFrame, c: DataFrame, rounds: int, k: int, exclude: str | None, digits: int, decode) -> DataFrame:
    """The stored corpus ``id, vec`` is sent to the questions in parts of about ``BLOCK_BYTES``; no vector is shuffled more than once, and
    ``k`` rows a question and part are."""
    spark, grouped = q.sparkSession, exclude == "group"
    q = stored(q.repartition(2 * spark.sparkContext.defaultParallelism), "knn_questions")

    def part(n: int):
        rows = c.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == n).toPandas()  # bounded: about ``BLOCK_BYTES``
        values = rows["vec"].to_numpy()
        vectors = np.vstack(values if decode is None else [decode(v) for v in values]) if len(rows) else np.zeros((0, 1))
        return spark.sparkContext.broadcast((vectors, rows["id"].to_numpy(np.int64), rows["grp"].to_numpy() if grouped else None))

    def scan(sent):
        def run(batches):
            vectors, ids, groups = sent.value
            ready = unit_rows(vectors)
            for b in batches:
                if len(b) and len(ids):
                    best = TopK(_stack(b["qvec"].to_numpy(), decode), b["qid"].to_numpy(np.int64), k, exclude, digits,
                                b["qgrp"].to_numpy() if grouped else None)
                    best.add(vectors, ids, groups, ready=ready)
                    yield best.frame()
        return run

    local = [q.mapInPandas(scan(part(n)), TOPK_SCHEMA) for n in range(rounds)]
    return top_k_per_query(reduce(DataFrame.unionByName, local), k, "distance")


def _prepare(queries, corpus, exclude, qid, qvec, id, vec, qgroup, group):
    qcols = [F.col(qid).cast("long").alias("qid"), F.col(qvec).alias("qvec")]
    ccols = [F.col(id).cast("long").alias("id"), F.col(vec).alias("vec")]
    if exclude == "group":
        qcols.append(F.col(qgroup).cast("string").alias("qgrp"))
        ccols.append(F.col(group).cast("string").alias("grp"))
    return queries.select(*qcols), corpus.select(*ccols)


def block_topk(q: DataFrame, c: DataFrame, keys: list[str], k: int, exclude: str | None = None,
               digits: int = DIST_DIGITS, decode=None) -> DataFrame:
    """Local top-k of every group of ``keys``: queries ``qid, qvec`` meet corpus rows ``id, vec``
    that share the key (cogroup, one numpy product per group). ``decode`` turns stored
    vectors (e.g. half precision bytes) into arrays inside the worker."""
    return (q.groupBy(*keys).cogroup(c.groupBy(*keys))
            .applyInPandas(_block_topk(k, exclude, digits, decode), TOPK_SCHEMA))


def top_k_per_query(df: DataFrame, k: int, score: str, descending: bool = False,
                    key: str = "qid", rank: str = "rank") -> DataFrame:
    """``row_number() <= k`` per query, ties to the lower id; ``rank`` is a bigint."""
    order = F.col(score).desc() if descending else F.col(score).asc()
    w = Window.partitionBy(key).orderBy(order, F.col("id").asc())
    return (df.withColumn(rank, F.row_number().over(w))
            .where(F.col(rank) <= k)
            .withColumn(rank, F.col(rank).cast("long")))


def closest_per_source(corpus: DataFrame, query_vec: Column) -> DataFrame:
    """Smallest distance from one query vector to each document."""
    return (corpus.select("source", "embedding", query_vec.alias("_q"))
            .select("source", rounded(cosine_distance("embedding", "_q")).alias("d"))
            .groupBy("source").agg(F.min("d").alias("closest_distance")))


def nearest_other_source(corpus: DataFrame) -> DataFrame:
    """For each document's first chunk, the document of the closest chunk from a *different* document.

    The correlated TOP 1 with ``<>`` is expressed as a batched top-1 with a group exclusion."""
    # First chunk per document by aggregation (partial per partition), not a per-document sort.
    first = (corpus.groupBy("source").agg(F.min_by(F.struct("id", "embedding"), "id").alias("_f"))
             .select(F.col("_f.id").alias("qid"), F.col("source").alias("qsource"), F.col("_f.embedding").alias("qvec")))
    hits = knn_batch(first, corpus, 1, exclude="group", qgroup="qsource", group="source")
    names = corpus.select(F.col("id"), F.col("source").alias("closest_other_document"))
    return (first.select("qid", F.col("qsource").alias("source"))
            .join(hits.select("qid", "id"), "qid", "left")
            .join(names, "id", "left")
            .select("source", "closest_other_document"))


def topic_shift(corpus: DataFrame, n: int = 10) -> DataFrame:
    """Distance between each chunk and the previous chunk of the same document; the n largest.

    Position and previous vector come from ``sequence_context`` (no self-joins by id, and
    no window that holds a whole document)."""
    from lodestar.operators.sequence import sequence_context
    seq = sequence_context(corpus.select("source", "id", "embedding"), "source", ["id"], ["embedding"], 1)
    ordered = (seq.where(F.size("history") == 1)
               .select("source", "position", "embedding", F.col("history")[0]["embedding"].alias("prev")))
    return (ordered.select("source", "position",
                           rounded(cosine_distance("embedding", "prev")).alias("shift_from_previous_chunk"))
            .orderBy(F.col("shift_from_previous_chunk").desc(), "source", "position").limit(n))
