"""Approximate search over a cell index (inverted-file layout).

Build: ``pyspark.ml`` KMeans (cosine) assigns every vector to a cell; the table is
written ``partitionBy("cell")`` and every cell is cut into blocks of bounded
size (``blk``) so a hot cell is spread over several tasks. The centroids
(cells × dims, size-checked) are the only thing kept outside the table.

Search: each query's ``nprobe`` nearest cells come from an Arrow UDF that holds
the centroids; the probed cells prune the index scan (partition filter through
a semi-join on the small set of probed cells), queries meet the rows of their
cells block by block in a ``cogroup`` with the same numpy kernel as exact search,
and ``row_number() <= k`` merges.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.config import ANN_MIN_ROWS, BLOCK_BYTES, DIST_DIGITS, DISTANCES, MAX_CENTROID_BYTES, QUERY_BLOCK_BYTES
from lodestar.operators.knn import ROUNDS, TOPK_SCHEMA, TopK, _stack, fits_broadcast, knn_batch, stored, top_k_per_query, unit_rows


@dataclass
class CellIndex:
    path: str
    centroids: np.ndarray  # cells × dims, unit rows
    radii: np.ndarray | None = None  # per cell: largest distance of a (unit) row to its centroid

    @property
    def cells(self) -> int:
        return int(self.centroids.shape[0])


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def build_cell_index(corpus: DataFrame, path: str, *, n_cells: int | None = None, min_rows: int = ANN_MIN_ROWS,
                     seed: int = 7, max_iter: int = 10, id: str = "id", vec: str = "embedding",
                     train_rows: int = 1_000_000) -> CellIndex | None:
    """Write the cell index of ``corpus`` (``id, embedding``) under ``path``.

    Returns None below ``min_rows`` rows: such a table is searched exactly. Centroids are
    trained on all rows up to ``train_rows`` and on a seeded sample of about that many
    beyond it (each KMeans iteration is a pass over its input); every row is then
    assigned to its nearest centroid, so every row is indexed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = corpus.sparkSession
    n = corpus.count()
    if n < min_rows:
        return None
    first = corpus.select(F.size(vec).alias("d")).limit(1).collect()
    dims = int(first[0]["d"])
    # never more cells than the centroid budget holds; a larger table has larger cells (blocks stay bounded)
    k = min(int(n_cells or max(2, round(math.sqrt(n)))), MAX_CENTROID_BYTES // (dims * 8))
    feats = corpus.select(F.col(id).cast("long").alias("id"), F.col(vec).alias("embedding"),
                          array_to_vector(F.col(vec)).alias("features"))
    train = feats if n <= train_rows else feats.sample(fraction=min(1.0, train_rows / n), seed=seed)
    model = KMeans(k=k, distanceMeasure="cosine", seed=seed, maxIter=max_iter).fit(train)
    centroids = _unit(np.array(model.clusterCenters(), dtype=np.float64))
    assigned = model.transform(feats).select("id", "embedding", F.col("prediction").cast("int").alias("cell"))
    crows = int(min(65536, max(1024, BLOCK_BYTES // max(1, dims * 8))))
    to_centroid = centroid_distance_udf(centroids)
    cells = (assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"),
                                          F.max(to_centroid(F.col("embedding"), F.col("cell"))).alias("radius"))
             .withColumn("nblk", F.ceil(F.col("rows") / F.lit(crows)).cast("int")))
    # ``cells`` has one row per cell (k rows, checked above): a bounded broadcast.
    table = (assigned.join(F.broadcast(cells.select("cell", "nblk")), "cell")
             .withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nblk")).cast("int"))
             .select("id", "embedding", "blk", "cell"))
    table.repartition("cell", "blk").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)],
                          "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    radii = _radii(spark, path, k)
    return CellIndex(path, centroids, radii)


def _radii(spark: SparkSession, path: str, k: int) -> np.ndarray:
    r = np.zeros(k, dtype=np.float64)
    for row in spark.read.parquet(f"{path}/cells").select("cell", "radius").collect():  # one row per cell
        r[row["cell"]] = row["radius"]
    return r


def centroid_distance_udf(centroids: np.ndarray):
    """Arrow UDF: euclidean distance of a unit-scaled vector to the centroid of its cell."""
    cents = _unit(np.asarray(centroids, dtype=np.float64))

    @F.pandas_udf(T.DoubleType())
    def dist(v: pd.Series, cell: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype="float64")
        X = _unit(np.vstack(v.to_numpy()).astype(np.float64))
        C = cents[cell.to_numpy(np.int64)]
        return pd.Series(np.linalg.norm(X - C, axis=1))

    return dist


def load_cell_index(spark: SparkSession, path: str) -> CellIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # cells × dims, bounded at build
    cents = np.array([r["centroid"] for r in rows], dtype=np.float64)
    return CellIndex(path, cents, _radii(spark, path, cents.shape[0]))


def nearest_cells_udf(centroids: np.ndarray, nprobe: int):
    """Arrow UDF: the ``nprobe`` cells whose centroids are closest (cosine) to a vector."""
    cents = _unit(np.asarray(centroids, dtype=np.float64))
    p = min(nprobe, cents.shape[0])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        Q = _unit(np.vstack(v.to_numpy()).astype(np.float64))
        D = np.round(1.0 - Q @ cents.T, DIST_DIGITS)
        order = np.lexsort((np.broadcast_to(np.arange(cents.shape[0]), D.shape), D), axis=1)[:, :p]
        return pd.Series([row.astype(np.int32) for row in order])

    return nearest


def _query_blocks(queries: DataFrame, dims: int) -> int:
    qrows = int(min(16384, max(256, QUERY_BLOCK_BYTES // max(1, dims * 8))))
    return max(1, math.ceil(queries.count() / qrows))


def _by_cell(cells) -> dict[int, np.ndarray]:
    """Of the cells that each question probes: the questions (their places) by cell."""
    lens = np.array([len(c) for c in cells], dtype=np.int64)
    if not lens.sum():
        return {}
    flat = np.concatenate([np.asarray(c, dtype=np.int64) for c in cells])
    order = np.argsort(flat, kind="stable")
    found, starts = np.unique(flat[order], return_index=True)
    return dict(zip(found.tolist(), np.split(np.repeat(np.arange(len(lens)), lens)[order], starts[1:])))


def _cells_topk(qids, Qm, by_cell: dict, batches, k: int, exclude: str | None, digits: int) -> pd.DataFrame:
    """Top-k of the questions among the rows (``cell, id, vec``) of the cells that they probe."""
    best = TopK(Qm, qids, k, exclude, digits)
    for batch in batches:
        for cell, grp in batch.groupby("cell", sort=False):
            qi = by_cell.get(int(cell))
            if qi is not None:
                best.add(_stack(grp["vec"].to_numpy(), None), grp["id"].to_numpy(np.int64), rows=qi)
    return best.frame()


def cell_groups(sizes: list[tuple[int, int, int]], rows: int) -> list[tuple[int, int, int]]:
    """Neighbouring cells put together up to ``rows`` rows: ``(cell, grp, parts)`` from ``(cell, rows, nblk)``. A cell cut into
    several blocks is a group of its own with as many parts."""
    out, grp, held = [], -1, rows
    for cell, n, nblk in sorted(sizes):
        if nblk > 1 or held + n > rows:
            grp, held = grp + 1, 0
        out.append((cell, grp, nblk))
        held = rows if nblk > 1 else held + n
    return out


def _probe(asked: DataFrame, index: CellIndex, k: int, exclude: str | None, qb: int, digits: int) -> DataFrame:
    """Local top-k of questions ``qid, qvec, cells`` against the rows of those cells. A block of questions meets a group of cells
    of bounded size in one task, so a question's vector is sent once per group and not once per cell."""
    spark = asked.sparkSession
    crows = int(min(65536, max(1024, BLOCK_BYTES // max(1, index.centroids.shape[1] * 8))))
    sizes = [(r["cell"], r["rows"], r["nblk"]) for r in spark.read.parquet(f"{index.path}/cells").collect()]  # one row per cell
    members = cell_groups(sizes, crows)
    group_of = {cell: (grp, parts) for cell, grp, parts in members}

    def deal(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                mine: dict = {}
                for cell in r.cells:
                    mine.setdefault(group_of[int(cell)], []).append(int(cell))
                out += [(r.qid, r.qvec, grp, part, cells) for (grp, parts), cells in mine.items() for part in range(parts)]
            yield pd.DataFrame(out, columns=["qid", "qvec", "grp", "part", "cells"])

    numbers = asked.schema["qvec"].dataType.simpleString()
    q = (asked.where("qvec is not null").mapInPandas(deal, f"qid long, qvec {numbers}, grp int, part int, cells array<int>")
         .withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int")))
    # The probed cells are at most the number of cells (bounded at build): as a literal
    # IN list they become a partition filter, so unprobed cell folders are never read.
    probed = [r["cell"] for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]
    groups = F.broadcast(spark.createDataFrame(members, "cell int, grp int, parts int").select("cell", "grp"))  # one row per cell
    rows = (spark.read.parquet(f"{index.path}/rows").where(F.col("cell").isin(probed)).join(groups, "cell")
            .select("grp", F.col("blk").alias("part"), "cell", "id", F.col("embedding").alias("vec"))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))))

    def meet(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(rs):
            return pd.DataFrame({"qid": [], "id": [], "distance": []})
        Q = _stack(qs["qvec"].to_numpy(), None)
        return _cells_topk(qs["qid"].to_numpy(np.int64), Q, _by_cell(qs["cells"]), [rs], k, exclude, digits)

    keys = ["qb", "grp", "part"]
    return q.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(meet, TOPK_SCHEMA)


def _probe_broadcast(qc: DataFrame, index: CellIndex, k: int, exclude: str | None, digits: int) -> DataFrame:
    """Local top-k of questions ``qid, qvec, cells`` broadcast to a scan of the probed cells only.

    Each task groups its rows by cell and scores them against the questions that probe
    that cell; the index is read in place (no shuffle of its rows)."""
    spark = qc.sparkSession
    pdf = qc.toPandas()  # bounded by the caller: questions × (dims + cells) × 8 <= BROADCAST_QUERY_BYTES
    if len(pdf) == 0:
        return spark.createDataFrame([], TOPK_SCHEMA)
    by_cell = _by_cell(pdf["cells"])
    if not by_cell:
        return spark.createDataFrame([], TOPK_SCHEMA)
    Q = _stack(pdf["qvec"].to_numpy(), None)
    bq = spark.sparkContext.broadcast((pdf["qid"].to_numpy(np.int64), Q, by_cell))
    rows = (spark.read.parquet(f"{index.path}/rows").where(F.col("cell").isin(list(by_cell)))
            .select("cell", "id", F.col("embedding").alias("vec")))

    def run(batches):
        yield _cells_topk(*bq.value, batches, k, exclude, digits)

    return rows.mapInPandas(run, TOPK_SCHEMA)


def _probe_rounds(q: DataFrame, index: CellIndex, k: int, exclude: str | None, digits: int, opens, parts: list[list[int]]) -> DataFrame:
    """Local top-k of questions (``qid, qvec`` and what ``opens`` reads) where the cells are sent to the questions in ``parts``. Which cells
    a question opens is found where it lies, so neither its cells nor its vector are sent on."""
    spark = q.sparkSession
    n_cells = index.cells
    table = spark.read.parquet(f"{index.path}/rows").select("cell", "id", F.col("embedding").alias("vec"))

    def part(cells: list[int]):
        rows = table.where(F.col("cell").isin(cells)).toPandas().sort_values("cell", kind="stable")  # about ``BLOCK_BYTES``
        cell, first = np.unique(rows["cell"].to_numpy(), return_index=True)
        vectors = np.vstack(rows["vec"].to_numpy()) if len(rows) else np.zeros((0, 1))
        return spark.sparkContext.broadcast((vectors, rows["id"].to_numpy(np.int64), cell, np.r_[first, len(rows)].astype(np.int64)))

    def scan(sent):
        def run(batches):
            vectors, ids, cells, first = sent.value
            norm, unit = unit_rows(vectors)
            for b in batches:
                if not len(b):
                    continue
                best = TopK(_stack(b["qvec"].to_numpy(), None), b["qid"].to_numpy(np.int64), k, exclude, digits)
                if "kth" in b:
                    best.at_most(b["kth"].to_numpy(np.float64))
                step = max(1, DISTANCES // n_cells)
                for lo in range(0, len(b), step):
                    met = opens(b.iloc[lo:lo + step])[:, cells]
                    for n in np.flatnonzero(met.any(axis=0)):
                        x, y = first[n], first[n + 1]
                        best.add(vectors[x:y], ids[x:y], rows=lo + np.flatnonzero(met[:, n]), ready=(norm[x:y], unit[x:y]))
                yield best.frame()
        return run

    return reduce(DataFrame.unionByName, [q.mapInPandas(scan(part(cells)), TOPK_SCHEMA) for cells in parts])


def _in_rounds(spark: SparkSession, index: CellIndex) -> list[list[int]] | None:
    """The cells in parts of about ``BLOCK_BYTES``, None where these are more than ``ROUNDS``."""
    most = BLOCK_BYTES // (index.centroids.shape[1] * 4)
    sizes = [(r["cell"], r["rows"], 1) for r in spark.read.parquet(f"{index.path}/cells").collect()]  # one row per cell
    if max((n for _, n, _ in sizes), default=0) > 2 * most:
        return None
    parts: dict[int, list[int]] = {}
    for cell, grp, _ in cell_groups(sizes, most):
        parts.setdefault(grp, []).append(cell)
    return list(parts.values()) if 0 < len(parts) <= ROUNDS else None


def cell_search(queries: DataFrame, index: CellIndex, k: int = 10, *, nprobe: int = 4, exclude: str | None = None,
                qid: str = "qid", qvec: str = "qvec", digits: int = DIST_DIGITS, exact: bool = False,
                strategy: str = "auto") -> DataFrame:
    """Top-k per query from the ``nprobe`` nearest cells: ``qid, id, distance, rank``.

    ``exact=True`` adds a second pass that makes the result equal to exact search:
    with unit vectors, cosine distance = |q - x|² / 2, and every row of a cell lies
    within its radius r of the centroid c, so no row of a cell is closer than
    (max(0, |q - c| - r))² / 2. Every unprobed cell whose bound is not above the
    query's k-th distance from the first pass is scanned too.

    ``strategy="auto"`` broadcasts the questions with their cells when both are
    within ``BROADCAST_QUERY_BYTES`` (the index is scanned in place);
    otherwise the cells are sent to the questions in at most ``ROUNDS`` parts (``"rounds"``), and beyond that
    questions and cell blocks meet in a ``cogroup`` (``"blocks"``)."""
    q = queries.select(F.col(qid).cast("long").alias("qid"), F.col(qvec).alias("qvec"))
    dims = index.centroids.shape[1]
    broadcast = strategy == "broadcast" or (strategy == "auto" and fits_broadcast(q, dims + index.cells))
    parts = _in_rounds(q.sparkSession, index) if strategy == "rounds" or (strategy == "auto" and not broadcast) else None
    if parts:
        q = stored(q.where("qvec is not null").repartition(2 * q.sparkSession.sparkContext.defaultParallelism), "cell_questions")
    qb = 1 if broadcast or parts else _query_blocks(q, dims)
    nearest = nearest_cells_udf(index.centroids, nprobe)

    def probe(with_cells: DataFrame) -> DataFrame:
        if broadcast:
            return _probe_broadcast(with_cells, index, k, exclude, digits)
        return _probe(with_cells, index, k, exclude, qb, digits)

    if parts:
        first = _probe_rounds(q, index, k, exclude, digits, opened_cells(index.centroids, nprobe), parts)
    else:
        first = probe(q.withColumn("cells", nearest(F.col("qvec"))))
    top = top_k_per_query(first, k, "distance")
    if not exact:
        return top
    if index.radii is None:
        raise ValueError("the index has no cell radii; rebuild it for exact search")
    top = top.checkpoint()  # questions × k rows, read twice below
    kth = top.groupBy("qid").agg(F.max("distance").alias("_dk"), F.count(F.lit(1)).alias("_n"))
    bound = F.when(F.col("_n") >= k, F.col("_dk"))  # fewer than k found: every cell may help
    if parts:
        second = q.join(kth, "qid", "left").select("qid", "qvec", bound.alias("kth"))
        more = _probe_rounds(second, index, k, exclude, digits, opened_cells(index.centroids, nprobe, index.radii), parts)
        return top_k_per_query(top.select("qid", "id", "distance").unionByName(more), k, "distance")
    extra_cells = bounded_cells_udf(index.centroids, index.radii, nprobe)
    second = q.join(kth, "qid", "left").withColumn("cells", extra_cells(F.col("qvec"), bound)).select("qid", "qvec", "cells")
    more = probe(second)
    return top_k_per_query(top.select("qid", "id", "distance").unionByName(more), k, "distance")


def bounded_cells_udf(centroids: np.ndarray, radii: np.ndarray, nprobe: int, margin: float = 2e-6):
    """Arrow UDF: cells outside a query's ``nprobe`` nearest whose distance bound does not
    exceed ``kth`` (all of them when ``kth`` is null)."""
    opens = opened_cells(centroids, nprobe, radii, margin)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def extra(v: pd.Series, kth: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        return pd.Series([np.flatnonzero(m).astype(np.int32) for m in opens(pd.DataFrame({"qvec": v, "kth": kth}))])

    return extra


def opened_cells(centroids: np.ndarray, nprobe: int, radii: np.ndarray | None = None, margin: float = 2e-6):
    """A function of rows ``qvec``, or ``qvec, kth`` with ``radii``: which cells (columns) a question opens, its ``nprobe`` nearest ones, or with
    ``radii`` the others whose distance bound does not exceed ``kth`` (all of them when that is null)."""
    cents = _unit(np.asarray(centroids, dtype=np.float64))
    p = min(nprobe, cents.shape[0])

    def opens(rows: pd.DataFrame) -> np.ndarray:
        s = _unit(np.vstack(rows["qvec"].to_numpy()).astype(np.float64)) @ cents.T
        near = np.argsort(np.round(1.0 - s, DIST_DIGITS), axis=1, kind="stable")[:, :p]
        if radii is None:
            out = np.zeros(s.shape, bool)
            np.put_along_axis(out, near, True, axis=1)
            return out
        lower = np.maximum(0.0, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * s)) - np.asarray(radii, dtype=np.float64)[None, :]) ** 2 / 2.0
        out = lower <= rows["kth"].to_numpy(dtype=np.float64, na_value=np.inf)[:, None] + margin
        np.put_along_axis(out, near, False, axis=1)
        return out

    return opens


def vector_top_k(queries: DataFrame, corpus: DataFrame, index: CellIndex | None, k: int = 10, *,
                 nprobe: int = 4, exclude: str | None = None, exact: bool = False) -> tuple[DataFrame, str]:
    """The path choice of the original: approximate when an index exists, exact otherwise
    (``exact=True`` keeps the index but scans every cell that could hold a better row)."""
    if index is None:
        return knn_batch(queries, corpus, k, exclude=exclude), "exact"
    return (cell_search(queries, index, k, nprobe=nprobe, exclude=exclude, exact=exact),
            "exact (cells)" if exact else "approximate")


def recall_at_k(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the true top-k ids that the other method also returned: ``found, total, recall``."""
    hit = truth.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("_hit")), ["qid", "id"], "left")
    return hit.agg(F.count("_hit").alias("found"), F.count(F.lit(1)).alias("total")).withColumn(
        "recall", F.round(F.col("found") / F.col("total"), 4))
