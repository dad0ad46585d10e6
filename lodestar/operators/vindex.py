"""Vector index for whole tables: two levels of centroids, residual codes in several cells per row, exact re-ranking.

Build. A bounded sample (``TRAIN_BYTES``) gives the coarse centroids; their number is bounded by
``MAX_CENTROID_BYTES``, so that matrix may travel to every task. Every row belongs to its ``SPILL`` nearest coarse cells. Each
coarse cell is trained on a bounded sample of its own rows into fine cells, as many as its rows ask for; the fine centroids
are a table and meet the rows in a join on the coarse cell, never on the driver. A row is stored once per
coarse cell as the 8-bit residual to its fine centroid (``dims`` + 16 bytes). A coarse cell with a third of all rows
gets more fine cells and is cut into parts of bounded size.

How many cells a search opens is not guessed: the questions of a sample of the table's own rows are answered exactly,
and ``nprobe`` is the least number of fine cells that holds ``target`` of those neighbours (self-match left out).

Search. Questions rank the fine cells of their coarse cells, open the nearest ``nprobe``, and score the codes there; the
best candidates are re-ranked by their exact distance. Where the fine centroids fit ``FINE_BYTES`` they are sent to every task and a
question carries no list of cells, only the distance of its last one. Since residuals add to the centroid, a
code's distance is the cell's distance less a product with the code: centroids are not read again.

Defined results: rows without a vector or with a vector of norm 0 are not indexed; ties go to the lower id; below ``min_rows``
there is no index (``None``) and the caller searches exactly."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.config import ANN_MIN_ROWS, DISTANCES, DIST_DIGITS, MAX_CENTROID_BYTES, QUERY_BLOCK_BYTES
from lodestar.functions.vectors import cosine_distance
from lodestar.operators.knn import TOPK_SCHEMA, knn_batch, top_k_per_query

ROWS_PER_CELL = 6
SPILL = 3
MAX_FINE = 4096               # fine cells per coarse cell at most; beyond it cells hold more rows
TRAIN_BYTES = 64 << 20        # vectors of one training sample, as doubles
FINE_TRAIN = 16               # sampled rows per fine cell
PART_ROWS = 1 << 16           # rows of a coarse cell that meet questions in one task
ASKED = 256                   # sampled rows whose exact neighbours set nprobe
MARGIN = 0.008                # three standard errors of a share of 0.98 among 256 x 10 neighbours
RERANK = 3                    # candidates per wanted row that get their exact distance
FINE_BYTES = 64 << 20         # fine centroids, as doubles, that are sent to every task of a search
GROUP_ROWS = 1 << 18          # stored rows of small coarse cells that meet questions in one task
BEGIN = 4096                  # stored rows, about, that give a task of a search its first distance to beat
_HASH = 1 << 30


@dataclass
class VectorIndex:
    path: str
    rows: int
    dims: int
    cells: int
    spill: int
    cprobe: int
    nprobe: int
    k: int
    target: float


def _units(values) -> np.ndarray:
    m = np.vstack(values).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)


def _nearest(x: np.ndarray, c: np.ndarray, p: int = 1) -> np.ndarray:
    """Numbers of the ``p`` nearest rows of ``c``, nearest first, in slices of about 8 M products."""
    out = np.empty((len(x), p), np.int32)
    step = max(1, (8 << 20) // max(1, len(c)))
    for lo in range(0, len(x), step):
        s = x[lo:lo + step] @ c.T
        out[lo:lo + step] = np.argsort(-s, axis=1, kind="stable")[:, :p] if p > 1 else s.argmax(1)[:, None]
    return out


def _train(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; a cell that loses all rows keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        a = _nearest(x, c)[:, 0]
        order = np.argsort(a, kind="stable")
        full, starts = np.unique(a[order], return_index=True)
        sums = np.add.reduceat(x[order], starts, axis=0)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        new = c.copy()
        new[full] = np.where(n > 0, sums / np.where(n > 0, n, 1.0), c[full])
        if np.array_equal(new, c):
            break
        c = new
    return c


def _sampled(share, salt: int):
    """About ``share`` (a number or a column) of the rows, the same ones on every reading."""
    share = share if not isinstance(share, float | int) else F.lit(float(share))
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(_HASH)) < share * _HASH


def _coarse(spark: SparkSession, path: str) -> np.ndarray:
    """Bounded: at most ``MAX_CENTROID_BYTES``."""
    rows = spark.read.parquet(f"{path}/coarse").collect()
    return np.array([r["centroid"] for r in sorted(rows, key=lambda r: r["coarse"])], np.float64)


def build_index(corpus: DataFrame, path: str, *, rows_per_cell: int = ROWS_PER_CELL, spill: int = SPILL, k: int = 10, target: float = 0.98,
                min_rows: int = ANN_MIN_ROWS, seed: int = 7) -> VectorIndex | None:
    """Writes the index of ``corpus`` (``id, embedding``) under ``path`` and calibrates it for top-``k``."""
    spark = corpus.sparkSession
    some = F.exists("embedding", lambda x: x != 0)
    corpus.select(F.col("id").cast("long").alias("id"), "embedding").where(F.col("embedding").isNotNull() & some) \
        .write.mode("overwrite").parquet(f"{path}/vectors")
    v = spark.read.parquet(f"{path}/vectors")
    n, dims = v.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if n < min_rows:
        return None
    n_coarse = max(2, min(round(math.sqrt(n / rows_per_cell)), MAX_CENTROID_BYTES // (dims * 8)))
    budget = TRAIN_BYTES // (dims * 8)

    def train_coarse(batches):
        x = [_units(b["embedding"].to_numpy()) for b in batches if len(b)]
        c = _train(np.vstack(x), n_coarse, seed) if x else np.zeros((0, 1))
        yield pd.DataFrame({"coarse": np.arange(len(c), dtype=np.int32), "centroid": list(c)})

    # the sample meets in one task, in the order of the table; the table is read by many
    place = ["_metadata.file_path", "_metadata.row_index"]
    sample = v.select("id", "embedding", *[F.col(c).alias(f"_{n}") for n, c in enumerate(place)])
    sample = sample.where(_sampled(min(1.0, min(64 * n_coarse, budget) / n), 1)).repartition(1).sortWithinPartitions("_0", "_1")
    sample = sample.select("id", "embedding")
    sample.mapInPandas(train_coarse, "coarse int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/coarse")
    centers = _coarse(spark, path)
    spill = min(spill, len(centers))
    sent = spark.sparkContext.broadcast(centers)

    def nearest(batches):
        for b in batches:
            if len(b):
                yield b.assign(near=list(_nearest(_units(b["embedding"].to_numpy()), sent.value, spill)))

    v.mapInPandas(nearest, "id long, embedding array<float>, near array<int>").write.mode("overwrite").parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed").select("id", "embedding", F.explode("near").alias("coarse"))
    sizes = sorted((r["coarse"], r["count"]) for r in placed.groupBy("coarse").count().collect())  # one row per coarse cell
    fine = [max(1, min(MAX_FINE, round(c / (rows_per_cell * spill)))) for _, c in sizes]
    first = np.cumsum([0, *fine]).tolist()
    groups = [(g, c, f, a, -(-c // PART_ROWS), min(1.0, min(FINE_TRAIN * f, budget) / c)) for (g, c), f, a in zip(sizes, fine, first)]
    spark.createDataFrame(groups, "coarse int, rows long, cells int, first int, parts int, share double") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    grouped = placed.join(F.broadcast(groups), "coarse")  # one row per coarse cell: bounded

    def train_fine(rows: pd.DataFrame) -> pd.DataFrame:
        c = _train(_units(rows["embedding"].to_numpy()), int(rows["cells"].iloc[0]), seed)
        return pd.DataFrame({"coarse": rows["coarse"].iloc[0], "cell": rows["first"].iloc[0] + np.arange(len(c)), "centroid": list(c)})

    least = F.col("rows") * F.col("share") < 2  # a cell of a few rows is trained on all of them
    grouped.where(_sampled(F.when(least, F.lit(1.0)).otherwise(F.col("share")), 2)).groupBy("coarse") \
        .applyInPandas(train_fine, "coarse int, cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/fine")
    centroids = spark.read.parquet(f"{path}/fine")

    def code(rows: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"coarse": [], "part": [], "cell": [], "id": [], "scale": [], "code": []})
        if not len(rows) or not len(cells):
            return empty
        x, c = _units(rows["embedding"].to_numpy()), np.vstack(cells["centroid"].to_numpy())
        a = _nearest(x, c)[:, 0]
        r = x - c[a]
        scale = np.maximum(np.abs(r).max(1), 1e-12) / 127
        q = np.rint(r / scale[:, None]).astype(np.int8)
        out = pd.DataFrame({"coarse": rows["coarse"].to_numpy(), "part": rows["part"].to_numpy(), "cell": cells["cell"].to_numpy()[a],
                            "id": rows["id"].to_numpy(), "scale": scale, "code": [x.tobytes() for x in q]})
        return out.sort_values(["cell", "id"])

    parts = grouped.select("coarse", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "embedding")
    spread = centroids.join(F.broadcast(groups.select("coarse", "parts")), "coarse").select(
        "coarse", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cell", "centroid")
    coded = parts.groupBy("coarse", "part").cogroup(spread.groupBy("coarse", "part")).applyInPandas(
        code, "coarse int, part int, cell int, id long, scale double, code binary")
    coded.write.mode("overwrite").partitionBy("coarse").parquet(f"{path}/rows")
    sent.destroy()
    cells = centroids.count()
    cprobe, nprobe = _calibrate(spark, path, centers, cells, k, min(1.0, target + MARGIN), n)
    index = VectorIndex(path, n, dims, cells, spill, cprobe, nprobe, k, target)
    spark.createDataFrame([tuple(asdict(index).values())], "path string, rows long, dims int, cells int, spill int, cprobe int, "
                          "nprobe int, k int, target double").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(**spark.read.parquet(f"{path}/meta").first().asDict() | {"path": path})


def index_rows(spark: SparkSession, index: VectorIndex) -> DataFrame:
    """``coarse, part, cell, id, scale, code``: the stored copies."""
    return spark.read.parquet(f"{index.path}/rows")


def _calibrate(spark, path, centers, cells, k, target, n) -> tuple[int, int]:
    """(coarse cells, fine cells) that hold ``target`` of the true neighbours of a sample of rows."""
    v = spark.read.parquet(f"{path}/vectors")
    asked = v.where(_sampled(min(1.0, ASKED / n), 3)).select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    truth = knn_batch(asked, v, k, exclude="self").select("qid", "id").join(asked, "qid")
    copies = truth.join(spark.read.parquet(f"{path}/rows").select("id", "cell"), "id")
    met = copies.join(spark.read.parquet(f"{path}/fine"), "cell").select("qid", "id", "coarse", cosine_distance("qvec", "centroid").alias("d"))
    best = met.groupBy("qid", "id").agg(F.min(F.struct("d", "coarse")).alias("b")).select("qid", "id", "b.d", "b.coarse").toPandas()  # ASKED x k rows
    if not len(best):
        return len(centers), cells
    q = asked.toPandas()  # ASKED rows
    qm = _units(q["qvec"].to_numpy())
    at = np.searchsorted(np.sort(q["qid"].to_numpy()), best["qid"].to_numpy())
    row = np.argsort(q["qid"].to_numpy(), kind="stable")[at]
    limit = best["d"].to_numpy()
    sent = spark.sparkContext.broadcast((qm, row, limit))

    def closer(batches):
        m, r, lim = sent.value
        total = np.zeros(len(r), np.int64)
        for b in batches:
            if len(b):
                d = np.sort(1.0 - m @ np.vstack(b["centroid"].to_numpy()).T, axis=1)
                for i in np.unique(r):
                    mine = np.flatnonzero(r == i)
                    total[mine] += np.searchsorted(d[i], lim[mine] - 1e-9)
        yield pd.DataFrame({"pair": np.arange(len(r)), "n": total})

    fine = spark.read.parquet(f"{path}/fine").select("centroid")
    ranks = fine.mapInPandas(closer, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    ranks = ranks.set_index("pair")["n"].reindex(range(len(best))).to_numpy()
    nprobe = int(np.sort(ranks)[min(len(ranks), math.ceil(target * len(ranks))) - 1]) + 1
    order = np.argsort(np.argsort(-(qm @ centers.T), axis=1, kind="stable"), axis=1, kind="stable")
    held = ranks < nprobe
    cprobe = int(order[row[held], best["coarse"].to_numpy()[held]].max()) + 1
    sent.destroy()
    return min(cprobe, len(centers)), min(nprobe, cells)


def search(queries: DataFrame, index: VectorIndex, k: int | None = None, *, nprobe: int | None = None, exclude_self: bool = False,
           qid: str = "qid", qvec: str = "qvec", rerank: int = RERANK, digits: int = DIST_DIGITS) -> DataFrame:
    """Top-k of every question: ``qid, id, distance, rank`` with exact distances of the rows found."""
    spark = queries.sparkSession
    k, nprobe = k or index.k, nprobe or index.nprobe
    q = queries.select(F.col(qid).cast("long").alias("qid"), F.col(qvec).alias("qvec")).where("qvec is not null")
    blocks = max(1, math.ceil(q.count() / max(256, QUERY_BLOCK_BYTES // (index.dims * 8))))
    sent = spark.sparkContext.broadcast(_coarse(spark, index.path))
    cprobe = index.cprobe if nprobe <= index.nprobe else len(sent.value)
    want = k * rerank + (1 if exclude_self else 0)
    by_limits = index.cells * index.dims * 8 <= FINE_BYTES
    near = (_near_by_limits if by_limits else _near_by_lists)(q, index, sent, blocks, cprobe, nprobe, want)
    near = near.repartition("qid").groupBy("qid", "id").agg(F.min("distance").alias("distance"))
    if exclude_self:
        near = near.where("qid <> id")
    near = top_k_per_query(near, k * rerank, "distance").select("qid", "id")
    exact = near.join(spark.read.parquet(f"{index.path}/vectors"), "id").join(q, "qid")
    exact = exact.select("qid", "id", (F.round(cosine_distance("embedding", "qvec"), digits) + F.lit(0.0)).alias("distance"))
    return top_k_per_query(exact, k, "distance")


def _scan_groups(spark: SparkSession, index: VectorIndex) -> list[tuple[int, int, int]]:
    """(coarse, part, group): coarse cells side by side in groups of at most ``GROUP_ROWS`` rows, as many at least as there are cores."""
    cells = sorted((r["coarse"], r["rows"], r["parts"]) for r in spark.read.parquet(f"{index.path}/groups").collect())  # one row per coarse cell
    most = min(GROUP_ROWS, -(-sum(c[1] for c in cells) // spark.sparkContext.defaultParallelism))
    out, group, held = [], 0, 0
    for coarse, rows, parts in cells:
        for part in range(parts):
            if held and held + rows // parts > most:
                group, held = group + 1, 0
            out.append((coarse, part, group))
            held += rows // parts
    return out


def _near_by_limits(q: DataFrame, index: VectorIndex, sent, blocks: int, cprobe: int, nprobe: int, want: int) -> DataFrame:
    """The ``want`` nearest codes of every question and group of coarse cells, in the cells that the question opens: ``qid, id,
    distance``. Which these are follows from the distance of the last one, so no (question, cell) pair is a row."""
    spark = q.sparkSession
    fine = spark.read.parquet(f"{index.path}/fine").orderBy("cell").toArrow()  # bounded by ``FINE_BYTES``
    centers = fine["centroid"].combine_chunks().flatten().to_numpy().reshape(fine.num_rows, -1)
    placed = _scan_groups(spark, index)
    groups = max((g for _, _, g in placed), default=0) + 1
    told = spark.sparkContext.broadcast((fine["cell"].to_numpy(), fine["coarse"].to_numpy(), centers, placed))
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")
    some = cprobe < len(sent.value)

    def allowed(m: np.ndarray) -> np.ndarray:
        """Which coarse cells a question opens cells of."""
        out = np.zeros((len(m), len(sent.value)), bool)
        np.put_along_axis(out, _nearest(m, sent.value, cprobe), True, axis=1)
        return out

    def limits(batches):
        cell, coarse, c, placed = told.value
        starts = np.r_[0, np.flatnonzero(np.diff(coarse)) + 1]
        seen = {int(x): n for n, x in enumerate(coarse[starts])}
        of = [(seen[x], g) for x, _, g in placed if x in seen]
        step = max(1, DISTANCES // len(cell))
        for b in batches:
            far, visits = np.zeros(len(b)), []
            for lo in range(0, len(b), step):
                m = _units(b["qvec"].iloc[lo:lo + step].to_numpy())
                d = 1.0 - m @ c.T
                if some:
                    d[~allowed(m)[:, coarse]] = np.inf
                last = np.minimum(-(-nprobe // b["copies"].iloc[lo:lo + step].to_numpy()), len(cell)) - 1
                far[lo:lo + step] = np.partition(d, np.unique(last), axis=1)[np.arange(len(m)), last] + 1e-9
                met = np.logical_or.reduceat((d <= far[lo:lo + step, None]) & np.isfinite(d), starts, axis=1)
                to = np.zeros((len(m), groups), bool)
                for at, g in of:
                    to[:, g] |= met[:, at]
                visits += [np.flatnonzero(x) for x in to]
            yield b.assign(far=far, grp=visits)

    def scan(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(rs):
            return pd.DataFrame({"qid": [], "id": [], "distance": []})
        numbers, coarse, c, _ = told.value
        m, qids, far = _units(qs["qvec"].to_numpy()), qs["qid"].to_numpy(), qs["far"].to_numpy()
        m32 = m.astype(np.float32)
        rs = rs.sort_values("cell", kind="stable")
        codes = np.frombuffer(b"".join(rs["code"]), np.int8).reshape(len(rs), -1)
        scale, ids, cell = rs["scale"].to_numpy(np.float32), rs["id"].to_numpy(), rs["cell"].to_numpy()
        cells, first = np.unique(cell, return_index=True)
        last, at = np.r_[first[1:], len(cell)], np.searchsorted(numbers, cells)
        opens = allowed(m) if some else None
        least = np.full(len(qs), np.inf, np.float32)  # the distance to beat
        alone = qs["copies"].to_numpy() == 1  # rows of one question share candidates by coarse cells: each of them needs the best of every one
        place = np.repeat(np.arange(len(cells)), last - first)
        once = not pd.DataFrame({"coarse": coarse[at[place]], "id": ids}).duplicated().any()

        def inside(w, n):
            """Distances of cells and questions, and whether a question opens the cell."""
            d = 1.0 - c[at[n]] @ m[w].T
            open_ = d <= far[w]
            return d, open_ & opens[w][:, coarse[at[n]]].T if some else open_

        # a first distance to beat, from some of the cells: ``want`` rows of these lie no farther
        n = np.arange(len(cells))[::max(1, len(rs) // BEGIN)]
        rows = np.concatenate([np.arange(first[x], last[x]) for x in n])
        rows = np.sort(rows[np.unique(ids[rows], return_index=True)[1]])
        to, sampled = np.searchsorted(n, place[rows]), codes[rows].astype(np.float32) * scale[rows, None]
        step = max(1, DISTANCES // max(1, len(rows)))
        begun = np.flatnonzero(alone) if len(rows) >= want else np.zeros(0, np.int64)
        for lo in range(0, len(begun), step):
            w = begun[lo:lo + step]
            d, open_ = inside(w, n)
            s = np.where(open_, d, np.inf).astype(np.float32).T[:, to] - m32[w] @ sampled.T
            least[w] = np.partition(s, want - 1, axis=1)[:, want - 1] + np.float32(1e-5)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        share = -(-want // qs["copies"].to_numpy())
        out, cut, found, held, waits = none, [], [], 0, 0

        def joined(parts):
            return (np.concatenate([x[n] for x in parts]) for n in range(3))

        def nearest(w, i, d, most):
            """The first ``most`` entries of every question, and where the last of them stands."""
            o = np.lexsort((i, d, w))
            w, i, d = w[o], i[o], d[o]
            starts = np.r_[0, np.flatnonzero(np.diff(w)) + 1]
            place = np.arange(len(w)) - np.repeat(starts, np.diff(np.r_[starts, len(w)]))
            keep, last = place < most[w], place == most[w] - 1
            return (w[keep], i[keep], d[keep]), (w[last], d[last])

        def fold():
            """The entries of one coarse cell, each copy for itself."""
            nonlocal found, held, waits
            one, (q, far_) = nearest(*joined(found), share)
            if once:  # as many rows lie no farther
                q, far_ = q[alone[q]], far_[alone[q]]
                least[q] = np.minimum(least[q], far_)
            cut.append(one)
            found, held, waits = [], 0, waits + len(one[0])

        def merge():
            """The rows of all coarse cells so far: a row that lies in several counts once, by its least distance."""
            nonlocal out, cut, waits
            w, i, d = joined([out, *cut])
            o = np.lexsort((d, i, w))
            w, i, d = w[o], i[o], d[o]
            new = np.r_[True, (w[1:] != w[:-1]) | (i[1:] != i[:-1])][:len(w)]
            out, (q, far_) = nearest(w[new], i[new], d[new], np.full(len(qs), want))
            least[q] = np.minimum(least[q], far_)
            cut, waits = [], 0

        step = max(1, DISTANCES // len(m))
        for lo in range(0, len(cells), step):
            d, open_ = inside(slice(None), np.arange(lo, min(lo + step, len(cells))))
            for n in range(lo, min(lo + step, len(cells))):
                if found and coarse[at[n]] != coarse[at[n - 1]]:
                    fold()
                    if waits > 2 << 20:
                        merge()
                who = np.flatnonzero(open_[n - lo])
                if not len(who):
                    continue
                a, b = first[n], last[n]
                s = d[n - lo, who].astype(np.float32)[:, None] - (m32[who] @ codes[a:b].T.astype(np.float32)) * scale[None, a:b]
                x, y = np.divmod(np.flatnonzero(s <= least[who, None]), b - a)
                found.append((who[x], ids[a:b][y], s[x, y]))
                held += len(x)
                if held > 4 << 20:
                    found = [nearest(*joined(found), share)[0]]
                    held = len(found[0][0])
        if found:
            fold()
        if cut:
            merge()
        return pd.DataFrame({"qid": qids[out[0]], "id": out[1], "distance": out[2].astype(np.float64)})

    # rows of one question share its cells and candidates
    q = q.select("qid", "qvec", F.count(F.lit(1)).over(Window.partitionBy("qid")).alias("copies"))
    asked = q.mapInPandas(limits, "qid long, qvec array<float>, copies long, far double, grp array<int>").select(
        "qid", "qvec", "copies", "far", F.explode("grp").alias("grp"), block.alias("qb"))
    where = F.broadcast(spark.createDataFrame(placed, "coarse int, part int, grp int"))  # one row per coarse cell and part
    rows = index_rows(spark, index).join(where, ["coarse", "part"]).select("grp", "cell", "id", "scale", "code")
    rows = rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return asked.groupBy("grp", "qb").cogroup(rows.groupBy("grp", "qb")).applyInPandas(scan, TOPK_SCHEMA)


def _near_by_lists(q: DataFrame, index: VectorIndex, sent, blocks: int, cprobe: int, nprobe: int, want: int) -> DataFrame:
    """The same where the fine centroids are too many to be sent: they meet the questions in joins, and every question lists the cells
    that it opens."""
    spark = q.sparkSession
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")

    def coarse_of(batches):
        for b in batches:
            if len(b):
                yield b.assign(near=list(_nearest(_units(b["qvec"].to_numpy()), sent.value, cprobe)))

    asked = q.mapInPandas(coarse_of, "qid long, qvec array<float>, near array<int>").select(
        "qid", "qvec", F.explode("near").alias("coarse"), block.alias("qb"))

    def rank_cells(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"qid": [], "coarse": [], "cell": [], "d": []})
        d = 1.0 - _units(qs["qvec"].to_numpy()) @ np.vstack(cs["centroid"].to_numpy()).T
        best = np.argsort(d, axis=1, kind="stable")[:, :nprobe]
        at = np.arange(len(qs)).repeat(best.shape[1])
        return pd.DataFrame({"qid": qs["qid"].to_numpy()[at], "coarse": qs["coarse"].iloc[0], "cell": cs["cell"].to_numpy()[best.ravel()],
                             "d": d[at, best.ravel()]})

    fine = spark.read.parquet(f"{index.path}/fine").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ranked = asked.groupBy("coarse", "qb").cogroup(fine.groupBy("coarse", "qb")).applyInPandas(rank_cells, "qid long, coarse int, cell int, d double")
    opened = top_k_per_query(ranked.withColumnRenamed("cell", "id").withColumnRenamed("d", "distance"), nprobe, "distance")
    lists = opened.groupBy("qid", "coarse").agg(F.collect_list("id").alias("cells"), F.collect_list("distance").alias("ds"))  # at most nprobe each
    lists = lists.join(q, "qid").withColumn("qb", block)
    groups = F.broadcast(spark.read.parquet(f"{index.path}/groups").select("coarse", "parts"))
    lists = lists.join(groups, "coarse").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    rows = index_rows(spark, index).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def scan(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(rs):
            return pd.DataFrame({"qid": [], "id": [], "distance": []})
        m, qids = _units(qs["qvec"].to_numpy()).astype(np.float32), qs["qid"].to_numpy()
        rs = rs.sort_values("cell", kind="stable")
        codes = np.frombuffer(b"".join(rs["code"]), np.int8).reshape(len(rs), -1)
        scale, ids, cell = rs["scale"].to_numpy(np.float32), rs["id"].to_numpy(), rs["cell"].to_numpy()
        lens = qs["cells"].map(len).to_numpy()
        ask = np.concatenate(qs["cells"].to_numpy()) if lens.sum() else np.zeros(0, np.int64)
        far = np.concatenate(qs["ds"].to_numpy()).astype(np.float32)
        who = np.arange(len(qs)).repeat(lens)
        by = np.argsort(ask, kind="stable")
        ask, far, who = ask[by], far[by], who[by]
        found, held = [], 0
        out_q, out_i, out_d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)

        def fold():
            nonlocal out_q, out_i, out_d, found, held
            w = np.concatenate([out_q, *[f[0] for f in found]])
            i = np.concatenate([out_i, *[f[1] for f in found]])
            d = np.concatenate([out_d, *[f[2] for f in found]])
            o = np.lexsort((i, d, w))
            w, i, d = w[o], i[o], d[o]
            starts = np.r_[0, np.flatnonzero(np.diff(w)) + 1]
            keep = np.arange(len(w)) - np.repeat(starts, np.diff(np.r_[starts, len(w)])) < want
            out_q, out_i, out_d, found, held = w[keep], i[keep], d[keep], [], 0

        cells, first = np.unique(cell, return_index=True)
        last = np.r_[first[1:], len(cell)]
        lo, hi = np.searchsorted(ask, cells, "left"), np.searchsorted(ask, cells, "right")
        for a, b, x, y in zip(first, last, lo, hi):
            if x == y:
                continue
            s = far[x:y, None] - (m[who[x:y]] @ codes[a:b].T.astype(np.float32)) * scale[None, a:b]
            found.append((who[x:y].repeat(b - a), np.tile(ids[a:b], y - x), s.ravel()))
            held += s.size
            if held > 4 << 20:
                fold()
        if found:
            fold()
        return pd.DataFrame({"qid": qids[out_q], "id": out_i, "distance": out_d.astype(np.float64)})

    return lists.groupBy("coarse", "part", "qb").cogroup(rows.groupBy("coarse", "part", "qb")).applyInPandas(scan, TOPK_SCHEMA)
