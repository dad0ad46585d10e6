"""Quality classifier by positive-unlabelled learning (non-negative risk).

Trusted positives are labelled rows of the training folds with quality 1; the unlabelled text is
every document. With the logistic loss the unbiased risk of a linear score g is

    R = -prior * E_p[g] + E_u[log(1 + e^g)],

whose negative part ``E_u[log(1+e^g)] - prior * E_p[log(1+e^g)]`` must not fall below 0: where it
does, the step is taken back until it holds (the non-negative correction). The class prior is the
smallest ratio of the unlabelled to the positive share above any score threshold, with a
margin for the sizes of both sets.

The score is linear in hinge functions of a text's statistics. Each Newton step is one pass over the
written statistics of all documents: every task sums gradient and curvature, Spark adds the
sums up by position, and the driver gets a fixed number of them, whatever the input.

Defined results: null text is empty and gets a score like any; rows without an id or label are
unlabelled; repeated labels of one id count once, and as positive only if all say so; without any
positive the score is 0.5 everywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import table
from lodestar.llm.outliers import STATS_SQL, statistics

ROUNDS = 7
RIDGE = 1e-3
MAX_POSITIVES = 200_000   # labelled rows that are fitted at most
KNOTS = {
    "len": (1.0, 2.0, 2.5, 3.0, 3.5), "word": (1.0, 1.4, 1.6, 1.8, 2.0, 2.4), "sym": (0.1, 0.25, 0.4, 0.6), "dup": (0.2, 0.4, 0.6, 0.8),
    "rep": (0.2, 0.35, 0.5, 0.7, 0.9), "upper": (0.1, 0.2, 0.3, 0.5, 0.8), "punct": (0.1, 0.2, 0.3, 0.4, 0.6), "line": (1.0, 2.0, 3.0, 4.0)}
DIM = 1 + sum(1 + len(k) for k in KNOTS.values())


def basis(pdf) -> np.ndarray:
    """Hinge functions of the statistics of each row, bounded to about -1 to 1."""
    n = np.maximum(pdf["n_words"].to_numpy(float), 1)
    c = np.maximum(pdf["word_chars"].to_numpy(float), 1)
    lines = np.maximum(pdf["n_lines"].to_numpy(float), 1)
    raw = {"len": np.log10(n), "word": np.log(c / n), "sym": np.sqrt(pdf["n_symbols"] / c), "dup": np.sqrt(pdf["n_dup_lines"] / lines),
           "rep": np.sqrt(pdf["n_repeat_words"] / n), "upper": np.sqrt(pdf["n_upper"] / c), "punct": np.sqrt(pdf["n_punct"] / c),
           "line": np.log(n / lines + 1)}
    cols = [np.ones(len(n))]
    for k, knots in KNOTS.items():
        x = np.asarray(raw[k], float)
        cols += [x, *[np.maximum(x - a, 0) for a in knots]]
    return np.stack(cols, 1)


def _softplus(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, g)


def _sums(rows: DataFrame, f, size: int) -> np.ndarray:
    """f(pdf) -> vector of ``size`` sums per batch; added up over all rows by Spark."""
    def part(batches):
        total = np.zeros(size)
        for b in batches:
            total += f(b.to_pandas())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["i", "v"])
    got = rows.mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in got:
        out[r.i] = r.v
    return out


def _newton(rows: DataFrame, prior: float, w: np.ndarray, rounds: int) -> np.ndarray:
    def pass_over(w):
        def f(pdf):
            x = basis(pdf)
            g = x @ w
            q = 1 / (1 + np.exp(-g))
            pos = pdf["positive"].to_numpy(bool)
            return np.concatenate([x[pos].sum(0), (x * q[:, None]).sum(0), ((x * (q * (1 - q))[:, None]).T @ x).ravel(),
                                   [_softplus(g).sum(), _softplus(g[pos]).sum(), pos.sum(), len(x)]])
        return _sums(rows, f, 2 * DIM + DIM * DIM + 4)

    def parts(w):
        s = pass_over(w)
        u, p = s[-4:-2], s[-2:]
        n_p, n_u = max(p[0], 1), max(p[1], 1)
        negative = u[0] / n_u - prior * u[1] / n_p
        risk = -prior * (s[:DIM] @ w) / n_p + u[0] / n_u + RIDGE / 2 * (w[1:] @ w[1:])
        ridge = RIDGE * np.r_[1e-3, np.ones(DIM - 1)]
        grad = -prior * s[:DIM] / n_p + s[DIM:2 * DIM] / n_u + ridge * w
        curve = s[2 * DIM:-4].reshape(DIM, DIM) / n_u + np.diag(ridge)
        return risk, negative, np.linalg.solve(curve, grad)

    risk, _, step = parts(w)
    for _ in range(rounds):
        for scale in (1.0, 0.4, 0.1):
            new = w - scale * step
            got = parts(new)
            if got[0] <= risk + 1e-9 and got[1] >= 0:
                break
        else:
            return w
        done = risk - got[0] < 1e-5
        w, (risk, _, step) = new, got
        if done:
            break
    return w


def class_prior(rows: DataFrame, w: np.ndarray) -> float:
    """Share of positives among all: the least ratio of tail shares over thresholds of the score."""
    bins = 400

    def f(pdf):
        g = 1 / (1 + np.exp(-(basis(pdf) @ w)))
        at = np.minimum((g * bins).astype(int), bins - 1)
        return np.r_[np.bincount(at, minlength=bins), np.bincount(at[pdf["positive"].to_numpy(bool)], minlength=bins)].astype(float)

    s = _sums(rows, f, 2 * bins)
    u, p = np.cumsum(s[:bins][::-1]), np.cumsum(s[bins:][::-1])
    if not p[-1]:
        return 0.5
    n_u, n_p = u[-1], p[-1]
    margin = np.sqrt(np.log(20) / n_u) + np.sqrt(np.log(20) / n_p)
    ratio = [(a / n_u + margin) / max(b / n_p, 1e-9) for a, b in zip(u, p, strict=True) if b / n_p > 0.2]
    return float(np.clip(min(ratio, default=0.5), 0.02, 0.98))


def score_quality(docs: DataFrame, labels: DataFrame, train) -> DataFrame:
    """doc_id, score and the estimated prior of every row of ``docs`` (doc_id, text). ``labels``:
    doc_id, quality; ``train``: a condition on doc_id, of the rows whose labels may be used."""
    text = docs.select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "text")
    stats = table(text.mapInArrow(statistics, STATS_SQL), "quality")
    good = labels.where(train & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    good = table(good.select("doc_id", F.lit(True).alias("positive")), "positives")
    n = good.count()
    if n > MAX_POSITIVES:
        good = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * MAX_POSITIVES / n))
    rows = table(stats.drop("lang", "source").join(good, "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False))), "fit")
    w, prior = np.zeros(DIM), 0.5
    if n and rows.where("positive").limit(1).count():
        w = _newton(rows, 0.5, w, 4)
        prior = class_prior(rows, w)
        w = _newton(rows, prior, w, ROUNDS)

    def score(batches):
        for b in batches:
            g = basis(b.to_pandas()) @ w
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-g)))], names=["doc_id", "score"])

    return rows.mapInArrow(score, "doc_id long, score double").withColumn("prior", F.lit(prior))
