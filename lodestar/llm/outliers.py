"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Each text becomes a vector of transformed statistics: shares and counts under square roots or logarithms,
whose sampling spread depends on the size of the text alone. For every (lang, source) the minimum
covariance determinant estimate is found over all its rows: three starts (quartile spreads, correlation of
squashed values, spatial signs), from each of them C-steps (mean and covariance of the share ``H`` of rows with
the smallest Mahalanobis distances) until the log-determinant falls by less than ``TOL``, and of the three the
estimate with the least determinant. A row whose robust squared distance exceeds the chi-square quantile of
``CUT`` is rejected.

Most texts have no symbol and no repeated line, so a plain covariance of the inner rows is singular. As in the
regularised estimate (MRCD) a fixed positive matrix is added to it in every step: the sampling variance that
counts have in the median text of the group. A C-step with such a matrix still never raises the determinant.

A C-step is one aggregation: rows of a group are summed per distance bin (count, sums, products;
combined before the shuffle), and the bins up to the share ``H``, the last one in part, give the next
estimate. No group is ever gathered, so a source with a third of all rows is as cheap as any.

Defined results: null text has no words (base_failed). A null language or source is a group of
its own. Groups under ``MIN_GROUP`` rows use the estimate of their language, and languages under
it that of all rows. Rows with equal counts are one row of the estimate, so copies do not draw it to themselves;
every row is judged. A group of equal rows has the sampling variance alone. Extra columns are ignored."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import small_side, table
from lodestar.llm.words import ALNUM, EXACT, NONSPACE, counts_per_text, slices, windows

H = 0.75          # share of rows that the estimate rests on
CUT = 1 - 1e-5    # quantile of the rejecting distance
TOL = 1e-3        # C-steps end when the log-determinant falls by less
MIN_GROUP = 35    # rows of a group with an estimate of its own: five per statistic
BINS, PER_E = 128, 8  # distance bins, and how many of them a factor of e spans
FEATURES = ["f_len", "f_word", "f_sym", "f_dup", "f_rep", "f_upper", "f_punct"]
NOISE = ["e" + f[1:] for f in FEATURES]
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct"]
STATS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string())]
                  + [(c, pa.int64()) for c in COUNTS])
STATS_SQL = ", ".join(["doc_id long, lang string, source string", *[f"{c} long" for c in COUNTS]])


def _repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries (owner, key): whether an equal one stands earlier, and whether any other is equal."""
    order = np.lexsort((np.arange(len(keys)), keys, owner))
    k, o = keys[order], owner[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    later, multiple = np.zeros(len(k), bool), np.zeros(len(k), bool)
    later[order] = same
    both = same.copy()
    both[:-1] |= same[1:]
    multiple[order] = both
    return later, multiple


def statistics(batches):
    """Arrow batches of (doc_id, lang, source, text) to the counts of each whole text."""
    for b, t in slices(batches):
        s, e = t.words(NONSPACE)
        own = t.text_of(s)
        h = t.hashes(s, e, EXACT)
        size = np.zeros(len(t.data) + 1, np.int64)
        np.cumsum((t.data & 0xC0) != 0x80, out=size[1:])
        at = t.text_of(np.arange(0)) if not len(t.data) else np.repeat(np.arange(t.n), np.diff(t.offs))
        w = windows(h, 3)
        first = np.flatnonzero(own[:len(w)] == own[2:]) if len(w) else np.zeros(0, np.int64)
        _, twice = _repeats(w[first], own[first])
        in_rep = np.zeros(len(s), bool)
        for j in range(3):
            in_rep[first[twice] + j] = True
        # lines: between line feeds, within one text, with at least one word
        cut = np.unique(np.concatenate([t.offs, np.flatnonzero(t.data == 10), np.flatnonzero(t.data == 10) + 1]))
        ls, le = cut[:-1], cut[1:]
        words_before = np.zeros(len(t.data) + 1, np.int64)
        np.add.at(words_before, s + 1, 1)
        words_before = np.cumsum(words_before)
        keep = words_before[le] > words_before[ls]
        ls, le = ls[keep], le[keep]
        line_own = t.text_of(ls)
        again, _ = _repeats(t.hashes(ls, le, EXACT), line_own)
        long = lambda x: pa.array(x, pa.int64())
        chars = np.add.reduceat(np.r_[size[e] - size[s], 0], np.r_[0, np.flatnonzero(np.diff(own)) + 1]) if len(s) else []
        word_chars = np.zeros(t.n, np.int64)
        if len(s):
            word_chars[np.unique(own)] = chars
        punct = ~ALNUM[t.data] & NONSPACE[t.data]
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id").cast(pa.int64()), b.column("lang").cast(pa.string()), b.column("source").cast(pa.string()),
            long(counts_per_text(own, t.n)), long(word_chars), long(counts_per_text(at[SYMBOLS[t.data]], t.n)),
            long(counts_per_text(line_own[again], t.n)), long(counts_per_text(own[in_rep], t.n)),
            long(counts_per_text(line_own, t.n)), long(counts_per_text(at[UPPER[t.data]], t.n)),
            long(counts_per_text(at[punct], t.n))], schema=STATS)


def vectors(rows: DataFrame) -> DataFrame:
    """The transformed statistic vector of every row (``f_*``) and the sampling variance of each statistic (``e_*``).

    The square root of a share of ``n`` things varies by 1/(4n) whatever the share is (with Anscombe's 3/8 and 3/4 also for few);
    repeated words come six at a time, for one window found again marks three words twice."""
    n, c, lines = (F.greatest(F.col(x), F.lit(1)) for x in ("n_words", "word_chars", "n_lines"))
    share = lambda k, of: F.sqrt((F.col(k) + 0.375) / (of + 0.75))
    return rows.withColumns({
        "f_len": F.log1p("n_words") / 2, "e_len": 0.25 / n,
        "f_word": F.log(c / n), "e_word": 0.25 / n,
        "f_sym": share("n_symbols", c), "e_sym": 0.25 / (c + 0.75),
        "f_dup": share("n_dup_lines", lines), "e_dup": 0.25 / (lines + 0.75),
        "f_rep": share("n_repeat_words", n), "e_rep": 1.5 / (n + 0.75),
        "f_upper": share("n_upper", c), "e_upper": 0.25 / (c + 0.75),
        "f_punct": share("n_punct", c), "e_punct": 0.25 / (c + 0.75),
    })


def chi2_quantile(q: float, p: int) -> float:
    """Chi-square quantile (Wilson and Hilferty's cube)."""
    from statistics import NormalDist
    z = NormalDist().inv_cdf(q)
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def distance(df: DataFrame):
    """Squared Mahalanobis distance of a row joined with ``mean`` and ``prec``, as one JVM expression."""
    p = len(FEATURES)
    x = [F.col(f) - F.col("mean")[i] for i, f in enumerate(FEATURES)]
    out = F.lit(0.0)
    for i in range(p):
        row = sum((F.col("prec")[i * p + j] * x[j] for j in range(p)), F.lit(0.0))
        out = out + x[i] * row
    return out


STATE = "g string, start int, noise array<double>, mean array<double>, cov array<double>, prec array<double>, " \
        "logdet double, scale double, done boolean"
STATE_COLUMNS = [x.split()[0] for x in STATE.split(", ")]
PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def _symmetric(values) -> np.ndarray:
    out = np.zeros((len(FEATURES), len(FEATURES)))
    for (i, j), v in zip(PAIRS, values, strict=True):
        out[i, j] = out[j, i] = v
    return out


def _state(g, start, noise, mean, cov, logdet, scale, done) -> tuple:
    """One row of ``STATE``; ``prec`` is the inverse of the covariance with the sampling variances."""
    return (g, start, list(noise), list(mean), cov.ravel().tolist(), np.linalg.inv(cov + np.diag(noise)).ravel().tolist(), logdet, scale, done)


def _starts(batches):
    """Three first estimates of each group, from its medians and the sums of squashed values and of spatial signs."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            spread = np.outer(r.spread, r.spread)
            squashed = _symmetric(getattr(r, f"t{i}_{j}") for i, j in PAIRS) / r.n
            m = np.array([getattr(r, f"t{i}") for i in range(len(FEATURES))]) / r.n
            squashed -= np.outer(m, m)
            sd = np.sqrt(np.maximum(np.diag(squashed), 1e-12))
            signs = _symmetric(getattr(r, f"u{i}_{j}") for i, j in PAIRS) / r.n
            for k, corr in enumerate((np.eye(len(sd)), squashed / np.outer(sd, sd), signs * len(sd))):
                out.append(_state(r.g, k, r.noise, r.center, corr * spread, math.inf, 1.0, False))
        yield pd.DataFrame(out, columns=STATE_COLUMNS)


def _c_step(key, bins: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """The next estimate of a group from the sums of its distance bins."""
    now, bins = state.iloc[0], bins.sort_values("bin")
    n = bins["n"].to_numpy(float)
    below = np.cumsum(n) - n
    w = np.clip((H * n.sum() - below) / n, 0, 1)
    used = float(w @ n)
    mean = np.array([w @ bins[f"s{i}"].to_numpy() for i in range(len(FEATURES))]) / used
    cov = _symmetric(w @ bins[f"q{i}_{j}"].to_numpy() for i, j in PAIRS) / used - np.outer(mean, mean)
    noise = np.asarray(now["noise"], float)
    logdet = float(np.linalg.slogdet(cov + np.diag(noise))[1])
    middle = math.exp((bins["bin"].iloc[int(np.searchsorted(below + n, 0.5 * n.sum()))] + 0.5 - BINS / 3) / PER_E)
    scale = max(middle / chi2_quantile(0.5, len(FEATURES)), 1.0)
    done = not logdet < now["logdet"] - TOL
    if not logdet < now["logdet"]:
        mean, cov, logdet = np.asarray(now["mean"], float), np.asarray(now["cov"], float).reshape(cov.shape), float(now["logdet"])
    return pd.DataFrame([_state(key[0], int(key[1]), noise, mean, cov, logdet, scale, done)], columns=STATE_COLUMNS)


def _consistent(batches):
    """The inverse for judging: the covariance is blown up where the middle distance is above what is expected."""
    for pdf in batches:
        prec = [np.linalg.inv(np.asarray(c, float).reshape(len(FEATURES), -1) * s + np.diag(e)).ravel().tolist()
                for c, s, e in zip(pdf["cov"], pdf["scale"], pdf["noise"], strict=True)]
        yield pdf[["g", "mean", "logdet"]].assign(prec=prec)


def fit(rows: DataFrame) -> DataFrame:
    """(g, mean, logdet, prec) of each group ``g`` of the rows (g, ``f_*`` and ``e_*``)."""
    start = rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f) for f in FEATURES],
        F.array(*[F.percentile_approx(e, 0.5, 1000) for e in NOISE]).alias("noise"))
    start = table(start.select("g", "n", "noise", F.array(*[F.col(f)[1] for f in FEATURES]).alias("center"), F.array(*[
        F.sqrt(F.pow((F.col(f)[2] - F.col(f)[0]) / 1.349, 2) + F.col("noise")[i]) for i, f in enumerate(FEATURES)]).alias("spread")), "mcd")
    z = rows.join(small_side(start, 300), "g").select("g", *[
        ((F.col(f) - F.col("center")[i]) / F.col("spread")[i]).alias(f"z{i}") for i, f in enumerate(FEATURES)])
    size = F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(FEATURES))), F.lit(0.0))), F.lit(1e-9))
    z = z.select("g", *[F.tanh(f"z{i}").alias(f"t{i}") for i in range(len(FEATURES))],
                 *[(F.col(f"z{i}") / size).alias(f"u{i}") for i in range(len(FEATURES))])
    sums = z.groupBy("g").agg(*[F.sum(f"t{i}").alias(f"t{i}") for i in range(len(FEATURES))],
                              *[F.sum(F.col(f"{x}{i}") * F.col(f"{x}{j}")).alias(f"{x}{i}_{j}") for x in "tu" for i, j in PAIRS])
    state, settled = table(start.join(sums, "g").mapInPandas(_starts, STATE), "mcd"), None

    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)] + [
        F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}_{j}") for i, j in PAIRS]
    while True:
        active = state.where("not done")
        finished = state.where("done")
        settled = finished if settled is None else settled.unionByName(finished)
        if not active.limit(1).count():
            break
        d = rows.join(small_side(active.select("g", "start", "mean", "prec"), 800), "g")
        place = F.floor(PER_E * F.log(distance(d) + 1e-9) + BINS / 3)
        bins = d.withColumn("bin", F.least(F.lit(BINS - 1), F.greatest(F.lit(0), place)).cast("int")).groupBy("g", "start", "bin").agg(
            F.count(F.lit(1)).alias("n"), *sums)
        state = table(bins.groupBy("g", "start").cogroup(
            active.withColumnsRenamed({"g": "of", "start": "origin"}).groupBy("of", "origin")).applyInPandas(_c_step, STATE), "mcd")
    least = settled.groupBy("g").agg(F.min_by(F.struct("mean", "cov", "noise", "scale", "logdet"), F.struct("logdet", "start")).alias("x"))
    return table(least.select("g", "x.*").mapInPandas(
        _consistent, "g string, mean array<double>, logdet double, prec array<double>"), "mcd")


def judge(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, lang, source) with its counts, ``base_failed``, the squared
    robust ``distance`` and ``kept``."""
    v = table(docs.select("doc_id", "lang", "source", "text").mapInArrow(statistics, STATS_SQL), "stats")
    v = v.withColumns({"l": F.coalesce("lang", F.lit("\x00")), "s": F.coalesce("source", F.lit("\x00"))})
    # rows of equal counts are one row of the estimate
    once = table(v.groupBy("l", "s", *COUNTS).agg(F.count(F.lit(1)).alias("copies")).drop("copies"), "counts")
    sizes = once.groupBy("l", "s").agg(F.count(F.lit(1)).alias("n_ls"))
    langs = sizes.groupBy("l").agg(F.sum("n_ls").alias("n_l"))
    group = table(sizes.join(langs, "l").select(
        "l", "s", F.when(F.col("n_ls") >= MIN_GROUP, F.concat_ws("\x01", "l", "s"))
        .when(F.col("n_l") >= MIN_GROUP, F.col("l")).otherwise(F.lit("\x02")).alias("g")), "groups")
    own = once.join(small_side(group.where(F.col("g").contains("\x01")), 80), ["l", "s"])
    # a language's own estimate, and that of all rows, rest on all their rows, not on the small groups alone
    pools = table(group.where(~F.col("g").contains("\x01")).select("g").distinct(), "pools")
    whole = once.join(small_side(pools.where("g <> '\x02'").withColumnRenamed("g", "l"), 40), "l").withColumn("g", F.col("l"))
    rows = own.select("g", *COUNTS).unionByName(whole.select("g", *COUNTS))
    if pools.where("g = '\x02'").limit(1).count():
        rows = rows.unionByName(once.withColumn("g", F.lit("\x02")).select("g", *COUNTS))
    params = fit(vectors(rows).select("g", *FEATURES, *NOISE))
    d = vectors(v.join(small_side(group, 80), ["l", "s"]).join(small_side(params.select("g", "mean", "prec"), 800), "g", "left"))
    d = d.withColumn("distance", F.coalesce(distance(d), F.lit(0.0))).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    cut = chi2_quantile(CUT, len(FEATURES))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= F.lit(cut))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance",
        "lang", "source")
