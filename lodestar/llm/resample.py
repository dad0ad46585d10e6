"""Target-distribution importance resampling: hashed n-gram weights, Gumbel noise, and a distributed radix sort.

Weights: words of the corpus and of the target are counted in ``BUCKETS`` hashed buckets; the gain of a bucket is the
scaled log ratio of its two smoothed shares. The gains are one array of fixed size, and a text's weight is the sum
of the array's entries over its features: one scan in place, no shuffle.

Draw: the rows are ranked by a least-significant-digit radix sort over the composite key (score downwards, doc_id, number of
features), packed into as few whole numbers as its ranges need. Every pass is a stable counting sort: rows lie in
blocks of consecutive places; digits are counted per block; sums of the counts over smaller digits and, for the
same digit, over earlier blocks give where each block's rows of a digit begin; a row's destination is that plus its own
number among them. After the last pass the destination is the rank. Nothing is sorted as a whole: a task orders the rows
of one digit of one block. Each pass is written, so a lost executor repeats one pass at most.

Defined results: a null text has no words, weight 0; rows with a null doc_id are hashed with an empty id and stand after equal
scores with one; rows equal in score and id are ordered by n_features, further equals are interchangeable; rows with
fewer than ``LEAST`` words are scored and never drawn; empty tables (documents or target) give smoothed gains over what
there is; extra columns are ignored."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import table
from lodestar.llm.words import ALNUM, LOWER, Texts, counts_per_text, slices
from lodestar.session import range_partitions

BUCKETS = 10_000
RUNS = 1
SEED = 2024
LEAST = 20
SHARE = 10
DIGIT_BITS = 15
KEY_BITS = 60
LONG_WORD = 64
_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1).astype(np.uint32)


def crc_over(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 states carried on over a byte range each: byte by byte over all ranges at once, the longest first."""
    n = ends - starts
    order = np.argsort(-n, kind="stable")
    out, at, left = state[order], starts[order], n[order]
    far = int(np.searchsorted(-left, -LONG_WORD, side="left"))  # few words are longer; those go one by one
    for i in range(far):
        out[i] = zlib.crc32(data[at[i]:at[i] + left[i]], int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    c, at, left = out[far:], at[far:], left[far:]
    for j in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -j, side="left"))
        x = c[:live]
        c[:live] = _TABLE[(x ^ data[at[:live] + j]) & 255] ^ (x >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def features(t: Texts, runs: int = RUNS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words joined by one space: the text that each run lies in, and its bucket."""
    starts, ends = t.words(ALNUM)
    owner, data = t.text_of(starts), LOWER[t.data]
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    state = crc_over(state, data, starts, ends)
    yield owner, (state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)
    for k in range(1, runs):
        state = state[:-1] if len(state) else state
        state = _TABLE[(state ^ np.uint32(0x20)) & 255] ^ (state >> np.uint32(8))
        state = crc_over(state, data, starts[k:], ends[k:])
        whole = owner[:len(state)] == owner[k:]
        yield owner[k:][whole], (state[whole] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)


def histogram(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all ``texts`` (text) per bucket; a task sends one row per bucket, the driver gets ``buckets`` sums."""
    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for _, t in slices(batches):
            for _, b in features(t, runs, buckets):
                sums += np.bincount(b, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the corpus), per bucket."""
    b, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs``: doc_id, n_words, n_features, weight, score."""
    def score(batches):
        for batch, t in slices(batches):
            n, words, weight = np.zeros(t.n, np.int64), None, np.zeros(t.n, np.int64)
            for owner, b in features(t, runs, len(gain)):
                found = counts_per_text(owner, t.n)
                words = found if words is None else words
                n += found
                sums = np.concatenate([[0], np.cumsum(gain[b])])
                ends = np.cumsum(found)
                weight += sums[ends] - sums[ends - found]
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            total = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *[pa.array(x, pa.int64()) for x in (words, n, weight, total)]],
                                             ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, _SCORED)


def _packed(rows: DataFrame, keys: list[tuple[str, bool]]) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Whole numbers ``__k0`` (least significant), ``__k1``, ... that order ``rows`` like ``keys`` (column, downwards), and the
    bits of each. Nulls stand last. A range of 2^60 and more is cut into two numbers of 32 bits."""
    ends = rows.agg(*[f(c).alias(f"{n}{i}") for i, (c, _) in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    fields: list[tuple[Column, int]] = []  # most significant first
    for i, (c, down) in enumerate(keys):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        lo, hi = (0, 0) if lo is None else (lo, hi)
        if hi - lo + 1 < 1 << KEY_BITS:
            v = F.lit(hi) - F.col(c) if down else F.col(c) - F.lit(lo)
            fields.append((F.coalesce(v, F.lit(hi - lo + 1)).cast("long"), (hi - lo + 1).bit_length()))
        else:
            u = F.col(c).bitwiseXOR(F.lit(-(1 << 63) if not down else (1 << 63) - 1))
            fields.append((F.col(c).isNull().cast("long"), 1))
            fields += [(F.coalesce(F.shiftrightunsigned(u, 32), F.lit(0)).cast("long"), 32),
                       (F.coalesce(u.bitwiseAND((1 << 32) - 1), F.lit(0)).cast("long"), 32)]
    numbers: list[tuple[Column, int]] = []
    for v, bits in reversed(fields):
        if numbers and numbers[-1][1] + bits <= KEY_BITS:
            low, used = numbers[-1]
            numbers[-1] = (F.shiftleft(v, used).bitwiseOR(low), used + bits)
        else:
            numbers.append((v, bits))
    named = [(f"__k{i}", bits) for i, (_, bits) in enumerate(numbers)]
    return rows.withColumns({name: v for (name, _), (v, _) in zip(named, numbers)}), named


def radix_ranks(rows: DataFrame, keys: list[tuple[str, bool]], rank: str = "rank", digit_bits: int = DIGIT_BITS) -> DataFrame:
    """``rows`` with their ``rank`` (1, 2, ...) in the order of ``keys`` (whole-number column, downwards), by least-significant-digit radix sort."""
    rows, numbers = _packed(rows, keys)
    rows = table(rows.withColumn("__pos", F.monotonically_increasing_id()), "radix")
    n = rows.count()
    # places per block: some blocks per task, so that a digit which all rows share is spread, and at most 2^20 for memory
    block = min(max(n // (4 * range_partitions(rows)), 1 << 10), 1 << 20)
    for name, bits in numbers:
        passes = max(1, -(-bits // digit_bits))
        width = -(-bits // passes)
        for k in range(passes):
            rows = _counting_pass(rows, F.shiftright(name, k * width).bitwiseAND((1 << width) - 1), block)
    drop = ["__pos", *[name for name, _ in numbers]]
    return rows.withColumn(rank, F.col("__pos") + 1).drop(*drop)


def _counting_pass(rows: DataFrame, digit: Column, block: int) -> DataFrame:
    """One stable counting sort by ``digit`` (of a fixed number of values): ``__pos`` becomes the destination."""
    cut = rows.withColumn("__d", digit).withColumn("__b", F.expr(f"__pos div {block}"))
    counts = table(cut.groupBy("__b", "__d").agg(F.count(F.lit(1)).alias("__n")), "counts")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    digits = counts.groupBy("__d").agg(F.sum("__n").alias("__all"))
    starts = digits.select("__d", F.coalesce(F.sum("__all").over(Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    earlier = F.coalesce(F.sum("__n").over(Window.partitionBy("__d").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("__earlier", earlier).join(F.broadcast(starts), "__d").select(
        "__b", "__d", (F.col("__start") + F.col("__earlier")).alias("__to"))
    own = F.row_number().over(Window.partitionBy("__b", "__d").orderBy("__pos")) - 1
    moved = cut.withColumn("__own", own).join(offsets, ["__b", "__d"])
    return table(moved.withColumn("__pos", (F.col("__to") + F.col("__own")).cast("long")).drop("__b", "__d", "__own", "__to"), "radix")


def resample(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, share: int = SHARE,
             least: int = LEAST) -> DataFrame:
    """Every row of ``docs`` with doc_id, n_words, n_features, weight, score, and the rank of those drawn: ``share`` percent of
    the rows that have ``least`` words."""
    gain = gains(histogram(docs, runs, buckets), histogram(target, runs, buckets))
    rows = table(scored(docs, gain, runs, seed), "scored")
    able = rows.where(F.col("n_words") >= least)
    ranked = radix_ranks(able, [("score", True), ("doc_id", False), ("n_features", False)])
    drawn = able.count() * share // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(rows.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


ORACLE = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t),
docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
feats AS (SELECT rid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM docs),
target AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
vocab AS (SELECT w FROM feats UNION SELECT w FROM target),
bytes AS (SELECT w, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INT, 2))::BIGINT) AS b FROM vocab),
bucket AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS b
  FROM bytes, tab),
s AS (SELECT b, count(*) AS n FROM feats JOIN bucket USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM target JOIN bucket USING (w) GROUP BY b),
tot AS (SELECT (SELECT count(*) FROM feats) AS s, (SELECT count(*) FROM target) AS t),
gain AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (tot.s + 10000) / ((s.n + 1)::DOUBLE * (tot.t + 10000))))::BIGINT AS g
  FROM s LEFT JOIN t USING (b), tot),
sums AS (SELECT rid, count(*) AS n, sum(g)::BIGINT AS weight FROM feats JOIN bucket USING (w) JOIN gain USING (b) GROUP BY rid),
scored AS (SELECT d.rid, d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296))))::BIGINT
      AS score FROM docs d LEFT JOIN sums USING (rid)),
ranked AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT 10 * count(*) // 100 FROM ranked) THEN r END AS rank FROM scored LEFT JOIN ranked USING (rid)
"""
