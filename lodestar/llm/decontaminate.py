"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 10 consecutive words of a benchmark item (a shorter item is one
pattern). Patterns of one length are searched together. The text is read through a block of two
words: the shift table says how far the search may move on because no pattern can end before; at
shift 0 the hash of the block, the patterns' suffix, selects a bucket of patterns, and these are
compared word by word, at last by their bytes. Many stretches of text move on at once (numpy).

The patterns travel to the tasks in blocks of at most ``BLOCK_WORDS`` words: the item words are
counted by Spark, items are dealt to as many blocks as that bound needs, each block scans the
documents once, and hits of several blocks are merged per document. So no broadcast grows with the
data and no hit is lost.

Defined results: null or empty text has no words and no hits; items without words (null, empty)
have no window; an item with a null id counts under the empty id; repeated items and items with
equal texts each count by id; rows are judged one by one, so repeated rows stay."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.words import ALNUM, LOWER, Texts, counts_per_text, mix, slices, texts_of

WIDTH = 10
BLOCK_WORDS = 2_000_000
TABLE_BITS = 20
LANE = 384

RAW_SQL = "row long, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"
RAW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())),
                 ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _block(h: np.ndarray, size: int) -> np.ndarray:
    """For each position: a hash of the block of ``size`` words that ends there (0 before a full block)."""
    out = h.copy()
    if size == 2:
        out[1:] = h[1:] + h[:-1] * np.uint64(0x9E3779B97F4A7C15)
    return (mix(out) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Patterns:
    """All patterns of one length: word hashes, joined bytes, item ids, shift table and buckets."""

    def __init__(self, width: int, rows: dict[bytes, tuple[np.ndarray, set[str]]]):
        self.width, self.size = width, min(2, width)
        self.text = list(rows)
        self.words = np.array([rows[t][0] for t in self.text], np.uint64).reshape(len(rows), width)
        self.items = [rows[t][1] for t in self.text]
        self.shift = np.full(1 << TABLE_BITS, width - self.size + 1, np.int32)
        for end in range(self.size - 1, width):
            cols = self.words[:, end - self.size + 1:end + 1]
            at = _block(np.ascontiguousarray(cols).ravel(), self.size)[self.size - 1::self.size]
            np.minimum.at(self.shift, at, width - 1 - end)
        last = _block(np.ascontiguousarray(self.words[:, width - self.size:]).ravel(), self.size)[self.size - 1::self.size]
        self.order = np.argsort(last, kind="stable")
        self.keys, first, n = np.unique(last[self.order], return_index=True, return_counts=True)
        self.first, self.n = first, n

    def find(self, h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every place where all word hashes agree within one text."""
        m = self.width
        if len(h) < m or not len(self.text):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        block = _block(h, self.size)
        pos = np.arange(m - 1, len(h), LANE)
        stop = np.minimum(pos + LANE, len(h))
        found = []
        while len(pos):
            s = self.shift[block[pos]]
            found.append(pos[s == 0])
            pos = pos + np.maximum(s, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        ends = np.concatenate(found)
        at = np.searchsorted(self.keys, block[ends])
        ok = at < len(self.keys)
        ok[ok] = self.keys[at[ok]] == block[ends[ok]]
        ends, at = ends[ok], at[ok]
        n = self.n[at]
        place = np.repeat(ends, n)
        which = self.order[np.repeat(self.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        for j in range(m):
            same = h[place - j] == self.words[which, m - 1 - j]
            place, which = place[same], which[same]
        begin = place - m + 1
        inside = own[begin] == own[place]
        return begin[inside], which[inside]


def patterns(items: list[tuple[str, str | None]], width: int = WIDTH) -> list[Patterns]:
    """Search tables of the items (id, text), one per pattern length."""
    by: dict[int, dict[bytes, tuple[np.ndarray, set[str]]]] = {}
    t = texts_of(pa.array([x for _, x in items], pa.string()))
    s, e = t.words(ALNUM)
    h, own, low = t.hashes(s, e), t.text_of(s), LOWER[t.data].tobytes()
    bounds = np.searchsorted(own, np.arange(t.n + 1))
    for i, (item, _) in enumerate(items):
        a, b = bounds[i], bounds[i + 1]
        w = min(width, b - a)
        for k in range(a, b - w + 1) if w else ():
            text = b" ".join(low[s[j]:e[j]] for j in range(k, k + w))
            by.setdefault(int(w), {}).setdefault(text, (h[k:k + w], set()))[1].add(item)
    return [Patterns(w, rows) for w, rows in sorted(by.items())]


def search(t: Texts, tables: list[Patterns]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Per text: number of words, confirmed hit ranges (in words of the text), items with an occurring window."""
    s, e = t.words(ALNUM)
    h, own, low = t.hashes(s, e), t.text_of(s), LOWER[t.data].tobytes()
    n_words = counts_per_text(own, t.n)
    base = np.cumsum(n_words) - n_words
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(t.n)]
    items: list[set[str]] = [set() for _ in range(t.n)]
    for p in tables:
        for begin, which in zip(*(x.tolist() for x in p.find(h, own)), strict=True):
            if b" ".join(low[s[j]:e[j]] for j in range(begin, begin + p.width)) == p.text[which]:
                d = int(own[begin])
                lo = begin - int(base[d])
                ranges[d].append((lo, lo + p.width))
                items[d] |= p.items[which]
    return n_words, ranges, items


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _scan(items_of_block):
    def run(batches):
        tables = patterns(items_of_block.value)
        for b, t in slices(batches):
            n, ranges, items = search(t, tables)
            ranges = [_merged(r) for r in ranges]
            yield pa.RecordBatch.from_arrays([
                b.column("row"), b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()),
                pa.array([[x[0] for x in r] for r in ranges], pa.list_(pa.int32())),
                pa.array([[x[1] for x in r] for r in ranges], pa.list_(pa.int32())),
                pa.array([sorted(x) for x in items], pa.list_(pa.string()))], schema=RAW)
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, starts, ends (merged hit ranges in words) and items."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
    total = items.select(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # a word takes two characters at least
    n_blocks = max(1, int(np.ceil(total / block_words)))
    d = docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text")
    if n_blocks > 1:  # the row's own key, so that hits of several blocks come together again
        d = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text").groupBy("row", "doc_id", "text").agg(
            F.count(F.lit(1)).alias("copies"))
    parts = []
    for k in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k) if n_blocks > 1 else items
        block = spark.sparkContext.broadcast([(r.item, r.text) for r in own.collect()])
        parts.append(d.select("row", "doc_id", "text").mapInArrow(_scan(block), RAW_SQL))
    if n_blocks == 1:
        return parts[0].drop("row")
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    spans = F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))
    merged = F.aggregate(
        F.array_sort(F.col("spans")),
        F.array().cast("array<struct<starts:int,ends:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["ends"] >= x["starts"]),
                              F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                                       F.array(F.struct(F.element_at(acc, -1)["starts"].alias("starts"),
                                                        F.greatest(F.element_at(acc, -1)["ends"], x["ends"]).alias("ends")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["starts"].alias("starts"), x["ends"].alias("ends"))))))
    rows = rows.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), spans.alias("spans"),
                                             F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = rows.join(d.select("row", F.col("doc_id").alias("same"), "copies"), "row").where("doc_id <=> same")
    rows = rows.withColumn("spans", merged).select("doc_id", "n_words", F.col("spans.starts").alias("starts"),
                                                   F.col("spans.ends").alias("ends"), "items", "copies")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")


def report(leaks: DataFrame) -> DataFrame:
    """Counts and the item digest of each row of ``find_leaks``."""
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda acc, x: acc + x).cast("long")
    return leaks.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
