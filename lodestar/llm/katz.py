"""Language-model scoring: Katz backoff with Good-Turing discounts (bigrams over unigrams).

Model: P(w) = d(c) c / N for a known token, the rest of the mass for the one unknown token;
P(w | h) = d(c) c(h, w) / c(h) for a seen pair, else a(h) P(w), where a(h) is normalised exactly:
(1 - seen mass of h) / (1 - unigram mass of the tokens seen after h); a context that leaves no mass
counts as seen once more. d(c) is the Good-Turing
discount up to count ``K`` (absolute discounting where counts of counts are degenerate).

The corpus is read once into chunks of about ``CHUNK`` tokens (numbers into the chunk's own
vocabulary). Every chunk asks for its distinct unigrams and bigrams, each with its training count: keys are
dealt by hash range to slots, a slot adds up what all chunks counted, stores the
totals as a part of the n-gram table (partitioned by order and slot) and answers every chunk. The
backoff sums of a context are gathered the same way, from the chunk that each bigram was assigned
to. Only sorted distinct keys travel, never token rows; one key comes at most once from a chunk, so
a word with a third of all tokens costs no more than a rare one. The number of slots grows with the
tokens, so a task's memory does not. Each step is written to the shared folder.

Tokens: words of non-space bytes, A-Z lower-cased, then one end per text. Defined results: null text is
empty (one end token); rows without doc_id are scored but never learned from and not held out;
repeated rows are texts of their own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import table
from lodestar.llm.words import NONSPACE, mix, slices

K = 5
CHUNK = 1_200_000        # tokens of a chunk, about
SLOT = 2_000_000         # tokens for each slot of each order, about
UNIGRAM, BIGRAM, CONTEXT = 1, 2, 3
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)

CHUNK_SQL = "chunk long, doc_ids array<long>, train binary, sizes binary, vocab binary, stream binary, tokens long"
ASK_SQL = "slot long, chunk long, n long, keys binary, counts binary, a binary, b binary"
ANSWER_SQL = "slot long, chunk long, n long, keys binary, data binary, hist array<long>"


def _pack(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize) if len(x) else np.zeros((0, 1), np.uint8)
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(raw.T).tobytes() or b"\0", codec="zstd", asbytes=True)


def _unpack(data: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    raw = pa.decompress(data[8:], n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _chunks(batches):
    """Chunk rows: the texts' tokens as numbers into the chunk's vocabulary (most frequent first)."""
    part, number = TaskContext.get().partitionId(), 0
    ids, train, sizes, hashes, total = [], [], [], [], 0

    def row():
        nonlocal number
        h = np.concatenate(hashes)
        keys, inv, n = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        number += 1
        return pa.RecordBatch.from_arrays([
            pa.array([(part << 24) + number]), pa.array([ids], pa.list_(pa.int64())), pa.array([_pack(np.array(train, np.uint8))]),
            pa.array([_pack(np.concatenate(sizes))]), pa.array([keys[order].tobytes()]), pa.array([_pack(rank[inv])]),
            pa.array([len(h)], pa.int64())], names=["chunk", "doc_ids", "train", "sizes", "vocab", "stream", "tokens"])

    for b, t in slices(batches):
        s, e = t.words(NONSPACE)
        own = t.text_of(s)
        n = np.bincount(own, minlength=t.n) if len(own) else np.zeros(t.n, np.int64)
        out = np.full(int(n.sum()) + t.n, END, np.uint64)
        first = np.cumsum(n + 1) - (n + 1)
        at = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        out[at] = t.hashes(s, e)
        ids += b.column("doc_id").to_pylist()
        train += b.column("train").to_pylist()
        sizes.append((n + 1).astype(np.uint32))
        hashes.append(out)
        total += len(out)
        if total >= CHUNK:
            yield row()
            ids, train, sizes, hashes, total = [], [], [], [], 0
    if total:
        yield row()


class Chunk:
    """A chunk's tokens, contexts and distinct bigrams."""

    def __init__(self, row: dict):
        self.ids, self.chunk = row["doc_ids"], row["chunk"]
        self.train = _unpack(row["train"], np.uint8).astype(bool)
        self.sizes = _unpack(row["sizes"], np.uint32).astype(np.int64)
        self.vocab = np.frombuffer(row["vocab"], np.uint64)
        self.token = _unpack(row["stream"], np.uint32).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.learn = np.repeat(self.train, self.sizes)
        self.v = len(self.vocab)
        prev = np.empty_like(self.token)
        prev[1:] = self.token[:-1]
        prev[self.first] = self.v                      # the start of a text
        self.prev = prev
        self.hash = np.r_[self.vocab, START]

    def bigrams(self):
        """(hash order of distinct bigrams: hashes, contexts, tokens, training counts, number of each token's bigram)."""
        code = self.prev * (self.v + 1) + self.token
        order = np.argsort(code)
        c = code[order]
        new = np.r_[True, c[1:] != c[:-1]]
        at = np.cumsum(new) - 1
        n = np.bincount(at, self.learn[order]).astype(np.int64)
        code = c[new]
        ctx, tok = code // (self.v + 1), code % (self.v + 1)
        h = mix(self.hash[ctx] * np.uint64(0x9E3779B97F4A7C15) + self.hash[tok])
        by = np.argsort(h)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        use = np.empty(len(order), np.int64)
        use[order] = rank[at]
        return h[by], ctx[by], tok[by], n[by], use

    def unigrams(self):
        by = np.argsort(self.vocab)
        return self.vocab[by], np.bincount(self.token, self.learn, self.v).astype(np.int64)[by], by


def _slot_bounds(keys: np.ndarray, slots: int) -> np.ndarray:
    edge = np.array([((1 << 64) * i // slots) for i in range(1, slots)], np.uint64)
    return np.r_[0, np.searchsorted(keys, edge), len(keys)]


def _ask_rows(kind: int, chunk: int, keys, counts, slots: int, a=None, b=None):
    bounds = _slot_bounds(keys, slots)
    cols: dict[str, list] = {k: [] for k in ("slot", "chunk", "n", "keys", "counts", "a", "b")}
    for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if hi > lo:
            cols["slot"].append((kind << 40) + i)
            cols["chunk"].append(chunk)
            cols["n"].append(hi - lo)
            cols["keys"].append(_pack_sorted(keys[lo:hi]))
            # a chunk's own counts are small; the totals of contexts are those of the whole corpus
            cols["counts"].append(_pack(counts[lo:hi].astype(np.uint64 if kind == CONTEXT else np.uint32)))
            cols["a"].append(None if a is None else _pack(a[lo:hi]))
            cols["b"].append(None if b is None else _pack(b[lo:hi]))
    long, raw = pa.int64(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(cols["slot"], long), pa.array(cols["chunk"], long), pa.array(cols["n"], long),
                                       *[pa.array(cols[k], raw) for k in ("keys", "counts", "a", "b")]], names=list(cols))


def _rows(batches):
    for b in batches:
        yield from b.to_pylist()


def _asks(slots: int):
    def run(batches):
        for row in _rows(batches):
            c = Chunk(row)
            keys, n, _ = c.unigrams()
            yield _ask_rows(UNIGRAM, c.chunk, keys, n, slots)
            h, _, _, n, _ = c.bigrams()
            yield _ask_rows(BIGRAM, c.chunk, h, n, slots)
    return run


def _merge(t: pa.Table) -> pa.Table:
    """The totals of one slot: its part of the n-gram table (chunk -1) and the answer to each chunk."""
    rows = sorted(t.to_pylist(), key=lambda r: r["chunk"])
    keys = [_unpack_sorted(r["keys"]) for r in rows]
    counts = np.concatenate([_unpack(r["counts"], np.uint32) for r in rows]).astype(np.int64)
    flat = np.concatenate(keys)
    distinct, inv = np.unique(flat, return_inverse=True)
    total = np.bincount(inv, counts, len(distinct)).astype(np.int64)
    told = np.flatnonzero(counts > 0)
    owner = np.zeros(len(flat), np.int64)  # the first chunk that learned a key answers for it
    _, first = np.unique(inv[told], return_index=True)
    owner[told[first]] = 1
    answer = (total[inv] * 2 + owner).astype(np.uint64)
    at = np.r_[0, np.cumsum([len(k) for k in keys])]
    seen = total > 0
    hist = np.bincount(np.minimum(total, K + 2), minlength=K + 3)
    out = [(rows[0]["slot"], -1, int(seen.sum()), _pack_sorted(distinct[seen]), _pack(total[seen].astype(np.uint64)),
            [int(total.sum()), *hist[1:K + 2].tolist(), int(seen.sum())])]
    out += [(r["slot"], r["chunk"], r["n"], None, _pack(answer[at[i]:at[i + 1]]), None) for i, r in enumerate(rows)]
    return _answers(out)


def _answers(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["slot", "chunk", "n", "keys", "data", "hist"])


def discounts(hist: list[int]) -> np.ndarray:
    """d(0..K + 1) of Good-Turing from the counts of counts n_1..n_(K+1); d is 1 above K."""
    n = [0, *hist]
    d = np.ones(K + 2)
    a = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    for r in range(1, K + 1):
        good = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if n[r] and n[r + 1] and a < 1 else -1.0
        d[r] = good if 0 < good < 1 else (r - absolute) / r
    return d


class Model:
    """Discounts and the unigram level."""

    def __init__(self, uni: list[int], bi: list[int]):
        self.n, self.v = uni[0], uni[-1]
        self.d1, self.d2 = discounts(uni[1:K + 2]), discounts(bi[1:K + 2])
        seen = [uni[r] for r in range(1, K + 1)]
        kept = self.n - sum((1 - self.d1[r]) * r * seen[r - 1] for r in range(1, K + 1))
        self.unknown = 1 - kept / self.n if self.n else 1.0
        self.scale = 1.0
        if self.n and self.unknown < 1 / (self.n + 1):  # no rare tokens: one more count, for the unknown
            self.unknown, self.scale = 1 / (self.n + 1), (self.n / (self.n + 1)) / (kept / self.n)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        known = self.d1[np.minimum(c, K + 1)] * c / max(self.n, 1) * self.scale
        return np.where(c > 0, known, self.unknown)

    def held(self, c: np.ndarray) -> np.ndarray:
        return self.d2[np.minimum(c, K + 1)] * c


def _answered(c: Chunk, answers: pa.Table):
    """Answers by kind, in key order of the chunk."""
    rows = sorted(answers.select(["slot", "data"]).to_pylist(), key=lambda r: r["slot"])
    def of(kind, dtype):
        got = [_unpack(r["data"], dtype) for r in rows if r["slot"] >> 40 == kind]
        return np.concatenate(got) if got else np.zeros(0, dtype)
    return of


def _counts_of(c: Chunk, of):
    """Training counts of the vocabulary and of the contexts (the start of a text comes as often as the end)."""
    _, _, by = c.unigrams()
    n = np.zeros(c.v + 1, np.int64)
    n[by] = (of(UNIGRAM, np.uint64) >> np.uint64(1)).astype(np.int64)
    end = np.flatnonzero(c.vocab == END)
    n[c.v] = n[end[0]] if len(end) else 0
    return n


def _sums(model: Model, slots: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            c = Chunk(row)
            of = _answered(c, right)
            n = _counts_of(c, of)
            p1 = model.unigram(n[:c.v])
            _, ctx, tok, _, _ = c.bigrams()
            got = of(BIGRAM, np.uint64).astype(np.int64)
            mine = (got & 1) == 1
            s1 = np.bincount(ctx[mine], model.held(got[mine] >> 1), c.v + 1)
            s2 = np.bincount(ctx[mine], p1[tok[mine]], c.v + 1)
            have = np.unique(ctx)
            have = have[n[have] > 0]
            by = have[np.argsort(c.hash[have])]
            out.append(_ask_rows(CONTEXT, c.chunk, c.hash[by], n[by], slots, s1[by], s2[by]))
        return pa.Table.from_batches(out) if out else pa.table([pa.array([], k) for k in [pa.int64()] * 3 + [pa.binary()] * 4],
                                                               names=["slot", "chunk", "n", "keys", "counts", "a", "b"])
    return run


def backoff(total: np.ndarray, seen: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """a(h) from c(h), the discounted counts and the unigram mass of what was seen after h. A context
    whose counts are all too large for a discount counts as seen once more, so that something is
    left; its weight is given as a negative number."""
    full = seen > total - 1e-6
    left = 1 - seen / np.where(full, total + 1, total)
    return np.where(full, -1, 1) * left / np.maximum(1 - mass, 1e-15)


def _weights(t: pa.Table) -> pa.Table:
    """Backoff weights of one slot's contexts, stored (chunk -1) and sent to the chunks that ask."""
    rows = sorted(t.to_pylist(), key=lambda r: r["chunk"])
    keys = [_unpack_sorted(r["keys"]) for r in rows]
    distinct, first, inv = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    cat = lambda k, dtype: np.concatenate([_unpack(r[k], dtype) for r in rows])
    total = cat("counts", np.uint64).astype(np.int64)[first]
    a = backoff(total, np.bincount(inv, cat("a", np.float64)), np.bincount(inv, cat("b", np.float64)))
    at = np.r_[0, np.cumsum([len(k) for k in keys])]
    out = [(rows[0]["slot"], -1, len(distinct), _pack_sorted(distinct), _pack(a), None)]
    out += [(r["slot"], r["chunk"], r["n"], None, _pack(a[inv[at[i]:at[i + 1]]]), None) for i, r in enumerate(rows)]
    return _answers(out)


SCORE_SQL = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _scored(model: Model):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in left.to_pylist():
            c = Chunk(row)
            of = _answered(c, right)
            n = _counts_of(c, of)
            p1 = model.unigram(n[:c.v])
            h, ctx, tok, _, use = c.bigrams()
            pair = (of(BIGRAM, np.uint64) >> np.uint64(1)).astype(np.int64)
            alpha = np.ones(c.v + 1)
            have = np.unique(ctx)
            have = have[n[have] > 0]
            alpha[have[np.argsort(c.hash[have])]] = of(CONTEXT, np.float64)
            p = np.where(pair > 0, model.held(pair) / np.maximum(n[ctx] + (alpha[ctx] < 0), 1), np.abs(alpha[ctx]) * p1[tok])
            log = np.log10(np.maximum(p, 1e-300))[use]
            base = np.log10((n[:c.v] + 1) / (model.n + model.v + 1))[c.token]
            add = lambda x: np.add.reduceat(x, c.first)
            parts.append(pa.table([pa.array(c.ids, pa.int64()), pa.array(c.sizes), pa.array(add((n[:c.v] > 0)[c.token].astype(np.int64))),
                                   pa.array(add(base)), pa.array(add(log))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(parts) if parts else pa.table(
            [pa.array([], k) for k in [pa.int64()] * 3 + [pa.float64()] * 2], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
    return run


def score_texts(docs: DataFrame, learn) -> tuple[DataFrame, DataFrame]:
    """(scores of every row, the stored n-gram tables: order, slot, keys, counts or weights).
    ``docs``: doc_id, text; ``learn``: a condition on doc_id, of the rows that are learned from."""
    text = docs.select("doc_id", F.coalesce(learn, F.lit(False)).cast("int").alias("train"), "text")
    chunks = table(text.mapInArrow(_chunks, CHUNK_SQL), "chunks")
    tokens = chunks.select(F.sum("tokens")).first()[0] or 0
    slots = max(1, -(-tokens // SLOT))
    answers = table(chunks.mapInArrow(_asks(slots), ASK_SQL).groupBy("slot").applyInArrow(_merge, ANSWER_SQL)
                    .withColumn("kind", F.shiftright("slot", 40)), "ngrams")
    found = (answers.where("chunk = -1").select("kind", F.posexplode("hist").alias("i", "n")).groupBy("kind", "i")
             .agg(F.sum("n").alias("n")).collect())
    hist = {k: [0] * (K + 3) for k in (UNIGRAM, BIGRAM)}
    for r in found:
        hist[r.kind][r.i] = r.n
    model = Model(hist[UNIGRAM], hist[BIGRAM])
    replies = answers.where("chunk >= 0").select("slot", "chunk", "data")
    asks = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_sums(model, slots), ASK_SQL)
    weights = table(asks.groupBy("slot").applyInArrow(_weights, ANSWER_SQL).withColumn("kind", F.lit(CONTEXT).cast("long")), "weights")
    replies = replies.unionByName(weights.where("chunk >= 0").select("slot", "chunk", "data"))
    scores = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_scored(model), SCORE_SQL)
    stored = answers.unionByName(weights).where("chunk = -1").select("kind", "slot", "n", "keys", F.col("data").alias("numbers"))
    return scores.withColumn("train_tokens", F.lit(model.n).cast("long")), stored
