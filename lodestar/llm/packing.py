"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids (a public tokenizer, then id 1) and pieces of at most ``CAPACITY`` ids;
only longer documents are cut. Pieces are dealt to shards of about ``SHARD`` pieces, and every
shard has ``ISLANDS`` islands, each evolving packings of the shard's pieces in a task of its own.
Crossover injects whole well-filled sequences of one parent into the other, drops the sequences that
hold a piece twice, and best-fits the displaced pieces; mutation dissolves the emptiest sequences.
Between epochs the best packing of an island migrates to the next one. Sequences that stay under
``WEAK`` full after the last epoch are pooled over all shards and packed once more, so the number of
shards costs no sequences. A shard whose sequences reach the lower bound stops early.

The work of a task is bounded by the shard size; the number of shards grows with the documents.

Tokenising: texts of ASCII and the Latin-1 letters are cut into the tokenizer's own pre-tokens
by vectorised passes, and every distinct pre-token is encoded once per worker (bounded cache); any
other text goes to the tokenizer whole. Both give the same ids.

Defined results: null and empty texts are one piece of one id (the end, 1); repeated rows are packed
each; a null doc_id is kept as null."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import table
from lodestar.llm.words import EXACT, HELD, Texts, slices

CAPACITY = 4096
END = 1
SHARD = 16_000
ISLANDS, EPOCHS, POPULATION = 2, 2, 3
CHILDREN = 20    # of an island in one epoch at least
EFFORT = 60_000  # pieces that an island places in one epoch of children, where that makes more of them
POOL = 48        # displaced pieces that an exchange looks at together
WEAK = 0.97
CACHE_UNITS = 1_500_000
LINE = 512       # pre-tokens that go to the tokenizer together

#: Byte classes of the fast path: 0 white space, 1 letter, 2 digit, 3 other.
CLASS = np.full(256, 3, np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] = 0
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = CLASS[0x80:] = 1
CLASS[0x30:0x3A] = 2


class Encoder:
    """Token ids of whole texts; every distinct pre-token is encoded once."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_str(spec)
        vocab = self.whole.get_vocab(with_added_tokens=True)
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # whether an id ends a pre-token
        self.ends[[i for x, i in vocab.items() if suffix and x.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        """Forget all pre-tokens. ``keys`` (sorted hashes) with ``number``; ``first`` and ``size`` by number."""
        self.keys = np.zeros(0, np.uint64)
        self.number = np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of sorted keys; -1 for those not known."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.number[at], -1)

    def _one_by_one(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, and the number of each one's."""
        ids = [e.ids for e in self.whole.encode_batch_fast(units, add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.uint32), np.array([len(x) for x in ids], np.int64)

    def _by_lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, which go to the tokenizer many to a line: each is one pre-token there and its last
        id is one that ends a word, so the ids of a line fall apart again. A line whose ends do not tally goes one by one."""
        lines = [words[lo:lo + LINE] for lo in range(0, len(words), LINE)]
        ids, sizes = [], []
        for line, e in zip(lines, self.whole.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            got = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends[got])
            if len(ends) == len(line) and ends[-1] == len(got) - 1:
                size = np.diff(ends, prepend=-1)
            else:
                got, size = self._one_by_one(line)
            ids.append(got)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        parts, sizes = [], []
        word = np.array([u.isalpha() for u in units], bool)
        for kind, encode in ((word, self._by_lines), (~word, self._one_by_one)):
            at = np.flatnonzero(kind)
            for lo in range(0, len(at), 8192):
                ids, n = encode([units[i] for i in at[lo:lo + 8192]])
                parts.append(ids)
                sizes.append(n)
        keys = np.r_[keys[word], keys[~word]]
        flat, size = np.concatenate(parts), np.concatenate(sizes).astype(np.int32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(max(len(self.ids) // 4, len(flat)), np.uint32)]
        self.ids[self.used:self.used + len(flat)] = flat
        number = np.arange(len(self.size), len(self.size) + len(size), dtype=np.int32)
        self.first = np.r_[self.first, self.used + np.cumsum(size, dtype=np.int64) - size]
        self.size = np.r_[self.size, size]
        self.used += len(flat)
        order = np.argsort(keys)
        keys, number = keys[order], number[order]
        at = np.searchsorted(self.keys, keys)
        self.keys, self.number = np.insert(self.keys, at, keys), np.insert(self.number, at, number)

    @staticmethod
    def plain(t: Texts) -> np.ndarray:
        """Per text: whether the fast path gives the tokenizer's own result."""
        d = t.data
        bad = np.zeros(len(d) + 1, np.int64)
        if len(d):
            odd = (d >= 0xC0) & (d != 0xC3)
            odd[1:] |= (d[:-1] == 0xC3) & ((d[1:] == 0x97) | (d[1:] == 0xB7))
            odd[1:] |= (d[:-1] == 0x3C) & (d[1:] == 0x7C)
            np.cumsum(odd, out=bad[1:])
        return bad[t.offs[1:]] == bad[t.offs[:-1]]

    @staticmethod
    def units(t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of each pre-token."""
        c = CLASS[t.data]
        if not len(c):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (c[1:] == 2)
        new[t.offs[:-1][t.offs[:-1] < len(c)]] = True
        edge = np.flatnonzero(new)
        s, e = edge, np.r_[edge[1:], len(c)]
        keep = c[s] != 0
        s, e = s[keep].copy(), e[keep].copy()
        # 's 't 're 've 'm 'll 'd after a lone apostrophe belong to it
        q = np.flatnonzero((t.data[s] == 0x27) & (e - s == 1))
        q = q[q + 1 < len(s)]
        q = q[(s[q + 1] == e[q]) & (c[s[q + 1]] == 1)] if len(q) else q
        if len(q):
            q = q[~np.isin(e[q], t.offs)]
        if len(q):
            low = t.data | 0x20
            a = low[e[q]]
            two = np.where(e[q + 1] - s[q + 1] >= 2, low[np.minimum(e[q] + 1, len(c) - 1)], 0)
            k = np.where(np.isin(a, list(b"stmd")), 1, 0)
            k = np.where(((a == ord("r")) | (a == ord("v"))) & (two == ord("e")) | (a == ord("l")) & (two == ord("l")), 2, k)
            e[q] += k
            s[q + 1] += k
            keep = e > s
            s, e = s[keep], e[keep]
        return s, e

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids): ids of text i are ids[bounds[i]:bounds[i + 1]], its end id included."""
        if len(self.keys) > CACHE_UNITS:
            self.clear()
        s, e = self.units(t)
        own = t.text_of(s)
        plain = self.plain(t)
        if not plain.all():
            keep = plain[own]
            s, e, own = s[keep], e[keep], own[keep]
        h, where, inv = np.unique(t.hashes(s, e, EXACT), return_index=True, return_inverse=True)
        new = np.flatnonzero(self._find(h) < 0)
        if len(new):
            raw = t.data.tobytes()
            self._learn(h[new], [raw[a:b].decode("utf-8") for a, b in zip(s[where[new]].tolist(), e[where[new]].tolist(), strict=True)])
        at = self._find(h)[inv] if len(h) else np.zeros(0, np.int64)
        size = self.size[at].astype(np.int64)
        ids = self.ids[np.repeat(self.first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        per = np.bincount(own, size, t.n).astype(np.int64) if len(own) else np.zeros(t.n, np.int64)
        slow = {}
        if not plain.all():
            at_ = np.flatnonzero(~plain)
            raw = t.data.tobytes()
            texts = [raw[t.offs[i]:t.offs[i + 1]].decode("utf-8") for i in at_]
            slow = {int(i): np.array(x.ids, np.uint32) for i, x in
                    zip(at_, self.whole.encode_batch_fast(texts, add_special_tokens=False), strict=True)}
        total = per.copy()
        for i, x in slow.items():
            total[i] = len(x)
        bounds = np.r_[0, np.cumsum(total + 1)]
        out = np.full(bounds[-1], END, np.uint32)
        fast = np.arange(len(ids)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(bounds[:-1], per)
        out[fast] = ids
        for i, x in slow.items():
            out[bounds[i]:bounds[i] + len(x)] = x
        return bounds, out


def _pieces(spec, capacity: int):
    def run(batches):
        enc = HELD.get("packing")
        if enc is None:
            enc = HELD["packing"] = Encoder(spec.value)
        for b, t in slices(batches, keep="packing"):
            bounds, ids = enc.encode(t)
            n = np.diff(bounds)
            count = -(-n // capacity)
            row = np.repeat(np.arange(t.n), count)
            piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, n[row] - start)
            raw = ids.astype("<u4").tobytes()
            lo = (bounds[row] + start) * 4
            crc = [zlib.crc32(raw[a:a + 4 * k]) for a, k in zip(lo.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every row of ``docs``: doc_id, piece, start, length, ids_crc32."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select("doc_id", "text").mapInArrow(
        _pieces(spec, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open sequences by free room, for best fit."""

    def __init__(self, capacity: int):
        self.by: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, b: int, room: int) -> None:
        self.by[room].append(b)
        self.mask |= 1 << room

    def take(self, need: int) -> tuple[int, int] | None:
        m = self.mask >> need
        if not m:
            return None
        room = need + (m & -m).bit_length() - 1
        b = self.by[room].pop()
        if not self.by[room]:
            self.mask &= ~(1 << room)
        return b, room


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int, assign: np.ndarray, fill: list[int]) -> None:
    """Put the items of ``order`` one by one into the fullest sequence with room (in place)."""
    bins = Bins(capacity)
    for b, f in enumerate(fill):
        if f < capacity:
            bins.add(b, capacity - f)
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        got = bins.take(need)
        if got is None:
            b, room = len(fill), capacity
            fill.append(0)
        else:
            b, room = got
        assign[i] = b
        fill[b] += need
        if room > need:
            bins.add(b, room - need)


def _dense(assign: np.ndarray) -> np.ndarray:
    return np.unique(assign, return_inverse=True)[1].astype(np.int32)


def fitness(lengths: np.ndarray, assign: np.ndarray, capacity: int) -> float:
    fill = np.bincount(assign, lengths)
    return float(np.mean((fill / capacity) ** 2))


def _packed(lengths: np.ndarray, capacity: int, rng, noise: float) -> np.ndarray:
    assign, fill = np.full(len(lengths), -1, np.int32), []
    best_fit(lengths, np.argsort(-(lengths * (1 + noise * rng.standard_normal(len(lengths)))), kind="stable"), capacity, assign, fill)
    return assign


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Well-filled sequences of ``b`` injected into ``a``; clashing sequences go, displaced items are best-fitted."""
    fill_b = np.bincount(b, lengths)
    good = np.flatnonzero(fill_b >= np.quantile(fill_b, 0.5))
    good = good[rng.random(len(good)) < 0.3]
    inject = np.isin(b, good)
    clash = np.isin(a, np.unique(a[inject]))
    child = np.where(inject, b + a.max() + 1, np.where(clash, -1, a))
    return _repair(child, lengths, capacity)


def _sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The totals of every one and every two of ``x``, and the places of both (the same place twice for one)."""
    i, j = np.triu_indices(len(x))
    return np.where(i == j, x[i], x[i] + x[j]), i, j


def exchange(a: np.ndarray, free: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """One or two displaced pieces take the place of one or two shorter ones wherever a sequence gets fuller by it (in place).
    What is displaced afterwards is shorter and easier to fit. Returns the displaced pieces."""
    order = np.argsort(a, kind="stable")
    cuts = np.searchsorted(a[order], np.arange(a.max() + 2))
    total, i, j = _sums(lengths[free].astype(np.int64))
    rank = np.argsort(total, kind="stable")
    for bin_ in range(len(cuts) - 1):
        here = order[cuts[bin_]:cuts[bin_ + 1]]
        room = capacity - int(lengths[here].sum())
        if not room or not len(here):
            continue
        now, x, y = _sums(lengths[here].astype(np.int64))
        at = np.searchsorted(total, now + room, side="right", sorter=rank) - 1
        gain = np.where(at >= 0, total[rank[at]] - now, 0)
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            continue
        k = rank[at[best]]
        out, into = here[np.unique([x[best], y[best]])], free[np.unique([i[k], j[k]])]
        a[into], a[out] = bin_, -1
        free = np.concatenate([free[~np.isin(free, into)], out])
        total, i, j = _sums(lengths[free].astype(np.int64))
        rank = np.argsort(total, kind="stable")
    return free


def mutate(a: np.ndarray, lengths: np.ndarray, capacity: int, rng) -> np.ndarray:
    """The emptiest sequences and a few others are dissolved; their pieces are exchanged against shorter ones, then best-fitted."""
    fill = np.bincount(a, lengths)
    gone = np.union1d(np.argsort(fill)[:3], rng.integers(0, len(fill), max(1, len(fill) // 100)))
    a = np.where(np.isin(a, gone), -1, a)
    left = np.flatnonzero(a >= 0)
    if len(left):
        a[left] = _dense(a[left])
        exchange(a, rng.permutation(np.flatnonzero(a < 0))[:POOL], lengths, capacity)
    return _repair(a, lengths, capacity)


def _repair(child: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    free = np.flatnonzero(child < 0)
    kept = child >= 0
    out = np.full(len(child), -1, np.int32)
    out[kept] = _dense(child[kept])
    fill = np.bincount(out[kept], lengths[kept]).astype(int).tolist() if kept.any() else []
    best_fit(lengths, free[np.argsort(-lengths[free], kind="stable")], capacity, out, fill)
    return _dense(out)


def evolve(lengths: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int) -> list[np.ndarray]:
    """One epoch of an island: the best packings, best first."""
    rng = np.random.default_rng(seed)
    bound = -(-int(lengths.sum()) // capacity)
    people = list(elites)
    while len(people) < POPULATION:
        people.append(_packed(lengths, capacity, rng, 0.0 if not people else 0.05))
        if people[-1].max() + 1 <= bound:
            break
    rank = lambda x: (int(x.max()), -fitness(lengths, x, capacity))
    people.sort(key=rank)
    for _ in range(max(CHILDREN, EFFORT // len(lengths))):
        if people[0].max() + 1 <= bound or len(people) < 2:
            break
        i, j = sorted(rng.choice(len(people), 2, replace=False))
        people.append(mutate(crossover(people[i], people[j], lengths, capacity, rng), lengths, capacity, rng))
        people = sorted(people, key=rank)[:POPULATION]
    return people


STATE_SQL = "shard long, island int, keys binary, lengths binary, elites array<binary>, sequences int, fit double"


def _evolved(capacity: int, epoch: int):
    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                lengths = np.frombuffer(r.lengths, np.int32)
                people = evolve(lengths, [np.frombuffer(x, np.int32) for x in r.elites], capacity, hash((r.shard, r.island, epoch)) & 0x7FFFFFFF)
                out.append((r.shard, r.island, r.keys, r.lengths, [x.tobytes() for x in people], int(people[0].max()) + 1,
                            fitness(lengths, people[0], capacity)))
            yield pd.DataFrame(out, columns=["shard", "island", "keys", "lengths", "elites", "sequences", "fit"])
    return run


def _gathered(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("key")
    keys, lengths = pdf["key"].to_numpy(np.int64).tobytes(), pdf["length"].to_numpy(np.int32).tobytes()
    return pd.DataFrame([(key[0], i, keys, lengths, [], 0, 0.0) for i in range(ISLANDS)],
                        columns=["shard", "island", "keys", "lengths", "elites", "sequences", "fit"])


def _placed(batches):
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            keys, lengths = np.frombuffer(r.keys, np.int64), np.frombuffer(r.lengths, np.int32).astype(np.int64)
            assign = np.frombuffer(r.best, np.int32).astype(np.int64)
            order = np.lexsort((keys, assign))
            before = np.cumsum(lengths[order]) - lengths[order]
            fill = np.bincount(assign, lengths).astype(np.int64)
            offset = np.empty(len(keys), np.int64)
            offset[order] = before - (np.cumsum(fill) - fill)[assign[order]]
            yield pd.DataFrame({"key": keys, "length": lengths, "shard": r.shard, "bin": assign, "offset": offset, "fill": fill[assign]})


def _pack(items: DataFrame, capacity: int, epochs: int) -> DataFrame:
    """(key, length, shard, bin, offset, fill) of items (key, length, shard)."""
    state = table(items.groupBy("shard").applyInPandas(_gathered, STATE_SQL), "islands")
    for epoch in range(epochs):
        if epoch:
            guest = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"),
                                 F.col("elites")[0].alias("guest"))
            state = state.join(guest, ["shard", "island"]).withColumn(
                "elites", F.concat(F.slice("elites", 1, POPULATION - 1), F.array("guest"))).drop("guest")
            state = state.select("shard", "island", "keys", "lengths", "elites", "sequences", "fit")
        spread = state.repartition("shard", "island")
        state = table(spread.mapInPandas(_evolved(capacity, epoch), STATE_SQL), "islands")
    best = state.groupBy("shard").agg(F.max_by(F.struct("keys", "lengths", F.col("elites")[0].alias("best")),
                                               F.struct(-F.col("sequences"), F.col("fit"))).alias("x"))
    return table(best.select("shard", "x.*").mapInPandas(
        _placed, "key long, length long, shard long, bin long, offset long, fill long"), "places")


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``pieces`` (with ``length``) and for each row its ``sequence_id`` and ``offset``."""
    rows = table(pieces.withColumn("key", F.monotonically_increasing_id()), "pieces")
    n = rows.count()
    if not n:
        return rows.drop("key").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    shards = max(1, -(-n // shard))
    dealt = rows.select("key", "length", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    placed = _pack(dealt, capacity, EPOCHS)
    full = placed.where(F.col("fill") >= WEAK * capacity)
    weak = placed.where(F.col("fill") < WEAK * capacity)
    k = weak.count()
    if shards > 1 and k:
        again = weak.select("key", "length", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-k // shard)))).alias("shard"))
        weak = _pack(again, capacity, EPOCHS).withColumn("shard", F.col("shard") + F.lit(shards))
    placed = full.unionByName(weak)
    return rows.join(placed.select("key", (F.col("shard") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset"), "key").drop("key")
