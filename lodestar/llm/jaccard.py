"""Exact n-gram Jaccard self-join with a token-group matrix.

A document's tokens are the distinct 64-bit hashes of its 5-word shingles. Documents with equal
sets are one class, represented by its smallest id. Then

1. *partition*: classes that agree on one of ``SIGNATURES`` min-hashes are compared with one pivot
   of their bucket each (linear work) and, where they link, form a group of similar documents;
2. *matrix*: every class keeps the first ``n - ceil(0.75 n) + 1`` tokens of its set in one global
   order (words frequent in a sample last, then by hash). Two linked sets share such a token.
   The matrix holds, per token, the groups whose union of these tokens has it; tokens of a single
   group are dropped;
3. *bound*: for a document and another group, the number of matrix tokens they share bounds
   the overlap with any member from above; the group is opened only if that reaches what 0.75 needs
   for some member size;
4. *open*: members of opened groups are compared exactly. A group's whole sets lie in blocks of about
   ``BLOCK_BYTES``, and one row compares a document with all members of a block: with those of the first
   block, and, where none of these linked, with every other block.

Documents already in one group need no further link between them, so the result (the smallest id
reachable) is exact while the thousands of near copies of one text cost one comparison each.
The sampled frequencies only choose the order; any order gives the same result.

Defined results: null and empty texts have no shingles and are alone; fewer than 5 words are one
shingle; rows with one doc_id are one node (all their texts link it); a row without an id is
returned with a null component and links nothing. Every row of the input is returned once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import components, small_side, table
from lodestar.llm.words import NONSPACE, Texts, mix, slices, windows

WIDTH = 5
NUM, DEN = 75, 100      # similarity
SIGNATURES = 4
BLOCK_BYTES = 64 << 10  # of members' sets that a document is compared with in one row, about
SAMPLE = 16             # one class in so many tells which tokens are frequent
HOT_COUNT = 4           # so often in the sample: frequent
HOT_MOST = 400_000      # most frequent tokens that are broadcast (8 bytes each)


def token_sets(t: Texts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, tokens): the sorted distinct shingle hashes of text i are tokens[bounds[i]:bounds[i + 1]]."""
    s, e = t.words(NONSPACE)
    own = t.text_of(s)
    h = t.hashes(s, e)
    w = windows(h, width)
    first = np.flatnonzero(own[:len(w)] == own[width - 1:]) if len(w) else np.zeros(0, np.int64)
    tok, owner = w[first], own[first]
    n_words = np.bincount(own, minlength=t.n) if len(own) else np.zeros(t.n, np.int64)
    for d in np.flatnonzero((n_words > 0) & (n_words < width)):  # the whole sequence is one shingle
        a = np.searchsorted(own, d)
        tok = np.append(tok, windows(h[a:a + n_words[d]], int(n_words[d])) ^ np.uint64(n_words[d]))
        owner = np.append(owner, d)
    order = np.argsort(tok)
    order = order[np.argsort(owner[order].astype(np.uint16 if t.n < 65536 else np.int64), kind="stable")]
    tok, owner = tok[order], owner[order]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (owner[1:] != owner[:-1])
    tok, owner = tok[new], owner[new]
    return np.searchsorted(owner, np.arange(t.n + 1)), tok


def _reduce(f, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1, x.dtype)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = f.reduceat(x, bounds[:-1][full])
    return out


SETS_SQL = "doc_id long, n long, h1 long, h2 long, " + ", ".join(f"s{k} long" for k in range(SIGNATURES))


def _sets(batches):
    for b, t in slices(batches):
        bounds, tok = token_sets(t)
        cols = [_reduce(np.add, mix(tok + np.uint64(7)), bounds), _reduce(np.bitwise_xor, mix(tok ^ np.uint64(0xABCDEF)), bounds)]
        cols += [_reduce(np.minimum, mix(tok ^ mix(np.array([k + 1], np.uint64))[0]), bounds) for k in range(SIGNATURES)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()), *[pa.array(c.view(np.int64)) for c in cols]],
            names=["doc_id", "n", "h1", "h2", *[f"s{k}" for k in range(SIGNATURES)]])


def _tokens(batches):
    """doc_id and the whole set as bytes, once per text."""
    for b, t in slices(batches):
        bounds, tok = token_sets(t)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(
            [tok[bounds[i]:bounds[i + 1]].tobytes() for i in range(t.n)], pa.binary())], names=["doc_id", "tokens"])


def _prefixes(hot):
    """doc_id, n, and the first n - ceil(0.75 n) + 1 tokens, frequent ones last."""
    def run(batches):
        frequent = hot.value
        for b, t in slices(batches):
            bounds, tok = token_sets(t)
            n = np.diff(bounds)
            owner = np.repeat(np.arange(t.n), n)
            if len(frequent) and len(tok):
                at = np.minimum(np.searchsorted(frequent, tok), len(frequent) - 1)
                late = frequent[at] == tok
                order = np.lexsort((np.arange(len(tok)), late, owner))
                tok = tok[order]
            p = np.where(n > 0, n - -(-NUM * n // DEN) + 1, 0)
            rank = np.arange(len(tok)) - np.repeat(bounds[:-1], n)
            keep = tok[rank < np.repeat(p, n)]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(p)], pa.int32()), pa.array(keep.view(np.int64)))],
                names=["doc_id", "n", "tokens"])
    return run


def _views(column: pa.Array) -> list[np.ndarray]:
    """The token sets of a binary column, without a copy."""
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].tolist()
    data = column.buffers()[2]
    return [np.frombuffer(data, np.uint64, (hi - lo) // 8, lo) for lo, hi in zip(offs, offs[1:], strict=False)]


def _linked(batches):
    """Pairs whose sets reach the similarity."""
    for b in batches:
        keep = []
        for x, y in zip(_views(b.column("ta")), _views(b.column("tb")), strict=True):
            both = np.concatenate([x, y])
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            keep.append(DEN * same >= NUM * (len(x) + len(y) - same))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked_members(batches):
    """Pairs (a, b) of a document and the members b of a block whose sets reach the similarity."""
    for b in batches:
        out_a, out_b = [], []
        lists, ids = b.column("sets"), b.column("ids")
        bounds, flat = lists.offsets.to_numpy(), _views(lists.values)
        id_bounds, id_flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        for i, (a, x) in enumerate(zip(b.column("a").to_pylist(), _views(b.column("tokens")), strict=True)):
            members = flat[bounds[i]:bounds[i + 1]]
            n = np.array([len(m) for m in members])
            both = np.concatenate(members)
            hit = x[np.minimum(np.searchsorted(x, both), len(x) - 1)] == both
            same = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
            got = id_flat[id_bounds[i]:id_bounds[i + 1]][DEN * same >= NUM * (len(x) + n - same)]
            out_a.append(np.full(len(got), a, np.int64))
            out_b.append(got)
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])


def whole_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and the whole set of every row of ``docs`` whose id is among ``ids`` and whose text has words."""
    texts = docs.select("doc_id", "text").join(small_side(ids, 24), "doc_id", "left_semi")
    return table(texts.mapInArrow(_tokens, "doc_id long, tokens binary").where("length(tokens) > 0"), "tokens")


def compare(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole texts link."""
    ids = table(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sets = whole_sets(ids, docs)
    out = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta")), "a")
           .join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb")), "b"))
    return table(out.select("a", "b", "ta", "tb").mapInArrow(_linked, "a long, b long").distinct(), "links")


def _need(nq, lo, hi):
    """Fewest shared prefix tokens of a document of size nq and a linked one of size lo to hi."""
    def ceil(x):
        return F.ceil(x / F.lit(float(DEN)))
    least = F.ceil((nq + lo) * NUM / (NUM + DEN) - 1e-9) - ceil(nq * NUM) + 1
    other = F.ceil((nq + hi) * NUM / (NUM + DEN) - 1e-9) - ceil(hi * NUM)
    return F.greatest(F.lit(1), F.least(least, other))


def link_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, links): sizes and digests per row; the class of every repeated set; exact links
    that connect all linked classes."""
    spark = docs.sparkSession
    d = docs.select("doc_id", "text")
    sets = table(d.mapInArrow(_sets, SETS_SQL), "sets")
    full = sets.where("n > 0 and doc_id is not null")
    classes = table(full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
                    .where("copies > 1").select("h1", "h2", "n", "rep"), "classes")
    marked = full.join(small_side(classes, 40), ["h1", "h2", "n"], "left")
    reps = marked.where("rep is null or rep = doc_id").select("doc_id", "n", *[f"s{k}" for k in range(SIGNATURES)])
    # 1. groups: every class against one pivot of each of its buckets
    pairs = None
    for k in range(SIGNATURES):
        pivot = reps.groupBy(f"s{k}").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("top")).where("b < top").drop("top")
        one = reps.join(pivot, f"s{k}").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
        pairs = one if pairs is None else pairs.unionByName(one)
    links = compare(table(pairs.distinct(), "pivots"), d)
    groups = components(links, "groups")
    # 2. matrix
    sample = d.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(_exploded, "token long")
    counts = table(sample.groupBy("token").count().where(F.col("count") >= HOT_COUNT), "frequent")
    by = sorted(counts.groupBy("count").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r[0])
    least, total = None, 0
    for r in by:
        if total + r.n > HOT_MOST:
            break
        least, total = r[0], total + r.n
    hot = np.zeros(0, np.uint64) if least is None else np.sort(
        np.array(counts.where(F.col("count") >= least).select("token").toPandas()["token"], np.int64).view(np.uint64))
    spare = marked.where("rep is not null and rep <> doc_id").select("doc_id", F.lit(None).cast("long").alias("root"))
    special = table(spare.unionByName(groups.withColumnRenamed("id", "doc_id")).withColumn("special", F.lit(True)), "special")
    sent = spark.sparkContext.broadcast(hot)
    prefix = table(d.where("doc_id is not null").mapInArrow(_prefixes(sent), "doc_id long, n long, tokens array<long>")
                   .where("n > 0").join(small_side(special, 32), "doc_id", "left").where("special is null or root is not null")
                   .select("doc_id", "n", F.coalesce("root", "doc_id").alias("grp"), "tokens"), "prefix")
    sent.destroy()  # the prefixes are written
    shared = table(prefix.select(F.explode("tokens").alias("token"), "grp").groupBy("token").agg(
        F.min("grp").alias("a"), F.max("grp").alias("b")).where("a < b").select("token"), "shared")
    rows = table(prefix.select(F.explode("tokens").alias("token"), "doc_id", "n", "grp").join(shared, "token"), "matrix")
    size = table(prefix.groupBy("grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"),
                                            F.ceil(F.sum("n") * F.lit(8.0 / BLOCK_BYTES)).cast("long").alias("parts")), "sizes")
    matrix = rows.select("token", "grp").distinct().join(size, "grp").select("token", F.col("grp").alias("other"), "lo", "hi", "parts")
    # 3. bound; a pair of groups is looked at from the one with the larger id
    low, high = F.ceil(F.col("n") * NUM / DEN), F.floor(F.col("n") * DEN / NUM)
    lo, hi = F.greatest("lo", low), F.least("hi", high)
    met = rows.join(matrix, "token").where((F.col("grp") > F.col("other")) & (lo <= hi))
    opened = table(met.groupBy("doc_id", "n", "other", "lo", "hi", "parts").agg(F.count(F.lit(1)).alias("c"))
                   .where(F.col("c") >= _need(F.col("n"), lo, hi))
                   .select(F.col("doc_id").alias("a"), "other", "parts").distinct(), "opened")
    # 4. open: against the first block; whoever links to a member there needs no other block
    chosen = table(opened.select("other", "parts").distinct(), "chosen")
    members = table(prefix.select(F.col("grp").alias("other"), F.col("doc_id").alias("b")).distinct().join(chosen, "other").select(
        "other", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("block")), "members")
    whole = whole_sets(opened.select(F.col("a").alias("doc_id")).unionByName(members.select(F.col("b").alias("doc_id"))).distinct(), d)
    blocks = (members.join(whole.withColumnRenamed("doc_id", "b"), "b").groupBy("other", "block")
              .agg(F.collect_list(F.struct("b", "tokens")).alias("m")).select("other", "block", F.col("m.b").alias("ids"), F.col("m.tokens").alias("sets")))
    blocks = table(blocks, "blocks")

    def against(asked: DataFrame) -> DataFrame:
        met = asked.join(whole.withColumnRenamed("doc_id", "a"), "a").join(blocks, ["other", "block"])
        return table(met.select("a", "tokens", "ids", "sets").mapInArrow(_linked_members, "a long, b long"), "links")

    links = links.unionByName(against(opened.select("a", "other", F.lit(0).cast("long").alias("block"))))
    roots = components(links, "groups")
    left = (opened.where("parts > 1")
            .join(roots.select(F.col("id").alias("a"), F.col("root").alias("r1")), "a", "left")
            .join(roots.select(F.col("id").alias("other"), F.col("root").alias("r2")), "other", "left")
            .where(F.coalesce("r1", "a") != F.coalesce("r2", "other")))
    rest = left.select("a", "other", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts") - 1)).alias("block"))
    return sets, classes, links.unionByName(against(table(rest, "rest")))


def _exploded(batches):
    """The set of each text, a row per token: in one pass, for a second one in the same task would need a worker of its own,
    which an executor then keeps."""
    for _, t in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(token_sets(t)[1].view(np.int64))], names=["token"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest id reachable)."""
    sets, classes, links = link_groups(docs)
    # a row whose set is another class than its id's first row links its id with that class
    mine = sets.join(small_side(classes, 40), ["h1", "h2", "n"], "left")
    same = mine.where("rep is not null and rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(links.unionByName(same), "roots")
    return sets.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
