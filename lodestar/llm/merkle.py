"""Merkle manifest: a leaf per row, a tree per source, a tree over the sources, and a proof for every row.

Incremental witnesses. A task appends the leaves of one aligned block (``BLOCK`` consecutive ones of a source) to a
growing tree: the run of siblings that is still open at each level is the partial witness of the subtree it
belongs to; every later sibling that completes extends it, and a full run becomes one node of the level above
(``Tree``). A block leaves its root and the witnesses of its members, once per run and not once per leaf.
Block roots are then appended in the same way, in blocks of their own, until one node per source is left, and the
sources' roots likewise. Going down again, each block takes over its parent's witness and extends that of its members.

A source with a third of all rows is dealt over as many tasks as it has blocks. Texts are read once, by the
leaf digests; from there on rows of about 150 bytes travel. A round holds one block per task.

Defined results: leaves of a source ascend by doc_id, rows without one first, equal ones by leaf digest (rows equal in
all columns are interchangeable); a null source is a source of its own, before all others; a row without
siblings has the digest of the empty string as proof; rows without a doc_id are never changed by the query's
tampering; empty texts are values (``0:``), not nulls; extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import numbered, small_side, table

FAN = 16
LEVELS = 2              # levels that one append of a block closes
BLOCK = FAN ** LEVELS
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BLOCKS = "tree long, block long, total long, digest string, levels array<string>, ids array<long>, changed array<string>"
_PATHS = "tree long, idx long, places array<int>, runs array<string>"
_PROOFS = "doc_id long, leaf string, subroot string, root string, places array<int>, siblings array<string>, changed string"
_REPORT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


class Tree:
    """Appended digests and the runs above them. ``levels[l]`` holds the digests of level ``l`` as hex text; the
    part after its last multiple of ``FAN`` is the open run, which later siblings extend."""

    def __init__(self):
        self.levels = [bytearray()]

    def append(self, node: bytes, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append(bytearray())
        run = self.levels[level]
        run += node
        if len(run) % (FAN * HEX) == 0:
            self.append(digest(bytes(run[-FAN * HEX:])), level + 1)

    def close(self, whole: bool) -> bytes:
        """Ends the open runs (a shorter run, even of one node, becomes its digest) and gives the root: that of a ``whole``
        tree as soon as one node is left, that of a block after ``LEVELS`` levels."""
        level = 0
        while len(self.levels[level]) > HEX if whole else level < LEVELS:
            left = len(self.levels[level]) % (FAN * HEX)
            if left:
                self.append(digest(bytes(self.levels[level][-left:])), level + 1)
            level += 1
        del self.levels[level + 1:]
        return bytes(self.levels.pop())


def run_of(levels: list[str], i: int) -> list[tuple[int, str]]:
    """The witness of node ``i`` within its block: its place and its run, level by level."""
    out = []
    for run in levels:
        lo = i // FAN * FAN * HEX
        out.append((i % FAN, run[lo:lo + FAN * HEX]))
        i //= FAN
    return out


def _append_block(rows: pa.Table) -> pa.Table:
    rows = rows.take(pa.array(np.argsort(rows["idx"].to_numpy(), kind="stable")))
    total, tree = rows["total"][0].as_py(), Tree()
    for node in rows["digest"].to_pylist():
        tree.append(node.encode())
    root = tree.close(total <= BLOCK)
    levels = [bytes(x).decode() for x in tree.levels]  # none for a lone leaf, which is its own root
    return pa.table({"tree": [rows["tree"][0].as_py()], "block": [rows["idx"][0].as_py() // BLOCK], "total": [total], "digest": [root.decode()],
                     "levels": pa.array([levels], pa.list_(pa.string())), "ids": pa.array([rows["doc_id"].to_pylist()], pa.list_(pa.int64())),
                     "changed": pa.array([rows["changed"].to_pylist()], pa.list_(pa.string()))})


def _grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Appends ``nodes`` (tree, idx, total, digest, doc_id, changed) round by round: the blocks of each round, and
    the root of each tree. Rounds grow with the logarithm of the largest tree to the base ``BLOCK``."""
    rounds, roots = [], None
    while True:
        blocks = table(nodes.groupBy("tree", F.expr(f"idx div {BLOCK}")).applyInArrow(_append_block, _BLOCKS), "merkle")
        rounds.append(blocks)
        done = blocks.where(F.col("total") <= BLOCK).select("tree", F.col("digest").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        open_ = blocks.where(F.col("total") > BLOCK)
        if not open_.limit(1).count():
            return rounds, table(roots, "roots")
        nodes = open_.select("tree", F.col("block").alias("idx"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), "digest",
                             F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("changed"))


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("places", pa.list_(pa.int32())), ("runs", pa.list_(pa.string()))])
    for batch in batches:
        for r in batch.to_pylist():
            rows = []
            for i in range(len(r["ids"])):
                path = run_of(r["levels"], i)
                rows.append({"tree": r["tree"], "idx": r["block"] * BLOCK + i, "places": [p for p, _ in path] + (r["places"] or []),
                             "runs": [x for _, x in path] + (r["runs"] or [])})
            yield pa.RecordBatch.from_pylist(rows, schema)


def _extended(blocks: DataFrame, upper: list[DataFrame]) -> DataFrame:
    """``blocks`` with the witness of each block's root in the rounds above it."""
    none = blocks.withColumn("places", F.lit(None).cast("array<int>")).withColumn("runs", F.lit(None).cast("array<string>"))
    if not upper:
        return none
    return blocks.join(_paths(upper).withColumnRenamed("idx", "block"), ["tree", "block"], "left")


def _paths(rounds: list[DataFrame]) -> DataFrame:
    """The whole witness of every node that was appended in ``rounds[0]``: tree, idx, places, runs."""
    return _extended(rounds[0], rounds[1:]).mapInArrow(_unfold, _PATHS)


@dataclass
class Manifest:
    """``members``: one row per block of leaves with ids, digests and the witness of the block (places, runs), subroot;
    ``roots``: source, subroot; ``root``: the digest of the whole dataset, null for an empty one."""

    members: DataFrame
    roots: DataFrame
    root: str | None


def leaf_of(fields: dict[str, Column]) -> Column:
    """The leaf digest of a row's fields: ``-`` for null, else byte count, ``:`` and value."""
    parts = []
    for name in FIELDS:
        value = fields[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def build(docs: DataFrame, tamper: Column | None = None) -> Manifest:
    """The manifest of ``docs``. Where the condition ``tamper`` holds, a second leaf (``changed``) of the row with
    its text lower-cased is kept beside the real one, for proofs that have to fail."""
    own = {name: F.col(name) for name in FIELDS}
    lowered = leaf_of(own | {"text": F.translate("text", UPPER, LOWER)})
    changed = F.when(tamper, lowered) if tamper is not None else F.lit(None).cast("string")
    leaves = table(docs.select("doc_id", "source", leaf_of(own).alias("digest"), changed.alias("changed")), "leaves")
    sources = table(numbered(leaves.select("source").distinct(), [F.col("source").asc_nulls_first()], "tree"), "sources")
    n = sources.count()
    named = small_side(sources.withColumnRenamed("source", "name"), 300)
    leaves = leaves.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    leaves = numbered(leaves, [F.col("doc_id").asc_nulls_first(), F.col("digest")], "idx", "tree", "total")
    rounds, subroots = _grow(leaves)
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n).cast("long").alias("total"),
                          F.col("root").alias("digest"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("changed"))
    top_rounds, top_root = _grow(top)
    above = _paths(top_rounds).select(F.col("idx").alias("tree"), F.col("places").alias("up_places"), F.col("runs").alias("up_runs"))
    above = table(above.join(subroots.withColumnRenamed("root", "subroot"), "tree"), "above")
    members = _extended(rounds[0], rounds[1:]).join(small_side(above, 8192), "tree")
    none_int, none_str = F.array().cast("array<int>"), F.array().cast("array<string>")
    members = members.select("tree", "ids", "changed", "levels", "subroot", F.concat(F.coalesce("places", none_int), "up_places").alias("places"),
                             F.concat(F.coalesce("runs", none_str), "up_runs").alias("runs"), "digest")
    first = top_root.first()
    return Manifest(members, sources.join(subroots, "tree").select("source", F.col("root").alias("subroot")), first.root if first else None)


def _leaves(row: dict) -> Iterator[tuple[int | None, str, str | None, list[tuple[int, str]]]]:
    """Each leaf of a block: id, leaf, changed leaf and its whole witness."""
    above = list(zip(row["places"], row["runs"]))
    for i, (doc_id, changed) in enumerate(zip(row["ids"], row["changed"])):
        leaf = row["levels"][0][i * HEX:(i + 1) * HEX] if row["levels"] else row["digest"]
        yield doc_id, leaf, changed, run_of(row["levels"], i) + above


def siblings_of(path: list[tuple[int, str]]) -> list[str]:
    return [run[k:k + HEX] for place, run in path for k in range(0, len(run), HEX) if k != place * HEX]


def fold(leaf: str, path: list[tuple[int, str]]) -> str:
    """The root that ``leaf`` and its siblings give."""
    node = leaf
    for place, run in path:
        node = digest(f"{run[:place * HEX]}{node}{run[(place + 1) * HEX:]}".encode()).decode()
    return node


def proofs(manifest: Manifest) -> DataFrame:
    """The real witnesses: doc_id, leaf, subroot, root, place of the node in its run and siblings, level by level; also
    ``changed``, the tampered leaf. About 5 KB per row: for rows that are asked for, or for writing out whole."""
    root = manifest.root

    def emit(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                            ("places", pa.list_(pa.int32())), ("siblings", pa.list_(pa.string())), ("changed", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                rows = [{"doc_id": i, "leaf": leaf, "subroot": row["subroot"], "root": root, "places": [p for p, _ in path],
                         "siblings": siblings_of(path), "changed": changed} for i, leaf, changed, path in _leaves(row)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.members.mapInArrow(emit, _PROOFS)


def report(manifest: Manifest) -> DataFrame:
    """Per row: the digest of its proof, and whether the (tampered or original) leaf folds to the root with it."""
    root = manifest.root

    def emit(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for doc_id, leaf, changed, path in _leaves(row):
                    proof = "".join(f"{run[:p * HEX]}{run[(p + 1) * HEX:]}" for p, run in path)
                    folded = fold(changed or leaf, path)
                    out.append((doc_id, leaf, row["subroot"], root, digest(proof.encode()).decode(), folded, folded == root))
                names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
                types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return manifest.members.mapInArrow(emit, _REPORT)


ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t),
ids AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL),
crcs AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM ids, tab),
fields AS (SELECT row_number() OVER () AS rid, d.doc_id, source, text,
    coalesce(strlen(d.doc_id::VARCHAR)::VARCHAR || ':' || d.doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
    || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, coalesce(crc % 5 = 0, false) AS bad
  FROM documents d LEFT JOIN crcs c ON c.doc_id = d.doc_id),
leaves AS (SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
    CASE WHEN bad THEN sha256(head || coalesce(strlen(low)::VARCHAR || ':' || low, '-')) END AS changed FROM fields),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes(tree, level, idx, h, n) AS (SELECT tree, 0, idx, leaf, n FROM placed
  UNION ALL SELECT tree, level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16 FROM nodes WHERE n > 1
    GROUP BY tree, level, idx // 16, n),
subs AS (SELECT tree, level AS depth, h FROM nodes WHERE n = 1),
tops(level, idx, h, n) AS (SELECT 0, tree - 1, h, count(*) OVER () FROM subs
  UNION ALL SELECT level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16 FROM tops WHERE n > 1 GROUP BY level, idx // 16, n),
pow AS (SELECT k, (16 ** k)::BIGINT AS p FROM range(16) r(k)),
path AS (SELECT p.rid, q.level, q.idx, q.h, p.idx // k.p AS own FROM placed p JOIN nodes q ON q.tree = p.tree AND q.n > 1 JOIN pow k ON k.k = q.level
    AND q.idx // 16 = p.idx // (16 * k.p)
  UNION ALL SELECT p.rid, s.depth + q.level, q.idx, q.h, (p.tree - 1) // k.p FROM placed p JOIN subs s ON s.tree = p.tree JOIN tops q ON q.n > 1
    JOIN pow k ON k.k = q.level AND q.idx // 16 = (p.tree - 1) // (16 * k.p)),
proofs AS (SELECT rid, sha256(coalesce(string_agg(h, '' ORDER BY level, idx) FILTER (WHERE idx <> own), '')) AS proof_sha256 FROM path GROUP BY rid),
depths AS (SELECT rid, max(level) + 1 AS depth FROM path GROUP BY rid),
runs AS (SELECT rid, level, coalesce(string_agg(h, '' ORDER BY idx) FILTER (WHERE idx < own), '') AS lo,
    coalesce(string_agg(h, '' ORDER BY idx) FILTER (WHERE idx > own), '') AS hi FROM path GROUP BY rid, level),
fold(rid, level, h) AS (SELECT rid, 0, coalesce(changed, leaf) FROM placed
  UNION ALL SELECT f.rid, f.level + 1, sha256(r.lo || f.h || r.hi) FROM fold f JOIN runs r ON r.rid = f.rid AND r.level = f.level),
final AS (SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
    f.h AS folded_root FROM placed p JOIN subs s ON s.tree = p.tree LEFT JOIN proofs q ON q.rid = p.rid LEFT JOIN depths d ON d.rid = p.rid
    JOIN fold f ON f.rid = p.rid AND f.level = coalesce(d.depth, 0))
SELECT *, folded_root = root AS verified FROM final
"""
