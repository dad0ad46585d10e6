"""Embedding texts through a pluggable function, in Arrow batches.

``embed_fn(list[str]) -> list[list[float]]`` is called once per Arrow batch
(``spark.sql.execution.arrow.maxRecordsPerBatch`` texts); a count mismatch is an
error. Every job is given its function; ``hash_embedding`` is a deterministic
stand-in for tests and for tables that come without a model: a unit Gaussian
vector seeded by the SHA-256 of the text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EmbedFn = Callable[[list[str]], list]


def hash_embedding(dims: int = 64) -> EmbedFn:
    """Deterministic unit vectors: a Gaussian sample seeded by SHA-256 of the text."""
    def embed(texts: list[str]) -> list:
        out = []
        for t in texts:
            seed = int.from_bytes(hashlib.sha256(t.encode("utf-8")).digest()[:8], "little")
            v = np.random.default_rng(seed).standard_normal(dims)
            out.append((v / np.linalg.norm(v)).astype(np.float32))
        return out
    return embed


def embed_column(df: DataFrame, text: str = "content", out: str = "embedding", *, embed_fn: EmbedFn) -> DataFrame:
    """``df`` plus an ``array<float>`` embedding of ``text`` (null: the empty text)."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            vectors = embed_fn(texts)
            if len(vectors) != len(texts):
                raise RuntimeError(f"embedding returned {len(vectors)} vectors for {len(texts)} texts")
            vectors = [np.asarray(v, dtype=np.float32) for v in vectors]
            offsets = np.cumsum([0, *map(len, vectors)], dtype=np.int32)
            values = pa.array(np.concatenate(vectors) if vectors else np.zeros(0, np.float32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def embed_distinct(df: DataFrame, text: str = "question", out: str = "qvec", *, embed_fn: EmbedFn) -> DataFrame:
    """Embed each distinct text once and join the vectors back (the question cache)."""
    uniq = df.select(F.col(text).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    vecs = embed_column(uniq, "_text", out, embed_fn=embed_fn)
    return df.join(vecs, df[text] == vecs["_text"], "left").drop("_text")


def embed_cached(df: DataFrame, store: str, text: str = "question", out: str = "qvec", *, embed_fn: EmbedFn) -> tuple[DataFrame, int]:
    """``df`` with the embedding of ``text``, and how many texts had to be embedded for it.

    ``store`` keeps vectors by the hash of their text over all runs: texts that it lacks (an anti-join on the hash) are embedded once
    each and added as a further part; its manifest names the parts, so a run that fails half-way adds nothing. A null text has no
    vector."""
    from lodestar.operators.ingest import manifest, publish

    spark, schema = df.sparkSession, f"hash string, {out} array<float>"
    parts = (manifest(spark, store) or {"parts": []})["parts"]
    known = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    texts = df.select(F.col(text).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    new = texts.withColumn("hash", F.sha2("_text", 256)).join(known.select("hash"), "hash", "left_anti")
    if new.limit(1).count():
        part = f"{store.rstrip('/')}/part-{uuid.uuid4().hex}"
        embed_column(new, "_text", out, embed_fn=embed_fn).select("hash", out).write.parquet(part)
        publish(spark, store, part, parts=[*parts, part])
        added = spark.read.schema(schema).parquet(part)
        fresh, known = added.count(), known.unionByName(added)
    else:
        fresh = 0
    joined = df.withColumn("_hash", F.sha2(F.col(text), 256)).join(known.withColumnRenamed("hash", "_hash"), "_hash", "left")
    return joined.drop("_hash"), fresh
