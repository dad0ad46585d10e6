"""Positions and preceding rows: keys only are sorted, any key may be large, null or repeated."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from lodestar.operators import sequence
from lodestar.operators.relational import dense_index


def plain(rows, n):
    """Per key the rows in order of (t, nulls first), each with its place and the values of up to n rows before it."""
    keys = {}
    for k, t, v in rows:
        keys.setdefault(k, []).append((t is not None, t or 0, v))
    out = []
    for k, seq in keys.items():
        seq.sort()
        for i, (has, t, v) in enumerate(seq):
            out.append((k, t if has else None, v, i + 1, [x[2] for x in seq[max(0, i - n):i]]))
    return sorted(out, key=str)


def test_context_over_many_blocks_with_a_hot_and_a_null_key(spark, monkeypatch):
    monkeypatch.setattr(sequence, "BLOCK", 7)
    rows = [(0 if i % 3 == 0 else None if i % 3 == 1 else i % 20, None if i in (3, 4) else i * 31 % 601, f"v{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "k long, t long, v string").repartition(9)
    for n in (1, 5, 7, 9):  # 9: more rows than a block has
        got = sequence.sequence_context(df, "k", ["t"], ["v"], n)
        assert got.columns == ["k", "t", "v", "position", "history"]
        assert sorted(((r.k, r.t, r.v, r.position, [h.v for h in r.history]) for r in got.collect()), key=str) == plain(rows, n)


def test_ties_and_repeated_rows_keep_every_row(spark):
    rows = [("a", 1, "x")] * 4 + [("a", 1, "y")] * 3 + [("a", 2, "z"), ("b", 1, "x")]
    df = spark.createDataFrame(rows, "k string, t long, v string")
    got = sequence.sequence_context(df, "k", ["t"], ["v"], 2).collect()
    assert sorted((r.k, r.t, r.v) for r in got) == sorted(rows)
    assert sorted(r.position for r in got if r.k == "a") == list(range(1, 9))
    at = {r.position: r.v for r in got if r.k == "a"}
    assert at[8] == "z"
    for r in got:
        if r.k == "a":
            assert [h.v for h in r.history] == [at[p] for p in range(max(1, r.position - 2), r.position)]
    numbers = [r.n for r in dense_index(df, ["t"], "n", 10).collect()]
    assert sorted(numbers) == list(range(10, 19))


def test_numbers_replace_a_column_of_their_name_and_empty_tables_give_none(spark):
    df = spark.createDataFrame([(5, 99), (3, 98), (None, 97)], "k long, n long")
    assert {r.k: r.n for r in dense_index(df, ["k"], "n").collect()} == {None: 0, 3: 1, 5: 2}
    assert dense_index(df.limit(0), ["k"], "n").collect() == []
    assert sequence.sequence_context(df.limit(0), "k", ["n"], ["n"], 2).collect() == []


def test_running_total_has_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), (1, 1, 5)], "k long, t long, v long")
    got = {(r.k, r.t): r.s for r in sequence.running_total(df, "k", ["t"], "v", "s").collect()}
    assert got == {(None, 1): 2, (None, 2): 5, (1, 1): 5}


def test_texts_and_maps_are_not_checkpointed(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(50).select("id", (F.col("id") % 3).alias("k"), F.lit("long text").alias("body")).write.parquet(path)
    df = spark.read.parquet(path).withColumn("extra", F.create_map(F.lit("a"), "id"))
    out = sequence.sequence_context(df, "k", ["id"], ["body"], 2)
    assert out.count() == 50
    with contextlib.redirect_stdout(io.StringIO()) as said:
        out.explain("simple")
    kept = re.findall(r"ExistingRDD\[([^\]]*)\]", said.getvalue())
    assert kept and not any("body" in c or "extra" in c for c in kept)
