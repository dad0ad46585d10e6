"""Operator invariants: embeddings, history, validation, numbering, skew-safe windows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import changes as ch
from lodestar.operators import relational as rel
from lodestar.operators import validate as va
from lodestar.operators.embedding import embed_column, embed_distinct, hash_embedding


def test_embeddings_are_unit_vectors_and_deterministic(spark):
    df = spark.createDataFrame([(1, "hello"), (2, "hello"), (3, "other")], "id long, text string")
    rows = {r["id"]: np.array(r["e"]) for r in embed_column(df, "text", "e", embed_fn=hash_embedding(16)).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-5 for v in rows.values())
    assert np.allclose(rows[1], rows[2]) and not np.allclose(rows[1], rows[3])


def test_embedding_count_mismatch_is_an_error(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(Exception, match="embedding returned 0 vectors"):
        embed_column(df, "text", "e", embed_fn=lambda texts: []).collect()


def test_distinct_texts_are_embedded_once(spark):
    df = spark.createDataFrame([(i, "same question") for i in range(5)], "id long, question string")
    out = embed_distinct(df, "question", "qvec", embed_fn=hash_embedding(8))
    assert out.count() == 5 and out.select(F.to_json("qvec")).distinct().count() == 1


def test_chat_history_keeps_the_last_six_messages(spark):
    msgs = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(20)],
                                 "conv_id long, turn long, role string, text string")
    h = rel.chat_history(msgs).where("turn = 19").first()["history"]
    assert [m["content"] for m in h] == [f"m{t}" for t in range(13, 19)]
    assert rel.chat_history(msgs).where("turn = 0").first()["history"] == []


def test_validation_rejects_with_reasons(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    df = spark.createDataFrame([(1, 5), (1, 4), (2, 9), (3, 2), (None, 1)], "answer_id long, rating int")
    out = va.validate(df, [va.NotNull("NN", ["answer_id"]), va.Check("CK_rating", F.col("rating").between(1, 5)),
                           va.Unique("UQ_answer", ["answer_id"]), va.ForeignKey("FK_answer", ["answer_id"], parent, ["id"])])
    got = sorted(((r["answer_id"], r["rating"], tuple(r["errors"])) for r in out.collect()), key=str)
    assert got == sorted([(1, 5, ("UQ_answer",)), (1, 4, ("UQ_answer",)), (2, 9, ("CK_rating",)),
                          (3, 2, ("FK_answer",)), (None, 1, ("NN",))], key=str)
    assert va.accepted(out).count() == 0 and va.rejected(out).count() == 5


def test_dense_index_is_contiguous(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(13)
    idx = rel.dense_index(df, ["k"], "n", 1000)
    rows = sorted((r["k"], r["n"]) for r in idx.collect())
    assert [n for _, n in rows] == list(range(1000, 2000))


def test_rank_without_a_global_window_equals_rank(spark):
    df = spark.createDataFrame([(f"s{i}", c) for i, c in enumerate([5, 3, 5, 1, 3, 9])], "source string, chunks long")
    got = {r["source"]: r["r"] for r in rel.rank_desc(df, "chunks", "r").collect()}
    want = {r["source"]: r["r"] for r in df.withColumn("r", F.rank().over(Window.orderBy(F.col("chunks").desc()))).collect()}
    assert got == want


def test_next_in_key_handles_a_hot_key(spark):
    # key 0 holds a third of the rows and spans several range partitions
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
                                     F.col("id").alias("ts"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    got = {(r["k"], r["ts"]): r["nxt"] for r in ch.next_in_key(df, "k", ["ts"], "ts", "nxt").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = {(r["k"], r["ts"]): r["nxt"] for r in df.withColumn(
        "nxt", F.lead("ts").over(Window.partitionBy("k").orderBy("ts"))).collect()}
    assert got == want


def test_upsert_origins(spark):
    t = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long")
    s = spark.createDataFrame([(2, 21), (3, 30)], "k long, v long")
    got = {r["k"]: (r["v"], r["origin"]) for r in ch.upsert(t, s, "k", ["v"]).collect()}
    assert got == {1: (10, "kept"), 2: (21, "updated"), 3: (30, "inserted")}


def test_update_audit_logs_unchanged_rows_too(spark):
    before = spark.createDataFrame([(1, 4), (2, 5)], "id long, rating int")
    after = before.withColumn("rating", F.lit(4))
    rows = sorted((r["id"], r["old_value"], r["new_value"]) for r in ch.update_audit(before, after, "id", "rating").collect())
    assert rows == [(1, 4, 4), (2, 5, 4)]


def test_sequence_context_matches_windows_with_a_hot_key(spark):
    from lodestar.operators.sequence import sequence_context
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"),
                                     F.col("id").alias("t"), (F.col("id") * 7).alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    got = {(r["k"], r["t"]): (r["position"], [h["v"] for h in r["history"]])
           for r in sequence_context(df, "k", ["t"], ["v"], 3).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    w = Window.partitionBy("k").orderBy("t")
    want = {(r["k"], r["t"]): (r["p"], [h["v"] for h in r["h"]]) for r in df.select(
        "k", "t", F.row_number().over(w).alias("p"),
        F.collect_list(F.struct("v")).over(w.rowsBetween(-3, -1)).alias("h")).collect()}
    assert got == want


def test_ingest_publishes_a_new_version_and_keeps_the_old_one(spark, tmp_path):
    from lodestar.operators.ingest import ingest_chunks, load_published
    base = str(tmp_path / "chunks")
    v1 = spark.createDataFrame([(1, "a.txt", "first version of the text " * 30)], "doc_id long, source string, text string")
    v2 = spark.createDataFrame([(1, "a.txt", "second version " * 10), (2, "b.txt", "another document here " * 5)],
                               "doc_id long, source string, text string")
    p1 = ingest_chunks(v1, base, version="1", embed_fn=hash_embedding())
    assert load_published(spark, base).count() == spark.read.parquet(p1).count() == 2
    p2 = ingest_chunks(v2, base, version="2", embed_fn=hash_embedding())
    now = load_published(spark, base)
    assert {r["source"] for r in now.collect()} == {"a.txt", "b.txt"}
    assert sorted(r["id"] for r in now.collect()) == list(range(1, now.count() + 1))
    assert spark.read.parquet(p1).count() == 2 and p1 != p2  # the old version is still readable


def test_encryption_round_trip_and_wrong_key(spark):
    from lodestar.operators.secure import decrypt, encrypt
    key, wrong = F.lit("k" * 32), F.lit("w" * 32)
    r = spark.range(1).select(encrypt(F.lit("jon@example.is"), key).alias("e")).select(
        decrypt(F.col("e"), key).alias("ok"), decrypt(F.col("e"), wrong).alias("bad")).first()
    assert r["ok"] == "jon@example.is" and r["bad"] is None


def test_running_total_matches_the_window_with_a_hot_key(spark):
    from lodestar.operators.sequence import running_total
    df = spark.range(0, 2000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 25).alias("k"),
                                     F.col("id").alias("t"), (F.col("id") % 7).alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    got = {(r["k"], r["t"]): r["rt"] for r in running_total(df, "k", ["t"], "v", "rt").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r["k"], r["t"]): r["rt"] for r in df.withColumn("rt", F.sum("v").over(w)).collect()}
    assert got == want


def test_load_documents_names_each_file(spark, tmp_path):
    from lodestar.sources.tables import load_documents
    (tmp_path / "a.txt").write_text("Fyrsta skjalið.", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_text("Annað skjal.", encoding="utf-8")
    (tmp_path / "skip.pdf").write_bytes(b"%PDF")
    (tmp_path / "sheet.docx").write_bytes(b"PK\x03\x04 and so on")
    (tmp_path / "zero").write_bytes(b"a\x00b")
    (tmp_path / "latin").write_bytes("æ".encode("latin-1"))
    got = {r["source"]: r["text"] for r in load_documents(spark, str(tmp_path), others="skip").collect()}
    assert got == {"a.txt": "Fyrsta skjalið.", "b.txt": "Annað skjal."}
    with pytest.raises(Exception, match="not a text file"):
        load_documents(spark, str(tmp_path)).collect()


def test_row_history_at_sf01_through_collect(spark):
    """Regression: partition ids must agree across plan branches also when the result is
    collected (this once lost successors at partition boundaries)."""
    from lodestar.operators.changes import next_in_key
    ev = spark.read.parquet("/root/testdata/sf0.1/events.parquet").select("user_id", "ts", "event_id")
    got = {(r["user_id"], r["event_id"]): r["nxt"] for r in next_in_key(ev, "user_id", ["ts", "event_id"], "ts", "nxt").collect()}
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    want = {(r["user_id"], r["event_id"]): r["nxt"] for r in ev.withColumn("nxt", F.lead("ts").over(w)).collect()}
    assert got == want
