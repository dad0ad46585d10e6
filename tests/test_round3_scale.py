"""Findings of round 3 on time, disk and memory: the same rows by the ways that grow with the input."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from lodestar.operators import fulltext as ft
from lodestar.operators import textindex as ti
from lodestar.operators.embedding import embed_column, hash_embedding
from lodestar.sources.tables import load_documents, write_documents

SF001 = "/root/testdata/sf0.001"


def test_documents_are_written_by_the_tasks_as_the_text_writer_leaves_them(spark, tmp_path):
    rows = [("b", "two\nlines"), ("a/1=x%", "þorskur"), ("c", None), (None, "nameless"), ("d", ""), ("é ö", "raw")]
    docs = spark.createDataFrame(rows, "name string, text string").repartition(3, "name")
    docs.write.partitionBy("name").text(str(tmp_path / "spark"))
    write_documents(docs, str(tmp_path / "tasks"))
    read = lambda p: sorted(map(tuple, load_documents(spark, str(tmp_path / p), "*.txt", name_column="name").collect()))
    assert read("tasks") == read("spark") and len(read("tasks")) == 6
    assert ("b", "two\nlines\n", 10) in read("tasks")
    folders = lambda p: {x.name for x in Path(tmp_path / p).iterdir() if x.is_dir()}
    assert folders("tasks") == folders("spark")
    assert not list(Path(tmp_path / "tasks").rglob("_*"))  # nothing left half-written, no rename of all files at the end of the job


def test_rows_of_one_name_in_a_task_share_a_file(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "name string, text string").coalesce(1)
    write_documents(docs, str(tmp_path / "tasks"))
    got = {r.source: r.text for r in load_documents(spark, str(tmp_path / "tasks"), "*.txt", name_column="name").collect()}
    assert got == {"a": "x\nx\n", "b": "y\n"}
    assert load_documents(spark, str(tmp_path / "tasks"), "*.txt", name_column="name").agg(F.sum("bytes")).first()[0] == 6


def test_reembedding_cuts_the_documents_into_chunks_once(spark):
    import __spark_entry__ as e
    out = e.queries()["reembed_changed"](spark, SF001)
    assert not [f for f in out.inputFiles() if "documents" in f]  # all six readings are of the stored chunks
    assert {r.origin for r in out.select("origin").distinct().collect()} == {"kept", "updated"}
    assert out.where("not follows_text").count() == 0


def test_embedding_hands_other_columns_on_as_they_are(spark):
    df = spark.sql("""SELECT * FROM VALUES (1L, 'a', 9007199254740993L, array('x', null), date'0001-01-01'), (2L, null, null, null, null)
                      t(id, content, big, list, day)""")
    out = embed_column(df, embed_fn=hash_embedding(4))
    assert out.select(*df.columns).collect() == df.collect()
    want = hash_embedding(4)(["a", ""])
    assert [r.embedding for r in out.orderBy("id").collect()] == [v.tolist() for v in want]
    assert embed_column(df.limit(0), embed_fn=hash_embedding(4)).count() == 0


def test_segments_count_words_where_a_range_lies(spark, tmp_path, monkeypatch):
    """Several segments with negative ids, rows that come twice, deletions and stop words equal a fresh build, before and after a merge."""
    monkeypatch.setattr(ti, "WORDS_AT_ONCE", 40)
    base = str(tmp_path / "index")
    word = lambda i: f"w{i % 7} w{i % 7} og w{i % 11} x{abs(i)} og"
    alive = {i: word(i) for i in range(-40, 100)}
    first = [(i, 0, t) for i, t in alive.items()] + [(None, 0, "lost"), (5, 1, "late w5"), (6, 1, None), (7, -1, "early")]
    ti.apply_batch(spark.createDataFrame(first, "id long, at int, content string").repartition(5), base, 0, order=["at"])
    second = [(i, 1, f"new {word(i)}" if i % 3 else None) for i in range(-31, 33, 2)] + [(200, 0, "og og"), (201, 0, "")]
    ti.apply_batch(spark.createDataFrame(second, "id long, at int, content string"), base, 1, order=["at"])
    alive |= {5: "late w5", 6: None}
    alive |= {i: t for i, _, t in second}
    stop = spark.createDataFrame([("og",)], "term string")
    fresh = ft.build_postings(spark.createDataFrame([x for x in alive.items() if x[1] is not None], "id long, content string"), stopwords=stop)
    rows = lambda p: sorted((r.term, r.id, r.tf, r.df, round(r.weight, 9)) for r in p.collect())
    index = ti.TextIndex(spark, base, stop)
    lists = index.lists(index.docs()).where("size(entries) > 0")
    assert lists.count() < index.entries().count() and max(lists.selectExpr("max(size(entries))").first()) <= 2 * ti.RANGE
    assert rows(index.postings()) == rows(fresh)
    merged = index.merge()
    assert merged.segments == [-1] and merged.blocks().groupBy("term", "range").count().where("count > 1").count() == 0
    assert rows(merged.postings()) == rows(fresh)
    docs = {r.id: r.dl for r in merged.docs().collect()}
    assert docs == {i: len([w for w in t.split() if w != "og"]) for i, t in alive.items() if t is not None}


def test_an_empty_batch_is_a_segment(spark, tmp_path):
    ti.apply_batch(spark.createDataFrame([], "id long, content string"), str(tmp_path), 0)
    index = ti.TextIndex(spark, str(tmp_path))
    assert index.docs().count() == 0 and index.postings().count() == 0 and index.merge().postings().count() == 0


def test_recall_report_asks_every_fiftieth_vector_against_copies_of_all(spark, tmp_path):
    import __spark_entry__ as e
    from lodestar.session import data_tag, scratch_path
    for name, first in (("asked", 0), ("none", 1)):
        ids = [i for i in range(first, 120) if first == 0 or i % 50]
        sf = str(tmp_path / name)
        spark.createDataFrame([(i, [float((i * 7 + j * j * (i + 3)) % 23 - 11) for j in range(1, 9)]) for i in ids],
                              "vec_id long, embedding array<float>").write.parquet(f"{sf}/embeddings.parquet")
        spark.createDataFrame([(i, "s", f"text {i}") for i in ids], "doc_id long, source string, text string").write.parquet(f"{sf}/documents.parquet")
        got = {r.method: r.recall_pct for r in e.queries()["recall_report"](spark, sf).collect()}
        base = scratch_path(spark, f"scale_{data_tag(sf)}")
        assert {r.qid for r in spark.read.parquet(f"{base}/queries").collect()} == ({0, 50, 100} if name == "asked" else set())
        assert spark.read.parquet(f"{base}/vectors").count() == 20 * len(ids)
        assert len(got) == 4 and got["exact float32"] == (100.0 if name == "asked" else None)
