"""Round 4: folders read by tasks, exact search in single precision with a bound, text counts kept by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.sources import tables


def test_a_folder_is_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """Names as Spark's reader gives them, escaped ones and null too; hidden files are left out; the driver holds no list of files."""
    monkeypatch.setattr(tables, "FILES_AT_ONCE", 4)
    rows = [("doc1", "one"), ("a b/c%d", "two\nlines"), ("", "none"), (None, "none too"), ("þ=x", ""), ("doc2", None)]
    tables.write_documents(spark.createDataFrame(rows, "name string, text string").repartition(3), str(tmp_path / "docs"))
    for hidden in ("_SUCCESS", ".doc.txt.crc", "name=doc1/_half.txt", "name=doc1/.x.txt", "name=doc1/other.bin"):
        (tmp_path / "docs" / hidden).write_text("not this")
    read = lambda: tables.load_documents(spark, str(tmp_path / "docs"), "*.txt", name_column="name")
    assert read().inputFiles() == []
    got = sorted(map(tuple, read().collect()))
    assert got == sorted([("doc1", "one\n", 4), ("a b/c%d", "two\nlines\n", 10), ("unknown", "none\n", 5), ("unknown", "none too\n", 9), ("þ=x", "\n", 1),
                          ("doc2", "\n", 1)])
    with monkeypatch.context() as m:
        m.setattr(tables, "_folder", lambda path: None)  # Spark's reader
        assert sorted(map(tuple, read().collect())) == got
    (tmp_path / "docs" / "stray.txt").write_text("no name")
    with pytest.raises(Exception, match="no folder name="):
        read().collect()


def test_a_folder_without_names_is_read_at_any_depth(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    for at in ("a.txt", "x/b.txt", "x/y/c.txt", "x/y/c.md"):
        (tmp_path / at).write_text(at)
    for pattern, want in (("*.txt", {"a.txt": "a.txt", "b.txt": "x/b.txt", "c.txt": "x/y/c.txt"}), ("[ab].*", {"a.txt": "a.txt", "b.txt": "x/b.txt"})):
        docs = tables.load_documents(spark, str(tmp_path), pattern)
        assert {r.source: r.text for r in docs.collect()} == want
        assert docs.agg(F.sum("bytes")).first()[0] == sum(map(len, want.values()))


@pytest.mark.parametrize("exclude", [None, "self", "group"])
def test_the_best_rows_are_those_of_double_precision(monkeypatch, exclude):
    """Near copies closer than single precision can tell, exact copies (ties to the lower id), lengths 0, and ids that repeat."""
    from lodestar.operators import knn
    monkeypatch.setattr(knn, "DISTANCES", 5000)
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((900, 24)).astype(np.float32).astype(np.float64)
    rows[100:300] = rows[100] + 3e-6 * rng.standard_normal((200, 24))
    rows[300:340], rows[7], rows[450:460] = rows[5], 0.0, rows[450:460] * 1e-9
    ids, groups = np.r_[np.arange(890), np.arange(10)], np.array([f"g{i % 40}" for i in range(900)], object)
    asked = np.r_[0:120, 280:310, 450:455]
    best = knn.TopK(rows[asked], ids[asked], 7, exclude, 6, groups[asked])
    for lo, hi in ((0, 4), (4, 200), (200, 900)):
        best.add(rows[lo:hi], ids[lo:hi], groups[lo:hi])
    norm = np.linalg.norm(rows, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.round(1.0 - rows[asked] @ rows.T / np.outer(norm[asked], norm), 6) + 0.0
    if exclude:
        d[(ids[asked][:, None] == ids) if exclude == "self" else (groups[asked][:, None] == groups)] = np.inf
    want = []
    for q, line in zip(ids[asked], d):
        want += [(q, i, x) for x, i in sorted((x, i) for x, i in zip(line, ids) if np.isfinite(x))[:7]]
    assert list(best.frame().itertuples(index=False, name=None)) == want


@pytest.mark.parametrize("exclude", [None, "self", "group"])
def test_a_corpus_sent_in_parts_gives_what_blocks_give(spark, monkeypatch, exclude):
    from lodestar.operators import knn
    c = tables.corpus(spark, "/root/testdata/sf0.01")
    q = c.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"), F.col("source").alias("qsource"))
    kw = dict(exclude=exclude, qgroup="qsource", group="source")
    want = knn.knn_batch(q, c, 7, strategy="blocks", **kw)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 40 << 10)
    monkeypatch.setattr(knn, "fits_broadcast", lambda *_: False)
    got = knn.knn_batch(q, c, 7, **kw)
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("exact", [False, True])
def test_cells_sent_in_parts_give_what_blocks_give(spark, tmp_path, monkeypatch, exact):
    from lodestar.operators import ann
    c = tables.corpus(spark, "/root/testdata/sf0.01")
    q = tables.vector_questions(c)
    q = q.union(q.where("qid < 3"))  # the same question twice
    index = ann.build_cell_index(c, str(tmp_path / "cells"))
    want = ann.cell_search(q, index, 10, nprobe=3, exclude="self", exact=exact, strategy="blocks").collect()
    monkeypatch.setattr(ann, "BLOCK_BYTES", 40 << 10)
    got = ann.cell_search(q, index, 10, nprobe=3, exclude="self", exact=exact, strategy="rounds")
    assert len(ann._in_rounds(spark, index)) > 2 and "FlatMapCoGroups" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_index_search_from_a_first_distance_to_beat(spark, tmp_path, monkeypatch):
    """All cells opened: the best rows of exact search, with exact copies, ids that repeat, a repeated question and few rows a group."""
    from lodestar.operators import vindex
    from lodestar.operators.knn import knn_batch
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i % 390, [float(v) for v in r]) for i, r in enumerate(x)]
    c = spark.createDataFrame(rows, "id long, embedding array<float>")
    index = vindex.build_index(c, str(tmp_path / "index"))
    q = c.where("id between 40 and 160 or id < 3").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    q = q.where("qid >= 10").union(q.where("qid = 100"))
    monkeypatch.setattr(vindex, "BEGIN", 120)
    got = vindex.search(q, index, 5, nprobe=index.cells, rerank=30, exclude_self=True)
    want = knn_batch(q.distinct(), c, 5, exclude="self")
    distances = lambda df: {r.qid: r.d for r in df.groupBy("qid").agg(F.sort_array(F.collect_list("distance")).alias("d")).collect()}
    got, want = distances(got.where("qid <> 100")), distances(want.where("qid <> 100"))
    assert len(got) > 100 and got == want


def test_stream_counts_words_where_the_chunk_lies(spark, tmp_path):
    """Documents that come twice in a batch and again in a later one: the weights of all counts, and no (word, chunk) pair is shuffled."""
    from lodestar.operators.embedding import hash_embedding
    from lodestar.streaming import ingest as st
    text = lambda i, n: " ".join(f"w{(i * j) % 13} og" for j in range(n))
    first = [(i, "s", text(i, 150)) for i in range(30)] + [(3, "s", text(5, 90)), (None, "s", text(1, 60)), (40, "s", None)]
    for n, rows in enumerate((first, [(3, "s", text(7, 40)), (50, "s", text(9, 80))])):
        spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(str(tmp_path / f"in/{n}"))
        stream = spark.readStream.schema("doc_id long, source string, text string").parquet(str(tmp_path / "in/*"))
        st.stream_chunks(spark, stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), embed_fn=hash_embedding(4))
    counts, chunks = spark.read.parquet(str(tmp_path / "out/postings")), spark.read.parquet(str(tmp_path / "out/chunks"))
    assert counts.where("batch_id = 1").count() and counts.where("term = 'og'").count() == 0
    got = st.postings_from_counts(counts, chunks.select("id"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    plain = counts.groupBy("term", "id").agg(F.sum("tf").alias("tf"))  # the same counts without lengths
    whole = {r.id: r.dl for r in plain.where("id is not null").groupBy("id").agg(F.sum("tf").alias("dl")).collect()}
    n, avgdl = chunks.count(), plain.agg(F.sum("tf")).first()[0] / chunks.count()
    df = {r.term: r["count"] for r in counts.groupBy("term").count().collect()}
    rows = got.collect()
    assert len(rows) == counts.where("id is not null").count() and {r.id for r in rows} == set(whole)
    for r in rows:
        idf = np.log(1 + (n - df[r.term] + 0.5) / (df[r.term] + 0.5))
        assert r.df == df[r.term] and abs(r.weight - idf * r.tf * 2.2 / (r.tf + 1.2 * (0.25 + 0.75 * whole[r.id] / avgdl))) < 1e-9


def test_merged_blocks_are_shuffled_as_numbers(spark):
    from lodestar.operators import textindex as ti
    rows = [("a", 0, [(-31, 2, 9), (4, 1, 5)]), ("a", 0, [(3, 7, 3)]), ("a", 1, [(40, 1, 1)]), ("b", 0, []), ("b", -2, [(-70, 3, 2147483647)])]
    lists = spark.createDataFrame(rows, "term string, range long, entries array<struct<id: long, tf: long, dl: long>>")
    got = ti._blocks(lists)
    assert {(r.term, r.range): ([tuple(e) for e in r.entries], r.n, r.max_tf, r.min_dl) for r in got.collect()} == {
        ("a", 0): ([(-31, 2, 9), (3, 7, 3), (4, 1, 5)], 3, 7, 3), ("a", 1): ([(40, 1, 1)], 1, 1, 1), ("b", -2): ([(-70, 3, 2147483647)], 1, 3, 2147483647)}
    assert got.schema["entries"].dataType.simpleString() == lists.schema["entries"].dataType.simpleString()
    assert "RepartitionByExpression" in got._jdf.queryExecution().optimizedPlan().toString()  # numbers pass it, no structs
