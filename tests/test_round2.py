"""Nulls in snapshot diffs, doubled quotes in question files, restarts of the update audit, files that readers take."""

import pyarrow as pa
import pyarrow.parquet as pa_parquet

from lodestar.operators.changes import next_in_key, snapshot_changes
from lodestar.operators.evaluate import accepted_sources
from lodestar.operators.ingest import load_published, publish, published_path
from lodestar.operators.secure import visible_counts
from lodestar.sources.tables import load_documents, read_questions_csv
from lodestar.streaming.ingest import append_log, file_stream, stream_update_audit


def test_null_values_are_values_in_a_diff(spark):
    old = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "x"), (5, "same")], "id long, content string")
    new = spark.createDataFrame([(1, None), (2, None), (3, "y"), (5, "same"), (6, None)], "id long, content string")
    got = {r.id: r.operation for r in snapshot_changes(old, new).collect()}
    assert got == {2: "U", 3: "U", 4: "D", 6: "I"}


def test_question_file_with_doubled_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('set,question,source,expected,previous\nhold,"Say ""no"", then go",a|b,"x, y",\n', encoding="utf-8")
    rows = read_questions_csv(spark, str(tmp_path / "q.csv")).collect()
    assert [tuple(r) for r in rows] == [("hold", 'Say "no", then go', "a|b", "x, y", "")]


def test_pointer_keeps_earlier_versions_readable(spark, tmp_path):
    base = str(tmp_path / "t")
    assert published_path(spark, base) is None
    for v in (1, 2, 3):
        spark.range(v).write.parquet(f"{base}/v={v}")
        publish(spark, base, f"{base}/v={v}")
    assert published_path(spark, base).endswith("v=3") and load_published(spark, base).count() == 3


def test_update_audit_goes_on_after_a_restart(spark, tmp_path):
    start = spark.createDataFrame([(1, 2), (2, 7)], "id long, v int")
    src = str(tmp_path / "in")
    run = lambda: stream_update_audit(spark, start, spark.readStream.schema("id long, v int").parquet(src),
                                      "id", "v", str(tmp_path / "out"), str(tmp_path / "ckpt"))
    spark.createDataFrame([(1, 4)], "id long, v int").coalesce(1).write.parquet(src)
    run()
    spark.createDataFrame([(1, 3)], "id long, v int").coalesce(1).write.mode("append").parquet(src)
    got = {(r.old_value, r.new_value) for r in run().collect()}
    assert got == {(2, 4), (4, 3)}
    assert {tuple(r) for r in load_published(spark, str(tmp_path / "out/table")).select("id", "v").collect()} == {(1, 3), (2, 7)}


def test_repeated_grants_count_rows_once(spark):
    docs = spark.createDataFrame([("HR",), ("HR",), ("IT",)], "department string")
    mapping = spark.createDataFrame([("ann", "HR"), ("ann", "HR"), ("dbo", "IT")], "user_name string, department string")
    got = sorted(tuple(r) for r in visible_counts(docs, mapping, "dbo").collect())
    assert got == [("ann", "HR", 2), ("dbo", "HR", 2), ("dbo", "IT", 1)]


def test_null_successors_inside_a_key_stay_null(spark):
    rows = [(1, i, None if i % 3 == 0 else i) for i in range(400)] + [(2, 0, 5), (2, 1, None)]
    df = spark.createDataFrame(rows, "k long, at long, v long")
    got = {(r.k, r.at): r.nxt for r in next_in_key(df, "k", ["at"], "v", "nxt").collect()}
    after = {(k, at): v for k, at, v in rows}
    assert got == {(k, at): after.get((k, at + 1)) for k, at, _ in rows}


def test_short_passages_have_sources(spark):
    texts = {1: "a red fox ran home", 2: "Red fox", 3: "shattered foxes ran", 4: "fox red", 5: "", 6: None}
    asked = {1: "red fox", 2: "a red fox ran", 3: "fox", 4: "owl", 5: "red", 6: "", 7: " - ", 8: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    passages = spark.createDataFrame(list(asked.items()), "item_id long, text string")
    got = {tuple(r) for r in accepted_sources(passages, docs).collect()}
    assert got == {(q, d) for q, p in asked.items() for d, t in texts.items() if p and t and p.strip(" -") and p in t}


def test_folder_reader_takes_every_text_file(spark, tmp_path):
    (tmp_path / "one.txt").write_text("first")
    (tmp_path / "two.md").write_text("# second")
    (tmp_path / "notes").write_text("third")
    got = {r.source: (r.text, r.bytes) for r in load_documents(spark, str(tmp_path)).collect()}
    assert got == {"one.txt": ("first", 5), "two.md": ("# second", 8), "notes": ("third", 5)}


def test_stream_reads_its_own_table_only(spark, tmp_path):
    for name, x in (("part", 1), ("part-2", 2), ("part.3", 3), ("part_sizes", 9), ("parts", 9)):
        pa_parquet.write_table(pa.table({"x": [x]}), tmp_path / f"{name}.parquet")
    got = append_log(spark, file_stream(spark, str(tmp_path), "part", "x long"), str(tmp_path / "sink"), str(tmp_path / "ck"))
    assert sorted(r.x for r in got.collect()) == [1, 2, 3]
