"""Vector index with a recall target, text index in segments, manifests, chains of updates."""

import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from lodestar.operators.embedding import hash_embedding
from lodestar.operators import ann, vindex
from lodestar.operators import fulltext as ft
from lodestar.operators import textindex as ti
from lodestar.operators.changes import chained_audit
from lodestar.operators.hybrid import retrieve
from lodestar.operators.ingest import ingest_chunks, manifest, publish, published_index
from lodestar.operators.knn import knn_batch
from lodestar.streaming.ingest import stream_update_audit


@pytest.fixture(scope="module")
def vectors(spark):
    """Five hundred random directions, one group of 400 near copies, ties, a zero vector and a missing one."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 24))
    near = x[0] + 0.05 * rng.normal(size=(400, 24))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(np.vstack([x, near, x[1:4], x[1:4] * 2]))]
    rows += [(5000, [0.0] * 24), (5001, None)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return vindex.build_index(vectors, str(tmp_path_factory.mktemp("vi")))


def test_every_row_is_indexed_in_several_cells(spark, vectors, index):
    held = {r.id: r.n for r in vindex.index_rows(spark, index).groupBy("id").agg(F.countDistinct("cell").alias("n")).collect()}
    assert held == {i: index.spill for i in range(906)} and index.rows == 906
    again = vindex.open_index(spark, index.path)
    assert again == index


def test_recall_reaches_its_target_and_distances_are_exact(vectors, index):
    live = vectors.where("id < 5000")
    q = live.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    truth = {(r.qid, r.id): r.distance for r in knn_batch(q, live, 10, exclude="self").collect()}
    got = vindex.search(q, index, exclude_self=True).collect()
    hits = [r for r in got if (r.qid, r.id) in truth]
    assert len(hits) >= 0.98 * len(truth) - 20  # near copies tie
    assert all(abs(truth[r.qid, r.id] - r.distance) <= 1e-6 for r in hits) and not any(r.qid == r.id for r in got)
    assert all(sorted(x.rank for x in got if x.qid == i) == list(range(1, 11)) for i in (0, 7, 499, 905))


def test_all_cells_opened_is_exact_search(vectors, index):
    live = vectors.where("id < 500")
    q = live.where("id < 40").select((F.col("id") + 10_000).alias("qid"), F.col("embedding").alias("qvec"))
    got = vindex.search(q, index, 3, nprobe=index.cells, rerank=30).select("qid", "rank", "distance").collect()
    want = knn_batch(q, vectors.where("id < 5000"), 3).select("qid", "rank", "distance").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_small_tables_have_no_index(vectors, tmp_path):
    assert vindex.build_index(vectors.limit(20), str(tmp_path)) is None


def test_retrieve_takes_the_published_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} " * 60 + f"and {i * i}", f"src{i % 3}") for i in range(130)], "doc_id long, text string, source string")
    base = str(tmp_path / "t")
    path = ingest_chunks(docs, base, embed_fn=hash_embedding())
    index = published_index(spark, base)
    chunks = spark.read.parquet(path)
    assert index.rows == chunks.count() and manifest(spark, base)["vectors"] == index.path
    q = chunks.select(F.col("id").alias("qid"), F.col("content").alias("question"), F.col("embedding").alias("qvec"))
    got = retrieve(q, chunks, None, "hybrid", index=index, max_distance=2.0)
    want = retrieve(q, chunks, None, "hybrid", max_distance=2.0)
    assert {r.mode_used for r in got.collect()} == {"vector"}
    key = ["qid", "id"]
    assert got.select(*key).intersect(want.select(*key)).count() >= 0.95 * want.count()


def test_publishers_at_once_get_numbers_of_their_own(spark, tmp_path):
    base, got = str(tmp_path / "p"), []
    runs = [threading.Thread(target=lambda i=i: got.append(publish(spark, base, f"v{i}"))) for i in range(8)]
    [t.start() for t in runs]
    [t.join() for t in runs]
    assert len(set(got)) == 8 and manifest(spark, base)["number"] == max(got)


# --- text index ------------------------------------------------------------------

WORDS = "alda bjarg dalur eldur foss gil hraun is jokull klettur laut mosi".split()


def brute(rows, stop=()):
    """BM25 of each (word, id) by plain loops."""
    tf = {i: [w for w in t.lower().split() if w not in stop] for i, t in rows.items() if t is not None}
    n, avg = len(tf), sum(map(len, tf.values())) / len(tf)
    out = {}
    for w in {w for x in tf.values() for w in x}:
        df = sum(w in x for x in tf.values())
        for i, x in tf.items():
            c = x.count(w)
            if c:
                out[w, i] = (c, df, math.log(1 + (n - df + .5) / (df + .5)) * c * 2.2 / (c + 1.2 * (.25 + .75 * len(x) / avg)))
    return out


def check(index, rows, stop=()):
    got = {(r.term, r.id): (r.tf, r.df, r.weight) for r in index.postings().collect()}
    want = brute(rows, stop)
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-9 for k in want)
    return want


def test_segments_follow_inserts_changes_deletes_and_redelivery(spark, tmp_path):
    rng, base = random.Random(2), str(tmp_path / "ix")
    rows = {i: " ".join(rng.choices(WORDS, k=rng.randint(0, 30))) for i in range(700)}
    df = lambda d: spark.createDataFrame(list(d.items()), "id long, content string")
    ti.apply_batch(df(rows), base, 0)
    check(ti.TextIndex(spark, base), rows)
    edits = {i: None if i % 3 else f"Nytt {rows[i]}" for i in range(0, 300, 7)} | {900: "alda alda", 901: None}
    rows |= edits
    for _ in range(2):
        ti.apply_batch(df(edits), base, 1)
    index = ti.TextIndex(spark, base, spark.createDataFrame([("foss",)], "term string"))
    assert index.segments == [0, 1]
    check(index, rows, {"foss"})                # a stop word that came later: neither matched nor counted
    merged = index.merge()
    assert len(merged.segments) == 1
    check(merged, rows, {"foss"})
    ti.apply_batch(df(edits), base, 1)         # delivered once more after the merge
    ti.apply_batch(df({0: "gil", 5: None}), base, 2)
    rows |= {0: "gil", 5: None}
    check(ti.TextIndex(spark, base), rows)
    check(ti.TextIndex(spark, base).merge(), rows)


@pytest.mark.parametrize("exclude", [False, True])
def test_search_by_bounds_equals_brute_force(spark, tmp_path, exclude):
    rng, base = random.Random(4), str(tmp_path / "ix")
    many = [f"w{i}" for i in range(300)]
    rows = {i: "alda " + " ".join(rng.choices(many, k=rng.randint(1, 12)) + rng.choices(WORDS, k=rng.randint(0, 9))) for i in range(6000)}
    for n, part in enumerate((rows, {3: "w1 w2 w3 w4", 4: None, 5500: "w1 w1 w2"})):
        ti.apply_batch(spark.createDataFrame(list(part.items()), "id long, content string"), base, n)
        rows |= part
    asked = {1: "w1 w2 w3 alda", 3: "w7 w7 eldur", 7: "Alda", 9: "nothing here", 11: None, 12: "foss w250 w251 w252"}
    q = spark.createDataFrame(list(asked.items()), "qid long, question string")
    index, report = ti.TextIndex(spark, base, spark.createDataFrame([("foss",)], "term string")), {}
    got = ti.search(q, index, 5, exclude_self=exclude, report=report).collect()
    weights = brute(rows, {"foss"})
    for i, text in asked.items():
        words = set((text or "").lower().split()) - {"foss"}
        score = {}
        for (w, d), (_, _, x) in weights.items():
            if w in words and not (exclude and d == i):
                score[d] = score.get(d, 0) + x
        best = sorted((-round(s, 6), d) for d, s in score.items())[:5]
        mine = sorted((-r.relevance, r.id) for r in got if r.qid == i)
        assert [d for _, d in mine] == [d for _, d in best] and all(abs(a[0] - b[0]) < 2e-6 for a, b in zip(mine, best))
    assert report["opened"] < report["blocks"]


def test_search_does_not_shuffle_the_lists(spark, tmp_path):
    base = str(tmp_path / "ix")
    ti.apply_batch(spark.createDataFrame([(i, f"alda w{i % 50}") for i in range(3000)], "id long, content string"), base, 0)
    q = spark.createDataFrame([(1, "alda w3 w4")], "qid long, question string")
    index = ti.TextIndex(spark, base)
    words = ft.query_terms(q).select("term").distinct()
    plan = index.blocks().join(ti._small(words, 32), "term").select("term", "range", "max_tf")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "entries" not in plan  # bounds are read without the ids
    assert [r.id for r in ti.search(q, index, 2).orderBy("rank").collect()] == [3, 4]


# --- chains of updates -------------------------------------------------------------

def test_two_updates_of_one_key_are_a_chain(spark, tmp_path):
    before = spark.createDataFrame([(1, 2), (2, 5), (3, 1)], "k long, v long")
    ups = spark.createDataFrame([(1, 4, 2), (1, 3, 1), (2, 5, 1), (9, 9, 1)], "k long, v long, at long")
    audit, last = chained_audit(before, ups, "k", "v", ["at"])
    assert sorted(map(tuple, audit.collect())) == [(1, 2, 3), (1, 3, 4), (2, 5, 5)]
    assert sorted(map(tuple, last.collect())) == [(1, 4), (2, 5), (9, 9)]
    ups.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ups.schema).parquet(str(tmp_path / "in"))
    got = stream_update_audit(spark, before, stream, "k", "v", str(tmp_path / "out"), str(tmp_path / "ck"), ["at"])
    assert sorted((r.k, r.old_value, r.new_value) for r in got.collect()) == [(1, 2, 3), (1, 3, 4), (2, 5, 5)]
    from lodestar.operators.ingest import load_published
    assert sorted(map(tuple, load_published(spark, str(tmp_path / "out/table")).collect())) == [(1, 4), (2, 5), (3, 1), (9, 9)]


def test_usage_calendar_has_the_empty_months(spark):
    from lodestar.operators.relational import usage_by_month, usage_rows
    rows = [(1, "2026-01-05 07:59:00", 0, "view", 1.5), (2, "2026-01-31 08:00:00", 1, "buy", 2.0), (3, "2026-04-01 23:00:00", 3, "view", 4.25),
            (4, None, 1, "view", 9.0), (5, "2026-04-02 16:00:00", None, "view", 5.75)]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("t"))
    usage = usage_rows(events, spark.createDataFrame([("b",), ("a",), ("b",)], "source string"))
    got = {(r.duration_ms, r.source, r.shift) for r in usage.collect()}
    assert got == {(1.5, "a", "night"), (2.0, "b", "day"), (4.25, "b", "evening"), (9.0, "b", None), (5.75, None, "evening")}
    table = [(str(r.month), r.mode, r.searches, r.avg_ms) for r in usage_by_month(usage).collect()]
    assert table == [(f"2026-0{m}-01", mode, *{(1, "buy"): (1, 2.0), (1, "view"): (1, 1.5), (4, "view"): (2, 5.0)}.get((m, mode), (0, None)))
                     for m in (1, 2, 3, 4) for mode in ("buy", "view")]


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    from lodestar.operators.buckets import BucketTable
    from lodestar.operators.changes import upsert
    base, put = str(tmp_path / "b"), lambda rows, batch: upsert(rows, batch, "k", ["v"]).select("k", "v")
    df = lambda d: spark.createDataFrame(list(d.items()), "k long, v long")
    state, t = {i: i for i in range(2000)}, BucketTable(spark, base, "k", "k long, v long", 32)
    assert not t.exists() and t.apply(df(state), 0, put)
    for n, change in enumerate(({5: -5}, {5: -6, 9000: 1}, {None: 3}), 1):
        state |= change
        assert t.apply(df(change), n, put) and not t.apply(df({5: 77}), n, put)
        written = {p.name for p in (tmp_path / "b" / f"batch={n}").iterdir() if p.name.startswith("_bucket")}
        assert len(written) <= len(change)
    again = BucketTable(spark, base, "k", "k long, v long")
    assert again.buckets == 32 and {r.k: r.v for r in again.table().collect()} == state


def test_knn_merges_two_tasks_per_core_whatever_the_partitions(spark, vectors):
    live = vectors.where("id < 5000")
    q = live.where("id < 30").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    many = live.repartition(300)
    assert sorted(map(tuple, knn_batch(q, many, 4).collect())) == sorted(map(tuple, knn_batch(q, live, 4, strategy="blocks").collect()))
    plan = knn_batch(q, many, 4)._jdf.queryExecution().executedPlan().toString()
    assert f"Coalesce {2 * spark.sparkContext.defaultParallelism}" in plan


def test_rank_over_many_values_equals_a_window(spark):
    from pyspark.sql import Window
    from lodestar.operators.relational import rank_desc
    df = spark.range(3000).select("id", F.pmod(F.xxhash64("id"), F.lit(700)).alias("v"))
    got = rank_desc(df, "v").select("id", "rank").collect()
    want = df.select("id", F.rank().over(Window.orderBy(F.desc("v"))).alias("rank")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_fuzzy_lookup_sends_few_names_to_python(spark):
    from lodestar.operators.textops import _jaro_winkler, fuzzy_candidates, fuzzy_lookup, jaro_winkler_bound
    rng = random.Random(6)
    made = ["".join(rng.choices("aeiourstlnmkþ", k=rng.randint(1, 9))) + rng.choice(["", " hf", "-vík"]) for _ in range(2500)]
    names = spark.createDataFrame([(x,) for x in [*made, "", None, "æ", "almond"]], "name string").union(
        spark.read.parquet(f"{SF01}/part.parquet").select("p_name"))
    every = {r.name for r in names.collect() if r.name is not None}
    for probe in (sorted(every)[700][:-3], "almond", "zzz"):
        bound = {r.name: r.b for r in names.where("name is not null").select("name", jaro_winkler_bound(F.col("name"), probe).alias("b")).collect()}
        assert all(bound[x] >= _jaro_winkler(x, probe) - 1e-12 for x in every)
        want = sorted((-round(_jaro_winkler(x, probe), 6), x) for x in every)[:3]
        assert [r.name for r in fuzzy_lookup(names, probe).collect()] == [x for _, x in want]
    assert fuzzy_candidates(names, sorted(every)[700][:-3], 3).count() < len(every) / 10


def test_embeddings_are_kept_over_runs(spark, tmp_path):
    from lodestar.operators.embedding import embed_cached
    calls = tmp_path / "calls"
    calls.mkdir()

    def embed(texts):
        (calls / str(random.getrandbits(64))).write_text("\n".join(texts))
        return hash_embedding(8)(texts)

    asked = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "id long, question string")
    first, n = embed_cached(asked("a", "b", "a", None), str(tmp_path / "s"), embed_fn=embed)
    assert n == 2 and [r.id for r in first.where("qvec is null").collect()] == [3]
    again, n = embed_cached(asked("b", "c", "a"), str(tmp_path / "s"), embed_fn=embed)
    assert n == 1 and again.where("qvec is null").count() == 0
    vec = {r.question: list(r.qvec) for r in first.where("question is not null").collect()}
    assert all(vec.get(r.question, list(r.qvec)) == list(r.qvec) for r in again.collect())
    assert sorted(x for f in calls.iterdir() for x in f.read_text().split()) == ["a", "b", "c"]
