"""Ranking, fusion, gate and passages against plain Python over a small set of notes with random vectors."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.config import MAX_DISTANCE
from lodestar.operators import ann
from lodestar.operators import fulltext as ft
from lodestar.operators import hybrid as hy
from lodestar.operators.knn import top_k_per_query

STOP = {"og", "til"}


@pytest.fixture(scope="module")
def notes(spark, harbours):
    """(rows by id, unit vectors, corpus, stop list, postings)."""
    rows = {r.doc_id: (r.source, r.text) for r in harbours.collect()}
    vec = np.random.default_rng(4).normal(size=(len(rows), 16)).astype(np.float32)
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(i, s, t, [float(x) for x in vec[i]]) for i, (s, t) in rows.items()],
                                   "id long, source string, content string, embedding array<float>").cache()
    stop = spark.createDataFrame([(w,) for w in STOP], "term string")
    return rows, vec.astype(float), corpus, stop, ft.build_postings(corpus, stopwords=stop).cache()


def words(text):
    return [w for w in re.split(r"\W+", text.lower()) if w and w not in STOP]


def bm25(rows, question):
    bags = {i: words(t) for i, (_, t) in rows.items()}
    n, avg = len(bags), sum(map(len, bags.values())) / len(bags)
    out = Counter()
    for w in set(words(question)):
        df = sum(w in b for b in bags.values())
        for i, b in bags.items():
            if w in b:
                out[i] += math.log(1 + (n - df + .5) / (df + .5)) * b.count(w) * 2.2 / (b.count(w) + 1.2 * (.25 + .75 * len(b) / avg))
    return [i for i, _ in sorted(out.items(), key=lambda x: (-round(x[1], 6), x[0]))]


def by_distance(vec, q):
    d = np.round(1 - vec @ (q / np.linalg.norm(q)), 6)
    return sorted(range(len(vec)), key=lambda i: (d[i], i)), d


def asked(spark, *qs):
    return spark.createDataFrame([(i, t, None if v is None else [float(x) for x in v]) for i, t, v in qs],
                                 "qid long, question string, qvec array<float>")


def test_fused_ranks_equal_plain_fusion(spark, notes):
    rows, vec, corpus, stop, post = notes
    qs = [(1000 + i, text, vec[j] + 0.2 * vec[(j + 1) % 160]) for i, (text, j) in enumerate(
        [("salt og korn", 3), ("Skip17nafn", 90), ("ull ull net", 159), ("ekkert sem finnst", 7), ("til og", 20)])]
    got = {}
    for r in hy.hybrid_search(asked(spark, *qs), corpus, post, stopwords=stop).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id, round(r.score, 12), r.source))
    for qid, text, v in qs:
        near, _ = by_distance(vec, v)
        score = Counter()
        for ranking in (near[:20], bm25(rows, text)[:20]):
            for k, i in enumerate(ranking, 1):
                score[i] += 1 / (60 + k)
        want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted(got[qid]) == [(k, i, round(s, 12), rows[i][0]) for k, (i, s) in enumerate(want, 1)]


def test_a_name_found_by_words_needs_no_near_vector(spark, notes):
    rows, vec, corpus, stop, post = notes
    target = next(i for i, (_, t) in rows.items() if "Skip68nafn" in t)
    away = asked(spark, (1, "skip68NAFN", vec[by_distance(vec, -vec[target])[0][0]]))
    found = lambda mode: {r.id for r in hy.retrieve(away, corpus, post, mode, stopwords=stop).collect()}
    assert target in found("hybrid") and target not in found("vector")


def test_match_counts_leave_stop_words_out(spark, notes):
    rows, _, _, stop, post = notes
    texts = {1: "og til", 2: "hafnar", 3: "ull korn", 4: "Skip0nafn", 5: ""}
    qs = spark.createDataFrame(list(texts.items()), "qid long, question string")
    got = {r.qid: r.matches for r in ft.match_count(qs, post, stopwords=stop).collect()}
    assert got == {q: sum(bool(set(words(t)) & set(words(x))) for _, x in rows.values()) for q, t in texts.items()}
    assert got[1] == 0 and got[2] == len(rows)


def test_cells_and_the_whole_table_give_the_same_first_row(spark, notes, tmp_path):
    _, vec, corpus, _, _ = notes
    idx = ann.build_cell_index(corpus, str(tmp_path / "cells"))
    qs = asked(spark, *[(i, "", vec[i]) for i in range(0, 160, 13)])
    approx, how = ann.vector_top_k(qs, corpus, idx, 3, nprobe=1)
    assert how == "approximate" and {r.qid: r.id for r in approx.where("rank = 1").collect()} == {i: i for i in range(0, 160, 13)}
    assert ann.build_cell_index(corpus.where("id < 99"), str(tmp_path / "few")) is None


def on_the_circle(spark, *cosines):
    return spark.createDataFrame([(i, f"s{i}", f"orð{i}", [c, math.sqrt(1 - c * c)]) for i, c in enumerate(cosines)],
                                 "id long, source string, content string, embedding array<float>")


def test_the_cut_off_itself_is_kept_row_by_row(spark):
    limit = 1 - MAX_DISTANCE
    corpus = on_the_circle(spark, 1.0, limit + 0.01, limit, limit - 0.01, -1.0)
    got = hy.retrieve(asked(spark, (50, "", [1, 0])), corpus, None, "vector").orderBy("n").collect()
    assert [(r.n, r.id, r.mode_used, r.refused) for r in got] == [(1, 0, "vector", False), (2, 1, "vector", False), (3, 2, "vector", False)]


@pytest.mark.parametrize(("vector", "kept"), [([1, 0], {0, 1, 2}), ([-1, 0], {0, 1, 2}), ([0, -1], set())])
def test_the_gate_keeps_or_drops_a_hybrid_question_as_a_whole(spark, vector, kept):
    corpus = on_the_circle(spark, 0.95, 0.2, -0.9)
    got = hy.retrieve(asked(spark, (50, "orð1", vector)), corpus, ft.build_postings(corpus), "hybrid").collect()
    if kept:
        assert {r.id for r in got} == kept and not any(r.refused for r in got)
    else:
        assert [(r.id, r.refused, r.mode_used) for r in got] == [(None, True, "hybrid")]


def test_questions_without_a_vector_and_rows_without_one(spark):
    corpus = on_the_circle(spark, 0.95, 0.2).union(spark.createDataFrame([(7, "s7", "orð7", None)], "id long, source string, content string, embedding array<float>"))
    qs = asked(spark, (50, "orð7", [1, 0]), (51, "orð7", None))
    got = hy.hybrid_search(qs, corpus, ft.build_postings(corpus)).collect()
    assert {r.id for r in got if r.qid == 50} == {0, 1, 7} and [(r.id, r.closest) for r in got if r.qid == 51] == [(7, None)]


def test_without_a_text_index_the_mode_used_is_vector(spark):
    corpus = on_the_circle(spark, 0.9, 0.1)
    assert {r.mode_used for r in hy.retrieve(asked(spark, (5, "orð0", [1, 0])), corpus, None, "hybrid").collect()} == {"vector"}
    with pytest.raises(ValueError, match="unknown mode"):
        hy.retrieve(corpus, corpus, None, "both")


def test_passages_and_context_follow_the_ranks(spark):
    n = 4
    rows = [(q, "hybrid", k, 10 * q + k, f"skjal{k}.txt", 0.12345 * k, False) for q in (1, 2) for k in range(n, 0, -1)] + [
        (3, "hybrid", None, None, None, None, True)]
    got = spark.createDataFrame(rows, "qid long, mode_used string, n long, id long, source string, score double, refused boolean")
    texts = {10 * q + k: f"texti {q}/{k}\nlína" for q in (1, 2) for k in range(1, n + 1)}
    p = hy.passages(got, spark.createDataFrame(list(texts.items()), "id long, content string"))
    for r in p.collect():
        assert [(x.n, x.source, x.content, x.score) for x in r.passages] == [
            (k, f"skjal{k}.txt", texts[10 * r.qid + k], round(0.12345 * k, 4)) for k in range(1, n + 1)]
    want = {q: "\n\n".join(f"[{k}] (skjal{k}.txt)\n{texts[10 * q + k]}" for k in range(1, n + 1)) for q in (1, 2)}
    assert {r.qid: r.context for r in hy.prompt_context(p).collect()} == want


def test_search_text_takes_a_rewrite_that_says_something(spark):
    qs = spark.createDataFrame([(i, f"spurning {i}") for i in range(5)], "qid long, question string")
    rewrites = {0: "ný spurning", 1: "  inndregin \n", 2: "", 3: " \t"}
    got = hy.search_text(qs, spark.createDataFrame(list(rewrites.items()), "qid long, rewritten string"))
    assert {r.qid: r.search_query for r in got.collect()} == {i: rewrites.get(i, "").strip() or f"spurning {i}" for i in range(5)}


@pytest.mark.parametrize("common_df", [1, 12, 80, 10**9])
def test_pruned_ranking_is_the_whole_ranking(notes, harbours, common_df):
    _, _, _, stop, post = notes
    qs = harbours.select(F.col("doc_id").alias("qid"), F.concat(F.substring("text", 1, 40), F.lit(" korn skip5nafn")).alias("question"))
    whole = ft.fulltext_scores(qs, post, stopwords=stop).where("qid <> id")
    want = top_k_per_query(whole, 7, "relevance", descending=True).select("qid", "id", "relevance", "rank").collect()
    got = ft.text_top_k(qs, post, 7, stopwords=stop, exclude_self=True, common_df=common_df).select("qid", "id", "relevance", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
