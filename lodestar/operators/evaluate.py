"""Scoring retrieval and answers against a question set, all questions in one batch.

A question has ``qid, set, question, expected, sources, previous``: ``expected``
holds ``|``-separated alternatives of the key text, ``sources`` the accepted
documents (blank = off-topic), ``previous`` a non-blank earlier question for
follow-ups. A run gives the rows each question retrieved and the answer text;
``evaluate_mode`` makes one in a search mode, and runs of several modes are put
together with ``unionByName``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.config import NOT_FOUND
from lodestar.functions.text import contains_expected, ratio_text
from lodestar.operators import hybrid as hy
from lodestar.operators.fulltext import small, terms

METRICS = ["Right chunk retrieved", "Correct answer", "…of which follow-up questions", "Off-topic refused"]
TIME_METRIC = "Avg. response time"


def accepted_sources(passages: DataFrame, docs: DataFrame, *, id: str = "item_id", text: str = "text",
                     doc_id: str = "doc_id", doc_text: str = "text", doc_terms: DataFrame | None = None) -> DataFrame:
    """``qid, doc_id``: the documents that contain each passage.

    Containment is found without pairing every passage with every document: a
    document that holds the passage holds each of its inner words as a whole word,
    so candidates are the documents with the passage's rarest inner word (an
    equi-join on the word), and ``instr`` confirms each candidate. A passage of one
    or two words has no inner word: its longest word is a piece of some word of the
    document, so it meets the pieces of that length of all distinct words. A passage
    without words gets no sources."""
    words = passages.select(F.col(id).alias("qid"), F.posexplode(terms(F.col(text))).alias("pos", "term"),
                            F.size(terms(F.col(text))).alias("n"))
    inner = words.where((F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1)).select("qid", "term").distinct()
    if doc_terms is not None:  # ``term, id`` of every word of every document (e.g. term_counts)
        doc_words = doc_terms.select("term", F.col("id").alias("doc_id"))
    else:
        doc_words = docs.select(F.col(doc_id).alias("doc_id"),
                                F.explode(F.array_distinct(terms(F.col(doc_text)))).alias("term"))
    # frequencies of the passages' words only; passages and their words are broadcast where they are few
    asked = doc_words.join(small(inner.select("term").distinct(), 32), "term", "left_semi")
    freq = asked.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    key = (inner.join(freq, "term").groupBy("qid")
           .agg(F.min_by("term", F.struct("df", "term")).alias("term"))).checkpoint()
    cand = small(key, 48).join(doc_words, "term").select("qid", "doc_id")
    short = (words.where("n < 3").groupBy("qid").agg(F.max_by("term", F.struct(F.length("term"), F.col("term"))).alias("piece"))
             .withColumn("len", F.length("piece")))
    lengths = [r.len for r in short.select("len").distinct().collect()]  # of single words
    if lengths:
        sized = doc_words.select("term").distinct().select("term", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)])).alias("len"))
        sized = sized.where(F.col("len") <= F.length("term"))
        starts = sized.select("term", "len", F.explode(F.expr("sequence(1, length(term) - len + 1)")).alias("at"))
        pieces = starts.select("term", F.expr("substring(term, at, len)").alias("piece"))
        hits = pieces.join(short, "piece").select("qid", "term").distinct()
        cand = cand.unionByName(hits.join(doc_words, "term").select("qid", "doc_id").distinct())
    cand = cand.checkpoint()  # pairs of numbers
    return (small(cand, 24).join(passages.select(F.col(id).alias("qid"), F.col(text).alias("_p")), "qid")
            .join(docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("_d")), "doc_id")
            .where(F.instr("_d", F.col("_p")) > 0)
            .select("qid", "doc_id").distinct())


def passage_questions(passages: DataFrame, accepted: DataFrame, *, id: str = "item_id", text: str = "text") -> DataFrame:
    """Questions from passages: expected text = the passage; ``answerable`` when some document holds it."""
    found = accepted.select("qid").distinct().withColumn("answerable", F.lit(True))
    return (passages.select(F.col(id).alias("qid"), F.col(text).alias("question"), F.col(text).alias("expected"))
            .join(found, "qid", "left")
            .select("qid", "question", "expected", F.coalesce("answerable", F.lit(False)).alias("answerable"),
                    F.lit("").alias("previous")))


def sources_text(questions: DataFrame, accepted: DataFrame) -> DataFrame:
    """The CSV form of the key: accepted documents as one ``a|b|c`` string per question.

    Only for writing the question file, whose format holds the list in one field."""
    lists = (accepted.groupBy("qid")
             .agg(F.array_join(F.sort_array(F.collect_set(F.col("doc_id").cast("string"))), "|").alias("sources")))
    return questions.join(lists, "qid", "left").withColumn("sources", F.coalesce("sources", F.lit("")))


def answers_from_rows(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """Answer text per question: the numbered passages (``[n] (source)\\ncontent``), or the
    refusal text when nothing was retrieved."""
    block = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] ("), F.col("source"), F.lit(")\n"), F.col("content"))
    per_q = (rows.select("qid", F.struct("n", block.alias("b")).alias("p")).groupBy("qid")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["b"]), "\n\n").alias("answer")))
    return (questions.select("qid").join(per_q, "qid", "left")
            .select("qid", F.coalesce("answer", F.lit(NOT_FOUND)).alias("answer")))


def score(questions: DataFrame, rows: DataFrame, answers: DataFrame, mode: str, mode_used: str | None = None,
          accepted: DataFrame | None = None, by: str = "id") -> DataFrame:
    """Per question: ``hit`` (a retrieved row from an accepted source holds the key text),
    ``correct`` (the answer holds it), ``refused`` (the answer cites nothing).

    Accepted sources come as ``accepted`` pairs ``qid, doc_id`` (a semi-join, any number of
    documents per question) or, for a question file, from its ``sources`` string, whose parts
    are compared with the column ``by`` of the rows."""
    if accepted is not None:
        q = questions.select("qid", "set", "expected", "answerable", "previous")
        from_accepted = rows.join(accepted.select("qid", F.col("doc_id").alias("id")), ["qid", "id"], "left_semi")
    else:
        q = questions.select("qid", "set", "expected", (F.col("sources") != "").alias("answerable"), "previous",
                             "sources")
        from_accepted = (rows.join(q.select("qid", "sources"), "qid")
                         .where(F.array_contains(F.split("sources", r"\|", -1), F.col(by).cast("string"))))
    hits = (from_accepted.join(q.select("qid", "expected"), "qid")
            .where(contains_expected(F.col("content"), F.col("expected")))
            .select("qid").distinct().withColumn("hit", F.lit(True)))
    out = q.join(answers, "qid", "left").join(hits, "qid", "left")
    return out.select(
        "qid", "set", F.lit(mode).alias("mode"), F.lit(mode_used or mode).alias("mode_used"),
        F.col("answerable"), (F.col("previous") != "").alias("followup"),
        F.coalesce("hit", F.lit(False)).alias("hit"),
        contains_expected(F.col("answer"), F.col("expected")).alias("correct"),
        (F.instr("answer", "[") == 0).alias("refused"))


def evaluate_mode(questions: DataFrame, corpus: DataFrame, postings: DataFrame | None, mode: str, *,
                  rewrites: DataFrame | None = None, answers: DataFrame | None = None,
                  seconds: DataFrame | None = None, **search) -> DataFrame:
    """A run of all questions in one search mode, scored: the columns of ``score`` plus ``question``,
    ``searched`` (the text searched for) and ``seconds``.

    ``questions`` has ``qid, set, question, expected, sources, previous, qvec``, ``corpus`` ``id, source,
    content, embedding``. A follow-up is searched for by its row in ``rewrites`` (``qid, rewritten``), where that
    says something; ``qvec`` is the vector of what is searched for. ``mode_used`` is what ``retrieve`` says: hybrid
    without ``postings`` runs as vector. Without ``answers`` (``qid, answer``) the numbered rows are the answer;
    ``seconds`` (``qid, seconds``) are measured response times, null where there are none. ``search`` goes to
    ``retrieve``. Rows without a source count as ``unknown``, rows without a text as empty; null ``previous`` and
    ``sources`` count as blank.

    What is retrieved (ids, at most top-k per question) is checkpointed, for three branches read it."""
    questions = questions.withColumns({c: F.coalesce(c, F.lit("")) for c in ("previous", "sources")})
    if rewrites is None:
        rewrites = questions.select("qid", F.lit("").alias("rewritten")).limit(0)
    texts = hy.search_text(questions.select("qid", "question"), rewrites).select("qid", F.col("search_query").alias("searched"))
    asked = questions.select("qid", "qvec").join(texts, "qid").withColumnRenamed("searched", "question")
    got = hy.retrieve(asked, corpus.select("id", "source", "embedding"), postings, mode, **search).checkpoint()
    rows = (got.where(~F.col("refused")).select("qid", "n", "id")
            .join(corpus.select("id", F.coalesce("source", F.lit("unknown")).alias("source"),
                                F.coalesce("content", F.lit("")).alias("content")), "id"))
    if answers is None:
        answers = answers_from_rows(questions, rows)
    scored = score(questions, rows, answers, mode, by="source")
    used = got.select("qid", "mode_used").distinct()
    out = (scored.drop("mode_used").join(used, "qid").join(questions.select("qid", "question"), "qid").join(texts, "qid"))
    if seconds is None:
        return out.withColumn("seconds", F.lit(None).cast("double"))
    return out.join(seconds.select("qid", "seconds"), "qid", "left")


def metrics(scored: DataFrame) -> DataFrame:
    """Counts per (set, mode), and ``avg_seconds`` where response times were measured."""
    a, f = F.col("answerable"), F.col("followup")
    timed = [F.round(F.avg("seconds"), 6).alias("avg_seconds")] if "seconds" in scored.columns else []
    return scored.groupBy("set", "mode").agg(
        F.count_if(a & F.col("hit")).alias("retrieved"),
        F.count_if(a & F.col("correct")).alias("answered"),
        F.count_if(a & F.col("correct") & f).alias("followups_answered"),
        F.count_if(~a & F.col("refused")).alias("refused"),
        F.count_if(a).alias("n_answerable"),
        F.count_if(f).alias("n_followups"),
        F.count_if(~a).alias("n_offtopic"), *timed)


def ratios(m: DataFrame) -> DataFrame:
    """``k/n (p%)`` strings per metric, a dash when n = 0; the mean time as ``x.x s``, a dash where none was measured."""
    timed = []
    if "avg_seconds" in m.columns:
        timed = [F.when(F.col("avg_seconds").isNull(), F.lit("–"))
                 .otherwise(F.format_string("%.1f s", F.bround("avg_seconds", 1))).alias("avg_time")]
    return m.select("set", "mode",
                    ratio_text(F.col("retrieved"), F.col("n_answerable")).alias("right_chunk"),
                    ratio_text(F.col("answered"), F.col("n_answerable")).alias("correct_answer"),
                    ratio_text(F.col("followups_answered"), F.col("n_followups")).alias("followups"),
                    ratio_text(F.col("refused"), F.col("n_offtopic")).alias("off_topic_refused"), *timed)


def table(r: DataFrame, modes: list[str] | dict[str, str]) -> DataFrame:
    """Metrics as rows, modes as columns (under their labels, if ``modes`` is a dictionary from mode to label)."""
    names = {"right_chunk": METRICS[0], "correct_answer": METRICS[1], "followups": METRICS[2],
             "off_topic_refused": METRICS[3]}
    if "avg_time" in r.columns:
        names["avg_time"] = TIME_METRIC
    long = r.select("set", "mode", F.explode(F.map_from_arrays(
        F.array(*[F.lit(v) for v in names.values()]), F.array(*[F.col(k) for k in names]))).alias("metric", "value"))
    wide = long.groupBy("set", "metric").pivot("mode", list(modes)).agg(F.first("value"))
    return wide.withColumnsRenamed(modes) if isinstance(modes, dict) else wide


def failures(scored: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """What went wrong, per question: mode mismatch, retrieval miss, answer miss, answered off-topic.

    A run of ``evaluate_mode`` also tells the question, what was searched for and the mode it ran as."""
    told = [c for c in ("question", "searched", "mode_used") if "searched" in scored.columns]
    s = scored if questions is None else scored.join(questions.select("qid"), "qid")
    kinds = F.array(
        F.when(F.col("mode_used") != F.col("mode"), F.lit("ran as another mode")),
        F.when(F.col("answerable") & ~(F.col("hit") & F.col("correct")),
               F.when(F.col("hit"), F.lit("answer miss")).otherwise(F.lit("retrieval miss"))),
        F.when(~F.col("answerable") & ~F.col("refused"), F.lit("answered off-topic")))
    return (s.select("set", "mode", "qid", *told, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind")))
