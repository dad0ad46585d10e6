"""Registered evaluation queries: retrieval and answer scoring on the benchmark questions,
ratio strings, the metric × mode table, failures, search text, run-cost reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.config import NOT_FOUND, NUMBER_WORDS, SEARCH_MODES
from lodestar.operators import evaluate as ev
from lodestar.operators import fulltext as ft
from lodestar.operators.hybrid import search_text as search_text_op
from lodestar.operators.hybrid import text_ranks
from lodestar.plans.common import built_once
from lodestar.plans.registry import register
from lodestar.plans.retrieval import question_postings, text_lists
from lodestar.plans.sqlparts import FRANKS, FUSED, POSTINGS, QTERMS, SPLIT, STOP, VRANKS, WHOLE
from lodestar.sources.tables import read_table, text_questions, whole_corpus

MODE = "text"  # the question set has no vectors of its own: retrieval is by words


def _set(qid):
    return F.when(qid % 5 == 4, "holdout").otherwise("tuning")


def _accepted(spark, sf):
    """``qid, doc_id`` of the documents with each passage, found once."""
    def find():
        docs, bench = read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark")
        return ft.stored(ev.accepted_sources(bench, docs, doc_terms=text_lists(spark, sf)[2]), "accepted")
    return built_once(spark, sf, "accepted", find, ("documents", "benchmark"))


def _run(spark, sf):
    corpus = text_lists(spark, sf)[0]
    stop, post = question_postings(spark, sf)
    accepted = _accepted(spark, sf)
    questions = ev.passage_questions(read_table(spark, sf, "benchmark"), accepted).withColumn("set", _set(F.col("qid")))
    top = text_ranks(questions, post, 5, exclude_self=False, stopwords=stop).checkpoint()  # read by rows and answers
    rows = (ft.small(top, 48).join(corpus, "id").select("qid", F.col("rank").alias("n"), "id", "source", "content"))
    answers = ev.answers_from_rows(questions, rows)
    return questions, ev.score(questions, rows, answers, MODE, accepted=accepted), accepted


# --- oracle SQL -----------------------------------------------------------------------

def _norm_sql(x: str) -> str:
    out = f"lower({x})"
    for d, forms in NUMBER_WORDS.items():
        pat = f"(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(forms.split())})([^\\p{{L}}\\p{{N}}_]|$)"
        for _ in range(2):
            out = f"regexp_replace({out}, '{pat}', '\\1{d}\\3', 'g')"
    return out


def _contains_sql(text: str, expected: str) -> str:
    return (f"list_bool_or(list_transform(string_split({expected}, '|'), "
            f"lambda o: contains({_norm_sql(text)}, {_norm_sql('o')})))")


_SCORED = f"""docs AS (SELECT doc_id AS id, source, text AS content FROM documents), {STOP},
{POSTINGS.replace('corpus', 'docs')},
srcs AS (SELECT b.item_id AS qid, string_agg(d.doc_id::VARCHAR, '|' ORDER BY d.doc_id::VARCHAR) AS sources
         FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id),
questions AS (SELECT b.item_id AS qid, b.text AS question, b.text AS expected, coalesce(s.sources, '') AS sources,
                     '' AS previous, CASE WHEN b.item_id % 5 = 4 THEN 'holdout' ELSE 'tuning' END AS set
              FROM benchmark b LEFT JOIN srcs s ON s.qid = b.item_id),
qt AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(regexp_split_to_array(lower(question), {SPLIT})) AS term
       FROM questions) WHERE term <> '' AND term NOT IN (SELECT term FROM stop)),
fs AS (SELECT qid, id, round(sum(weight), 6) + 0.0 AS relevance FROM qt JOIN post USING (term) GROUP BY qid, id),
fr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, id) AS n FROM fs QUALIFY n <= 5),
rows AS (SELECT fr.qid, fr.n, fr.id, d.source, d.content FROM fr JOIN docs d ON d.id = fr.id),
ans AS (SELECT q.qid, coalesce(string_agg('[' || r.n || '] (' || r.source || ')' || chr(10) || r.content,
                                          chr(10) || chr(10) ORDER BY r.n), '{NOT_FOUND}') AS answer
        FROM questions q LEFT JOIN rows r ON r.qid = q.qid GROUP BY q.qid),
hits AS (SELECT DISTINCT r.qid FROM rows r JOIN questions q ON q.qid = r.qid
         WHERE list_contains(string_split(q.sources, '|'), r.id::VARCHAR) AND {_contains_sql('r.content', 'q.expected')}),
scored AS (SELECT q.qid, q.set, '{MODE}' AS mode, '{MODE}' AS mode_used, q.sources <> '' AS answerable,
                  q.previous <> '' AS followup, h.qid IS NOT NULL AS hit,
                  {_contains_sql('a.answer', 'q.expected')} AS correct, instr(a.answer, '[') = 0 AS refused
           FROM questions q LEFT JOIN ans a ON a.qid = q.qid LEFT JOIN hits h ON h.qid = q.qid),
m AS (SELECT set, mode, count_if(answerable AND hit) AS retrieved, count_if(answerable AND correct) AS answered,
             count_if(answerable AND correct AND followup) AS followups_answered,
             count_if(NOT answerable AND refused) AS refused, count_if(answerable) AS n_answerable,
             count_if(followup) AS n_followups, count_if(NOT answerable) AS n_offtopic
      FROM scored GROUP BY set, mode)"""


def _ratio_sql(k: str, n: str) -> str:
    return (f"CASE WHEN {n} = 0 THEN '–' ELSE {k} || '/' || {n} || ' (' || "
            f"round_even(100.0 * {k} / {n}, 0)::BIGINT || '%)' END")


_RATIOS = f"""r AS (SELECT set, mode, {_ratio_sql('retrieved', 'n_answerable')} AS right_chunk,
       {_ratio_sql('answered', 'n_answerable')} AS correct_answer,
       {_ratio_sql('followups_answered', 'n_followups')} AS followups,
       {_ratio_sql('refused', 'n_offtopic')} AS off_topic_refused FROM m)"""


@register("eval_retrieval", f"WITH {_SCORED} SELECT * FROM m")
def eval_retrieval(spark, sf):
    _, scored, _ = _run(spark, sf)
    return ev.metrics(scored)


@register("eval_answers", f"WITH {_SCORED}, {_RATIOS} SELECT * FROM r")
def eval_answers(spark, sf):
    _, scored, _ = _run(spark, sf)
    return ev.ratios(ev.metrics(scored))


@register("eval_table", f"""WITH {_SCORED}, {_RATIOS},
long AS (SELECT set, 'Right chunk retrieved' AS metric, mode, right_chunk AS value FROM r
         UNION ALL SELECT set, 'Correct answer', mode, correct_answer FROM r
         UNION ALL SELECT set, '…of which follow-up questions', mode, followups FROM r
         UNION ALL SELECT set, 'Off-topic refused', mode, off_topic_refused FROM r)
SELECT set, metric, first(value) FILTER (WHERE mode = '{MODE}') AS "{MODE}" FROM long GROUP BY set, metric""")
def eval_table(spark, sf):
    _, scored, _ = _run(spark, sf)
    return ev.table(ev.ratios(ev.metrics(scored)), [MODE])


@register("eval_failures", f"""WITH {_SCORED}
SELECT set, mode, qid, kind FROM (
  SELECT set, mode, qid, CASE WHEN mode_used <> mode THEN 'ran as another mode' END AS kind FROM scored
  UNION ALL SELECT set, mode, qid, CASE WHEN answerable AND NOT (hit AND correct)
                                        THEN CASE WHEN hit THEN 'answer miss' ELSE 'retrieval miss' END END FROM scored
  UNION ALL SELECT set, mode, qid, CASE WHEN NOT answerable AND NOT refused THEN 'answered off-topic' END FROM scored)
WHERE kind IS NOT NULL""")
def eval_failures(spark, sf):
    questions, scored, _ = _run(spark, sf)
    return ev.failures(scored, questions)


_STRIP = r"[\t\n\x0b\x0c\r\x1c-\x1f\x85\p{Z}]"


# --- both search modes, with follow-ups and response times ----------------------------

CUT = 0.64  # distance cut-off of these runs; a setting that the tuning set is there to choose
TIMED_BY = {"hybrid": "click", "vector": "view"}  # events whose values stand in for the response times of a mode


def _key(spark, sf):
    """The question set with key, accepted sources by name and follow-ups; every fourth question follows the one before it."""
    docs, bench = read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark")
    accepted = ft.small(_accepted(spark, sf), 24).join(docs.select("doc_id", "source"), "doc_id")
    questions = ev.passage_questions(bench, accepted).drop("previous", "answerable").withColumn("set", _set(F.col("qid")))
    questions = ev.sources_text(questions, accepted.select("qid", F.col("source").alias("doc_id")))
    before = bench.select((F.col("item_id") + 1).alias("qid"), F.col("text").alias("previous")).where("qid % 4 = 3")
    return (questions.join(before, "qid", "left").withColumn("previous", F.coalesce("previous", F.lit("")))
            .join(text_questions(spark, sf).select("qid", "qvec"), "qid"))


def _mode_run(spark, sf, mode, text_index=True):
    stop, post = question_postings(spark, sf)  # follow-ups are searched for by benchmark texts too
    questions = _key(spark, sf)
    rewrites = (questions.where("previous <> ''")
                .select("qid", F.concat_ws(" ", "previous", "question").alias("rewritten")))
    seconds = (read_table(spark, sf, "events").where(F.col("event_type") == TIMED_BY[mode])
               .groupBy(F.col("user_id").alias("qid")).agg(F.avg("value").alias("seconds")))
    return ev.evaluate_mode(questions, whole_corpus(spark, sf), post if text_index else None, mode, rewrites=rewrites,
                            seconds=seconds, max_distance=CUT, stopwords=stop)


def _both(spark, sf):
    return _mode_run(spark, sf, "hybrid").unionByName(_mode_run(spark, sf, "vector"))


_MODES = f"""{WHOLE},
named AS (SELECT b.item_id AS qid, string_agg(DISTINCT d.source, '|' ORDER BY d.source) AS sources
          FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id),
keyed AS (SELECT b.item_id AS qid, b.text AS asked, coalesce(s.sources, '') AS sources, coalesce(p.text, '') AS previous,
                 CASE WHEN b.item_id % 5 = 4 THEN 'holdout' ELSE 'tuning' END AS set
          FROM benchmark b LEFT JOIN named s ON s.qid = b.item_id
          LEFT JOIN benchmark p ON p.item_id = b.item_id - 1 AND b.item_id % 4 = 3),
questions AS (SELECT k.qid, CASE WHEN previous <> '' THEN regexp_replace(previous || ' ' || asked, '^{_STRIP}+|{_STRIP}+$', '', 'g')
                                 ELSE asked END AS question, e.embedding AS qvec
              FROM keyed k LEFT JOIN embeddings e ON e.vec_id = k.qid),
{STOP}, {POSTINGS}, {QTERMS}, {VRANKS.format(cand=20)}, {FRANKS.format(cand=20)}, {FUSED.format(k=5)},
found AS (SELECT 'hybrid' AS used, qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM hyb WHERE closest <= {CUT}
          UNION ALL
          SELECT 'vector', qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) FROM vr WHERE rank <= 5 AND distance <= {CUT}),
got AS (SELECT f.*, coalesce(c.source, 'unknown') AS source, coalesce(c.content, '') AS content FROM found f JOIN corpus c USING (id)),
runs AS (SELECT * FROM (VALUES ('hybrid', 'hybrid', 'click'), ('vector', 'vector', 'view'), ('hybrid', 'vector', 'click')) t(mode, used, timed)),
ans AS (SELECT used, qid, string_agg('[' || n || '] (' || source || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY n) AS answer
        FROM got GROUP BY used, qid),
hits AS (SELECT DISTINCT g.used, g.qid FROM got g JOIN keyed k USING (qid)
         WHERE list_contains(string_split(k.sources, '|'), g.source) AND {_contains_sql('g.content', 'k.asked')}),
secs AS (SELECT event_type AS timed, user_id AS qid, avg(value) AS seconds FROM events GROUP BY 1, 2),
scored AS (SELECT k.qid, k.set, r.mode, r.used AS mode_used, k.asked AS question, q.question AS searched, k.sources <> '' AS answerable,
                  k.previous <> '' AS followup, h.qid IS NOT NULL AS hit,
                  {_contains_sql(f"coalesce(a.answer, '{NOT_FOUND}')", 'k.asked')} AS correct,
                  instr(coalesce(a.answer, '{NOT_FOUND}'), '[') = 0 AS refused, s.seconds
           FROM keyed k CROSS JOIN runs r JOIN questions q ON q.qid = k.qid
           LEFT JOIN ans a ON a.qid = k.qid AND a.used = r.used LEFT JOIN hits h ON h.qid = k.qid AND h.used = r.used
           LEFT JOIN secs s ON s.qid = k.qid AND s.timed = r.timed),
m AS (SELECT set, mode, count_if(answerable AND hit) AS retrieved, count_if(answerable AND correct) AS answered,
             count_if(answerable AND correct AND followup) AS followups_answered,
             count_if(NOT answerable AND refused) AS refused, count_if(answerable) AS n_answerable,
             count_if(followup) AS n_followups, count_if(NOT answerable) AS n_offtopic, round(avg(seconds), 6) AS avg_seconds
      FROM scored WHERE mode = mode_used GROUP BY set, mode)"""


@register("eval_modes", f"WITH {_MODES} SELECT * FROM m")
def eval_modes(spark, sf):
    """Counts and mean response time of both search modes; sources by name from their ``a|b|c`` list, with follow-ups."""
    return ev.metrics(_both(spark, sf))


_LABELS = [("Right chunk retrieved", _ratio_sql("retrieved", "n_answerable")), ("Correct answer", _ratio_sql("answered", "n_answerable")),
           ("…of which follow-up questions", _ratio_sql("followups_answered", "n_followups")),
           ("Off-topic refused", _ratio_sql("refused", "n_offtopic")),
           ("Avg. response time", "coalesce(printf('%.1f s', round_even(avg_seconds, 1)), '–')")]
_COLUMNS = ", ".join(f"first(value) FILTER (WHERE mode = '{mode}') AS \"{label}\"" for mode, label in SEARCH_MODES.items())


@register("eval_modes_table", f"""WITH {_MODES},
long AS ({" UNION ALL ".join(f"SELECT set, mode, '{name}' AS metric, {value} AS value FROM m" for name, value in _LABELS)})
SELECT set, metric, {_COLUMNS} FROM long GROUP BY set, metric""")
def eval_modes_table(spark, sf):
    """The same as ratios: one row per set and metric, one column per search mode."""
    return ev.table(ev.ratios(ev.metrics(_both(spark, sf))), SEARCH_MODES)


@register("eval_modes_failures", f"""WITH {_MODES}
SELECT set, mode, mode_used, qid, question, searched, kind FROM (
  SELECT *, CASE WHEN mode_used <> mode THEN 'ran as another mode' END AS kind FROM scored
  UNION ALL SELECT *, CASE WHEN answerable AND NOT (hit AND correct) THEN CASE WHEN hit THEN 'answer miss' ELSE 'retrieval miss' END END FROM scored
  UNION ALL SELECT *, CASE WHEN NOT answerable AND NOT refused THEN 'answered off-topic' END FROM scored)
WHERE kind IS NOT NULL""")
def eval_modes_failures(spark, sf):
    """Failures of both modes and of hybrid without its text index, which runs as vector; with what was searched for."""
    return ev.failures(_both(spark, sf).unionByName(_mode_run(spark, sf, "hybrid", text_index=False)))


@register("search_text", f"""WITH q AS (SELECT conv_id || ':' || turn AS qid, conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
rw AS (SELECT conv_id, turn + 1 AS turn, text AS rewritten FROM conversations WHERE role = 'system')
SELECT q.qid, q.question, coalesce(nullif(regexp_replace(rw.rewritten, '^{_STRIP}+|{_STRIP}+$', '', 'g'), ''), q.question) AS search_query
FROM q LEFT JOIN rw ON rw.conv_id = q.conv_id AND rw.turn = q.turn""")
def search_text(spark, sf):
    """User turns as questions; a system turn right before a user turn stands in for the
    model's standalone rewrite of that follow-up (the model itself is outside)."""
    conv = read_table(spark, sf, "conversations")
    q = conv.where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("qid"),
                                           F.col("text").alias("question"))
    rw = conv.where("role = 'system'").select(F.concat_ws(":", "conv_id", F.col("turn") + 1).alias("qid"),
                                              F.col("text").alias("rewritten"))
    return search_text_op(q, rw)


_PROC = """CASE WHEN e.props LIKE '{"k": 9_}' THEN 'search_ann' ELSE 'search_' || e.event_type END"""


@register("run_cost_report", f"""WITH per_query AS (
  SELECT {_PROC} AS procedure_name, e.user_id, r.r_name AS region,
         count(*) AS calls, sum(e.value) AS duration
  FROM events e JOIN customer c ON c.c_custkey = e.user_id JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2, 3)
SELECT procedure_name, region, max(calls) AS calls, round(sum(duration) / max(calls), 6) AS avg_ms
FROM per_query GROUP BY procedure_name, region""")
def run_cost_report(spark, sf):
    """Cost per call by procedure and region: events ⋈ customer ⋈ nation ⋈ region, statements
    named by a LIKE pattern first, then sum(avg·n) per statement and sum / max(calls) per procedure."""
    e = read_table(spark, sf, "events")
    c = read_table(spark, sf, "customer")
    n = read_table(spark, sf, "nation")
    r = read_table(spark, sf, "region")
    proc = F.when(F.col("props").like('{"k": 9_}'), "search_ann").otherwise(F.concat(F.lit("search_"), F.col("event_type")))
    joined = (e.join(c, e["user_id"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
              .join(r, n["n_regionkey"] == r["r_regionkey"]))
    per_query = joined.groupBy(proc.alias("procedure_name"), "user_id", F.col("r_name").alias("region")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("value").alias("duration"))
    return per_query.groupBy("procedure_name", "region").agg(
        F.max("calls").alias("calls"), F.round(F.sum("duration") / F.max("calls"), 6).alias("avg_ms"))


@register("run_cost_simple", """SELECT 'search_' || event_type AS procedure_name, sum(calls) AS runs, round(avg(avg_value), 6) AS avg_ms
FROM (SELECT event_type, user_id, count(*) AS calls, avg(value) AS avg_value FROM events GROUP BY 1, 2)
GROUP BY 1 ORDER BY runs DESC, procedure_name LIMIT 10""")
def run_cost_simple(spark, sf):
    """Plain average of per-statement averages (differs from the weighted report)."""
    e = read_table(spark, sf, "events")
    per = e.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("calls"), F.avg("value").alias("avg_value"))
    return (per.groupBy(F.concat(F.lit("search_"), F.col("event_type")).alias("procedure_name"))
            .agg(F.sum("calls").alias("runs"), F.round(F.avg("avg_value"), 6).alias("avg_ms"))
            .orderBy(F.col("runs").desc(), "procedure_name").limit(10))


@register("questions_csv", f"""WITH {_SCORED}
SELECT set, question, sources AS source, expected, previous FROM questions""")
def questions_csv(spark, sf):
    """The question set written as CSV with a header (quoted, UTF-8) and read back: blank
    fields come back as empty strings, as a CSV dict reader gives them."""
    from lodestar.session import data_tag, scratch_path
    from lodestar.sources.tables import read_questions_csv
    questions, _, accepted = _run(spark, sf)
    questions = ev.sources_text(questions, accepted)
    path = scratch_path(spark, f"questions_csv_{data_tag(sf)}")
    (questions.select("set", "question", F.col("sources").alias("source"), "expected", "previous")
     .write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path))
    return read_questions_csv(spark, path)
