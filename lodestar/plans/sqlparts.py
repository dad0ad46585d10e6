"""Shared pieces of the DuckDB oracle SQL (views of the driver tables are
pre-registered under their table names)."""

from lodestar.config import ICELANDIC_STOPWORDS

# every embedding with its document, if any; every document; both
CORPUS = ("corpus AS (SELECT e.vec_id AS id, d.source, d.text AS content, e.embedding "
          "FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)")
TEXTS = "corpus AS (SELECT doc_id AS id, source, text AS content FROM documents)"
WHOLE = ("corpus AS (SELECT coalesce(d.doc_id, e.vec_id) AS id, d.source, d.text AS content, e.embedding "
         "FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id)")
VQUESTIONS = "questions AS (SELECT vec_id AS qid, embedding AS qvec FROM embeddings)"
QUESTIONS = ("questions AS (SELECT b.item_id AS qid, b.text AS question, e.embedding AS qvec "
             "FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)")
STOP = f"stop AS (SELECT DISTINCT unnest(string_split('{ICELANDIC_STOPWORDS}', ' ')) AS term)"
SPLIT = r"'[^\p{L}\p{N}_]+'"


def cos(a: str, b: str) -> str:
    return f"(round(list_cosine_distance(({a})::DOUBLE[], ({b})::DOUBLE[]), 6) + 0.0)"


# BM25 postings over the corpus, as lodestar.operators.fulltext.build_postings
POSTINGS = f"""
tok AS (SELECT id, term FROM (SELECT id, unnest(regexp_split_to_array(lower(content), {SPLIT})) AS term FROM corpus)
        WHERE term <> '' AND term NOT IN (SELECT term FROM stop)),
tf AS (SELECT term, id, count(*) AS tf FROM tok GROUP BY term, id),
dl AS (SELECT id, count(*) AS dl FROM tok GROUP BY id),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT (SELECT count(content) FROM corpus)::DOUBLE AS n,
              ((SELECT count(*) FROM tok) / (SELECT count(content) FROM corpus)::DOUBLE)::DOUBLE AS avgdl),
post AS (SELECT tf.term, tf.id, tf.tf, dfs.df,
                ln(1.0 + (st.n - dfs.df + 0.5) / (dfs.df + 0.5)) * tf.tf * 2.2
                  / (tf.tf + 1.2 * (0.25 + 0.75 * dl.dl / st.avgdl)) AS weight
         FROM tf JOIN dfs USING (term) JOIN dl USING (id) CROSS JOIN st)"""

QTERMS = f"""
qt AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(regexp_split_to_array(lower(question), {SPLIT})) AS term
       FROM questions) WHERE term <> '' AND term NOT IN (SELECT term FROM stop))"""

# vector and text candidate lists, fused (as lodestar.operators.hybrid)
VRANKS = f"""
vall AS (SELECT q.qid, c.id, {cos('q.qvec', 'c.embedding')} AS distance FROM questions q JOIN corpus c ON c.id <> q.qid
         WHERE q.qvec IS NOT NULL AND c.embedding IS NOT NULL),
vr AS (SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM vall
       QUALIFY rank <= {{cand}})"""
FRANKS = """
fs AS (SELECT qid, id, round(sum(weight), 6) + 0.0 AS relevance FROM qt JOIN post USING (term)
       WHERE id <> qid GROUP BY qid, id),
fr AS (SELECT qid, id, relevance, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, id) AS rank FROM fs
       QUALIFY rank <= {cand})"""
FUSED = """
fused AS (SELECT coalesce(vr.qid, fr.qid) AS qid, coalesce(vr.id, fr.id) AS id,
                 coalesce(1.0::DOUBLE / (60 + vr.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + fr.rank), 0.0) AS score
          FROM vr FULL OUTER JOIN fr ON vr.qid = fr.qid AND vr.id = fr.id),
top AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fused
        QUALIFY rank <= {k}),
closest AS (SELECT qid, min(distance) AS closest FROM vr GROUP BY qid),
hyb AS (SELECT top.qid, top.rank, top.id, c.source, top.score, closest.closest
        FROM top JOIN corpus c ON c.id = top.id LEFT JOIN closest ON closest.qid = top.qid)"""


def hybrid_ctes(k: int = 5, cand: int = 20) -> str:
    return ",".join([WHOLE, QUESTIONS, STOP, POSTINGS, QTERMS, VRANKS.format(cand=cand),
                     FRANKS.format(cand=cand), FUSED.format(k=k)])

_STRIP = r"[\t\n\x0b\x0c\r\x1c-\x1f\x85\p{Z}]"
# chunks of the documents, as lodestar.operators.chunking.split_chunks, plus department
CHUNKS = f"""
chunks_raw AS (
  WITH d AS (SELECT doc_id, source, regexp_replace(text, '[ \t]+', ' ', 'g') AS t FROM documents),
  w AS (SELECT doc_id, source, t, unnest(range(0, length(t), 450)) AS s FROM d WHERE length(t) > 0),
  c AS (SELECT doc_id, source, s // 450 AS chunk_no,
               regexp_replace(substring(t, s + 1, 500), '^{_STRIP}+|{_STRIP}+$', '', 'g') AS content FROM w)
  SELECT (doc_id * 8388608 + chunk_no)::BIGINT AS id, doc_id, chunk_no::BIGINT AS chunk_no, source, content
  FROM c WHERE length(content) >= 20),
chunks AS (SELECT *, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'IT'
                          WHEN source IN ('src4', 'src5', 'src6', 'src7') THEN 'Finance'
                          ELSE 'HR' END AS department FROM chunks_raw)"""
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
