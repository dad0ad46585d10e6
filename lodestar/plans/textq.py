"""Registered text queries: preview, regex, redaction, contacts, masking, fuzzy lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.text import normalize_numbers, redact_emails
from lodestar.operators import textops as tx
from lodestar.operators.fulltext import missing_stopwords, terms
from lodestar.plans.common import chunks
from lodestar.plans.registry import register
from lodestar.plans.sqlparts import CHUNKS, EMAIL, SPLIT
from lodestar.sources.tables import read_table

# The amount pattern of the original (Icelandic "8.000 kr") finds nothing in the driver
# documents; their amounts are digit groups with either separator.
DRIVER_AMOUNTS = r"\d{1,3}([.,]\d{3})+"


@register("chunk_preview", f"""WITH {CHUNKS}
SELECT id, replace(source, 'src', 'doc') || '.txt' AS file_name, left(content, 80) AS content_start,
       length(content)::BIGINT AS content_length
FROM chunks ORDER BY id LIMIT 10""")
def chunk_preview(spark, sf):
    c = chunks(spark, sf)
    return (c.orderBy("id").limit(10)
            .select("id", F.concat(F.replace("source", F.lit("src"), F.lit("doc")), F.lit(".txt")).alias("file_name"),
                    F.left("content", F.lit(80)).alias("content_start"),
                    F.length("content").cast("long").alias("content_length")))


@register("redact_emails", f"""WITH {CHUNKS}
SELECT id, regexp_replace(content, '{EMAIL}', '[email]', 'g') AS redacted FROM chunks WHERE content LIKE '%@%'""")
def redact_emails_q(spark, sf):
    c = chunks(spark, sf)
    return c.where(F.col("content").like("%@%")).select("id", redact_emails(F.col("content")).alias("redacted"))


@register("regex_email_count", f"""WITH {CHUNKS}
SELECT count(*) AS chunks_with_an_email FROM chunks WHERE regexp_matches(content, '{EMAIL}')""")
def regex_email_count(spark, sf):
    c = chunks(spark, sf)
    return c.where(F.regexp_like("content", F.lit(EMAIL))).agg(F.count(F.lit(1)).alias("chunks_with_an_email"))


@register("regex_first_email", f"""WITH {CHUNKS}
SELECT DISTINCT regexp_extract(content, '{EMAIL}') AS email FROM chunks
WHERE regexp_matches(content, '{EMAIL}')""")
def regex_first_email(spark, sf):
    c = chunks(spark, sf)
    return (c.where(F.regexp_instr("content", F.lit(EMAIL)) > 0)
            .select(F.regexp_substr("content", F.lit(EMAIL)).alias("email")).distinct())


@register("regex_matches", f"""WITH {CHUNKS}
SELECT id, source, ordinal, match_value FROM (
  SELECT id, source, unnest(regexp_extract_all(content, '{DRIVER_AMOUNTS}')) AS match_value,
         unnest(generate_series(1, len(regexp_extract_all(content, '{DRIVER_AMOUNTS}')))) AS ordinal
  FROM chunks)""")
def regex_matches(spark, sf):
    return tx.regex_matches(chunks(spark, sf), DRIVER_AMOUNTS)


@register("regex_amounts", f"""WITH {CHUNKS}
SELECT source, sum(len(regexp_extract_all(content, '{DRIVER_AMOUNTS}')))::BIGINT AS amounts FROM chunks GROUP BY source""")
def regex_amounts(spark, sf):
    return tx.regex_count_by(chunks(spark, sf), DRIVER_AMOUNTS).withColumn("amounts", F.col("amounts").cast("long"))


@register("split_lines", f"""WITH {CHUNKS}
SELECT id, ordinal, line FROM (
  SELECT id, unnest(string_split(content, chr(10))) AS line,
         unnest(generate_series(1, len(string_split(content, chr(10))))) AS ordinal FROM chunks)""")
def split_lines(spark, sf):
    return tx.split_lines(chunks(spark, sf))


_CONTACTS = f"""contacts AS (SELECT email, min(source) AS source FROM (
  SELECT nullif(regexp_extract(content, '{EMAIL}'), '') AS email, source FROM chunks) WHERE email IS NOT NULL GROUP BY email)"""


@register("contacts", f"WITH {CHUNKS}, {_CONTACTS} SELECT email, source FROM contacts")
def contacts(spark, sf):
    return tx.contacts(chunks(spark, sf))


@register("mask_emails", f"""WITH {CHUNKS}, {_CONTACTS}
SELECT 'hr_user' AS reader, regexp_replace(email, '^(.).*$', '\\1XX@XXXX.com') AS email, source FROM contacts
UNION ALL SELECT 'dbo' AS reader, email, source FROM contacts""")
def mask_emails(spark, sf):
    con = tx.contacts(chunks(spark, sf))
    masked = tx.masked_contacts(con, False).select(F.lit("hr_user").alias("reader"), "email", "source")
    plain = tx.masked_contacts(con, True).select(F.lit("dbo").alias("reader"), "email", "source")
    return masked.unionByName(plain)


_NUM_SQL = "lower(text)"
for _d, _forms in __import__("lodestar.config", fromlist=["NUMBER_WORDS"]).NUMBER_WORDS.items():
    # RE2 has no look-around: capture the neighbours, and run twice for adjacent words.
    _pat = f"(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(_forms.split())})([^\\p{{L}}\\p{{N}}_]|$)"
    for _ in range(2):
        _NUM_SQL = f"regexp_replace({_NUM_SQL}, '{_pat}', '\\1{_d}\\3', 'g')"


@register("normalize_numbers", f"SELECT conv_id, turn, {_NUM_SQL} AS normalized FROM conversations")
def normalize_numbers_q(spark, sf):
    conv = read_table(spark, sf, "conversations")
    return conv.select("conv_id", "turn", normalize_numbers(F.col("text")).alias("normalized"))


# A part name with two letters dropped, as a user's typo.
FUZZY_PROBE = "goldenrod lavendr spring choclate lace"


@register("fuzzy_edit", f"""SELECT name, levenshtein(name, '{FUZZY_PROBE}')::BIGINT AS edit_distance,
  (CASE WHEN greatest(length(name), {len(FUZZY_PROBE)}) = 0 THEN 100
        ELSE round(100.0 * (1.0 - levenshtein(name, '{FUZZY_PROBE}') / greatest(length(name), {len(FUZZY_PROBE)})))
   END)::BIGINT AS edit_similarity,
  round(jaro_winkler_similarity(name, '{FUZZY_PROBE}'), 6) AS jaro_winkler_similarity
FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL)""")
def fuzzy_edit(spark, sf):
    return tx.fuzzy_scores(read_table(spark, sf, "part"), FUZZY_PROBE, "p_name")


@register("fuzzy_lookup", f"""SELECT name, levenshtein(name, '{FUZZY_PROBE}')::BIGINT AS edit_distance,
  round(100.0 * (1.0 - levenshtein(name, '{FUZZY_PROBE}') / greatest(length(name), {len(FUZZY_PROBE)})))::BIGINT AS edit_similarity,
  round(1.0 - round(jaro_winkler_similarity(name, '{FUZZY_PROBE}'), 6), 6) AS jaro_winkler_distance
FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL)
ORDER BY round(jaro_winkler_similarity(name, '{FUZZY_PROBE}'), 6) DESC, name LIMIT 3""")
def fuzzy_lookup(spark, sf):
    return tx.fuzzy_lookup(read_table(spark, sf, "part"), FUZZY_PROBE, 3, "p_name")


@register("missing_stopwords", f"""WITH {CHUNKS},
words AS (SELECT DISTINCT unnest(string_split('{__import__("lodestar.config", fromlist=["x"]).ICELANDIC_STOPWORDS}', ' ')) AS term),
vocab AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_split_to_array(lower(content), {SPLIT})) AS term FROM chunks))
SELECT term FROM words w WHERE term <> '' AND NOT EXISTS (SELECT 1 FROM vocab v WHERE v.term = w.term)""")
def missing_stopwords_q(spark, sf):
    """Stop-list words that the documents' vocabulary does not hold yet (anti-join)."""
    vocab = chunks(spark, sf).select(F.explode(terms(F.col("content"))).alias("term"))
    return missing_stopwords(spark, vocab)


@register("names_case_insensitive", """SELECT 'part' AS source_table, count(DISTINCT p_name) AS names_binary,
  count(DISTINCT lower(p_name)) AS names_ci FROM part
UNION ALL SELECT 'customer', count(DISTINCT c_name), count(DISTINCT lower(c_name)) FROM customer""")
def names_case_insensitive(spark, sf):
    """Distinct names under binary and case-insensitive collation (``UTF8_LCASE``)."""
    def counts(table, col):
        df = read_table(spark, sf, table)
        return df.agg(F.lit(table).alias("source_table"), F.countDistinct(col).alias("names_binary"),
                      F.countDistinct(F.collate(F.col(col), "UTF8_LCASE")).alias("names_ci"))
    return counts("part", "p_name").unionByName(counts("customer", "c_name"))
