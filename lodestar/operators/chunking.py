"""Splitting documents into overlapping chunks (whole texts, every window).

Runs of spaces and tabs collapse to one space (newlines stay); windows of
``size`` code points start every ``size - overlap``; each window is stripped
and kept when at least ``min_chars`` long. One ``explode`` per document; no
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.config import CHUNK_OVERLAP, CHUNK_SIZE, MIN_CHUNK_CHARS

# --- fixed values: the characters Python's str.strip() removes (ASCII white space,
#     \x1c-\x1f, NEL and the Unicode space separators) ---
STRIP_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
STRIP_CLASS = r"[\t\n\x0b\x0c\r\x1c-\x1f\x85\p{Z}]"
# chunk id = doc_id * CHUNK_ID_BASE + chunk_no; a text has at most 2^31 bytes, so fewer windows than this
CHUNK_ID_BASE = 1 << 23


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]+", " ")


def strip_text(text: Column) -> Column:
    """Python's ``str.strip()``: a character-set trim, no regular expression."""
    return F.btrim(text, F.lit(STRIP_CHARS))


def split_chunks(docs: DataFrame, *, id: str = "doc_id", text: str = "text", keep=("source",),
                 size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, min_chars: int = MIN_CHUNK_CHARS) -> DataFrame:
    """``id, doc_id, chunk_no, <keep...>, content`` — one row per kept window.

    ``chunk_no`` is the window's position in the document (0-based, counted before
    short windows are dropped), so ids are stable when one document changes."""
    step = size - overlap
    body = docs.select(F.col(id).alias("doc_id"), *keep, collapse_spaces(F.col(text)).alias("_t"))
    n_windows = F.ceil(F.length("_t") / F.lit(step)).cast("int")
    # All windows of a document are cut in one array expression, so the text is not
    # copied onto every window row; empty texts give no window.
    windows = F.when(F.length("_t") > 0, F.transform(
        F.sequence(F.lit(0), n_windows - 1),
        lambda i: strip_text(F.substring(F.col("_t"), i * step + 1, size)))).otherwise(F.array().cast("array<string>"))
    out = (body.select("doc_id", *keep, F.posexplode(windows).alias("chunk_no", "content"))
           .where(F.length("content") >= min_chars))
    return out.select((F.col("doc_id") * F.lit(CHUNK_ID_BASE) + F.col("chunk_no")).cast("long").alias("id"),
                      "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), *keep, "content")
