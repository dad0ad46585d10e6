"""Text functions as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.config import EMAIL_PATTERN, EMAIL_REDACTION, MASKED_EMAIL_SUFFIX, NUMBER_WORDS


def redact_emails(text: Column, pattern: str = EMAIL_PATTERN, replacement: str = EMAIL_REDACTION) -> Column:
    """Hide e-mail addresses before text leaves the table."""
    return F.regexp_replace(text, pattern, replacement)


def first_email(text: Column, pattern: str = EMAIL_PATTERN) -> Column:
    """The first address in a text, null when there is none."""
    return F.regexp_substr(text, F.lit(pattern))


def mask_email(email: Column, can_unmask: Column | bool = False) -> Column:
    """``aXX@XXXX.com`` form (first character kept) unless the reader may unmask."""
    masked = F.regexp_replace(email, r"^(.).*$", "$1" + MASKED_EMAIL_SUFFIX)
    flag = F.lit(can_unmask) if isinstance(can_unmask, bool) else can_unmask
    return F.when(flag, email).otherwise(masked)


def normalize_numbers(text: Column, words: dict[str, str] = NUMBER_WORDS) -> Column:
    """Lower-case, then number words (all inflections) to digits at word boundaries, where a
    word character is a letter, digit or underscore of any script."""
    out = F.lower(text)
    for digit, forms in words.items():
        out = F.regexp_replace(out, r"(?<![\p{L}\p{N}_])(" + "|".join(forms.split()) + r")(?![\p{L}\p{N}_])", digit)
    return out


def contains_expected(text: Column, expected: Column, words: dict[str, str] = NUMBER_WORDS) -> Column:
    """True when any ``|``-separated alternative of ``expected``, normalised, is a substring
    of the normalised text (an empty alternative matches)."""
    norm_text = normalize_numbers(text, words)
    options = F.split(expected, r"\|", -1)
    return F.exists(options, lambda o: F.instr(norm_text, normalize_numbers(o, words)) > 0)


def edit_similarity(a: Column, b: Column) -> Column:
    """0-100: ``round(100 * (1 - levenshtein / longer length))``; 100 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(100)).otherwise(
        F.round(F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b) / longest)).cast("int"))


def ratio_text(k: Column, n: Column) -> Column:
    """``k/n (p%)``, a dash when n = 0 (percent rounded half to even, as Python's format)."""
    pct = F.bround(F.lit(100.0) * k / n, 0).cast("long")
    return F.when(n == 0, F.lit("–")).otherwise(
        F.format_string("%d/%d (%d%%)", k.cast("long"), n.cast("long"), pct))
