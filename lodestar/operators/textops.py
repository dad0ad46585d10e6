"""Regular-expression and lookup jobs over text rows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.config import AMOUNT_PATTERN, EMAIL_PATTERN
from lodestar.functions.text import edit_similarity, first_email, mask_email


def regex_matches(df: DataFrame, pattern: str = AMOUNT_PATTERN, *, text: str = "content",
                  keep=("id", "source")) -> DataFrame:
    """One row per match (``ordinal`` 1-based, ``match_value``), like a lateral table function."""
    return (df.select(*keep, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 0)))
            .select(*keep, (F.col("pos") + 1).cast("long").alias("ordinal"), F.col("col").alias("match_value")))


def regex_count_by(df: DataFrame, pattern: str = AMOUNT_PATTERN, group: str = "source", text: str = "content",
                   name: str = "amounts") -> DataFrame:
    return df.groupBy(group).agg(F.sum(F.regexp_count(F.col(text), F.lit(pattern))).alias(name))


def split_lines(df: DataFrame, *, text: str = "content", keep=("id",)) -> DataFrame:
    """A text split into its lines, ``ordinal`` 1-based (empty lines kept)."""
    return (df.select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)))
            .select(*keep, (F.col("pos") + 1).cast("long").alias("ordinal"), F.col("col").alias("line")))


def contacts(chunks: DataFrame, pattern: str = EMAIL_PATTERN) -> DataFrame:
    """The first address of each row, deduplicated, with the smallest source holding it."""
    found = chunks.select(first_email(F.col("content"), pattern).alias("email"), "source")
    return found.where(F.col("email").isNotNull()).groupBy("email").agg(F.min("source").alias("source"))


def masked_contacts(contacts_df: DataFrame, can_unmask: Column | bool = False) -> DataFrame:
    return contacts_df.select(mask_email(F.col("email"), can_unmask).alias("email"), "source")


# ---------------------------------------------------------------------------
# fuzzy lookup


def _jaro_winkler(a: str, b: str, prefix_scale: float = 0.1, boost_threshold: float = 0.7) -> float:
    """Jaro-Winkler similarity (1 = identical)."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if la == 0 or lb == 0:
        return 0.0
    window = max(0, max(la, lb) // 2 - 1)
    ma = np.zeros(la, bool)
    mb = np.zeros(lb, bool)
    matches = 0
    for i, ch in enumerate(a):
        lo, hi = max(0, i - window), min(lb, i + window + 1)
        for j in range(lo, hi):
            if not mb[j] and b[j] == ch:
                ma[i] = mb[j] = True
                matches += 1
                break
    if matches == 0:
        return 0.0
    sa = [a[i] for i in range(la) if ma[i]]
    sb = [b[j] for j in range(lb) if mb[j]]
    transpositions = sum(x != y for x, y in zip(sa, sb)) // 2  # half the out-of-order pairs, rounded down
    jaro = (matches / la + matches / lb + (matches - transpositions) / matches) / 3.0
    if jaro <= boost_threshold:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * prefix_scale * (1.0 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow-batched Jaro-Winkler similarity (no built-in in Spark)."""
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b)],
                     dtype="float64")


def fuzzy_scores(names: DataFrame, probe: str, name: str = "name") -> DataFrame:
    """Edit distance, edit similarity (0-100) and Jaro-Winkler of every distinct name to a probe."""
    p = F.lit(probe)
    distinct = names.select(F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct()
    return distinct.select(
        "name",
        F.levenshtein("name", p).cast("long").alias("edit_distance"),
        edit_similarity(F.col("name"), p).cast("long").alias("edit_similarity"),
        F.round(jaro_winkler_similarity(F.col("name"), p), 6).alias("jaro_winkler_similarity"))


def jaro_winkler_bound(name: Column, probe: str, prefix_scale: float = 0.1, boost_threshold: float = 0.7) -> Column:
    """An upper bound of the similarity to ``probe``, in the JVM: at most as many letters match as both texts have in
    common (by letter counts), none is out of order, and the common prefix is known."""
    size, n = F.length(name), len(probe)
    common = F.lit(0)
    for letter, times in Counter(probe).items():
        common = common + F.least(size - F.length(F.replace(name, F.lit(letter), F.lit(""))), F.lit(times))
    prefix = F.lit(0)
    for k in range(min(4, n), 0, -1):
        prefix = F.when((prefix == 0) & name.startswith(probe[:k]), k).otherwise(prefix)
    jaro = F.when((common == 0) | (size == 0), F.lit(0.0)).otherwise((common / size + common / F.lit(max(n, 1)) + F.lit(1.0)) / 3.0)
    return F.when(name == probe, 1.0).when(jaro <= boost_threshold, jaro).otherwise(jaro + prefix * prefix_scale * (F.lit(1.0) - jaro))


def fuzzy_candidates(names: DataFrame, probe: str, n: int, name: str = "name") -> DataFrame:
    """The distinct names that can be among the ``n`` most similar: those whose bound reaches the n-th similarity found among
    the ``8 n`` names of the largest bounds. Only these and those few pass through Python."""
    bounds = names.select(F.col(name).alias("name")).where(F.col(name).isNotNull()).distinct().withColumn("_b", jaro_winkler_bound(F.col("name"), probe))
    seeds = bounds.orderBy(F.col("_b").desc(), "name").limit(8 * n)
    best = seeds.select(jaro_winkler_similarity(F.col("name"), F.lit(probe)).alias("_s")).orderBy(F.col("_s").desc()).limit(n)
    reach = best.agg(F.when(F.count(F.lit(1)) >= n, F.min("_s")).otherwise(0.0)).scalar()
    return bounds.where(F.col("_b") >= reach - F.lit(1e-6)).select("name")  # similarities are compared by six digits


def fuzzy_lookup(names: DataFrame, probe: str, n: int = 3, name: str = "name") -> DataFrame:
    """The n names most similar to a probe (Jaro-Winkler), with both distances."""
    scored = fuzzy_scores(fuzzy_candidates(names, probe, n, name), probe)
    return (scored.orderBy(F.col("jaro_winkler_similarity").desc(), "name").limit(n)
            .select("name", "edit_distance", "edit_similarity",
                    F.round(F.lit(1.0) - F.col("jaro_winkler_similarity"), 6).alias("jaro_winkler_distance")))
