"""Row filters per reader, column encryption and e-mail masking.

A row filter is applied *before* ranking, so a reader always gets k rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OWNER = "dbo"

# --- fixed values: the readers of the original and their departments ---
USER_DEPARTMENTS = [("hr_user", "HR"), ("it_user", "IT")]


def user_departments(spark: SparkSession, rows=USER_DEPARTMENTS) -> DataFrame:
    return spark.createDataFrame(rows, "user_name string, department string")


def visible_to(df: DataFrame, user: str, mapping: DataFrame, owner: str = OWNER) -> DataFrame:
    """Rows a reader may see: the owner sees all, a mapped user their departments, others none."""
    if user == owner:
        return df
    allowed = mapping.where(F.col("user_name") == user).select("department").distinct()
    # One reader's departments: bounded by the number of departments.
    return df.join(F.broadcast(allowed), "department", "left_semi")


def grants(df: DataFrame, mapping: DataFrame, owner: str = OWNER) -> DataFrame:
    """(reader, department) pairs for every reader at once: the mapping plus the owner on every department."""
    everything = df.select("department").distinct().select(F.lit(owner).alias("user_name"), "department")
    return mapping.select("user_name", "department").unionByName(everything).distinct()


def visible_counts(df: DataFrame, mapping: DataFrame, owner: str = OWNER) -> DataFrame:
    """Rows visible per reader and department: rows are counted per department before they meet the grants."""
    counts = df.groupBy("department").agg(F.count(F.lit(1)).alias("visible_chunks"))
    return grants(df, mapping, owner).join(counts, "department").select("user_name", "department", "visible_chunks")


def encrypt(col: Column, key: Column) -> Column:
    """AES-GCM; the output holds the 12-byte IV and the 16-byte tag."""
    return F.aes_encrypt(col.cast("binary"), key, F.lit("GCM"))


def decrypt(col: Column, key: Column) -> Column:
    """Null, not an error, when the key is wrong (a closed key reads as NULL)."""
    return F.try_aes_decrypt(col, key, F.lit("GCM")).cast("string")
