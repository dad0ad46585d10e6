"""Declared constraints as a validation job: every row gets the list of rules it breaks.

Rules: NOT NULL, CHECK (any predicate, e.g. an IN list or a range), UNIQUE
(key counted with partial aggregation, duplicates joined back), FOREIGN KEY
(left join to the parent's distinct keys). Rows with an empty ``errors`` array
are accepted; the rest are rejected with their reasons.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class NotNull:
    name: str
    columns: list[str]


@dataclass
class Check:
    name: str
    predicate: Column  # rows where it is false are rejected (null passes, as in SQL CHECK)


@dataclass
class Unique:
    name: str
    columns: list[str]


@dataclass
class ForeignKey:
    name: str
    columns: list[str]
    parent: DataFrame
    parent_columns: list[str]


def validate(df: DataFrame, rules: list) -> DataFrame:
    """``df`` plus ``errors array<string>`` in rule order."""
    flags: list[Column] = []
    out = df
    for i, rule in enumerate(rules):
        if isinstance(rule, NotNull):
            bad = F.lit(False)
            for c in rule.columns:
                bad = bad | F.col(c).isNull()
            flags.append(F.when(bad, F.lit(rule.name)))
        elif isinstance(rule, Check):
            flags.append(F.when(~F.coalesce(rule.predicate, F.lit(True)), F.lit(rule.name)))
        elif isinstance(rule, Unique):
            flag = f"_dup{i}"
            dups = (df.groupBy(*rule.columns).agg(F.count(F.lit(1)).alias("_n"))
                    .where("_n > 1").select(*rule.columns, F.lit(True).alias(flag)))
            out = out.join(dups, rule.columns, "left")
            flags.append(F.when(F.col(flag), F.lit(rule.name)))
        elif isinstance(rule, ForeignKey):
            flag = f"_fk{i}"
            keys = (rule.parent.select(*[F.col(p).alias(c) for p, c in zip(rule.parent_columns, rule.columns)])
                    .distinct().withColumn(flag, F.lit(True)))
            out = out.join(keys, rule.columns, "left")
            has_key = F.lit(True)
            for c in rule.columns:
                has_key = has_key & F.col(c).isNotNull()
            flags.append(F.when(has_key & F.col(flag).isNull(), F.lit(rule.name)))
        else:
            raise TypeError(f"unknown rule {rule!r}")
    errors = F.filter(F.array(*flags), lambda x: x.isNotNull()) if flags else F.array().cast("array<string>")
    return out.select(*df.columns, errors.alias("errors"))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") == 0).drop("errors")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") > 0)
