"""Small relational operators: first of each key, present and missing, ordinals, method names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by order, which must be total: an order-preserving dedup.

    Rows are reduced before the shuffle, so a hot key costs one row a task.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("m_")
    return rows.groupBy(*keys).agg(best).select(*keys, "m_.*").select(*rows.columns)


def present(asked: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(asked rows whose key is known, the others)."""
    return asked.join(known, key, "left_semi"), asked.join(known, key, "left_anti")


def match_names(asked: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """asked with the items of that name, and missing where there is none."""
    found = items.withColumn("hit_", F.lit(True))
    return asked.join(found, key, "left").withColumn("missing", F.col("hit_").isNull()).drop("hit_")


def at_ordinals(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ordinals: Sequence[int]) -> DataFrame:
    """rows whose number (from 1) in their key's order is listed, with that number."""
    numbered = rows.withColumn("ordinal", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col("ordinal").isin(*ordinals))


def allowed(method: Column, prefixes: Sequence[str]) -> Column:
    """Public methods whose name starts with a listed verb followed by a capital or nothing."""
    return method.rlike("^(" + "|".join(prefixes) + ")([A-Z]|$)") & ~method.startswith("_")
