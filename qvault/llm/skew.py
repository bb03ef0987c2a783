"""Joins whose hot keys are split, on DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qvault.llm.text import free_names

#: A key with 1 / HOT of the joined rows or more is split into as many parts as it has such shares; so there are at most HOT such keys.
HOT = 1000


def join_split(rows: DataFrame, table: DataFrame, key: str, *, n: str, by: list[str]) -> DataFrame:
    """The inner join of ``rows`` with ``table``, which has one row per ``key`` and in ``n`` how many of ``rows`` have it.

    ``table`` is read three times, so it should be one that is written. Rows of
    a hot key are dealt to its parts by a hash of their columns ``by``; the
    key's row of ``table`` goes to each. What is broadcast is at most HOT rows.
    """
    part, parts = free_names([*rows.columns, *table.columns], "part", "parts")
    total = table.agg(F.sum(n)).first()[0] or 0
    share = F.col(n) * HOT / F.lit(float(max(1, total)))
    hot = table.where(share >= 1).select(key, F.ceil(share).cast("int").alias(parts))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(*by), F.col(parts)), F.lit(0))).drop(parts)
    copied = table.withColumn(part, F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(share).cast("int")) - 1)))
    return dealt.join(copied.drop(n), [key, part]).drop(part)
