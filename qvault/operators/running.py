"""Running totals over groups of any size: sums of ranges first, then inside each range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qvault.storage import materialize


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """``df`` with, for each new column of ``totals``, the sum of its expression over the rows before, inside ``keys`` and by ``order``.

    Rows are dealt by ranges of keys and order and written, so a group that
    holds the whole table is spread over many tasks. Each range adds up alone;
    the sums of ranges, one row per key and range, give what came before.
    ``order`` must tell the rows of a key apart.
    """
    part = "_range"
    dealt, _ = materialize(df.withColumns({f"_of_{n}": c for n, c in totals.items()}).repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys, part).agg(*[F.sum(f"_of_{n}").alias(f"_sum_{n}") for n in totals])
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, part, *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in totals])
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(before, [*keys, part])
    return placed.select(*df.columns, *[(F.col(f"_before_{n}") + F.coalesce(F.sum(f"_of_{n}").over(inside), F.lit(0))).alias(n) for n in totals])
