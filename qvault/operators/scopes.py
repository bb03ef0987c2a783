"""Rules that hold for one repository or scan, or for all: a scope that equi-joins can use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_keys(rules: DataFrame, keys: Sequence[str]) -> list[str]:
    """Those of ``keys`` that the rules name; rules without any hold everywhere."""
    return [k for k in keys if k in rules.columns]


def scope(keys: Sequence[str]) -> Column:
    """The scope of a rule by its keys: all of them, or empty where they are null and the rule holds everywhere."""
    named = F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    return F.coalesce(named, F.lit(""))


def scopes(keys: Sequence[str]) -> Column:
    """The scopes of rules that a row may fall under: its own and the empty one."""
    return F.array_distinct(F.array(scope(keys), F.lit("")))
