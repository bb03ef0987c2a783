"""Text normalisation shared by the operators, as Spark columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that end a word or are stripped from a line: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the faster ``lower``, which then does the same."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def strip_blanks(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null or blank texts have none."""
    stripped = strip_blanks(F.coalesce(text, F.lit("")))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, BLANK_RUN))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def wide_hash(text: Column) -> Column:
    """128 bits of SHA-256: apart from collisions too rare to happen, equal for equal texts only."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def free_names(taken: list[str], *wished: str) -> tuple[str, ...]:
    """The wished column names, with underscores in front of those that ``taken`` has already."""
    used, out = {c.lower() for c in taken}, []
    for name in wished:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return tuple(out)
