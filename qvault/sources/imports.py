"""Import edges between the files of a repository: specifiers are resolved as paths, then meet files by an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a line names what it imports; specifiers of the first two are relative if they begin with a dot.
ESM = r"\bfrom\s+['\"]([^'\"]+)['\"]"
CJS = r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
#: Python names modules from the root of the repository.
MODULE = (r"^\s*from\s+([\w.]+)\s+import\b", r"^\s*import\s+([\w.]+)")


def normal_path(path: Column) -> Column:
    """A path without ``.`` and with ``..`` resolved, by a fold over its segments; one that leaves the root keeps its ``..``."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", "."))
    above = lambda held: (F.size(held) > 0) & (F.element_at(held, -1) != "..")
    step = lambda held, s: F.when((s == "..") & above(held), F.slice(held, 1, F.size(held) - 1)).otherwise(F.concat(held, F.array(s)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def parent(path: Column) -> Column:
    """The folder of a path; that of a file at the root is empty."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def imported_stems(lines: DataFrame) -> DataFrame:
    """(repo_id, file, stem): what the lines of a file ask for, as a path of the repository without extension, or with it where a name may hold a dot."""
    relative = F.filter(F.concat(F.regexp_extract_all("text", F.lit(ESM), F.lit(1)), F.regexp_extract_all("text", F.lit(CJS), F.lit(1))), lambda s: s.startswith("."))
    paths = F.transform(relative, lambda s: normal_path(F.concat_ws("/", parent(normal_path(F.col("file"))), s)))
    module = F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in MODULE])
    stems = F.concat(F.transform(paths, without_extension), paths, F.array_compact(F.array(F.replace(module, F.lit("."), F.lit("/")))))
    # Only lines with one of the words reach the folds.
    asking = lines.where(F.col("text").rlike(r"\b(from|require|import)\b"))
    return asking.select("repo_id", "file", F.explode(stems).alias("stem")).distinct()


def import_edges(lines: DataFrame) -> DataFrame:
    """One-hop edges (repo_id, file, imported) between the files that ``lines`` (repo_id, file, line, text) has.

    A specifier means the file of its path with any extension, or the index
    file (``index.*``, ``__init__.py``) of the folder of its path.
    """
    files = lines.select("repo_id", F.col("file").alias("imported")).distinct()
    path = normal_path(F.col("imported"))
    index = F.when(F.col("imported").rlike(r"(^|/)(index\.[^./]+|__init__\.py)$"), parent(path))
    known = files.select("repo_id", "imported", F.explode(F.array_compact(F.array(without_extension(path), index))).alias("stem"))
    return imported_stems(lines).join(known, ["repo_id", "stem"]).where("file <> imported").select("repo_id", "file", "imported").distinct()
