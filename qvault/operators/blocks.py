"""Blocks of source files: how deep each line is nested, and the function and the table or class around it.

Files are dealt to tasks by repository and name and sorted by line; each task
streams over its lines with a stack of open blocks, so a file of any length
takes memory for its nesting alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRING = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`")
COMMENT = re.compile(r"^\s*(?://|#|--|/\*|\*)")
#: What opens a block: (what it is, pattern with the name, what shows its end: braces, parentheses or indents).
HEADERS = [
    ("function", re.compile(r"^\s*(?:async\s+)?def\s+(\w+)\s*\("), "indent"),
    ("function", re.compile(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*\("), "brace"),
    ("function", re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)"), "brace"),
    ("function", re.compile(r"^\s*(?:(?:async|static|public|private|protected)\s+)*(?!(?:if|for|while|switch|catch|return|function|with)\b)([A-Za-z_$][\w$]*)\s*\([^()]*\)\s*\{"), "brace"),
    ("table", re.compile(r"(?i)\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[\"`\[]?([A-Za-z_][\w$.]*)[\"`\]]?\s*\("), "paren"),
    ("table", re.compile(r"^\s*model\s+([A-Za-z_]\w*)\s*\{"), "brace"),
    ("table", re.compile(r"\b(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*new\s+(?:\w+\.)?[Ss]chema\s*\("), "paren"),
    ("table", re.compile(r"\bclass\s+([A-Za-z_]\w*)\b[^{:]*\{"), "brace"),
    ("table", re.compile(r"^\s*class\s+([A-Za-z_]\w*)\s*(?:\([^)]*\))?\s*:"), "indent"),
]


class Nesting:
    """The open blocks of one file, line by line."""

    def __init__(self):
        self.stack: list[list] = []  # kind, name, how it ends, depth outside, whether it has begun
        self.depth = {"brace": 0, "paren": 0}

    def line(self, text: str) -> tuple[int, str | None, str | None]:
        """The depth in braces before a line, and the innermost function and table that it is in or begins."""
        before = self.depth["brace"]
        if text.strip() and not COMMENT.match(text):
            indent = len(text) - len(text.lstrip())
            while self.stack and self.stack[-1][2] == "indent" and self.stack[-1][3] >= indent:
                self.stack.pop()
            for kind, pattern, end in HEADERS:
                if m := pattern.search(text):
                    self.stack.append([kind, m[1], end, indent if end == "indent" else self.depth[end], end == "indent"])
        name = lambda kind: next((b[1] for b in reversed(self.stack) if b[0] == kind), None)
        found = before, name("function"), name("table")
        if text.strip() and not COMMENT.match(text):
            code = STRING.sub("", text)
            for c in code:
                if c in "{}()":
                    kind = "brace" if c in "{}" else "paren"
                    self.depth[kind] = max(0, self.depth[kind] + (1 if c in "{(" else -1))
                    for b in self.stack:
                        b[4] = b[4] or b[2] == kind and self.depth[kind] > b[3]
            waits = code.rstrip().endswith("=>" if "=>" in code else (")", "(", ","))  # its brace may come on the next line
            self.stack = [b for b in self.stack if b[2] == "indent" or (self.depth[b[2]] > b[3] if b[4] else waits)]
        return found


def with_blocks(lines: DataFrame) -> DataFrame:
    """``lines`` (repo_id, file, line, text; others are left out) with depth, function and table; each null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nesting = None, Nesting()
        for b in batches:
            out = []
            for repo, file, text in zip(*(b.column(c).to_pylist() for c in ("repo_id", "file", "text")), strict=True):
                if (repo, file) != at:
                    at, nesting = (repo, file), Nesting()
                out.append(nesting.line(text or ""))
            depth, function, table = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(depth, pa.int32()), pa.array(function, pa.string()), pa.array(table, pa.string())], [*b.schema.names, "depth", "function", "table"])

    held = lines.select("repo_id", "file", "line", "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema) + ", depth int, function string, table string"
    return held.repartition("repo_id", "file").sortWithinPartitions("repo_id", "file", "line").mapInArrow(run, schema)


def assigned_name(text):
    """The name that a line assigns to, null if it assigns to none: the part before the first single =."""
    return F.nullif(F.regexp_extract(text, r"^\s*(?:(?:const|let|var)\s+)?([A-Za-z_$][\w$]*)\s*(?::[^=]*)?=(?!=)", 1), F.lit(""))
