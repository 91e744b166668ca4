"""Code facts of Python files: imports by logical lines, definitions by line patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DEFINITION = r"^\s*(?:async\s+)?(def|class)\s+(\w+)"
#: What a fold over a file has to see: strings, comments, joined lines, brackets, ends of lines and statements.
_MARK = re.compile(
    r'''"""(?:\\.|[^\\])*?(?:"""|\Z)|\'{3}(?:\\.|[^\\])*?(?:\'{3}|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|\#[^\n]*|\\\r?\n|[()\[\]{};\n]''', re.S)
_STARTS = re.compile(r"[ \t]*(?:import\s|from\s*[.\w]+\s*import\b)")
_IMPORT = re.compile(r"(?:^|:)\s*(?:import\s+(.+)|from\s*((?:\.\s*)*[\w.]*)\s*import\b(.+))$", re.S)
_NAME = re.compile(r"([\w.]+|\*)(?:\s+as\s+(\w+))?")
IMPORTS = "repo string, path string, line_no long, module string, imported string, alias string"


def logical_lines(content: str) -> Iterator[tuple[int, str]]:
    """(line number, statement) without comments, strings emptied and lines joined in brackets and behind a backslash.

    An import can not stand in brackets, so one there starts a statement: brackets that are never closed cost no more than that.
    """
    number = begin = 1
    depth, at, parts = 0, 0, []
    for mark in _MARK.finditer(content):
        parts.append(content[at : mark.start()])
        token, at = mark.group(), mark.end()
        if token in "([{":
            depth += 1
            parts.append(token)
        elif token in ")]}":
            depth = max(0, depth - 1)
            parts.append(token)
        elif token in "\n;" and (not depth or token == "\n" and _STARTS.match(content, at)):
            yield begin, "".join(parts)
            depth, parts = 0, []
        elif token[0] in "\"'":
            parts.append("''")
        elif token[0] != "#":
            parts.append(" ")
        number += token.count("\n")
        if not parts:
            begin = number
    yield begin, "".join([*parts, content[at:]])


def imports_of(content: str) -> Iterator[tuple[int, str, str, str | None]]:
    """(line number, module, imported name, alias) of every name that a file's text imports."""
    for number, statement in logical_lines(content):
        found = _IMPORT.search(statement) if "import" in statement else None
        if not found:
            continue
        module = None if found[1] else re.sub(r"\s", "", found[2])
        for item in (found[1] or found[3]).strip().strip("()").split(","):
            name = _NAME.fullmatch(item.strip())
            if name:
                yield number, module or name[1], name[1], name[2]


def import_facts(files: DataFrame) -> DataFrame:
    """V4: (repo, path, line_no, module, imported, alias) of the import statements of ``files(repo, path, ext, content)``; one row per
    imported name, the line being the statement's first. Names in strings and comments are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repos, paths, contents = (batch.column(c).to_pylist() for c in ("repo", "path", "content"))
            rows = [(repo, path, *fact) for repo, path, content in zip(repos, paths, contents, strict=True) for fact in imports_of(content)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = [c.split()[0] for c in IMPORTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    python = files.filter((F.col("ext") == "py") & F.col("content").contains("import"))
    return python.select("repo", "path", "content").mapInArrow(run, IMPORTS)


def definition_facts(lines: DataFrame) -> DataFrame:
    """V4: (repo, path, line_no, kind, name, is_async) of functions and classes."""
    found = lines.filter((F.col("ext") == "py") & F.col("line").rlike(DEFINITION))
    return found.select(
        "repo", "path", "line_no", F.regexp_extract("line", DEFINITION, 1).alias("kind"), F.regexp_extract("line", DEFINITION, 2).alias("name"),
        F.col("line").rlike(r"^\s*async").alias("is_async"),
    )
