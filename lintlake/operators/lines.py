"""Line-level building blocks over ``files(repo, path, ext, content)``.

A file's lines never leave its row: hits and their surrounding lines are picked
with array functions, so every context scan is a map with no shuffle and only
the hits become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

FILE_KEYS = ("repo", "path", "ext")
COMMENT = r"^\s*(#|//|/\*|\* )"
SLASH_COMMENT = r"^\s*//"
CODE_COMMENT = r"^\s*(#|//)"
_QUOTED = r""""[^"]*"|'[^']*'|`[^`]*`"""
_QUOTED_OR_OPEN = r""""[^"]*("|$)|'[^']*('|$)|`[^`]*(`|$)"""


def to_lines(files: DataFrame) -> DataFrame:
    """One row per line with 1-based numbers."""
    return files.select(*FILE_KEYS, F.posexplode(F.split("content", "\n")).alias("pos", "line")).select(
        *FILE_KEYS, (F.col("pos") + 1).alias("line_no"), "line"
    )


def is_comment(line: Column) -> Column:
    """P7."""
    return line.rlike(COMMENT)


def in_string(line: Column, pos: Column) -> Column:
    """Whether the 0-based ``pos`` lies inside a quoted span of ``line``."""
    before = F.substring(line, F.lit(1), pos.cast("int"))
    return F.regexp_replace(before, _QUOTED, "").rlike("[\"'`]")


def outside_strings(line: Column) -> Column:
    """``line`` with quoted spans emptied, so a match in it starts outside every string."""
    return F.regexp_replace(line, _QUOTED_OR_OPEN, '""')


def any_of(patterns: Sequence[str]) -> str:
    """One alternation for a list of patterns."""
    return "|".join(f"(?:{p})" for p in patterns)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def first_label(text: Column, labelled: Sequence[tuple[str, str]], test: Callable[[Column, str], Column]) -> Column:
    """Label of the first pattern, in list order, that ``text`` passes."""
    return F.coalesce(*[F.when(test(text, p), F.lit(label)) for p, label in labelled])


def rlike(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def contains(text: Column, word: str) -> Column:
    return text.contains(word)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it.

    A column of an earlier select may be inlined at every use; inside a lambda that repeats it per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def frame(lines: Column, line_no: Column, lo: int, hi: int) -> Column:
    """The lines at offsets ``lo..hi`` around ``line_no``, cut at the file's ends."""
    start = F.greatest(line_no + lo, F.lit(1))
    return F.slice(lines, start, F.greatest(line_no + hi - start + 1, F.lit(0)))


def any_line(lines: Column, pattern: str) -> Column:
    return F.exists(lines, lambda line: line.rlike(pattern))


def line_hits(
    files: DataFrame,
    hit: Callable[[Column], Column],
    frames: dict[str, tuple[int, int]] | None = None,
    keys: Sequence[str] = FILE_KEYS,
) -> DataFrame:
    """Rows (keys…, line_no, line, frame…) for the lines passing ``hit``; each frame is an array of lines."""
    lines = F.col("_lines")
    numbered = F.transform(lines, lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))
    kept = F.filter(numbered, lambda s: hit(s["line"]))
    if frames:
        kept = F.transform(
            kept,
            lambda s: F.struct(
                s["line_no"].alias("line_no"),
                s["line"].alias("line"),
                *[frame(lines, s["line_no"], lo, hi).alias(name) for name, (lo, hi) in frames.items()],
            ),
        )
    return files.withColumn("_lines", F.split("content", "\n")).select(*keys, F.inline(kept))


def context_flag(files: DataFrame, hit: Callable[[Column], Column], flag: str, lo: int, hi: int) -> DataFrame:
    """Lines passing ``hit`` with whether any line at offsets ``lo..hi`` matches ``flag``."""
    found = line_hits(files, hit, {"ctx": (lo, hi)})
    return found.withColumn("has_context", any_line(F.col("ctx"), flag)).drop("ctx")


def labelled_hits(found: DataFrame, labelled: Sequence[tuple[str, str]], text: Column, column: str = "label") -> DataFrame:
    """One row per (hit, matching pattern)."""
    labels = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for p, label in labelled]))
    return found.withColumn(column, F.explode(labels))
