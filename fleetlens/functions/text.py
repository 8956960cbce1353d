"""Text helpers shared by the extractors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white-space characters a line cleaner has to remove.
SPACE = "[\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed one time, however often it is used.

    Spark repeats a shared sub-expression inside conditional branches and
    lambdas; binding it to a lambda variable does not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unix_lines(content: Column) -> Column:
    """All line ends as \\n, so that line patterns mean the same everywhere."""
    return F.regexp_replace(content, "\\r\\n?|\\u2028|\\u2029", "\n")


def matches(content: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern as array<string>."""
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


def extract_or_null(content: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group; no or empty match gives null."""
    return F.nullif(F.regexp_extract(content, pattern, group), F.lit(""))


def line_count(content: Column) -> Column:
    """Number of lines; a final line without line end counts, an empty text has none."""
    ends = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    open_line = (F.length(content) > 0) & ~F.endswith(content, F.lit("\n"))
    return (ends + open_line.cast("int")).cast("bigint")


def directory_of(path: Column) -> Column:
    """Folder part of a path; '' for the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def ancestors(path: Column) -> Column:
    """The folder of a path and all folders above it, '' included."""
    parts = F.split(directory_of(path), "/")
    depth = F.when(directory_of(path) == "", F.lit(0)).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), depth), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def clamp(x: Column) -> Column:
    """Scores live on a 1..5 scale."""
    return F.least(F.lit(5.0), F.greatest(F.lit(1.0), x.cast("double")))


def round6(x: Column) -> Column:
    """Six decimals, halves up, by plain arithmetic."""
    return F.floor(x * 1000000 + 0.5) / 1000000
