"""The files table: one row per file of a repository snapshot.

``(workspace, owner, repo, push_id, path, content)``. Lookups are plain column
predicates, so Parquet row groups sorted by path are skipped and ``content`` is
never read by a job that looks at paths only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_SCHEMA = "workspace string, owner string, repo string, push_id bigint, path string, content string"


def glob_to_regex(glob: str) -> str:
    """Anchored pattern of a glob: ``*`` and ``?`` stay in one folder, ``**/`` spans
    any number of folders, ``@(a|b)`` and ``{a,b}`` are alternatives."""
    out, i, closing = [], 0, []
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if glob.startswith("@(", i):
            out.append("(?:")
            closing.append(")")
            i += 2
            continue
        if c == "{":
            out.append("(?:")
            closing.append("}")
        elif closing and c == closing[-1]:
            out.append(")")
            closing.pop()
        elif closing and (c == "|" or (c == "," and closing[-1] == "}")):
            out.append("|")
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        else:
            out.append(re.escape(c))
        i += 1
    return f"^{''.join(out)}$"


WILD = re.compile(r"[*?{]|@\(")


def is_exact(glob: str) -> bool:
    return not WILD.search(glob)


def path_matches(path: Column, glob: str) -> Column:
    """Plain comparisons where the glob allows it (they reach the scan), else a pattern."""
    if is_exact(glob):
        return path == glob
    if glob.startswith("**/") and is_exact(glob[3:]):
        return (path == glob[3:]) | F.endswith(path, F.lit(glob[2:]))
    if glob.endswith("/**") and is_exact(glob[:-3]):
        return F.startswith(path, F.lit(glob[:-2]))
    if glob.startswith("**/*") and is_exact(glob[4:]):
        return F.endswith(path, F.lit(glob[4:]))
    if glob.startswith("*") and is_exact(glob[1:]):
        return F.endswith(path, F.lit(glob[1:])) & ~F.contains(path, F.lit("/"))
    return path.rlike(glob_to_regex(glob))


def files_by_path(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path)


def files_by_glob(files: DataFrame, glob: str) -> DataFrame:
    return files.filter(path_matches(F.col("path"), glob))


def read_files_table(spark: SparkSession, location: str, fmt: str = "parquet") -> DataFrame:
    """A stored files table in any columnar or text format Spark reads."""
    return spark.read.schema(FILES_SCHEMA).format(fmt).load(location)


def read_checkouts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Working copies laid out as ``<root>/<owner>/<repo>/<path>`` as a files table.

    Only files whose name matches ``glob`` are opened. Files that are not UTF-8
    text keep their row, with a null content: rules on paths still see them.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", "content")
    )
    without_store = "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"
    folder = re.sub(without_store, "", root).strip("/")
    inner = F.regexp_replace(F.regexp_replace(F.col("path"), without_store, ""), f"^/*{re.escape(folder)}/*", "")
    parts = F.split(inner, "/", 3)
    return raw.select(
        F.lit(None).cast("string").alias("workspace"),
        F.get(parts, F.lit(0)).alias("owner"),
        F.get(parts, F.lit(1)).alias("repo"),
        F.lit(0).cast("bigint").alias("push_id"),
        F.get(parts, F.lit(2)).alias("path"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("content"),
    ).filter(F.col("path").isNotNull())


def write_files_table(files: DataFrame, location: str) -> None:
    """Store a files table for path lookups: files hold narrow, sorted ranges of paths."""
    ranged = files.repartitionByRange("workspace", "path").sortWithinPartitions("workspace", "path")
    ranged.write.partitionBy("workspace").parquet(location)
