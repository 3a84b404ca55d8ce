"""Page files under a glob. Listing never opens a file; bytes are read for the files of one group at a time."""

from __future__ import annotations

import re
import threading
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inferlake.functions.ids import path_below
from inferlake.sources.storage import absolute

_WILDCARD = re.compile(r"[*?\[{]")
_SPECIAL = re.compile(r"([\\*?\[\]{}])")
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Paths that are opened by name; a larger group is found by its hash in a listing of the folder.
NAMED = 50_000
TASK_FILES = 500     # files opened by name that one task reads
_LOCK = threading.Lock()
_BEFORE: dict[SparkSession, list[str]] = {}     # the setting as it was, for each listing under way


def split_glob(glob: str) -> tuple[str, str]:
    """(folder without wildcards, pattern below it)."""
    parts = glob.split("/")
    cut = next((i for i, p in enumerate(parts) if _WILDCARD.search(p)), len(parts) - 1)
    return "/".join(parts[:cut]), "/".join(parts[cut:])


def glob_regex(pattern: str) -> str:
    """Anchored regex of a glob; ``**`` crosses folders, which Hadoop globs cannot say."""
    token = re.compile(r"\*\*/|\*\*|\*|\?|\[[^\]]+\]|\{[^}]+\}|.", re.S)

    def one(piece: str) -> str:
        fixed = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        if piece in fixed:
            return fixed[piece]
        if piece.startswith("[") and len(piece) > 1:
            return piece.replace("[!", "[^", 1)
        if piece.startswith("{") and len(piece) > 1:
            return "(?:" + "|".join(re.escape(p) for p in piece[1:-1].split(",")) + ")"
        return re.escape(piece)

    return "^" + "".join(one(m.group(0)) for m in token.finditer(pattern)) + "$"


@contextmanager
def _few_listing_tasks(spark: SparkSession, for_each_core: int):
    """Spark lists folders with a task for each, up to 10,000, which costs far more than the listing; a few tasks for each
    core share the folders instead. The setting is the session's: the last of the listings under way puts it back."""
    with _LOCK:
        under_way = _BEFORE.setdefault(spark, [])
        before = under_way[0] if under_way else spark.conf.get(_LISTING)
        if not under_way:
            spark.conf.set(_LISTING, str(min(int(before), for_each_core * spark.sparkContext.defaultParallelism)))
        under_way.append(before)
    try:
        yield
    finally:
        with _LOCK:
            under_way.pop()
            if not under_way:
                del _BEFORE[spark]
                spark.conf.set(_LISTING, before)


def _load(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files below folders, or at paths. Many paths go to the JVM in one call; ``load`` makes one for each."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    with _few_listing_tasks(spark, 4 if isinstance(paths, str) else 1):
        if isinstance(paths, str):
            return reader.load(paths)
        jvm = spark._jvm
        named = jvm.java.util.regex.Pattern.compile("\0").splitAsStream("\0".join(paths)).toList()
        return DataFrame(reader._jreader.load(jvm.PythonUtils.toSeq(named)), spark)


def list_pages(spark: SparkSession, glob: str, *columns: str) -> DataFrame:
    """(row_id, path, and the named file columns): the id is the path below the fixed part
    of the glob. Files are opened only if ``content`` is named."""
    if ".pdf" in glob.lower():
        raise ValueError("pdf files must be rendered to page images first")
    folder, pattern = split_glob(glob)
    files = _load(spark, folder).select("path", *columns)
    if "content" not in columns:    # Spark reckons 4 MB for a file, and a task has 32 of them
        files = files.coalesce(4 * spark.sparkContext.defaultParallelism)
    return (files.select(path_below(F.col("path"), absolute(spark, folder)).alias("row_id"),
                         "path", *columns)
            .where(F.col("row_id").rlike(glob_regex(pattern))))


def page_group(groups: int) -> Column:
    """The group of a page file, by the hash of its path; as a filter it keeps other files from being opened."""
    return F.pmod(F.xxhash64(F.col("_metadata.file_path")), F.lit(groups))


def read_group(spark: SparkSession, glob: str, groups: int, group: int | None,
               paths: list[str] | None = None, at_once: int = 1) -> DataFrame:
    """(path, content) of the files in one group of paths; of all groups with None. With the group's ``paths`` at hand
    the folder is not listed again for it. Spark gives 32 small files to a task, which costs more than they do: groups
    that are read ``at_once`` get two tasks for each core together, of some hundred files at most."""
    if paths:
        named = _load(spark, [_SPECIAL.sub(r"\\\1", p) for p in paths]).select("path", "content")
        shared = -(-2 * spark.sparkContext.defaultParallelism // at_once)
        return named.coalesce(max(shared, -(-len(paths) // TASK_FILES)))
    folder, pattern = split_glob(glob)
    files = _load(spark, folder)
    if group is not None:
        files = files.where(page_group(groups) == F.pmod(F.lit(group), F.lit(groups)))
    below = path_below(F.col("path"), absolute(spark, folder))
    return files.where(below.rlike(glob_regex(pattern))).select("path", "content")
