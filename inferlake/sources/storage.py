"""Small control files and existence checks through Spark's own file systems."""

from __future__ import annotations

import json
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def qualified(spark: SparkSession, path: str) -> str:
    """Path with the scheme and authority of its file system."""
    fs, jpath = _open(spark, path)
    return jpath.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def absolute(spark: SparkSession, path: str) -> str:
    """Path without scheme and authority, made absolute by its file system."""
    fs, jpath = _open(spark, path)
    return jpath.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().getPath()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything matching a glob, is there."""
    fs, jpath = _open(spark, path)
    found = fs.globStatus(jpath)
    return found is not None and len(found) > 0


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Full paths that match a glob; for patterns with few matches."""
    fs, jpath = _open(spark, pattern)
    return [s.getPath().toString() for s in fs.globStatus(jpath) or []]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, jpath = _open(spark, path)
    out = fs.create(jpath, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    write_text(spark, path, json.dumps(document))


def read_json(spark: SparkSession, path: str) -> dict | None:
    """One control file; None when it is missing."""
    if not exists(spark, path):
        return None
    rows = spark.read.text(path, wholetext=True).collect()   # a single small file
    return json.loads(rows[0][0])


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that must not exist yet; False when another was faster.

    Local file systems get the operating system's exclusive create, since Hadoop's local one
    checks first and creates later; others are asked not to overwrite, which HDFS does in one step.
    """
    fs, jpath = _open(spark, path)
    fs.mkdirs(jpath.getParent())
    jvm = spark._jvm
    if fs.getUri().getScheme() == "file":
        place = jvm.java.nio.file.Path.of(jvm.java.net.URI(f"file://{_quoted(jpath.toUri().getPath())}"))
        try:
            jvm.java.nio.file.Files.write(place, bytearray(text.encode()), _options(spark, "CREATE_NEW", "WRITE"))
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
                return False
            raise
    try:
        out = fs.create(jpath, False)
    except Py4JJavaError as error:
        if fs.exists(jpath):
            return False
        raise error
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def _quoted(path: str) -> str:
    return quote(path, safe="/")


def _options(spark: SparkSession, *names: str):
    kind = spark._jvm.java.nio.file.StandardOpenOption
    array = spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.OpenOption, len(names))
    for at, name in enumerate(names):
        array[at] = getattr(kind, name)
    return array


def file_names(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names directly below a folder with their times in milliseconds; empty when it is missing."""
    fs, jpath = _open(spark, folder)
    if not fs.exists(jpath):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(jpath)}


def delete(spark: SparkSession, path: str) -> None:
    """One control file that this library wrote."""
    fs, jpath = _open(spark, path)
    fs.delete(jpath, False)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, jpath = _open(spark, path)
    fs.mkdirs(jpath)
