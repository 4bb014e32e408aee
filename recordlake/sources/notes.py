"""Note trees as a corpus table ``(_note_file, content)``."""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.functions.text import is_note


def plain_path(uri: Column) -> Column:
    """File URI as a plain path: percent escapes decoded, ``file:`` dropped."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def absolute_root(spark: SparkSession, path: str) -> str:
    """Root as it appears at the front of ``_note_file``: a path without scheme is qualified by the session's file system."""
    if "://" in path and not path.startswith("file:"):
        return path.rstrip("/")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    qualified = root.getFileSystem(conf).makeQualified(root).toString()
    return ("/" + qualified[len("file:"):].lstrip("/") if qualified.startswith("file:") else qualified).rstrip("/")


def within_depth(path: Column, root: str, depth: int) -> Column:
    """True for files at most ``depth`` directories below ``root``; 0 is the root only.

    A root without scheme and host stands for that path in any file system.  A file that is not below the root is an error, and so
    is a root with a glob, which has no one depth.
    """
    if set(root) & set("*?[{"):
        raise ValueError(f"depth needs one root, not {root!r}")
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", root):
        path = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/+[^/]*(?=/)", "")
    start = root.rstrip("/") + "/"
    below = F.substring(path, len(start) + 1, 1 << 30)
    outside = F.raise_error(F.concat(F.lit(f"not below {start}: "), path)).cast("int")
    return F.when(path.startswith(start), F.size(F.split(below, "/")) - 1).otherwise(outside) <= depth


def note_files(path: Column, root: str | None, depth: int | None) -> Column:
    return is_note(path) if depth is None else is_note(path) & within_depth(path, root, depth)


def read_corpus(spark: SparkSession, path: str, depth: int | None = None) -> DataFrame:
    """Every markdown and typst file under ``path``, one row each, whole text.

    Type and depth depend on the path only, so files they exclude are not opened.
    """
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    return _corpus(reader.load(path), path, depth)


def stream_corpus(spark: SparkSession, path: str, depth: int | None = None) -> DataFrame:
    """The same as a stream of new files."""
    reader = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    return _corpus(reader.load(path), path, depth)


def _corpus(files: DataFrame, path: str, depth: int | None) -> DataFrame:
    note_file = plain_path(F.col("_metadata.file_path"))
    wanted = files.filter(note_files(note_file, None if depth is None else absolute_root(files.sparkSession, path), depth))
    return wanted.select(note_file.alias("_note_file"), F.col("value").alias("content"))
