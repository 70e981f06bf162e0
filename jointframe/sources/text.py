"""Line and document scans that keep file order without gathering a file in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, _blk, seq, line): large files are read in splits; (_blk, seq) is the line order of a file.

    Inside a split rows come in file order, so the increasing id orders them.
    """
    return spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text): one row per file, for formats that are one small document each."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of files; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", pattern).load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def tokens(line):
    """Whitespace-separated tokens of a line."""
    return F.split(F.trim(line), r"\s+")


def matches(line, pattern: str, groups: int):
    """The groups of every match as an array of arrays, made for ``explode``.

    A generator is a wall for the optimizer: filters on the groups are not
    pushed below it, so the pattern runs once per line and once per match.
    """
    marked = "\x01".join(f"${i}" for i in range(1, groups + 1))
    return F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)),
                       lambda hit: F.split(F.regexp_replace(hit, pattern, marked), "\x01"))
