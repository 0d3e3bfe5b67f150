"""Listing and reading JUnit report files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testlog.operators.runs import glob_pattern


WILD = re.compile(r"[*?\[{]")


def _read(spark: SparkSession, path: str, pattern: str | None, since: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if since:
        # the source itself skips older files before their content is read
        reader = reader.option("modifiedAfter", since)
    return reader.load(path)


def _read_glob(spark: SparkSession, glob: str, since: str | None) -> DataFrame:
    """Files of a glob; one with ``**`` is read from its fixed root and matched by path."""
    if "**" not in glob:
        return _read(spark, glob, None, since)
    folders = glob.split("/")
    fixed = next(i for i, part in enumerate(folders) if WILD.search(part))
    root, last = "/".join(folders[:fixed]) or ".", folders[-1]
    found = _read(spark, root, "*" if last == "**" else last, since)
    return found.filter(F.col("path").rlike(glob_pattern("**/" + glob.lstrip("/"))))


def list_reports(
    spark: SparkSession,
    files: list[str] = (),
    dirs: list[str] = (),
    globs: list[str] = (),
    run_id: int | None = None,
    modified_after: str | None = None,
) -> DataFrame:
    """Explicit files, ``*.xml`` below directories, and path globs, each path once."""
    parts = [_read(spark, f, None, modified_after) for f in files]
    parts += [_read(spark, d, "*.xml", modified_after) for d in dirs]
    parts += [_read_glob(spark, g, modified_after) for g in globs]
    if not parts:
        raise ValueError("no report input given")
    union = reduce(DataFrame.unionByName, parts)
    return union.dropDuplicates(["path"]).select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        "path",
        F.col("modificationTime").alias("modified"),
        F.col("content").cast("string").alias("content"),
    )


def distinct_reports(reports: DataFrame) -> DataFrame:
    """A run's report paths, each once, whatever number of inputs named them."""
    return reports.dropDuplicates(["run_id", "path"])
