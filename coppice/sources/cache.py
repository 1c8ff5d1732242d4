"""Facts kept between runs: what a file said last time holds as long as its path and content are the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Part of every key; a new number makes all old facts stale.
VERSION = 1


def fingerprint(files: DataFrame) -> DataFrame:
    """files with ``fingerprint``: of version, path and text."""
    return files.withColumn("fingerprint", F.sha2(F.concat_ws("\0", F.lit(str(VERSION)), "path", F.coalesce("text", F.lit(""))), 256))


def cached_facts(files: DataFrame, folder: str, facts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """facts(files), where only files that the cache (Parquet below ``folder``) doesn't know are parsed.

    ``facts`` makes rows with a path from rows of files. The cache has the facts and the fingerprints of the files they
    were made from, files without facts too. A run appends the facts first and their fingerprints last, so one that is
    broken off leaves nothing that counts.
    """
    spark = files.sparkSession
    keyed = fingerprint(files)
    known = _read(spark, f"{folder}/files")
    fresh = keyed if known is None else keyed.join(known.select("fingerprint").distinct(), "fingerprint", "left_anti")
    if not fresh.isEmpty():
        made = facts(fresh.drop("fingerprint"))
        made.join(fresh.select("path", "fingerprint"), "path").write.mode("append").parquet(f"{folder}/facts")
        fresh.select("fingerprint").distinct().write.mode("append").parquet(f"{folder}/files")
    every = _read(spark, f"{folder}/facts")
    if every is None:
        return facts(files.limit(0))
    # a run that was broken off may have appended facts twice
    return every.join(keyed.select("fingerprint").distinct(), "fingerprint", "left_semi").distinct().drop("fingerprint")


def _read(spark, path: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
