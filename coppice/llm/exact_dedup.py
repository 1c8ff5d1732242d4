"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its content says so: 256 characters on or later, after a sentence end or after one
of some pairs of characters (about one in a hundred), so text without sentences is cut by its content
too; 4096 at most. A chunk's identifier is two 64-bit hashes, verified against the bytes of
all chunks that carry it; of different chunks with the same hashes each gets a number of its own.
Documents are then lists of identifiers, and equal lists are equal texts, so long texts do not
move once their chunks are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, lower_ascii, written

#: Ends of sentences with white space after them, pairs of characters that are none, and ends of sentences that need no space.
#: One class of characters comes first, so that most places are passed over at once.
CHUNK = r"(?s).{256,4094}?[.!?\nqxz79。！？、](?:(?<=[.!?\n])\s|(?<=[qxz79])[aeiou013]|(?<=[。！？、]))|.{1,4096}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def hashes(chunk: Column) -> list[Column]:
    return [F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(7), chunk).alias("b")]


def collisions(docs: DataFrame, text_col: str) -> DataFrame | None:
    """(a, b, chunk, nth) of the chunks that are not the only ones with their hashes, numbered from 0; None if there are none."""
    parts = docs.select(F.explode(chunks(lower_ascii(F.col(text_col)))).alias("chunk")).distinct().select(*hashes(F.col("chunk")), "chunk")
    twice = parts.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if twice.isEmpty():
        return None
    return written(parts.join(twice, ["a", "b"]).groupBy("a", "b").agg(F.array_sort(F.collect_list("chunk")).alias("all")).select("a", "b", F.posexplode("all").alias("nth", "chunk")), "chunk-collisions")


def recipes(rows: DataFrame, twice: DataFrame | None) -> DataFrame:
    """rows (__row, __chunks) with __recipe. Chunks whose hashes are not theirs alone are looked up one by one."""
    plain = F.transform(F.col("__chunks"), lambda c: F.struct(*hashes(c), F.lit(0).alias("nth")))
    if twice is None:
        return rows.select("*", plain.alias("__recipe"))
    rows = written(rows, "chunked")
    parts = rows.select("__row", F.posexplode("__chunks").alias("at", "chunk")).select("__row", "at", *hashes(F.col("chunk")), "chunk")
    odd = parts.join(twice, ["a", "b", "chunk"]).select("__row", F.struct("at", "nth").alias("odd"))
    found = rows.select("*", plain.alias("__plain")).join(odd.groupBy("__row").agg(F.map_from_entries(F.collect_list("odd")).alias("__odd")), "__row", "left")
    one = lambda c, i: F.struct(c["a"].alias("a"), c["b"].alias("b"), F.coalesce(F.col("__odd")[i], F.lit(0)).alias("nth"))
    return found.select("*", F.transform("__plain", one).alias("__recipe")).drop("__plain", "__odd")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id_col, keep_id, group_size, kept and text_sha256 (of the text with A-Z lower-cased).

    Equal means identical after lower-casing A-Z; null counts as empty. Of equal texts one row
    stays: that with the largest id (null ids come last); of repeated rows with that id, one.
    An empty table gives no rows; other columns are ignored. A very long text takes the memory of one row.
    """
    text = lower_ascii(F.col(text_col))
    twice = collisions(docs, text_col)
    rows = docs.select(
        F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("__row"), chunks(text).alias("__chunks"), F.sha2(text.cast("binary"), 256).alias("text_sha256"),
    )
    rows = written(recipes(rows, twice).drop("__chunks"), "recipes")
    groups = rows.groupBy("__recipe").agg(F.count("*").alias("group_size"), F.max(F.struct("__id", "__row")).alias("__best"))
    out = join_hot(rows, groups, ["__recipe"], "group_size", rows.count())
    return out.select(F.col("__id").alias(id_col), F.col("__best.__id").alias("keep_id"), "group_size", (F.col("__row") == F.col("__best.__row")).alias("kept"), "text_sha256")


def op4(spark, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (t)
"""
