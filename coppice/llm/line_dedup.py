"""Removal of lines that spread over many sites, in DataFrame operations only.

One HyperLogLog sketch of sites per line hash, merged by aggregation: each task sketches the lines it
reads, and only a sketch for each of its lines is shuffled. Lines whose estimate is near the threshold,
and only those, get an exact count of their sites from a second pass. Lines on at least ``min_sites``
sites are boilerplate and go from every document. With ``min_texts`` they must also be in so many
distinct texts, so copies of one text don't make its lines boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written

#: log2 of a sketch's registers: a relative error of 1.6 %; the exact band is five times that.
LOG_K = 12
BAND = 0.08
#: Boilerplate lines that a plan may hold as constants (two hashes each). More are joined.
IN_PLAN = 5000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hash(line: Column, name: str = "line") -> list[Column]:
    return [F.xxhash64(line).alias(f"{name}_a"), F.xxhash64(F.lit(7), line).alias(f"{name}_b")]


KEYS = ["line_a", "line_b"]


def _exploded(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    """The given columns and the hash of each line that isn't blank."""
    lines = docs.select(*more, F.explode(_lines(F.col(text_col))).alias("__line")).where(F.col("__line").rlike(r"\S"))
    return lines.select(*[c for c in lines.columns if c != "__line"], *_hash(F.col("__line")))


def spread_lines(docs: DataFrame, min_sites: int, site_col: str = "source", text_col: str = "text", min_texts: int = 1) -> DataFrame:
    """Hashes of the non-blank lines on at least min_sites distinct sites (a null site is one) and in min_texts distinct texts, and their rows (n)."""
    site = F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit("\0"))).alias("site")
    lines = _exploded(docs, text_col, site)
    about = lines.groupBy(*KEYS).agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"), F.count("*").alias("n"))
    # a line on k sites has k rows at least, which spares most lines the estimate
    about = about.where(F.col("n") >= min_sites).select(*KEYS, F.hll_sketch_estimate("sketch").alias("sites"), "n")
    about = written(about.where(F.col("sites") >= min_sites * (1 - BAND) - 1), "line-spread")
    sure = F.col("sites") > min_sites * (1 + BAND) + 1
    near = about.where(~sure)
    total = near.agg(F.sum("n")).first()[0] or 0
    # the sites of the lines near the threshold, dealt by line and site, so a line of many rows is not one task's
    exact = join_hot(lines, near.select(*KEYS, "n"), KEYS, "n", total, "inner").groupBy(*KEYS, "site").agg(F.max("n").alias("n"))
    exact = exact.groupBy(*KEYS).agg(F.count("*").alias("sites"), F.max("n").alias("n"))
    spread = about.where(sure).unionByName(exact.where(F.col("sites") >= min_sites))
    return _in_texts(docs, written(spread, "line-sites-spread"), min_texts, text_col) if min_texts > 1 else spread


def _in_texts(docs: DataFrame, spread: DataFrame, min_texts: int, text_col: str) -> DataFrame:
    """The spread lines that are in at least min_texts distinct texts, counted exactly."""
    total = spread.agg(F.sum("n")).first()[0] or 0
    rows = join_hot(_exploded(docs, text_col, F.xxhash64(F.col(text_col)).alias("text")), spread, KEYS, "n", total, "inner")
    # each line's texts are dealt by line and text, so a line in most documents is not one task's
    texts = rows.groupBy(*KEYS, "text").agg(F.lit(1).alias("one")).groupBy(*KEYS).agg(F.count("*").alias("texts"))
    return spread.join(texts.where(F.col("texts") >= min_texts), KEYS, "left_semi")


def remove_spread_lines(docs: DataFrame, min_sites: int = 5, site_col: str = "source", text_col: str = "text", id_col: str = "doc_id", length_col: str = "n_chars", counts: bool = False, min_texts: int = 1) -> DataFrame:
    """Documents without their boilerplate lines, in their own columns (``counts``: with n_lines and n_removed).

    Blank lines always stay. A text that loses no line stays as it is, null included; one that
    loses all is empty. Repeated rows lose the same lines; length_col (if there) follows. An empty table
    gives no rows. Very long texts take the memory of one row. Up to IN_PLAN boilerplate lines are
    looked up in the row and no document moves; more are joined by line, with the same result.
    """
    spread = written(spread_lines(docs, min_sites, site_col, text_col, min_texts), "boilerplate")
    few = spread.limit(IN_PLAN + 1).select(*KEYS).collect()
    hits = _hits_in_row(docs, few, text_col) if len(few) <= IN_PLAN else _hits_by_join(docs, spread, text_col, id_col)
    lines = _lines(F.col(f"`{text_col}`"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__hits"))
    some = F.size("__hits") > 0
    out = hits.withColumn("__text", F.when(some, F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")).otherwise(F.col(f"`{text_col}`")))
    types = dict(docs.dtypes)
    columns = [
        F.col("__text").alias(c) if c == text_col
        else F.when(some, F.char_length("__text").cast(types[c])).otherwise(F.col(f"`{c}`")).alias(c) if c == length_col
        else F.col(f"`{c}`")
        for c in docs.columns
    ]
    extra = [F.size(lines).cast("long").alias("n_lines"), F.size("__hits").cast("long").alias("n_removed")]
    return out.select(*columns, *(extra if counts else []))


def _hits_in_row(docs: DataFrame, spread: list, text_col: str) -> DataFrame:
    """docs with __hits, the places of the boilerplate lines in the text, from constants of the plan."""
    if not spread:
        return docs.withColumn("__hits", F.array().cast("array<int>"))
    a, b = (",".join(f"{r[k]}L" if r[k] > -(1 << 63) else "(-9223372036854775807L - 1L)" for r in spread) for k in (0, 1))
    quoted = text_col.replace("`", "``")
    places = f"transform(split(coalesce(`{quoted}`, ''), '\n'), (l, i) -> if(xxhash64(l) IN ({a}) AND xxhash64(7, l) IN ({b}), i, -1))"
    return docs.withColumn("__hits", F.array_remove(F.expr(places), F.lit(-1)))


def _hits_by_join(docs: DataFrame, spread: DataFrame, text_col: str, id_col: str) -> DataFrame:
    key = [F.xxhash64(F.col(id_col), F.col(text_col)).alias("__a"), F.xxhash64(F.lit(7), F.col(id_col), F.col(text_col)).alias("__b")]
    at = docs.select(*key, F.posexplode(_lines(F.col(text_col))).alias("__at", "__line")).where(F.col("__line").rlike(r"\S")).select("__a", "__b", "__at", *_hash(F.col("__line")))
    total = spread.agg(F.sum("n")).first()[0] or 0
    hits = join_hot(at, spread, KEYS, "n", total, "inner").groupBy("__a", "__b").agg(F.collect_set("__at").alias("__found"))
    out = docs.select("*", *key).join(hits, ["__a", "__b"], "left")
    return out.withColumn("__hits", F.coalesce("__found", F.array().cast("array<int>")))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = remove_spread_lines(docs, min_sites=5, counts=True)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, i, s[i] AS line
  FROM (SELECT doc_id, source, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
bad AS (SELECT line FROM l WHERE regexp_matches(line, '[^ \t\n\x{0B}\f\r]') GROUP BY line HAVING count(DISTINCT site) >= 5),
m AS (SELECT l.*, bad.line IS NOT NULL AS gone FROM l LEFT JOIN bad USING (line))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  CAST(length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS BIGINT) AS n_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
FROM m GROUP BY doc_id
"""
