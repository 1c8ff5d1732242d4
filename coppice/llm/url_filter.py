"""URL verdicts: allow and block rules first, else a logistic regression, in DataFrame operations only.

The model is trained from a small labelled table of URLs (data/url_labels.csv, or one of the caller's) on
hashed character trigrams of host and path. Its weights are whole numbers (millionths), so a score is
the same sum everywhere.
"""

from __future__ import annotations

import csv
import math
import zlib
from collections import Counter
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A prime, so that places depend on all three characters.
PLACES = 4093
#: Rules that one expression holds; more are joined by host.
RULES_IN_PLAN = 200

#: Verdict, host and path prefix.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for block) of the table that comes with the package."""
    with resources.files(__package__).joinpath("data/url_labels.csv").open(encoding="utf-8") as f:
        return [(r["url"], int(r["label"])) for r in csv.DictReader(f)]


LABELS = labelled_urls()


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for URLs without ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _python_parts(url: str) -> str:
    rest = (url or "").partition("://")[2]
    end = min([i for i in map(rest.find, "?#") if i >= 0] or [len(rest)])
    host, slash, path = rest[:end].partition("/")
    return host.translate(str.maketrans(UPPER, UPPER.lower())) + slash + path


def _place(a: int, b: int, c: int) -> int:
    return ((a * 131 + b) * 131 + c) % PLACES


def train(labels: list[tuple[str, int]], epochs: int = 40, rate: float = 0.3, l2: float = 1e-3) -> tuple[list[int], int]:
    """Weights and bias in millionths, from (url, label) rows of a small table, each learnt whole."""
    rows = [(Counter(_place(*map(ord, s[i : i + 3])) for i in range(len(s) - 2)), y) for s, y in ((_python_parts(u), y) for u, y in labels)]
    rows.sort(key=lambda r: zlib.crc32(repr(sorted(r[0].items())).encode()))
    w, bias = [0.0] * PLACES, 0.0
    for _ in range(epochs):
        for x, y in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(w[k] * n for k, n in x.items())))))
            bias -= rate * (p - y) / 10
            for k, n in x.items():
                w[k] -= rate * ((p - y) * n / max(1, len(x)) * 4 + l2 * w[k])
    return [round(v * 1e6) for v in w], round(bias * 1e6)


def log_odds(url: str, weights: list[int], bias: int) -> int:
    """What model_score gives for one URL."""
    s = _python_parts(url)
    return bias + sum(weights[_place(*map(ord, s[i : i + 3]))] for i in range(len(s) - 2))


def held_out_accuracy(labels: list[tuple[str, int]], parts: int = 5) -> float:
    """Share of labels that a model trained without any URL of the same host gives, over all hosts in turn."""
    host = lambda u: _python_parts(u).split("/")[0]
    fold = {u: zlib.crc32(host(u).encode()) % parts for u, _ in labels}
    right = 0
    for k in range(parts):
        model = train([r for r in labels if fold[r[0]] != k])
        right += sum((log_odds(u, *model) > 0) == bool(y) for u, y in labels if fold[u] == k)
    return right / len(labels)


def model_score(text: Column, weights: list[int], bias: int) -> Column:
    """Log-odds of block in millionths; texts of fewer than three characters have the bias."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    code = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    n = F.char_length(text)
    place = lambda i: ((F.get(code, i) * 131 + F.get(code, i + 1)) * 131 + F.get(code, i + 2)) % PLACES
    grams = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(grams, F.lit(bias).cast("long"), lambda a, i: a + F.get(table, place(i).cast("int")))


def ruled(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rows (host, path) with the longest rule that fits and its verdict, both null if none does; of equal rules the last one counts."""
    if len(rules) <= RULES_IN_PLAN:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
            fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
            rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
        return rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    last = {(h, p): v for v, h, p in rules}
    by_host: dict[str, list[tuple[int, str, str]]] = {}
    for (h, p), v in last.items():
        by_host.setdefault(h, []).append((len(h + p), p, v))
    depths = sorted({h.count(".") + 1 for h in by_host})
    table = rows.sparkSession.createDataFrame([(h, x) for h, x in by_host.items()], "__host string, __own array<struct<size:int,path:string,verdict:string>>")
    labels, fits = F.split("host", r"\."), []
    for d in depths:
        # a host and each of its parent domains, as one join a depth; no row moves while the rules are small enough to broadcast
        own = table.where(F.size(F.split("__host", r"\.")) == d).select(F.col("__host").alias(f"__h{d}"), F.col("__own").alias(f"__o{d}"))
        rows = rows.join(own, F.when(F.size(labels) >= d, F.array_join(F.slice(labels, F.size(labels) - d + 1, d), ".")) == F.col(f"__h{d}"), "left")
        good = F.filter(F.coalesce(F.col(f"__o{d}"), F.array().cast("array<struct<size:int,path:string,verdict:string>>")), lambda r: F.col("path").startswith(r["path"]))
        own_host = F.col(f"__h{d}")
        fits.append(F.transform(good, lambda r: F.struct(r["size"].alias("size"), F.concat(own_host, r["path"]).alias("rule"), r["verdict"].alias("verdict"))))
    best = F.array_max(F.concat(*fits))
    return rows.withColumn("__best", best).select("*", F.col("__best.rule").alias("rule"), F.col("__best.verdict").alias("verdict")).drop("__best", *[f"__{x}{d}" for d in depths for x in "ho"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], weights: list[int], bias: int, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule (the longest that fits, else null), score and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's. A null or odd
    URL has an empty host and path and fits no rule; repeated rows are judged alike; an empty table
    gives no rows; other columns are ignored.
    """
    host, path = parts(F.col(url_col))
    rows = ruled(pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path")), rules)
    scored = rows.withColumn("score", model_score(F.concat("host", "path"), weights, bias))
    return scored.select(F.col("__id").alias(id_col), "host", "path", "rule", "score", F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"))


def op8(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, *train(LABELS))


def op8_sql() -> str:
    weights, bias = train(LABELS)
    cases = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}|{h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT *, CASE {' '.join(cases)} END AS fit, list_transform(range(1, length(host || path) - 1), lambda i:
  ((unicode(substr(host || path, i, 1)) * 131 + unicode(substr(host || path, i + 1, 1))) * 131 + unicode(substr(host || path, i + 2, 1))) % {PLACES}) AS grams FROM h),
s AS (SELECT *, CAST({bias} + coalesce(list_sum(list_transform(grams, lambda g: CAST([{', '.join(map(str, weights))}][CAST(g AS INTEGER) + 1] AS BIGINT))), 0) AS BIGINT) AS score FROM m)
SELECT page_id, host, path, split_part(fit, '|', 2) AS rule, score, coalesce(split_part(fit, '|', 1), CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM s
"""
