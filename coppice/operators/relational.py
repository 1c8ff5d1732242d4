"""Joins, anti-joins, rollups and waterfalls; column names are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.text import ancestors


def grouped_count(df: DataFrame, value: Column) -> DataFrame:
    return df.groupBy(value.cast("string").alias("value")).agg(F.count("*").alias("count")).orderBy("value")


def first_declaration(df: DataFrame, id: str, order: list[Column]) -> DataFrame:
    """The first row of each id, by an aggregate that begins where the rows are, so a hot id isn't one task's."""
    best = df.groupBy(F.col(id).alias("__id")).agg(F.min(F.struct(*[o.alias(f"__o{k}") for k, o in enumerate(order)], F.struct(*[F.col(c) for c in df.columns]).alias("__row"))).alias("__best"))
    return best.select("__best.__row.*")


def first_by(df: DataFrame, id: str, order: str) -> DataFrame:
    """The row of each id with the least ``order``."""
    rest = [c for c in df.columns if c != id]
    return df.groupBy(id).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row")).select(id, "__row.*")


def previous_declaration(df: DataFrame, id: str, order: list[Column], what: str) -> DataFrame:
    """Rows whose id was declared before, with ``previous``: the row just before it, not the first."""
    w = Window.partitionBy(id).orderBy(*order)
    return df.withColumn("previous", F.lag(what).over(w)).where("previous IS NOT NULL")


def unsupported(decls: DataFrame, id: str, *supports: tuple[DataFrame, str]) -> DataFrame:
    """Declarations without a row in any of the supports."""
    for s, key in supports:
        decls = decls.join(s.select(F.col(key).alias("__s")).distinct(), F.col(id) == F.col("__s"), "left_anti")
    return decls


def missing_intermediates(decls: DataFrame, id: str) -> DataFrame:
    """Ancestor ids that are not declared."""
    up = decls.select(F.explode(ancestors(F.col(id))).alias("missing_id")).distinct()
    return up.join(decls.select(F.col(id).alias("missing_id")).distinct(), "missing_id", "left_anti")


def nearest_visible(nodes: DataFrame, visible: DataFrame, id: str) -> DataFrame:
    """Each node with its nearest visible proper ancestor, or null."""
    up = nodes.select(id, F.posexplode(ancestors(F.col(id))).alias("depth", "ancestor"))
    seen = visible.select(F.col(id).alias("ancestor")).distinct()
    near = up.join(seen, "ancestor").groupBy(id).agg(F.max_by("ancestor", "depth").alias("parent_id"))
    return nodes.select(id).join(near, id, "left")


def either_match(left: DataFrame, right: DataFrame, conditions: list[Column]) -> DataFrame:
    """Rows that match by any of the conditions, each an equi-join of its own, and once only."""
    out = left.join(right, conditions[0])
    for c in conditions[1:]:
        out = out.unionByName(left.join(right, c))
    return out.distinct()


def resolve_unique(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, resolution, value): unique, ambiguous or missing."""
    n = F.countDistinct(value)
    return pairs.groupBy(key).agg(n.alias("candidates"), F.when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("missing").alias("resolution"), F.when(n == 1, F.min(value)).alias("resolved"))


def cascade(candidates: DataFrame, call: str, target: str, priority: str) -> DataFrame:
    """The target of the first priority at which a call has exactly one."""
    per = candidates.select(call, target, priority).distinct()
    one = per.groupBy(call, priority).agg(F.count("*").alias("__n"), F.min(target).alias(target)).where("__n = 1")
    return one.groupBy(call).agg(F.min_by(target, priority).alias(target), F.min(priority).alias(priority))


def coupling(nodes: DataFrame, edges: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """Distinct fan-out and fan-in without self edges, and instability (0 when isolated)."""
    e = edges.where(F.col(source) != F.col(target)).select(source, target).distinct()
    out = e.groupBy(F.col(source).alias(node)).agg(F.count("*").alias("fan_out"))
    into = e.groupBy(F.col(target).alias(node)).agg(F.count("*").alias("fan_in"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    df = nodes.select(node).distinct().join(out, node, "left").join(into, node, "left").select(node, zero("fan_out"), zero("fan_in"))
    total = F.col("fan_out") + F.col("fan_in")
    return df.withColumn("instability", F.when(total > 0, F.col("fan_out") / total).otherwise(F.lit(0.0)))


def waterfall(*cases: tuple[Column, str], otherwise: str) -> Column:
    """The first label whose condition holds."""
    out = None
    for c, label in cases:
        out = F.when(c, label) if out is None else out.when(c, label)
    return out.otherwise(otherwise)


def span_containment(refs: DataFrame, spans: DataFrame, path: str, line: str, start: str, end: str, span_id: str, ref_id: str) -> DataFrame:
    """References inside exactly one span of their path. Lines are whole numbers.

    A span is cut into stretches of 2^k lines that begin at a multiple of 2^k, two of a size at most, and the spans of a
    stretch are counted before the join. A line is in one stretch of each size, so the work grows with the rows and the
    logarithm of the spans' lengths, not with the pairs, however many spans overlap.
    """
    at = lambda x, k: F.call_function("shiftright", x, k)
    lo, past = F.col("__lo"), F.col("__hi") + 1
    bits = lambda n: (F.length(F.bin(n)) - 1).cast("int")
    first, last = lambda k: -at(-lo, k), lambda k: at(past, k)
    odd = lambda x: F.pmod(x, F.lit(2)) == 1
    s = spans.where(F.col(start) <= F.col(end)).select(F.col(path).alias("__path"), F.col(start).cast("long").alias("__lo"), F.col(end).cast("long").alias("__hi"), F.col(span_id).alias("__span"))
    top = s.agg(bits(F.max(past - lo)).alias("__top"))
    s = s.groupBy("__path", "__lo", "__hi").agg(F.count("*").alias("__n"), F.min("__span").alias("__span"))
    s = s.withColumn("__k", F.explode(F.sequence(F.lit(0), bits(past - lo)))).where(first(F.col("__k")) < last(F.col("__k")))
    ends = F.array(F.when(odd(first(F.col("__k"))), first(F.col("__k"))), F.when(odd(last(F.col("__k"))), last(F.col("__k")) - 1))
    s = s.withColumn("__at", F.explode(ends)).where("__at IS NOT NULL").groupBy("__path", "__k", "__at").agg(F.sum("__n").alias("__n"), F.min("__span").alias("__span"))
    r = refs.select(F.col(path).alias("__path"), F.col(line).cast("long").alias("__line"), F.col(ref_id).alias("__ref"))
    lines = r.select("__path", "__line").distinct().crossJoin(F.broadcast(top)).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__top"))))
    hit = lines.withColumn("__at", at(F.col("__line"), F.col("__k"))).join(s, ["__path", "__k", "__at"]).groupBy("__path", "__line").agg(F.sum("__n").alias("__n"), F.min("__span").alias("__span"))
    out = r.join(hit, ["__path", "__line"]).groupBy("__ref").agg(F.sum("__n").alias("__n"), F.min("__span").alias("__span")).where("__n = 1")
    return out.select(F.col("__ref").alias(ref_id), F.col("__span").alias(span_id))


def duplicates(items: DataFrame, key: list[Column]) -> DataFrame:
    """Members of groups with equal keys, with peer_count; groups are counted before the join back.

    Null parts of a key are equal to each other. A group of many members is split by adaptive execution, as the
    groups' side of the join has one row for it.
    """
    names = [f"__k{i}" for i in range(2 * len(key))]
    # a part and whether it is null, so that the join is an equi-join without nulls
    parts = [c for k in key for c in (F.coalesce(k.cast("string"), F.lit("")), k.isNull())]
    keyed = items.select("*", *[k.alias(n) for k, n in zip(parts, names, strict=True)])
    groups = keyed.groupBy(*names).agg((F.count("*") - 1).alias("peer_count")).where("peer_count > 0")
    return keyed.join(groups, names).drop(*names)


def kth_match(left: DataFrame, right: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The k-th row of each key on the left with the k-th on the right; rows without a partner go. Keys are small groups, such as a file's items of one name."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return left.withColumn("__k", nth).join(right.withColumn("__k", nth).drop(*[c for c in right.columns if c in left.columns and c not in keys]), [*keys, "__k"]).drop("__k")
