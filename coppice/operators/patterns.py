"""Pattern similarity, profiles, missing applications and clusters over a table of items.

An item has: shape (array of node kinds in pre-order), nodes, name, calls (array of name, qualifier,
syntax) and invocations (array). ``features`` adds the term sets that everything here works on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions import text as T


@dataclass(frozen=True)
class Benchmarks:
    """Expected mean similarity by strictness. Fixed values unless configured."""

    high: float = 0.55
    medium: float = 0.45
    low: float = 0.20

    def __post_init__(self):
        if not 0 <= self.low <= self.medium <= self.high <= 1:
            raise ValueError("pattern benchmarks must be ordered: 0 <= low <= medium <= high <= 1")

    def expected(self, strictness: Column) -> Column:
        return F.when(strictness == "high", self.high).when(strictness == "low", self.low).otherwise(self.medium)


#: Weights of pair similarity (shape, calls, invocations, size).
SHAPE, CALLS, INVOCATIONS, SIZE = 0.52, 0.34, 0.08, 0.06
#: Weights of a missing application (required recall, similarity, discriminator recall).
RECALL, SIMILAR, TELLING = 0.58, 0.27, 0.15
#: The benchmark ladder.
DUPLICATE_LIKE, DIFFUSE, TOLERANCE, OUTLIER_LEAST, OUTLIER_RANGE = 0.88, 0.05, 0.15, 0.10, 0.60
#: How many candidates, terms and items a report holds, and the least size of a clustered item.
TOP, TERMS, ITEMS, CLUSTER_NODES, SIGNATURE_TERMS = 20, 12, 8, 12, 10


def features(items: DataFrame) -> DataFrame:
    c = F.col
    return items.select(
        "*", T.shape_terms(c("shape")).alias("shape_terms"), F.array_distinct(T.call_names(c("calls"))).alias("call_terms"), F.array_distinct("invocations").alias("invocation_terms"),
        T.match_terms(c("shape"), c("nodes"), c("name"), c("calls"), c("invocations")).alias("terms"),
    )


def pair_similarity(a: str, b: str) -> Column:
    """Of two items with features, whose columns have the prefixes a and b."""
    x, y = F.col(f"{a}nodes"), F.col(f"{b}nodes")
    size = F.when((x == 0) | (y == 0), 0.0).otherwise(F.least(x, y) / F.greatest(x, y))
    one = lambda c: T.jaccard(F.col(f"{a}{c}"), F.col(f"{b}{c}"))
    return SHAPE * one("shape_terms") + CALLS * one("call_terms") + INVOCATIONS * one("invocation_terms") + SIZE * size


def _met(rows: DataFrame, group: str, order: str, kept: list[str], part: int) -> DataFrame:
    """Rows of a group against rows of it, as __g and the columns with a_ and b_; each two meet both ways round.

    A group is cut in as many parts as ``part`` asks for and every pair of parts is a task's, so a large group isn't one task.
    """
    size = rows.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / part)).cast("int").alias("__parts"))
    dealt = rows.join(size, group).withColumn("__own", F.pmod(F.xxhash64(order), F.col("__parts")).cast("int"))
    side = lambda p: dealt.select(F.col(group).alias("__g"), "__parts", "__own", *[F.col(c).alias(p + c) for c in kept])
    left = side("a_").withColumn("__to", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    right = side("b_").withColumnsRenamed({"__own": "__to"}).withColumn("__own", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    # few bytes can be many pairs, so the number of tasks is not left to the size of the rows
    keys, tasks = ["__g", "__own", "__to"], 4 * rows.sparkSession.sparkContext.defaultParallelism
    return left.drop("__parts").repartition(tasks, *keys).join(right.drop("__parts").repartition(tasks, *keys), keys)


def _pairs(rows: DataFrame, group: str, order: str) -> DataFrame:
    """(group, similarity) for the pairs of rows of a group. Groups are hand-marked applications or one signature's items."""
    both = _met(rows, group, order, ["nodes", *SETS, order], PART).where(F.col(f"a_{order}") < F.col(f"b_{order}"))
    return both.select(F.col("__g").alias(group), pair_similarity("a_", "b_").alias("similarity"))


def _closest(a: str, b: str, same: Column) -> Column:
    """The largest ratio of a size of one to a size of the other, both sorted and above 0; of neighbours in one where they are the same."""
    tagged = lambda c, tag: F.transform(F.col(c), lambda x: F.struct(x.alias("v"), F.lit(tag).alias("of")))
    near = lambda m, cross: F.array_max(F.transform(F.sequence(F.lit(1), F.size(m) - 1), lambda k: F.when(
        F.lit(True) if not cross else F.get(m, k - 1)["of"] != F.get(m, k)["of"], F.get(m, k - 1)["v"] / F.get(m, k)["v"])))
    one, two = tagged(a, 0), F.array_sort(F.concat(tagged(a, 0), tagged(b, 1)))
    alone = F.when(F.size(F.col(a)) > 1, near(one, False))
    return F.when(same, alone).when(F.arrays_overlap(a, b), 1.0).when((F.size(F.col(a)) > 0) & (F.size(F.col(b)) > 0), near(two, True))


def _class_similarity(rows: DataFrame, group: str) -> DataFrame:
    """(group, sum, least, most) of the similarity of all pairs of a group, from its classes of equal term sets and its sizes.

    The mean of a sum is the sum of the means, so terms meet by class and sizes by size. Rows have no nulls and no two of one order.
    """
    sized = rows.groupBy(group, *SETS, "nodes").agg(F.count("*").alias("m"))
    some = F.col("nodes") > 0
    classes = sized.groupBy(group, *SETS).agg(
        F.sum("m").alias("n"), F.array_sort(F.collect_list(F.when(some, F.col("nodes").cast("double")))).alias("sizes"),
        F.coalesce(F.bool_or(some & (F.col("m") > 1)), F.lit(False)).alias("twice"), F.bool_or(~some).alias("zero")).withColumn("__class", F.struct(*SETS))
    both = _met(classes, group, "__class", ["n", "sizes", "twice", "zero", "__class", *SETS], CLASSES).where("a___class <= b___class")
    same = F.col("a___class") == F.col("b___class")
    pairs = F.when(same, F.col("a_n") * (F.col("a_n") - 1) / 2).otherwise(F.col("a_n").cast("double") * F.col("b_n"))
    one = lambda c: T.jaccard(F.col(f"a_{c}"), F.col(f"b_{c}"))
    both = both.select("*", same.alias("__same"), pairs.alias("__pairs")).where("__pairs > 0")
    both = both.select("*", (SHAPE * one("shape_terms") + CALLS * one("call_terms") + INVOCATIONS * one("invocation_terms")).alias("__base"))
    least, most = lambda c: F.get(F.col(c), 0), lambda c: F.get(F.col(c), F.size(F.col(c)) - 1)
    far = F.when(F.col("a_zero") | F.col("b_zero"), 0.0).otherwise(F.least(least("a_sizes") / most("b_sizes"), least("b_sizes") / most("a_sizes")))
    near = F.when(F.col("__same") & F.col("a_twice"), 1.0).otherwise(F.coalesce(_closest("a_sizes", "b_sizes", F.col("__same")), F.lit(0.0)))
    terms = both.groupBy(F.col("__g").alias(group)).agg(F.sum(F.col("__base") * F.col("__pairs")).alias("terms"), F.min(F.col("__base") + SIZE * far).alias("least"), F.max(F.col("__base") + SIZE * near).alias("most"))
    # pairs of sizes by a running sum of the smaller ones
    sizes = sized.where(some).groupBy(group, "nodes").agg(F.sum("m").cast("double").alias("m"))
    below = F.sum(F.col("m") * F.col("nodes")).over(Window.partitionBy(group).orderBy("nodes").rowsBetween(Window.unboundedPreceding, -1))
    ratio = F.col("m") * F.coalesce(below, F.lit(0.0)) / F.col("nodes") + F.col("m") * (F.col("m") - 1) / 2
    ratios = sizes.withColumn("ratio", ratio).groupBy(group).agg(F.sum("ratio").alias("ratio"))
    return terms.join(ratios, group, "left").select(group, (F.col("terms") + SIZE * F.coalesce("ratio", F.lit(0.0))).alias("sum"), "least", "most")


#: Rows of a group that meet the rows of another part in one task.
PART = 1000
#: Classes of a group that do so.
CLASSES = 256
#: The term sets that two items are compared by.
SETS = ["shape_terms", "call_terms", "invocation_terms"]


def similarity_summary(applied: DataFrame, definitions: DataFrame, benchmarks: Benchmarks = Benchmarks()) -> DataFrame:
    """For each pattern with applications: scored ones, pairs, mean, least and most similarity, expected and the estimate (null without pairs).

    ``applied`` has pattern_id, ord (which orders applications) and features; ``definitions`` pattern_id and
    strictness, of which the first by ord counts; a pattern without one is of medium strictness.
    """
    first = definitions.groupBy("pattern_id").agg(F.min_by("strictness", "ord").alias("strictness"))
    n = applied.groupBy("pattern_id").agg(F.count("*").alias("scored"))
    s = F.col("similarity")
    # pairs are made one by one only in groups with nulls or repeated orders, where not every two rows are a pair
    null = F.greatest(*[F.col(c).isNull() for c in ("nodes", *SETS, "ord")]) | (F.col("nodes") < 0)
    per = applied.groupBy("pattern_id", "ord").agg(F.count("*").alias("n"), F.bool_or(null).alias("null"))
    per = per.groupBy("pattern_id").agg(F.bool_or(F.col("null") | (F.col("n") > 1)).alias("odd"), F.sum("n").alias("n"))
    odd, even = per.where("odd").select("pattern_id"), per.where("NOT odd AND n > 1").select("pattern_id", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    summed = _class_similarity(applied.join(even.select("pattern_id"), "pattern_id", "left_semi"), "pattern_id").join(even, "pattern_id")
    summed = summed.select("pattern_id", "pairs", T.round3(F.col("sum") / F.col("pairs")).alias("mean"), T.round3(F.col("least")).alias("least"), T.round3(F.col("most")).alias("most"))
    one_by_one = _pairs(applied.join(odd, "pattern_id", "left_semi"), "pattern_id", "ord").groupBy("pattern_id")
    got = summed.unionByName(one_by_one.agg(F.count("*").alias("pairs"), T.round3(F.avg(s)).alias("mean"), T.round3(F.min(s)).alias("least"), T.round3(F.max(s)).alias("most")))
    out = n.join(got, "pattern_id", "left").join(first, "pattern_id", "left").withColumn("strictness", F.coalesce("strictness", F.lit("medium")))
    out = out.withColumns({"pairs": F.coalesce("pairs", F.lit(0).cast("long")), "expected": benchmarks.expected(F.col("strictness"))})
    return out.withColumn("estimate", F.when(F.col("pairs") > 0, benchmark_estimate("strictness", "mean", "least", "most", benchmarks)))


def benchmark_estimate(strictness: str, mean: str, least: str, most: str, benchmarks: Benchmarks = Benchmarks()) -> Column:
    s, m = F.col(strictness), F.col(mean)
    delta = m - benchmarks.expected(s)
    outlier = (s != "low") & ((F.col(least) <= OUTLIER_LEAST) | (F.col(most) - F.col(least) >= OUTLIER_RANGE))
    return (
        F.when(m >= DUPLICATE_LIKE, "duplicate_like").when(m <= DIFFUSE, "diffuse").when(outlier, "looser_than_expected")
        .when(delta > TOLERANCE, "tighter_than_expected").when(delta < -TOLERANCE, "looser_than_expected").otherwise("near_expected")
    )


def profiles(applied: DataFrame, definitions: DataFrame, benchmarks: Benchmarks = Benchmarks()) -> DataFrame:
    """(pattern_id, strictness, expected, required, optional, discriminators): term sets of each definition with two applications or more.

    A term is required if it is in 0.67 of the applications (0.50 for medium), rounded up. Patterns without a
    required or a telling term have no profile.
    """
    n = applied.groupBy("pattern_id").agg(F.count("*").alias("n")).where("n >= 2")
    counts = applied.select("pattern_id", F.explode("terms").alias("term")).where(~T.is_noise(F.col("term"))).groupBy("pattern_id", "term").agg(F.count("*").alias("c"))
    rows = definitions.select("pattern_id", "strictness").distinct().join(n, "pattern_id").join(counts, "pattern_id")
    ratio = F.when(F.col("strictness") == "medium", 0.50).otherwise(0.67)
    out = rows.groupBy("pattern_id", "strictness").agg(
        F.array_sort(F.collect_set(F.when(F.col("c") >= F.ceil(F.col("n") * ratio), F.col("term")))).alias("required"),
        F.array_sort(F.collect_set("term")).alias("optional"),
        F.array_sort(F.collect_set(F.when(T.is_discriminator(F.col("term")), F.col("term")))).alias("discriminators"),
    )
    return out.where((F.size("required") > 0) & (F.size("discriminators") > 0)).withColumn("expected", benchmarks.expected(F.col("strictness")))


def scored(pairs: DataFrame) -> DataFrame:
    """pairs of a profile and an item's terms, with recall, telling_recall, score and passes."""
    hit, tell = F.size(F.array_intersect("required", "terms")), F.size(F.array_intersect("discriminators", "terms"))
    rows = pairs.withColumns({"recall": hit / F.size("required"), "told": tell, "telling_recall": tell / F.size("discriminators")})
    rows = rows.withColumn("score", T.round3(RECALL * F.col("recall") + SIMILAR * T.jaccard(F.col("optional"), F.col("terms")) + TELLING * F.col("telling_recall")))
    least = lambda v: F.col("score") >= F.greatest(F.col("expected"), F.lit(v))
    high = (F.col("recall") >= 0.70) & (F.col("told") >= 1) & least(0.58)
    medium = (F.col("recall") >= 0.50) & (F.col("told") >= 1) & least(0.48)
    low = (F.col("told") >= 2) & (F.col("telling_recall") >= 0.50) & least(0.36)
    return rows.withColumn("passes", F.when(F.col("strictness") == "high", high).when(F.col("strictness") == "low", low).otherwise(medium))


def missing_applications(profile: DataFrame, items: DataFrame, annotated: DataFrame, top: int = TOP) -> DataFrame:
    """The best candidates among items that aren't annotated for the pattern and not in a file with a file-scoped application.

    ``annotated`` has pattern_id, path and line (null for a file-scoped one). Only items that share a telling term
    with a profile can pass, so they meet by an equi-join on those terms.
    """
    of = annotated.where("line IS NOT NULL").select("pattern_id", "path", "line").distinct()
    whole = annotated.where("line IS NULL").select("path").distinct()
    free = items.join(whole, "path", "left_anti")
    tells = profile.select("pattern_id", "strictness", F.explode("discriminators").alias("term"))
    has = free.select("path", "line", "name", F.explode("terms").alias("term"))
    met = tells.join(has, "term").select("pattern_id", "strictness", "path", "line", "name").distinct().join(of, ["pattern_id", "path", "line"], "left_anti")
    rows = scored(met.join(profile, ["pattern_id", "strictness"]).join(free.select("path", "line", "name", "terms"), ["path", "line", "name"])).where("passes")
    rows = rows.orderBy(F.desc("score"), "pattern_id", T.path_key(F.col("path")), "line").limit(top)
    return rows.select(
        "pattern_id", "strictness", F.when((F.col("strictness") == "high") & (F.col("score") >= 0.70), "probable").otherwise("possible").alias("confidence"), "score", "name", "path", "line",
        F.slice(F.array_sort(F.array_intersect("required", "terms")), 1, TERMS).alias("matched"), F.slice(F.array_sort(F.array_except("required", "terms")), 1, TERMS).alias("missing"),
    )


def signature(terms: Column) -> Column:
    """The first ten telling-or-not terms of an item without noise, sizes and names, joined; null for fewer than two, or two telling ones."""
    kept = F.array_sort(F.filter(terms, lambda t: ~T.is_noise(t) & ~t.startswith("size:") & ~t.startswith("name:")))
    return F.when(F.size(F.filter(kept, T.is_discriminator)) >= 2, F.array_join(F.slice(kept, 1, SIGNATURE_TERMS), "|"))


def clusters(items: DataFrame, targets: DataFrame, annotated: DataFrame, top: int = TOP) -> DataFrame:
    """Groups of like items without an annotation that hold a target; thin delegates are left out.

    ``items`` have features, path, line and ord (their order); ``targets`` path and line.
    """
    place = annotated.where("line IS NOT NULL").select("path", "line").distinct()
    whole = annotated.where("line IS NULL").select("path").distinct()
    rows = items.where(F.col("nodes") >= CLUSTER_NODES).join(place, ["path", "line"], "left_anti").join(whole, "path", "left_anti")
    rows = rows.withColumn("signature", signature(F.col("terms"))).where("signature IS NOT NULL")
    rows = rows.join(targets.select("path", "line", F.lit(True).alias("target")).distinct(), ["path", "line"], "left")
    groups = rows.groupBy("signature").agg(
        F.count("*").alias("item_count"), F.bool_or(F.coalesce("target", F.lit(False))).alias("target"), F.countDistinct("name").alias("names"),
        F.max("nodes").alias("largest"), F.max(F.size("invocations")).alias("invoked"), F.min_by(F.col("path"), "ord").alias("first_path"),
    ).where("item_count >= 2 AND target")
    rows = rows.join(groups.select("signature"), "signature", "left_semi")
    scores = _pairs(rows, "signature", "ord").groupBy("signature").agg(T.round3(F.avg("similarity")).alias("score"))
    shared = rows.select("signature", F.explode("terms").alias("term")).where(~T.is_noise(F.col("term"))).groupBy("signature", "term").agg(F.count("*").alias("c"))
    shared = shared.join(groups.select("signature", "item_count"), "signature").where("c = item_count").groupBy("signature").agg(F.array_sort(F.collect_list("term")).alias("shared"))
    out = groups.join(scores, "signature").join(shared, "signature", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<string>")))
    out = out.where(~_thin(F.col("shared"), F.col("largest"), F.col("invoked"))).withColumn("shared", F.slice("shared", 1, TERMS))
    few = ((F.col("item_count") <= 4) & (F.size("shared") <= 5)) | ((F.col("item_count") >= 5) & (F.size("shared") <= 4))
    extract = (F.col("score") >= 0.86) | ((F.col("score") >= 0.82) & ((F.col("names") == 1) | few))
    out = out.select(
        "signature", "item_count", "score", F.when(F.col("score") >= 0.62, "high").when(F.col("score") >= 0.36, "medium").otherwise("low").alias("suggested_strictness"),
        F.when(extract, "extraction_candidate").otherwise("possible_pattern").alias("interpretation"), "shared", "first_path",
    ).orderBy(F.desc("item_count"), F.desc("score"), T.path_key(F.col("first_path")), "signature").limit(top)
    nth = F.row_number().over(Window.partitionBy("signature").orderBy("ord"))
    members = rows.join(F.broadcast(out.select("signature")), "signature", "left_semi").withColumn("__nth", nth).where(F.col("__nth") <= ITEMS)
    members = members.groupBy("signature").agg(F.array_sort(F.collect_list(F.struct("ord", "path", "line", "name"))).alias("items"))
    return out.join(members, "signature").drop("first_path")


def _thin(shared: Column, largest: Column, invoked: Column) -> Column:
    """Items that share little but one call: small ones that hand over to it."""
    moves = F.exists(shared, lambda t: t.startswith("control:") | t.startswith("flow:") | (t == "shape:closure"))
    calls = F.filter(shared, lambda t: t.startswith("call:"))
    plain = F.filter(calls, lambda t: ~t.contains("::"))
    return ~moves & (F.size(calls) <= 4) & (F.size(plain) == 1) & (largest <= 30) & (invoked == 0)
