"""What tests and claims say about items: supports, evidence, categories, signals, ownership, coupling and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions import text as T
from coppice.sources.files import ignored
from coppice.sources.syntax import surfaces

from . import graph as G
from . import relational as R

STATES = ("current", "planned", "deprecated")


def ownership(implements: DataFrame) -> DataFrame:
    """(path, module_ids): the modules that own a file, whole or an item of it, sorted."""
    return implements.groupBy("path").agg(F.array_sort(F.collect_set("module_id")).alias("module_ids"))


def owned(implements: DataFrame, items: DataFrame) -> DataFrame:
    """Items with the module (module_id) that owns them: those inside an implemented item, or all of a file that a module implements whole.

    A whole file counts for its modules only where no item of it has an owner of its own.
    """
    scoped = implements.where("body_line IS NOT NULL").select("module_id", F.col("path").alias("__p"), F.col("body_line").alias("__lo"), (F.col("body_line") + T.owned_lines(F.col("body")) - 1).alias("__hi"))
    inside = items.join(scoped, (F.col("path") == F.col("__p")) & F.col("start_line").between(F.col("__lo"), F.col("__hi"))).drop("__p", "__lo", "__hi")
    whole = implements.where("body_line IS NULL").select("module_id", "path").distinct().join(scoped.select(F.col("__p").alias("path")).distinct(), "path", "left_anti")
    return inside.unionByName(items.join(whole, "path").select(*inside.columns))


def verified_items(verifies: DataFrame, items: DataFrame) -> DataFrame:
    """(spec_id, stable_id): the item that an item-scoped verify stands above, by path and lines: the first to begin within what it owns."""
    v = verifies.where("body_line IS NOT NULL").select("spec_id", F.col("path").alias("__p"), F.col("line").alias("__at"), F.col("body_line").alias("__lo"), (F.col("body_line") + T.owned_lines(F.col("body")) - 1).alias("__hi"))
    hit = v.join(items.select("path", "start_line", "stable_id"), (F.col("path") == F.col("__p")) & F.col("start_line").between(F.col("__lo"), F.col("__hi")))
    return hit.groupBy("spec_id", "path", "__at").agg(F.min_by("stable_id", "start_line").alias("stable_id")).select("spec_id", "stable_id")


def spec_states(specs: DataFrame) -> DataFrame:
    """(spec_id, state): of repeated declarations the last one counts; planned before deprecated before current."""
    state = F.when(F.col("planned"), "planned").when(F.col("deprecated"), "deprecated").otherwise("current")
    return specs.groupBy(F.col("id").alias("spec_id")).agg(F.max_by(state, "ord").alias("state"))


def supports(verifies: DataFrame, specs: DataFrame, items: DataFrame) -> DataFrame:
    """Tests as support roots: root, name, item_scoped, file_scoped and the claims of each state. References to unknown claims say nothing."""
    tests = items.where("is_test").select(F.col("stable_id").alias("root"), "name", "path")
    known = verifies.join(spec_states(specs), "spec_id")
    by_item = verified_items(known, items).join(spec_states(specs), "spec_id").select(F.col("stable_id").alias("root"), "spec_id", "state", F.lit(True).alias("of_item"))
    by_file = known.where("body_line IS NULL").select("path", "spec_id", "state").distinct().join(tests, "path").select("root", "spec_id", "state", F.lit(False).alias("of_item"))
    said = by_item.unionByName(by_file).groupBy("root").agg(
        F.bool_or("of_item").alias("item_scoped"), F.bool_or(~F.col("of_item")).alias("file_scoped"),
        *[F.array_sort(F.collect_set(F.when(F.col("state") == s, F.col("spec_id")))).alias(s) for s in STATES],
    )
    none, false = F.array().cast("array<string>"), F.lit(False)
    return tests.drop("path").join(said, "root", "left").select("root", "name", F.coalesce("item_scoped", false).alias("item_scoped"), F.coalesce("file_scoped", false).alias("file_scoped"), *[F.coalesce(s, none).alias(s) for s in STATES])


def evidence(edges: DataFrame, supports: DataFrame) -> DataFrame:
    """For each item that a test reaches: the tests with and without claims, the claims of each state, and the scopes."""
    reach = G.closure(edges, supports.select("root"))
    rows = reach.join(supports, "root")
    any_spec = F.size("current") + F.size("planned") + F.size("deprecated") > 0
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(s)))).alias(s) for s in STATES]
    return rows.groupBy(F.col("node").alias("stable_id")).agg(
        F.array_sort(F.collect_set(F.when(any_spec, F.col("name")))).alias("verifying_tests"), F.array_sort(F.collect_set(F.when(~any_spec, F.col("name")))).alias("unverified_tests"),
        *merged, F.bool_or("item_scoped").alias("item_scoped"), F.bool_or("file_scoped").alias("file_scoped"),
    )


def traced(items: DataFrame, edges: DataFrame, supports: DataFrame, owners: DataFrame, ignore_unexplained: Sequence[str] = (), mediated: DataFrame | None = None) -> DataFrame:
    """Items that aren't tests, with their evidence, category, and what their modules say.

    Category: the first of current, planned, deprecated, unverified_test, mediated, unexplained that holds.
    ``file_scoped_only`` is a seventh bucket that overlaps the six. ``hidden`` marks unexplained items of ignored
    paths: they stay among the analysed ones but are in no bucket. ``mediated`` has stable_id and reason.
    """
    none = F.array().cast("array<string>")
    rows = items.where("NOT is_test").join(evidence(edges, supports), "stable_id", "left").join(owners, "path", "left")
    if mediated is None:
        rows = rows.withColumn("reason", F.lit(None).cast("string"))
    else:
        rows = rows.join(mediated.groupBy("stable_id").agg(F.min("reason").alias("reason")), "stable_id", "left")
    sets = ("verifying_tests", "unverified_tests", *STATES, "module_ids")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in sets} | {c: F.coalesce(c, F.lit(False)) for c in ("item_scoped", "file_scoped")})
    some = lambda c: F.size(c) > 0
    category = R.waterfall((some("current"), "current"), (some("planned"), "planned"), (some("deprecated"), "deprecated"), (some("unverified_tests"), "unverified_test"), (F.col("reason").isNotNull(), "mediated"), otherwise="unexplained")
    rows = G.stored(rows.select(
        "stable_id", "path", F.col("start_line").alias("line"), "name", "kind", "public", T.is_review_surface(F.col("path"), F.col("public"), F.col("name"), F.col("kind")).alias("review_surface"), T.is_test_file(F.col("path")).alias("test_file"),
        *sets, "reason", category.alias("category"), (F.col("file_scoped") & ~F.col("item_scoped")).alias("file_scoped_only"),
    ))
    backed = rows.where(some("current")).select(F.explode("module_ids").alias("module_id")).distinct()
    of = rows.select("stable_id", F.explode("module_ids").alias("module_id")).join(backed, "module_id", "left_semi")
    connected = module_connected(edges, of, rows.where(some("current")).select("stable_id"))
    rows = rows.join(of.select("stable_id", F.lit(True).alias("module_backed")).distinct(), "stable_id", "left").join(connected.withColumn("module_connected", F.lit(True)), "stable_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("module_backed", "module_connected")})
    return rows.withColumn("hidden", (F.col("category") == "unexplained") & ignored(F.col("path"), ignore_unexplained))


def module_connected(edges: DataFrame, backed: DataFrame, supported: DataFrame) -> DataFrame:
    """(stable_id): items of backed modules (stable_id, module_id) that supported ones lead to, either way, by calls inside a shared module."""
    left = backed.select(F.col("stable_id").alias("caller"), "module_id")
    right = backed.select(F.col("stable_id").alias("callee"), "module_id")
    inside = edges.join(left, "caller").join(right, ["callee", "module_id"]).select("caller", "callee").distinct()
    seeds = supported.join(backed.select("stable_id").distinct(), "stable_id", "left_semi").select(F.col("stable_id").alias("node"))
    return G.reachable(G.undirected(inside), seeds).select(F.col("node").alias("stable_id"))


def buckets(traced: DataFrame) -> DataFrame:
    """(bucket, items): the six categories and the overlapping file_scoped_only, empty ones too."""
    names = ["current", "planned", "deprecated", "unverified_test", "mediated", "unexplained", "file_scoped_only"]
    shown = traced.where("NOT hidden").select(F.explode(F.array_compact(F.array("category", F.when(F.col("file_scoped_only"), F.lit("file_scoped_only"))))).alias("bucket"))
    every = traced.sparkSession.createDataFrame([(n,) for n in names], "bucket string")
    return every.join(shown.groupBy("bucket").agg(F.count("*").alias("items")), "bucket", "left").select("bucket", F.coalesce("items", F.lit(0).cast("long")).alias("items"))


def bucket_items(traced: DataFrame, bucket: str) -> DataFrame:
    """The items of one bucket in order of path (by component), line, name and kind."""
    keep = F.col("file_scoped_only") if bucket == "file_scoped_only" else F.col("category") == bucket
    return traced.where(keep & ~F.col("hidden")).orderBy(T.path_key(F.col("path")), "line", "name", F.when(F.col("kind") == "function", 0).otherwise(1))


def unexplained_counts(traced: DataFrame) -> DataFrame:
    """One row: the unexplained items and how many of them are of each kind that matters."""
    u, n = traced.where("category = 'unexplained' AND NOT hidden"), F.count_if
    owned = F.size("module_ids") > 0
    return u.agg(
        F.count("*").alias("unexplained_items"), n(F.col("review_surface")).alias("review_surface_items"), n(F.col("public")).alias("public_items"), n(~F.col("public")).alias("internal_items"), n(F.col("test_file")).alias("test_file_items"), n(owned).alias("module_owned_items"), n(F.col("module_backed")).alias("module_backed_items"),
        n(F.col("module_connected")).alias("module_connected_items"), n(F.col("module_backed") & ~F.col("module_connected")).alias("module_isolated_items"), n(~owned).alias("unowned_items"),
    )


def scoped_items(traced: DataFrame, target: str | None = None, symbol: str | None = None) -> DataFrame:
    """Items of a path or folder, and of a name: a filter on results, so what lies outside still counts as evidence."""
    rows = traced if target is None else traced.where(T.in_scope(F.col("path"), target, "/"))
    return rows if symbol is None else rows.where(F.col("name") == symbol)


def within(files: DataFrame, scope: str) -> DataFrame:
    """The corpus below a path: a filter on what is analysed at all."""
    return files.where(T.in_scope(F.col("path"), scope, "/"))


def signals(items: DataFrame, group: str) -> DataFrame:
    """Items of each group with their references inside it, from inside it and out of it, and whether a root reaches them.

    A call to a name that several items of the group have is a reference inside, but leads nowhere.
    """
    call = items.select(group, F.col("stable_id").alias("caller"), F.explode("calls").alias("call")).select(group, "caller", F.col("call.name").alias("name"))
    named = items.groupBy(group, "name").agg(F.countDistinct("stable_id").alias("n"), F.min("stable_id").alias("callee"))
    seen = call.join(named, [group, "name"], "left")
    out = seen.groupBy(group, F.col("caller").alias("stable_id")).agg(F.count("n").alias("internal_refs"), F.count_if(F.col("n").isNull()).alias("external_refs"))
    led = seen.where("n = 1")
    into = led.groupBy(group, F.col("callee").alias("stable_id")).agg(F.count("*").alias("inbound_refs"))
    key = lambda c: F.concat_ws("\0", group, c)
    roots = items.where("root_visible OR is_test OR (name = 'main' AND kind = 'function')").select(key("stable_id").alias("node"))
    reached = G.reachable(led.select(key("caller").alias("caller"), key("callee").alias("callee")), roots).withColumn("reached", F.lit(True))
    rows = items.join(out, [group, "stable_id"], "left").join(into, [group, "stable_id"], "left").withColumn("node", key("stable_id")).join(reached, "node", "left").drop("node")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("internal_refs", "external_refs", "inbound_refs")}
    return rows.withColumns(zero | {"reached": F.coalesce("reached", F.lit(False))}).withColumn("unreached", ~F.col("root_visible") & ~F.col("is_test") & ~F.col("reached"))


def signal_lists() -> dict[str, tuple[Column, list[Column]]]:
    """The eight lists over signals(): what is in each, and its order."""
    c, desc = F.col, F.desc
    return {
        "connected": (c("internal_refs") + c("inbound_refs") > 0, [desc(c("internal_refs") + c("inbound_refs")), desc("internal_refs"), c("name")]),
        "outbound_heavy": (c("external_refs") > c("internal_refs"), [desc(c("external_refs") - c("internal_refs")), desc("external_refs"), c("name")]),
        "isolated": ((c("internal_refs") == 0) & (c("inbound_refs") == 0) & (c("external_refs") > 0), [desc("external_refs"), c("name")]),
        "unreached": (c("unreached"), [c("name"), c("kind")]),
        "highest_complexity": ((c("cognitive") > 0) | (c("cyclomatic") > 1), [desc("cognitive"), desc("cyclomatic"), c("name")]),
        "parameter_heavy": (c("params") > 1, [desc("params"), desc("string_params"), c("name")]),
        "stringly_boundary": (c("public") & (c("string_params") > 0), [desc("string_params"), desc("params"), c("name")]),
        "panic_heavy": (c("panics") > 0, [desc("panics"), desc("cognitive"), c("name")]),
    }


def signal_list(signals: DataFrame, name: str) -> DataFrame:
    keep, order = signal_lists()[name]
    return signals.where(keep).orderBy(*order)


def duplicates(owned_items: DataFrame) -> DataFrame:
    """Items with the same shape, calls and invocations as others, sorted: module_id, path, name, kind, peer_count. Tests and slight items don't count."""
    c = F.col
    rows = owned_items.where(~c("is_test") & ~T.is_test_path(c("path")) & T.is_substantive(c("shape"), c("nodes"), c("calls"), c("invocations")))
    key = [F.array_join("shape", ">"), F.array_join(T.call_names(c("calls")), "|"), F.array_join("invocations", "|")]
    return R.duplicates(rows, [F.xxhash64(*key), F.xxhash64(F.lit(1), *key)]).select("module_id", "path", "name", "kind", "peer_count").orderBy(F.desc("peer_count"), "module_id", T.path_key(c("path")), "name")


def unowned(items: DataFrame, implements: DataFrame) -> DataFrame:
    """Items of files that no module implements, sorted."""
    return items.join(implements.select("path").distinct(), "path", "left_anti").select("path", "name", "kind").orderBy(T.path_key(F.col("path")), "name", "kind")


def module_coupling(modules: DataFrame, implements: DataFrame, resolved: DataFrame) -> DataFrame:
    """Fan-in, fan-out and instability of each module, with its distinct outer, ambiguous and unresolved targets.

    ``resolved`` is import_files(); a file belongs to a module if it alone, of all modules, implements it.
    """
    concrete = modules.where("kind = 'module'").select(F.col("id").alias("module_id")).distinct()
    own = implements.join(concrete, "module_id", "left_semi").select("module_id", "path").distinct()
    of = R.resolve_unique(own.withColumnRenamed("path", "file"), "file", "module_id").select("file", "resolution", "resolved")
    uses = own.join(resolved, "path")
    inner = uses.where("file IS NOT NULL").select("module_id", "file").distinct().join(of, "file", "left")
    counts = inner.groupBy("module_id").agg(F.count_if(F.col("resolution") == "ambiguous").alias("ambiguous"), F.count_if(F.col("resolution").isNull()).alias("unresolved"))
    outer = uses.where("file IS NULL AND NOT internal").groupBy("module_id").agg(F.countDistinct("target").alias("external"))
    pairs = inner.where("resolution = 'unique'").select(F.col("module_id").alias("src"), F.col("resolved").alias("dst"))
    out = R.coupling(concrete, pairs, "module_id", "src", "dst").join(counts, "module_id", "left").join(outer, "module_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("ambiguous", "unresolved", "external")})


def owned_texts(implements: DataFrame, files: DataFrame) -> DataFrame:
    """(module_id, path, text): implemented items, and whole files of which no item has an owner of its own."""
    item = implements.where("body_line IS NOT NULL").select("module_id", "path", F.col("body").alias("text"))
    scoped = item.select("path").distinct()
    whole = implements.where("body_line IS NULL").select("module_id", "path").distinct().join(scoped, "path", "left_anti").join(files.select("path", "text"), "path")
    return item.unionByName(whole)


def module_summary(owned_items: DataFrame, implements: DataFrame, files: DataFrame) -> DataFrame:
    """Per module: owned lines, public and internal items, complexity and quality. Parameters count for public functions, panics for all."""
    texts = owned_texts(implements, files)
    lines = texts.groupBy("module_id").agg(F.sum(T.owned_lines(F.col("text"))).alias("owned_lines"))
    shown = surfaces(texts, "module_id").groupBy("module_id").agg(F.sum("public_items").alias("public_items"), F.sum("internal_items").alias("internal_items"))
    when = lambda c: F.sum(F.when(F.col("public"), F.col(c)).otherwise(0))
    own = owned_items.where("NOT is_test").groupBy("module_id").agg(
        F.count("*").alias("functions"), F.sum("cyclomatic").alias("total_cyclomatic"), F.max("cyclomatic").alias("max_cyclomatic"),
        F.sum("cognitive").alias("total_cognitive"), F.max("cognitive").alias("max_cognitive"), when("params").alias("parameters"), when("bool_params").alias("bool_params"), when("string_params").alias("string_params"), F.sum("panics").alias("panic_sites"),
    )
    return lines.join(shown, "module_id", "full").join(own, "module_id", "full")


def architecture_metrics(summary: DataFrame) -> DataFrame:
    """One row over the visible modules: sums, and the largest of the largest."""
    most = ("max_cyclomatic", "max_cognitive")
    return summary.agg(*[(F.max if c in most else F.sum)(c).alias(c) for c in summary.columns if c != "module_id"])


def ranking(summary: DataFrame, value: str) -> DataFrame:
    """(value, count) of the modules that have any of it."""
    return summary.where(F.col(value) > 0).select(F.col("module_id").alias("value"), F.col(value).cast("long").alias("count")).orderBy("value")


def repo_metrics(traced: DataFrame, duplicates: DataFrame, unowned: DataFrame) -> DataFrame:
    """(metric, value, count): items of each bucket, duplicates and unowned items, in all (value null) and by file."""
    one = lambda df, name: df.agg(F.count("*").alias("count")).select(F.lit(name).alias("metric"), F.lit(None).cast("string").alias("value"), "count")
    by_file = lambda df, name: df.groupBy("path").agg(F.count("*").alias("count")).select(F.lit(name + "_by_file").alias("metric"), F.col("path").alias("value"), "count")
    u = traced.where("category = 'unexplained' AND NOT hidden")
    out = one(traced, "analyzed_items")
    for name, df in (("duplicate_items", duplicates), ("unowned_items", unowned), ("unexplained_items", u), ("unexplained_review_surface_items", u.where("review_surface"))):
        out = out.unionByName(one(df, name)).unionByName(by_file(df, name))
    for bucket in ("current", "mediated", "unverified_test"):
        out = out.unionByName(one(traced.where(F.col("category") == bucket), f"{bucket}_items"))
    return out


def unreached_by_name(items: DataFrame, group: str) -> DataFrame:
    """Items that no root of their group reaches by name: a call leads to a name, and the first item of a name goes on from there."""
    key = lambda c: F.concat_ws("\0", group, c)
    first = items.groupBy(group, "name").agg(F.min_by("calls", F.struct("path", "start_line")).alias("calls"))
    led = first.select(key("name").alias("caller"), F.explode("calls").alias("c"), group).select("caller", key("c.name").alias("callee"))
    known = items.select(key("name").alias("callee")).distinct()
    roots = items.where("root_visible OR is_test OR (name = 'main' AND kind = 'function')").select(key("name").alias("node"))
    reached = G.reachable(led.join(known, "callee", "left_semi"), roots)
    return items.where("NOT root_visible AND NOT is_test").withColumn("node", key("name")).join(reached, "node", "left_anti").drop("node")


def same_language(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Items of the languages that the targets are of."""
    return items.join(targets.select("lang").distinct(), "lang", "left_semi")
