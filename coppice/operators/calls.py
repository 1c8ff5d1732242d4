"""From calls and imports to edges: candidates in order of preference, of which the first that is unique counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = "array<array<string>>"


def prefixes(module: Column, container: Column, qualifier: Column, aliases: Sequence[str] = ()) -> Column:
    """Where a Rust qualifier may lead, best first, as arrays of segments."""
    segs = F.filter(F.split(qualifier, "::"), lambda s: s != "")
    first, n = F.get(segs, 0), F.size(segs)
    rest = F.slice(segs, 2, F.greatest(n - 1, F.lit(0)))
    one = lambda *parts: F.array(F.concat(*parts))
    none = F.array().cast(_NONE)
    supers = F.aggregate(segs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, s: F.struct((a["n"] + F.when(a["on"] & (s == "super"), 1).otherwise(0)).alias("n"), (a["on"] & (s == "super")).alias("on")))["n"]
    above = F.slice(module, F.lit(1), F.greatest(F.size(module) - supers, F.lit(0)))
    below = F.slice(segs, supers + 1, F.greatest(n - supers, F.lit(0)))
    every = F.transform(F.reverse(F.sequence(F.lit(0), F.size(module))), lambda k: F.concat(F.slice(module, F.lit(1), k), segs))
    root = first == "crate" if not aliases else (first == "crate") | first.isin(*aliases)
    return (
        F.when((n == 0) | qualifier.isNull(), none).when(root, F.array(rest))
        .when(first == "self", F.when((n == 1) & (F.size(container) > 0), one(module, container)).otherwise(one(module, rest)))
        .when(first == "Self", F.when(F.size(container) > 0, one(module, container, rest)).otherwise(none))
        .when(first == "super", F.when(supers > F.size(module), none).otherwise(one(above, below))).otherwise(every)
    )


def _unique(items: DataFrame, *keys: str) -> DataFrame:
    """Keys that one item has alone, and its id; names count within their language."""
    return items.groupBy("lang", *keys).agg(F.count("*").alias("__n"), F.min("stable_id").alias("callee")).where("__n = 1").drop("__n")


def resolved_calls(items: DataFrame, imports: DataFrame, aliases: Sequence[str] = ()) -> DataFrame:
    """(caller, callee) of the calls that lead to one item.

    Rust: qualified candidates (unique anywhere, then in the file), the name in the file, the name anywhere, then
    what the name was imported as. Go and TypeScript: the name in the file, then anywhere; before both, in Go, the
    function of the imported package that the qualifier names.
    """
    c = items.select("lang", "path", F.col("stable_id").alias("caller"), "module_path", "container_path", F.posexplode("calls").alias("no", "call"))
    c = c.select("lang", "path", "caller", "no", "module_path", "container_path", "call.name", "call.qualifier")
    ids = ["lang", "path", "caller", "no"]

    def qualified(rows: DataFrame, rank: int) -> DataFrame:
        """rows with qualifier and name -> candidates that are unique."""
        q = rows.select(*ids, *(["which"] if "which" in rows.columns else [F.lit(0).alias("which")]), F.posexplode(F.array_distinct(prefixes(F.col("module_path"), F.col("container_path"), F.col("qualifier"), aliases))).alias("k", "p"), "name")
        q = q.select(*ids, "which", "k", F.array_join(F.concat("p", F.array("name")), "::").alias("qualified_name"))
        found = q.join(_unique(items, "qualified_name"), ["lang", "qualified_name"]).withColumn("own", F.lit(0))
        near = q.join(_unique(items, "path", "qualified_name"), ["lang", "path", "qualified_name"]).withColumn("own", F.lit(1))
        return found.unionByName(near).select("caller", "no", F.struct(F.lit(rank).alias("r"), F.col("which"), F.col("k"), F.col("own")).alias("priority"), "callee")

    plain = lambda df, rank: df.select("caller", "no", F.struct(F.lit(rank).alias("r"), F.lit(0).alias("which"), F.lit(0).alias("k"), F.lit(0).alias("own")).alias("priority"), "callee")
    rust = c.where("lang = 'rust'")
    out = qualified(rust.where("qualifier IS NOT NULL"), 1)
    out = out.unionByName(plain(c.join(_unique(items, "path", "name"), ["lang", "path", "name"]), 2)).unionByName(plain(c.join(_unique(items, "name"), ["lang", "name"]), 3))
    named = F.coalesce("alias", F.element_at(F.split("target", "::"), -1))
    brought = imports.where(F.col("path").endswith(".rs")).select("path", named.alias("name"), "target").distinct()
    brought = brought.groupBy("path", "name").agg(F.array_sort(F.collect_list("target")).alias("targets"))
    via = rust.join(brought, ["path", "name"]).select(*ids, "module_path", "container_path", F.posexplode("targets").alias("which", "target")).where(F.col("target").contains("::"))
    tail = F.element_at(F.split("target", "::"), -1)
    via = via.select(*ids, "module_path", "container_path", "which", tail.alias("name"), F.array_join(F.slice(F.split("target", "::"), F.lit(1), F.size(F.split("target", "::")) - 1), "::").alias("qualifier"))
    out = out.unionByName(qualified(via, 4)).unionByName(plain(package_calls(c.where("lang = 'go'"), items, imports), 0))
    return out.groupBy("caller", "no").agg(F.min_by("callee", "priority").alias("callee")).select("caller", "callee").distinct()


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def package_calls(calls: DataFrame, items: DataFrame, imports: DataFrame) -> DataFrame:
    """Go calls through an import: the one function of that name in the folder that the import path ends in."""
    alias = F.coalesce("alias", F.element_at(F.split("target", "/"), -1))
    known = imports.where(F.col("path").endswith(".go")).select("path", alias.alias("qualifier"), "target").where("qualifier NOT IN ('_', '.')").distinct()
    ends = known.select("path", "qualifier", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("target", "/"))), lambda k: F.array_join(F.slice(F.split("target", "/"), k, F.size(F.split("target", "/"))), "/"))).alias("folder"))
    made = items.where("lang = 'go' AND kind = 'function' AND NOT is_test").select(_folder(F.col("path")).alias("folder"), "name", F.col("stable_id").alias("callee"))
    hit = calls.join(ends, ["path", "qualifier"]).join(made, ["folder", "name"])
    one = hit.groupBy("caller", "no").agg(F.countDistinct("callee").alias("__n"), F.min("callee").alias("callee")).where("__n = 1")
    return one.select("caller", "no", "callee")


def invoked(items: DataFrame, package: str | None = None) -> DataFrame:
    """(caller, callee) from items that run one of the package's binaries to that binary's main."""
    run = items.select(F.col("stable_id").alias("caller"), F.explode("invocations").alias("binary"))
    binary = F.when(F.col("path").rlike(r"(^|/)src/bin/[^/]+\.rs$"), F.regexp_extract("path", r"src/bin/([^/]+)\.rs$", 1)).when(F.col("path").rlike(r"(^|/)src/bin/[^/]+/main\.rs$"), F.regexp_extract("path", r"src/bin/([^/]+)/main\.rs$", 1))
    if package:
        binary = binary.when(F.col("path").rlike(r"(^|/)src/main\.rs$"), F.lit(package))
    main = items.where("lang = 'rust' AND name = 'main' AND kind = 'function'").select(binary.alias("binary"), F.col("stable_id").alias("callee"))
    return run.join(main.where("binary IS NOT NULL"), "binary").select("caller", "callee").distinct()


def edges(items: DataFrame, imports: DataFrame, aliases: Sequence[str] = (), package: str | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """Parsed edges and, if given, those that other tools found."""
    out = resolved_calls(items, imports, aliases).unionByName(invoked(items, package))
    return (out if semantic is None else out.unionByName(semantic.select("caller", "callee"))).distinct()


def import_files(imports: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """(path, target, file): the files that an import leads to, null for none; ``internal`` if it could only be inside.

    Rust: crate, self and super, longest prefix first, x.rs before x/mod.rs; crate begins at ``root``. Go: the files of the
    longest folder that the import path ends in. TypeScript: relative paths as .ts, .tsx and their index.
    """
    folder, target = _folder(F.col("path")), F.col("target")
    segs = F.split(target, "::")
    rest = F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0)))
    supers = F.aggregate(rest, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, s: F.struct((a["n"] + F.when(a["on"] & (s == "super"), 1).otherwise(0)).alias("n"), (a["on"] & (s == "super")).alias("on")))["n"]
    dirs = F.filter(F.split(folder, "/"), lambda s: s != "")
    up = F.array_join(F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - supers, F.lit(0))), "/")
    base = F.when(F.get(segs, 0) == "crate", F.lit(root)).when(F.get(segs, 0) == "self", folder).when(F.get(segs, 0) == "super", up)
    tail = F.when(F.get(segs, 0) == "super", F.slice(rest, supers + 1, F.greatest(F.size(rest) - supers, F.lit(0)))).otherwise(rest)
    lead = F.when(base == "", F.lit("")).otherwise(F.concat(base, F.lit("/")))
    stem = lambda k: F.concat(lead, F.array_join(F.slice(tail, F.lit(1), k), "/"))
    rust = F.when(F.size(tail) > 0, F.flatten(F.transform(F.reverse(F.sequence(F.lit(1), F.size(tail))), lambda k: F.array(F.concat(stem(k), F.lit(".rs")), F.concat(stem(k), F.lit("/mod.rs"))))))
    near = _normal(F.concat(F.when(folder == "", F.lit("")).otherwise(F.concat(folder, F.lit("/"))), target))
    script = F.when(target.startswith("."), F.transform(F.array(*map(F.lit, (".ts", ".tsx", "/index.ts", "/index.tsx"))), lambda e: F.concat(near, e)))
    ext = F.substring_index("path", ".", -1)
    one = imports.select("path", "target").distinct()
    cand = one.select("path", "target", F.posexplode_outer(F.when((ext == "rs") & base.isNotNull(), rust).when(ext.isin("ts", "tsx"), script)).alias("k", "file"))
    there = files.select(F.col("path").alias("file")).distinct()
    best = cand.join(there, "file").groupBy("path", "target").agg(F.min_by("file", "k").alias("file"))
    parts = F.split("target", "/")
    ends = one.where(F.col("path").endswith(".go")).select("path", "target", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("k", "folder"))
    go = there.where(F.col("file").endswith(".go") & ~F.col("file").endswith("_test.go")).select("file", _folder(F.col("file")).alias("folder"))
    hits = ends.join(go, "folder")
    first = hits.groupBy("path", "target").agg(F.min("k").alias("k"))
    packages = hits.join(first, ["path", "target", "k"]).select("path", "target", "file")
    inside = (ext == "rs") & F.get(segs, 0).isin("crate", "self", "super") | target.startswith(".")
    return one.join(best.unionByName(packages), ["path", "target"], "left").select("path", "target", "file", inside.alias("internal"))


def _normal(path: Column) -> Column:
    """The path without . and .. parts."""
    out = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda a, s: F.when((s == ".") | (s == ""), a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.array_join(out, "/")
