"""Rules over paths, lines, names and spans as queries: over the test tables where they can be, else over small inlined rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.functions import text as T
from coppice.operators import health as H
from coppice.operators import relational as R
from coppice.sources.comments import comment_blocks
from coppice.sources.files import PROSE, SOURCE, ignored, vcs_ignored, vcs_rules

from .catalogue import _t, query
from .fixtures import DEMO, files, repository, values
from .health_fixtures import CALLS, IMPORTS, SIGNALS, TRACE, _traced

PATHS = ["src/a.rs", "src/gen/b.rs", "docs/n.md", "src/gen.rs", "x/target/c.go", "a/b/c.ts", "a/b/d.test.ts", ".env"]


def _paths(spark):
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


@query(values("path VARCHAR, ignored BOOLEAN", *zip(PATHS, [False, True, True, False, True, False, True, False], strict=True)))
def ignored_paths(spark, sf):
    return _paths(spark).select("path", ignored(F.col("path"), ["src/gen", " ", "*.md", "**/target/*", "a/b/{d,e}.test.t[st]"]).alias("ignored"))


@query(values("path VARCHAR, ignored BOOLEAN", *zip(PATHS, [False, True, False, False, True, True, False, False], strict=True)))
def vcs_ignored_paths(spark, sf):
    rules = vcs_rules("", "# all\ngen/\n/target\nx/*/\n*.ts\n") + vcs_rules("a/b", "!*.test.ts\n")
    return _paths(spark).select("path", vcs_ignored(F.col("path"), rules).alias("ignored"))


@query(values("path VARCHAR, kind VARCHAR", *zip(PATHS, ["source", "source", "markdown", "source", "source", "source", "source", None], strict=True)))
def file_kinds(spark, sf):
    ext = F.substring_index("path", ".", -1)
    return _paths(spark).select("path", F.when(ext.isin(*SOURCE), "source").when(ext.isin(*PROSE), "markdown").alias("kind"))


@query(values(
    "path VARCHAR, block_no INTEGER, line INTEGER, text VARCHAR, owned_line INTEGER, owned_body VARCHAR",
    ("a.sh", 0, 1, "", 4, "run\nmore"), ("a.sh", 0, 2, "@verifies A", 4, "run\nmore"), ("b.py", 0, 1, "@verifies A", 2, "def f():\n    pass"), ("c.go", 0, 2, "@spec B", 5, "func g() {\n}"), ("c.go", 0, 3, "Text */ here", 5, "func g() {\n}"),
    ("d.rs", 0, 4, "@spec D", None, None), ("d.rs", 0, 5, "open", None, None)))
def block_lines(spark, sf):
    tree = {
        "a.sh": "#!/bin/sh\n# @verifies A\n\nrun\nmore\n", "b.py": "# @verifies A\ndef f():\n    pass\n\nx = 1\n", "c.go": "package p\n// @spec B\n// Text */ here\n\nfunc g() {\n}\n", "d.rs": "//// @spec C\n\n\n/* @spec D\nopen", "e.rs": "// no tag\nfn x() {}\n"}
    return comment_blocks(files(spark, tree))


@query("SELECT p_partkey, CASE WHEN p_size * 2 <= 24 THEN 'small' WHEN p_size * 2 <= 80 THEN 'medium' ELSE 'large' END AS bucket FROM part")
def size_buckets(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", T.size_bucket(F.col("p_size") * 2).alias("bucket"))


@query("""WITH s AS (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents)
SELECT doc_id, CAST(greatest(len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END, 1) AS BIGINT) AS owned_lines FROM s""")
def owned_line_counts(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.owned_lines(F.coalesce("text", F.lit(""))).cast("long").alias("owned_lines"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS id, coalesce(split_part(url, '://', 2), '') AS path FROM pages)
SELECT page_id, id = 'example' OR starts_with(id, 'example.') AS in_id_scope, starts_with(path, split_part(path, '/', 1) || '/en/') OR path = split_part(path, '/', 1) || '/en' AS in_path_scope FROM h""")
def scope_prefixes(spark, sf):
    rows = _t(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("id"), F.coalesce(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("")).alias("path"))
    rest = F.array_join(F.slice(F.split("path", "/"), 2, 1 << 20), "/")
    return rows.select("page_id", T.in_scope(F.col("id"), "example").alias("in_id_scope"), T.in_scope(rest, "en", "/").alias("in_path_scope"))


@query(values("alias VARCHAR, target VARCHAR, name VARCHAR", (None, "a/b/c", "c"), ("x", "a/b", "x"), ("_", "side", None), (".", "dot", None), (None, "fmt", "fmt")))
def import_aliases(spark, sf):
    rows = spark.createDataFrame([(None, "a/b/c"), ("x", "a/b"), ("_", "side"), (".", "dot"), (None, "fmt")], "alias string, target string")
    return rows.select("alias", "target", T.import_alias(F.col("alias"), F.col("target")).alias("name"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS k, l_returnflag FROM lineitem),
r AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_suppkey DESC) AS k, l_returnflag FROM lineitem)
SELECT l_orderkey, l_returnflag, l_linenumber, l_suppkey AS matched FROM l JOIN r USING (l_orderkey, l_returnflag, k)""")
def kth_matches(spark, sf):
    x = _t(spark, sf, "lineitem")
    left = x.select("l_orderkey", "l_returnflag", "l_linenumber", F.col("l_linenumber").alias("ord"))
    right = x.select("l_orderkey", "l_returnflag", F.col("l_suppkey").alias("matched"), (-F.col("l_suppkey")).alias("ord"))
    return R.kth_match(left, right, ["l_orderkey", "l_returnflag"], F.col("ord")).select("l_orderkey", "l_returnflag", "l_linenumber", "matched")


@query(values(
    "metric VARCHAR, value VARCHAR, count BIGINT", ("analyzed_items", None, 8), ("duplicate_items", None, 0), ("unowned_items", None, 6), ("unowned_items_by_file", "src/loose.rs", 1), ("unowned_items_by_file", "tests/checks.rs", 4), ("unowned_items_by_file", "tests/whole.rs", 1),
    ("unexplained_items", None, 2), ("unexplained_items_by_file", "src/live.rs", 1), ("unexplained_items_by_file", "src/loose.rs", 1), ("unexplained_review_surface_items", None, 1), ("unexplained_review_surface_items_by_file", "src/loose.rs", 1),
    ("current_items", None, 3), ("mediated_items", None, 0), ("unverified_test_items", None, 1)))
def repo_metrics(spark, sf):
    r = repository(spark, TRACE)
    return H.repo_metrics(_traced(spark), r.duplicates(), r.unowned())


@query(values("name VARCHAR, start_line INTEGER", ("lost", 5)))
def unreached_by_name(spark, sf):
    return H.unreached_by_name(repository(spark, SIGNALS).owned_items(), "module_id").select("name", "start_line")


@query(values("path VARCHAR", ("src/live.rs",), ("src/loose.rs",)))
def corpus_within(spark, sf):
    return H.within(files(spark, TRACE), "src").select("path")


@query(values("lang VARCHAR, items BIGINT", ("go", 4)))
def same_language_items(spark, sf):
    items = repository(spark, CALLS).items
    return H.same_language(items, items.where("path = 'lib/do.go'")).groupBy("lang").agg(F.count("*").alias("items"))


@query(values("id VARCHAR, kind VARCHAR", ("APP.IO.DISK", "module")))
def modules_scoped(spark, sf):
    return repository(spark, DEMO).modules("current", scope="APP.IO.DISK").select("id", "kind")


@query(values("key VARCHAR, resolution VARCHAR", ("x.rs", "unique"), ("y/mod.rs", "unique"), ("y/part.rs", "unique"), ("z.rs", "ambiguous")))
def file_modules(spark, sf):
    own = repository(spark, IMPORTS).implements.select(F.col("path").alias("key"), "module_id")
    return R.resolve_unique(own, "key", "module_id").select("key", "resolution")


@query(values("stable_id VARCHAR, module_id VARCHAR", *[(f"src/live.rs:live::{n}:{k}", "APP.CORE") for k, n in enumerate(["live_impl", "planned_impl", "deprecated_impl", "unverified_impl", "orphan_impl", "shared", "file_only"], 2)]))
def owned_code(spark, sf):
    return repository(spark, TRACE).owned_items().select("stable_id", "module_id")
