"""The views over small inlined source trees, with the rows worked out by hand as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query
from .engine import Repository

DEMO = {
    "specs.rs": """/**
@group DEMO
All of it.

@spec DEMO.LIVE
Live child.

@spec DEMO.NEXT @planned 0.3.0
Planned child.

@spec DEMO.OLD
@deprecated 0.6.0
Old child.

@spec DEMO.BARE
Child without
support.
*/
""",
    "checks.rs": """// @verifies DEMO.LIVE
fn checks_live() {}

// @verifies DEMO.OLD
fn checks_old() {
    run();
}

// @verifies DEMO.GONE
fn checks_gone() {}
""",
    "whole.rs": "// @fileverifies DEMO.NEXT\nfn any() {}\n\n",
    "review.md": """### `@spec DEMO.REVIEWED`
Reviewed by hand.

### `@fileattests DEMO.REVIEWED`
artifact: docs/review.md
owner: qa
last_reviewed: 2026-04-16
review_interval_days: 30

Notes follow.
""",
    "attest.rs": "// @attests DEMO.LIVE\n// artifact: log.txt\n// owner: qa\n// last_reviewed: 04-12-2026\n",
    "arch.md": """# `@area APP`
The program.

## `@module APP.CORE`
Core part.

## `@module APP.IO.DISK`
Disk part.

## `@module APP.LATER @planned`
Later part.

# `@pattern SHAPE.LOOP`
`@strictness high`
Loops over rows.

```
# @module APP.FENCED
```
""",
    "core.rs": """// @fileimplements APP.CORE
fn a() {}

// @applies SHAPE.LOOP
fn b() {
    for x in y {}
}

// @applies SHAPE.NONE
fn c() {}
""",
    "disk.rs": "// @implements APP.IO.DISK\nfn open() {}\n\n// @implements APP\nfn close() {}\n",
}

#: Faults of every kind that the lint knows.
FAULTS = {
    "a.rs": """/**
@spec A
First.
@spec A
Again.
@group G @planned
@spec A.B.C
Deep.
@planned
*/
""",
    "b.rs": "// @verifies G2\n// @verifies A\nfn f() {}\n\n// @verifies\nfn g() {}\n\n// @verifies A B\nfn h() {}\n\n// @verifies A\n",
    "c.rs": "/**\n@group G\nGroup.\n*/\n\n// @verifies G\nfn f() {}\n",
    "d.rs": "// @attests A\n// artifact x\n// owner:\n// owner: qa\n// colour: red\n// last_reviewed: 2026-02-30\n// review_interval_days: 0\n",
    "e.rs": "// @module M\n// Text.\n// @module M\n// @pattern P\n// @pattern P\n",
    "f.rs": "// @fileimplements M\n// @fileimplements M\nfn f() {}\n",
    "g.md": "# @module N.X\nText.\n\n`@applies P`\n",
}

LEGACY = {
    "specs.rs": "/**\n@spec DEMO\nDemo root.\n\n@spec DEMO.PLANNED\nPlanned child.\n\n@planned\n\n@spec DEMO.OLD\nOld.\n@deprecated 0.6.0\nnot part of it\n*/\n",
    "bad.rs": "// @planned\n// @group G\n// Text.\n// @deprecated\n",
}


def files(spark: SparkSession, tree: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(p, p.rsplit(".", 1)[-1], "markdown" if p.endswith(".md") else "source", t) for p, t in tree.items()], "path string, ext string, kind string, text string")


_KEPT: dict[tuple, Repository] = {}


def repository(spark: SparkSession, tree: dict[str, str], dialect: int = 1, **options) -> Repository:
    """One repository for each tree and session, so its files are parsed once for all queries."""
    key = (spark.sparkContext.applicationId, *tree, dialect, str(options))
    if key not in _KEPT:
        _KEPT[key] = Repository(files(spark, tree), dialect, **options)
    return _KEPT[key]


def values(columns: str, *rows: tuple) -> str:
    """SQL of the rows; columns as ``name type``."""
    show = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    named = [c.split() for c in columns.split(", ")]
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in named)
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({', '.join(n for n, _ in named)})"


@query(values("id VARCHAR, kind VARCHAR, parent_id VARCHAR, path VARCHAR, line INTEGER", ("DEMO", "group", None, "specs.rs", 2), ("DEMO.BARE", "spec", "DEMO", "specs.rs", 15)))
def specs_unverified(spark, sf):
    return repository(spark, DEMO).specs(unverified=True).select("id", "kind", "parent_id", "path", "line")


@query(values(
    "id VARCHAR, kind VARCHAR, text VARCHAR, planned BOOLEAN, planned_release VARCHAR, deprecated BOOLEAN, deprecated_release VARCHAR, parent_id VARCHAR, verifies BIGINT, attests BIGINT, unverified BOOLEAN",
    ("DEMO", "group", "All of it.", False, None, False, None, None, 0, 0, False),
    ("DEMO.LIVE", "spec", "Live child.", False, None, False, None, "DEMO", 1, 0, False),
    ("DEMO.NEXT", "spec", "Planned child.", True, "0.3.0", False, None, "DEMO", 1, 0, False),
    ("DEMO.OLD", "spec", "Old child.", False, None, True, "0.6.0", "DEMO", 1, 0, False),
    ("DEMO.BARE", "spec", "Child without support.", False, None, False, None, "DEMO", 0, 0, True),
    ("DEMO.REVIEWED", "spec", "Reviewed by hand.", False, None, False, None, "DEMO", 0, 1, False),
))
def specs_view(spark, sf):
    return repository(spark, DEMO).specs().select("id", "kind", "text", "planned", "planned_release", "deprecated", "deprecated_release", "parent_id", "verifies", "attests", "unverified")


@query(values("id VARCHAR, parent_id VARCHAR", ("DEMO", None), ("DEMO.NEXT", "DEMO")))
def specs_planned(spark, sf):
    return repository(spark, DEMO).specs("planned").select("id", "parent_id")


@query(values("id VARCHAR", ("DEMO.OLD",)))
def specs_scoped(spark, sf):
    return repository(spark, DEMO).specs("current", scope="DEMO.OLD").select("id")


@query(values(
    "total_specs BIGINT, planned_specs BIGINT, deprecated_specs BIGINT, unverified_specs BIGINT, verified_specs BIGINT, attested_specs BIGINT, specs_with_both_supports BIGINT, verifies BIGINT, item_scoped_verifies BIGINT, file_scoped_verifies BIGINT, unattached_verifies BIGINT, attests BIGINT, block_attests BIGINT, file_attests BIGINT",
    (5, 1, 1, 1, 3, 1, 0, 3, 2, 1, 0, 1, 0, 1)))
def specs_metrics(spark, sf):
    return repository(spark, DEMO).spec_metrics()


@query(values("grouping VARCHAR, value VARCHAR, count BIGINT", ("file", "review.md", 1), ("file", "specs.rs", 4), ("top", "DEMO", 3)))
def specs_grouped(spark, sf):
    r = repository(spark, DEMO)
    return r.specs_by_file().select(F.lit("file").alias("grouping"), "value", "count").unionByName(r.current_specs_by_top_level_id().select(F.lit("top").alias("grouping"), "value", "count"))


FACTS = "fact VARCHAR, id VARCHAR, path VARCHAR, line INTEGER, body_line INTEGER, detail VARCHAR"


@query(values(
    FACTS,
    ("verifies", "DEMO.LIVE", "checks.rs", 1, 2, "fn checks_live() {}"), ("verifies", "DEMO.OLD", "checks.rs", 4, 5, "fn checks_old() {\n    run();\n}"), ("verifies", "DEMO.GONE", "checks.rs", 9, 10, "fn checks_gone() {}"),
    ("verifies", "DEMO.NEXT", "whole.rs", 1, None, "// @fileverifies DEMO.NEXT\nfn any() {}"),
    ("attests", "DEMO.REVIEWED", "review.md", 4, None, "docs/review.md qa 2026-04-16 30 file"),
    ("module", "APP", "arch.md", 1, None, "area false The program."), ("module", "APP.CORE", "arch.md", 4, None, "module false Core part."), ("module", "APP.IO.DISK", "arch.md", 7, None, "module false Disk part."),
    ("module", "APP.LATER", "arch.md", 10, None, "module true Later part."),
    ("implements", "APP.CORE", "core.rs", 1, None, "file"), ("implements", "APP.IO.DISK", "disk.rs", 1, 2, "fn open() {}"), ("implements", "APP", "disk.rs", 4, 5, "fn close() {}"),
    ("pattern", "SHAPE.LOOP", "arch.md", 13, None, "high Loops over rows."),
    ("applies", "SHAPE.LOOP", "core.rs", 4, 5, "fn b() {\n    for x in y {}\n}"), ("applies", "SHAPE.NONE", "core.rs", 9, 10, "fn c() {}"),
))
def annotation_parse(spark, sf):
    r = repository(spark, DEMO)
    none = F.lit(None).cast("int").alias("body_line")
    fact = lambda name, df, id, body, detail: df.select(F.lit(name).alias("fact"), F.col(id).alias("id"), "path", "line", body, detail.alias("detail"))
    return (
        fact("verifies", r.verifies, "spec_id", "body_line", F.col("body"))
        .unionByName(fact("attests", r.attests, "spec_id", none, F.concat_ws(" ", "artifact", "owner", "last_reviewed", "review_interval_days", "scope")))
        .unionByName(fact("module", r.module_decls, "id", none, F.concat_ws(" ", "kind", "planned", "text")))
        .unionByName(fact("implements", r.implements, "module_id", "body_line", F.when(F.col("body_line").isNull(), "file").otherwise(F.col("body"))))
        .unionByName(fact("pattern", r.pattern_decls, "pattern_id", none, F.concat_ws(" ", "strictness", "text")))
        .unionByName(fact("applies", r.applications, "pattern_id", "body_line", F.col("body")))
    )


LINT = "severity VARCHAR, path VARCHAR, line INTEGER, message VARCHAR"


@query(values(
    LINT,
    ("error", "checks.rs", 9, "unknown spec id `DEMO.GONE` referenced by @verifies"), ("error", "attest.rs", 4, "last_reviewed must use YYYY-MM-DD format"), ("error", "arch.md", 7, "missing intermediate module `APP.IO`"),
    ("error", "core.rs", 9, "unknown pattern id `SHAPE.NONE` referenced by @applies"), ("error", "disk.rs", 4, "@implements and @fileimplements may only reference @module ids; `APP` is declared as @area"),
))
def lint_report(spark, sf):
    return repository(spark, DEMO).lint()


@query(values(
    LINT,
    ("error", "a.rs", 4, "duplicate node id `A`; first declared as @spec at a.rs:2"), ("error", "a.rs", 7, "missing intermediate spec `A.B`"),
    ("error", "a.rs", 9, "@planned must be adjacent to exactly one owning @spec; the backward-looking form is not allowed in version 1"),
    ("error", "b.rs", 1, "unknown spec id `G2` referenced by @verifies"), ("error", "b.rs", 2, "annotation block may contain only one @verifies"),
    ("error", "b.rs", 5, "missing spec id after @verifies"), ("error", "b.rs", 8, "unexpected trailing content after @verifies spec id"), ("error", "b.rs", 11, "@verifies must attach to the next supported item"),
    ("error", "c.rs", 6, "cannot reference @group `G` from @verifies"),
    ("error", "d.rs", 2, "attestation metadata must use key: value format"), ("error", "d.rs", 1, "missing required attestation metadata `artifact`"), ("error", "d.rs", 3, "missing required attestation metadata `owner`"),
    ("error", "d.rs", 4, "duplicate attestation metadata `owner`; first declared on line 3"), ("error", "d.rs", 5, "unknown attestation metadata `colour`"),
    ("error", "d.rs", 6, "last_reviewed must use YYYY-MM-DD format"), ("error", "d.rs", 7, "review_interval_days must be a positive integer"),
    ("error", "e.rs", 3, "duplicate module id `M`; first declared on line 1"), ("error", "e.rs", 5, "duplicate pattern id `P`; first declared on line 4"),
    ("error", "f.rs", 2, "duplicate @fileimplements; first declared on line 1"), ("error", "g.md", 1, "missing intermediate module `N`"),
    ("error", "g.md", 1, "current module `N.X` has no direct @implements or @fileimplements attachment"), ("error", "g.md", 4, "@applies and @fileapplies must attach to source code, not markdown declarations"),
))
def lint_faults(spark, sf):
    return repository(spark, FAULTS).lint()


@query(values("id VARCHAR, planned BOOLEAN, planned_release VARCHAR, deprecated BOOLEAN, deprecated_release VARCHAR, text VARCHAR", ("DEMO", False, None, False, None, "Demo root."), ("DEMO.PLANNED", True, None, False, None, "Planned child."), ("DEMO.OLD", False, None, True, "0.6.0", "Old."), ("G", False, None, False, None, "Text.")))
def legacy_specs(spark, sf):
    return repository(spark, LEGACY, 0).spec_decls.select("id", "planned", "planned_release", "deprecated", "deprecated_release", "text")


@query(values(LINT, ("error", "bad.rs", 1, "@planned must appear after a @spec in the same block"), ("error", "bad.rs", 4, "@deprecated may only apply to @spec, not @group")))
def legacy_lint(spark, sf):
    return repository(spark, LEGACY, 0).lint()


@query(values(
    "id VARCHAR, kind VARCHAR, parent_id VARCHAR, planned BOOLEAN, file_implements BIGINT, item_implements BIGINT, applications BIGINT, unimplemented BOOLEAN",
    ("APP", "area", None, False, 0, 1, 0, False), ("APP.CORE", "module", "APP", False, 1, 0, 2, False), ("APP.IO.DISK", "module", "APP", False, 0, 1, 0, False), ("APP.LATER", "module", "APP", True, 0, 0, 0, False),
))
def arch_view(spark, sf):
    return repository(spark, DEMO).modules().select("id", "kind", "parent_id", "planned", "file_implements", "item_implements", "applications", "unimplemented")


@query(values("name VARCHAR, count BIGINT", ("total_modules", 3), ("total_areas", 1), ("unimplemented_modules", 0), ("file_scoped_implements", 1), ("item_scoped_implements", 2), ("below APP", 3)))
def arch_metrics(spark, sf):
    r = repository(spark, DEMO)
    m = r.module_metrics()
    rows = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("count")) for c in m.columns])).alias("x")).select("x.*")
    return rows.unionByName(r.modules_by_area().select(F.concat(F.lit("below "), "value").alias("name"), "count"))


@query(values("id VARCHAR, defined BOOLEAN, strictness VARCHAR, applications BIGINT, modules BIGINT, parent_id VARCHAR", ("SHAPE.LOOP", True, "high", 1, 1, None), ("SHAPE.NONE", False, None, 1, 1, None)))
def patterns_view(spark, sf):
    return repository(spark, DEMO).patterns().select("id", "defined", "strictness", "applications", "modules", "parent_id")


@query(values("total_patterns BIGINT, total_applications BIGINT, modules_with_applications BIGINT", (1, 2, 1)))
def patterns_metrics(spark, sf):
    return repository(spark, DEMO).pattern_metrics()


@query(values(
    "section VARCHAR, name VARCHAR, count BIGINT", ("lint", "errors", 5), ("lint", "warnings", 0), ("specs", "total_specs", 5), ("specs", "planned_specs", 1), ("specs", "deprecated_specs", 1), ("specs", "unverified_specs", 1),
    ("arch", "total_modules", 3), ("arch", "total_areas", 1), ("arch", "unimplemented_modules", 0),
    ("health", "duplicate_items", 0), ("health", "unowned_items", 4),
))
def overview(spark, sf):
    return repository(spark, DEMO).overview()
