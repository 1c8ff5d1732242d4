"""The views over a repository: claims, architecture, patterns, lint and overview.

A Repository begins with a table of files (path, kind, text); each file is parsed once, into stored tables that all
views read. Trees are flat: a row a node
with its nearest visible parent. Record order, which decides first declarations, is a struct ``ord`` of phase, path
components and line: source before prose for claims, prose before source for architecture.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions import annotations as A
from coppice.functions import text as T
from coppice.operators import calls as C
from coppice.operators import health as H
from coppice.operators import patterns as P
from coppice.operators import relational as R
from coppice.sources import syntax
from coppice.sources.comments import comment_blocks
from coppice.sources.prose import prose_sections
from coppice.sources.stored import written

#: Messages of the lint.
DUPLICATE_SPEC = "duplicate node id `{}`; first declared as @{} at {}:{}"
DUPLICATE_MODULE = "duplicate module id `{}`; first declared on line {}"
DUPLICATE_PATTERN = "duplicate pattern id `{}`; first declared on line {}"
DUPLICATE_ITEM = "duplicate @implements for attached item starting on line {}; first declared on line {}"
DUPLICATE_FILE = "duplicate @fileimplements; first declared on line {}"
MISSING_SPEC = "missing intermediate spec `{}`"
MISSING_MODULE = "missing intermediate module `{}`"
UNKNOWN_SPEC = "unknown spec id `{}` referenced by @{}"
UNKNOWN_MODULE = "unknown module id `{}` referenced by @implements or @fileimplements"
UNKNOWN_PATTERN = "unknown pattern id `{}` referenced by @applies"
GROUP = "cannot reference @group `{}` from @{}"
AREA = "@implements and @fileimplements may only reference @module ids; `{}` is declared as @area"
UNATTACHED = "current module `{}` has no direct @implements or @fileimplements attachment"


def said(template: str, *values: Column) -> Column:
    """A message with the values in place of its {}."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, p in zip(values, parts[1:], strict=True):
        out += [v.cast("string"), F.lit(p)]
    return F.concat(*out)


def _ordered(rows: DataFrame, prose_first: bool) -> DataFrame:
    prose = F.col("path").endswith(".md")
    return rows.withColumn("ord", F.struct((~prose if prose_first else prose).alias("phase"), T.path_key(F.col("path")).alias("parts"), "line"))


def tree(declared: DataFrame, direct: Column) -> DataFrame:
    """The rows of ``declared`` (id, ...) that are directly visible or above one, each with its nearest visible parent_id."""
    shown = declared.where(direct).select("id")
    above = shown.select(F.explode(T.ancestors(F.col("id"))).alias("id")).distinct()
    visible = declared.join(shown.unionByName(above).distinct(), "id", "left_semi")
    return visible.join(R.nearest_visible(visible, visible.select("id"), "id"), "id", "left")


def scoped(rows: DataFrame, scope: str | None) -> DataFrame:
    """The scope's own row and all below it, if the scope itself is there."""
    if scope is None:
        return rows
    return rows.where(T.in_scope(F.col("id"), scope)).join(rows.where(F.col("id") == scope).select(F.lit(1).alias("__there")).limit(1), how="inner").drop("__there")


def _state(state: str, planned: Column) -> Column:
    return {"all": F.lit(True), "current": ~planned, "planned": planned}[state]


class Repository:
    def __init__(self, files: DataFrame, dialect: int = 1, benchmarks: P.Benchmarks = P.Benchmarks(), ignore_unexplained: Sequence[str] = (), crate_names: Sequence[str] = (), package: str | None = None):
        self.files, self.dialect, self.benchmarks, self.ignore_unexplained = files, dialect, benchmarks, ignore_unexplained
        self.crate_names, self.package = [n.replace("-", "_") for n in crate_names], package

    @cached_property
    def lines(self) -> DataFrame:
        return written(comment_blocks(self.files.where("kind = 'source'")), "comment-lines")

    @cached_property
    def source(self) -> DataFrame:
        return written(A.tag_sections(self.lines), "source-sections")

    @cached_property
    def prose(self) -> DataFrame:
        return written(prose_sections(self.files.where("kind = 'markdown'")), "prose-sections")

    @cached_property
    def sections(self) -> DataFrame:
        return self.source.unionByName(self.prose)

    @cached_property
    def spec_decls(self) -> DataFrame:
        return _ordered(A.specs(self.sections, self.dialect), False)

    @cached_property
    def verifies(self) -> DataFrame:
        return _ordered(A.verifies(self.source, self.files), False)

    @cached_property
    def attests(self) -> DataFrame:
        return _ordered(A.attests(self.sections, self.files, self.lines), False)

    @cached_property
    def module_decls(self) -> DataFrame:
        return _ordered(A.modules(self.sections), True)

    @cached_property
    def implements(self) -> DataFrame:
        return _ordered(A.implements(self.source, self.files), True)

    @cached_property
    def pattern_decls(self) -> DataFrame:
        return _ordered(A.patterns(self.sections), True)

    @cached_property
    def applications(self) -> DataFrame:
        return _ordered(A.applications(self.source, self.files), True)

    @cached_property
    def items(self) -> DataFrame:
        return written(syntax.items(self.files.where("kind = 'source'")), "items")

    @cached_property
    def imports(self) -> DataFrame:
        return written(syntax.file_imports(self.files.where("kind = 'source'")), "imports")

    def edges(self, semantic: DataFrame | None = None) -> DataFrame:
        """Calls between items; ``semantic`` (caller, callee) adds what a language server or compiler found."""
        return written(C.edges(self.items, self.imports, self.crate_names, self.package, semantic), "edges")

    def supports(self) -> DataFrame:
        return H.supports(self.verifies, self.spec_decls, self.items)

    def health(self, semantic: DataFrame | None = None, mediated: DataFrame | None = None) -> DataFrame:
        """Items with their evidence, category and module standing; see operators/health.py for what is made of them."""
        return H.traced(self.items, self.edges(semantic), self.supports(), H.ownership(self.implements), self.ignore_unexplained, mediated)

    def owned_items(self) -> DataFrame:
        return H.owned(self.implements, self.items)

    def duplicates(self) -> DataFrame:
        return H.duplicates(self.owned_items())

    def unowned(self) -> DataFrame:
        return H.unowned(self.items, self.implements)

    def coupling(self, root: str = "") -> DataFrame:
        return H.module_coupling(self.module_decls, self.implements, C.import_files(self.imports, self.files, root))

    def module_analysis(self) -> DataFrame:
        return H.module_summary(self.owned_items(), self.implements, self.files)

    def applied_features(self) -> DataFrame:
        """Applications with the features of the largest item in what they mark."""
        a = self.applications.select("pattern_id", F.col("path").alias("__p"), F.col("line").alias("app_line"), "body_line", "ord", (F.col("body_line") + T.owned_lines(F.col("body")) - 1).alias("__hi"))
        hit = a.join(self.items, (F.col("path") == F.col("__p")) & (F.col("body_line").isNull() | F.col("start_line").between(F.col("body_line"), F.col("__hi"))))
        of = hit.groupBy("pattern_id", "__p", "app_line").agg(F.max_by(F.struct(*self.items.columns, "ord"), F.struct("nodes", -F.col("start_line"))).alias("i"))
        return P.features(of.select("pattern_id", "i.*"))

    def _candidates(self) -> DataFrame:
        rows = self.items.where(~F.col("is_test") & ~T.is_test_path(F.col("path"))).withColumn("line", F.col("start_line"))
        return P.features(rows.withColumn("ord", F.struct(T.path_key(F.col("path")).alias("parts"), "line")))

    def _annotated(self) -> DataFrame:
        return self.applications.select("pattern_id", "path", F.col("body_line").alias("line"))

    def pattern_similarity(self) -> DataFrame:
        return P.similarity_summary(self.applied_features(), self.pattern_decls, self.benchmarks)

    def missing_applications(self, target: str | None = None) -> DataFrame:
        first = R.first_by(self.pattern_decls, "pattern_id", "ord")
        rows = self._candidates()
        rows = rows if target is None else rows.where(T.in_scope(F.col("path"), target, "/"))
        return P.missing_applications(P.profiles(self.applied_features(), first, self.benchmarks), rows, self._annotated())

    def pattern_clusters(self, target: str | None = None) -> DataFrame:
        rows = self._candidates()
        return P.clusters(rows, rows if target is None else rows.where(T.in_scope(F.col("path"), target, "/")), self._annotated())

    def specs(self, state: str = "all", unverified: bool = False, scope: str | None = None) -> DataFrame:
        """Visible claims and the groups and claims above them, with their supports counted."""
        first = R.first_by(self.spec_decls, "id", "ord")
        v = self.verifies.where("body IS NOT NULL").groupBy(F.col("spec_id").alias("id")).agg(F.count("*").alias("verifies"), F.count("body_line").alias("item_verifies"))
        a = self.attests.groupBy(F.col("spec_id").alias("id")).agg(F.count("*").alias("attests"), F.count_if(F.col("scope") == "block").alias("block_attests"))
        zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("verifies", "item_verifies", "attests", "block_attests")}
        rows = first.join(v, "id", "left").join(a, "id", "left").withColumns(zero)
        rows = rows.withColumn("unverified", (F.col("kind") == "spec") & ~F.col("planned") & (F.col("verifies") == 0) & (F.col("attests") == 0))
        direct = (F.col("kind") == "spec") & _state(state, F.col("planned"))
        return scoped(tree(rows, direct & F.col("unverified") if unverified else direct), scope)

    def spec_metrics(self, **view) -> DataFrame:
        """One row: the counts over the claims of a view."""
        s = self.specs(**view).where("kind = 'spec'")
        n, total = F.count_if, lambda c: F.coalesce(F.sum(c), F.lit(0))
        v, a = F.col("verifies"), F.col("attests")
        return s.agg(
            F.count("*").alias("total_specs"), n(F.col("planned")).alias("planned_specs"), n(F.col("deprecated")).alias("deprecated_specs"), n(F.col("unverified")).alias("unverified_specs"),
            n(v > 0).alias("verified_specs"), n(a > 0).alias("attested_specs"), n((v > 0) & (a > 0)).alias("specs_with_both_supports"), total("verifies").alias("verifies"),
            total("item_verifies").alias("item_scoped_verifies"), total(v - F.col("item_verifies")).alias("file_scoped_verifies"), F.lit(0).cast("long").alias("unattached_verifies"),
            total("attests").alias("attests"), total("block_attests").alias("block_attests"), total(a - F.col("block_attests")).alias("file_attests"),
        )

    def specs_by_file(self, **view) -> DataFrame:
        return R.grouped_count(self.specs(**view).where("kind = 'spec'"), F.col("path"))

    def current_specs_by_top_level_id(self, **view) -> DataFrame:
        return R.grouped_count(self.specs(**view).where("kind = 'spec' AND NOT planned AND NOT deprecated"), T.top_level(F.col("id")))

    def contained(self) -> DataFrame:
        """Applications with every implementation that holds them: the same item, or the whole file."""
        app = self.applications.select("pattern_id", "path", "line", "body_line", F.col("ord").alias("app_ord"))
        imp = self.implements.select("module_id", F.col("path").alias("__p"), F.col("body_line").alias("__b"), F.col("ord").alias("imp_ord"))
        item = app.join(imp, (F.col("path") == F.col("__p")) & (F.col("body_line") == F.col("__b")))
        file = app.join(imp.where("__b IS NULL"), F.col("path") == F.col("__p"))
        return item.unionByName(file).drop("__p", "__b").distinct()

    def modules(self, state: str = "all", unimplemented: bool = False, scope: str | None = None) -> DataFrame:
        """Visible modules and areas, with implementations and pattern applications counted."""
        first = R.first_by(self.module_decls, "id", "ord")
        own = self.implements.groupBy(F.col("module_id").alias("id")).agg(F.count_if(F.col("body_line").isNull()).alias("file_implements"), F.count("body_line").alias("item_implements"))
        used = self.contained().groupBy(F.col("module_id").alias("id")).agg(F.countDistinct("pattern_id", "path", "line").alias("applications"))
        zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("file_implements", "item_implements", "applications")}
        rows = first.join(own, "id", "left").join(used, "id", "left").withColumns(zero)
        rows = rows.withColumn("unimplemented", (F.col("kind") == "module") & ~F.col("planned") & (F.col("file_implements") + F.col("item_implements") == 0))
        direct = _state(state, F.col("planned"))
        return scoped(tree(rows, direct & F.col("unimplemented") if unimplemented else direct), scope)

    def module_metrics(self, **view) -> DataFrame:
        m = self.modules(**view)
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return m.agg(
            F.count_if(F.col("kind") == "module").alias("total_modules"), F.count_if(F.col("kind") == "area").alias("total_areas"), F.count_if(F.col("unimplemented")).alias("unimplemented_modules"),
            total("file_implements").alias("file_scoped_implements"), total("item_implements").alias("item_scoped_implements"),
        )

    def modules_by_area(self, **view) -> DataFrame:
        """(value, count): modules anywhere below each visible area; areas with none are left out."""
        m = self.modules(**view)
        up = m.where("kind = 'module'").select(F.explode(T.ancestors(F.col("id"))).alias("id"))
        return R.grouped_count(up.join(m.where("kind = 'area'").select("id"), "id", "left_semi"), F.col("id"))

    def patterns(self, scope: str | None = None) -> DataFrame:
        """Defined and applied patterns, with their applications and the modules that hold them counted."""
        first = R.first_by(self.pattern_decls, "pattern_id", "ord").select(F.col("pattern_id").alias("id"), "strictness", "text", "path", "line", F.lit(True).alias("defined"))
        used = self.applications.groupBy(F.col("pattern_id").alias("id")).agg(F.count("*").alias("applications"))
        declared = self.module_decls.select(F.col("id").alias("module_id")).distinct()
        held = self.contained().join(declared, "module_id", "left_semi").groupBy(F.col("pattern_id").alias("id")).agg(F.countDistinct("module_id").alias("modules"))
        rows = first.join(used, "id", "full").join(held, "id", "left")
        rows = rows.withColumns({"defined": F.coalesce("defined", F.lit(False)), "applications": F.coalesce("applications", F.lit(0).cast("long")), "modules": F.coalesce("modules", F.lit(0).cast("long"))})
        if scope is None:
            return tree(rows, F.lit(True))
        inside = T.in_scope(F.col("id"), scope)
        return scoped(tree(rows.where(inside | F.col("defined")), inside), scope)

    def pattern_metrics(self) -> DataFrame:
        owner = self.contained().groupBy("pattern_id", "path", "line").agg(F.min_by("module_id", "imp_ord").alias("module_id"))
        return self.pattern_decls.agg(F.countDistinct("pattern_id").alias("total_patterns")).crossJoin(self.applications.agg(F.count("*").alias("total_applications"))).crossJoin(
            owner.agg(F.countDistinct("module_id").alias("modules_with_applications")))

    def spec_lint(self) -> DataFrame:
        d = self.spec_decls
        error = lambda df, message: A.errors(df, message)
        out = A.diagnostics(self.sections.where("keyword NOT IN ('module', 'area', 'implements', 'fileimplements', 'pattern', 'applies', 'fileapplies')"), self.dialect)
        twice = R.previous_declaration(d.withColumn("here", F.struct("kind", "path", "line")), "id", [F.col("ord")], "here")
        out = out.unionByName(error(twice, said(DUPLICATE_SPEC, F.col("id"), F.col("previous.kind"), F.col("previous.path"), F.col("previous.line"))))
        out = out.unionByName(error(_missing(d), said(MISSING_SPEC, F.col("missing_id"))))
        refs = self.verifies.select("spec_id", "path", "line", F.lit("verifies").alias("tag")).unionByName(
            self.attests.select("spec_id", "path", "line", F.when(F.col("scope") == "file", "fileattests").otherwise("attests").alias("tag")))
        return out.unionByName(_bad_references(refs, "spec_id", d, said(UNKNOWN_SPEC, F.col("spec_id"), F.col("tag")), "group", said(GROUP, F.col("spec_id"), F.col("tag"))))

    def module_lint(self) -> DataFrame:
        d, imp, pat = self.module_decls, self.implements, self.pattern_decls
        error = lambda df, message: A.errors(df, message)
        out = A.diagnostics(self.source.where("keyword IN ('implements', 'fileimplements', 'pattern', 'applies', 'fileapplies')"))
        out = out.unionByName(A.diagnostics(self.prose.where("keyword = 'pattern'")))
        out = out.unionByName(error(self.prose.where("keyword IN ('applies', 'fileapplies')"), F.lit(A.IN_PROSE)))
        again = lambda df, by, message: error(R.previous_declaration(df, by, [F.col("ord")], "line"), message)
        out = out.unionByName(again(d, "id", said(DUPLICATE_MODULE, F.col("id"), F.col("previous"))))
        out = out.unionByName(again(pat, "pattern_id", said(DUPLICATE_PATTERN, F.col("pattern_id"), F.col("previous"))))
        items = imp.where("body_line IS NOT NULL").withColumn("place", F.struct("path", "body_line"))
        out = out.unionByName(again(items, "place", said(DUPLICATE_ITEM, F.col("body_line"), F.col("previous"))))
        out = out.unionByName(again(imp.where("body_line IS NULL"), "path", said(DUPLICATE_FILE, F.col("previous"))))
        out = out.unionByName(error(_missing(d), said(MISSING_MODULE, F.col("missing_id"))))
        out = out.unionByName(_bad_references(imp, "module_id", d, said(UNKNOWN_MODULE, F.col("module_id")), "area", said(AREA, F.col("module_id"))))
        strange = self.applications.join(pat.select("pattern_id").distinct(), "pattern_id", "left_anti")
        out = out.unionByName(error(strange, said(UNKNOWN_PATTERN, F.col("pattern_id"))))
        bare = d.where("kind = 'module' AND NOT planned").join(imp.select(F.col("module_id").alias("id")).distinct(), "id", "left_anti")
        return out.unionByName(error(bare, said(UNATTACHED, F.col("id"))))

    def lint(self) -> DataFrame:
        """All diagnostics, sorted, equal ones once."""
        return A.ordered(self.spec_lint().unionByName(self.module_lint()))

    def overview(self) -> DataFrame:
        """(section, name, count): diagnostics, declarations as written (copies too), and what lacks support."""
        d = self.lint().agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
        s = self.spec_decls.agg(F.count_if(F.col("kind") == "spec").alias("total_specs"), F.count_if("planned").alias("planned_specs"), F.count_if("deprecated").alias("deprecated_specs"))
        u = self.specs("current", unverified=True).agg(F.count_if("unverified").alias("unverified_specs"))
        m = self.module_decls.agg(F.count_if(F.col("kind") == "module").alias("total_modules"), F.count_if(F.col("kind") == "area").alias("total_areas"))
        n = self.modules("current", unimplemented=True).agg(F.count_if("unimplemented").alias("unimplemented_modules"))
        h = self.duplicates().agg(F.count("*").alias("duplicate_items")).crossJoin(self.unowned().agg(F.count("*").alias("unowned_items")))
        rows = None
        for section, df in (("lint", d), ("specs", s), ("specs", u), ("arch", m), ("arch", n), ("health", h)):
            part = df.select(F.explode(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(c).alias("name"), F.col(c).cast("long").alias("count")) for c in df.columns])).alias("x")).select("x.*")
            rows = part if rows is None else rows.unionByName(part)
        return rows


def _missing(decls: DataFrame) -> DataFrame:
    """Declarations with each ancestor id that none declares."""
    up = decls.select("path", "line", F.explode(T.ancestors(F.col("id"))).alias("missing_id"))
    return up.join(decls.select(F.col("id").alias("missing_id")).distinct(), "missing_id", "left_anti")


def _bad_references(refs: DataFrame, key: str, decls: DataFrame, unknown: Column, wrong_kind: str, wrong: Column) -> DataFrame:
    """References to ids that aren't declared, or whose last declaration is of the wrong kind."""
    last = decls.groupBy(F.col("id").alias(key)).agg(F.max_by("kind", "ord").alias("__kind"))
    rows = refs.join(last, key, "left")
    return A.errors(rows, F.when(F.col("__kind").isNull(), unknown).when(F.col("__kind") == wrong_kind, wrong))
