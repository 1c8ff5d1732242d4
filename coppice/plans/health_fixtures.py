"""Parsing, call resolution and health over small inlined source trees, with the rows worked out by hand as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions import text as T
from coppice.operators import calls as C
from coppice.operators import graph as G
from coppice.operators import health as H
from coppice.sources.stored import written
from coppice.sources.syntax import surfaces

from .catalogue import query
from .fixtures import files, repository, values

TRACE = {
    "src/live.rs": "// @fileimplements APP.CORE\npub fn live_impl() { shared(); }\nfn planned_impl() {}\nfn deprecated_impl() {}\nfn unverified_impl() {}\nfn orphan_impl() {}\nfn shared() {}\nfn file_only() {}\n",
    "src/loose.rs": "pub fn loose_orphan() {}\n",
    "tests/checks.rs": """use app::live;
// @verifies APP.LIVE
#[test]
fn verifies_live() { live_impl(); }

// @verifies APP.NEXT
#[test]
fn verifies_planned() { planned_impl(); }

// @verifies APP.OLD
#[test]
fn verifies_deprecated() { deprecated_impl(); }

#[test]
fn exercises_unverified() { unverified_impl(); }
""",
    "tests/whole.rs": "// @fileverifies APP.LIVE\n#[test]\nfn whole() { file_only(); }\n",
    "specs.md": "# `@group APP`\nAll.\n\n## `@spec APP.LIVE`\nLive.\n\n## `@spec APP.NEXT @planned`\nNext.\n\n## `@spec APP.OLD @deprecated`\nOld.\n",
    "arch.md": "# `@module APP.CORE`\nCore.\n",
}


_KEPT: dict[str, DataFrame] = {}


def _traced(spark):
    key = spark.sparkContext.applicationId
    if key not in _KEPT:
        _KEPT[key] = written(repository(spark, TRACE).health(), "traced")
    return _KEPT[key]


@query(values(
    "name VARCHAR, line INTEGER, category VARCHAR, verifying VARCHAR, unverified VARCHAR, specs VARCHAR, modules VARCHAR, review_surface BOOLEAN, file_scoped_only BOOLEAN, module_backed BOOLEAN, module_connected BOOLEAN",
    ("live_impl", 2, "current", "verifies_live", "", "APP.LIVE", "APP.CORE", True, False, True, True),
    ("planned_impl", 3, "planned", "verifies_planned", "", "APP.NEXT", "APP.CORE", False, False, True, False),
    ("deprecated_impl", 4, "deprecated", "verifies_deprecated", "", "APP.OLD", "APP.CORE", False, False, True, False),
    ("unverified_impl", 5, "unverified_test", "", "exercises_unverified", "", "APP.CORE", False, False, True, False),
    ("orphan_impl", 6, "unexplained", "", "", "", "APP.CORE", False, False, True, False),
    ("shared", 7, "current", "verifies_live", "", "APP.LIVE", "APP.CORE", False, False, True, True),
    ("file_only", 8, "current", "whole", "", "APP.LIVE", "APP.CORE", False, True, True, True),
    ("loose_orphan", 1, "unexplained", "", "", "", "", True, False, False, False),
))
def health_items(spark, sf):
    join = lambda *c: F.array_join(F.concat(*c), ",")
    return _traced(spark).select(
        "name", "line", "category", join("verifying_tests").alias("verifying"), join("unverified_tests").alias("unverified"), join("current", "planned", "deprecated").alias("specs"), join("module_ids").alias("modules"),
        "review_surface", "file_scoped_only", "module_backed", "module_connected")


@query(values("bucket VARCHAR, items BIGINT", ("current", 3), ("planned", 1), ("deprecated", 1), ("unverified_test", 1), ("mediated", 0), ("unexplained", 2), ("file_scoped_only", 1)))
def health_buckets(spark, sf):
    return H.buckets(_traced(spark))


@query(values("analysed BIGINT, by_buckets BIGINT", (8, 9)))
def bucket_overlap_counts(spark, sf):
    t = _traced(spark)
    return t.agg(F.count("*").alias("analysed")).crossJoin(H.buckets(t).agg(F.sum("items").alias("by_buckets")))


@query(values("unexplained_items BIGINT, review_surface_items BIGINT, public_items BIGINT, internal_items BIGINT, test_file_items BIGINT, module_owned_items BIGINT, module_backed_items BIGINT, module_connected_items BIGINT, module_isolated_items BIGINT, unowned_items BIGINT", (2, 1, 1, 1, 0, 1, 1, 0, 1, 1)))
def health_unexplained(spark, sf):
    return H.unexplained_counts(_traced(spark))


@query(values("bucket VARCHAR, items BIGINT", ("current", 3), ("planned", 1), ("deprecated", 1), ("unverified_test", 1), ("mediated", 0), ("unexplained", 1), ("file_scoped_only", 1)))
def health_ignored(spark, sf):
    return H.buckets(repository(spark, TRACE, ignore_unexplained=("src/loose.rs",)).health())


@query(values("name VARCHAR, category VARCHAR", ("planned_impl", "planned")))
def health_scoped(spark, sf):
    return H.scoped_items(_traced(spark), "src", "planned_impl").select("name", "category")


@query(values("name VARCHAR, category VARCHAR, reason VARCHAR", ("orphan_impl", "mediated", "build support code"), ("unverified_impl", "unverified_test", "build support code")))
def health_mediated(spark, sf):
    r = repository(spark, TRACE)
    some = r.items.where("name IN ('orphan_impl', 'unverified_impl')").select("stable_id", F.lit("build support code").alias("reason"))
    return r.health(mediated=some).where("reason IS NOT NULL").select("name", "category", "reason")


@query(values("path VARCHAR, name VARCHAR, kind VARCHAR", ("src/loose.rs", "loose_orphan", "function"), ("tests/checks.rs", "exercises_unverified", "function"), ("tests/checks.rs", "verifies_deprecated", "function"), ("tests/checks.rs", "verifies_live", "function"), ("tests/checks.rs", "verifies_planned", "function"), ("tests/whole.rs", "whole", "function")))
def unowned_code(spark, sf):
    return repository(spark, TRACE).unowned()


@query(values("spec_id VARCHAR, name VARCHAR, start_line INTEGER", ("APP.LIVE", "verifies_live", 4), ("APP.NEXT", "verifies_planned", 8), ("APP.OLD", "verifies_deprecated", 12)))
def verify_line_range(spark, sf):
    r = repository(spark, TRACE)
    return H.verified_items(r.verifies, r.items).join(r.items, "stable_id").select("spec_id", "name", "start_line")


MIXED = {
    "src/foo/mod.rs": """use std::collections::{BTreeMap, HashMap as Map};
mod inner {
    pub(crate) fn helper(a: bool, b: &str) -> usize { 1 }
}
impl<T> Foo<T> for Bar {
    pub fn run(&self, name: String, flag: bool, n: Option<String>) -> Result<()> {
        let x = match name.as_str() {
            "a" => 1,
            "b" if flag => { 2 }
            _ => 3,
        };
        for i in 0..x {
            if i > 1 && flag || i < 0 {
                self.call(i)?;
            } else if flag {
                return Ok(());
            } else { panic!("no"); }
        }
        Command::new(env!("CARGO_BIN_EXE_tool")).arg("x").unwrap();
    }
}
#[test]
fn checks() { inner::helper(true, "x"); }
""",
    "cmd/srv.go": """package p
import (
  "fmt"
  alias "a/b/c"
  _ "side"
)
func (s *Server) Run(a, b bool, name string) error {
  switch x { case 1: foo()
  case 2, 3: s.bar(x)
  default: panic("x") }
  for i := 0; i < 3; i++ { if i == 2 || x > 1 { go func() { if y { inner() } }() } }
  return nil
}
func helper() {}
""",
    "src/web/index.ts": """import { a } from "./x";
export { later };
export class Box {
  private hide(a: string) { return a; }
  async show(flag: boolean, n?: string): Promise<void> {
    for (const x of list) { if (x && flag) { throw new Error("e"); } else { await go(x); } }
    const y = flag ? 1 : 2;
  }
}
export const add = (a: number, b: number): number => a + b;
const later = async (x) => { try { run(x); } catch (e) { console.log(e); } };
function plain() { switch (k) { case 1: return 1; default: return 2; } }
""",
}


@query(values(
    "qualified_name VARCHAR, kind VARCHAR, start_line INTEGER, end_line INTEGER, public BOOLEAN, root_visible BOOLEAN, is_test BOOLEAN, params INTEGER, bool_params INTEGER, string_params INTEGER, cyclomatic INTEGER, cognitive INTEGER, panics INTEGER",
    ("foo::inner::helper", "function", 3, 3, False, True, False, 2, 1, 1, 1, 0, 0),
    ("foo::Bar::run", "method", 6, 20, True, True, False, 4, 1, 1, 9, 9, 2),
    ("foo::checks", "function", 23, 23, False, False, True, 0, 0, 0, 1, 0, 0),
    ("cmd::srv::Server::Run", "method", 7, 13, True, True, False, 3, 2, 1, 6, 5, 1),
    ("cmd::srv::helper", "function", 14, 14, False, False, False, 0, 0, 0, 1, 0, 0),
    ("web::Box::hide", "method", 4, 4, False, False, False, 1, 0, 1, 1, 0, 0),
    ("web::Box::show", "method", 5, 8, True, True, False, 2, 1, 1, 5, 5, 1),
    ("web::add", "function", 10, 10, True, True, False, 2, 0, 0, 1, 0, 0),
    ("web::later", "function", 11, 11, True, True, False, 1, 0, 0, 2, 1, 0),
    ("web::plain", "function", 12, 12, False, False, False, 0, 0, 0, 2, 1, 0),
))
def parsed_items(spark, sf):
    return repository(spark, MIXED).items.select("qualified_name", "kind", "start_line", "end_line", "public", "root_visible", "is_test", "params", "bool_params", "string_params", "cyclomatic", "cognitive", "panics")


@query(values(
    "item VARCHAR, name VARCHAR, qualifier VARCHAR, syntax VARCHAR",
    ("foo::Bar::run", "as_str", "name", "field"), ("foo::Bar::run", "call", "self", "field"), ("foo::Bar::run", "Ok", None, "identifier"), ("foo::Bar::run", "new", "Command", "scoped"),
    ("foo::Bar::run", "arg", 'Command::new(env!("CARGO_BIN_EXE_tool"))', "field"), ("foo::Bar::run", "unwrap", 'Command::new(env!("CARGO_BIN_EXE_tool")).arg("x")', "field"),
    ("foo::checks", "helper", "inner", "scoped"), ("cmd::srv::Server::Run", "foo", None, "identifier"), ("cmd::srv::Server::Run", "bar", "s", "field"), ("cmd::srv::Server::Run", "panic", None, "identifier"),
    ("cmd::srv::Server::Run", "inner", None, "identifier"), ("web::Box::show", "go", None, "identifier"), ("web::later", "run", None, "identifier"), ("web::later", "log", "console", "field"),
))
def parsed_calls(spark, sf):
    return repository(spark, MIXED).items.select(F.col("qualified_name").alias("item"), F.explode("calls").alias("c")).select("item", "c.name", "c.qualifier", "c.syntax")


@query(values(
    "path VARCHAR, target VARCHAR, alias VARCHAR",
    ("src/foo/mod.rs", "std::collections::BTreeMap", None), ("src/foo/mod.rs", "std::collections::HashMap", "Map"), ("cmd/srv.go", "fmt", None), ("cmd/srv.go", "a/b/c", "alias"), ("cmd/srv.go", "side", "_"), ("src/web/index.ts", "./x", None)))
def parsed_imports(spark, sf):
    return repository(spark, MIXED).imports


@query(values("item VARCHAR, binary_name VARCHAR", ("foo::Bar::run", "tool")))
def parsed_invocations(spark, sf):
    return repository(spark, MIXED).items.select(F.col("qualified_name").alias("item"), F.explode("invocations").alias("binary_name"))


CALLS = {
    "src/lib.rs": "pub fn top() { crate::a::go(); own::deep::far(); launch(); nothing(); twice(); Command::new(env!(\"CARGO_BIN_EXE_tool\")).run(); }\nuse crate::a::go as launch;\nfn twice() {}\n",
    "src/a.rs": "pub fn go() { super::top(); self::near(); }\nfn near() {}\nimpl Box {\n    fn open(&self) { self.shut(); Self::shut(); }\n    fn shut(&self) {}\n}\nmod twin { fn twice() {} }\n",
    "src/deep.rs": "pub fn far() { unique_elsewhere(); }\n",
    "src/other.rs": "fn unique_elsewhere() {}\nfn twice() {}\nfn user() { twice(); }\n",
    "src/bin/tool.rs": "fn main() { a::go(); }\n",
    "pkg/run.go": "package run\nimport \"x.org/m/lib\"\nfunc Start() { lib.Do(); local() }\nfunc local() {}\n",
    "lib/do.go": "package lib\nfunc Do() {}\n",
    "lib2/do.go": "package lib2\nfunc Do() {}\n",
    "web/a.ts": "export function alpha() { beta(); gamma(); }\nfunction beta() {}\n",
    "web/b.ts": "export function gamma() {}\n",
}


def _named(edges, items):
    name = lambda c: items.select(F.col("stable_id").alias(c), F.concat_ws(" ", "path", "qualified_name").alias(f"{c}_name"))
    return edges.join(name("caller"), "caller").join(name("callee"), "callee").select(F.col("caller_name").alias("caller"), F.col("callee_name").alias("callee"))


@query(values(
    "caller VARCHAR, callee VARCHAR",
    ("src/lib.rs top", "src/a.rs a::go"), ("src/lib.rs top", "src/deep.rs deep::far"), ("src/lib.rs top", "src/lib.rs twice"), ("src/lib.rs top", "src/bin/tool.rs bin::tool::main"),
    ("src/a.rs a::go", "src/lib.rs top"), ("src/a.rs a::go", "src/a.rs a::near"), ("src/a.rs a::Box::open", "src/a.rs a::Box::shut"), ("src/deep.rs deep::far", "src/other.rs other::unique_elsewhere"),
    ("src/other.rs other::user", "src/other.rs other::twice"), ("src/bin/tool.rs bin::tool::main", "src/a.rs a::go"),
    ("pkg/run.go pkg::run::Start", "lib/do.go lib::do::Do"), ("pkg/run.go pkg::run::Start", "pkg/run.go pkg::run::local"), ("web/a.ts web::a::alpha", "web/a.ts web::a::beta"), ("web/a.ts web::a::alpha", "web/b.ts web::b::gamma"),
))
def call_edges(spark, sf):
    r = repository(spark, CALLS, crate_names=("own",))
    return _named(r.edges(), r.items)


IMPORTS = {
    "x.rs": "// @fileimplements X\nuse crate::y::Thing;\nuse crate::z::T;\nuse std::fmt;\nuse crate::nowhere::Q;\nuse crate::w;\nfn a() {}\n",
    "y/mod.rs": "// @fileimplements Y\nuse super::x::a;\nuse self::part::P;\nfn b() {}\n",
    "y/part.rs": "// @fileimplements Y\nfn p() {}\n",
    "z.rs": "// @fileimplements Y\nfn c() {}\n\n// @implements Z\nfn d() {}\n",
    "w.rs": "fn e() {}\n",
    "web/a.ts": "import { b } from \"./lib\";\nimport { c } from \"../c\";\nimport { d } from \"pkg\";\n",
    "web/lib/index.ts": "export const b = 1;\n",
    "c.tsx": "export const c = 1;\n",
    "cmd/m.go": "package m\nimport \"x.org/k/pkg/util\"\n",
    "pkg/util/u.go": "package util\n",
    "pkg/util/u_test.go": "package util\n",
    "arch.md": "# `@module X`\nX.\n\n# `@module Y`\nY.\n\n# `@module Z`\nZ.\n",
}


@query(values(
    "path VARCHAR, target VARCHAR, file VARCHAR, internal BOOLEAN",
    ("x.rs", "crate::y::Thing", "y/mod.rs", True), ("x.rs", "crate::z::T", "z.rs", True), ("x.rs", "std::fmt", None, False), ("x.rs", "crate::nowhere::Q", None, True), ("x.rs", "crate::w", "w.rs", True),
    ("y/mod.rs", "super::x::a", None, True), ("y/mod.rs", "self::part::P", "y/part.rs", True),
    ("web/a.ts", "./lib", "web/lib/index.ts", True), ("web/a.ts", "../c", "c.tsx", True), ("web/a.ts", "pkg", None, False), ("cmd/m.go", "x.org/k/pkg/util", "pkg/util/u.go", False),
))
def import_resolution(spark, sf):
    r = repository(spark, IMPORTS)
    return C.import_files(r.imports, r.files)


@query(values(
    "module_id VARCHAR, fan_out BIGINT, fan_in BIGINT, instability DOUBLE, ambiguous BIGINT, unresolved BIGINT, external BIGINT",
    ("X", 1, 0, 1.0, 1, 1, 1), ("Y", 0, 1, 0.0, 0, 0, 0), ("Z", 0, 0, 0.0, 0, 0, 0)))
def module_coupling(spark, sf):
    return repository(spark, IMPORTS).coupling()


SIGNALS = {
    "sig.rs": """// @fileimplements M
pub fn entry(a: bool, b: &str) { helper(); helper(); out(); twin(); }
fn helper() { if x { deep(); } }
fn deep() { y.unwrap(); }
fn lost(n: u32, s: String) { ext(); }
mod a { fn twin() {} }
mod b { fn twin() {} }
""",
}


@query(values(
    "name VARCHAR, start_line INTEGER, internal_refs BIGINT, inbound_refs BIGINT, external_refs BIGINT, unreached BOOLEAN",
    ("entry", 2, 3, 0, 1, False), ("helper", 3, 1, 2, 0, False), ("deep", 4, 0, 1, 1, False), ("lost", 5, 0, 0, 1, True), ("twin", 6, 0, 0, 0, True), ("twin", 7, 0, 0, 0, True)))
def item_signals(spark, sf):
    return H.signals(repository(spark, SIGNALS).owned_items(), "module_id").select("name", "start_line", "internal_refs", "inbound_refs", "external_refs", "unreached")


@query(values(
    "list VARCHAR, names VARCHAR",
    ("connected", "entry,helper,deep"), ("outbound_heavy", "deep,lost"), ("isolated", "lost"), ("unreached", "lost,twin,twin"), ("highest_complexity", "helper"), ("parameter_heavy", "entry,lost"), ("stringly_boundary", "entry"), ("panic_heavy", "deep")))
def item_signal_lists(spark, sf):
    rows, out = H.signals(repository(spark, SIGNALS).owned_items(), "module_id"), None
    for name, (keep, order) in H.signal_lists().items():
        kept = rows.where(keep)
        # the order as a number, so that one row can hold the list
        nth = kept.select("module_id", "name", F.row_number().over(Window.partitionBy("module_id").orderBy(*order)).alias("k"))
        one = nth.agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "name"))).getField("name"), ",").alias("names")).select(F.lit(name).alias("list"), "names")
        out = one if out is None else out.unionByName(one)
    return out


BODY = "{ let a = f(x); for i in xs { if i > 2 { a += g::h(i); } let b = h(i, a); k(b); } m(a, b); }"
COPIES = {
    "p.rs": f"// @fileimplements M\nfn one() {BODY}\nfn two() {BODY}\nfn tiny() {{ f(x); }}\n",
    "q.rs": f"// @fileimplements N\nfn three() {BODY}\nfn four() {BODY.replace('k(b)', 'other(b)')}\n",
    "tests/r.rs": f"// @fileimplements N\nfn five() {BODY}\n",
}


@query(values("module_id VARCHAR, path VARCHAR, name VARCHAR, kind VARCHAR, peer_count BIGINT", ("M", "p.rs", "one", "function", 2), ("M", "p.rs", "two", "function", 2), ("N", "q.rs", "three", "function", 2)))
def duplicate_code(spark, sf):
    return repository(spark, COPIES).duplicates()


@query(values(
    "module_id VARCHAR, owned_lines BIGINT, public_items BIGINT, internal_items BIGINT, total_cyclomatic BIGINT, max_cyclomatic BIGINT, parameters BIGINT, bool_params BIGINT, string_params BIGINT, panic_sites BIGINT",
    ("M", 7, 1, 7, 7, 2, 2, 1, 1, 1)))
def module_summary(spark, sf):
    s = repository(spark, SIGNALS).module_analysis()
    return s.select("module_id", *[F.col(c).cast("long").alias(c) for c in ("owned_lines", "public_items", "internal_items", "total_cyclomatic", "max_cyclomatic", "parameters", "bool_params", "string_params", "panic_sites")])


PATTERNED = {
    "arch.md": "# `@pattern READ.LOOP`\n`@strictness high`\nReads in a loop.\n",
    "a.rs": "// @applies READ.LOOP\nfn read_a() { for x in open(p) { parse(x); keep(x); } }\n\n// @applies READ.LOOP\nfn read_b() { for y in open(q) { parse(y); keep(y); } }\n",
    "b.rs": "fn read_c() { for z in open(r) { parse(z); keep(z); } }\n\nfn plain() { say(1); }\n",
}


@query(values("pattern_id VARCHAR, scored BIGINT, pairs BIGINT, strictness VARCHAR, mean DOUBLE, expected DOUBLE, estimate VARCHAR", ("READ.LOOP", 2, 1, "high", 0.92, 0.55, "duplicate_like")))
def pattern_similarity(spark, sf):
    return repository(spark, PATTERNED).pattern_similarity().select("pattern_id", "scored", "pairs", "strictness", "mean", "expected", "estimate")


@query(values("pattern_id VARCHAR, confidence VARCHAR, name VARCHAR, path VARCHAR, line INTEGER, missing VARCHAR", ("READ.LOOP", "probable", "read_c", "b.rs", 1, "")))
def pattern_candidates(spark, sf):
    return repository(spark, PATTERNED).missing_applications().select("pattern_id", "confidence", "name", "path", "line", F.array_join("missing", ",").alias("missing"))


@query(values("path VARCHAR, language VARCHAR", ("a.rs", "rust"), ("b.go", "go"), ("c.tsx", "typescript"), ("d.py", None)))
def languages(spark, sf):
    return files(spark, {"a.rs": "", "b.go": "", "c.tsx": "", "d.py": ""}).select("path", T.language(F.col("path")).alias("language"))


@query(values("path VARCHAR, found VARCHAR", ("x/src/a.rs", "src/a.rs"), ("a.rs", "a.rs"), ("b.rs", "b.rs"), ("lib/src/b.rs", "deep/lib/src/b.rs")))
def suffix_paths(spark, sf):
    known = F.array(*map(F.lit, ("src/a.rs", "other/a.rs", "deep/lib/src/b.rs", "b.rs")))
    return spark.createDataFrame([("x/src/a.rs",), ("a.rs",), ("b.rs",), ("lib/src/b.rs",)], "path string").select("path", T.longest_suffix(known, F.col("path")).alias("found"))


@query(values(
    "path VARCHAR", ("x.rs",), ("y/mod.rs",), ("y/part.rs",), ("z.rs",), ("w.rs",)))
def file_closure(spark, sf):
    """Files that x.rs needs, over imports."""
    r = repository(spark, IMPORTS)
    uses = C.import_files(r.imports, r.files).where("file IS NOT NULL").select(F.col("path").alias("caller"), F.col("file").alias("callee"))
    return G.reachable(uses, spark.createDataFrame([("x.rs",)], "node string")).select(F.col("node").alias("path"))


@query(values("path VARCHAR, module_ids VARCHAR", ("x.rs", "X"), ("y/mod.rs", "Y"), ("y/part.rs", "Y"), ("z.rs", "Y,Z")))
def ownership_index(spark, sf):
    return H.ownership(repository(spark, IMPORTS).implements).select("path", F.array_join("module_ids", ",").alias("module_ids"))


@query(values("path VARCHAR, name VARCHAR, test_path BOOLEAN, test_file BOOLEAN, review BOOLEAN", *[
    ("a/tests/x.rs", "f", True, True, False), ("a/tests.rs", "f", True, True, False), ("a/x_test.rs", "f", True, False, True), ("a/x_test.go", "f", True, True, False), ("a/x.spec.ts", "f", True, True, False),
    ("__tests__/x.ts", "f", True, False, True), ("a/x.go", "main", False, False, True), ("a/test.rs", "g", False, False, False)]))
def test_rules(spark, sf):
    rows = spark.createDataFrame([("a/tests/x.rs", "f"), ("a/tests.rs", "f"), ("a/x_test.rs", "f"), ("a/x_test.go", "f"), ("a/x.spec.ts", "f"), ("__tests__/x.ts", "f"), ("a/x.go", "main"), ("a/test.rs", "g")], "path string, name string")
    path, public = F.col("path"), F.col("name") == "f"
    return rows.select("path", "name", T.is_test_path(path).alias("test_path"), T.is_test_file(path).alias("test_file"), T.is_review_surface(path, public, F.col("name"), F.lit("function")).alias("review"))


@query(values("value VARCHAR, count BIGINT", ("sum total_cyclomatic", 7), ("max max_cyclomatic", 2), ("M panic_sites", 1)))
def architecture_rollup(spark, sf):
    s = repository(spark, SIGNALS).module_analysis()
    m = H.architecture_metrics(s).select(F.explode(F.array(F.struct(F.lit("sum total_cyclomatic").alias("value"), F.col("total_cyclomatic").cast("long").alias("count")), F.struct(F.lit("max max_cyclomatic").alias("value"), F.col("max_cyclomatic").cast("long").alias("count")))).alias("x")).select("x.*")
    return m.unionByName(H.ranking(s, "panic_sites").select(F.concat("value", F.lit(" panic_sites")).alias("value"), "count"))


SURFACE = {
    "a.rs": """use std::fmt;
pub use crate::x::{A, B};
#[derive(Debug)]
pub struct S { pub a: u32 }
pub(crate) enum E { X }
pub const fn f() -> u32 { 1 }
const C: u32 = { 3 };
pub mod m { fn g() {} pub trait T { fn h(); } }
impl S { pub fn open(&self) {} fn shut(&self) {} pub const K: u32 = 1; }
macro_rules! mac { () => {} }
extern "C" { fn far(); }
extern crate core;
""",
    "b.go": "package b\nfunc Do() {}\nfunc hide() {}\n",
    "c.ts": "export function shown() {}\nfunction own() {}\n",
    "d.py": "def f(): pass\n",
}


@query(values("path VARCHAR, public_items BIGINT, internal_items BIGINT", ("a.rs", 7, 8), ("b.go", 1, 1), ("c.ts", 1, 1)))
def surface_by_file(spark, sf):
    return surfaces(files(spark, SURFACE).withColumn("key", F.col("path")), "key").withColumnRenamed("key", "path")


@query(values("nth BIGINT, path VARCHAR, line INTEGER, name VARCHAR", (0, "src/live.rs", 6, "orphan_impl"), (1, "src/loose.rs", 1, "loose_orphan")))
def bucket_order(spark, sf):
    """The order of a bucket, numbered as the rows stand."""
    rows = H.bucket_items(_traced(spark), "unexplained").select("path", "line", "name").coalesce(1)
    return rows.withColumn("nth", F.monotonically_increasing_id())
