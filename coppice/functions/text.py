"""Column functions over ids, paths, names and shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest shape of the small and of the medium bucket.
SMALL, MEDIUM = 24, 80

#: Marker term and the parts of node kinds that show it.
MARKERS = [
    ("control:if", ("if_expression", "if_statement")),
    ("control:branch", ("match_expression", "switch_statement", "conditional_type")),
    ("control:loop", ("for_expression", "while_expression", "loop_expression", "for_statement")),
    ("data:binding", ("let_declaration", "lexical_declaration", "variable_declarator", "short_var_declaration")),
    ("data:assignment", ("assignment_expression", "augmented_assignment_expression", "field_initializer")),
    ("shape:closure", ("closure_expression", "arrow_function", "func_literal", "anonymous_function")),
    ("shape:call", ("call_expression",)),
    ("shape:member", ("field_expression", "member_expression", "selector_expression")),
    ("flow:return", ("return_expression", "return_statement")),
    ("flow:defer_or_try", ("try_expression", "await_expression")),
]


def top_level(id: Column) -> Column:
    return F.substring_index(id, ".", 1)


def ancestors(id: Column) -> Column:
    """Proper ancestors of a dotted id, outermost first; none for an id without dots or a null."""
    p = F.split(id, r"\.")
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, 1, i), "."))).otherwise(F.array().cast("array<string>"))


def path_key(path: Column) -> Column:
    """Sort key: paths order by component."""
    return F.split(path, "/")


def in_scope(id: Column, scope: str, sep: str = ".") -> Column:
    """The scope itself and all below it."""
    return (id == scope) | id.startswith(scope + sep)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty line is not one."""
    parts = F.split(text, r"\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def size_bucket(nodes: Column) -> Column:
    return F.when(nodes <= SMALL, "small").when(nodes <= MEDIUM, "medium").otherwise("large")


def marker_terms(fingerprint: Column, nodes: Column) -> Column:
    found = [F.when(_any([F.contains(fingerprint, F.lit(p)) for p in parts]), F.lit(name)) for name, parts in MARKERS]
    return F.array_sort(F.filter(F.array(*found, F.concat(F.lit("size:"), size_bucket(nodes))), lambda x: x.isNotNull()))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def shape_terms(kinds: Column) -> Column:
    """node:k for each kind and edge:a>b for each neighbouring pair."""
    nodes = F.transform(kinds, lambda k: F.concat(F.lit("node:"), k))
    n = F.size(kinds)
    edges = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat(F.lit("edge:"), F.get(kinds, i), F.lit(">"), F.get(kinds, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(nodes, edges)))


def name_terms(name: Column) -> Column:
    """Lower-case parts of at least three characters; parts end before capitals and at other signs."""
    parts = F.split(F.regexp_replace(name, r"(?<=.)(?=[A-Z])", " "), r"[^A-Za-z0-9]+")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, F.lower), lambda x: F.length(x) >= 3)))


def jaccard(a: Column, b: Column) -> Column:
    """0 when both sets are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def round3(x: Column) -> Column:
    return F.round(x * F.lit(1000.0), 0) / F.lit(1000.0)


def occurrences(text: Column, part: str) -> Column:
    """Occurrences that don't overlap."""
    return F.regexp_count(text, F.lit("".join("\\" + c if not c.isalnum() and c != "_" else c for c in part)))


#: Folders and file-name ends of tests.
TEST_FOLDERS = ("tests", "__tests__")
TEST_ENDS = ("_test.go", "_test.rs", "_tests.rs", ".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx")
TEST_NAMES = ("tests.rs",)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_test_path(path: Column) -> Column:
    """Paths whose items count for nothing in duplicates and patterns."""
    base = base_name(path)
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TEST_FOLDERS))) | base.isin(*TEST_NAMES) | _any([base.endswith(e) for e in TEST_ENDS])


def language(path: Column) -> Column:
    """Language by suffix; null for files without an item parser."""
    ext = F.substring_index(path, ".", -1)
    return F.when(ext == "rs", "rust").when(ext == "go", "go").when(ext.isin("ts", "tsx"), "typescript")


def is_test_file(path: Column) -> Column:
    """What a language takes for a test file; not the same as is_test_path."""
    base, parts = base_name(path), F.split(path, "/")
    rust = F.array_contains(parts, "tests") | (F.regexp_replace(base, r"(?<=.)\.[^.]*$", "") == "tests")
    script = F.array_contains(parts, "tests") | _any([base.endswith(e) for e in TEST_ENDS if e.endswith((".ts", ".tsx"))])
    return F.when(language(path) == "rust", rust).when(language(path) == "go", base.endswith("_test.go")).when(language(path) == "typescript", script).otherwise(F.lit(False))


def is_review_surface(path: Column, public: Column, name: Column, kind: Column) -> Column:
    return ~is_test_file(path) & (public | ((name == "main") & (kind == "function")))


def longest_suffix(paths: Column, path: Column) -> Column:
    """The path itself if it is among ``paths`` (an array), else the one path that shares the longest run of last components, else the path unchanged."""
    own = F.reverse(F.split(path, "/"))
    run = lambda p: F.aggregate(
        F.zip_with(F.reverse(F.split(p, "/")), own, lambda a, b: F.coalesce(a == b, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, same: F.struct((s["n"] + F.when(s["on"] & same, 1).otherwise(0)).alias("n"), (s["on"] & same).alias("on")),
    )["n"]
    # a suffix must be the whole of the shorter path
    fits = F.filter(paths, lambda p: run(p) >= F.least(F.size(F.split(p, "/")), F.size(F.split(path, "/"))))
    best = F.array_max(F.transform(fits, run))
    at = F.filter(fits, lambda p: run(p) == best)
    return F.when(F.array_contains(paths, path), path).when(F.size(at) == 1, F.get(at, 0)).otherwise(path)


def owned_lines(text: Column) -> Column:
    return F.greatest(F.size(lines(text)), F.lit(1))


def import_alias(alias: Column, target: Column) -> Column:
    """An import's name: its alias, else the last part of its path; null for blank and dot imports."""
    name = F.coalesce(alias, F.element_at(F.split(target, "/"), -1))
    return F.when(~name.isin("_", "."), name)


#: Terms that say nothing, and markers that tell patterns apart.
NOISE = ("shape:call", "shape:member", "data:binding", "size:small", "size:medium")
DISCRIMINATORS = ("control:branch", "control:loop", "shape:closure", "flow:defer_or_try")


def is_noise(term: Column) -> Column:
    return term.isin(*NOISE)


def is_discriminator(term: Column) -> Column:
    return term.startswith("call:") | term.startswith("invoke:") | term.startswith("name:") | term.isin(*DISCRIMINATORS)


def call_names(calls: Column) -> Column:
    """qualifier::name, or the name alone, of an array of calls."""
    return F.transform(calls, lambda c: F.when(c["qualifier"].isNotNull(), F.concat(c["qualifier"], F.lit("::"), c["name"])).otherwise(c["name"]))


def match_terms(shape: Column, nodes: Column, name: Column, calls: Column, invocations: Column) -> Column:
    """Sorted distinct marker, name, call and invocation terms of an item."""
    tag = lambda t, xs: F.transform(xs, lambda x: F.concat(F.lit(t), x))
    return F.array_sort(F.array_distinct(F.concat(marker_terms(F.array_join(shape, ">"), nodes), tag("name:", name_terms(name)), tag("call:", call_names(calls)), tag("invoke:", invocations))))


#: The least shape and score of items that can be duplicates, and the node kinds that score.
DUPLICATE_NODES, DUPLICATE_SCORE = 24, 4
LOOPS = ("for_expression", "while_expression", "loop_expression", "for_statement")
BRANCHES = ("if_expression", "match_expression", "conditional_type", "switch_statement", "if_statement")
BINDINGS = ("let_declaration", "lexical_declaration", "variable_declarator", "short_var_declaration", "assignment_expression", "augmented_assignment_expression")
CLOSURES = ("closure_expression", "arrow_function", "func_literal", "anonymous_function")


def _count(fingerprint: Column, kinds: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for k in kinds:
        out = out + occurrences(fingerprint, k)
    return out


def substantive_score(shape: Column, calls: Column, invocations: Column) -> Column:
    """Calls and invocations, one more if a call isn't a plain name, and each place a scoring kind stands in the fingerprint."""
    odd = F.exists(calls, lambda c: c["qualifier"].isNotNull() | (c["syntax"] != "identifier")).cast("int")
    return F.size(calls) + F.size(invocations) + odd + _count(F.array_join(shape, ">"), BRANCHES + LOOPS + BINDINGS + CLOSURES)


def is_substantive(shape: Column, nodes: Column, calls: Column, invocations: Column) -> Column:
    stateful = _count(F.array_join(shape, ">"), LOOPS + BINDINGS + CLOSURES) > 0
    return (nodes >= DUPLICATE_NODES) & (substantive_score(shape, calls, invocations) >= DUPLICATE_SCORE) & stateful
