"""Annotation facts of a small source tree, and the block scanner on odd texts."""

import pytest

from coppice.functions import annotations as A
from coppice.sources import comments, files

RUST = """\
//! @fileimplements APP.CORE

/// @spec APP.LOGIN @planned 0.3.0
/// Users can
///
/// log in.
/// @param ignored text
/// @spec APP.LOGOUT
/// @deprecated
/// They can leave.

/**
 * @module APP.CORE
 * The core.
 */
// @verifies APP.LOGIN
// @verifies APP.LOGOUT
#[test]
fn logs_in() {
    if true { check(); }
}
fn other() {}
// @specs NOT.A.TAG
"""
PYTHON = """\
# @group APP
# All of it.
# @pattern APP.SHAPE
#
# @strictness high
# A shape.

# @applies APP.SHAPE
def f(x):

    return x
y = 1
# @verifies APP.LOST
"""


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "src").mkdir()
    (root / "skip").mkdir()
    (root / "src/a.rs").write_text(RUST)
    (root / "b.py").write_text(PYTHON)
    (root / "empty.go").write_text("")
    (root / "skip/c.rs").write_text("// @spec SKIPPED\n")
    (root / "notes.txt").write_text("// @spec NOT.READ\n")
    found = files.read_files(spark, str(root), ["skip/", " "])
    return found, A.tag_sections(comments.comment_blocks(found))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_files(tree):
    # empty.go has no bytes, so no row
    assert rows(tree[0], "path", "ext", "kind") == [("b.py", "py", "source"), ("src/a.rs", "rs", "source")]


def test_specs(tree):
    got = rows(A.specs(tree[1]), "id", "kind", "text", "planned", "planned_release", "deprecated", "path", "line")
    assert got == [
        ("APP", "group", "All of it.", False, None, False, "b.py", 1),
        ("APP.LOGIN", "spec", "Users can log in.", True, "0.3.0", False, "src/a.rs", 3),
        ("APP.LOGOUT", "spec", "They can leave.", False, None, True, "src/a.rs", 8),
    ]


def test_modules_and_patterns(tree):
    assert rows(A.modules(tree[1]), "id", "kind", "text", "line") == [("APP.CORE", "module", "The core.", 13)]
    assert rows(A.patterns(tree[1]), "pattern_id", "strictness", "text", "line") == [("APP.SHAPE", "high", "A shape.", 3)]


def test_references(tree):
    found, sections = tree
    assert rows(A.verifies(sections, found), "spec_id", "body_line", "body") == [("APP.LOGIN", 18, "#[test]\nfn logs_in() {\n    if true { check(); }\n}")]
    assert rows(A.implements(sections, found), "module_id", "body_line", "body") == [("APP.CORE", None, RUST.rstrip())]
    assert rows(A.applications(sections, found), "pattern_id", "body_line", "body") == [("APP.SHAPE", 9, "def f(x):\n\n    return x")]


def test_diagnostics(tree):
    assert rows(A.diagnostics(tree[1]), "severity", "path", "line", "message") == [
        ("error", "b.py", 13, "@verifies must attach to the next supported item"),
        ("error", "src/a.rs", 17, "annotation block may contain only one @verifies"),
    ]


def test_scanner_on_odd_texts():
    assert comments.split_lines("a\r\nb\n\n") == ["a", "b", ""]
    assert comments.blocks_of("x.rs", None) == comments.blocks_of("x.rs", "") == []
    assert comments.blocks_of("x.ts", "/* @spec A */ let x;") == [("x.ts", 0, 1, "@spec A ", None, None)]
    assert comments.blocks_of("x.go", "/* one\n@area B") == [("x.go", 0, 1, "one", None, None), ("x.go", 0, 2, "@area B", None, None)]
    assert comments.blocks_of("x.sh", "#!/bin/sh\n# @verifies A\n\nls\n")[1] == ("x.sh", 0, 2, "@verifies A", 4, "ls")
    assert comments.blocks_of("x.rs", "// @verifies A\nstruct B;\nmore")[0][4:] == (2, "struct B;")
    assert files.glob_regex("a/*.{rs,go}") == r"^a/.*\.(?:rs|go)$"


def test_empty_table(spark):
    none = spark.createDataFrame([], "path string, text string")
    s = A.tag_sections(comments.comment_blocks(none))
    assert A.specs(s).count() == A.verifies(s, none).count() == A.diagnostics(s).count() == 0
