"""Files, configuration, sinks and the cache on small trees."""

import json
import os

import pytest
from pyspark.sql import functions as F

from coppice.operators import calls, relational
from coppice.plans import fixtures, sinks
from coppice.sources import cache, config, files, syntax


def write(root, tree):
    for p, t in tree.items():
        at = root / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(t if isinstance(t, bytes) else t.encode())


def test_files_of_a_tree(spark, tmp_path):
    write(tmp_path / "src", {
        "a.rs": "fn a() {}\n", "foo/src/a.rs": "fn b() {}\n", "b.txt": "no", "bad.rs": b"fn \xff() {}\n", ".hid/c.rs": "fn c() {}\n", "out/gen.rs": "x", "out/keep.rs": "y", "deep/out/z.rs": "z", "n.md": "# x\n", "skip/q.py": "q", "_own.go": "func x() {}",
        ".gitignore": "/out/*\n!/out/keep.rs\n# note\n\nskip/\n", "deep/.gitignore": "*.rs\n", ".git/x.rs": "no",
    })
    got = {r["path"]: r for r in files.read_files(spark, os.path.relpath(tmp_path / "src")).collect()}
    assert sorted(got) == [".hid/c.rs", "_own.go", "a.rs", "bad.rs", "foo/src/a.rs", "n.md", "out/keep.rs"]
    assert got["n.md"]["kind"] == "markdown" and got["a.rs"]["valid"] and not got["bad.rs"]["valid"] and "�" in got["bad.rs"]["text"]
    assert got["a.rs"]["text"] == "fn a() {}\n" and got["foo/src/a.rs"]["text"] == "fn b() {}\n"
    assert files.read_files(spark, str(tmp_path / "src"), ["foo", "*.md"], vcs=False).where("path LIKE 'foo%' OR ext = 'md'").count() == 0


def test_configuration(tmp_path):
    c = config.parse_config('version = "1"\nignore = ["a", "b/*"]\n[health]\nignore-unexplained = ["x/**"]\n[patterns.metrics]\nhigh = 0.7\n[toolchain]\nmanager = "mise"\n')
    assert (c.dialect, c.ignore, c.ignore_unexplained, c.manager, c.benchmarks.high, c.benchmarks.low) == (1, ("a", "b/*"), ("x/**",), "mise", 0.7, 0.2)
    for text, said in [
        ("colour = 1\n", "line 1 uses unknown key `colour`"), ('\nversion = "2"\n', "line 2 uses unsupported version"), ('root = " "\n', "empty root"), ('ignore = [""]\n', "empty ignore pattern"),
        ("[patterns.metrics]\nhigh = 0.1\n", "ordered"), ("[patterns.metrics]\nlow = 1.5\n", "decimals"), ("[toolchain]\nmanager = \"x\"\n", "line 1 uses unsupported toolchain"), ("a = = 1\n", "line 1"),
    ]:
        with pytest.raises(ValueError, match=said.replace("[", r"\[")):
            config.parse_config(text)
    write(tmp_path, {"p/coppice.toml": 'root = "inner"\n', "p/inner/deep/x.rs": "", "v/.git/HEAD": "", "v/sub/x.rs": ""})
    r = config.find_root(str(tmp_path / "p/inner/deep"))
    assert (r.source, r.path, r.warning()) == ("config", str(tmp_path / "p/inner"), None) and r.diagnostics("coppice.toml")[0][0] == "warning"
    v = config.find_root(str(tmp_path / "v/sub"))
    assert (v.source, v.path, v.config.dialect) == ("vcs", str(tmp_path / "v"), 0) and "inferred VCS root" in v.warning()


def test_documents(spark, tmp_path):
    r = fixtures.repository(spark, fixtures.DEMO)
    doc = json.loads(sinks.json_document(r.specs(), True, r.spec_metrics()))
    assert [n["id"] for n in doc["nodes"]] == ["DEMO"] and [n["id"] for n in doc["nodes"][0]["children"]] == ["DEMO.BARE", "DEMO.LIVE", "DEMO.NEXT", "DEMO.OLD", "DEMO.REVIEWED"]
    assert doc["metrics"]["total_specs"] == 5 and "planned_release" not in doc["nodes"][0]
    assert "text" not in json.loads(sinks.json_document(r.specs()))["nodes"][0]
    text = sinks.text_document(r.specs()).split("\n")
    assert text[0] == "DEMO [group]" and "  DEMO.NEXT [planned 0.3.0]" in text and "  DEMO.OLD [deprecated 0.6.0]" in text
    said = list(sinks.lint_text(r.lint()))
    assert said[0].startswith("error: arch.md:7:") and said[-1] == "5 errors, 0 warnings"
    sinks.write_json(r.modules(), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_cache_parses_only_new_files(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def facts(rows):
        seen.add(rows.count())
        return syntax.items(rows).select("path", "name", "start_line")

    tree = {"a.rs": "fn a() {}\n", "b.rs": "fn b() {}\n", "c.rs": "// nothing\n"}
    first = cache.cached_facts(fixtures.files(spark, tree), str(tmp_path / "c"), facts)
    assert sorted(r["name"] for r in first.collect()) == ["a", "b"] and seen.value == 3
    tree |= {"b.rs": "\nfn b2() {}\n", "d.rs": "fn d() {}\n"}
    second = cache.cached_facts(fixtures.files(spark, tree), str(tmp_path / "c"), facts)
    assert sorted((r["name"], r["start_line"]) for r in second.collect()) == [("a", 1), ("b2", 2), ("d", 1)] and seen.value == 5


def test_duplicates_count_null_keys(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "")], "id int, t string")
    got = relational.duplicates(rows, [F.col("t")]).collect()
    assert sorted((r["id"], r["peer_count"]) for r in got) == [(1, 1), (2, 1)]


def test_odd_files_have_no_items(spark):
    tree = {"a.rs": "fn (", "b.go": "func", "c.ts": "export class", "d.rs": "}}}", "e.rs": "/* open", "f.rs": 'fn f() { "unclosed }', "g.rs": ""}
    assert [r["name"] for r in syntax.items(fixtures.files(spark, tree)).collect()] in ([], ["f"])
    none = fixtures.files(spark, {"a.rs": "x"}).limit(0)
    assert syntax.items(none).count() == 0 and calls.edges(syntax.items(none), syntax.file_imports(none)).count() == 0


def test_rest_imports_without_the_corpus_operators(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(root / "coppice", tmp_path / "coppice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
