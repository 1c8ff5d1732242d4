"""Views as JSON and text. Tables of any size are written by the executors; a tree is put together where it is shown."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that only a verbose view shows.
VERBOSE = ("body", "text", "shape", "calls", "invocations", "items", "matched", "missing", "shared", "verifying_tests", "unverified_tests", "module_ids")
#: A tree of more nodes than this is written, not shown.
MOST_NODES = 100_000


def projected(view: DataFrame, verbose: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The view, without bodies and long lists unless ``verbose``."""
    return view if verbose else view.drop(*[c for c in VERBOSE if c not in keep])


def write_json(view: DataFrame, path: str, verbose: bool = True) -> None:
    """One JSON object a line; null fields are left out."""
    projected(view, verbose).write.mode("errorifexists").option("ignoreNullFields", True).json(path)


def json_rows(view: DataFrame) -> DataFrame:
    """(json): each row as an object without its null fields."""
    return view.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in view.columns]), {"ignoreNullFields": "true"}).alias("json"))


def nested(view: DataFrame, id: str = "id", parent: str = "parent_id") -> list[dict]:
    """A flat tree as nested objects with ``children``, sorted by id. Stops if it has more than MOST_NODES nodes."""
    rows = json_rows(view).limit(MOST_NODES + 1).collect()
    if len(rows) > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes: write the view with write_json")
    nodes = sorted((json.loads(r[0]) for r in rows), key=lambda n: n[id])
    by_id = {n[id]: n for n in nodes}
    top = []
    for n in nodes:
        above = by_id.get(n.pop(parent, None))
        (top if above is None else above.setdefault("children", [])).append(n)
    return top


def json_document(view: DataFrame, verbose: bool = False, metrics: DataFrame | None = None, name: str = "nodes") -> str:
    """The tree, and one row of metrics if given, as indented JSON."""
    out: dict = {name: nested(projected(view, verbose))}
    if metrics is not None:
        out["metrics"] = metrics.first().asDict()
    return json.dumps(out, indent=2, ensure_ascii=False)


def _text(nodes: list[dict], depth: int) -> Iterator[str]:
    for n in nodes:
        marks = [k for k in ("planned", "deprecated", "unverified", "unimplemented") if n.get(k)]
        release = n.get("planned_release") or n.get("deprecated_release")
        head = f"{'  ' * depth}{n['id']}" + (f" [{n['kind']}]" if n.get("kind") not in (None, "spec", "module") else "")
        yield head + "".join(f" [{m}{' ' + release if release and m in ('planned', 'deprecated') else ''}]" for m in marks)
        if n.get("text"):
            yield f"{'  ' * (depth + 1)}{n['text']}"
        yield from _text(n.get("children", []), depth + 1)


def text_document(view: DataFrame, verbose: bool = False) -> str:
    """The tree as indented lines: id, kind, lifecycle and description."""
    return "\n".join(_text(nested(projected(view, verbose, ("text",))), 0))


def lint_text(diagnostics: DataFrame) -> Iterator[str]:
    """A line for each diagnostic, in order, and a summary; rows stream, so any number will do."""
    counts = {"error": 0, "warning": 0}
    for r in diagnostics.toLocalIterator():
        counts[r["severity"]] = counts.get(r["severity"], 0) + 1
        yield f"{r['severity']}: {r['path']}:{r['line']}: {r['message']}"
    yield f"{counts['error']} errors, {counts['warning']} warnings" if any(counts.values()) else "clean"
