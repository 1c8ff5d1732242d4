"""Comment blocks of source files, with the item each stands above. Files are independent, so one Arrow pass does."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The reserved tags.
TAGS = (
    "spec", "group", "planned", "deprecated", "verifies", "fileverifies", "attests", "fileattests",
    "module", "area", "implements", "fileimplements", "pattern", "strictness", "applies", "fileapplies",
)
TAG = re.compile(r"\s*@(?:" + "|".join(TAGS) + r")(?!\S)")
SCHEMA = "path string, block_no int, line int, text string, owned_line int, owned_body string"

_SLASH = re.compile(r"\s*//[/!]? ?(.*)", re.S)
_HASH = re.compile(r"\s*#(?:!.*| ?(.*))", re.S)
_STAR = re.compile(r"\s*\*? ?(.*)", re.S)


def split_lines(text: str) -> list[str]:
    parts = [p.removesuffix("\r") for p in text.split("\n")]
    return parts[:-1] if parts[-1] == "" else parts


def comment_runs(lines: list[str], hashes: bool) -> Iterator[tuple[int, list[str]]]:
    """(first line index, stripped texts) of each run of line comments and each block comment."""
    style = _HASH if hashes else _SLASH
    at = 0
    while at < len(lines):
        start, run = at, []
        while at < len(lines) and (m := style.fullmatch(lines[at])):
            run.append(m[1] or "")
            at += 1
        if not run and (opened := re.match(r"\s*/\*\*? ?", lines[at])):
            rest, closed = lines[at][opened.end() :], ""
            while not closed:
                inside, closed, _ = rest.partition("*/")
                run.append(_STAR.fullmatch(inside)[1])
                at += 1
                if at == len(lines):
                    break
                rest = lines[at]
        if run:
            yield start, run
        else:
            at += 1


def owned_item(lines: list[str], at: int, ext: str) -> tuple[int, str] | None:
    """(line number, body) of what follows a comment; None where that is another comment or nothing."""
    blank, comment = lambda s: not s.strip(), lambda s: s.lstrip().startswith("#")
    start = at
    for skipped in (blank, comment, blank) if ext == "sh" else (blank,):
        start = next((k for k in range(start, len(lines)) if not skipped(lines[k])), len(lines))
    if start == len(lines) or ext != "sh" and lines[start].lstrip().startswith("#" if ext == "py" else ("//", "/*")):
        return None
    size = {"sh": _to_end, "py": _indented}.get(ext, _braced)(lines[start:])
    return start + 1, "\n".join(lines[start : start + size]).rstrip()


def _to_end(lines: list[str]) -> int:
    return len(lines)


def _indented(lines: list[str]) -> int:
    if not lines[0].rstrip().endswith(":"):
        return 1
    width = lambda s: len(s) - len(s.lstrip())
    ends = (k for k, s in enumerate(lines) if k and s.strip() and width(s) <= width(lines[0]) and s.lstrip()[0] not in "@#")
    return next(ends, len(lines))


def _braced(lines: list[str]) -> int:
    """To the brace that closes the first one; without braces, to a line that can't go on."""
    depth, opened = 0, False
    for k, s in enumerate(lines, 1):
        depth += s.count("{") - s.count("}")
        opened |= "{" in s
        t = s.strip()
        if opened:
            if depth <= 0:
                return k
        elif t and not t.startswith(("#[", "@")) and t[-1] not in ",([=" and (t[-1] == ";" or "(" not in t):
            return k
    return len(lines)


def blocks_of(path: str, text: str | None) -> list[tuple]:
    """Rows of SCHEMA for the blocks with a reserved tag; null and empty texts have none."""
    ext, lines, out, number = path.rsplit(".", 1)[-1], split_lines(text or ""), [], 0
    for start, run in comment_runs(lines, ext in ("sh", "py")):
        if any(map(TAG.match, run)):
            owned = owned_item(lines, start + len(run), ext) or (None, None)
            out += [(path, number, start + k + 1, t, *owned) for k, t in enumerate(run)]
            number += 1
    return out


def comment_blocks(files: DataFrame) -> DataFrame:
    """One row a line of the comment blocks that hold a reserved tag, from (path, text)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b["path"].to_pylist(), b["text"].to_pylist(), strict=True):
                if rows := blocks_of(path, text):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.where("path IS NOT NULL").select("path", "text").mapInArrow(run, SCHEMA)
