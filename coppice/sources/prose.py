"""Declarations in prose files, as sections like those of comment blocks. Files are independent, so one Arrow pass does."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .comments import TAGS, split_lines

SCHEMA = "path string, block_no int, line int, keyword string, rest string, text string, prose array<struct<line:int,text:string>>, marker string, marker_rest string, marker_line int, owned_line int, owned_body string"

_TAG = re.compile(r"@(" + "|".join(TAGS) + r")(?:\s+(.*))?$", re.S)
_BOUNDARY = re.compile(r"[@\\][A-Za-z]")
_FENCE = re.compile(r"\s*(```|~~~)")
#: Tags that only a heading can declare, and the markers that may follow them.
_HEADED = {"spec": ("planned", "deprecated"), "group": ("planned", "deprecated"), "module": ("planned",), "area": ("planned",), "pattern": ("strictness",)}


def plain(line: str) -> str:
    """A line without its quote sign, heading signs, bullet and back-ticks."""
    s = line.strip().removeprefix(">").lstrip().lstrip("#").lstrip()
    s = s[2:] if s.startswith(("- ", "* ")) else s
    if len(s) > 1 and s[0] == s[-1] == "`":
        s = s[1:-1]
    return s.strip()


def sections_of(path: str, text: str | None) -> list[tuple]:
    """Rows of SCHEMA: declarations in headings, file attestations, and applications, which prose can't hold."""
    lines, out, fenced, at = split_lines(text or ""), [], False, 0
    while at < len(lines):
        raw = lines[at]
        if _FENCE.match(raw):
            fenced = not fenced
        m = None if fenced or _FENCE.match(raw) else _TAG.match(plain(raw))
        at += 1
        if not m:
            continue
        number = at
        tag, rest = m[1], (m[2] or "").strip()
        if tag in _HEADED:
            if not raw.lstrip().startswith("#"):
                continue
            # claims look at the very next line for a marker, modules and patterns at the next that isn't blank
            near = at
            while tag in ("module", "area", "pattern") and near < len(lines) and not lines[near].strip():
                near += 1
            mark = _TAG.match(plain(lines[near])) if near < len(lines) else None
            marker = (mark[1], (mark[2] or "").strip(), near + 1) if mark and mark[1] in _HEADED[tag] else (None, None, None)
            at = near + 1 if marker[0] else at
            prose, at = _description(lines, at)
        elif tag == "fileattests":
            marker = (None, None, None)
            prose, at = _description(lines, at)
        elif tag in ("applies", "fileapplies"):
            prose, marker = [], (None, None, None)
        else:
            continue
        out.append((path, -1, number, tag, rest, " ".join(t for _, t in prose), [{"line": n, "text": t} for n, t in prose], *marker, None, None))
    return out


def _description(lines: list[str], at: int) -> tuple[list[tuple[int, str]], int]:
    """(line number, text) from here to the first blank line after text or the next tag, without fenced code; and where it ends."""
    out, fenced = [], False
    while at < len(lines):
        raw, said = lines[at], plain(lines[at])
        if _FENCE.match(raw):
            fenced = not fenced
        elif not fenced:
            if not raw.strip() and out or _BOUNDARY.match(said):
                break
            if said and said[0] not in "@\\":
                out.append((at + 1, said))
        at += 1
    return out, at


def prose_sections(files: DataFrame) -> DataFrame:
    """Sections of (path, text); null and empty texts have none."""
    names = [c.split()[0] for c in re.sub(r"<[^ ]*>", "", SCHEMA).split(", ")]
    said = pa.list_(pa.struct([("line", pa.int32()), ("text", pa.string())]))
    i, t = pa.int32(), pa.string()
    kinds = [t, i, i, t, t, t, said, t, t, i, i, t]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b["path"].to_pylist(), b["text"].to_pylist(), strict=True):
                if rows := sections_of(path, text):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.where("path IS NOT NULL").select("path", "text").mapInArrow(run, SCHEMA)
