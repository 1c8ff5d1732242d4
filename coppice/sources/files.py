"""Source trees as tables: one row a file, without ignored paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The suffixes of source files, and of declarations in prose.
SOURCE = ("rs", "go", "ts", "tsx", "sh", "py")
PROSE = ("md",)


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Patterns with wild cards are globs over the whole relative path; others name a file or a folder. Blank ones count for nothing."""
    out = F.lit(False)
    for p in filter(None, (p.strip() for p in patterns)):
        if set(p) & set("*?[{"):
            out = out | path.rlike(glob_regex(p))
        else:
            p = p.rstrip("/")
            out = out | (path == p) | path.startswith(p + "/")
    return out


def glob_regex(glob: str) -> str:
    """* and ? match any characters, slashes too; {a,b} and [..] as usual; ** followed by / matches nothing too."""
    out, at, depth = "", 0, 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
            continue
        if c == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            inner = glob[at + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            at = end + 1
            continue
        depth += (c == "{") - (c == "}" and depth > 0)
        out += {"*": ".*", "?": ".", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else c if c.isalnum() or c in "_/" else "\\" + c)
        at += 1
    return f"^{out}$"


def vcs_rules(folder: str, text: str) -> list[tuple[str, bool]]:
    """(regex over relative paths, whether it ignores) of the lines of an ignore file in a folder ("" is the root), in order."""
    out, at = [], glob_literal(folder + "/") if folder else ""
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        ignores = not line.startswith("!")
        line = line.lstrip("!").removeprefix("\\")
        only_folders, body = line.endswith("/"), line.strip("/")
        anchored = "/" in line.rstrip("/")
        if body:
            out.append((f"^{at}{'' if anchored else '(?:.*/)?'}{vcs_glob(body)}{'/.*' if only_folders else '(?:/.*)?'}$", ignores))
    return out


def glob_literal(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_/" else "\\" + c for c in text)


def vcs_glob(glob: str) -> str:
    """An ignore file's glob: * and ? stay within a folder, ** goes through folders."""
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif glob.startswith("**", at):
            out, at = out + ".*", at + 2
        elif c == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            inner = glob[at + 1 : end]
            out, at = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            out, at = out + {"*": "[^/]*", "?": "[^/]"}.get(c, glob_literal(c)), at + 1
    return out


def vcs_ignored(path: Column, rules: Sequence[tuple[str, bool]]) -> Column:
    """The last rule that fits decides."""
    out = F.lit(False)
    for regex, ignores in rules:
        out = F.when(path.rlike(regex), F.lit(ignores)).otherwise(out)
    return out


#: Ignore files, and folders of version control itself.
IGNORE_FILES = (".gitignore", ".jjignore")
VCS_FOLDERS = (".git", ".jj")


def _qualified(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(path)


def hidden_files(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """What Spark's own listing leaves out: ignore files, and source files in hidden places, as full paths.

    Walks folders through the store's own listing, so it works wherever Spark reads.
    """
    fs, at = _qualified(spark, root)
    ignores, sources, folders = [], [], [(at, False)]
    while folders:
        folder, hidden = folders.pop()
        for s in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName()):
            name, full = s.getPath().getName(), s.getPath().toString()
            odd = hidden or name.startswith((".", "_"))
            if s.isDirectory():
                if name not in VCS_FOLDERS:
                    folders.append((s.getPath(), odd))
            elif name in IGNORE_FILES:
                ignores.append(full)
            elif odd and name.rsplit(".", 1)[-1] in SOURCE + PROSE:
                sources.append(full)
    return sorted(ignores), sorted(sources)


def _content(spark: SparkSession, path: str) -> bytes:
    """The bytes of one small file, through the store's own reader."""
    fs, at = _qualified(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_files(spark: SparkSession, root: str, ignore: Sequence[str] = (), vcs: bool = True) -> DataFrame:
    """(path, ext, kind, text, valid) of source and prose files below root; paths are relative to it.

    Files that ignore files (``vcs``) or the patterns leave out have no row; hidden ones have. Suffixes are filtered
    before contents are read, so other files cost a listing only. Bytes that aren't UTF-8 become replacement signs,
    and ``valid`` is false. Files of no bytes have no row (Spark's file scan leaves them out); they hold no facts.
    """
    fs, at = _qualified(spark, root)
    base = at.toString().rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(SOURCE + PROSE) + "}").load(at.toString())
    rules = []
    if vcs:
        lists, hidden = hidden_files(spark, root)
        plain = [p for p in hidden if not p.rpartition("/")[2].startswith((".", "_"))]
        raw = raw.select("path", "content")
        if plain:
            raw = raw.unionByName(spark.read.format("binaryFile").load(plain).select("path", "content")).dropDuplicates(["path"])
        if odd := [(p, bytearray(_content(spark, p))) for p in hidden if p not in set(plain)]:  # Spark reads no file of such a name
            raw = raw.unionByName(spark.createDataFrame(odd, "path string, content binary"))
        texts = {p: _content(spark, p).decode("utf-8", "replace") for p in lists}
        # outer ignore files first, so that inner ones decide
        for full in sorted(lists, key=lambda p: (p.count("/"), p)):
            rules += vcs_rules(full[len(base) :].rpartition("/")[0], texts.get(full, ""))
    rel = F.when(F.col("path").startswith(base), F.substring("path", len(base) + 1, 1 << 30)).otherwise(F.col("path"))
    ext, text = F.substring_index("rel", ".", -1), F.col("content").cast("string")
    named = raw.select(rel.alias("rel"), "content").where(~ignored(F.col("rel"), ignore) & ~vcs_ignored(F.col("rel"), rules))
    return named.select(F.col("rel").alias("path"), ext.alias("ext"), F.when(ext.isin(*PROSE), "markdown").otherwise("source").alias("kind"), F.make_valid_utf8(text).alias("text"), F.is_valid_utf8(text).alias("valid"))
