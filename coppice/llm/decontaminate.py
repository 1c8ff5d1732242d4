"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items form one suffix automaton. Document words stream through it;
at every word the state gives the longest run of words, ending there, that some item contains.
A run that covers a window (``window`` words in a row of one item, or the whole of a shorter
item) is a hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, map_batches, texts, words_of, written

#: Words of benchmark items in one automaton (about 0.5 KB each); more items go in further passes.
BLOCK_WORDS = 200_000

_RUN = re.compile(rb"[^ ]+")


class SuffixAutomaton:
    """All substrings (in words) of a set of items.

    ``window_of[s]`` is the state of the last ``window`` words of state s; ``items_of`` has the
    items that contain them. ``short_of[s]`` has (words, item) of the short items that end here.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.window_of = [-1] * len(order)
        for s in order:
            if self.length[s] >= window:
                self.window_of[s] = s if self.length[self.link[s]] < window else self.window_of[self.link[s]]
        self.items_of: dict[int, set[str]] = {}
        ends: dict[int, list[tuple[int, str]]] = {}
        for item, words in items:
            if not words:
                continue
            for s, n in self.walk(words):
                if n >= window:
                    self.items_of.setdefault(self.window_of[s], set()).add(item)
            if len(words) < window:
                ends.setdefault(s, []).append((len(words), item))
        self.short_of: list[tuple[tuple[int, str], ...]] = [()] * len(order)
        for s in order[1:]:
            above = self.short_of[self.link[s]]
            self.short_of[s] = (*above, *ends[s]) if s in ends else above
        self.least = min([window, *(n for x in ends.values() for n, _ in x)])

    def _new(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, w: bytes) -> int:
        c = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:  # an earlier item went this way
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def walk(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """State and longest matching length after each word."""
        moves, link, length, s, n = self.next, self.link, self.length, 0, 0
        for w in words:
            t = moves[s].get(w)
            if t is None:
                while t is None and s:
                    s = link[s]
                    t = moves[s].get(w)
                if t is None:
                    n = 0
                    yield 0, 0
                    continue
                n = length[s]
            s, n = t, n + 1
            yield s, n

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Merged [start, end) word spans inside windows, the items they come from, the longest match."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        longest, least, window, short_of = 0, self.least, self.window, self.short_of
        for i, (s, n) in enumerate(self.walk(words), 1):
            if n < least:
                continue
            longest, reach = max(longest, n), 0
            if n >= window:
                reach = window
                found |= self.items_of[self.window_of[s]]
            for k, item in short_of[s]:
                if k <= n:
                    reach = max(reach, k)
                    found.add(item)
            if reach:
                start = i - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        return spans, found, longest


def _blocks(items: Iterator[tuple[str, bytes]], most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for item, text in items:
        words = words_of(text)
        if block and size + len(words) > most:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    yield block


def find_spans(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = (), block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Word spans of each document that lie inside benchmark windows.

    Returns id_col, the columns in ``keep``, n_words, n_hit, spans (of words, end exclusive),
    items (sorted as text), longest (match in words) and coverage, a row for each document.
    Null and empty texts have no words, so no hits; null or empty items match nothing; equal
    items count each by id; rows that repeat are judged alike; other columns are ignored. An empty
    table of documents gives no rows; an empty benchmark, no hits. A text takes its words' memory, once a batch.

    Items are a query set: they pass the driver in blocks of at most ``block_words`` words, and
    each block is one broadcast and one pass over the documents. With more than one block, only hits are
    written in between.
    """
    columns = list(dict.fromkeys([id_col, *keep]))
    out = _scanned(docs, benchmark, window, columns, id_col, text_col, item_col, item_text_col, block_words)
    return out.select(*columns, "n_words", "n_hit", "spans", "items", "longest", "coverage")


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, columns: list[str], id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS, cutting: bool = False) -> DataFrame:
    """find_spans, with __text: the text, with ``cutting`` without its spans. The last pass over the texts cuts as it scans, so a task has one worker."""
    spark = docs.sparkSession
    rows = benchmark.where(F.col(item_text_col).isNotNull()).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(item_text_col))
    text = F.col(text_col).alias("__text")
    found = [F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).alias("longest")]
    blocks = _blocks(((r[0], r[1].encode()) for r in rows.toLocalIterator()), block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        out = docs.select(*columns, text, *found)
        out = map_batches(out, _scanner(spark.sparkContext.broadcast(SuffixAutomaton(first, window)), cutting), out.schema)
    else:
        # a pass a block reads the texts and writes the hits only, which then meet their documents once
        key = [F.xxhash64(F.col(id_col), F.col(text_col)).alias("__ra"), F.xxhash64(F.lit(7), F.col(id_col), F.col(text_col)).alias("__rb")]
        hits = None
        for block in chain([first, second], blocks):
            sent = spark.sparkContext.broadcast(SuffixAutomaton(block, window))
            part = docs.select(*key, text, *found)
            part = map_batches(part, _scanner(sent), part.schema).where(F.size("spans") > 0).drop("__text", "n_words").dropDuplicates(["__ra", "__rb"])
            part = written(part, "decontaminate")
            sent.unpersist()
            hits = part if hits is None else hits.unionByName(part)
        hits = hits.groupBy("__ra", "__rb").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.max("longest").alias("longest"))
        out = docs.select(*columns, text, *key).join(hits, ["__ra", "__rb"], "left").select(*columns, "__text", F.lit(0).cast("long").alias("n_words"), "spans", "items", F.coalesce("longest", F.lit(0)).alias("longest"))
        out = map_batches(out, _scanner(None, cutting), out.schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    return out.select(*columns, "__text", "n_words", n_hit.alias("n_hit"), "spans", "items", "longest").withColumn("coverage", F.when(F.col("n_words") > 0, F.col("n_hit") / F.col("n_words")).otherwise(F.lit(0.0)))


SPANS = "array<struct<start:int,end:int>>"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanner(automaton, cutting: bool = False):
    """Adds what the automaton (None: nothing) finds to the spans, items and longest match that a row has; with ``cutting`` the spans leave the text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = automaton.value.hits if automaton else lambda _: ([], set(), 0)
        for batch in batches:
            words, spans, items, longest, left = [], [], [], [], []
            before = zip(batch["spans"].to_pylist(), batch["items"].to_pylist(), batch["longest"].to_pylist(), strict=True)
            for k, (text, (s0, i0, l0)) in enumerate(zip(texts(batch["__text"]), before, strict=True)):
                w = words_of(text)
                s, i, n = hits(w)
                if s0:
                    s = _merged([*s, *((x["start"], x["end"]) for x in s0)])
                words.append(len(w))
                spans.append([{"start": x, "end": y} for x, y in s])
                items.append(sorted(i | set(i0 or ())))
                longest.append(max(n, l0))
                if cutting:
                    left.append(cut(text, s).decode() if s else batch["__text"][k].as_py())
            new = {"n_words": words, "spans": spans, "items": items, "longest": longest} | ({"__text": left} if cutting else {})
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(k) for k, f in enumerate(batch.schema)], schema=batch.schema)

    return scan


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _RUN.finditer(text.translate(WORD_BYTES))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """Documents without benchmark spans, in their own columns.

    A document whose share of hit words is over ``max_coverage`` goes; of the others the hit
    spans are cut out and length_col (if there) follows. Documents without a hit, null texts
    among them, stay as they are.
    """
    rows = docs.withColumn("__all", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    out = _scanned(rows, benchmark, window, ["__all"], "__all", text_col, cutting=True).where(F.col("coverage") <= max_coverage)
    hit = F.size("spans") > 0
    return out.select(*[
        F.when(hit, F.col("__text")).otherwise(F.col(f"__all.`{c}`")).alias(c) if c == text_col
        else F.when(hit, F.char_length("__text").cast(dict(docs.dtypes)[c])).otherwise(F.col(f"__all.`{c}`")).alias(c) if c == length_col
        else F.col(f"__all.`{c}`").alias(c)
        for c in docs.columns
    ])


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH it AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
win AS (
  SELECT item, 10 AS n, array_to_string(w[i:i + 9], ' ') AS s FROM it, unnest(range(1, len(w) - 8)) AS r(i) WHERE len(w) >= 10
  UNION ALL
  SELECT item, len(w) AS n, array_to_string(w, ' ') AS s FROM it WHERE len(w) BETWEEN 1 AND 9),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
found AS (
  SELECT x.doc_id, x.i, win.n, win.item FROM (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
      SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)) x
  JOIN win ON win.n = x.n AND win.s = x.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
