"""Packing of token sequences by best-fit decreasing.

A document longer than the window is first cut into full windows, which are sequences of their
own. What is left of each document goes, longest first, into the open window with the tightest
remaining capacity; a segment tree over capacities finds it. Every input partition packs its
own documents, so no row is shuffled.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .token_count import BYTE_SIGNS, library_ids, load

#: Remainders that a task packs together, whatever columns are asked for; a full set is packed and the next one begun.
PACK_ROWS = 50_000


class CapacityTree:
    """Segment tree whose leaf c has the open windows with c free places."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.open = [0] * (2 * self.width)
        self.windows: list[list[int]] = [[] for _ in range(self.width)]

    def add(self, free: int, window: int) -> None:
        self.windows[free].append(window)
        k = free + self.width
        while k:
            self.open[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest window with at least ``need`` free places, as (free, window)."""
        k = need + self.width
        if not self.open[k]:
            while k > 1 and (k & 1 or not self.open[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.width:
                k = 2 * k if self.open[2 * k] else 2 * k + 1
        free = k - self.width
        window = self.windows[free].pop()
        while k:
            self.open[k] -= 1
            k >>= 1
        return free, window


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """For each piece its window and offset, and the number of windows; ties keep their order."""
    tree, n = CapacityTree(size), 0
    window, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        got = tree.take(lengths[i])
        if got is None:
            got, n = (size, n), n + 1
        free, window[i] = got
        offset[i] = size - free
        if free > lengths[i]:
            tree.add(free - lengths[i], window[i])
    return window, offset, n


#: Pre-tokens and words whose ids a worker keeps; it starts anew beyond that.
KEPT_IDS = 400_000

#: Characters on which lower-casing, composition and pre-tokens can't differ between libraries:
#: Latin and Cyrillic letters without marks of their own, their signs, and dashes and quotes.
PLAIN = re.compile("[\\x00-\u017f\u0400-\u0481\u048a-\u04ff\u2010-\u2027]*")

#: The pre-tokens of word_bpe_49k for lower-cased plain text.
PRE_TOKEN = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f\u0400-\u0481\u048a-\u04ff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\\t-\\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f\u0400-\u0481\u048a-\u04ff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)


class PreTokenIds(dict):
    """Lower-cased plain pre-token -> its ids as little-endian 32-bit words, from the library's merges alone."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, part: str) -> bytes:
        if len(self) >= KEPT_IDS:
            self.clear()
        signs = part if part.isascii() else part.encode().decode("latin-1")
        ids = array("I", [t.id for t in self.model.tokenize(signs.translate(BYTE_SIGNS))]).tobytes()
        if len(part) < 100:
            self[part] = ids
        return ids


class TextIds(dict):
    """Ids of texts as little-endian 32-bit words; as a dict, those of words that aren't plain.

    Plain text is lower-cased and parted as the tokenizer does, and each part goes through its merges. Words
    that aren't plain go to the library, and so do those that hold one of its added strings in any case, since
    it looks for them in the raw text. ``fast`` is off for a tokenizer that does something else (see agrees),
    and then the library takes each text whole.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.added = [t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()]
        self.parts = PreTokenIds(tokenizer.model)
        self.fast = all(" " not in a and "\n" not in a for a in self.added)
        self.fast = self.fast and self.agrees()

    def agrees(self) -> bool:
        """Whether the parts give the library's ids on texts that hold every kind of pre-token."""
        probes = ["It's We'LL they'Re I'd I'm you'VE can'T", "  two  spaces\n\nlines\r\n\ttab\x0b\x0c\x1c\x1f\x85\xa0.", "Σςσ e\u0301 日本語 x", "İstanbul \u2013 “q”… ЁЖ й"]
        probes += ["".join(f"{chr(c)} a{chr(c)}b " for c in range(1, 0x180)), "".join(map(chr, range(33, 127))), "".join(map(chr, range(0x400, 0x482)))]
        return all(self.of(p) == self.library(p) for p in [*probes, *(f"X{a.upper()}y{a}" for a in self.added)])

    def library(self, text: str) -> bytes:
        return array("I", library_ids(self.tokenizer, text)).tobytes()

    def plain(self, text: str) -> bytes | None:
        """The ids of plain text without added strings; None for other texts."""
        if not (text.isascii() or PLAIN.fullmatch(text)):
            return None
        low = text.lower()
        if any(a in low for a in self.added):
            return None
        return b"".join(map(self.parts.__getitem__, PRE_TOKEN.findall(low)))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_IDS:
            self.clear()
        ids = self.plain(word)
        ids = self.library(word) if ids is None else ids
        if len(word) < 100:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if not self.fast:
            return self.library(text)
        ids = self.plain(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if ids is None else ids


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most ``size`` tokens.

    Returns for each piece: id_col, start (its document's ids before it), length, ids_crc32,
    doc_tokens, sequence_id, offset, and the ids themselves (little-endian) ``with_ids``. A
    document's ids are those of its text and then end_id; null and empty texts are end_id alone.
    Repeated rows are packed each; equal lengths keep the input's order; an empty table gives no
    rows; other columns are ignored. Every PACK_ROWS remainders of a partition (at most
    PACK_ROWS * size * 4 bytes, with_ids) are packed as a set, with ids or without. A tokenizer other than
    word_bpe_49k gets the library's ids too, more slowly. A sequence_id has the partition in its upper bits.
    """
    if sys.byteorder != "little":
        raise ValueError("ids are written as this machine has them, which must be little-endian")
    last = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, base = TextIds(load(tokenizer_path)), TaskContext.get().partitionId() << 36
        kind = None
        rest: list[list] = []

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:7]]]
            return pa.RecordBatch.from_arrays([*arrays, *([pa.array(cols[7], pa.binary())] if with_ids else [])], names=names)

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base
            window, offset, n = best_fit([r[2] for r in rest], size)
            for r, w, o in zip(rest, window, offset, strict=True):
                r[5], r[6] = base + w, o
            base += n
            for k in range(0, len(rest), 5000):
                yield batch_of(rest[k : k + 5000])
            rest.clear()

        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
        for batch in batches:
            kind, full, sets = batch.schema.field(0).type, [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = ids.of(text or "") + last
                n = len(data) // 4
                whole = memoryview(data)
                for at in range(0, n, size):
                    piece = whole[4 * at : 4 * (at + size)]
                    row = [doc, at, len(piece) // 4, zlib.crc32(piece), n, 0, 0, *([bytes(piece)] if with_ids else [])]
                    if row[2] == size:
                        row[5], base = base, base + 1
                        full.append(row)
                    else:
                        rest.append(row)
                    if len(rest) == PACK_ROWS:
                        sets += packed()
            yield from sets
            if full:
                yield batch_of(full)
        if rest:
            yield from packed()

    rows = docs.select(id_col, F.col(text_col).alias("__text"))
    return map_batches(rows, run, f"`{id_col}` {rows.dtypes[0][1]}, {SCHEMA}" + ", ids binary" * with_ids)


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
