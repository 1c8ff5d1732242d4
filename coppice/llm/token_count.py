"""Token counts with the whole-token shortcut.

Offline, every string of the vocabulary is encoded by the library; those that are one pre-token
and one token form the proven set. A pre-token of that set counts 1 without merging; only the
others go through the merges. Counts of the words met so far are kept for the next ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

#: Fixed value: the pre-token pattern that byte_bpe_50k.json's byte-level step applies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words whose counts a worker keeps; it starts anew beyond that.
KEPT_WORDS = 300_000

_UNSAFE = -(1 << 40)


def _byte_signs() -> dict[int, int]:
    """The byte-level step's sign for each byte: itself if it can be seen, else the next one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + k for k, b in enumerate(rest)}


BYTE_SIGNS = _byte_signs()


def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def library_ids(tokenizer, text: str) -> list[int]:
    """The library's ids of a text, without begin, end or added tokens of its own."""
    return tokenizer.encode(text, add_special_tokens=False).ids


def proven_tokens(tokenizer) -> frozenset[str]:
    """Vocabulary strings that encode alone as one token and are one pre-token."""
    pattern, found = regex.compile(PRE_TOKEN), set()
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ids = [i for s, i in tokenizer.get_vocab().items() if s not in added]
    strings = [s for s in (tokenizer.decode([i], skip_special_tokens=False) for i in ids) if s and "�" not in s]
    for s, e in zip(strings, tokenizer.encode_batch(strings, add_special_tokens=False), strict=True):
        m = pattern.match(s)
        if len(e.ids) == 1 and m and m.end() == len(s):
            found.add(s)
    return frozenset(found)


class Counter(dict):
    """Word, as it stands after a space -> its tokens with that space.

    A word next to further white space is _UNSAFE: its pre-tokens depend on its neighbours. ``fast`` is off for
    a tokenizer whose pre-tokens are others (see agrees); the library then counts each text whole.
    """

    def __init__(self, tokenizer, proven: frozenset[str]):
        super().__init__()
        self.tokenizer, self.proven, self.pattern = tokenizer, proven, regex.compile(PRE_TOKEN)
        self.merge = tokenizer.model.tokenize
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.fast = True
        self.fast = self.agrees()

    def agrees(self) -> bool:
        """Whether counts are the library's on texts that hold every kind of pre-token."""
        probes = ["It's We'LL they're I'd can't", "a1b22 C-3.50% (x) [Y]{z}", "  two  spaces\n\nlines\r\n\ttab\x00\x1c\x85\xa0 .", "naïve ÉCOLE Σςσ e\u0301 日本語 — “q” 😀", "".join(map(chr, range(1, 0x250)))]
        return all(self.count(p) == self.library(p) for p in [*probes, *(f"X {a}y{a}" for a in self.added)])

    def library(self, text: str) -> int:
        return len(library_ids(self.tokenizer, text))

    def merged(self, text: str) -> int:
        if any(s in text for s in self.added):
            return self.library(text)
        n = 0
        for t in self.pattern.findall(text):
            n += 1 if t in self.proven else len(self.merge((t if t.isascii() else t.encode().decode("latin-1")).translate(BYTE_SIGNS)))
        return n

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        n = _UNSAFE if not word or word[0].isspace() or word[-1].isspace() else self.merged(" " + word)
        if len(word) < 100:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not self.fast:
            return self.library(text)
        first, *rest = text.split(" ")
        n = sum(map(self.__getitem__, rest))
        if n < 0 or (rest and (not first or first[-1].isspace())):
            return self.merged(text)  # white space runs: the whole text at once
        return n + self.merged(first)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (UTF-8) and n_tokens of every whole text, as the tokenizer's library gives them.

    Null counts as empty: 0 bytes, 0 tokens. Added strings inside texts count as the library's
    default has it. Repeated rows are counted alike; other columns are ignored. The proven set is
    broadcast; the vocabulary bounds its size.
    """
    proven = docs.sparkSession.sparkContext.broadcast(proven_tokens(load(tokenizer_path)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(load(tokenizer_path), proven.value)
        for batch in batches:
            rows = texts(batch.column(1))
            n = pa.array([counter.count(t.decode()) for t in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in rows], pa.int64()), n], names=[batch.schema.names[0], "n_bytes", "n_tokens"])

    rows = docs.select(id_col, F.col(text_col).alias("__text"))
    return map_batches(rows, count, f"`{id_col}` {rows.dtypes[0][1]}, n_bytes long, n_tokens long")


def op2(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 1024)
