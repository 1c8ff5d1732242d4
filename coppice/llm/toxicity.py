"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words and their stems, neighbouring pairs and pairs with one word between, each
once a text, hashed to ``2**bits`` places. Per-coordinate rates follow the squared gradients and the L1 term
keeps most weights at exactly 0, so what is broadcast is small.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fit_in_one_task, held_out, labelled_texts, map_batches, texts, words_of


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 6
    #: The fit uses at most so many labelled rows, spread by hash, and of a row with more distinct
    #: places than max_places those of smallest mixed value: a sample of the whole text. (Learning
    #: only; a score uses all places of the text.)
    max_rows: int = 6000
    max_places: int = 1 << 14


class WordHashes(dict):
    """Word -> its row in ``table``: hashes of the word and of its stems (first STEMS bytes)."""

    STEMS = (4, 5, 7)
    MOST = 400_000

    def __init__(self):
        super().__init__()
        self.table = np.zeros((1 << 12, 1 + len(self.STEMS)), np.uint64)

    def __missing__(self, word: bytes) -> int:
        k = len(self)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[k] = [zlib.crc32(word), *(zlib.crc32(word[:n], n) for n in self.STEMS)]
        self[word] = k
        return k

    def places(self, text: bytes, bits: int) -> np.ndarray:
        """Places of all features of a text, those that repeat too."""
        if len(self) > self.MOST:
            self.clear()
        words = words_of(text)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        rows = self.table[at]
        a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        h = rows[:, 0]
        out = np.concatenate([(rows * a).ravel(), h[:-1] * a + h[1:] * b, h[:-2] * a + h[2:] * c])
        return (out >> np.uint64(64 - bits)).astype(np.int32)


class FTRL:
    """Follow the regularised leader, proximal; place 2**bits is the bias, without L1."""

    def __init__(self, s: Settings):
        self.s, n = s, (1 << s.bits) + 1
        self.z, self.n = np.zeros(n), np.zeros(n)

    def weights(self, at) -> np.ndarray:
        s, z, n = self.s, self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == 1 << s.bits, 0.0, s.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = sigmoid(float(w.sum())) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w[:-1]).astype(np.int32)
        return at, w[at], float(w[-1])


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def learnt_places(text: bytes, hashes: WordHashes, s: Settings) -> np.ndarray:
    """A text's distinct places, at most max_places of them."""
    at = np.unique(hashes.places(text, s.bits))
    if len(at) > s.max_places:
        mixed = at.astype(np.uint32) * np.uint32(0x9E3779B1)
        at = np.sort(at[np.argpartition(mixed, s.max_places)[: s.max_places]])
    return at


Weights = tuple[np.ndarray, np.ndarray, float]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Non-zero places, their weights and the bias. Without labelled rows all are 0.

    Texts become places where they are; one task learns from the bounded sample, in order of a hash
    of the ids, and only the sparse weights reach the driver. Repeated rows are learnt each.
    """
    s = settings

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            at = [learnt_places(t, hashes, s).tobytes() for t in texts(batch["__text"])]
            yield pa.RecordBatch.from_arrays([batch["__turn"], batch["__label"], pa.array(at, pa.binary())], names=["turn", "label", "at"])

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            seen += [(np.append(np.frombuffer(d, np.int32), 1 << s.bits), y) for y, d in zip(batch["label"].to_pylist(), batch["at"].to_pylist(), strict=True)]
        at, w, bias = trained(seen, s)
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()]), pa.array([w.tobytes()]), pa.array([bias])], names=["at", "w", "bias"])

    rows = labelled_texts(docs, labels, label, s.max_rows, id_col, text_col)
    sample = map_batches(rows, featured, "turn long, label int, at binary")
    got = fit_in_one_task(sample, ["turn", "at"], learnt, "at binary, w binary, bias double").collect()
    return (np.frombuffer(got[0][0], np.int32), np.frombuffer(got[0][1]), got[0][2]) if got else trained([], s)


def trained(seen: list[tuple[np.ndarray, int]], s: Settings) -> Weights:
    model = FTRL(s)
    for _ in range(s.epochs):
        for at, y in seen:
            model.learn(at, y)
    return model.sparse()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", name: str = "score", keep: bool = False) -> DataFrame:
    """id_col and the probability of label 1; with ``keep`` all columns of docs (name must be free).

    Null and empty texts get the bias's probability; repeated rows are scored alike.
    """
    at, weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((at, weights.astype(np.float32), bias))
    bits = settings.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHashes(), np.zeros(1 << bits, np.float32)
        table[sent.value[0]] = sent.value[1]
        for batch in batches:
            out = []
            for t in texts(batch["__text"]):
                p = hashes.places(t, bits)
                out.append(sigmoid(float(table[np.unique(p[table[p] != 0])].sum(dtype=np.float64)) + sent.value[2]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["__kept", name])

    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.col(id_col)
    rows = docs.select(kept.alias("__kept"), F.col(text_col).alias("__text"))
    scored = map_batches(rows, run, StructType([rows.schema.fields[0], StructField(name, DoubleType())]))
    return scored.select("__kept.*", name) if keep else scored.withColumnRenamed("__kept", id_col)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score under the threshold, in their own columns."""
    scored = score(docs, fit(docs, labels, settings=settings, id_col=id_col, text_col=text_col), settings, id_col, text_col, "__toxicity", keep=True)
    return scored.where(F.col("__toxicity") < threshold).drop("__toxicity")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
