"""Quality: a linear-chain conditional random field labels every line good or bad.

Features of a line are its own make-up and that of the lines before and after it. Labels are of
whole documents: training begins with each line labelled as its document and then lets the model
relabel the lines of bad documents (one of them stays bad). A document's quality is the
length-weighted mean of its lines' forward-backward marginals, calibrated on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_in_one_task, held_out, labelled_texts, map_batches, texts


@dataclass(frozen=True)
class Settings:
    #: The fit uses at most so many labelled rows, spread by hash; of a text with more than max_lines
    #: lines it learns ``parts`` stretches of consecutive lines, spread evenly from its first line to its last.
    max_rows: int = 6000
    max_lines: int = 100
    parts: int = 5
    rounds: int = 3
    steps: int = 120
    rate: float = 0.1
    l2: float = 1e-4


def _classes() -> np.ndarray:
    kind = np.full(256, 3)  # 0 lower or beyond ASCII, 1 upper, 2 digit, 3 other sign, 4 space, 5 sentence sign, 6 bar, 7 loud sign
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 0
    kind[[9, 11, 12, 13, 32]], kind[[46, 44, 59, 58, 63]], kind[124] = 4, 5, 6
    kind[[33, 35, 36, 37, 38, 42]] = 7
    return kind.astype(np.uint8)


CLASSES = _classes()
BASE = 15
WIDTH = 3 * BASE + 1


def line_features(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their bytes, and the number of lines of each text."""
    data = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(np.float64)
    kind = CLASSES[data]
    at = starts.astype(np.int64)
    share = np.zeros((len(ends), 8))
    for k in range(8):
        share[:, k] = np.add.reduceat(kind == k, at, dtype=np.int64)
    share[:, 3] -= 1  # the newline itself
    n = np.maximum(size, 1)
    words = share[:, 4] + 1
    letters = np.maximum(share[:, 0] + share[:, 1], 1)
    upper = share[:, 1] / letters
    split = [r.split(b"\n") for r in rows]
    lines = np.array([len(x) for x in split])
    # share of a line's words that it already had
    again = np.array([1 - len(set(w)) / len(w) if (w := line.split()) else 0.0 for x in split for line in x])
    f = np.stack([
        np.log1p(size) / 5, upper, (upper > 0.5) * 1.0, share[:, 2] / n, share[:, 3] / n, share[:, 5] / n * 5,
        share[:, 6] / words, share[:, 7] / words, (share[:, 7] > 0.3 * words) * 1.0, (share[:, 6] > 0.3 * words) * 1.0, n / words / 20, (size == 0) * 1.0,
        again, (again > 0.5) * 1.0, (again > 0.8) * 1.0,
    ], axis=1)
    first = np.zeros(len(ends), bool)
    first[np.concatenate([[0], np.cumsum(lines)[:-1]])] = True
    last = np.append(first[1:], True)
    before, after = np.roll(f, 1, 0), np.roll(f, -1, 0)
    before[first], after[last] = 0, 0
    return np.concatenate([f, before, after, np.ones((len(ends), 1))], axis=1), size, lines


def learnt_lines(lines: int, s: Settings) -> list[np.ndarray]:
    """Indices of the lines that are learnt of a text, a chain each: all, or evenly spread stretches."""
    if lines <= s.max_lines:
        return [np.arange(lines)]
    each = s.max_lines // s.parts
    return [np.arange(a, a + each) for a in np.linspace(0, lines - each, s.parts).astype(int)]


def marginals(unary: np.ndarray, lines: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line (given log-odds), and the sum of P(label, next label), by forward-backward.

    Chains of like length run together, so one long document doesn't widen the others.
    """
    start = np.concatenate([[0], np.cumsum(lines)[:-1]])
    good, pairs = np.zeros(len(unary)), np.zeros((2, 2))
    order = np.argsort(lines, kind="stable")
    at = 0
    while at < len(order):
        most = lines[order[at]] * 2
        to = at + int(np.searchsorted(lines[order[at:]], most, "right"))
        group = order[at:to]
        at = to
        n, t = lines[group], int(lines[group].max())
        index = start[group][:, None] + np.minimum(np.arange(t)[None, :], n[:, None] - 1)
        mask = np.arange(t)[None, :] < n[:, None]
        u = np.exp(np.clip(unary[index], -30, 30))
        phi = np.stack([np.ones_like(u), u], -1) / (1 + u)[..., None]
        m = np.exp(move)
        a, b = np.empty_like(phi), np.ones_like(phi)
        a[:, 0] = phi[:, 0] / phi[:, 0].sum(-1, keepdims=True)
        for k in range(1, t):
            x = (a[:, k - 1] @ m) * phi[:, k]
            a[:, k] = x / x.sum(-1, keepdims=True)
        for k in range(t - 2, -1, -1):
            x = (b[:, k + 1] * phi[:, k + 1]) @ m.T
            b[:, k] = np.where(mask[:, k + 1, None], x / x.sum(-1, keepdims=True), 1.0)
        p = a * b
        p /= p.sum(-1, keepdims=True)
        good[index[mask]] = p[..., 1][mask]
        if t > 1:
            both = a[:, :-1, :, None] * m * (phi[:, 1:] * b[:, 1:])[:, :, None, :]
            both /= both.sum((-1, -2), keepdims=True)
            pairs += both[mask[:, 1:]].sum(0)
    return good, pairs


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def document_score(good: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of each document's lines, as log-odds."""
    start = np.concatenate([[0], np.cumsum(lines)[:-1]])
    mean = np.add.reduceat(good * (size + 1), start) / np.add.reduceat(size + 1, start)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


class Model:
    def __init__(self):
        self.w, self.move, self.scale, self.shift = np.zeros(WIDTH), np.zeros((2, 2)), 1.0, 0.0

    def lines(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return marginals(x @ self.w, lines, self.move)[0]

    def score(self, rows: list[bytes]) -> np.ndarray:
        x, size, lines = line_features(rows)
        return _sigmoid(self.scale * document_score(self.lines(x, lines), size, lines) + self.shift)

    def fit(self, rows: list[bytes], labels: list[int], s: Settings) -> "Model":
        """Learns whole texts."""
        x, size, lines = line_features(rows) if rows else (np.zeros((0, WIDTH)), np.zeros(0), np.zeros(0, int))
        return self.learn(x, size, lines, np.arange(len(rows)), labels, s)

    def learn(self, x: np.ndarray, size: np.ndarray, lines: np.ndarray, owner: np.ndarray, labels: list[int], s: Settings) -> "Model":
        """x and size of all lines; the lines of each chain and the text (owner, ascending) that it is of; the texts' labels."""
        if not len(labels) or len(set(labels)) < 2:
            self.shift = 0.0 if not len(labels) else 4.0 if labels[0] else -4.0
            return self
        text_lines = np.bincount(owner, lines, len(labels)).astype(int)
        texts_y, y = np.array(labels, float), np.array(labels, float)[owner]
        doc = np.repeat(np.arange(len(lines)), lines)
        start = np.concatenate([[0], np.cumsum(lines)[:-1]])
        first = np.concatenate([[0], np.cumsum(text_lines)[:-1]])
        inner = np.ones(len(doc), bool)
        inner[start] = False
        line = y[doc]
        for r in range(s.rounds):
            if r:
                p = self.lines(x, lines)
                worst = np.repeat(np.minimum.reduceat(p, first), text_lines)
                line = np.where(y[doc] == 1, 1.0, ((p > 0.5) & (p > worst)) * 1.0)
            seen = np.array([[np.sum((line[:-1] == a) & (line[1:] == b) & inner[1:]) for b in (0, 1)] for a in (0, 1)], float)
            m1, m2 = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
            for k in range(1, s.steps + 1):
                p, pairs = marginals(x @ self.w, lines, self.move)
                g = np.concatenate([x.T @ (p - line), (pairs - seen).ravel()]) / len(line) + s.l2 * np.concatenate([self.w, self.move.ravel()])
                m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
                step = s.rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
                self.w, self.move = self.w - step[:WIDTH], self.move - step[WIDTH:].reshape(2, 2)
        v = document_score(self.lines(x, lines), size, text_lines)
        a, b = 1.0, 0.0
        for _ in range(2000):
            p = _sigmoid(a * v + b)
            a, b = a - 0.1 * (np.mean((p - texts_y) * v) + 1e-3 * a), b - 0.1 * np.mean(p - texts_y)
        self.scale, self.shift = float(a), float(b)
        return self


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on a bounded sample (Settings); without labelled rows every score is that of one constant.

    Lines become features where the texts are, whole texts long ones included; one task learns from the
    sample, and only the model reaches the driver.
    """
    s = settings

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, chains = [], []
            for t in texts(batch["__text"]):
                x, size, _ = line_features([t])
                at = learnt_lines(len(size), s)
                chains.append(",".join(str(len(a)) for a in at))
                data.append(np.concatenate([x, size[:, None]], 1)[np.concatenate(at)].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch["__turn"], batch["__label"], pa.array(chains, pa.string()), pa.array(data, pa.binary())], names=["turn", "label", "chains", "data"])

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, lines, owner, y = [np.zeros((0, WIDTH + 1), np.float32)], [], [], []
        for batch in batches:
            for label, chains, d in zip(*(batch[c].to_pylist() for c in ("label", "chains", "data")), strict=True):
                data.append(np.frombuffer(d, np.float32).reshape(-1, WIDTH + 1))
                lines += (own := [int(n) for n in chains.split(",")])
                owner += [len(y)] * len(own)
                y.append(label)
        rows = np.concatenate(data).astype(np.float64)
        m = Model().learn(rows[:, :-1], rows[:, -1], np.array(lines, int), np.array(owner, int), y, s)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([m.w, m.move.ravel(), [m.scale, m.shift]]).tobytes()])], names=["model"])

    rows = labelled_texts(docs, labels, label, s.max_rows, id_col, text_col)
    sample = map_batches(rows, featured, "turn long, label int, chains string, data binary")
    got, m = fit_in_one_task(sample, ["turn", "data"], learnt, "model binary").collect(), Model()
    if got:
        v = np.frombuffer(got[0][0])
        m.w, m.move, m.scale, m.shift = v[:WIDTH], v[WIDTH:-2].reshape(2, 2), float(v[-2]), float(v[-1])
    return m


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1, higher is better). Null and empty texts are one empty line; repeated rows score alike."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(texts(batch.column(1))) if len(batch) else [], pa.float64())], names=[id_col, "score"])

    rows = docs.select(id_col, F.col(text_col).alias("__text"))
    return map_batches(rows, run, f"`{id_col}` {rows.dtypes[0][1]}, score double")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
