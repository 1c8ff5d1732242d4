"""Near duplicates: all pairs of word-shingle sets with a Jaccard similarity of at least 0.8.

1. Documents with equal sets form one class. A pass over all texts also counts frequent shingles.
2. With shingles ordered by frequency, two linked sets share one among the first n - ceil(8 n / 9) + 1
   of the smaller and the first n - ceil(0.8 n) + 1 of the larger, and the smaller has at least 0.8
   of the larger's size. So those prefixes, each shingle's rows in order of size and parted where a
   step in size is too large, deal the classes into groups; groups with equal members are one group.
3. In a group, classes form a signature tree: a leaf has their token bitmaps, a node the OR of
   those below and their range of sizes. A dual traversal leaves out node pairs whose largest
   possible overlap is too small. The pairs that stay keep a spanning forest for each group, not
   all pairs; connected, they make blobs that hold every component whole.
4. Within a blob the exact sets decide, pair by pair, unless two classes are connected already.

Sets are of 64-bit hashes, so two different shingles of a pair may be taken for one with a
probability of about 2**-64 for each pair of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.operators.components import connected_components
from coppice.sources.stored import release_shuffles

from .common import drop, join_hot, map_batches, texts, written

WORDS = 5
#: A pair links when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles whose frequency orders prefixes. Any order gives right results; this one keeps groups small.
FREQUENT = 1 << 16
#: Classes of a group, and shingles of a blob, that one unit of work takes; larger ones are dealt in blocks.
GROUP_UNIT, BLOB_UNIT = 2048, 500_000
LEAF = 16
#: Bytes of a signature, so that a unit of work has a bound in bytes too.
SIGNATURE = 1 << 16

_M = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) < 100:
            self[word] = h
        return h


def shingles(text: bytes, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, no words none."""
    words = text.lower().split()  # on bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(w)
    if n == 0:
        return w
    k = min(n, WORDS)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _M + w[i : n - k + 1 + i]
    h = (h ^ (h >> np.uint64(32))) * _C
    return np.unique(h ^ (h >> np.uint64(29)))


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def early_length(n: int) -> int:
    """A set's part of the prefix that links it with larger ones: their overlap is 8/9 of it at least."""
    most = (100 + PERCENT) // 2
    return n - (PERCENT * n + most - 1) // most + 1


def signature(tokens: np.ndarray) -> bytes:
    """Bitmap with two to four bits for each token; half as long, it is the OR of its halves.

    SIGNATURE bytes at most: beyond some 130,000 tokens it says less, never something wrong.
    """
    size = min(max(8, (1 << len(tokens).bit_length()) // 4), SIGNATURE)
    bits = np.zeros(size * 8, np.uint8)
    bits[(tokens & np.uint64(size * 8 - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


class _Frequent:
    """Lossy counting: a shingle is left out only if seen once in a bucket of BUCKET shingles."""

    BUCKET, KEPT = 2_000_000, 1 << 17

    def __init__(self):
        self.buffer: list[np.ndarray] = []
        self.size = 0
        self.tokens, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, tokens: np.ndarray) -> None:
        self.buffer.append(tokens)
        self.size += len(tokens)
        if self.size >= self.BUCKET:
            self.flush()

    def flush(self) -> None:
        t = np.concatenate([*self.buffer, self.tokens[:0]])
        self.buffer = []
        t.sort()
        # where runs of equal tokens begin and end; np.unique would hold several copies of the bucket
        same = t[1:] == t[:-1]
        begin, end = same.copy(), same.copy()
        begin[1:] &= ~same[:-1]
        end[:-1] &= ~same[1:]
        begin = np.flatnonzero(begin)
        t, c = t[begin], np.flatnonzero(end) - begin + 2
        t, at = np.unique(np.concatenate([self.tokens, t]), return_inverse=True)
        c = np.bincount(at, np.concatenate([self.counts, c]), len(t)).astype(np.int64)
        if len(t) > self.KEPT:
            keep = np.sort(np.argpartition(-c, self.KEPT)[: self.KEPT])
            t, c = t[keep], c[keep]
        self.tokens, self.counts, self.buffer, self.size = t, c, [], 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _sets(docs: DataFrame) -> DataFrame:
    """A row (kind 0) for each document: id, row hashes, n, two halves of its set's 128-bit key, signature; kind 1: a frequent shingle and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, frequent, kind = _Hashes(), _Frequent(), None
        names = ["kind", "id", "ra", "rb", "n", "k1", "k2", "sig"]
        for batch in batches:
            kind = batch["id"].type
            n, k1, k2, sig = [], [], [], []
            for t in texts(batch["text"]):
                s = shingles(t, hashes)
                frequent.add(s)
                data = s.tobytes()
                n.append(len(s))
                k1.append(xxhash.xxh64_intdigest(data, 1))
                k2.append(xxhash.xxh64_intdigest(data, 2))
                sig.append(signature(s) if len(s) else b"")
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(n), pa.int32()), batch["id"], batch["ra"], batch["rb"], pa.array(n, pa.int64()), _signed(np.array(k1, np.uint64)), _signed(np.array(k2, np.uint64)), pa.array(sig, pa.binary())], names=names)
        if kind is None:
            return
        frequent.flush()
        m = len(frequent.tokens)
        for a in range(0, m, 10_000):
            t, c = frequent.tokens[a : a + 10_000], frequent.counts[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(t), pa.int32()), pa.nulls(len(t), kind), _signed(t), _signed(t), pa.array(c), _signed(t), _signed(t), pa.nulls(len(t), pa.binary())], names=names)

    return map_batches(docs, run, f"kind int, id {dict(docs.dtypes)['id']}, ra long, rb long, n long, k1 long, k2 long, sig binary")


def _prefixes(docs: DataFrame, frequent: list[tuple[int, int]]) -> DataFrame:
    """(token, k1, m) for the first shingles of each set, in the order (frequency, hash); m is the set's size, negative beyond early_length."""
    f = np.array([x[0] for x in frequent], np.int64).view(np.uint64)
    order = np.argsort(f)
    sent = docs.sparkSession.sparkContext.broadcast((f[order], np.array([x[1] for x in frequent], np.int64)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        often, count = sent.value
        for batch in batches:
            token, k1, m = [], [], []
            for t in texts(batch["text"]):
                s = shingles(t, hashes)
                key = xxhash.xxh64_intdigest(s.tobytes(), 1)
                if not len(s) or key in seen:  # a copy says nothing new
                    continue
                if len(seen) < 200_000:
                    seen.add(key)
                size = len(s)
                p = prefix_length(size)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    hot = often[at] == s
                    cold = s[~hot]
                    if len(cold) < p:
                        cold = np.concatenate([cold, s[hot][np.argsort(count[at[hot]], kind="stable")]])
                    s = cold
                token.append(s[:p])
                k1.append(np.full(p, key, np.uint64))
                m.append(np.where(np.arange(p) < early_length(size), size, -size).astype(np.int32))
            if token:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(token)), _signed(np.concatenate(k1)), pa.array(np.concatenate(m))], names=["token", "k1", "m"])

    return map_batches(docs, run, "token long, k1 long, m int")


class Chains:
    """Parts rows (token, |m|, late, k1), in this order, into the chains of a token.

    A row continues its token's chain if the last early row before it has at least PERCENT of its
    size; else an early row begins one and a late row (m < 0) links with nothing. A chain's first
    row is kept back until a second one comes; chains of one row are left out.
    """

    def __init__(self):
        self.open = np.zeros((0, 3), np.int64)  # the last early row
        self.sent, self.chain = False, 0  # whether it was put out; its chain
        self.last = np.zeros((0, 3), np.int64)

    def add(self, x: np.ndarray) -> np.ndarray:
        """Rows (token, m, k1), repeated ones allowed; returns rows (token, chain, k1)."""
        x = x[(np.diff(x, axis=0, prepend=self.last if len(self.last) else x[:1] - 1) != 0).any(1)]
        if not len(x):
            return x
        self.last = x[-1:]
        held = len(self.open)
        x = np.concatenate([self.open, x])
        token, m, n = x[:, 0], x[:, 1], np.abs(x[:, 1])
        at = np.arange(len(x))
        early = np.maximum.accumulate(np.where(m > 0, at, -1))
        before = np.concatenate([[-1], early[:-1]])
        linked = (before >= 0) & (token[before] == token) & (100 * n[before] >= PERCENT * n)
        start = (m > 0) & ~linked
        begun = np.maximum.accumulate(np.where(start, at, 0))
        chain = n[begun]
        if held:
            chain = np.where(begun == 0, self.chain, chain)
        keep = linked | (start & np.concatenate([linked[1:], [False]]))
        if held and self.sent:
            keep[0] = False
        out = np.stack([token, chain, x[:, 2]], 1)[keep]
        k = int(early[-1])
        if k >= 0:
            self.sent = bool(keep[k]) or (held > 0 and k == 0 and self.sent)
            self.open, self.chain = x[k : k + 1], int(chain[k])
        return out


def _shared(rows: DataFrame) -> DataFrame:
    """(token, chain, k1) of the chains with two rows or more. Rows stream in order; one is kept back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = Chains()
        for batch in batches:
            if len(batch):
                out = chains.add(np.stack([batch[c].to_numpy().astype(np.int64) for c in ("token", "m", "k1")], 1))
                if len(out):
                    yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1].astype(np.int32)), pa.array(out[:, 2])], names=["token", "chain", "k1"])

    ordered = rows.repartition(F.col("token")).sortWithinPartitions("token", F.abs("m"), F.col("m") < 0, "k1")
    return map_batches(ordered, run, "token long, chain int, k1 long")


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))
        self.trees = n

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        self.trees -= 1
        return True


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


class SignatureTree:
    """Sets in order of size; a node [lo, hi) has the OR of its bitmaps, its sizes' range and most collisions.

    Nodes are made as the traversal reaches them, with bitmaps folded to the length asked for;
    collisions (tokens less bits) are counted at that length.
    """

    def __init__(self, sizes: np.ndarray, signatures: list[bytes]):
        self.n = sizes
        self.bits = [np.frombuffer(s, np.uint8).view(np.uint64) for s in signatures]
        self.length = np.array([len(b) for b in self.bits])
        self.nodes: dict[tuple[int, int, int], tuple[np.ndarray, int]] = {}
        self.leaves: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def leaf(self, lo: int, hi: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of the leaf's sets and their collisions."""
        key = lo, hi, size
        if key not in self.leaves:
            m = np.stack([_fold(b, size) for b in self.bits[lo:hi]])
            self.leaves[key] = m, self.n[lo:hi] - np.bitwise_count(m).sum(1, dtype=np.int64)
        return self.leaves[key]

    def node(self, lo: int, hi: int, size: int) -> tuple[np.ndarray, int]:
        key = lo, hi, size
        if key not in self.nodes:
            if self.middle(lo, hi) is None:
                m, spare = self.leaf(lo, hi, size)
                self.nodes[key] = np.bitwise_or.reduce(m, 0), int(spare.max())
            else:
                mid = self.middle(lo, hi)
                (a, s), (b, t) = self.node(lo, mid, size), self.node(mid, hi, size)
                self.nodes[key] = a | b, max(s, t)
        return self.nodes[key]

    def middle(self, lo: int, hi: int) -> int | None:
        """Where a node parts in two: first between bitmap lengths, so that a leaf (None) has one length."""
        if self.length[lo] != self.length[hi - 1]:
            ends = np.flatnonzero(np.diff(self.length[lo:hi])) + lo + 1
            return int(ends[np.argmin(np.abs(ends - (lo + hi) // 2))])
        return (lo + hi) // 2 if hi - lo > LEAF else None

    def size(self, x: tuple[int, int], y: tuple[int, int]) -> int:
        """The length that all bitmaps of both can be folded to; sets are in order of size, so of length."""
        return int(min(self.length[x[0]], self.length[y[0]]))

    def possible(self, x: tuple[int, int], y: tuple[int, int]) -> bool:
        """Whether a set of x and one of y (x before y) can be similar enough."""
        if 100 * self.n[x[1] - 1] < PERCENT * self.n[y[0]]:
            return False
        size = self.size(x, y)
        (a, s), (b, t) = self.node(*x, size), self.node(*y, size)
        most = int(np.bitwise_count(a & b).sum()) + min(s, t)
        # overlap o of sets of sizes p and q: 100 o >= PERCENT (p + q - o)
        return (100 + PERCENT) * min(most, int(self.n[x[1] - 1])) >= PERCENT * int(self.n[x[0]] + self.n[y[0]])

    def pairs(self, forest: Forest, across: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """A spanning forest of the pairs that may be similar; with ``across``, of pairs that differ in it."""
        stack = [((0, len(self.n)), (0, len(self.n)))]
        while stack and forest.trees > 1:
            x, y = stack.pop()
            if not self.possible(x, y):
                continue
            cut = [(z[0], m, z[1]) if (m := self.middle(*z)) is not None else None for z in (x, y)]
            if cut[0] is None and cut[1] is None:
                yield from self._leaves(x, y, forest, across)
                continue
            xs = [x] if cut[0] is None else [cut[0][:2], cut[0][1:]]
            ys = [y] if cut[1] is None else [cut[1][:2], cut[1][1:]]
            stack += [(a, b) for a in xs for b in ys if a <= b][::-1]

    def _leaves(self, x, y, forest, across) -> Iterator[tuple[int, int]]:
        size = self.size(x, y)
        (a, s), (b, t) = self.leaf(*x, size), self.leaf(*y, size)
        i, j = np.arange(*x), np.arange(*y)
        most = np.bitwise_count(a[:, None, :] & b[None, :, :]).sum(2, dtype=np.int64) + np.minimum(s[:, None], t[None, :])
        p, q = self.n[i][:, None], self.n[j][None, :]
        ok = ((100 + PERCENT) * np.minimum(most, np.minimum(p, q)) >= PERCENT * (p + q)) & (i[:, None] < j[None, :])
        if across is not None:
            ok &= across[i][:, None] != across[j][None, :]
        for u, v in zip(*np.nonzero(ok), strict=True):
            if forest.join(int(i[u]), int(j[v])):
                yield int(i[u]), int(j[v])


def _units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray | list]]:
    """Columns of each run of rows with equal first ``keys`` columns."""
    kept: list[list] = []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
        kept = [k + c for k, c in zip(kept, cols, strict=True)] if kept else cols
        heads = list(zip(*kept[:keys], strict=True))
        at = 0
        for k in range(1, len(heads)):
            if heads[k] != heads[k - 1]:
                yield [c[at:k] for c in kept]
                at = k
        kept = [c[at:] for c in kept]
    if kept and kept[0]:
        yield kept


EDGES = "a long, b long"


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])


def _in_blocks(rows: DataFrame, keys: list[str], blocks: Column, own: Column) -> DataFrame:
    """Deals the rows of a key that has several blocks to every pair of its own block with another."""
    mine = F.when(blocks > 1, F.pmod(own, blocks)).otherwise(F.lit(0)).cast("int")
    out = rows.withColumn("__own", mine).withColumn("__other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    p, q = F.least("__own", "__other"), F.greatest("__own", "__other")
    return out.select(*keys, p.alias("p"), q.alias("q"), (F.col("__own") > F.col("__other")).cast("int").alias("side"), *[c for c in rows.columns if c not in keys])


def _candidates(members: DataFrame) -> DataFrame:
    """Members (token, chain, p, q, side, cid, n, sig): edges of classes that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, _, p, q, side, cid, n, sig in _units(batches, 4):
            order = np.lexsort((cid, n))
            tree = SignatureTree(np.array(n)[order], [sig[k] for k in order])
            across = np.array(side)[order] if p[0] != q[0] else None
            out += [(cid[order[i]], cid[order[j]]) for i, j in tree.pairs(Forest(len(n)), across)]
            if len(out) > 5000:
                yield _edges(out)
                out = []
        yield _edges(out)

    keys = ["token", "chain", "p", "q"]
    return map_batches(members.repartition(*keys).sortWithinPartitions(*keys), run, EDGES)


def exact_links(ids: list[int], sets: list[np.ndarray], side: list[int] | None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (of different sides, if given) that link."""
    order = sorted(range(len(ids)), key=lambda k: (len(sets[k]), ids[k]))
    n = np.array([len(sets[k]) for k in order])
    tokens = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    start = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(tokens.max(initial=0) + 1, bool)
    forest, out = Forest(len(order)), []
    for i in range(len(order) - 1):
        if forest.trees == 1:
            break
        to = int(np.searchsorted(n, 100 * n[i] // PERCENT, "right"))
        r = forest.root(i)
        left = [j for j in range(i + 1, to) if forest.root(j) != r and (side is None or side[order[i]] != side[order[j]])]
        if not left:
            continue
        mine = tokens[start[i] : start[i + 1]]
        mark[mine] = True
        if len(left) * 4 > to - i:
            got = np.add.reduceat(mark[tokens[start[i + 1] : start[to]]], start[i + 1 : to] - start[i + 1], dtype=np.int64)
            both = got[np.array(left) - i - 1]
        else:
            both = np.array([np.count_nonzero(mark[tokens[start[j] : start[j + 1]]]) for j in left])
        mark[mine] = False
        union = n[i] + n[left] - both
        for j in np.array(left)[100 * both >= PERCENT * union]:
            if forest.join(i, int(j)):
                out.append((ids[order[i]], ids[order[int(j)]]))
    return out


def _verified(members: DataFrame) -> DataFrame:
    """Members (blob, p, q, side, cid, set): links that hold on the exact sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, p, q, side, cid, data in _units(batches, 3):
            out += exact_links(cid, [np.frombuffer(d, np.uint64) for d in data], side if p[0] != q[0] else None)
            if len(out) > 5000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return map_batches(members.repartition("blob", "p", "q").sortWithinPartitions("blob", "p", "q"), run, EDGES)


def _exact_sets(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sets = [shingles(t, hashes).tobytes() for t in texts(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["blob"], batch["blocks"], batch["cid"], pa.array(sets, pa.binary())], names=["blob", "blocks", "cid", "set"])

    return map_batches(rows, run, "blob long, blocks long, cid long, set binary")


def _row(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that tell rows apart; rows of equal id and text are repeated ones."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("ra"), F.xxhash64(F.lit(7), F.col(id_col), F.col(text_col)).alias("rb")]


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ra, rb, n, root, component) for every row; root numbers the component and is null without shingles."""
    rows = docs.select(F.col(id_col).alias("id"), *_row(id_col, text_col), F.col(text_col).alias("text"))
    seen = written(_sets(rows), "shingle-sets")
    frequent = seen.where("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")).where("n >= 4").orderBy(F.desc("n"), "k1").limit(FREQUENT).collect()
    sets = seen.where("kind = 0").drop("kind")
    classes = sets.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("least"), F.min(F.struct("ra", "rb")).alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.select("k1", "k2", "n", "least", "rep.*", "copies", F.monotonically_increasing_id().alias("cid")), "classes")

    shared = written(_shared(_prefixes(rows, [(r[0], r[1]) for r in frequent])), "shared-prefixes")
    groups = shared.groupBy("token", "chain").agg(F.count("*").alias("size"), F.bit_xor("k1").alias("x"), F.bit_xor(F.xxhash64("k1")).alias("y"))
    groups = groups.groupBy("size", "x", "y").agg(F.min(F.struct("token", "chain")).alias("g")).select("g.*", "size")
    kept = join_hot(shared, groups, ["token", "chain"], "size", shared.count(), "inner")
    # k1 alone may stand for two classes; then both are members, and the exact sets tell them apart
    reps = sets.where("n > 0").select("ra", "rb", "k1", "k2", "sig").join(classes.select("cid", "ra", "rb", "k1", "k2", "n"), ["ra", "rb", "k1", "k2"]).dropDuplicates(["k1", "k2"])
    members = kept.join(reps, "k1").select("token", "chain", "cid", "n", "sig", "size")
    blocks = F.ceil(F.col("size") / GROUP_UNIT)
    members = _in_blocks(members, ["token", "chain"], blocks, F.xxhash64("cid")).select("token", "chain", "p", "q", "side", "cid", "n", "sig")
    blobs = written(connected_components(_candidates(members)), "blobs")
    drop(shared)
    release_shuffles(docs.sparkSession)

    sizes = blobs.join(classes.select(F.col("cid").alias("node"), "n"), "node")
    total = sizes.groupBy("root").agg(F.ceil(F.sum("n") / BLOB_UNIT).alias("blocks"), F.count("*").alias("size"))
    dealt = join_hot(blobs, total, ["root"], "size", max(1, blobs.count()))
    need = dealt.select(F.col("node").alias("cid"), F.col("root").alias("blob"), "blocks").join(classes.select("cid", "ra", "rb"), "cid")
    whole = rows.drop("id").join(need, ["ra", "rb"]).dropDuplicates(["ra", "rb"]).select("blob", "blocks", "cid", "text")
    found = _in_blocks(_exact_sets(whole), ["blob"], F.col("blocks"), F.xxhash64("cid")).select("blob", "p", "q", "side", "cid", "set")
    roots = connected_components(_verified(found))
    drop(blobs)
    release_shuffles(docs.sparkSession)

    keyed = classes.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").select("k1", "k2", F.coalesce("root", "cid").alias("root"), "least", "copies")
    least = keyed.groupBy("root").agg(F.min("least").alias("component"))
    keyed = keyed.drop("least").join(least, "root").select("k1", "k2", "root", "component", "copies")
    return join_hot(sets.select("id", "ra", "rb", "n", "k1", "k2"), keyed, ["k1", "k2"], "copies", max(1, sets.count()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id_col, n_shingles (distinct), component_id (smallest id that links reach).

    Ids may be of any type with an order, and null: a row without one takes part, and its component_id is that of
    the others (null if none has an id). Rows that share an id but not the text are rows of their own.
    Null, empty and blank texts have no shingles, link with nothing and have their own id; repeated rows are in
    one component; an empty table gives no rows; other columns are ignored. A very long text takes
    eight bytes a shingle where it is read and compared.
    """
    return _found(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near duplicates: of each component the row with the smallest id stays.

    Rows without shingles stay. Of repeated rows (equal id and text) one stays; rows that share an id but not the
    text are judged each by its own text; a row with a null id stays only where no other of its component has
    one. Columns are those of docs.
    """
    found = _found(docs, id_col, text_col)
    best = found.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "ra", "rb")).alias("best"))
    stay = best.select(F.col("best.ra").alias("__ra"), F.col("best.rb").alias("__rb")).unionByName(found.where("n = 0").select(F.col("ra").alias("__ra"), F.col("rb").alias("__rb")))
    rows = docs.select("*", *[c.alias(f"__{k}") for c, k in zip(_row(id_col, text_col), ("ra", "rb"), strict=True)])
    return rows.join(stay, ["__ra", "__rb"], "left_semi").dropDuplicates(["__ra", "__rb"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
