import random
import re
import tracemalloc

import numpy as np
import pytest

from coppice.llm import ngram_join as J


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        k = min(5, len(w))
        out[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    return out


def brute(rows):
    sets = sets_of(rows)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, s in sets.items():
        for t in s:
            by.setdefault(t, []).append(i)
    pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
    for a, b in pairs:
        x, y = sets[a], sets[b]
        if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


def variants(seed):
    r, rows = random.Random(seed), []
    word = lambda: r.choice("abcdefghij") + str(r.randrange(40))
    passage = [word() for _ in range(30)]
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 4, 5, 6, 12, 60, 200]))]
        for _ in range(r.choice([1, 2, 8])):
            w = [x if r.random() > r.choice([0, 0.01, 0.03, 0.06]) else word() for x in base]
            if r.random() < 0.2:
                w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
            rows.append(" ".join(w) if r.random() < 0.9 else " \n".join(w).upper())
    rows += [None, "", "  ", "\t", "One", "one"]
    return list(enumerate(rows))


def result(spark, rows):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n long, cid string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(docs).collect()}


@pytest.mark.parametrize("unit", [(2048, 500_000), (3, 40)])
def test_components_are_those_of_brute_force(spark, monkeypatch, unit):
    monkeypatch.setattr(J, "GROUP_UNIT", unit[0])
    monkeypatch.setattr(J, "BLOB_UNIT", unit[1])
    rows = variants(5)
    assert result(spark, rows) == brute(rows)


def test_table_components_are_those_of_brute_force(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert result(spark, rows) == brute(rows)


def test_keeps_one_of_each_component(spark):
    rows = variants(9)
    docs = spark.createDataFrame(rows + [rows[0], (None, "z")], "doc_id long, text string")
    want = sorted({c for _, c in brute(rows).values()})
    got = J.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r[0] for r in got.collect() if r[0] is not None) == want and got.where("doc_id IS NULL").count() == 1
    assert J.near_duplicates(docs.limit(0)).count() == 0


def test_tree_loses_no_possible_pair():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 300, dtype=np.uint64)
    sets = []
    for _ in range(150):
        s = base[r.random(300) > r.choice([0.02, 0.1, 0.5])]
        sets.append(np.unique(np.concatenate([s, r.integers(0, 2**63, r.integers(0, 20), dtype=np.uint64)])))
    sets += [np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 9, 40, 900, 5000)]
    sets.sort(key=len)
    tree, forest = J.SignatureTree(np.array([len(s) for s in sets]), [J.signature(s) for s in sets]), J.Forest(156)
    list(tree.pairs(forest))
    for i in range(150):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert forest.root(i) == forest.root(j)


@pytest.mark.parametrize("seed", range(20))
def test_chains_hold_every_pair_that_a_shared_shingle_may_link(seed):
    r = random.Random(seed)
    rows = {(r.randrange(6), r.choice([1, 1, -1]) * r.choice([5, 6, 7, 9, 12, 20, 40, 41, 50]), k) for k in range(r.choice([3, 30, 90]))}
    rows = sorted(rows, key=lambda x: (x[0], abs(x[1]), x[1] < 0, x[2]))
    streamed = [x for x in rows for _ in range(r.choice([1, 1, 2]))]
    chains, out = J.Chains(), []
    while streamed:
        cut = r.randint(1, 7)
        out += chains.add(np.array(streamed[:cut], np.int64)).tolist()
        streamed = streamed[cut:]
    assert len({(t, k) for t, _, k in out}) == len(out)
    of = {(t, k): c for t, c, k in out}
    for t, m, k in rows:
        for u, n, j in rows:
            if t == u and k != j and 0 < m <= abs(n) and 100 * m >= 80 * abs(n):
                assert of[t, k] == of[u, j]
    members = {}
    for t, c, _ in out:
        members[t, c] = members.get((t, c), 0) + 1
    assert all(v > 1 for v in members.values())


def test_frequent_shingles_take_little_memory():
    """A bucket's counts need the bucket once more and its repeats, not several copies of it."""
    seen = J._Frequent()
    tokens = np.random.default_rng(1).integers(0, 1 << 62, seen.BUCKET - 12, dtype=np.uint64)
    tracemalloc.start()
    seen.add(tokens.copy())
    seen.add(np.repeat(np.array([5, 3, 1 << 63], np.uint64), [7, 4, 1]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen.tokens.tolist() == [3, 5] and seen.counts.tolist() == [4, 7] and seen.size == 0
    seen.flush()
    seen.add(np.array([5, 5, 9], np.uint64))
    seen.flush()
    assert seen.tokens.tolist() == [3, 5] and seen.counts.tolist() == [4, 9]
    assert most < 2.6 * tokens.nbytes
