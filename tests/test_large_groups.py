"""Operators on groups whose pairs are too many to be made one by one."""

import math
import random
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coppice.operators import graph, patterns, relational, set_pairs


def test_spans_are_counted_not_paired(spark):
    """A million references and as many spans in one path (10^12 pairs), among them one line in a single span."""
    n = 1_000_000
    spans = spark.range(n).select(F.lit("p").alias("path"), F.col("id").alias("span"), (F.col("id") % 7 - 3).alias("lo"), (F.col("id") % 7 + 100).alias("hi"))
    spans = spans.unionByName(spark.createDataFrame([("p", n, 500, 70_000)], "path string, span long, lo long, hi long"))
    refs = spark.range(n).select(F.lit("p").alias("path"), F.col("id").alias("ref"), (F.col("id") % 200).alias("line"))
    refs = refs.unionByName(spark.createDataFrame([("p", n, 69_999), ("q", n + 1, 600)], "path string, ref long, line long"))
    got = relational.span_containment(refs, spans, "path", "line", "lo", "hi", "span", "ref").collect()
    assert [tuple(r) for r in got] == [(n, n)]


def test_spans_against_all_pairs(spark):
    """Random spans, empty and negative ones, nulls, and references that stand on several lines."""
    dice = random.Random(3)
    some = lambda least, most: None if dice.random() < 0.03 else dice.randint(least, most)
    spans = [(dice.choice(["a", "b", None]), k, lo := some(-300, 300), None if lo is None else lo + dice.choice([-2, 0, 1, 5, 64, 200])) for k in range(40)]
    refs = [(dice.choice(["a", "b", "c", None]), dice.randint(0, 250), some(-350, 450)) for _ in range(300)]
    want, inside = {}, {}
    for p, ref, line in refs:
        inside.setdefault(ref, []).extend(k for q, k, lo, hi in spans if None not in (p, q, line, lo) and p == q and lo <= line <= hi)
    want = {(ref, found[0]) for ref, found in inside.items() if len(found) == 1}
    r, s = spark.createDataFrame(refs, "path string, ref long, line int"), spark.createDataFrame(spans, "path string, span long, lo int, hi int")
    assert want and {tuple(x) for x in relational.span_containment(r, s, "path", "line", "lo", "hi", "span", "ref").collect()} == want
    assert relational.span_containment(r, s.limit(0), "path", "line", "lo", "hi", "span", "ref").count() == 0


def pairs_of(sets):
    """All pairs by hand: null elements count in the sizes only."""
    out = set()
    for a, x in sets.items():
        for b, y in sets.items():
            both = len((x & y) - {None})
            if a is not None and b is not None and a < b and both:
                out.add((a, b, both, len(x), len(y)))
    return out


def test_overlaps_against_all_pairs(spark, monkeypatch):
    """In blocks (several, and far apart in their elements) and joined; ids and elements of any type, nulls."""
    dice = random.Random(5)
    sets = {f"k{k:03d}" if k else None: {dice.choice([None, *(f"é{(k % 2) * 50 + e}" for e in range(12))]) for _ in range(dice.randint(1, 9))} for k in range(60)}
    rows = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "id string, t string")
    want = pairs_of(sets)
    for block, few, cells, steps in ((7, 0, 20, 3), (1000, 0, 1 << 20, 1 << 21), (7, 10**9, 20, 3)):
        for name, value in (("BLOCK", block), ("FEW", few)):
            monkeypatch.setattr(set_pairs, name, value)
        assert {tuple(r) for r in set_pairs.overlaps(rows).select("a", "b", "both", "na", "nb").collect()} == want
        monkeypatch.setattr(set_pairs, "BLOCK", 2048)
        table = [(i, j, b, *r) for i, j in ((0, 0), (0, 1), (1, 1)) for b, r in [(int(k[1:]) // 3 % 2, (k, len(s), [t for t in s if t])) for k, s in sorted((k, s) for k, s in sets.items() if k)] if b in (i, j)]
        monkeypatch.setattr(set_pairs, "CELLS", cells)
        monkeypatch.setattr(set_pairs, "STEPS", steps)
        batch = pa.RecordBatch.from_pylist([dict(zip(("i", "j", "block", "id", "n", "ts"), r)) for r in table])
        got = [tuple(r.values()) for part in set_pairs._count_pairs([batch.slice(0, 40), batch.slice(40)]) for r in part.to_pylist()]
        assert len(got) == len(want) and set(got) == want
    assert set_pairs.overlaps(rows.limit(0)).count() == 0


def test_overlaps_of_sets_that_share_much(spark):
    """3,000 sets of 150 elements out of 200: 4.5 million pairs, 500 million meetings on an element."""
    rows = spark.range(3000).select("id", F.explode(F.sequence(F.lit(0), F.lit(149))).alias("k")).select("id", ((F.col("id") + F.col("k")) % 200).alias("t"))
    began = time.time()
    got = set_pairs.overlaps(rows).agg(F.count("*"), F.sum("both"), F.min("both"), F.max("both"), F.min("na"), F.max("nb")).first()
    took = time.time() - began
    each = [max(150 - d, 0) + max(d - 50, 0) for d in range(200)]  # of the distance around the ring
    both = [each[(b - a) % 200] for a in range(200) for b in range(200)]
    assert tuple(got) == (3000 * 2999 // 2, (15 * 15 * sum(both) - 3000 * 150) // 2, min(both), 150, 150, 150)
    assert took < 60


def test_blocks_travel_packed():
    """A block of 2,048 sets of 40 of 1,000 elements takes a quarter of its numbers' bytes, and comes out of its parts as it was, nulls counted."""
    dice = random.Random(11)
    sets = {k: dice.sample(range(5_000_000_000, 5_000_001_000), 40) + [None] * (k % 3 == 0) for k in range(2048)}
    rows = pa.RecordBatch.from_pylist([{"id": k, "t": t} for k, ts in sets.items() for t in ts])
    packed = list(set_pairs._pack([rows.slice(0, 50_001), rows.slice(50_001)]))
    assert len(packed) == 1 and sorted(packed[0].column("ts")[0].as_py()) == sorted({t for ts in sets.values() for t in ts} - {None})
    whole = packed[0].column("packed")[0].as_py()
    assert len(whole) < len(sets) * 40 * 8 / 4
    parts = [{"i": 3, "j": j, "block": b, "p": whole[at : at + 9999]} for j, b in ((3, 3), (5, 3), (5, 5)) for at in range(0, len(whole), 9999)]
    table = pa.RecordBatch.from_pylist(parts)
    out = [x for b in set_pairs._unpack([table.slice(0, 7), table.slice(7)]) for x in b.to_pylist()]
    assert [(x["j"], x["block"], x["id"]) for x in out] == [(j, b, k) for j, b in ((3, 3), (5, 3), (5, 5)) for k in sets]
    assert all(x["n"] == len(sets[x["id"]]) and x["ts"] == [t for t in sets[x["id"]] if t] for x in out)


def test_similarity_in_blocks_and_joined(spark, monkeypatch):
    """Both ways round as the SQL does: 1 of 16 (62.5 thousandths) up, and sizes with nulls."""
    dice = random.Random(13)
    sets = {k: {dice.choice([None, *range(9)]) for _ in range(dice.randint(1, 9))} for k in range(40)} | {50: set(range(100, 108)), 51: set(range(107, 116))}
    rows = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "id long, t long")
    want = {(a, b, math.floor(both / (na + nb - both) * 1000 + 0.5) / 1000) for a, b, both, na, nb in pairs_of(sets)}
    assert (50, 51, 0.063) in want
    for few in (0, 10**9):
        monkeypatch.setattr(set_pairs, "BLOCK", 7)
        monkeypatch.setattr(set_pairs, "FEW", few)
        got = [tuple(r) for r in set_pairs.jaccard(rows).select("a", "b", "similarity").collect()]
        assert len(got) == len(want) and set(got) == want


def test_closure_without_rounds(spark, monkeypatch):
    """A chain of 600 nodes with a cycle at its end, of which a round of joins takes four edges; as held and as rounds on a short one."""
    chain = [(f"n{k}", f"n{k + 1}") for k in range(600)] + [("n600", "n590"), ("n600", None), (None, "n1")]
    roots = spark.createDataFrame([("n0",), ("n595",), ("n0",), ("away",), (None,)], "root string")
    e = spark.createDataFrame(chain, "caller string, callee string")
    want = {("n0", f"n{k}") for k in range(1, 601)} | {("n595", f"n{k}") for k in range(590, 601)}
    began = time.time()
    for reflexive, more in ((False, set()), (True, {("n0", "n0"), ("away", "away")})):
        got = [tuple(r) for r in graph.closure(e, roots, reflexive).collect()]
        assert len(got) == len(set(got)) and set(got) == want | more
    assert time.time() - began < 60
    short = e.where("caller IS NULL OR callee IS NULL OR substring(caller, 2) >= '595' AND length(caller) = 4")
    held = [sorted(map(tuple, graph.closure(short, roots, r).collect())) for r in (False, True)]
    assert graph.closure(e.limit(0), roots).count() == 0 and graph.closure(e.limit(0), roots, True).count() == 3
    monkeypatch.setattr(graph, "HELD", 0)
    assert held == [sorted(map(tuple, graph.closure(short, roots, r).collect())) for r in (False, True)]


def test_reflexive_closure_of_a_ring(spark):
    """400 roots around a ring of 400: all 160,000 pairs, each once, in one walk a root instead of a hundred rounds."""
    e = spark.range(400).select(F.col("id").alias("caller"), ((F.col("id") + 1) % 400).alias("callee"))
    began = time.time()
    got = graph.closure(e, spark.range(401).select(F.col("id").alias("root")), reflexive=True)
    assert tuple(got.agg(F.count("*"), F.count_distinct("root", "node"), F.count_if(F.expr("root = 400 AND node = 400"))).first()) == (160_001, 160_001, 1)
    assert time.time() - began < 60


def test_roots_on_a_cycle_share_a_walk(monkeypatch):
    """300 roots on a ring of 300 that leads to a chain, itself with roots: a walk for the ring and one for each other root."""
    edges = [(k, (k + 1) % 300) for k in range(300)] + [(7, 300), (300, 301), (301, 302), (302, 302)]
    first = np.searchsorted([a for a, _ in sorted(edges)], np.arange(304))
    target = np.array([b for _, b in sorted(edges)])
    cycle = graph._cycles(first, target)
    assert len(set(cycle[:300])) == 1 and len(set(cycle)) == 4
    walks, walk = [], graph._walk
    monkeypatch.setattr(graph, "_walk", lambda *a: walks.append(a[0]) or walk(*a))
    monkeypatch.setattr(graph, "CHUNK", 100)
    sent = SimpleNamespace(value=(pa.array(range(303)), first, target, cycle))
    for reflexive in (False, True):
        walks.clear()
        lists = [x for b in graph._walker(sent, reflexive)([pa.RecordBatch.from_pydict({"root": [*range(303), 999]})]) for x in b.to_pylist()]
        got = [(r, n) for x in lists for r in x["roots"] for n in x["nodes"]]
        want = {(r, n) for r in range(300) for n in range(303)} | {(300, 301), (300, 302), (301, 302), (302, 302)}
        assert len(walks) == 4 and len(got) == len(set(got))
        assert set(got) == want | ({(300, 300), (301, 301), (999, 999)} if reflexive else set())


def test_walks_go_from_cycle_to_cycle(monkeypatch):
    """50 rings of 40 in a chain, each with a root of its own beside it: steps of a walk grow with the rings, not with their nodes, and pairs leave in full batches."""
    edges = [(40 * r + k, 40 * r + (k + 1) % 40) for r in range(50) for k in range(40)] + [(40 * r + 20, 40 * r + 40) for r in range(49)] + [(2000 + r, 40 * r) for r in range(50)]
    edges.sort()
    first, target = np.searchsorted([a for a, _ in edges], np.arange(2051)), np.array([b for _, b in edges])
    sizes, walk = set(), graph._walk
    monkeypatch.setattr(graph, "_walk", lambda root, first, *a: sizes.add(len(first) - 1) or walk(root, first, *a))
    monkeypatch.setattr(graph, "CHUNK", 1000)
    sent = SimpleNamespace(value=(pa.array(range(2050)), first, target, graph._cycles(first, target)))
    out = list(graph._paired(graph._walker(sent, False))([pa.RecordBatch.from_pydict({"root": [*range(0, 2000, 8), *range(2000, 2050)]})]))
    got = [(x["root"], x["node"]) for b in out for x in b.to_pylist()]
    want = {(a, n) for a in [*range(0, 2000, 8), *range(2000, 2050)] for n in range(a // 40 * 40 if a < 2000 else (a - 2000) * 40, 2000)}
    assert sizes == {100} and len(got) == len(set(got)) and set(got) == want
    assert all(500 <= len(b) <= 1500 for b in out[:-1])


def items_of(spark, rows):
    kinds = "pattern_id string, ord long, nodes int, shape_terms array<string>, call_terms array<string>, invocation_terms array<string>"
    return spark.createDataFrame(rows, kinds), spark.createDataFrame([], "pattern_id string, strictness string, ord long")


def test_similarity_by_classes_is_that_of_all_pairs(spark):
    """Random patterns; some with sizes of 0, of one row, or with nulls and repeated orders."""
    dice = random.Random(7)
    some = lambda: dice.sample("abcd", dice.randint(0, 3))
    rows = [(f"p{p}", k, dice.choice([0, 1, 2, 3, 7, 50, 51] if p % 3 else [4, 9]), some(), some()[:1], ["i"]) for p in range(12) for k in range(dice.choice([1, 2, 3, 30]))]
    rows += [("odd", 1, 5, ["a"], None, ["i"]), ("odd", 1, 6, ["a"], [], ["i"]), ("odd", 2, None, ["b"], ["a"], []), ("odd", None, 3, ["b"], ["a"], [])]
    items, none = items_of(spark, rows)
    s = F.col("similarity")
    each = patterns._pairs(items, "pattern_id", "ord").groupBy("pattern_id").agg(F.count("*").alias("pairs"), F.avg(s), F.min(s), F.max(s))
    want = {r[0]: (r[1], *(round(x, 3) for x in r[2:])) for r in each.collect()}
    got = {r.pattern_id: r for r in patterns.similarity_summary(items, none).collect()}
    assert set(got) == {r[0] for r in rows} and len(want) > 8 and "odd" in want
    for name, r in got.items():
        assert (r.pairs, r.mean, r.least, r.most) == pytest.approx(want.get(name, (0, None, None, None)), abs=0.00101 if name in want else None)


def test_similarity_of_a_large_pattern(spark):
    """30,000 items of two classes: 450 million pairs."""
    _, none = items_of(spark, [("p", 0, 1, [], [], [])])
    x = spark.range(30_000).select(F.lit("p").alias("pattern_id"), F.col("id").alias("ord"), F.lit(10).alias("nodes"), F.array(F.when(F.col("id") < 10_000, "a").otherwise("b")).alias("shape_terms"), F.array(F.lit("c")).alias("call_terms"), F.array(F.lit("i")).alias("invocation_terms"))
    began = time.time()
    r = patterns.similarity_summary(x, none).first()
    alike = (10_000 * 9_999 + 20_000 * 19_999) // 2
    assert (r.scored, r.pairs, r.least, r.most) == (30_000, 30_000 * 29_999 // 2, 0.48, 1.0)
    assert r.mean == pytest.approx(0.48 + 0.52 * alike / r.pairs, abs=0.0005)
    assert time.time() - began < 60
