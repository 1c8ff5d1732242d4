"""Cycle-safe reachability over an edge table, as rounds of joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from coppice.sources.stored import drop, written


stored = written


#: Hops that one round takes, tables of found rows that are kept apart, and edges up to which each task gets them all.
HOPS, PARTS, SMALL = 4, 6, 200_000
#: Edges up to which a closure's tasks each hold the whole graph.
HELD = 1_000_000
#: Pairs of a closure that leave Python at once, and tasks for each core that walk from its roots.
CHUNK, TASKS = 1 << 16, 4


def _spread(edges: DataFrame, frontier: DataFrame, keys: list[str], max_hops: int | None = None, begin: DataFrame | None = None) -> DataFrame:
    """Rows (keys with node) that edges (__from, node) lead to from the frontier, in one hop or more; with those of ``begin``.

    A round takes several hops, so few rounds write a table: what one finds goes on from where its last hop ended.
    Earlier finds are one anti-join; their tables are merged when there are many.
    """
    small = edges.limit(SMALL + 1).count() <= SMALL
    e = F.broadcast(edges) if small else edges
    cols = [*keys, "node"]
    parts, frontier, done = ([] if begin is None else [begin]), frontier.select(*cols), 0
    while True:
        hops = HOPS if max_hops is None else min(HOPS, max_hops - done)
        if hops <= 0:
            break
        step, found = frontier, None
        for k in range(hops):
            step = step.withColumnRenamed("node", "__from").join(e, "__from").select(*cols).distinct()
            one = step.withColumn("__hop", F.lit(k))
            found = one if found is None else found.unionByName(one)
        new = found.groupBy(*cols).agg(F.min("__hop").alias("__hop"))
        for p in parts:
            new = new.join(p.select(*cols), cols, "left_anti")
        new = written(new, "graph")
        if new.isEmpty():
            break
        parts.append(new)
        done += hops
        frontier = new.where(F.col("__hop") == hops - 1).select(*cols)
        if len(parts) > PARTS:
            whole = written(_all(parts, cols), "graph")
            drop(*parts[1 if begin is not None else 0 : -1])
            parts = [whole]
            begin = whole
    return _all(parts, cols) if parts else frontier.limit(0)


def _all(parts: list[DataFrame], cols: list[str]) -> DataFrame:
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols))
    return out


def closure(edges: DataFrame, seeds: DataFrame, reflexive: bool = False, max_hops: int | None = None, caller: str = "caller", callee: str = "callee", root: str = "root") -> DataFrame:
    """(root, node) for every node that a path of at least one edge leads to from a seed.

    ``reflexive`` adds (root, root). Cycles end, as only pairs that are new go on; null ends are left out.
    """
    e = edges.select(F.col(caller).alias("__from"), F.col(callee).alias("node")).where("__from IS NOT NULL AND node IS NOT NULL").distinct()
    start = seeds.select(F.col(root).alias("root")).where("root IS NOT NULL").distinct()
    if max_hops is None and len(held := e.limit(HELD + 1).toArrow()) <= HELD:
        return _closure_held(held, start, reflexive)
    out = _spread(stored(e), start.withColumn("node", F.col("root")), ["root"], max_hops)
    return out.unionByName(start.select("root", F.col("root").alias("node"))).distinct() if reflexive else out


def _closure_held(edges: pa.Table, start: DataFrame, reflexive: bool) -> DataFrame:
    """The closure where each task holds the graph and walks it from its own roots, so no round is joined or written."""
    context, kind = start.sparkSession.sparkContext, from_arrow_type(edges.schema.field("node").type)
    source, target = edges.column("__from"), edges.column("node")
    ends = pa.concat_arrays([*source.cast(target.type).chunks, *target.chunks]) if len(edges) else pa.array([], target.type)
    coded = ends.dictionary_encode()
    code, nodes = coded.indices.to_numpy(), coded.dictionary
    source, target = code[: len(edges)], code[len(edges) :]
    first = np.concatenate([[0], np.cumsum(np.bincount(source, minlength=len(nodes)))])
    target = target[np.argsort(source, kind="stable")]
    sent = context.broadcast((nodes, first, target, _cycles(first, target)))
    out = StructType([start.schema["root"], StructField("node", kind)])
    # pairs leave Python as flat columns; made from lists in generated code, a list's pairs would all be held and copied one by one
    return start.repartition(TASKS * context.defaultParallelism, "root").mapInArrow(_paired(_walker(sent, reflexive)), out)


def _cycles(first: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each node one that stands for its strongly connected component (Tarjan, without recursion)."""
    n, first, target = len(first) - 1, first.tolist(), target.tolist()
    of, number, low, at = [-1] * n, [0] * n, [0] * n, first[:]
    clock, waiting = 0, []
    for start in range(n):
        path = [] if number[start] else [start]
        while path:
            v = path[-1]
            if not number[v]:
                clock += 1
                number[v] = low[v] = clock
                waiting.append(v)
            if at[v] < first[v + 1]:
                w = target[at[v]]
                at[v] += 1
                if not number[w]:
                    path.append(w)
                elif of[w] < 0:
                    low[v] = min(low[v], number[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            while low[v] == number[v] and of[v] < 0:
                of[waiting.pop()] = v
    return np.array(of, np.int64)


def _condensed(first: np.ndarray, target: np.ndarray, cycle: np.ndarray) -> tuple[np.ndarray, ...]:
    """The graph of cycles: the cycle of each node, edges between them as ``first`` and ``target`` (one to itself if it has an edge inside), and their nodes with where each cycle's begin."""
    _, of = np.unique(cycle, return_inverse=True)
    n = int(of.max()) + 1 if len(of) else 0
    pairs = np.unique(np.repeat(of, np.diff(first)) * n + of[target])
    source = pairs // max(1, n)
    return of, np.searchsorted(source, np.arange(n + 1)), pairs % max(1, n), np.argsort(of, kind="stable"), np.searchsorted(np.sort(of), np.arange(n + 1))


def _ranges(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, ``many`` numbers for each."""
    at = np.repeat(begin - (np.cumsum(many) - many), many)
    at += np.arange(len(at))
    return at


def _walker(sent, reflexive: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists of roots and of nodes, each of which all those roots reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, first, target, cycle = sent.value
        of, first, target, members, begins = _condensed(first, target, cycle)
        for batch in batches:
            roots = batch.column(0)
            at = pc.index_in(roots.cast(nodes.type), nodes)
            inside = [(of[i], k) for k, i in enumerate(at.to_pylist()) if i is not None]
            if reflexive:
                alone = pc.is_null(at)
                alone = roots.filter(alone)
                each = np.arange(len(alone) + 1)
                yield _lists(alone, each, alone.cast(nodes.type), each)
            for one, same in groupby(sorted(inside), lambda x: x[0]):
                to = _walk(one, first, target, reflexive)
                to = members[_ranges(begins[to], begins[to + 1] - begins[to])]
                mine = roots.take(pa.array([k for _, k in same]))
                for begin in range(0, len(to), CHUNK):
                    part = to[begin : begin + CHUNK]
                    yield _lists(mine, [0, len(mine)], nodes.take(pa.array(part)), [0, len(part)])

    return run


def _lists(roots: pa.Array, root_ends, nodes: pa.Array, node_ends) -> pa.RecordBatch:
    lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for ends, x in ((root_ends, roots), (node_ends, nodes)))
    return pa.RecordBatch.from_arrays([*lists], ["roots", "nodes"])


def _paired(run: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of such lists as flat columns; small ones leave together."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for a, b in (x for lists in run(batches) for x in _pieces(lists)):
            parts.append((a, b))
            rows += len(a)
            if 2 * rows >= CHUNK:
                yield _joined(parts)
                parts, rows = [], 0
        if rows:
            yield _joined(parts)

    return pairs


def _pieces(lists: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    roots, nodes = lists.columns
    if len(roots.flatten()) == len(nodes.flatten()) == len(lists):
        yield roots.flatten(), nodes.flatten()
        return
    for row in range(len(lists)):
        a, b = roots[row].values, nodes[row].values
        many = max(1, CHUNK // max(1, len(b)))
        for begin in range(0, len(a), many):
            some = a.slice(begin, many)
            each = some.take(pa.array(np.repeat(np.arange(len(some)), len(b))))
            yield each, b if len(some) == 1 else b.take(pa.array(np.tile(np.arange(len(b)), len(some))))


def _joined(parts: list[tuple[pa.Array, pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*parts)], ["root", "node"])


def _walk(root: int, first: np.ndarray, target: np.ndarray, reflexive: bool) -> np.ndarray:
    """Nodes at the end of a path from the root, of at least one edge unless reflexive."""
    seen = np.zeros(len(first) - 1, bool)
    seen[root] = reflexive
    frontier = np.array([root])
    while len(frontier):
        step = target[_ranges(first[frontier], first[frontier + 1] - first[frontier])]
        frontier = np.unique(step[~seen[step]])
        seen[frontier] = True
    return np.flatnonzero(seen)


def reachable(edges: DataFrame, seeds: DataFrame, caller: str = "caller", callee: str = "callee", node: str = "node") -> DataFrame:
    """Nodes that some seed reaches, seeds included."""
    e = stored(edges.select(F.col(caller).alias("__from"), F.col(callee).alias("node")).where("__from IS NOT NULL AND node IS NOT NULL").distinct())
    start = stored(seeds.select(F.col(node).alias("node")).distinct())
    return _spread(e, start, [], None, start)


def reverse_closure(edges: DataFrame, targets: DataFrame, caller: str = "caller", callee: str = "callee", node: str = "node") -> DataFrame:
    """Targets and everything that reaches one."""
    return reachable(edges, targets, callee, caller, node)


def induced(edges: DataFrame, nodes: DataFrame, caller: str = "caller", callee: str = "callee", node: str = "node") -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select(F.col(node).alias("__n")).distinct()
    return edges.join(n, F.col(caller) == F.col("__n"), "left_semi").join(n, F.col(callee) == F.col("__n"), "left_semi").select(caller, callee).distinct()


def undirected(edges: DataFrame, caller: str = "caller", callee: str = "callee") -> DataFrame:
    return edges.select(caller, callee).unionByName(edges.select(F.col(callee).alias(caller), F.col(caller).alias(callee))).distinct()


def projected_kernel(edges: DataFrame, roots: DataFrame, projected: DataFrame, caller: str = "caller", callee: str = "callee") -> tuple[DataFrame, DataFrame]:
    """Projected nodes that have a support root (themselves, if they are one), and the nodes that reach those."""
    supported = reachable(edges, roots, caller, callee)
    kept = stored(projected.select("node").distinct().join(supported, "node", "left_semi"))
    return kept, reverse_closure(edges, kept, caller, callee)


def propagate_labels(edges: DataFrame, seeds: DataFrame, caller: str = "caller", callee: str = "callee") -> DataFrame:
    """(node, label): the smallest label of a seed that reaches the node, in rounds until nothing changes.

    Only labels that fell go on to the next round.
    """
    e = stored(edges.select(F.col(caller).alias("__from"), F.col(callee).alias("__to")).where("__from IS NOT NULL AND __to IS NOT NULL").distinct())
    e = F.broadcast(e) if e.limit(SMALL + 1).count() <= SMALL else e
    best = stored(seeds.groupBy("node").agg(F.min("label").alias("label")))
    fell = best
    while True:
        step = fell
        for _ in range(HOPS):
            step = step.unionByName(step.join(e, F.col("node") == F.col("__from")).select(F.col("__to").alias("node"), "label")).groupBy("node").agg(F.min("label").alias("label"))
        both = best.select("node", "label", F.lit(False).alias("new")).unionByName(step.select("node", "label", F.lit(True).alias("new")))
        now = both.groupBy("node").agg(F.min("label").alias("label"), F.min(F.when(~F.col("new"), F.col("label"))).alias("before"))
        now = stored(now.select("node", "label", (F.col("before").isNull() | (F.col("label") < F.col("before"))).alias("fell")))
        fell, best = now.where("fell").select("node", "label"), now.select("node", "label")
        if fell.isEmpty():
            return best
