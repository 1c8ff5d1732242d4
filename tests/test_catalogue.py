"""Every query of the catalogue against its SQL, and the reachability operators on small graphs."""

import glob
import math
import os

import duckdb
import pytest

from coppice.operators import components, graph
from coppice.plans import all_queries as catalogue


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_is_its_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in cur.fetchall())


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "caller string, callee string")


def test_chain_supports_are_not_reflexive(spark):
    e, r = edges(spark, ("r", "a"), ("a", "b")), spark.createDataFrame([("r",)], "root string")
    assert {tuple(x) for x in graph.closure(e, r).collect()} == {("r", "a"), ("r", "b")}
    assert {tuple(x) for x in graph.closure(e, r, reflexive=True).collect()} == {("r", "r"), ("r", "a"), ("r", "b")}
    assert {tuple(x) for x in graph.closure(e, r, max_hops=1).collect()} == {("r", "a")}


def test_cycle_supports_its_root(spark):
    got = graph.closure(edges(spark, ("r", "a"), ("a", "r")), spark.createDataFrame([("r",)], "root string"))
    assert {tuple(x) for x in got.collect()} == {("r", "a"), ("r", "r")}


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 9), (2, 2), (7, 8), (8, 6), (None, 1), (9, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(e).collect()}
    assert got == {4: 4, 5: 4, 9: 4, 2: 2, 6: 6, 7: 6, 8: 6}
    assert components.connected_components(e.limit(0)).count() == 0


def test_every_caller_is_a_root(spark, tmp_path):
    """Errors of users 1, 2, 3, 20 in a row, and an edge that no other leads to: no root is left out by its number."""
    users = [(1, "error", 5.0), (2, "error", 5.0), (3, "error", 5.0), (20, "error", 500.0), (7, "view", 5.0), (9, "error", 5.0), (20, "error", 5.0), (1, "view", 5.0)]
    spark.createDataFrame([(k, *u) for k, u in enumerate(users)], "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in catalogue.QUERIES["support_closure"](spark, str(tmp_path)).select("root", "node").collect()]
    assert sorted(got) == [(1, 2), (1, 3), (1, 20), (2, 3), (2, 20), (3, 20), (9, 20)]
