"""Each operator as a query over the relational test tables, with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.functions import text as T
from coppice.operators import graph as G
from coppice.operators import relational as R
from coppice.operators import set_pairs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


HOSTS_SQL = "hosts AS (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS id, count(*) AS n FROM pages GROUP BY 1)"
ANC_SQL = "anc AS (SELECT id, d, array_to_string(string_split(id, '.')[1:d], '.') AS a FROM (SELECT id, unnest(range(1, len(string_split(id, '.')))) AS d FROM hosts))"


def _hosts(spark, sf):
    return _t(spark, sf, "pages").groupBy(F.regexp_extract("url", "://([^/?#]+)", 1).alias("id")).agg(F.count("*").alias("n"))


@query(f"WITH {HOSTS_SQL}, {ANC_SQL} SELECT id, a AS ancestor FROM anc")
def id_ancestors(spark, sf):
    return _hosts(spark, sf).select("id", F.explode(T.ancestors(F.col("id"))).alias("ancestor"))


@query(f"""WITH {HOSTS_SQL}, {ANC_SQL}, vis AS (SELECT id FROM hosts WHERE n >= 3 UNION SELECT a FROM anc WHERE d = 1),
m AS (SELECT anc.id, max(d) AS d FROM anc JOIN vis ON anc.a = vis.id GROUP BY 1)
SELECT hosts.id, anc.a AS parent_id FROM hosts LEFT JOIN m USING (id) LEFT JOIN anc ON anc.id = hosts.id AND anc.d = m.d""")
def id_tree_nearest_visible(spark, sf):
    hosts = _hosts(spark, sf)
    visible = hosts.where("n >= 3").select("id").unionByName(hosts.select(T.top_level(F.col("id")).alias("id")))
    return R.nearest_visible(hosts, visible, "id")


@query(f"WITH {HOSTS_SQL} SELECT split_part(id, '.', 1) AS value, count(*) AS count FROM hosts GROUP BY 1")
def top_level_counts(spark, sf):
    return R.grouped_count(_hosts(spark, sf), T.top_level(F.col("id")))


@query("SELECT source AS value, count(*) AS count FROM documents GROUP BY 1")
def grouped_counts(spark, sf):
    return R.grouped_count(_t(spark, sf, "documents"), F.col("source"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'planned' WHEN 'O' THEN 'current' ELSE 'deprecated' END AS state FROM orders
WHERE o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 20)""")
def lifecycle_filter(spark, sf):
    orders = _t(spark, sf, "orders").where("o_orderstatus <> 'P'")
    out = R.unsupported(orders, "o_orderkey", (_t(spark, sf, "lineitem").where("l_quantity >= 20"), "l_orderkey"))
    return out.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "planned").when(F.col("o_orderstatus") == "O", "current").otherwise("deprecated").alias("state"))


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS planned, count(*) FILTER (o_orderstatus = 'F') AS deprecated,
count(*) FILTER (v > 0) AS verified, count(*) FILTER (o_orderstatus <> 'P' AND v = 0) AS unverified FROM
(SELECT o.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 20) AS v FROM orders o)""")
def spec_metrics(spark, sf):
    v = _t(spark, sf, "lineitem").where("l_quantity >= 20").groupBy("l_orderkey").agg(F.count("*").alias("v"))
    o = _t(spark, sf, "orders").join(v, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("v", F.coalesce("v", F.lit(0)))
    return o.agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "P").alias("planned"), F.count_if(F.col("o_orderstatus") == "F").alias("deprecated"),
                 F.count_if(F.col("v") > 0).alias("verified"), F.count_if((F.col("o_orderstatus") != "P") & (F.col("v") == 0)).alias("unverified"))


FIRST_SQL = "f AS (SELECT doc_id, source, lower(split_part(coalesce(text, ''), chr(10), 1)) AS id FROM documents)"


def _first_lines(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", "source", F.lower(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), 0)).alias("id"))


@query(f"WITH {FIRST_SQL} SELECT id, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM f GROUP BY id")
def first_declaration_wins(spark, sf):
    return R.first_declaration(_first_lines(spark, sf), "id", [F.col("doc_id")]).select("id", "doc_id", "source")


@query(f"WITH {FIRST_SQL} SELECT * FROM (SELECT id, doc_id, lag(doc_id) OVER (PARTITION BY id ORDER BY doc_id) AS previous FROM f) WHERE previous IS NOT NULL")
def duplicate_previous_decl(spark, sf):
    return R.previous_declaration(_first_lines(spark, sf), "id", [F.col("doc_id")], "doc_id").select("id", "doc_id", "previous")


@query(f"WITH {HOSTS_SQL}, {ANC_SQL} SELECT DISTINCT a AS missing_id FROM anc WHERE a NOT IN (SELECT id FROM hosts)")
def missing_intermediates(spark, sf):
    return R.missing_intermediates(_hosts(spark, sf), "id")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def unknown_refs(spark, sf):
    return R.unsupported(_t(spark, sf, "labels"), "doc_id", (_t(spark, sf, "documents").where("lang = 'en'"), "doc_id")).select("doc_id")


@query("SELECT l.doc_id, d.lang AS kind FROM labels l JOIN documents d USING (doc_id) WHERE d.lang <> 'en'")
def kind_mismatch_refs(spark, sf):
    return _t(spark, sf, "labels").join(_t(spark, sf, "documents"), "doc_id").where("lang <> 'en'").select("doc_id", F.col("lang").alias("kind"))


OR_SQL = """own AS (SELECT DISTINCT c_custkey, s_suppkey FROM customer, supplier WHERE (c_custkey % 97 = s_suppkey % 97 AND c_nationkey = s_nationkey) OR (c_custkey = s_suppkey))"""


def _either(spark, sf):
    c, s = _t(spark, sf, "customer").select("c_custkey", "c_nationkey"), _t(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return R.either_match(c, s, [(F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_custkey") % 97 == F.col("s_suppkey") % 97), F.col("c_custkey") == F.col("s_suppkey")])


@query(f"WITH {OR_SQL} SELECT c_custkey, s_suppkey FROM own")
def ownership_or_join(spark, sf):
    return _either(spark, sf).select("c_custkey", "s_suppkey")


@query(f"WITH {OR_SQL} SELECT c_custkey, min(s_suppkey) AS owner FROM own GROUP BY 1")
def ownership_first_match(spark, sf):
    return _either(spark, sf).groupBy("c_custkey").agg(F.min("s_suppkey").alias("owner"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unowned_items(spark, sf):
    return R.unsupported(_t(spark, sf, "part"), "p_partkey", (_t(spark, sf, "lineitem").where("l_quantity > 45"), "l_partkey")).select("p_partkey", "p_name")


@query("""WITH x AS (SELECT p_partkey, l_suppkey FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 46) l ON l_partkey = p_partkey)
SELECT p_partkey, count(DISTINCT l_suppkey) AS candidates, CASE count(DISTINCT l_suppkey) WHEN 1 THEN 'unique' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS resolution,
CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS resolved FROM x GROUP BY 1""")
def module_resolution(spark, sf):
    pairs = _t(spark, sf, "part").join(_t(spark, sf, "lineitem").where("l_quantity > 46"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return R.resolve_unique(pairs, "p_partkey", "l_suppkey")


BRAND_SQL = """l AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 48),
be AS (SELECT DISTINCT a.p_brand AS src, b.p_brand AS dst FROM l a JOIN l b USING (l_orderkey) WHERE a.p_brand <> b.p_brand)"""


def _brand_edges(spark, sf):
    x = _t(spark, sf, "lineitem").where("l_quantity >= 48").join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand").distinct()
    return x.select("l_orderkey", F.col("p_brand").alias("src")).join(x.select("l_orderkey", F.col("p_brand").alias("dst")), "l_orderkey").where("src <> dst").select("src", "dst").distinct()


@query(f"""WITH {BRAND_SQL}, n AS (SELECT DISTINCT p_brand AS module FROM part), o AS (SELECT src, count(*) AS c FROM be GROUP BY 1), i AS (SELECT dst, count(*) AS c FROM be GROUP BY 1)
SELECT module, coalesce(o.c, 0) AS fan_out, coalesce(i.c, 0) AS fan_in, CASE WHEN coalesce(o.c, 0) + coalesce(i.c, 0) > 0 THEN coalesce(o.c, 0) / (coalesce(o.c, 0) + coalesce(i.c, 0)) ELSE 0.0 END AS instability
FROM n LEFT JOIN o ON o.src = module LEFT JOIN i ON i.dst = module""")
def coupling_metrics(spark, sf):
    return R.coupling(_t(spark, sf, "part").select(F.col("p_brand").alias("module")), _brand_edges(spark, sf), "module", "src", "dst")


@query("SELECT l_suppkey AS target, count(*) AS uses, count(DISTINCT l_partkey) AS distinct_uses FROM lineitem GROUP BY 1")
def dependency_targets(spark, sf):
    return _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("target")).agg(F.count("*").alias("uses"), F.countDistinct("l_partkey").alias("distinct_uses"))


@query("""SELECT n_name, count(*) AS items, CAST(sum(c_custkey % 17) AS BIGINT) AS total, max(c_custkey % 17) AS most, CAST(sum(CASE WHEN c_acctbal > 0 THEN c_custkey % 5 ELSE 0 END) AS BIGINT) AS public_params
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def complexity_rollup(spark, sf):
    k = F.col("c_custkey")
    return _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(
        F.count("*").alias("items"), F.sum(k % 17).alias("total"), F.max(k % 17).alias("most"), F.sum(F.when(F.col("c_acctbal") > 0, k % 5).otherwise(0)).alias("public_params"))


@query("SELECT c_mktsegment, count(*) FILTER (c_acctbal >= 0) AS public_items, count(*) FILTER (c_acctbal < 0) AS internal_items FROM customer GROUP BY 1")
def surface_counts(spark, sf):
    return _t(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") >= 0).alias("public_items"), F.count_if(F.col("c_acctbal") < 0).alias("internal_items"))


@query("SELECT r_name AS area, count(c_custkey) AS descendants FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def area_descendants(spark, sf):
    return _t(spark, sf, "region").join(_t(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(_t(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("r_name").alias("area")).agg(F.count("c_custkey").alias("descendants"))


@query("""WITH p AS (SELECT l_suppkey % 10 AS module, 1 AS rank, count(*) AS n, max(l_quantity) AS most FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1
UNION ALL SELECT l_suppkey % 10, 2, count(*), max(l_quantity) FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT module, CAST(sum(n) AS BIGINT) AS n, max(most) AS most, arg_min(n, rank) AS first_n FROM p GROUP BY 1""")
def provider_merge(spark, sf):
    x = _t(spark, sf, "lineitem")
    part = lambda c, r: x.where(c).groupBy((F.col("l_suppkey") % 10).alias("module")).agg(F.lit(r).alias("rank"), F.count("*").alias("n"), F.max("l_quantity").alias("most"))
    both = part("l_returnflag = 'R'", 1).unionByName(part("l_returnflag <> 'R'", 2))
    return both.groupBy("module").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min_by("n", "rank").alias("first_n"))


E_SQL = "e AS (SELECT DISTINCT a.user_id AS caller, b.user_id AS callee FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_type = 'error' AND b.event_type = 'error' AND a.value < 120 AND a.user_id <> b.user_id)"
ROOTS_SQL = "roots AS (SELECT DISTINCT caller AS root FROM e WHERE caller % 10 = 0)"


def _edges(spark, sf):
    ev = _t(spark, sf, "events").where("event_type = 'error'")
    a = ev.where("value < 120").select(F.col("event_id").alias("i"), F.col("user_id").alias("caller"))
    b = ev.select((F.col("event_id") - 1).alias("i"), F.col("user_id").alias("callee"))
    return G.stored(a.join(b, "i").where("caller <> callee").select("caller", "callee").distinct())


def _roots(edges):
    return edges.where("caller % 10 = 0").select(F.col("caller").alias("root")).distinct()


@query(f"""WITH RECURSIVE {E_SQL}, c(root, node) AS (SELECT caller, callee FROM e UNION SELECT c.root, e.callee FROM c JOIN e ON e.caller = c.node)
SELECT root, node FROM c""")
def support_closure(spark, sf):
    e = _edges(spark, sf)
    return G.closure(e, e.select(F.col("caller").alias("root")))


@query(f"""WITH RECURSIVE {E_SQL}, {ROOTS_SQL}, c(root, node) AS (SELECT root, root FROM roots UNION SELECT c.root, e.callee FROM c JOIN e ON e.caller = c.node)
SELECT root, node FROM c""")
def support_closure_reflexive(spark, sf):
    e = _edges(spark, sf)
    return G.closure(e, _roots(e), reflexive=True)


REV_SQL = f"WITH RECURSIVE {E_SQL}, r(node) AS (SELECT DISTINCT callee FROM e WHERE callee % 50 = 3 UNION SELECT e.caller FROM r JOIN e ON e.callee = r.node)"


@query(f"{REV_SQL} SELECT node FROM r")
def reverse_closure_nodes(spark, sf):
    e = _edges(spark, sf)
    return G.reverse_closure(e, e.where("callee % 50 = 3").select(F.col("callee").alias("node")))


@query(f"{REV_SQL} SELECT caller, callee FROM e WHERE caller IN (SELECT node FROM r) AND callee IN (SELECT node FROM r)")
def induced_edges(spark, sf):
    e = _edges(spark, sf)
    return G.induced(e, G.reverse_closure(e, e.where("callee % 50 = 3").select(F.col("callee").alias("node"))))


@query(f"""WITH RECURSIVE {E_SQL}, s AS (SELECT caller, callee FROM e WHERE caller % 3 = callee % 3), u AS (SELECT caller, callee FROM s UNION SELECT callee, caller FROM s),
c(node) AS (SELECT DISTINCT caller FROM e WHERE caller % 10 = 0 UNION SELECT u.callee FROM c JOIN u ON u.caller = c.node) SELECT node FROM c""")
def module_connected(spark, sf):
    e = _edges(spark, sf)
    return G.reachable(G.undirected(e.where("caller % 3 = callee % 3")), e.where("caller % 10 = 0").select(F.col("caller").alias("node")))


@query(f"""WITH RECURSIVE {E_SQL}, nodes AS (SELECT caller AS node FROM e UNION SELECT callee FROM e), c(node) AS (SELECT node FROM nodes WHERE node % 25 = 0 UNION SELECT e.callee FROM c JOIN e ON e.caller = c.node)
SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM c)""")
def unreached_items(spark, sf):
    e = _edges(spark, sf)
    nodes = e.select(F.col("caller").alias("node")).union(e.select("callee")).distinct()
    return nodes.join(G.reachable(e, nodes.where("node % 25 = 0")), "node", "left_anti")


@query(f"""WITH RECURSIVE {E_SQL}, c(node, label) AS (SELECT DISTINCT caller, caller FROM e WHERE caller % 10 = 0 UNION SELECT e.callee, c.label FROM c JOIN e ON e.caller = c.node)
SELECT node, min(label) AS label FROM c GROUP BY node""")
def label_propagation(spark, sf):
    e = _edges(spark, sf)
    return G.propagate_labels(e, e.where("caller % 10 = 0").select(F.col("caller").alias("node"), F.col("caller").alias("label")))


BIP_SQL = """b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49),
be AS (SELECT DISTINCT x.l_orderkey AS caller, y.l_orderkey AS callee FROM b x JOIN b y USING (p_brand) WHERE x.l_orderkey <> y.l_orderkey)"""


def _members(spark, sf):
    return _t(spark, sf, "lineitem").where("l_quantity >= 49").join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand").distinct()


def _scoped(spark, sf, hops):
    """Items in the target and, over shared modules, those within so many hops (None: to a fixpoint)."""
    b = G.stored(_members(spark, sf))
    hop = b.select(F.concat(F.lit("i"), F.col("l_orderkey").cast("string")).alias("caller"), F.concat(F.lit("m"), "p_brand").alias("callee"))
    seeds = b.where("l_orderkey % 100 < 5").select(F.concat(F.lit("i"), F.col("l_orderkey").cast("string")).alias("node"))
    if hops is None:
        reached = G.reachable(G.undirected(hop), seeds)
    else:
        modules = hop.join(seeds.withColumnRenamed("node", "caller").distinct(), "caller", "left_semi").select("callee").distinct()
        reached = hop.join(modules, "callee", "left_semi").select(F.col("caller").alias("node")).union(seeds).distinct()
    return reached.where("node LIKE 'i%'").select(F.substring("node", 2, 20).cast("long").alias("item"))


@query(f"WITH RECURSIVE {BIP_SQL}, c(node) AS (SELECT l_orderkey FROM b WHERE l_orderkey % 100 < 5 UNION SELECT be.callee FROM c JOIN be ON be.caller = c.node) SELECT node AS item FROM c")
def scoped_boundary_fixpoint(spark, sf):
    return _scoped(spark, sf, None)


@query(f"WITH {BIP_SQL} SELECT l_orderkey AS item FROM b WHERE l_orderkey % 100 < 5 UNION SELECT be.callee FROM b JOIN be ON be.caller = b.l_orderkey WHERE l_orderkey % 100 < 5")
def scoped_boundary_one_hop(spark, sf):
    return _scoped(spark, sf, 1)


@query(f"""WITH RECURSIVE {E_SQL}, s(node) AS (SELECT DISTINCT caller FROM e WHERE caller % 10 = 0 UNION SELECT e.callee FROM s JOIN e ON e.caller = s.node),
k AS (SELECT DISTINCT callee AS node FROM e WHERE callee % 7 = 0 AND callee IN (SELECT node FROM s)), r(node) AS (SELECT node FROM k UNION SELECT e.caller FROM r JOIN e ON e.callee = r.node)
SELECT node, node IN (SELECT node FROM k) AS preserved FROM r""")
def projected_kernel(spark, sf):
    e = _edges(spark, sf)
    kept, nodes = G.projected_kernel(e, e.where("caller % 10 = 0").select(F.col("caller").alias("node")), e.where("callee % 7 = 0").select(F.col("callee").alias("node")))
    return nodes.join(kept.select("node", F.lit(True).alias("preserved")), "node", "left").select("node", F.coalesce("preserved", F.lit(False)).alias("preserved"))


@query("""SELECT category, count(*) AS items FROM (SELECT CASE WHEN bool_or(l_returnflag = 'N') THEN 'current' WHEN bool_or(l_returnflag = 'A') THEN 'planned' WHEN bool_or(l_returnflag = 'R') THEN 'deprecated'
WHEN p_size > 25 THEN 'unverified_test' WHEN p_size > 10 THEN 'mediated' ELSE 'unexplained' END AS category FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity >= 49) l ON l_partkey = p_partkey GROUP BY p_partkey, p_size) GROUP BY 1""")
def category_waterfall(spark, sf):
    x = _t(spark, sf, "part").join(_t(spark, sf, "lineitem").where("l_quantity >= 49"), F.col("l_partkey") == F.col("p_partkey"), "left")
    flag = lambda f: F.coalesce(F.bool_or(F.col("l_returnflag") == f), F.lit(False))
    x = x.groupBy("p_partkey", "p_size").agg(flag("N").alias("c"), flag("A").alias("p"), flag("R").alias("d"))
    cat = R.waterfall((F.col("c"), "current"), (F.col("p"), "planned"), (F.col("d"), "deprecated"), (F.col("p_size") > 25, "unverified_test"), (F.col("p_size") > 10, "mediated"), otherwise="unexplained")
    return x.groupBy(cat.alias("category")).agg(F.count("*").alias("items"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY source HAVING count(*) > 3)")
def annotated_anti_join(spark, sf):
    docs, labels = _t(spark, sf, "documents").select("doc_id", "source"), _t(spark, sf, "labels")
    noisy = docs.join(labels.where("quality = 0"), "doc_id").groupBy("source").agg(F.count("*").alias("n")).where("n > 3")
    return R.unsupported(docs, "doc_id", (labels, "doc_id")).join(noisy.select("source"), "source", "left_anti").select("doc_id")


@query("SELECT doc_id, source, CAST(n - 1 AS BIGINT) AS peer_count FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def duplicate_items(spark, sf):
    return R.duplicates(_t(spark, sf, "documents"), [F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), F.length("text")]).select("doc_id", "source", "peer_count")


@query(r"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(p_name || 'CamelCase', '([^ ])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 3))), ',') AS terms FROM part""")
def name_terms(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.array_join(T.name_terms(F.concat("p_name", F.lit("CamelCase"))), ",").alias("terms"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_type || ' ' || p_name, ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(list_transform(w, lambda k: 'node:' || k), list_transform(range(1, len(w)), lambda i: 'edge:' || w[i] || '>' || w[i + 1])))), ',') AS terms FROM w""")
def shape_edge_terms(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.array_join(T.shape_terms(F.split(F.concat_ws(" ", "p_type", "p_name"), " ")), ",").alias("terms"))


SETS_SQL = "s AS (SELECT o_custkey AS id, list(DISTINCT l_suppkey) AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"


def _sets(spark, sf):
    x = _t(spark, sf, "orders").join(_t(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("id"), F.col("l_suppkey").alias("t")).distinct()
    return G.stored(x)


@query(f"""WITH {SETS_SQL} SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) * 1000) / 1000 AS similarity
FROM s x JOIN s y ON x.id < y.id WHERE len(list_intersect(x.t, y.t)) > 0""")
def jaccard_pairs(spark, sf):
    return set_pairs.jaccard(_sets(spark, sf))


@query("""WITH sp AS (SELECT p_brand AS path, p_partkey AS span, p_partkey % 50 AS lo, p_partkey % 50 + p_size % 6 AS hi FROM part), r AS (SELECT p_brand AS path, p_partkey AS ref, p_size AS line FROM part)
SELECT ref, min(span) AS span FROM r JOIN sp USING (path) WHERE line BETWEEN lo AND hi GROUP BY ref HAVING count(*) = 1""")
def span_containment(spark, sf):
    p = _t(spark, sf, "part")
    k = F.col("p_partkey")
    spans = p.select(F.col("p_brand").alias("path"), k.alias("span"), (k % 50).alias("lo"), (k % 50 + F.col("p_size") % 6).alias("hi"))
    return R.span_containment(p.select(F.col("p_brand").alias("path"), k.alias("ref"), F.col("p_size").alias("line")), spans, "path", "line", "lo", "hi", "span", "ref")


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS call, l_suppkey AS target, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 2 ELSE 3 END AS priority FROM lineitem),
o AS (SELECT call, priority, min(target) AS target FROM c GROUP BY 1, 2 HAVING count(*) = 1) SELECT call, arg_min(target, priority) AS target, min(priority) AS priority FROM o GROUP BY 1""")
def unique_call_resolution(spark, sf):
    c = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("call"), F.col("l_suppkey").alias("target"), F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3).alias("priority"))
    return R.cascade(c, "call", "target", "priority")


@query("SELECT pages.page_id, coalesce(n, 0) AS test_components FROM pages LEFT JOIN (SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(string_split(url, '/')) AS c FROM pages) WHERE c IN ('en', 'de') GROUP BY 1) x ON x.page_id = pages.page_id")
def path_components(spark, sf):
    parts = T.path_key(F.col("url"))
    return _t(spark, sf, "pages").select("page_id", F.coalesce(F.size(F.filter(parts, lambda c: c.isin("en", "de"))), F.lit(0)).cast("long").alias("test_components"))


@query("""SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS owners FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 40) GROUP BY 1""")
def pattern_metrics(spark, sf):
    used = _t(spark, sf, "lineitem").where("l_quantity >= 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, sf, "orders").join(used, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("owners"))
