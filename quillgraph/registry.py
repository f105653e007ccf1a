"""The engine's registered queries and their SQL for DuckDB over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import tokens
from .operators import analyze, filters, ingest, language, learn, search, temporal, traverse, vector_index
from .plans.rules import derive
from .sources.files import html_tables, subgraph_json, to_jsonld
from .sources.star import from_star, label, table
from .streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NODES = """nodes AS (
  SELECT 'region:' || r_regionkey AS label, 'region' AS type, 1.0::DOUBLE AS confidence, NULL::TIMESTAMP AS created_at, r_name AS text FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', 0.95, NULL, n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', 0.90, NULL, c_name || ' ' || c_mktsegment FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', 0.90, NULL, s_name FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', 0.85, NULL, p_name || ' ' || p_brand || ' ' || p_type FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', 0.80, o_orderdate::TIMESTAMP, o_orderstatus || ' ' || o_orderpriority FROM orders)"""
EDGES = """edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'in_region' AS rel, 'region:' || n_regionkey AS dst, 0.95::DOUBLE AS confidence, NULL::TIMESTAMP AS valid_from FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'located_in', 'nation:' || c_nationkey, 0.90, NULL FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey, 0.90, NULL FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey, 0.85, o_orderdate::TIMESTAMP FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey, max(round(1 - l_discount, 2)), NULL FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplied_by', 'supplier:' || l_suppkey, 0.80, NULL::TIMESTAMP FROM lineitem)"""
MOVES = "moves AS (SELECT src AS a, dst AS b, rel, confidence FROM edges UNION ALL SELECT dst, src, rel, confidence FROM edges)"


def query(sql: str | None = None):
    """Register a query under its name, with its SQL where there is one ({G}: the graph's tables)."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("{G}", f"{NODES},\n{EDGES},\n{MOVES}")
        return f

    return put


def walk_sql(start: str, a: str, b: str, depth: int, source: str = "edges") -> str:
    return f"""walk AS (
  SELECT '{start}' AS label, 0 AS depth UNION
  SELECT e.{b}, walk.depth + 1 FROM walk JOIN {source} e ON e.{a} = walk.label WHERE walk.depth < {depth}),
near AS (SELECT label, min(depth) AS depth FROM walk GROUP BY label)"""


# --- traversal and paths


@query(f"WITH RECURSIVE {{G}}, {walk_sql('region:0', 'dst', 'src', 2)} SELECT label, depth::INTEGER AS depth FROM near")
def bfs_in(spark, sf_dir):
    return traverse.bfs(from_star(spark, sf_dir), "region:0", 2, "in")


@query(f"WITH RECURSIVE {{G}}, {walk_sql('customer:1', 'a', 'b', 2, 'moves')} SELECT label, depth::INTEGER AS depth FROM near")
def bfs_both(spark, sf_dir):
    return traverse.bfs(from_star(spark, sf_dir), "Customer:1", 2)


@query(f"""WITH RECURSIVE {{G}}, {walk_sql('region:0', 'dst', 'src', 2)}
SELECT src, rel, dst, round(confidence, 4) AS confidence FROM edges JOIN near x ON x.label = src JOIN near y ON y.label = dst WHERE least(x.depth, y.depth) < 2""")
def bfs_edges(spark, sf_dir):
    g = from_star(spark, sf_dir)
    found = traverse.bfs_edges(g, traverse.bfs(g, "region:0", 2, "in"), 2)
    return found.select("src", "rel", "dst", F.round("confidence", 4).alias("confidence"))


@query(f"WITH RECURSIVE {{G}}, {walk_sql('order:1', 'src', 'dst', 6)} SELECT label, depth::INTEGER AS depth FROM near WHERE depth > 0")
def reach(spark, sf_dir):
    return traverse.reach(from_star(spark, sf_dir), "order:1", "out", 6)


@query("""WITH {G} SELECT n.label, n.type, round(n.confidence, 4) AS confidence, n.text AS name,
  (SELECT count(*) FROM edges WHERE src = n.label) AS n_from, (SELECT count(*) FROM edges WHERE dst = n.label) AS n_to FROM nodes n WHERE label = 'nation:3'""")
def get_node(spark, sf_dir):
    d = traverse.node_detail(from_star(spark, sf_dir), "Nation:3")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return d.select("label", "type", F.round("confidence", 4).alias("confidence"), F.element_at("props", "n_name").alias("name"), size("edges_from").alias("n_from"), size("edges_to").alias("n_to"))


def _event_mentions(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("label"))


@query("""SELECT x.event_type AS a, y.event_type AS b, count(DISTINCT x.user_id) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) x
JOIN (SELECT DISTINCT user_id, event_type FROM events) y ON x.user_id = y.user_id AND x.event_type < y.event_type GROUP BY ALL""")
def cooccurrence(spark, sf_dir):
    return learn.cooccurrence(_event_mentions(spark, sf_dir))


@query("""WITH pairs AS (SELECT x.s_nationkey AS a, y.s_nationkey AS b, count(*) AS n FROM (SELECT DISTINCT l_partkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) x
  JOIN (SELECT DISTINCT l_partkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) y USING (l_partkey) WHERE x.s_nationkey < y.s_nationkey GROUP BY ALL)
SELECT 'nation:3' AS label, n AS n, 'nation:' || CASE WHEN a = 3 THEN b ELSE a END AS other FROM pairs WHERE a = 3 OR b = 3""")
def explain(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = learn.cooccurrence(own.select(F.col("l_partkey").alias("doc"), label("nation", "s_nationkey").alias("label")))
    return traverse.explain(from_star(spark, sf_dir), "nation:3", pairs).select("label", F.inline("cooccurrences")).select("label", "n", F.col("b").alias("other"))


@query("""WITH {G}, ends AS (SELECT src AS label FROM edges UNION ALL SELECT dst FROM edges) SELECT n.label, n.type, count(e.label) AS degree FROM nodes n JOIN ends e USING (label)
GROUP BY ALL ORDER BY degree DESC, label LIMIT 10""")
def most_connected(spark, sf_dir):
    return traverse.most_connected(from_star(spark, sf_dir))


@query("""WITH {G}, ends AS (SELECT src AS label FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT label, count(*) AS n FROM ends GROUP BY label)
SELECT n.label, n.type, coalesce(d.n, 0) AS degree FROM nodes n LEFT JOIN d USING (label) WHERE coalesce(d.n, 0) <= 1""")
def isolated(spark, sf_dir):
    return traverse.isolated(from_star(spark, sf_dir), 1)


@query("""WITH {G}, ends AS (SELECT src AS label FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT label, count(*) AS n FROM ends GROUP BY label)
SELECT n.label, n.type, coalesce(d.n, 0) AS degree FROM nodes n LEFT JOIN d USING (label) WHERE coalesce(d.n, 0) <= 2 ORDER BY degree, label LIMIT 20""")
def frontier(spark, sf_dir):
    return traverse.frontier(from_star(spark, sf_dir))


@query("""WITH {G}, x AS (SELECT DISTINCT b FROM moves WHERE a = 'customer:1'), y AS (SELECT DISTINCT b FROM moves WHERE a = 'customer:2'),
p AS (SELECT c_custkey AS k, unnest(['c_name=' || c_name, 'c_mktsegment=' || c_mktsegment]) AS item FROM customer WHERE c_custkey IN (1, 2)),
items AS (SELECT 'neighbour' AS kind, b AS item, 'first' AS side FROM x UNION ALL SELECT 'neighbour', b, 'second' FROM y UNION ALL SELECT 'property', item, CASE WHEN k = 1 THEN 'first' ELSE 'second' END FROM p)
SELECT kind, item, CASE WHEN count(*) > 1 THEN 'shared' ELSE min(side) END AS side FROM items GROUP BY kind, item""")
def compare(spark, sf_dir):
    return traverse.compare(from_star(spark, sf_dir), "customer:1", "customer:2")


@query("WITH {G} SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n, string_agg(DISTINCT rel, ',' ORDER BY rel) AS rels FROM edges GROUP BY 1, 2")
def bundle(spark, sf_dir):
    return traverse.bundle(from_star(spark, sf_dir)).withColumn("rels", F.array_join("rels", ","))


@query("SELECT 'order:' || l_orderkey AS src, 'contains' AS rel, 'part:' || l_partkey AS dst, round(max(1 - l_discount), 4) AS confidence FROM lineitem GROUP BY 1, 2, 3")
def dedup_edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(label("order", "l_orderkey").alias("src"), F.lit("contains").alias("rel"), label("part", "l_partkey").alias("dst"), (1 - F.col("l_discount")).alias("confidence"), F.lit(False).alias("deleted"))
    return traverse.dedup_edges(traverse.Graph(from_star(spark, sf_dir).nodes, lines)).withColumn("confidence", F.round("confidence", 4))


@query("WITH {G} SELECT 'type' AS kind, type AS name, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'rel', rel, count(*) FROM edges GROUP BY rel")
def node_and_rel_types(spark, sf_dir):
    g = from_star(spark, sf_dir)
    types = traverse.node_types(g).select(F.lit("type").alias("kind"), F.col("type").alias("name"), "n")
    return types.unionByName(traverse.rel_types(g).select(F.lit("rel").alias("kind"), F.col("rel").alias("name"), "n"))


@query("""WITH {G}, shown AS (SELECT label FROM nodes WHERE type NOT IN ('order', 'part')),
left_edges AS (SELECT e.* FROM edges e SEMI JOIN shown x ON x.label = e.src SEMI JOIN shown y ON y.label = e.dst WHERE rel <> 'in_region')
SELECT label FROM shown WHERE label IN (SELECT src FROM left_edges UNION SELECT dst FROM left_edges) OR label = 'region:0'""")
def hide_types(spark, sf_dir):
    g = from_star(spark, sf_dir)
    return filters.hide(g.nodes, g.edges, ["order", "part"], ["in_region"], "region:0")[0].select("label")


@query("""WITH RECURSIVE {G}, p AS (
  SELECT 'order:7' AS node, ['order:7'] AS path, 1.0::DOUBLE AS c UNION ALL
  SELECT e.dst, list_append(p.path, e.dst), p.c * e.confidence FROM p JOIN edges e ON e.src = p.node WHERE len(p.path) < 6 AND NOT list_contains(p.path, e.dst) AND p.node NOT LIKE 'region:%')
SELECT array_to_string(path, ' > ') AS path, (len(path) - 1)::INTEGER AS hops, round(c, 4) AS confidence FROM p WHERE node LIKE 'region:%' AND node = (SELECT 'region:' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 7)""")
def simple_paths(spark, sf_dir):
    g = from_star(spark, sf_dir)
    region = table(spark, sf_dir, "orders").where("o_orderkey = 7").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    row = region.select(label("region", "n_regionkey").alias("r")).first()
    return traverse.paths(g, "order:7", row.r if row else "").select(F.array_join("path", " > ").alias("path"), "hops", F.round("confidence", 4).alias("confidence"))


@query("""WITH {G}, m AS (SELECT a, b, max(confidence) AS c FROM moves WHERE a <> b GROUP BY a, b)
SELECT x.a || ' > ' || x.b || ' > ' || y.b AS path, 2 AS hops, round(x.c * y.c, 4) AS confidence FROM m x JOIN m y ON x.b = y.a WHERE x.a = 'part:1' AND y.b = 'part:2' ORDER BY path LIMIT 10""")
def all_paths(spark, sf_dir):
    return traverse.all_paths(from_star(spark, sf_dir), "part:1", "Part:2", 2).withColumn("confidence", F.round("confidence", 4))


@query("""WITH {G} SELECT x.src || ' > ' || x.dst || ' > ' || y.dst || ' > ' || z.dst AS path, 3 AS hops, round(x.confidence * y.confidence * z.confidence, 4) AS confidence
FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON y.dst = z.src WHERE x.src = 'part:1' AND x.rel = 'supplied_by' AND z.dst = 'region:0' ORDER BY path LIMIT 1""")
def shortest_path(spark, sf_dir):
    return traverse.shortest_path(from_star(spark, sf_dir), "part:1", "Region:0").withColumn("confidence", F.round("confidence", 4))


@query("""WITH RECURSIVE {G}, p AS (
  SELECT 'order:7' AS node, ['order:7'] AS path, 1.0::DOUBLE AS c UNION ALL
  SELECT e.dst, list_append(p.path, e.dst), p.c * e.confidence FROM p JOIN edges e ON e.src = p.node WHERE len(p.path) < 6 AND NOT list_contains(p.path, e.dst)),
c AS (SELECT array_to_string(path, ' > ') AS chain, c FROM p WHERE node = 'region:1' ORDER BY c DESC, len(path), chain LIMIT 1)
SELECT count(*) > 0 AS supported, round(coalesce(max(c), 0), 4) AS confidence, max(chain) AS chain FROM c""")
def prove(spark, sf_dir):
    """The surest chain of one relation from an order to a region: all relations of the star count as one here."""
    g = from_star(spark, sf_dir)
    linked = traverse.Graph(g.nodes, g.edges.withColumn("rel", F.lit("linked")))
    return traverse.prove(linked, "order:7", "linked", "region:1").withColumn("confidence", F.round("confidence", 4))


@query(f"WITH RECURSIVE {{G}}, {walk_sql('order:1', 'src', 'dst', 2)} SELECT label, depth::INTEGER AS depth, round(0.8 * pow(0.5, depth), 4) AS impact FROM near WHERE depth > 0")
def what_if(spark, sf_dir):
    return traverse.what_if(from_star(spark, sf_dir), "order:1").withColumn("impact", F.round("impact", 4))


@query("""WITH {G} SELECT count(*) AS paths, round(max(x.confidence * y.confidence), 4) AS strongest, round(1 - exp(sum(ln(1 - x.confidence * y.confidence))), 4) AS total
FROM edges x JOIN edges y ON x.dst = y.src WHERE x.src = 'order:1' AND x.rel = 'contains' AND y.dst = 'supplier:1'""")
def influence_path(spark, sf_dir):
    found = traverse.influence(from_star(spark, sf_dir), "order:1", "supplier:1", 2)
    return found.select("paths", F.round("strongest", 4).alias("strongest"), F.round("total", 4).alias("total"))


@query("WITH {G} SELECT rel, b AS label, round(confidence, 4) AS confidence FROM moves WHERE a = 'supplier:1'")
def ask_neighbours(spark, sf_dir):
    return traverse.neighbours(from_star(spark, sf_dir), "supplier:1", "both").withColumn("confidence", F.round("confidence", 4))


@query()
def network(spark, sf_dir):
    """Communities by label propagation over the whole graph (tests compare with a plain version), with each node's degree centrality."""
    g = from_star(spark, sf_dir)
    return traverse.communities(g).join(traverse.centrality(g), "label").withColumn("centrality", F.round("centrality", 6))


@query("""WITH {G}, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges), near AS (SELECT DISTINCT b AS label FROM moves WHERE a = 'order:1'),
m AS (SELECT count(*) AS m FROM p WHERE a IN (SELECT label FROM near) AND b IN (SELECT label FROM near)), n AS (SELECT count(*) AS n FROM near)
SELECT 'order:1' AS label, n AS degree, round(CASE WHEN n > 1 THEN 2 * m / (n * (n - 1)) ELSE 0 END, 4)::DOUBLE AS coefficient FROM n, m""")
def clustering(spark, sf_dir):
    return traverse.clustering(from_star(spark, sf_dir), "order:1").withColumn("coefficient", F.round("coefficient", 4))


# --- filters and search


@query("""SELECT 'customer:' || c_custkey AS label FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'region:' || r_regionkey FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation WHERE NOT n_nationkey = 3""")
def filter_dsl(spark, sf_dir):
    text = "type:customer AND prop:c_mktsegment=BUILDING AND confidence>0.8 OR confidence>=0.95 AND NOT prop:n_name=NATION_3"
    g = from_star(spark, sf_dir)
    names = table(spark, sf_dir, "nation").where("n_nationkey = 3").select("n_name").first()
    return filters.search_nodes(g.nodes, text.replace("NATION_3", names.n_name if names else "none")).select("label")


BM25_SQL = r"""WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x = 'order')) AS f1, len(list_filter(w, lambda x: x = 'thing')) AS f2, len(list_filter(w, lambda x: x = 'the')) AS f3 FROM t),
s AS (SELECT count(*)::DOUBLE AS n, avg(n) AS l, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2, count(*) FILTER (f3 > 0) AS d3 FROM c),
scored AS (SELECT id, round(ln(1 + (s.n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * c.n / l)) + ln(1 + (s.n - d3 + 0.5) / (d3 + 0.5)) * f3 * 2.2 / (f3 + 1.2 * (0.25 + 0.75 * c.n / l))
  + ln(1 + (s.n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * c.n / l)), 6) AS score FROM c, s)"""


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _first_vector(spark, sf_dir) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row.embedding] if row else [1.0]


@query(BM25_SQL + " SELECT id, round(score, 4) AS score FROM scored WHERE score > 0 ORDER BY scored.score DESC, id LIMIT 10")
def bm25(spark, sf_dir):
    return search.bm25(_texts(spark, sf_dir), "the order thing").withColumn("score", F.round("score", 4))


KNN_SQL = """q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
k AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q)"""


@query(f"WITH {KNN_SQL} SELECT id, round(score, 4) AS score FROM k ORDER BY k.score DESC, id LIMIT 10")
def knn_exact(spark, sf_dir):
    return search.knn(_vectors(spark, sf_dir), _first_vector(spark, sf_dir)).withColumn("score", F.round("score", 4))


def _query_vectors(spark, sf_dir):
    """The stated query set: every row whose id is divisible by 100, against all rows."""
    return _vectors(spark, sf_dir).where("id % 100 = 0")


@query("""WITH k AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)
SELECT query, id, round(score, 4) AS score FROM k QUALIFY row_number() OVER (PARTITION BY query ORDER BY k.score DESC, id) <= 10""")
def knn_exact_block(spark, sf_dir):
    return search.knn_block(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir)).withColumn("score", F.round("score", 4))


@query("""SELECT vec_id AS id, round(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127.0, 6) AS q_scale,
array_to_string(list_transform(embedding::DOUBLE[], lambda x: round(x / (list_max(list_transform(embedding::DOUBLE[], lambda y: abs(y))) / 127.0))::INTEGER), ',') AS q FROM embeddings""")
def quantize(spark, sf_dir):
    return search.quantize(_vectors(spark, sf_dir)).select("id", F.round("q_scale", 6).alias("q_scale"), F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("q"))


@query()
def knn_int8(spark, sf_dir):
    """Two stages over all vectors: int8 codes alone, then the floats of the candidates."""
    vectors = _vectors(spark, sf_dir)
    return vector_index.search(vector_index.build(vectors, lists=1), _query_vectors(spark, sf_dir), count=1, widen=10).withColumn("score", F.round("score", 4))


@query()
def ann(spark, sf_dir):
    """The inverted-file index. The tables' vectors have no clusters (the tenth neighbour's cosine is .3 to .45), so half of the lists are probed for a recall of .95."""
    index = vector_index.build(_vectors(spark, sf_dir))
    return vector_index.search(index, _query_vectors(spark, sf_dir), count=-(-len(index.centres) // 2)).withColumn("score", F.round("score", 4))


@query(BM25_SQL + f""", {KNN_SQL}, r1 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM scored WHERE score > 0 QUALIFY r <= 100),
r2 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM k QUALIFY r <= 100)
SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY id ORDER BY score DESC, id LIMIT 10""")
def hybrid_rrf(spark, sf_dir):
    return search.rank_fusion(search.bm25(_texts(spark, sf_dir), "the order thing", 100), search.knn(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 100))


@query(BM25_SQL + """, k AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0),
r1 AS (SELECT vec_id AS query, id, r FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM scored WHERE score > 0 QUALIFY r <= 100), embeddings WHERE vec_id % 100 = 0),
r2 AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM k QUALIFY r <= 100),
f AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY query, id)
SELECT query, id, score FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10""")
def hybrid_rrf_block(spark, sf_dir):
    asked = _query_vectors(spark, sf_dir)
    return search.rank_fusion_block(search.bm25(_texts(spark, sf_dir), "the order thing", 100), search.knn_block(_vectors(spark, sf_dir), asked, 100), asked)


@query("SELECT DISTINCT p_type AS type FROM part WHERE contains(regexp_replace(lower(p_type), '[\\s-]', '_', 'g'), 'e')")
def autocomplete(spark, sf_dir):
    return search.autocomplete(table(spark, sf_dir, "part").select(F.col("p_type").alias("type")).distinct(), "E")


@query("""WITH e AS (SELECT DISTINCT 'part:' || l_partkey AS x, 'supplier:' || l_suppkey AS y FROM lineitem), n AS (SELECT x AS a, y AS hub FROM e UNION ALL SELECT y, x FROM e),
d AS (SELECT hub, count(*) AS d FROM n GROUP BY hub HAVING count(*) > 1), asked AS (SELECT DISTINCT a FROM n WHERE split_part(a, ':', 2)::BIGINT % 100 = 0),
pairs AS (SELECT DISTINCT least(p.a, q.a) AS a, greatest(p.a, q.a) AS b, p.hub, d.d FROM n p JOIN asked USING (a) JOIN n q ON p.hub = q.hub AND p.a <> q.a JOIN d ON d.hub = p.hub)
SELECT a, b, count(*) AS common, round(sum(1 / ln(d)), 4) AS score FROM pairs GROUP BY a, b""")
def kge_predict(spark, sf_dir):
    """Link prediction between parts or suppliers whose number is divisible by 100 (the stated query set) and all others."""
    g = from_star(spark, sf_dir)
    return search.link_candidates(g.edges.where("rel = 'supplied_by'"), _query_nodes(g)).withColumn("score", F.round("score", 4))


# --- rules

RULES = """
rule customer_region
when edge(c, "located_in", n)
when edge(n, "in_region", r)
then edge(c, "in_region", r, min(e1, e2))
rule order_region
when edge(o, "placed_by", c)
when edge(c, "in_region", r)
then edge(o, "in_region", r, product(e1, e2))
rule urgent
when prop(o, "o_orderpriority", "1-URGENT")
when confidence(o, ">=", 0.5)
then flag(o, "urgent order")
"""


@query("""SELECT 'customer:' || c_custkey AS src, 'in_region' AS rel, 'region:' || n_regionkey AS dst, 0.9::DOUBLE AS confidence, 'customer_region' AS derived_by, 1 AS round FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'supplier:' || s_suppkey, 'in_region', 'region:' || n_regionkey, 0.9, 'customer_region', 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'order:' || o_orderkey, 'in_region', 'region:' || n_regionkey, round(0.85 * 0.9, 4), 'order_region', 2 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def rule_derive(spark, sf_dir):
    return derive(from_star(spark, sf_dir), RULES).edges.withColumn("confidence", F.round("confidence", 4))


@query("SELECT 'order:' || o_orderkey AS label, 'urgent order' AS reason FROM orders WHERE o_orderpriority = '1-URGENT'")
def rule_flag(spark, sf_dir):
    return derive(from_star(spark, sf_dir), RULES).flags.select("label", "reason")


# --- learning


def _uses(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(label("customer", "o_custkey").alias("label"), F.when(F.col("o_orderstatus") == "F", "confirm").otherwise("access").alias("kind"))


@query("""SELECT 'customer:' || o_custkey AS label, 0.9::DOUBLE AS old, round(greatest(0.9, least(0.95, 0.9 + sum(CASE WHEN o_orderstatus = 'F' THEN 0.1 ELSE 0.02 END))), 4)::DOUBLE AS new
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey""")
def reinforce(spark, sf_dir):
    return learn.reinforce(from_star(spark, sf_dir).nodes, _uses(spark, sf_dir)).withColumns({"old": F.round("old", 4), "new": F.round("new", 4)})


@query(f"""WITH RECURSIVE {{G}}, {walk_sql('order:1', 'src', 'dst', 3)}
SELECT n.label, near.depth::INTEGER AS depth, round(n.confidence, 4) AS old, round(CASE WHEN near.depth = 0 THEN 0 ELSE greatest(0, n.confidence - 0.8 * pow(0.5, near.depth)) END, 4)::DOUBLE AS new FROM near JOIN nodes n USING (label)""")
def correct(spark, sf_dir):
    return learn.correct(from_star(spark, sf_dir), "order:1").withColumns({"old": F.round("old", 4), "new": F.round("new", 4)})


@query("""SELECT 'order:' || o_orderkey AS label, round(0.8 * pow(0.999, greatest(0, date_diff('day', o_orderdate::DATE, DATE '2000-01-01'))), 4) AS new,
0.8 * pow(0.999, greatest(0, date_diff('day', o_orderdate::DATE, DATE '2000-01-01'))) < 0.1 AS archive FROM orders""")
def decay(spark, sf_dir):
    own = from_star(spark, sf_dir).nodes.where("type = 'order'")
    return learn.decay(own, "2000-01-01").select("label", F.round("new", 4).alias("new"), "archive")


@query("""SELECT 'customer:' || c_custkey AS label, CASE WHEN (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 5 THEN 'core' ELSE 'active' END AS tier FROM customer""")
def tiering(spark, sf_dir):
    return learn.tiers(from_star(spark, sf_dir).nodes.where("type = 'customer'"), _uses(spark, sf_dir))


def _statuses(spark, sf_dir):
    """Order by order, a customer's latest priority as a fact that holds for 30 days."""
    when = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        label("customer", "o_custkey").alias("src"), F.lit("priority").alias("rel"), F.col("o_orderpriority").alias("dst"), F.lit(0.8).alias("confidence"), when.alias("valid_from"), (when + F.expr("INTERVAL 30 DAYS")).alias("valid_to")
    )


FACTS_SQL = "f AS (SELECT 'customer:' || o_custkey AS src, 'priority' AS rel, o_orderpriority AS dst, o_orderdate::TIMESTAMP AS valid_from, o_orderdate::TIMESTAMP + INTERVAL 30 DAY AS valid_to FROM orders)"


@query(f"WITH {FACTS_SQL} SELECT DISTINCT x.src, x.rel, x.dst AS dst_a, y.dst AS dst_b FROM f x JOIN f y ON x.src = y.src AND x.dst < y.dst AND x.valid_from < y.valid_to AND y.valid_from < x.valid_to")
def contradiction_scan(spark, sf_dir):
    return learn.contradictions(_statuses(spark, sf_dir), ["priority"])


@query(f"""WITH {FACTS_SQL}, d AS (SELECT DISTINCT * FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY valid_from, dst, valid_to) AS n FROM d)
SELECT x.src, x.rel, x.dst, strftime(x.valid_from, '%Y-%m-%d') AS valid_from, arg_max(y.dst, {{'e': y.valid_to, 'v': y.dst}}) AS other, strftime(max(y.valid_to), '%Y-%m-%d') AS until
FROM o x JOIN o y ON x.src = y.src AND y.n < x.n AND y.dst <> x.dst AND y.valid_to > x.valid_from GROUP BY ALL""")
def contradiction_witnesses(spark, sf_dir):
    found = learn.contradiction_witnesses(_statuses(spark, sf_dir), ["priority"])
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("valid_from", "until")})


@query(f"""WITH {FACTS_SQL}, d AS (SELECT DISTINCT * FROM f), o AS (SELECT *, max(valid_to) OVER (PARTITION BY src ORDER BY valid_from, dst, valid_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM d),
s AS (SELECT *, sum((top IS NULL OR top <= valid_from)::INT) OVER (PARTITION BY src ORDER BY valid_from, dst, valid_to ROWS UNBOUNDED PRECEDING) AS span FROM o)
SELECT src, rel, strftime(min(valid_from), '%Y-%m-%d') AS since, strftime(max(valid_to), '%Y-%m-%d') AS until, count(DISTINCT dst) AS values, count(*) AS rows FROM s GROUP BY src, rel, span HAVING count(DISTINCT dst) > 1""")
def contradiction_classes(spark, sf_dir):
    found = learn.contradiction_classes(_statuses(spark, sf_dir), ["priority"])
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("since", "until")})


@query(f"""WITH {FACTS_SQL}, w AS (SELECT *, lag(dst) OVER (PARTITION BY src ORDER BY valid_from, dst) AS previous, lag(valid_to) OVER (PARTITION BY src ORDER BY valid_from, dst) AS ended FROM f)
SELECT src, dst, previous, strftime(valid_from, '%Y-%m-%d') AS valid_from FROM w WHERE previous IS NOT NULL AND ended <= valid_from""")
def succession(spark, sf_dir):
    return learn.succession(_statuses(spark, sf_dir), "priority").withColumn("valid_from", F.date_format("valid_from", "yyyy-MM-dd"))


# --- time


@query(f"WITH {FACTS_SQL} SELECT src, dst, count(*) AS n FROM f WHERE valid_from < TIMESTAMP '1996-02-01' AND valid_to > TIMESTAMP '1996-01-01' GROUP BY src, dst")
def temporal_query(spark, sf_dir):
    return temporal.during(_statuses(spark, sf_dir), "1996-01-01", "1996-02-01").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("WITH {G} SELECT src, rel, dst FROM edges WHERE src = 'customer:1' OR dst = 'customer:1' ORDER BY valid_from NULLS LAST, src, rel, dst LIMIT 20")
def timeline(spark, sf_dir):
    return temporal.timeline(from_star(spark, sf_dir).edges, "customer:1", 20).select("src", "rel", "dst")


@query(f"""WITH {FACTS_SQL} SELECT src, rel, dst, strftime(valid_from, '%Y-%m-%d') AS valid_from FROM f WHERE valid_from <= TIMESTAMP '1996-06-01' AND valid_to > TIMESTAMP '1996-06-01'
QUALIFY row_number() OVER (PARTITION BY src, rel ORDER BY valid_from DESC, dst DESC) = 1""")
def situation_at(spark, sf_dir):
    return temporal.situation_at(_statuses(spark, sf_dir), "1996-06-01").select("src", "rel", "dst", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))


@query("SELECT 'order:' || o_orderkey AS label, 'created' AS change FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'")
def recent_changes(spark, sf_dir):
    return temporal.changes(from_star(spark, sf_dir), "1997-06-01")


@query(f"WITH {FACTS_SQL} SELECT src, dst, count(*) AS n FROM f WHERE valid_to > TIMESTAMP '1997-06-01' GROUP BY src, dst")
def current_edges(spark, sf_dir):
    return temporal.current(_statuses(spark, sf_dir), "1997-06-01").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


# --- ingest


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


@query("SELECT sha256(lower(trim(text))) AS hash, min(doc_id) AS doc, count(*) AS copies FROM documents GROUP BY 1")
def dedup_hash(spark, sf_dir):
    return ingest.drop_copies(_docs(spark, sf_dir))


@query("SELECT x.s_suppkey AS doc_a, y.s_suppkey AS doc_b, count(*) AS shared FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey GROUP BY ALL")
def doc_links(spark, sf_dir):
    return ingest.document_links(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), label("nation", "s_nationkey").alias("label")))


@query("SELECT 'part:' || l_partkey AS label, count(DISTINCT l_orderkey) AS docs, count(DISTINCT l_orderkey) - 1 AS confirmations FROM lineitem GROUP BY l_partkey")
def cross_doc(spark, sf_dir):
    return ingest.cross_document(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), label("part", "l_partkey").alias("label")))


@query("""SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_returnflag = 'N' THEN 'no_relation' WHEN 1 - l_discount * 6 >= 0.7 THEN 'confirmed' WHEN 1 - l_discount * 6 >= 0.5 THEN 'likely' ELSE 'uncertain' END AS tier, count(*) AS c
FROM lineitem GROUP BY ALL""")
def triage(spark, sf_dir):
    staged = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") != "N", "x").alias("rel"), (1 - F.col("l_discount") * 6).alias("confidence"))
    return ingest.triage(staged).groupBy("k", "n", "tier").agg(F.count(F.lit(1)).alias("c"))


@query("""SELECT s_suppkey AS doc, round(least(0.95, 0.7 + CASE WHEN s_nationkey % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN contains(trim(s_name), ' ') THEN 0.05 ELSE 0 END - CASE WHEN s_acctbal < 0 THEN 0.05 ELSE 0 END), 4)::DOUBLE AS confidence FROM supplier""")
def ner_conf(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.when(F.col("s_nationkey") % 2 == 0, "ORG").otherwise("EVENT").alias("ner_label"), F.col("s_name").alias("label"), (F.col("s_acctbal") < 0).alias("at_edge"))
    return ingest.mention_confidence(ingest.typed(own)).select("doc", "confidence")


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT DISTINCT array_to_string(w[1 : 1 + doc_id % 60], ' ') AS label FROM t WHERE len(w) > 0), s AS (SELECT ' ' || array_to_string(w, ' ') || ' ' AS words FROM t)
SELECT label, count(*) AS n FROM s JOIN k ON contains(words, ' ' || label || ' ') GROUP BY label""")
def ner_gazetteer(spark, sf_dir):
    """Names are the first one to sixty words of every document, found in all documents."""
    docs = _docs(spark, sf_dir)
    known = docs.select(F.array_join(F.slice(tokens("text"), F.lit(1), (F.col("doc") % 60 + 1).cast("int")), " ").alias("label"), F.lit("opening").alias("type")).where("label <> ''").distinct()
    return ingest.gazetteer_entities(docs, known).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


SENTENCES_SQL = r"s AS (SELECT doc_id AS doc, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\f\r\v]+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents)"


@query(rf"""WITH {SENTENCES_SQL}, w AS (SELECT doc, unnest(list_slice(regexp_split_to_array(sentence, '[ \t\n\f\r\v]+'), 2, 1000000000)) AS w FROM s),
c AS (SELECT doc, regexp_replace(w, '^[^\p{{L}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS label FROM w)
SELECT label, count(DISTINCT doc) AS docs FROM c WHERE regexp_full_match(label, '\p{{Lu}}[\p{{L}}\p{{N}}-]{{2,}}') AND lower(label) NOT IN {ingest.STOP!r} GROUP BY label""")
def ner_caps(spark, sf_dir):
    return ingest.capital_entities(_docs(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("docs"))


_FOUND = " UNION ALL ".join(f"SELECT doc, '{rel}' AS rel, unnest(regexp_extract_all(sentence, '{p}', 1)) AS src, unnest(regexp_extract_all(sentence, '{p}', 2)) AS dst FROM s" for rel, p in ingest.PATTERNS)


@query(f"WITH {SENTENCES_SQL}, f AS ({_FOUND}) SELECT DISTINCT doc, trim(src) AS src, rel, trim(dst) AS dst FROM f WHERE trim(src) <> '' AND trim(dst) <> ''")
def re_pattern(spark, sf_dir):
    return ingest.pattern_relations(ingest.sentences(_docs(spark, sf_dir)))


_VOTES = ", ".join(f"len(list_filter(w, lambda x: list_contains({words!r}, x))) AS {lang}" for lang, words in ingest.COMMON_WORDS.items())


@query(rf"""WITH t AS (SELECT lang, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents), v AS (SELECT lang, {_VOTES} FROM t)
SELECT lang, CASE WHEN de >= greatest(en, es, fr) THEN 'de' WHEN en >= greatest(es, fr) THEN 'en' WHEN es >= fr THEN 'es' ELSE 'fr' END AS detected, count(*) AS n FROM v GROUP BY 1, 2""")
def lang_detect(spark, sf_dir):
    found = ingest.detect_language(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return found.groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


NAMES_SQL = """n AS (SELECT DISTINCT p_name AS label FROM part UNION SELECT upper(p_name) FROM part WHERE p_size > 40 UNION SELECT replace(p_name, ' ', '-') FROM part WHERE p_size < 5
  UNION SELECT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) FROM part WHERE p_size = 7 UNION SELECT 'x' || p_name FROM part WHERE p_size = 9)"""


@query(rf"""WITH {NAMES_SQL}, k AS (SELECT label, lower(label) AS l, regexp_replace(lower(label), '[^\p{{L}}\p{{N}}]+', '', 'g') AS p,
  array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(label), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))), ' ') AS w FROM n),
e AS (SELECT min(y.label) AS a, x.label AS b, 1 AS step, 1.0::DOUBLE AS s FROM k x JOIN k y ON x.l = y.l GROUP BY x.label UNION ALL SELECT min(y.label), x.label, 2, 1.0 FROM k x JOIN k y ON x.p = y.p GROUP BY x.label
  UNION ALL SELECT min(y.label), x.label, 3, 1.0 FROM k x JOIN k y ON x.w = y.w GROUP BY x.label
  UNION ALL SELECT x.label, y.label, 4, round(1 - levenshtein(x.l, y.l) / greatest(length(x.l), length(y.l)), 4) FROM k x JOIN k y ON x.label < y.label AND x.p <> y.p AND x.w <> y.w
    WHERE levenshtein(x.l, y.l) <= floor(0.15 * greatest(length(x.l), length(y.l)) + 1e-9))
SELECT a, b, min(step)::INTEGER AS step, max(s) AS similarity FROM e WHERE a < b GROUP BY a, b""")
def resolve(spark, sf_dir):
    """Names of parts, and some of them in capitals, with a dash, turned round, or with a slip in the first word."""
    part, name = table(spark, sf_dir, "part"), F.col("p_name")
    turned = F.concat(F.split(name, " ")[1], F.lit(" "), F.split(name, " ")[0])
    forms = [part.select(name), part.where("p_size > 40").select(F.upper(name)), part.where("p_size < 5").select(F.regexp_replace(name, " ", "-")), part.where("p_size = 7").select(turned), part.where("p_size = 9").select(F.concat(F.lit("x"), name))]
    names = forms[0]
    for f in forms[1:]:
        names = names.union(f)
    return ingest.resolve_entities(names.toDF("label"))


@query("""WITH p AS (SELECT 'customer:' || o_custkey AS label, o_orderkey AS fact_id, o_orderdate::DATE::VARCHAR AS doc, o_orderpriority AS publisher FROM orders) SELECT label, fact_id, publisher FROM p""")
def provenance(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    facts = orders.select(F.col("o_orderkey").alias("fact_id"), label("customer", "o_custkey").alias("label"), F.col("o_orderkey").alias("doc"))
    docs = orders.select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("publisher"))
    return ingest.provenance(from_star(spark, sf_dir).nodes.where("type = 'customer'"), facts, docs).select("label", "fact_id", "publisher")


@query("""SELECT event_type AS source, count(*) AS total, count(*) - count(DISTINCT user_id) AS dedup_hits, round(count(*) FILTER (value > 50) / count(*), 4) AS cache_hit_rate, round(count(*) FILTER (value < 5) / count(*), 4) AS error_rate FROM events GROUP BY event_type""")
def ledger(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("text"), (F.col("value") > 50).alias("cached"), (F.col("value") < 5).alias("failed"))
    return ingest.ledger(own)


@query("SELECT page_id, ((length(html) - length(replace(html, '<tr', ''))) / 3)::BIGINT AS rows FROM pages")
def html_rows(spark, sf_dir):
    return html_tables(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.expr("count_if(row >= 0)").alias("rows"))


@query("""WITH {G} SELECT label, 'kg:' || label AS id, type, round(confidence, 4) AS confidence, (SELECT count(*) FROM edges WHERE src = label) AS n_edges, (SELECT min('kg:' || dst) FROM edges WHERE src = label) AS first FROM nodes WHERE type <> 'order'
UNION ALL SELECT 'order:' || o_orderkey, 'kg:order:' || o_orderkey, 'order', 0.8, 1 + (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey), least('kg:customer:' || o_custkey, (SELECT min('kg:part:' || l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey)) FROM orders""")
def export_jsonld(spark, sf_dir):
    item = to_jsonld(from_star(spark, sf_dir)).withColumn("e", F.from_json(F.get_json_object("item", "$.edges"), "array<struct<rel: string, id: string, confidence: double>>"))
    part = lambda key: F.get_json_object("item", key)
    return item.select("label", part("$['@id']").alias("id"), part("$['@type']").alias("type"), F.round(part("$.confidence").cast("double"), 4).alias("confidence"), F.coalesce(F.size("e"), F.lit(0)).cast("long").alias("n_edges"), F.array_min(F.col("e.id")).alias("first"))


@query(f"""WITH RECURSIVE {{G}}, {walk_sql('region:0', 'a', 'b', 1, 'moves')} SELECT 'node' AS kind, label AS key FROM near
UNION ALL SELECT 'edge', src || '|' || rel || '|' || dst FROM edges JOIN near x ON x.label = src JOIN near y ON y.label = dst WHERE least(x.depth, y.depth) < 1""")
def export_subgraph(spark, sf_dir):
    return subgraph_json(from_star(spark, sf_dir), "region:0", 1).select("kind", "key")


@query("WITH {G} SELECT rel, src AS label, round(confidence, 4) AS confidence FROM edges WHERE dst = 'region:1'")
def ask(spark, sf_dir):
    return language.ask(from_star(spark, sf_dir), "What connects to region:1?")[1].select("rel", "label", F.round("confidence", 4).alias("confidence"))


@query("SELECT 'customer ' || o_custkey AS subject, 'uses' AS rel, o_orderpriority AS object FROM orders")
def tell(spark, sf_dir):
    said = table(spark, sf_dir, "orders").select(F.concat(F.lit("customer "), "o_custkey", F.lit(" uses "), "o_orderpriority").alias("text"))
    return language.tell(said).select("subject", "rel", "object")


# --- analysis, assessments, mesh, actions


@query("""WITH {G}, ends AS (SELECT src AS label FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT n.label, count(e.label) AS d FROM nodes n LEFT JOIN ends e USING (label) GROUP BY n.label)
SELECT 'frontier:' || label AS gap_id, 'frontier' AS kind, label AS subject, round(1 - d / 3, 4) AS severity FROM d WHERE d <= 2""")
def gaps_frontier(spark, sf_dir):
    return analyze.frontier_gaps(from_star(spark, sf_dir))


@query(f"""WITH {FACTS_SQL}, p AS (SELECT src, date_diff('day', lag(valid_from) OVER (PARTITION BY src ORDER BY valid_from), valid_from) AS pause FROM f)
SELECT 'temporal:' || src AS gap_id, 'temporal' AS kind, src AS subject, round(1 - 200 / max(pause), 4) AS severity FROM p GROUP BY src HAVING max(pause) > 200""")
def gaps_temporal(spark, sf_dir):
    return analyze.temporal_gaps(_statuses(spark, sf_dir), 200)


@query("WITH {G} SELECT 'desert:' || type AS gap_id, 'desert' AS kind, type AS subject, round(1 - avg(confidence) / 0.9, 4) AS severity FROM nodes GROUP BY type HAVING round(avg(confidence), 9) < 0.9")
def gaps_desert(spark, sf_dir):
    g = from_star(spark, sf_dir)
    return analyze.desert_gaps(traverse.Graph(g.nodes.withColumn("confidence", F.col("confidence").cast("decimal(6,4)")), g.edges), 0.9).withColumn("severity", F.col("severity").cast("double"))


def _query_nodes(g):
    """The stated query set of pairs: nodes whose number is divisible by 100, against all nodes."""
    return g.nodes.where("cast(substring_index(label, ':', -1) as bigint) % 100 = 0").select("label")


@query()
def gaps(spark, sf_dir):
    """The ten most severe gaps of the whole graph; holes are pairs of any two nodes, and those of every hundredth node only bound how severe they must be."""
    g = from_star(spark, sf_dir)
    others = (analyze.frontier_gaps(g), analyze.temporal_gaps(_statuses(spark, sf_dir)), analyze.desert_gaps(g, 0.9))
    return analyze.suggest_queries(analyze.best_gaps(g, analyze.hole_gaps(g, 2, _query_nodes(g)), *others))


@query("""WITH {G}, ends AS (SELECT src AS label FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT n.label, count(e.label) AS d FROM nodes n LEFT JOIN ends e USING (label) GROUP BY n.label), """ + FACTS_SQL + """,
c AS (SELECT DISTINCT x.src, x.dst, y.dst FROM f x JOIN f y ON x.src = y.src AND x.dst < y.dst AND x.valid_from < y.valid_to AND y.valid_from < x.valid_to)
SELECT count(*) FILTER (d <= 2) AS gaps_found, count(*) FILTER (d = 0) AS orphan_nodes, (SELECT count(*) FROM (SELECT type FROM nodes GROUP BY type HAVING avg(confidence) < 0.87)) AS weak_clusters, (SELECT count(*) FROM c) AS contradictions FROM d""")
def scan(spark, sf_dir):
    return analyze.scan(from_star(spark, sf_dir), learn.contradictions(_statuses(spark, sf_dir), ["priority"]), 0.87)


@query("WITH {G} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def stats(spark, sf_dir):
    return analyze.stats(from_star(spark, sf_dir))


@query("WITH {G} SELECT type, CASE WHEN grouping(s) = 0 THEN s END AS source, count(*) AS n, round(avg(confidence), 4) AS mean FROM (SELECT *, 'star' AS s FROM nodes) GROUP BY CUBE (type, s)")
def graph_stats(spark, sf_dir):
    return analyze.graph_stats(from_star(spark, sf_dir))


@query("""WITH {G}, own AS (SELECT src, dst FROM edges WHERE rel = 'located_in'), m AS (SELECT src AS label, dst FROM own UNION ALL SELECT DISTINCT dst, dst FROM own)
SELECT min(label) AS component, count(*) AS members FROM m GROUP BY dst HAVING count(*) >= 3""")
def clusters_suspicious(spark, sf_dir):
    return analyze.suspicious_clusters(from_star(spark, sf_dir), ["located_in"])


@query("""WITH {G}, ends AS (SELECT src AS label FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT n.label, count(e.label) AS d FROM nodes n LEFT JOIN ends e USING (label) GROUP BY n.label),
near AS (SELECT label, d FROM d WHERE label IN (SELECT b FROM moves WHERE a = 'nation:1') AND label <> 'nation:1' ORDER BY d DESC, label LIMIT 10)
SELECT 'property' AS part, 'n_name' AS item, n_name AS value FROM nation WHERE n_nationkey = 1 UNION ALL SELECT 'relation', rel, count(*)::VARCHAR FROM moves WHERE a = 'nation:1' GROUP BY rel
UNION ALL SELECT 'neighbour', label, d::VARCHAR FROM near UNION ALL SELECT 'gap', 'frontier', round(1 - d / 3, 4)::VARCHAR FROM d WHERE label = 'nation:1' AND d <= 2""")
def dossier(spark, sf_dir):
    return analyze.report(from_star(spark, sf_dir), "nation:1")


HISTORY = ("ts", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")


def _assessments(spark, sf_dir):
    """Suppliers with all of lineitem as evidence."""
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(0.5).alias("probability"))
    direction = F.when(F.col("l_returnflag") == "R", "undermines").otherwise("supports")
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), direction.alias("direction"), F.lit(0.001).alias("weight"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.col("l_shipdate").cast("timestamp").alias("ts"), *HISTORY[1:])
    return ids, evidence


STEP_SQL = "CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * 0.001::DOUBLE * round(1 - l_discount, 2) * 2"


@query(f"""WITH e AS (SELECT l_suppkey AS id, sum({STEP_SQL}) AS s FROM lineitem GROUP BY 1)
SELECT s_suppkey AS id, 0.5::DOUBLE AS old, round(1 / (1 + exp(-coalesce(s, 0))), 4) AS new, round(1 / (1 + exp(-coalesce(s, 0))) - 0.5, 4) AS shift FROM supplier LEFT JOIN e ON e.id = s_suppkey""")
def assess_evaluate(spark, sf_dir):
    return analyze.evaluate(*_assessments(spark, sf_dir))


@query(f"""SELECT l_suppkey AS id, l_orderkey, l_partkey, l_linenumber, round(1 / (1 + exp(-sum({STEP_SQL}) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount, l_returnflag ROWS UNBOUNDED PRECEDING))), 4) AS probability
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def assess_history(spark, sf_dir):
    return analyze.history(*_assessments(spark, sf_dir), HISTORY).select("id", "l_orderkey", "l_partkey", "l_linenumber", "probability")


@query("SELECT o_custkey AS id, 1::BIGINT AS changed FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' GROUP BY o_custkey")
def assess_stale(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(label("customer", "o_custkey").alias("label"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    watches = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), label("customer", "c_custkey").alias("label"), F.lit("1997-01-01").cast("timestamp").alias("evaluated_at"))
    return analyze.stale(watches, orders)


@query("""WITH {G}, d(domain, type) AS (VALUES ('trade', 'order'), ('trade', 'part'), ('people', 'customer'), ('people', 'supplier'))
SELECT domain, count(*) AS node_count, round(avg(confidence), 4) AS avg_confidence, strftime(max(created_at), '%Y-%m-%d') AS freshness FROM nodes JOIN d USING (type) GROUP BY domain""")
def mesh_profile(spark, sf_dir):
    domains = spark.createDataFrame([("trade", "order"), ("trade", "part"), ("people", "customer"), ("people", "supplier")], "domain string, type string")
    return analyze.profile(from_star(spark, sf_dir).nodes, domains).withColumn("freshness", F.date_format("freshness", "yyyy-MM-dd"))


def _edits(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(label("part", "l_partkey").alias("label"), F.col("l_suppkey").alias("peer")).agg(F.max(F.round(1 - F.col("l_discount"), 2)).alias("confidence"), F.max(F.col("l_shipdate").cast("timestamp")).alias("ts"))


@query("""WITH e AS (SELECT 'part:' || l_partkey AS label, l_suppkey AS peer, max(round(1 - l_discount, 2)) AS c, max(l_shipdate) AS ts FROM lineitem GROUP BY ALL)
SELECT label, 'price' AS field, peer::VARCHAR AS value, peer FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY c * CASE WHEN peer % 3 = 0 THEN 0.25 ELSE 0.75 END::DOUBLE DESC, ts DESC, peer DESC) = 1""")
def mesh_merge(spark, sf_dir):
    return analyze.merge_edits(_edits(spark, sf_dir).withColumns({"field": F.lit("price"), "value": F.col("peer").cast("string"), "trust": F.when(F.col("peer") % 3 == 0, 0.25).otherwise(0.75)}))


@query("""WITH e AS (SELECT 'part:' || l_partkey AS label, l_suppkey AS peer, max(round(1 - l_discount, 2)) AS confidence FROM lineitem GROUP BY ALL)
SELECT label, peer, round(confidence, 4) AS confidence FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY confidence DESC, peer DESC) = 1""")
def mesh_query(spark, sf_dir):
    own = _edits(spark, sf_dir).select("label", "peer", "confidence")
    return analyze.federated(own.where("peer % 2 = 0"), own.where("peer % 2 = 1")).withColumn("confidence", F.round("confidence", 4))


@query("SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'P'")
def mesh_delta(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return analyze.delta(own.where("s <> 'P'"), own, ["k", "s"])


@query("""SELECT 'big' AS rule, event_id FROM events WHERE event_type = 'purchase' AND value > 50 UNION ALL SELECT 'broken', event_id FROM events WHERE event_type = 'error' OR NOT (value >= 1)""")
def action_dry_run(spark, sf_dir):
    rules = {"big": "event.event_type == 'purchase' && event.value > 50", "broken": "event.event_type == 'error' || ! (event.value >= 1)"}
    return analyze.action_matches(table(spark, sf_dir, "events"), rules).select("rule", "event_id")


@query("""WITH RECURSIVE e AS (SELECT event_type AS rule, epoch_us(ts) AS t, min(event_id) AS id FROM events WHERE event_type IN ('error', 'purchase') GROUP BY ALL),
f AS (SELECT rule, min(t) AS t FROM e GROUP BY rule UNION ALL SELECT f.rule, min(e.t) FROM f JOIN e ON e.rule = f.rule AND e.t >= f.t + 3600000000 GROUP BY f.rule)
SELECT id AS event_id FROM f JOIN e USING (rule, t)""")
def action_cooldown(spark, sf_dir):
    own = changes.timed(table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')")).select(F.col("event_type").alias("rule"), "ts", F.col("event_id").alias("id"))
    return analyze.cooled_down(own, 3600).select(F.col("id").alias("event_id"))


# --- streams


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_window(spark, sf_dir):
    return changes.windowed_counts(table(spark, sf_dir, "events")).withColumns({"start": F.date_format("start", "yyyy-MM-dd HH:mm"), "total": F.round("total", 2)})


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark, sf_dir):
    return changes.sessions(table(spark, sf_dir, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""SELECT 'confidence_updated' AS event, 'order:' || o_orderkey AS key FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'edge_added', 'order:' || o_orderkey || '|placed_by|customer:' || o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def st_events(spark, sf_dir):
    new = from_star(spark, sf_dir)
    old = new.patch_nodes("type = 'order' and props['o_orderstatus'] = 'F'", confidence="0.4")
    placed = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(label("order", "o_orderkey").alias("src"), F.lit("placed_by").alias("rel"))
    return changes.graph_events(traverse.Graph(old.nodes, old.edges.join(placed, ["src", "rel"], "left_anti").select(*old.edges.columns)), new).select("event", "key")


