"""More registered queries: files in and out, edits, filters, questions, ingest steps, gaps, and workflows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .graph import Graph, cut_lineage, empty
from .operators import analyze, filters, ingest, language, learn, search, temporal, traverse, workflow
from .plans.rules import derive, rule_table
from .registry import BM25_SQL, QUERIES, SQL, _docs, _statuses, query
from .shared import new_path
from .sources import files
from .sources.star import from_star, label, table
from .streaming import changes

__all__ = ["QUERIES", "SQL"]

# --- files: written to the shared folder, read back as graphs


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(label("customer", "c_custkey").alias("label"), F.lit("customer").alias("type"), F.lit(0.9).alias("confidence"), label("nation", "c_nationkey").alias("nation"), "c_mktsegment")


def _rows(nodes, edges, prop: str):
    left = nodes.select(F.lit("node").alias("kind"), F.concat_ws("|", "label", "type", F.element_at("props", F.lit(prop))).alias("key"), F.round("confidence", 4).alias("confidence"))
    return left.unionByName(edges.select(F.lit("edge").alias("kind"), F.concat_ws("|", "src", "rel", "dst").alias("key"), F.round("confidence", 4).alias("confidence")))


CUSTOMER_ROWS = """SELECT 'node' AS kind, 'customer:' || c_custkey || '|customer|' || c_mktsegment AS key, 0.9::DOUBLE AS confidence FROM customer
UNION ALL SELECT 'edge', 'customer:' || c_custkey || '|located_in|nation:' || c_nationkey, 0.7 FROM customer"""


def _records(spark, sf_dir):
    own = _customers(spark, sf_dir)
    nodes = own.select(F.col("label").alias("entity"), "type", F.create_map(F.lit("segment"), "c_mktsegment").alias("properties"), "confidence", F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("to"), F.lit(None).cast("string").alias("relationship"))
    return nodes.unionByName(own.select(F.lit(None).cast("string").alias("entity"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("map<string,string>").alias("properties"), F.lit(0.7).alias("confidence"), F.col("label").alias("from"), F.col("nation").alias("to"), F.lit("located_in").alias("relationship")))


@query(CUSTOMER_ROWS)
def src_ndjson(spark, sf_dir):
    path = new_path(spark, "ndjson")
    _records(spark, sf_dir).write.json(path)
    return _rows(*files.read_ndjson(spark, path), "segment")


@query(CUSTOMER_ROWS.replace("customer:", "nation:").replace("c_custkey || '|customer|' || c_mktsegment", "n_nationkey || '|nation|' || n_name").replace("c_custkey", "n_nationkey").replace("nation:' || c_nationkey", "region:' || n_regionkey").replace("|located_in|", "|in_region|").replace("FROM customer", "FROM nation"))
def src_json_file(spark, sf_dir):
    own = table(spark, sf_dir, "nation")
    nodes = F.struct(label("nation", "n_nationkey").alias("entity"), F.lit("nation").alias("type"), F.struct(F.col("n_name").alias("segment")).alias("properties"), F.lit(0.9).alias("confidence"))
    edges = F.struct(label("nation", "n_nationkey").alias("from"), label("region", "n_regionkey").alias("to"), F.lit("in_region").alias("relationship"), F.lit(0.7).alias("confidence"))
    path = new_path(spark, "json")
    # a JSON document of the smallest table: its rows are one array by nature
    own.agg(F.to_json(F.struct(F.collect_list(nodes).alias("entities"), F.collect_list(edges).alias("relationships"))).alias("value")).write.text(path)
    return _rows(*files.read_json_graph(spark, path), "segment")


@query("SELECT 'supplier:' || s_suppkey AS label, 'supplier' AS type, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM supplier WHERE s_suppkey % 5 <> 0")
def src_csv_nodes(spark, sf_dir):
    path = new_path(spark, "csv")
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.when(key % 5 != 0, label("supplier", "s_suppkey")).alias("name"), F.lit("supplier").alias("type"), F.when(key % 3 == 0, "unknown").otherwise("0.6").alias("confidence"), F.col("s_name").alias("full_name"))
    rows.write.csv(path, header=True)
    return files.read_csv_nodes(spark, path).select("label", "type", F.element_at("props", F.lit("full_name")).alias("name"), "confidence")


@query("SELECT 'supplier:' || s_suppkey AS src, 'located_in' AS rel, 'nation:' || s_nationkey AS dst, CASE WHEN s_suppkey % 3 = 0 THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM supplier WHERE s_suppkey % 5 <> 0")
def src_csv_edges(spark, sf_dir):
    path = new_path(spark, "csv")
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(label("supplier", "s_suppkey").alias("from"), F.when(key % 5 != 0, label("nation", "s_nationkey")).alias("to"), F.lit("located_in").alias("relationship"), F.when(key % 3 != 0, "0.6").alias("confidence"))
    rows.write.csv(path, header=True)
    return files.read_csv_edges(spark, path).select("src", "rel", "dst", "confidence")


@query("SELECT 'node' AS kind, n_name || '|nation' AS key FROM nation UNION ALL SELECT 'edge', n_name || '|inRegion|' || 'region-' || n_regionkey FROM nation")
def src_jsonld(spark, sf_dir):
    own = table(spark, sf_dir, "nation")
    item = F.struct(F.concat(F.lit("kg:nation-"), "n_nationkey").alias("@id"), F.lit("schema:Nation").alias("@type"), F.col("n_name").alias("rdfs:label"), F.struct(F.concat(F.lit("kg:region-"), "n_regionkey").alias("@id")).alias("kg:inRegion"))
    path = new_path(spark, "jsonld")
    own.agg(F.to_json(F.struct(F.collect_list(item).alias("@graph"))).alias("value")).write.text(path)
    nodes, edges = files.read_jsonld(spark, path)
    return nodes.select(F.lit("node").alias("kind"), F.concat_ws("|", "label", "type").alias("key")).unionByName(edges.select(F.lit("edge").alias("kind"), F.concat_ws("|", "src", "rel", "dst").alias("key")))


@query("SELECT 'd' || o_orderkey || '.md' AS filename, CASE WHEN o_orderkey % 2 = 0 THEN 'Order ' || o_orderkey ELSE 'Heading ' || o_orderkey END AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS author, 'The order was placed by customer ' || o_custkey || '.' AS excerpt FROM orders")
def src_md_frontmatter(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    front = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("---\ntitle: Order "), key, F.lit("\nauthor: "), "o_orderpriority", F.lit("\n---\n"))).otherwise("")
    text = F.concat(front, F.lit("# Heading "), key, F.lit("\n\nshort\n\nThe order was placed by customer "), F.col("o_custkey").cast("string"), F.lit(".\n"))
    raw = table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), key, F.lit(".md")).alias("filename"), text.alias("text"))
    return files.markdown_parts(raw).select("filename", "title", "author", "excerpt")


@query("SELECT page_id, ((length(html) - length(replace(html, '<li>', ''))) / 4)::BIGINT AS rows, ((length(html) - length(replace(html, '<li>', ''))) / 4)::BIGINT AS cells FROM pages")
def src_html_tables(spark, sf_dir):
    """Rows of tables: the menus of the pages, written as tables."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "<ul>", "<table>"), "</ul>", "</table>"), "<li>", "<tr><td>"), "</li>", "</td></tr>").alias("html"))
    found = files.html_tables(pages)
    return found.groupBy("page_id").agg(F.count_if(F.col("row") >= 0).alias("rows"), F.sum(F.when(F.col("row") >= 0, F.size("cells")).otherwise(0)).cast("long").alias("cells"))


# --- store, relate, edit


@query("""SELECT 'customer:' || c_custkey AS label, 'customer' AS type, 0.9::DOUBLE AS confidence, c_mktsegment AS segment, arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) AS last
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment""")
def src_store(spark, sf_dir):
    g = from_star(spark, sf_dir)
    own = table(spark, sf_dir, "orders").select(F.upper(label("customer", "o_custkey")).alias("label"), F.lit("other").alias("type"), F.lit(0.1).alias("confidence"), F.create_map(F.lit("last"), "o_orderstatus").alias("props"), "o_orderdate", "o_orderkey")
    grown = Graph(g.nodes.where("type = 'customer'"), g.edges).store(own, ["o_orderdate", "o_orderkey"])
    return grown.nodes.where("type = 'customer'").select("label", "type", F.round("confidence", 4).alias("confidence"), F.element_at("props", F.lit("c_mktsegment")).alias("segment"), F.element_at("props", F.lit("last")).alias("last"))


@query("SELECT 'part:' || p_partkey AS label, p_brand AS brand, 'seen' AS mark FROM part WHERE p_size > 20")
def src_set(spark, sf_dir):
    g = from_star(spark, sf_dir)
    own = table(spark, sf_dir, "part").where("p_size > 20").select(label("part", "p_partkey").alias("label"), F.create_map(F.lit("mark"), F.lit("seen")).alias("props"))
    marked = Graph(g.nodes.where("type = 'part'"), g.edges).store(own).nodes
    return marked.where(F.map_contains_key("props", "mark")).select("label", F.element_at("props", F.lit("p_brand")).alias("brand"), F.element_at("props", F.lit("mark")).alias("mark"))


@query("""SELECT CASE WHEN l_linenumber = 7 OR NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey) THEN 'node not found' ELSE 'stored' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1""")
def src_relate(spark, sf_dir):
    g = from_star(spark, sf_dir)
    end = F.when(F.col("l_linenumber") == 7, F.lit("nobody")).otherwise(label("SUPPLIER", "l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").select(label("Order", "l_orderkey").alias("src"), F.lit("shipped_by").alias("rel"), end.alias("dst"))
    grown, bad = Graph(g.nodes, g.edges.limit(0)).relate(rows)
    return grown.edges.select(F.lit("stored").alias("outcome")).unionByName(bad.select(F.col("error").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'node' AS kind, 'nation:' || n_nationkey AS key, CASE WHEN n_nationkey = 3 THEN 0::DOUBLE ELSE 0.95::DOUBLE END AS confidence, n_nationkey = 3 AS deleted FROM nation
UNION ALL SELECT 'edge', 'nation:' || n_nationkey || '|region:' || n_regionkey, 0.95, n_nationkey = 4 FROM nation""")
def edit_deletes(spark, sf_dir):
    g = from_star(spark, sf_dir)
    region = table(spark, sf_dir, "nation").where("n_nationkey = 4").select(label("region", "n_regionkey").alias("r")).first()
    g = g.soft_delete("Nation:3").delete_edge("nation:4", "in_region", region.r if region else "")
    nodes = g.nodes.where("type = 'nation'").select(F.lit("node").alias("kind"), F.col("label").alias("key"), "confidence", "deleted")
    return nodes.unionByName(g.edges.where("rel = 'in_region'").select(F.lit("edge").alias("kind"), F.concat_ws("|", "src", "dst").alias("key"), "confidence", "deleted"))


@query("""SELECT 'node' AS kind, CASE WHEN o_orderstatus = 'F' THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END AS confidence, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT 'edge', CASE WHEN o_custkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0.85::DOUBLE END, count(*) FROM orders GROUP BY ALL""")
def edit_patches(spark, sf_dir):
    g = from_star(spark, sf_dir).patch_nodes("type = 'order' AND props['o_orderstatus'] = 'F'", confidence="0.4D")
    g = g.patch_edges("rel = 'placed_by' AND cast(substring_index(dst, ':', -1) AS bigint) % 2 = 0", confidence="0.5D")
    each = [df.select(F.lit(kind).alias("kind"), F.round("confidence", 4).alias("confidence")) for kind, df in (("node", g.nodes.where("type = 'order'")), ("edge", g.edges.where("rel = 'placed_by'")))]
    return each[0].unionByName(each[1]).groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("n"))


# --- filters


@query("SELECT 'part:' || p_partkey AS label FROM part WHERE p_name = 'red bolt'")
def f_phrase(spark, sf_dir):
    return filters.search_nodes(from_star(spark, sf_dir).nodes, 'type:part AND "red bolt"').select("label")


@query("SELECT 'nation:' || n_nationkey AS label FROM nation UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier")
def f_prop_exists(spark, sf_dir):
    return filters.search_nodes(from_star(spark, sf_dir).nodes, "prop:n_name OR prop:s_name").select("label")


@query("SELECT 'customer:' || c_custkey AS label FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 5 AND c_mktsegment <> 'BUILDING'")
def f_tier(spark, sf_dir):
    nodes = from_star(spark, sf_dir).nodes.where("type = 'customer'")
    uses = table(spark, sf_dir, "orders").select(label("customer", "o_custkey").alias("label"), F.lit("access").alias("kind"))
    return filters.search_nodes(nodes.join(learn.tiers(nodes, uses), "label"), "tier:core AND NOT prop:c_mktsegment=BUILDING").select("label")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def f_acl(spark, sf_dir):
    level = F.when(F.col("c_mktsegment") == "BUILDING", "public").when(F.col("c_mktsegment") == "MACHINERY", "internal").when(F.col("c_mktsegment") == "FURNITURE", "restricted")
    return filters.cleared(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), level.alias("sensitivity"), "c_mktsegment"), "internal").select("id")


@query(BM25_SQL.replace("FROM documents)", "FROM documents WHERE lang = 'en' AND doc_id % 2 = 0)") + " SELECT id, round(score, 4) AS score FROM scored WHERE score > 0 ORDER BY scored.score DESC, id LIMIT 10")
def search_prefiltered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return search.bm25(docs, "the order thing", where="lang = 'en' AND id % 2 = 0").withColumn("score", F.round("score", 4))


@query("SELECT 'nation:' || n_nationkey AS label, row_number() OVER (ORDER BY n_nationkey % 3 DESC, 'nation:' || n_nationkey) AS place FROM nation")
def search_rank_conf(spark, sf_dir):
    nodes = from_star(spark, sf_dir).nodes.where("type = 'nation'").withColumn("confidence", F.expr("cast(substring_index(label, ':', -1) AS bigint) % 3 / 10"))
    found = filters.search_nodes(nodes, "type:nation").select("label", "confidence")
    return found.select("label", F.expr("row_number() OVER (ORDER BY confidence DESC, label)").cast("long").alias("place"))


# --- questions and statements


@query("WITH {G} SELECT label, type, text AS name FROM nodes WHERE label = 'nation:5'")
def ask_lookup(spark, sf_dir):
    return language.ask(from_star(spark, sf_dir), "What is the Nation:5?")[1].select("label", "type", F.element_at("props", F.lit("n_name")).alias("name"))


@query("WITH {G} SELECT rel, dst AS label, round(confidence, 4) AS confidence FROM edges WHERE src = 'order:3'")
def ask_outgoing(spark, sf_dir):
    return language.ask(from_star(spark, sf_dir), "What does order:3 connect to?")[1].withColumn("confidence", F.round("confidence", 4))


@query("WITH {G} SELECT x.src || ' > ' || x.dst || ' > ' || y.dst AS path, 2 AS hops FROM edges x JOIN edges y ON x.dst = y.src WHERE x.src = 'supplier:1' AND x.rel = 'located_in' AND y.rel = 'in_region'")
def ask_path(spark, sf_dir):
    row = table(spark, sf_dir, "supplier").where("s_suppkey = 1").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(label("region", "n_regionkey").alias("r")).first()
    return language.ask(from_star(spark, sf_dir), f"How are supplier:1 and {row.r if row else 'nothing'} related?")[1].select("path", "hops")


@query("SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_name = 'NATION_7'")
def ask_search(spark, sf_dir):
    g = from_star(spark, sf_dir)
    return language.ask(Graph(g.nodes.where("type = 'nation'"), g.edges), "search for nation_7", 1)[1].select("id")


VERBS = ("is a", "causes", "depends on", "runs on", "uses", "was developed at")


@query("""SELECT 'o' || o_orderkey AS subject, CASE WHEN o_orderkey % 7 < 6 THEN ['is_a', 'causes', 'depends_on', 'runs_on', 'uses', 'developed_at'][(o_orderkey % 7 + 1)::INTEGER] END AS rel, CASE WHEN o_orderkey % 7 < 6 THEN 'c' || o_custkey END AS object,
CASE WHEN o_orderkey % 7 = 6 THEN 'status' END AS key, CASE WHEN o_orderkey % 7 = 6 THEN o_orderstatus || ' now' END AS value FROM orders""")
def tell_all(spark, sf_dir):
    verb = F.get(F.array(*[F.lit(v) for v in VERBS]), (F.col("o_orderkey") % 7).cast("int"))
    fact = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(" "), verb, F.lit(" c"), F.col("o_custkey").cast("string"), F.lit("."))
    prop = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(" has property status = "), "o_orderstatus", F.lit(" now"))
    return language.tell(table(spark, sf_dir, "orders").select(F.coalesce(fact, prop).alias("text")))


# --- rules


@query("""WITH d AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT (2 * sum(n * n * n))::BIGINT AS fired, count(*) AS flagged, 2 AS rounds FROM d""")
def rules_fired(spark, sf_dir):
    """Three conditions on one hub without distinctness: as many matches as the cube of its edges, counted without making them."""
    text = 'rule many\nwhen edge(p, "supplied_by", a)\nwhen edge(p, "supplied_by", b)\nwhen edge(p, "supplied_by", c)\nthen flag(p, "many suppliers")'
    d = derive(from_star(spark, sf_dir), text)
    return d.flags.agg(F.lit(d.fired).cast("long").alias("fired"), F.count(F.lit(1)).alias("flagged"), F.lit(d.rounds).alias("rounds"))


@query("""SELECT 'order:' || o_orderkey AS label, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'urgent' END AS flag, CASE WHEN o_orderstatus = 'F' THEN 'yes' END AS done FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'F'""")
def rule_tie_break(spark, sf_dir):
    text = """rule a
when prop(o, "o_orderpriority", "1-URGENT")
then flag(o, "urgent")
rule b
when prop(o, "o_orderstatus", "F")
then prop(o, "done", "yes")
rule c
when prop(o, "done", "yes")
then flag(o, "closed")"""
    g = from_star(spark, sf_dir)
    nodes = derive(Graph(g.nodes.where("type = 'order'"), g.edges.limit(0)), text).graph.nodes
    return nodes.where(F.map_contains_key("props", "_flag")).select("label", F.element_at("props", F.lit("_flag")).alias("flag"), F.element_at("props", F.lit("done")).alias("done"))


@query("SELECT * FROM (VALUES ('a', 0, 'when edge', 'x,r,y'), ('a', 1, 'then edge', 'y,s,x,e1'), ('b', 0, 'when prop', 'x,k,v'), ('b', 1, 'then flag', 'x,why')) t(name, place, kind, arguments)")
def rules_push(spark, sf_dir):
    text = 'rule a\nwhen edge(x, "r", y)\nthen edge(y, "s", x, e1)\nrule b\nwhen prop(x, "k", "v")\nthen flag(x, "why")'
    return rule_table(spark, text).withColumn("arguments", F.array_join("arguments", ","))


# --- learning and time


@query("""WITH f AS (SELECT 'customer:' || o_custkey AS src, o_orderpriority AS dst, o_orderkey AS k, o_orderdate + INTERVAL 30 DAY AS valid_to FROM orders)
SELECT CASE WHEN dst = '1-URGENT' THEN 'superseded' WHEN dst = '2-HIGH' THEN 'contested' WHEN dst = '5-LOW' THEN 'disputed' ELSE 'none' END AS status, CASE WHEN dst = '1-URGENT' THEN '1999-01-01' ELSE strftime(valid_to, '%Y-%m-%d') END AS until, count(*) AS n FROM f GROUP BY ALL""")
def resolve_conflict(spark, sf_dir):
    facts = _statuses(spark, sf_dir)
    action = F.when(F.col("dst") == "1-URGENT", "supersede").when(F.col("dst") == "2-HIGH", "contest").when(F.col("dst") == "5-LOW", "dispute")
    decided = facts.select("src", "rel", F.col("dst").alias("loser"), F.lit("1999-01-01").cast("timestamp").alias("winner_from"), action.alias("action")).where("action is not null").distinct()
    out = learn.resolve(facts, decided)
    return out.groupBy(F.coalesce("status", F.lit("none")).alias("status"), F.date_format("valid_to", "yyyy-MM-dd").alias("until")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') || ': order:' || o_orderkey || ' placed by customer:1' AS line FROM orders WHERE o_custkey = 1 AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'""")
def entity_timeline(spark, sf_dir):
    return workflow.entity_timeline(from_star(spark, sf_dir).edges, "customer:1", "1995-01-01", "1998-01-01").select("line")


@query("SELECT o_orderkey AS id, epoch(TIMESTAMP '1997-01-01')::BIGINT - epoch(o_orderdate)::BIGINT - 86400 * (1 + o_custkey % 300) AS late FROM orders WHERE epoch(TIMESTAMP '1997-01-01')::BIGINT - epoch(o_orderdate)::BIGINT - 86400 * (1 + o_custkey % 300) >= 0")
def schedule_due(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("last"), (86400 * (1 + F.col("o_custkey") % 300)).alias("every"))
    return workflow.due(tasks, "1997-01-01")


@query("SELECT 'nation:' || n_nationkey AS label FROM nation WHERE n_nationkey = 6")
def watch(spark, sf_dir):
    return temporal.watch(from_star(spark, sf_dir), "Nation:6").nodes.where("props['_watched'] = 'true'").select("label")


# --- ingest steps


@query("""SELECT o_orderkey AS idx, CASE WHEN o_orderstatus = 'P' THEN 'renamed' ELSE 'placed_by' END AS rel FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def review_commit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    decided = orders.select(F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "P", "modified").otherwise("rejected").alias("action"), F.lit("renamed").alias("new_rel"))
    return ingest.review(orders.select(F.col("o_orderkey").alias("idx"), F.lit("placed_by").alias("rel")), decided)


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber % 2 AS n, l_returnflag || l_linestatus AS label FROM lineitem)
SELECT x.label AS a, y.label AS b, count(*) AS n, 0.4::DOUBLE AS confidence FROM m x JOIN m y ON x.doc = y.doc AND x.n = y.n AND x.label < y.label GROUP BY 1, 2""")
def co_mention(spark, sf_dir):
    return ingest.co_mentions(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).alias("n"), F.concat("l_returnflag", "l_linestatus").alias("label")))


@query("""SELECT l_orderkey AS doc, l_linenumber AS start, min({'t': l_suppkey % 3, 'l': 'part:' || l_partkey}).l AS label FROM lineitem GROUP BY 1, 2""")
def ner_chain(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("start"), label("part", "l_partkey").alias("label"), F.lit("part").alias("type"), (F.col("l_suppkey") % 3).alias("tier"))
    return ingest.first_tier(own).select("doc", "start", "label")


@query("""SELECT o_orderkey AS doc, CASE o_orderkey % 6 WHEN 0 THEN 'organization' WHEN 1 THEN 'location' WHEN 3 THEN 'monetary_value' WHEN 4 THEN 'concept' WHEN 5 THEN 'person' END AS type FROM orders WHERE o_orderkey % 6 <> 2""")
def ner_typemap(spark, sf_dir):
    names = F.get(F.array(*[F.lit(x) for x in ("ORG", "GPE", "CARDINAL", "MONEY", "UNHEARD_OF", "PERSON")]), (F.col("o_orderkey") % 6).cast("int"))
    return ingest.typed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), names.alias("ner_label"))).select("doc", "type")


@query("""WITH p AS (SELECT ['person', 'location', 'product'] AS k) SELECT k[(o_orderkey % 3 + 1)::INTEGER] AS type_a, k[(o_custkey % 3 + 1)::INTEGER] AS type_b,
CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 3 = 0 THEN 'works_with' WHEN o_orderkey % 3 + o_custkey % 3 = 1 THEN 'based_in' ELSE 'related_to' END AS rel, count(*) AS n FROM orders, p GROUP BY ALL""")
def re_typing(spark, sf_dir):
    kind = lambda c: F.get(F.array(F.lit("person"), F.lit("location"), F.lit("product")), (F.col(c) % 3).cast("int"))
    pairs = table(spark, sf_dir, "orders").select(kind("o_orderkey").alias("type_a"), kind("o_custkey").alias("type_b"))
    return ingest.default_relations(pairs).groupBy("type_a", "type_b", "rel").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS fact_id, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'P' THEN 'debunked' ELSE 'open' END AS status, CASE WHEN o_orderstatus = 'P' THEN 0::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM orders""")
def facts_review(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    decided = orders.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("fact_id"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("debunked").alias("decision"))
    return ingest.set_status(orders.select(F.col("o_orderkey").alias("fact_id"), F.lit("open").alias("status"), F.lit(0.8).alias("confidence")), decided)


@query("""WITH d AS (SELECT DISTINCT p_brand, p_name, p_type FROM part)
SELECT l.p_brand || ' ' || l.p_name AS text, min(e.p_type || ' ' || e.p_brand || ' ' || e.p_name) AS by FROM (SELECT DISTINCT p_brand, p_name FROM d) l JOIN d e ON e.p_brand = l.p_brand
  AND list_has_all(string_split(lower(e.p_type || ' ' || e.p_name), ' '), string_split(l.p_name, ' ')) GROUP BY 1""")
def ledger_subsumed(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_type").distinct()
    early = parts.select(F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("text"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    late = parts.select(F.concat_ws(" ", "p_brand", "p_name").alias("text"), F.lit("2024-02-01").cast("timestamp").alias("ts")).distinct()
    return ingest.subsumed(early.unionByName(late))


@query("SELECT 'part:' || p_partkey AS label, 'trade' AS domain FROM part UNION ALL SELECT 'supplier:' || s_suppkey, 'people' FROM supplier")
def classify_domain(spark, sf_dir):
    domains = spark.createDataFrame([("trade", "part"), ("people", "supplier")], "domain string, type string")
    return analyze.classify(from_star(spark, sf_dir).nodes, domains)


@query("""SELECT 'm' || (l_orderkey % 50) AS path, 'import' AS kind, 'pkg.p' || l_partkey AS name FROM (SELECT DISTINCT l_orderkey % 50 AS l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1)
UNION ALL SELECT 'm' || k, 'module', 'm' || k FROM (SELECT DISTINCT l_orderkey % 50 AS k FROM lineitem WHERE l_linenumber = 1) UNION ALL SELECT 'm' || k, 'function', 'run' FROM (SELECT DISTINCT l_orderkey % 50 AS k FROM lineitem WHERE l_linenumber = 1)""")
def ast_import(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit("m"), (F.col("l_orderkey") % 50).cast("string")).alias("path"), F.concat(F.lit("import pkg.p"), F.col("l_partkey").cast("string")).alias("line")).distinct()
    sources = lines.groupBy("path").agg(F.concat(F.array_join(F.array_sort(F.collect_set("line")), "\n"), F.lit("\n\ndef run():\n    pass\n")).alias("text"))
    return ingest.python_modules(sources)


@query("SELECT * FROM (VALUES ('locatedin', 'located_in', 1::INTEGER), ('suplied_by', 'supplied_by', 1)) t(name, like, distance)".replace("like", '"like"'))
def rel_fuzzy_warn(spark, sf_dir):
    new = spark.createDataFrame([("locatedin",), ("suplied_by",), ("contains",), ("unheard_of",)], "rel string")
    return workflow.close_names(new, traverse.rel_types(from_star(spark, sf_dir)))


@query("""WITH o AS (SELECT o_custkey AS doc, o_orderkey AS place, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS label FROM orders)
SELECT doc, place, coalesce(label, last_value(label IGNORE NULLS) OVER (PARTITION BY doc ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS label FROM o""")
def coref(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("place"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("label"), F.lit("x").alias("type"))
    return workflow.coreference(own).select("doc", "place", "label")


def _shipping_texts(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("Firm"), F.col("s_suppkey").cast("string"), F.lit(" is a carrier. It ships from "), "n_name", F.lit("."))
    docs = own.select(F.col("s_suppkey").alias("doc"), text.alias("text"))
    return docs.unionByName(docs.where("doc % 2 = 0").select((F.col("doc") + 1_000_000_000).alias("doc"), F.upper("text").alias("text")))


def _nation_names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), F.lit("nation").alias("type"))


@query("""SELECT 'mention' AS kind, s_suppkey + d AS doc, n_name AS a, 'nation' AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey, (VALUES (0), (1000000000)) t(d) WHERE d = 0 OR s_suppkey % 2 = 0
UNION ALL SELECT 'relation', s_suppkey, 'Firm' || s_suppkey, 'carrier' FROM supplier UNION ALL SELECT 'relation', s_suppkey + 1000000000, 'FIRM' || s_suppkey, 'CARRIER' FROM supplier WHERE s_suppkey % 2 = 0""")
def analyze_only(spark, sf_dir):
    mentions, relations = workflow.analyze_text(_shipping_texts(spark, sf_dir), _nation_names(spark, sf_dir))
    return mentions.select(F.lit("mention").alias("kind"), "doc", F.col("label").alias("a"), F.col("type").alias("b")).unionByName(relations.select(F.lit("relation").alias("kind"), "doc", F.col("src").alias("a"), F.col("dst").alias("b")))


#: Labels of the shipping texts and their classes: what means the same by letters, by words, or within .15 of its length in edits, and what such pairs join.
_NAMES_SQL = r"""firms AS (SELECT 'Firm' || s_suppkey AS firm, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey),
labels AS (SELECT firm AS l FROM firms UNION SELECT nation FROM firms UNION SELECT 'carrier'),
keyed AS (SELECT l, lower(l) AS k, regexp_replace(lower(l), '[^\p{L}\p{N}]+', '', 'g') AS p, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(l), '[^\p{L}\p{N}]+'), lambda x: x <> ''))), ' ') AS w FROM labels),
same AS (SELECT x.l AS a, y.l AS b FROM keyed x JOIN keyed y ON x.l <> y.l AND (x.k = y.k OR x.p = y.p AND x.p <> '' OR x.w = y.w AND x.w <> ''
  OR levenshtein(x.k, y.k) <= floor(0.15 * greatest(length(x.k), length(y.k)) + 1e-9))),
reach AS (SELECT a, b FROM same UNION SELECT r.a, s.b FROM reach r JOIN same s ON s.a = r.b),
names AS (SELECT l, least(l, coalesce(min(b), l)) AS name FROM labels LEFT JOIN reach ON a = l GROUP BY l),
facts AS (SELECT DISTINCT f.name AS src, 'is_a' AS rel, c.name AS dst FROM firms JOIN names f ON f.l = firm JOIN names c ON c.l = 'carrier'
  UNION SELECT DISTINCT f.name, 'ships_from', n.name FROM firms JOIN names f ON f.l = firm JOIN names n ON n.l = nation),
per_doc AS (SELECT f.name AS src, 'is_a' AS rel, c.name AS dst FROM firms JOIN names f ON f.l = firm JOIN names c ON c.l = 'carrier' UNION ALL SELECT f.name, 'ships_from', n.name FROM firms JOIN names f ON f.l = firm JOIN names n ON n.l = nation),
ends AS (SELECT src AS l FROM facts UNION SELECT dst FROM facts),
sizes AS (SELECT (SELECT count(*) FROM ends) AS nodes, (SELECT count(*) FROM facts) AS edges, (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM facts WHERE rel = 'ships_from' GROUP BY src)) AS conflicts)"""


@query(f"""WITH RECURSIVE {_NAMES_SQL}, first AS (SELECT 'dedup' AS stage, (SELECT count(*) FROM firms) AS n UNION ALL SELECT 'coref', count(*) FROM firms UNION ALL SELECT 'extract', count(*) FROM firms
UNION ALL SELECT 'resolve', count(*) FROM names WHERE l <> name UNION ALL SELECT 'relations', count(*) FROM per_doc UNION ALL SELECT 'conflicts', conflicts FROM sizes)
SELECT 'first ' || stage AS stage, n::BIGINT AS n FROM first UNION ALL SELECT 'first store', (nodes + edges)::BIGINT FROM sizes UNION ALL SELECT 'second ' || stage, n::BIGINT FROM first UNION ALL SELECT 'second store', 0
UNION ALL SELECT 'nodes', nodes::BIGINT FROM sizes UNION ALL SELECT 'edges', edges::BIGINT FROM sizes""")
def ingest_staged(spark, sf_dir):
    """All stages over all suppliers' texts, twice: the second run finds the same and stores nothing."""
    config = ingest.IngestConfig(templates={"ships_from": "{head} ships from {tail}"})
    g, told = empty(spark), []
    for run in ("first", "second"):
        g, counts = workflow.ingest_texts(g, _shipping_texts(spark, sf_dir), _nation_names(spark, sf_dir), ["ships_from"], config)
        g = Graph(cut_lineage(g.nodes), cut_lineage(g.edges))
        told.append(cut_lineage(counts).withColumn("stage", F.concat(F.lit(f"{run} "), "stage")))
    sizes = [df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n")) for name, df in (("nodes", g.nodes), ("edges", g.edges))]
    return told[0].unionByName(told[1]).unionByName(sizes[0]).unionByName(sizes[1])


@query("""SELECT o_orderpriority AS step, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS accepted, 0::BIGINT AS modified, count(*) FILTER (o_orderstatus = 'P') AS rejected, count(*) FILTER (o_orderstatus = 'O') AS pending FROM orders GROUP BY 1""")
def seed_flow(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    decided = orders.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("rejected").alias("action"))
    return workflow.seed_progress(orders.select(F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("step")), decided)


@query("""SELECT event_type AS source, round(3600 - 3540 * avg((value > 20)::INTEGER) * (1 - avg((value < 5)::INTEGER)))::BIGINT AS seconds FROM events GROUP BY 1""")
def adaptive_poll(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), (F.col("value") > 20).cast("int").alias("fresh"), (F.col("value") < 5).cast("int").alias("failed"))
    return workflow.poll_interval(own)


@query("""WITH s AS (SELECT event_type AS source, round(avg((value < 5)::INTEGER), 4) AS error_rate, count(*) FILTER (ts::DATE = DATE '2024-01-10') AS today FROM events GROUP BY 1)
SELECT source, error_rate < 0.15 AS healthy, error_rate, today, greatest(80 - today, 0) AS budget_left FROM s""")
def source_stats(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), "ts", (F.col("value") < 5).cast("int").alias("failed"))
    return workflow.source_stats(own, "2024-01-10", 80, 0.15)


@query("""SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'rss' ELSE 'api' END AS kind, s_suppkey % 2 = 0 AS enabled FROM supplier WHERE s_nationkey <> 1 UNION ALL SELECT -1, 'new', 'file', true""")
def src_crud(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("api").alias("kind"), F.lit(True).alias("enabled"), "s_nationkey")
    sources = workflow.patch(own, "id % 3 = 0", kind="'rss'")
    sources = workflow.drop(sources, own.where("s_nationkey = 1")).drop("s_nationkey")
    return workflow.patch(workflow.put(sources, spark.createDataFrame([(-1, "new", "file", True)], "id long, name string, kind string, enabled boolean")), "id % 2 <> 0 AND id > 0", enabled="false")


@query("SELECT doc_id AS doc, substring(text, 11, 25) AS passage FROM documents WHERE doc_id % 3 <> 0")
def src_document_crud(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    left = workflow.drop(docs, docs.where("doc % 3 = 0"), "doc")
    return workflow.passage(left, 10, 25)


# --- gaps and reports


@query("""WITH d AS (SELECT n_nationkey AS domain, c_mktsegment AS type FROM customer JOIN nation ON c_nationkey = n_nationkey),
grid AS (SELECT * FROM (SELECT DISTINCT domain FROM d), (SELECT DISTINCT type FROM d)), n AS (SELECT grid.domain, grid.type, count(d.type) AS n FROM grid LEFT JOIN d ON d.domain = grid.domain AND d.type = grid.type GROUP BY 1, 2)
SELECT domain, type, n FROM (SELECT *, avg(n) OVER (PARTITION BY type) AS mean FROM n) WHERE n < mean / 2""")
def gap_asymmetric(spark, sf_dir):
    own = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("label"), F.col("n_nationkey").alias("domain"), F.col("c_mktsegment").alias("type"))
    return analyze.asymmetric_gaps(own).select("domain", "type", "n")


@query("""WITH {G}, ends AS (SELECT src AS label FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT n.label, count(e.label) AS d FROM nodes n LEFT JOIN ends e USING (label) GROUP BY n.label)
SELECT 'frontier:' || label AS gap_id, label AS subject, 'What is ' || label || ' connected to?' AS question, round(1 - d / 3, 4) AS severity FROM d WHERE d <= 2 AND label NOT LIKE '%1' ORDER BY severity DESC, gap_id LIMIT 10""")
def gap_dismiss(spark, sf_dir):
    gaps = analyze.frontier_gaps(from_star(spark, sf_dir))
    found = analyze.rank_gaps(gaps, dismissed=gaps.where("subject LIKE '%1'"))
    return analyze.suggest_queries(found).select("gap_id", "subject", "question", "severity")


@query("""SELECT l_orderkey AS gap_id, min({'o': l_linenumber % 3, 'a': l_partkey}).a AS answer, ['mesh', 'free', 'paid'][(min({'o': l_linenumber % 3, 'a': l_partkey}).o + 1)::INTEGER] AS tier FROM lineitem GROUP BY 1""")
def enrich_dispatch(spark, sf_dir):
    tier = F.get(F.array(F.lit("mesh"), F.lit("free"), F.lit("paid")), (F.col("l_linenumber") % 3).cast("int"))
    return analyze.dispatch(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("gap_id"), tier.alias("tier"), F.col("l_partkey").alias("answer")))


def _peer_profiles(spark, sf_dir):
    own = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("peer"), F.lower("c_mktsegment").alias("domain"))
    return own.agg(F.count(F.lit(1)).alias("node_count"), F.round(F.avg(F.col("c_acctbal") / 10000), 4).alias("avg_confidence"))


PROFILES = "p AS (SELECT c_nationkey AS peer, lower(c_mktsegment) AS domain, count(*) AS node_count, round(avg(c_acctbal / 10000), 4) AS avg_confidence FROM customer GROUP BY 1, 2)"


@query(f"WITH {PROFILES} SELECT peer, domain, node_count, round(avg_confidence * ln(1 + node_count), 4) AS relevance FROM p WHERE contains(domain, 'build') ORDER BY relevance DESC, peer LIMIT 10")
def mesh_discover(spark, sf_dir):
    return analyze.discover(_peer_profiles(spark, sf_dir), "BUILD").select("peer", "domain", "node_count", "relevance")


@query(f"WITH {PROFILES} SELECT domain, sum(node_count)::BIGINT AS total FROM p GROUP BY domain HAVING max(node_count) < 18")
def mesh_blind_spot(spark, sf_dir):
    return analyze.blind_spots(_peer_profiles(spark, sf_dir), 18)


@query("""WITH e AS (SELECT 'part:' || l_partkey AS label, l_suppkey AS peer, max(round(1 - l_discount, 2)) AS c, max(l_shipdate) AS ts FROM lineitem GROUP BY ALL)
SELECT label, peer, round(c, 4) AS confidence FROM e WHERE peer % 4 <= 1 AND peer % 5 <= 2 QUALIFY row_number() OVER (PARTITION BY label ORDER BY c DESC, peer DESC) = 1""")
def mesh_query_cleared(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(label("part", "l_partkey").alias("label"), F.col("l_suppkey").alias("peer")).agg(F.max(F.round(1 - F.col("l_discount"), 2)).alias("confidence"))
    level = F.get(F.array(*map(F.lit, filters.SENSITIVITY)), (F.col("peer") % 4).cast("int"))
    return workflow.federated_answers(lines.withColumns({"sensitivity": level, "hops": F.col("peer") % 5}), "internal", 2).withColumn("confidence", F.round("confidence", 4))


@query("SELECT 'peer-' || o_orderstatus AS peer, count(*) AS rows FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
def mesh_audit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    log = spark.createDataFrame([], "peer string, ts timestamp, rows long, digest long")
    for s in ("F", "P"):
        log = workflow.audit(log, orders.where(F.col("o_orderstatus") == s), f"peer-{s}", "2024-01-01")
    return log.select("peer", "rows")


@query("""WITH {G} SELECT a.type AS type_a, e.rel, b.type AS type_b, count(*) AS n FROM edges e JOIN nodes a ON a.label = e.src JOIN nodes b ON b.label = e.dst GROUP BY ALL""")
def topic_map(spark, sf_dir):
    return workflow.topic_map(from_star(spark, sf_dir))


@query("""WITH {G}, ends AS (SELECT src AS label FROM edges UNION ALL SELECT dst FROM edges), top AS (SELECT label, count(*) AS n FROM ends GROUP BY label ORDER BY n DESC, label LIMIT 10)
SELECT 'type' AS part, type AS item, count(*)::VARCHAR AS value FROM nodes GROUP BY type UNION ALL SELECT 'relation', rel, count(*)::VARCHAR FROM edges GROUP BY rel
UNION ALL SELECT 'changed', type, count(*)::VARCHAR FROM nodes WHERE created_at >= TIMESTAMP '1998-01-01' GROUP BY type UNION ALL SELECT 'connected', label, n::VARCHAR FROM top""")
def briefing(spark, sf_dir):
    return workflow.briefing(from_star(spark, sf_dir), "1998-01-01")


@query("""WITH {G}, n AS (SELECT count(*) AS n FROM nodes), d AS (SELECT a AS label, count(DISTINCT b) AS d FROM moves WHERE a <> b GROUP BY a)
SELECT nodes.label, coalesce(d, 0) AS degree, round(coalesce(d, 0) / (n - 1), 6)::DOUBLE AS centrality FROM nodes LEFT JOIN d USING (label), n""")
def centrality(spark, sf_dir):
    return traverse.centrality(from_star(spark, sf_dir)).withColumn("centrality", F.round("centrality", 6))


_SHARES = ", ".join(f"((length(t) - length(replace(t, '{x}', ''))) / length(t))::FLOAT" for x in "aeinorst")


@query(f"""WITH p AS (SELECT 'part:' || p_partkey AS label, lower('part:' || p_partkey || ' ' || p_name || ' ' || p_brand || ' ' || p_type) AS t FROM part), v AS (SELECT label, [{_SHARES}] AS v FROM p)
SELECT label, array_to_string(list_transform(v, lambda x: round(x * 10000)::INTEGER), ',') AS embedding FROM v""")
def reindex(spark, sf_dir):
    found = workflow.reindex(from_star(spark, sf_dir).nodes.where("type = 'part'"), workflow.letter_shares)
    return found.select("label", F.array_join(F.transform("embedding", lambda x: F.round(x * 10000).cast("int").cast("string")), ",").alias("embedding"))


# --- assessments and actions


@query("""SELECT s_suppkey AS id, 'Supplier ' || s_suppkey || ' is safe' AS title, CASE WHEN s_suppkey % 4 = 0 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS probability FROM supplier WHERE s_suppkey % 10 <> 3 AND s_suppkey % 6 <> 0""")
def assess_crud(spark, sf_dir):
    """Created with defaults, patched, some deleted, and those listed that are still active."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string"), F.lit(" is safe")).alias("title"))
    made = workflow.new_assessments(own)
    made = workflow.patch(workflow.patch(made, "id % 4 = 0", probability="0.7D"), "id % 6 = 0", status="'closed'")
    return workflow.drop(made, own.where("id % 10 = 3")).where("status = 'active'").select("id", "title", "probability")


@query("""WITH m AS (SELECT event_type AS rule, event_id AS id, ts FROM events WHERE value > 40), e(rule, effect, target, value) AS (VALUES ('error', 'notify', 'ops', ''), ('purchase', 'edge_create', 'shop', 'bought_in'), ('purchase', 'confidence_cascade', '', '0.1'))
SELECT rule, id, effect, target FROM m JOIN e USING (rule) QUALIFY row_number() OVER (PARTITION BY rule ORDER BY ts, id, effect, target) <= 25""")
def action_effects(spark, sf_dir):
    firings = changes.timed(table(spark, sf_dir, "events").where("value > 40")).select(F.col("event_type").alias("rule"), F.col("event_id").alias("id"), "ts")
    effects = spark.createDataFrame([("error", "notify", "ops", ""), ("purchase", "edge_create", "shop", "bought_in"), ("purchase", "confidence_cascade", "", "0.1")], "rule string, effect string, target string, value string")
    return workflow.planned_effects(firings, effects, 25).select("rule", "id", "effect", "target")


@query("""WITH {G}, hot AS (SELECT 'nation:' || n_nationkey AS label FROM nation WHERE n_nationkey % 5 = 0), add AS (SELECT label, 0.04::DOUBLE AS v FROM hot UNION ALL SELECT dst, 0.02 FROM edges JOIN hot ON hot.label = edges.src),
s AS (SELECT label, sum(v) AS v FROM add GROUP BY label)
SELECT 'node' AS kind, n.label AS key, round(CASE WHEN v IS NULL THEN n.confidence ELSE least(0.95, n.confidence + v) END, 4)::DOUBLE AS confidence FROM nodes n LEFT JOIN s USING (label) WHERE type IN ('nation', 'region')
UNION ALL SELECT 'edge', label || '|flagged|region:0', 0.8 FROM hot""")
def action_apply(spark, sf_dir):
    g = from_star(spark, sf_dir)
    g = Graph(g.nodes.where("type IN ('nation', 'region')"), g.edges.where("rel = 'in_region'"))
    hot = table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select(label("nation", "n_nationkey").alias("id"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    planned = hot.withColumns({"effect": F.lit("confidence_cascade"), "target": F.lit(""), "value": F.lit("0.04")}).unionByName(hot.withColumns({"effect": F.lit("edge_create"), "target": F.lit("region:0"), "value": F.lit("flagged")}))
    done, _ = workflow.apply_effects(g, planned)
    nodes = done.nodes.select(F.lit("node").alias("kind"), F.col("label").alias("key"), F.round("confidence", 4).alias("confidence"))
    return nodes.unionByName(done.edges.where("rel = 'flagged'").select(F.lit("edge").alias("kind"), F.concat_ws("|", "src", "rel", "dst").alias("key"), F.round("confidence", 4).alias("confidence")))
