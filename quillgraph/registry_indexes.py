"""Registered queries over stored indexes and joins of similar texts, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.text import tokens
from .graph import cut_lineage, empty
from .operators import embeddings, mesh_digest, similar, text_index
from .registry import SQL, _texts, query
from .registry_steps import QUERIES
from .shared import new_path
from .sources.star import from_star, label, table
from .streaming import changes, cooldown
from .streaming.store import GraphStore

__all__ = ["QUERIES", "SQL"]

WORDS_SQL = r"t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)"


@query(f"""WITH RECURSIVE {WORDS_SQL}, d AS (SELECT id, list_distinct(w) AS w, len(list_distinct(w)) AS n FROM t),
l AS (SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON a.id <> b.id AND a.n > 0 AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  WHERE 100 * len(list_intersect(a.w, b.w)) >= 85 * (a.n + b.n - len(list_intersect(a.w, b.w)))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.id, least(d.id, coalesce(min(r.b), d.id)) AS class_id FROM d LEFT JOIN r ON r.a = d.id GROUP BY d.id""")
def dedup_semantic(spark, sf_dir):
    return similar.dedup_semantic(_texts(spark, sf_dir))


@query(f"""WITH {WORDS_SQL}, q AS (SELECT DISTINCT id AS query, unnest(w[1:3]) AS term FROM t WHERE id % 100 = 0), s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM t),
p AS (SELECT id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM t) JOIN (SELECT DISTINCT term FROM q) USING (term) GROUP BY id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
c AS (SELECT query, id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * p.n / mean))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY query, id)
SELECT query, id, round(score, 4) AS score FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY c.score DESC, id) <= 10""")
def bm25_index(spark, sf_dir):
    """An index of all documents, written in two batches; asked for the first three words of every hundredth one (the stated query set)."""
    texts = _texts(spark, sf_dir)
    index = text_index.build(texts.where("id % 3 <> 0"))
    text_index.add(index, texts.where("id % 3 = 0"))
    asked = texts.where("id % 100 = 0").select(F.col("id").alias("query"), F.array_join(F.slice(tokens("text"), 1, 3), " ").alias("text"))
    return text_index.search(index, asked).withColumn("score", F.round("score", 4))


@query()
def kge_train(spark, sf_dir):
    """Vectors of all nodes that have an edge, of all relations; the five likeliest new ends for the relations of every hundredth node (the stated query set)."""
    edges = cut_lineage(from_star(spark, sf_dir).edges.select("src", "rel", "dst"))
    model = embeddings.train(edges)
    asked = edges.where("cast(substring_index(src, ':', -1) AS bigint) % 100 = 0").select("src", "rel").distinct()
    return embeddings.predict(model, asked, edges).withColumn("score", F.round("score", 4))


@query("""SELECT step, messages, bytes FROM (SELECT 'rows' AS step, count(*) AS messages, coalesce(sum(strlen('{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '","t":"' || o_orderpriority || '"}')), 0)::BIGINT AS bytes FROM orders WHERE o_orderkey % 1000 = 7)""")
def mesh_digest_delta(spark, sf_dir):
    """What a peer lacks of all orders, by digests: the rows that travel, in bytes."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("t"))
    return mesh_digest.delta(own.where("k % 1000 <> 7"), own, ["k", "s", "t"]).sent.where("step = 'rows'")


@query("""SELECT 'customer:' || c_custkey AS label, c_mktsegment AS segment, count(o_orderkey) AS edges, 0::BIGINT AS errors FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 5 <> 0 GROUP BY ALL
UNION ALL SELECT error, NULL, 0, count(*) FROM (SELECT 'label is missing' AS error FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'node not found' FROM orders WHERE o_custkey % 5 = 0) GROUP BY error""")
def src_batch(spark, sf_dir):
    """Customers and orders in one batch; every fifth customer has no name, so its orders have no end."""
    named = F.when(F.col("c_custkey") % 5 != 0, label("customer", "c_custkey"))
    people = table(spark, sf_dir, "customer").select(named.alias("label"), F.lit("customer").alias("type"), F.create_map(F.lit("segment"), "c_mktsegment").alias("props"))
    orders = table(spark, sf_dir, "orders").select(label("order", "o_orderkey").alias("label"), F.lit("order").alias("type"), F.create_map().cast("map<string,string>").alias("props"))
    edges = table(spark, sf_dir, "orders").select(label("order", "o_orderkey").alias("src"), F.lit("placed_by").alias("rel"), F.upper(label("customer", "o_custkey")).alias("dst"))
    g, errors = empty(spark).batch(people.unionByName(orders), edges)
    n = g.edges.groupBy(F.col("dst").alias("label")).agg(F.count(F.lit(1)).alias("edges"))
    good = g.nodes.where("type = 'customer'").join(n, "label", "left").select("label", F.element_at("props", F.lit("segment")).alias("segment"), F.coalesce("edges", F.lit(0)).alias("edges"), F.lit(0).cast("long").alias("errors"))
    return good.unionByName(errors.groupBy(F.col("error").alias("label")).agg(F.lit(None).cast("string").alias("segment"), F.lit(0).cast("long").alias("edges"), F.count(F.lit(1)).alias("errors")))


@query("""WITH RECURSIVE e AS (SELECT event_type AS rule, epoch_us(ts) AS t, min(event_id) AS id FROM events GROUP BY ALL),
f AS (SELECT rule, min(t) AS t FROM e GROUP BY rule UNION ALL SELECT f.rule, min(e.t) FROM f JOIN e ON e.rule = f.rule AND e.t >= f.t + 3600000000 GROUP BY f.rule)
SELECT rule, id AS event_id FROM f JOIN e USING (rule, t)""")
def st_cooldown(spark, sf_dir):
    """All events as a stream with keyed state; a last event far in the future lets the watermark pass the others."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", cooldown.PROVIDER)
    own = changes.timed(table(spark, sf_dir, "events")).select(F.col("event_type").alias("rule"), "ts", F.col("event_id").alias("id"))
    path = new_path(spark, "cooldown")
    own.write.parquet(f"{path}/in")
    last = own.agg((F.max("ts") + F.expr("INTERVAL 10 YEARS")).alias("ts")).select(F.lit("").alias("rule"), "ts", F.lit(-1).cast("long").alias("id"))
    last.write.mode("append").parquet(f"{path}/in")
    fired = cooldown.cooled_down_stream(spark.readStream.schema(own.schema).parquet(f"{path}/in"), 3600)
    fired.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").where("rule <> ''").select("rule", F.col("id").alias("event_id"))


@query("""SELECT version, event, key FROM (SELECT 1::BIGINT AS version, 'node_created' AS event, 'customer:' || c_custkey AS key FROM customer UNION ALL SELECT 1, 'node_created', 'nation:' || n_nationkey FROM nation
UNION ALL SELECT 1, 'edge_added', 'customer:' || c_custkey || '|located_in|nation:' || c_nationkey FROM customer
UNION ALL SELECT 2, 'node_created', 'order:' || o_orderkey FROM orders UNION ALL SELECT 2, 'edge_added', 'order:' || o_orderkey || '|placed_by|customer:' || o_custkey FROM orders)""")
def snk_events(spark, sf_dir):
    """Two batches in a stored graph, the second one written twice; its change events, followed by a stream into a sink of JSON lines."""
    g = from_star(spark, sf_dir)
    store, path = GraphStore(spark, new_path(spark, "graph-store")), new_path(spark, "followed-events")
    for k, kinds, rel in ((1, ("customer", "nation"), "located_in"), (2, ("order",), "placed_by"), (2, ("order",), "placed_by")):
        nodes = g.nodes.where(F.col("type").isin(*kinds))
        store.append(nodes, g.edges.where((F.col("rel") == rel) & ~F.col("src").startswith("supplier:")), "star", k)
        store.follow(f"{path}/out", f"{path}/check").awaitTermination()
    return spark.read.schema("version long, event string, key string").json(f"{path}/out")
