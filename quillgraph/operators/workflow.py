"""Workflows over tables: staged ingest, assessments, sources, documents, schedules, action effects and audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import DEFAULT_CONFIDENCE, Graph, cut_lineage
from . import ingest as steps
from .components import connected_components
from .filters import cleared
from .learn import contradiction_witnesses
from .similar import keep_first

#: Stages of an ingest, in order; each can be skipped, though nothing is found without ``extract``.
STAGES = ("dedup", "coref", "extract", "resolve", "relations", "conflicts", "store")


def analyze_text(docs: DataFrame, known: DataFrame, config: steps.IngestConfig = steps.IngestConfig()) -> tuple[DataFrame, DataFrame]:
    """(mentions, relations) of texts (doc, text), and nothing is stored: (doc, label, type, confidence) and (doc, src, rel, dst, confidence).

    Names come from ``known`` (label, type) first, then from capitalised words.
    """
    named = steps.gazetteer_entities(docs, known).select("doc", "label", "type", F.lit(0.80).alias("confidence"))
    spare = steps.capital_entities(docs)
    spare = spare.join(known.select(F.lower("label").alias("_l")).distinct(), F.lower("label") == F.col("_l"), "left_anti")
    spare = spare.select("doc", "label", F.lit("concept").alias("type"), F.lit(0.50).alias("confidence"))
    mentions = named.unionByName(spare).where(F.col("confidence") >= config.min_entity_confidence)
    relations = steps.pattern_relations(steps.sentences(docs), config.templates).withColumn("confidence", F.lit(0.60))
    return mentions, relations


def ingest_texts(g: Graph, docs: DataFrame, known: DataFrame, singular: list[str] = (), config: steps.IngestConfig = steps.IngestConfig()) -> tuple[Graph, DataFrame]:
    """The graph after texts (doc, text), and (stage, n): what each stage that wasn't skipped found.

    dedup: the texts that are left when copies and near-copies are gone; coref: pronouns that got their names; extract: mentions; resolve: labels that another one now stands for;
    relations: by patterns and templates, whose ends become nodes; conflicts: values of a relation in ``singular`` that hold while another one does;
    store: nodes and edges that the graph didn't have. A second run of the same texts adds nothing.
    """
    counts: list[DataFrame] = []

    def told(stage: str, df: DataFrame) -> None:
        counts.append(df.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("n")))

    docs = docs.select("doc", "text")
    if "dedup" not in config.skip:
        differ = docs.join(steps.drop_copies(docs).select("doc"), "doc", "left_semi")
        docs = cut_lineage(keep_first(differ.withColumnRenamed("doc", "id"), config.dedup_threshold).withColumnRenamed("id", "doc"))
        told("dedup", docs)
    if config.enable_coref and "coref" not in config.skip:
        docs = cut_lineage(steps.name_pronouns(docs, known))
        counts.append(docs.agg(F.lit("coref").alias("stage"), F.coalesce(F.sum("pronouns"), F.lit(0)).alias("n")))
        docs = docs.drop("pronouns")
    mentions, relations = analyze_text(docs, known, config)
    mentions = cut_lineage(mentions if "extract" not in config.skip else mentions.limit(0))
    if "extract" not in config.skip:
        told("extract", mentions)
    relations = cut_lineage(relations if "relations" not in config.skip else relations.limit(0))
    if "resolve" not in config.skip:
        labels = mentions.select("label").unionByName(relations.select(F.explode(F.array("src", "dst")).alias("label"))).distinct()
        names = cut_lineage(canonical_names(g, labels, config.dedup_threshold))
        mentions = _renamed(mentions, names, "label")
        relations = _renamed(_renamed(relations, names, "src"), names, "dst")
        told("resolve", names)
    told("relations", relations)
    edges = cut_lineage(relations.groupBy("src", "rel", "dst").agg(F.max("confidence").alias("confidence")))
    if "conflicts" not in config.skip:
        none = F.lit(None).cast("timestamp")
        both = edges.select("src", "rel", "dst").unionByName(g.live_edges().select("src", "rel", "dst"))
        told("conflicts", contradiction_witnesses(both.withColumns({"valid_from": none, "valid_to": none}), list(singular)))
    if "store" in config.skip:
        out = g
    else:
        nodes = mentions.groupBy("label").agg(F.max_by("type", F.struct("confidence", "type")).alias("type"), F.max("confidence").alias("confidence"))
        ends = edges.select(F.explode(F.array("src", "dst")).alias("label")).distinct().select("label", F.lit("concept").alias("type"), F.lit(0.50).alias("confidence"))
        grown = g.store(nodes.unionByName(ends.join(nodes.select(F.lower("label").alias("_l")), F.lower("label") == F.col("_l"), "left_anti")))
        grown = Graph(cut_lineage(grown.nodes), grown.edges)
        held = g.live_edges().select(F.lower("src").alias("_s"), F.col("rel").alias("_r"), F.lower("dst").alias("_d")).distinct()
        fresh = cut_lineage(edges.join(held, (F.lower("src") == F.col("_s")) & (F.col("rel") == F.col("_r")) & (F.lower("dst") == F.col("_d")), "left_anti"))
        out, _ = grown.relate(fresh)
        told("store", grown.nodes.join(g.nodes.select("label_key"), "label_key", "left_anti").select("label").unionByName(fresh.select(F.col("src").alias("label"))))
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return out, every


def canonical_names(g: Graph, labels: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(label, name) of the labels that another one stands for: of each class of labels that mean the same, the least that the graph has, else the least."""
    roots = connected_components(steps.resolve_entities(labels, threshold).select("a", "b"))
    stored = g.live_nodes().select("label_key", F.col("label").alias("_stored"))
    classed = roots.join(stored, F.lower("node") == F.col("label_key"), "left")
    names = classed.groupBy("root").agg(F.coalesce(F.min("_stored"), F.first("root")).alias("name"))
    return classed.join(names, "root").select(F.col("node").alias("label"), "name").where("label <> name")


def _renamed(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    own = names.select(F.col("label").alias(column), F.col("name").alias("_name"))
    return df.join(own, column, "left").withColumn(column, F.coalesce("_name", column)).select(*df.columns).distinct()


def commit_review(g: Graph, staged: DataFrame, decisions: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph with the staged relations (idx, src, rel, dst, confidence) that decisions (idx, action, new_rel) accept or modify, and those that stay staged.

    Ends that aren't nodes yet become concepts; an edge that the graph has is confirmed with the greater confidence, not doubled.
    """
    taken = cut_lineage(steps.review(staged, decisions).groupBy("src", "rel", "dst").agg(F.max("confidence").alias("confidence")))
    ends = taken.select(F.explode(F.array("src", "dst")).alias("label")).distinct().select("label", F.lit("concept").alias("type"), F.lit(0.50).alias("confidence"))
    grown = g.store(ends)
    grown = Graph(cut_lineage(grown.nodes), g.edges)
    key = [F.lower("src"), F.col("rel"), F.lower("dst")]
    named = taken.select(*(c.alias(n) for c, n in zip(key, ("_s", "_r", "_d"))), F.col("confidence").alias("_sure")).groupBy("_s", "_r", "_d").agg(F.max("_sure").alias("_sure"))
    own = (F.lower("src") == F.col("_s")) & (F.col("rel") == F.col("_r")) & (F.lower("dst") == F.col("_d"))
    live = ~F.coalesce("deleted", F.lit(False))
    kept = g.edges.join(named, own, "left").withColumn("confidence", F.when(F.col("_sure").isNotNull() & live, F.greatest("confidence", "_sure")).otherwise(F.col("confidence"))).select(*g.edges.columns)
    held = g.live_edges().select(*(c.alias(n) for c, n in zip(key, ("_s", "_r", "_d")))).distinct()
    out, _ = Graph(grown.nodes, cut_lineage(kept)).relate(taken.join(held, own, "left_anti"))
    return out, staged.join(decisions.select("idx"), "idx", "left_anti")


def coreference(mentions: DataFrame) -> DataFrame:
    """Mentions (doc, place, label, type) whose missing labels (pronouns) are the last label of the same type before them in the document."""
    before = Window.partitionBy("doc", "type").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return mentions.withColumn("label", F.coalesce("label", F.last("label", ignorenulls=True).over(before)))


def close_names(new: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """(name, like, distance): new relation names that are no known one but nearly so; both tables are small vocabularies (column rel)."""
    a, b = new.select(F.col("rel").alias("name")).distinct(), known.select(F.col("rel").alias("like")).distinct()
    keyed = [df.withColumn("_n", F.explode(F.sequence(F.length(c) - d, F.length(c) + d))) for df, c, d in ((a, "name", most), (b, "like", 0))]
    near = keyed[0].join(keyed[1], "_n").withColumn("distance", F.levenshtein("name", "like"))
    fresh = near.join(b.select(F.col("like").alias("name")), "name", "left_anti")
    return fresh.where(F.col("distance").between(1, most)).select("name", "like", "distance")


def seed_progress(staged: DataFrame, decisions: DataFrame) -> DataFrame:
    """(step, total, accepted, modified, rejected, pending) of a seed session: staged items (idx, step) and decisions (idx, action)."""
    joined = staged.join(decisions.select("idx", "action"), "idx", "left")
    kinds = [F.count_if(F.col("action") == a).alias(a) for a in ("accepted", "modified", "rejected")]
    return joined.groupBy("step").agg(F.count(F.lit(1)).alias("total"), *kinds, F.count_if(F.col("action").isNull()).alias("pending"))


def poll_interval(queries: DataFrame, least: int = 60, most: int = 3600) -> DataFrame:
    """(source, seconds): the more new items a source's queries (source, fresh, failed) bring, the oftener it is asked; failures slow it down."""
    own = queries.groupBy("source").agg(F.avg(F.col("fresh").cast("double")).alias("f"), F.avg(F.col("failed").cast("double")).alias("e"))
    wait = most - (most - least) * F.col("f") * (1 - F.col("e"))
    return own.select("source", F.round(wait).cast("long").alias("seconds"))


def source_stats(queries: DataFrame, day: str, budget: int, most_errors: float = 0.5) -> DataFrame:
    """(source, healthy, error_rate, today, budget_left) of queries (source, ts, failed)."""
    today = F.count_if(F.col("ts").cast("date") == F.lit(day).cast("date"))
    own = queries.groupBy("source").agg(F.round(F.avg(F.col("failed").cast("double")), 4).alias("error_rate"), today.alias("today"))
    return own.select("source", (F.col("error_rate") < most_errors).alias("healthy"), "error_rate", "today", F.greatest(F.lit(budget) - F.col("today"), F.lit(0)).alias("budget_left"))


def put(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with rows added or replaced by key: how sources, assessments and documents are created."""
    return table.join(rows.select(key), key, "left_anti").select(*rows.columns).unionByName(rows)


def patch(table: DataFrame, where: str | Column, **values: str) -> DataFrame:
    """``table`` with columns set (SQL texts) where a condition holds."""
    hit = F.expr(where) if isinstance(where, str) else where
    return table.withColumns({c: F.when(hit, F.expr(v)).otherwise(F.col(c)) for c, v in values.items()})


def drop(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """``table`` without the rows of ``keys``."""
    return table.join(keys.select(key), key, "left_anti")


def new_assessments(rows: DataFrame) -> DataFrame:
    """Assessments (id, title, ...) with the defaults: probability .5, status active."""
    has = set(rows.columns)
    probability = F.coalesce("probability", F.lit(0.5)) if "probability" in has else F.lit(0.5)
    status = F.coalesce("status", F.lit("active")) if "status" in has else F.lit("active")
    return rows.withColumns({"probability": probability, "status": status})


def passage(docs: DataFrame, start: int, length: int) -> DataFrame:
    """(doc, passage): ``length`` code points of each text from ``start`` (0 is the first)."""
    return docs.select("doc", F.substring("text", start + 1, length).alias("passage"))


def due(tasks: DataFrame, now: str) -> DataFrame:
    """(id, late): tasks (id, last, every seconds) that should have run by ``now``, and by how many seconds."""
    late = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp")) - F.col("every")
    return tasks.select("id", late.alias("late")).where("late >= 0")


def entity_timeline(edges: DataFrame, label: str, since: str, until: str) -> DataFrame:
    """(ts, line): what happened to an entity in [since, until), a sentence for each edge."""
    a, b = F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")
    own = edges.where(((F.col("src") == label) | (F.col("dst") == label)) & (F.col("valid_from") >= a) & (F.col("valid_from") < b))
    text = F.concat_ws(" ", F.concat(F.date_format("valid_from", "yyyy-MM-dd"), F.lit(":")), "src", F.regexp_replace("rel", "_", " "), "dst")
    return own.select(F.col("valid_from").alias("ts"), text.alias("line"))


def topic_map(g: Graph) -> DataFrame:
    """(type_a, rel, type_b, n): which types of nodes hang together, and by what."""
    kinds = g.live_nodes().select("label", "type")
    ends = [kinds.toDF(end, f"type_{side}") for end, side in (("src", "a"), ("dst", "b"))]
    return g.live_edges().join(ends[0], "src").join(ends[1], "dst").groupBy("type_a", "rel", "type_b").agg(F.count(F.lit(1)).alias("n"))


def briefing(g: Graph, since: str, limit: int = 10) -> DataFrame:
    """(part, item, value): sizes, what changed since a time by type, and the entities with most edges."""
    from .traverse import most_connected, node_types, rel_types

    t = F.lit(since).cast("timestamp")
    own = [df.select(F.lit(part).alias("part"), F.col(c).alias("item"), F.col("n").cast("string").alias("value")) for part, c, df in (("type", "type", node_types(g)), ("relation", "rel", rel_types(g)))]
    fresh = g.live_nodes().where((F.col("created_at") >= t) | (F.col("updated_at") >= t)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    own.append(fresh.select(F.lit("changed").alias("part"), F.col("type").alias("item"), F.col("n").cast("string").alias("value")))
    own.append(most_connected(g, limit).select(F.lit("connected").alias("part"), F.col("label").alias("item"), F.col("degree").cast("string").alias("value")))
    out = own[0]
    for x in own[1:]:
        out = out.unionByName(x)
    return out


def reindex(nodes: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(label, embedding): all texts of nodes embedded anew; ``embed`` is a column expression or a pandas UDF of a model."""
    return nodes.select("label", embed(F.concat_ws(" ", "label", F.map_values("props"))).alias("embedding"))


def letter_shares(text: Column, letters: str = "aeinorst") -> Column:
    """A small embedding that needs no model: the share of each of some letters."""
    low = F.lower(text)
    counts = [(F.length(low) - F.length(F.translate(low, x, ""))) / F.greatest(F.length(low), F.lit(1)) for x in letters]
    return F.array(*[c.cast("float") for c in counts])


#: What a rule may do; ``value`` is a number for the first and third, a relation for the second.
EFFECTS = ("confidence_cascade", "edge_create", "set_confidence", "notify")


def planned_effects(firings: DataFrame, effects: DataFrame, budget: int) -> DataFrame:
    """(rule, id, ts, effect, target, value): effects (rule, effect, target, value) of firings (rule, id, ts), the first ``budget`` of each rule in order of time.

    What lies beyond the budget isn't done in this chain; it comes back with the next one.
    """
    place = F.row_number().over(Window.partitionBy("rule").orderBy("ts", "id", "effect", "target"))
    return firings.join(effects, "rule").withColumn("_n", place).where(F.col("_n") <= budget).drop("_n")


def apply_effects(g: Graph, planned: DataFrame, rules: Callable[[Graph, int], DataFrame] | None = None, max_depth: int = 3) -> tuple[Graph, int]:
    """The graph after effects whose ``id`` is a node's label, and how deep the chain went.

    confidence_cascade adds value to the node and half of it to those behind its outgoing edges; set_confidence sets it; edge_create adds an edge to
    ``target``; notify changes nothing. ``rules`` gives the effects that the changed graph sets off, up to ``max_depth`` rounds.
    """
    depth = 0
    while depth < max_depth and not planned.isEmpty():
        depth += 1
        moved = planned.where("effect = 'confidence_cascade'").select(F.col("id").alias("label"), F.col("value").try_cast("double").alias("v"))
        behind = moved.join(g.live_edges().select(F.col("src").alias("label"), "dst"), "label").select(F.col("dst").alias("label"), (F.col("v") / 2).alias("v"))
        sums = moved.unionByName(behind).groupBy("label").agg(F.sum("v").alias("_v"))
        fixed = planned.where("effect = 'set_confidence'").groupBy(F.col("id").alias("label")).agg(F.max_by(F.col("value").try_cast("double"), "ts").alias("_f"))
        nodes = g.nodes.join(sums, "label", "left").join(fixed, "label", "left")
        level = F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.coalesce("_f", "confidence") + F.coalesce("_v", F.lit(0.0))))
        nodes = nodes.withColumn("confidence", F.when(F.col("_v").isNull() & F.col("_f").isNull(), F.col("confidence")).otherwise(level)).select(*g.nodes.columns)
        made = planned.where("effect = 'edge_create'").select(F.col("id").alias("src"), F.col("value").alias("rel"), F.col("target").alias("dst"), F.lit(DEFAULT_CONFIDENCE).alias("confidence")).distinct()
        g, _ = Graph(cut_lineage(nodes), g.edges).relate(made)
        if rules is None:
            break
        planned = rules(g, depth)
    return g, depth


def audit(log: DataFrame, sent: DataFrame, peer: str, ts: str) -> DataFrame:
    """The log (peer, ts, rows, digest) with a line for a sync: how many rows went to a peer, and a digest that doesn't depend on their order."""
    line = sent.agg(F.lit(peer).alias("peer"), F.lit(ts).cast("timestamp").alias("ts"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*sent.columns)), F.lit(0).cast("long")).alias("digest"))
    return log.unionByName(line)


def federated_answers(answers: DataFrame, clearance: str, max_hops: int) -> DataFrame:
    """(label, peer, confidence): of peers' answers (label, peer, confidence, sensitivity, hops) the surest of each label that may be seen from where we are."""
    from .analyze import federated

    seen = cleared(answers, clearance).where(F.col("hops") <= max_hops)
    return federated(seen.select("label", "peer", "confidence"))
