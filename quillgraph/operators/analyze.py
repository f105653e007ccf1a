"""Gaps, statistics, assessments, the mesh of peers, and action rules."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph, cut_lineage
from .traverse import components, degrees


def _gap(df: DataFrame, kind: str, subject: str, severity) -> DataFrame:
    return df.select(F.concat(F.lit(f"{kind}:"), F.col(subject)).alias("gap_id"), F.lit(kind).alias("kind"), F.col(subject).alias("subject"), F.round(severity, 4).alias("severity"))


def frontier_gaps(g: Graph, max_edges: int = 2) -> DataFrame:
    """Nodes with few edges: the fewer, the more severe."""
    return _gap(degrees(g).where(F.col("degree") <= max_edges), "frontier", "label", 1 - F.col("degree") / (max_edges + 1))


def hole_gaps(g: Graph, least_common: int = 2, asked: DataFrame | None = None) -> DataFrame:
    """Pairs with common neighbours and no edge; with ``asked`` (label), those that have one of these at least."""
    from .search import link_candidates

    pairs = link_candidates(g.live_edges(), asked, least_common).withColumn("pair", F.concat_ws("|", "a", "b"))
    return _gap(pairs, "hole", "pair", 1 - 1 / F.col("common"))


def temporal_gaps(edges: DataFrame, days: int = 90) -> DataFrame:
    """Entities with a silence of more than ``days`` days between the facts that start at them."""
    order = Window.partitionBy("src").orderBy("valid_from")
    pauses = edges.where("valid_from is not null").withColumn("_pause", F.datediff("valid_from", F.lag("valid_from").over(order)))
    longest = pauses.groupBy("src").agg(F.max("_pause").alias("pause")).where(F.col("pause") > days)
    return _gap(longest, "temporal", "src", 1 - days / F.col("pause"))


def desert_gaps(g: Graph, below: float = 0.5) -> DataFrame:
    """Types whose mean confidence is low."""
    means = g.live_nodes().groupBy("type").agg(F.avg("confidence").alias("mean")).where(F.col("mean") < below)
    return _gap(means, "desert", "type", 1 - F.col("mean") / below)


def rank_gaps(*gaps: DataFrame, min_severity: float = 0.3, limit: int = 10, dismissed: DataFrame | None = None) -> DataFrame:
    """The most severe of all gaps, less the dismissed ones (gap_id)."""
    every = gaps[0]
    for x in gaps[1:]:
        every = every.unionByName(x)
    every = every.join(dismissed.select("gap_id"), "gap_id", "left_anti") if dismissed is not None else every
    return every.where(F.col("severity") >= min_severity).orderBy(F.desc("severity"), "gap_id").limit(limit)


def best_gaps(g: Graph, first: DataFrame, *others: DataFrame, limit: int = 10) -> DataFrame:
    """``rank_gaps`` of ``others`` and of all holes of the graph.

    The severity that ``limit`` of the others and of the holes ``first`` (those of some nodes) reach bounds the common neighbours of a hole in the result, so the pairs of all
    nodes are asked for that many.
    """
    best = cut_lineage(rank_gaps(*others, limit=limit))
    reached = [r.severity for r in rank_gaps(best, first, limit=limit).collect()]
    least = 2
    if len(reached) == limit:
        # severities are rounded to four places
        least = max(2, math.ceil(1 / (1 - min(reached) + 5.1e-5)))
    return rank_gaps(best, hole_gaps(g, least), limit=limit)


def suggest_queries(gaps: DataFrame) -> DataFrame:
    """Adds a question for each gap."""
    words = {"frontier": "What is %s connected to?", "hole": "How are %s related?", "temporal": "What happened to %s in between?", "desert": "Which sources confirm entities of type %s?"}
    text = F.lit(None).cast("string")
    for kind, form in words.items():
        text = F.when(F.col("kind") == kind, F.format_string(form, "subject")).otherwise(text)
    return gaps.withColumn("question", text)


def asymmetric_gaps(domains: DataFrame) -> DataFrame:
    """(domain, type, n, mean): types that a domain has less than half the mean of; ``domains`` is (label, domain, type)."""
    counts = domains.groupBy("domain", "type").agg(F.count(F.lit(1)).alias("n"))
    grid = domains.select("type").distinct().withColumn("_k", F.lit(1)).join(domains.select("domain").distinct().withColumn("_k", F.lit(1)), "_k").drop("_k")
    full = grid.join(counts, ["domain", "type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("mean", F.avg("n").over(Window.partitionBy("type"))).where("n < mean / 2")


def scan(g: Graph, contradictions: DataFrame, weak: float = 0.3) -> DataFrame:
    """One row: gaps_found, orphan_nodes, weak_clusters, contradictions."""
    d = degrees(g).agg(F.expr("count_if(degree <= 2)").alias("gaps_found"), F.expr("count_if(degree = 0)").alias("orphan_nodes"), F.lit(1).alias("_k"))
    w = g.live_nodes().groupBy("type").agg(F.avg("confidence").alias("m")).agg(F.count_if(F.col("m") < weak).alias("weak_clusters"), F.lit(1).alias("_k"))
    c = contradictions.agg(F.count(F.lit(1)).alias("contradictions"), F.lit(1).alias("_k"))
    return d.join(w, "_k").join(c, "_k").drop("_k")


def stats(g: Graph) -> DataFrame:
    """One row: live nodes and edges."""
    n = g.live_nodes().agg(F.count(F.lit(1)).alias("nodes"), F.lit(1).alias("_k"))
    return n.join(g.live_edges().agg(F.count(F.lit(1)).alias("edges"), F.lit(1).alias("_k")), "_k").drop("_k")


def graph_stats(g: Graph) -> DataFrame:
    """(type, source, n, mean): counts and mean confidence by type and source, with totals (nulls)."""
    return g.live_nodes().cube("type", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("mean"))


def suspicious_clusters(g: Graph, rels: list[str], least: int = 3) -> DataFrame:
    """(component, members): groups that are held together by the given relations."""
    own = Graph(g.nodes, g.edges.where(F.col("rel").isin(rels)))
    return components(own).groupBy("component").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= least)


def report(g: Graph, label: str, depth: int = 1, limit: int = 10) -> DataFrame:
    """(part, item, value): what is known of an entity and around it: properties, edges, neighbours by degree, own gaps."""
    from .traverse import bfs, neighbours

    own = g.live_nodes().where(F.col("label_key") == label.lower())
    props = own.select(F.explode("props").alias("item", "value")).select(F.lit("property").alias("part"), "item", "value")
    edges = neighbours(g, label, "both").groupBy("rel").agg(F.count(F.lit(1)).alias("n")).select(F.lit("relation").alias("part"), F.col("rel").alias("item"), F.col("n").cast("string").alias("value"))
    near = bfs(g, label, depth).where("depth > 0").join(degrees(g), "label").orderBy(F.desc("degree"), "label").limit(limit)
    around = near.select(F.lit("neighbour").alias("part"), F.col("label").alias("item"), F.col("degree").cast("string").alias("value"))
    gaps = frontier_gaps(g).where(F.lower("subject") == label.lower()).select(F.lit("gap").alias("part"), F.col("kind").alias("item"), F.col("severity").cast("string").alias("value"))
    return props.unionByName(edges).unionByName(around).unionByName(gaps)


WEIGHT = 2.0


def _logit(p):
    return F.ln(p / (1 - p))


def evaluate(assessments: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, old, new, shift): probabilities after evidence (id, direction, weight, confidence), by sums of log-odds."""
    sign = F.when(F.col("direction") == "supports", 1.0).otherwise(-1.0)
    moved = evidence.groupBy("id").agg(F.sum(sign * F.coalesce("weight", F.lit(0.5)) * F.coalesce("confidence", F.lit(1.0)) * WEIGHT).alias("_s"))
    p = F.least(F.greatest(F.coalesce("probability", F.lit(0.5)), F.lit(0.001)), F.lit(0.999))
    out = assessments.join(moved, "id", "left").withColumn("old", p).withColumn("new", 1 / (1 + F.exp(-(_logit(F.col("old")) + F.coalesce("_s", F.lit(0.0))))))
    return out.select("id", F.round("old", 4).alias("old"), F.round("new", 4).alias("new"), F.round(F.col("new") - F.col("old"), 4).alias("shift"))


def history(assessments: DataFrame, evidence: DataFrame, order_by: tuple[str, ...] = ("ts", "n")) -> DataFrame:
    """(id, and ``order_by``, probability) after each piece of evidence, in the order of these columns."""
    sign = F.when(F.col("direction") == "supports", 1.0).otherwise(-1.0)
    order = Window.partitionBy("id").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    joined = evidence.join(assessments.select("id", F.coalesce("probability", F.lit(0.5)).alias("_p")), "id")
    total = _logit(F.col("_p")) + F.sum(sign * F.col("weight") * F.col("confidence") * WEIGHT).over(order)
    return joined.select("id", *order_by, F.round(1 / (1 + F.exp(-total)), 4).alias("probability"))


def stale(watches: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, changed): assessments (id, label, evaluated_at) whose watched entities changed (label, ts) since."""
    hit = watches.join(changes, "label").where("ts > evaluated_at")
    return hit.groupBy("id").agg(F.countDistinct("label").alias("changed"))


def classify(nodes: DataFrame, domains: DataFrame) -> DataFrame:
    """(label, domain): domains (domain, type) by type."""
    return nodes.join(domains, "type").select("label", "domain")


def profile(nodes: DataFrame, domains: DataFrame) -> DataFrame:
    """(domain, node_count, avg_confidence, freshness): what a peer tells of itself."""
    own = nodes.join(domains, "type")
    return own.groupBy("domain").agg(F.count(F.lit(1)).alias("node_count"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.max("updated_at").alias("freshness"))


def discover(profiles: DataFrame, topic: str, limit: int = 10) -> DataFrame:
    """Peers (peer, domain, node_count, avg_confidence) that know most of a topic."""
    own = profiles.where(F.lower("domain").contains(topic.lower()))
    return own.withColumn("relevance", F.round(F.col("avg_confidence") * F.ln(1 + F.col("node_count")), 4)).orderBy(F.desc("relevance"), "peer").limit(limit)


def blind_spots(profiles: DataFrame, least: int = 10) -> DataFrame:
    """(domain, total): topics that are thin on every peer."""
    return profiles.groupBy("domain").agg(F.max("node_count").alias("_m"), F.sum("node_count").alias("total")).where(F.col("_m") < least).select("domain", "total")


def federated(*answers: DataFrame, limit: int | None = None) -> DataFrame:
    """Peers' answers (label, peer, confidence) as one list: the surest of each label, surest first."""
    every = answers[0]
    for a in answers[1:]:
        every = every.unionByName(a)
    best = every.groupBy("label").agg(F.max_by(F.struct("peer", "confidence"), F.struct("confidence", "peer")).alias("_b")).select("label", "_b.*")
    return best.orderBy(F.desc("confidence"), "label").limit(limit) if limit else best


def merge_edits(edits: DataFrame) -> DataFrame:
    """(label, field, value, peer): of concurrent edits (label, field, value, confidence, trust, ts, peer) the one of greatest confidence times trust; then the latest, then by peer."""
    weight = F.struct((F.col("confidence") * F.col("trust")).alias("w"), "ts", "peer")
    return edits.groupBy("label", "field").agg(F.max_by(F.struct("value", "peer"), weight).alias("_b")).select("label", "field", "_b.*")


def delta(mine: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``theirs`` whose content isn't among ``mine``, by a digest of all ``keys``."""
    digest = F.sha2(F.to_json(F.struct(*keys)), 256)
    return theirs.withColumn("_d", digest).join(mine.select(digest.alias("_d")), "_d", "left_anti").drop("_d")


CONDITION = re.compile(r"""\s*(entity\.\w+|event\.\w+|'[^']*'|\d+(?:\.\d+)?|==|!=|>=|<=|>|<|&&|\|\||!|\(|\))\s*""")


def action_condition(text: str):
    """A condition like ``entity.type == 'x' && entity.confidence > 0.8`` as a Column; only fields, literals and these operators are let in."""
    parts, at = [], 0
    while at < len(text):
        m = CONDITION.match(text, at)
        if not m:
            raise ValueError(f"not allowed in a condition: {text[at:]!r}")
        parts.append({"==": "=", "!=": "<>", "&&": "AND", "||": "OR", "!": "NOT"}.get(m[1], m[1].split(".", 1)[1] if m[1].startswith(("entity.", "event.")) else m[1]))
        at = m.end()
    return F.expr(" ".join(parts))


def action_matches(events: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, and the event's columns): what would fire, and nothing else (a dry run). ``rules``: names and conditions."""
    hits = F.array(*[F.when(action_condition(c), F.lit(name)) for name, c in rules.items()])
    return events.withColumn("rule", F.explode(F.array_compact(hits)))


def cooled_down(matches: DataFrame, seconds: int, key: str = "rule") -> DataFrame:
    """(key, ts, id): the matches (key, ts, id) that fire, each at least ``seconds`` after the one of its key that fired before it.

    What fires depends on what fired last, so a key's times are read in order; they are streamed, with one time held for each
    key. Of matches at the same time the one of the least id can fire.
    """
    once = matches.groupBy(key, "ts").agg(F.min("id").alias("id"))
    ordered = once.repartition(key).sortWithinPartitions(key, "ts")

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            fired = []
            for i, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.int64()).to_pylist())):
                if last is None or last[0] != k or t - last[1] >= seconds * 1_000_000:
                    last = (k, t)
                    fired.append(i)
            yield batch.take(pa.array(fired, pa.int64()))

    return ordered.select(key, "ts", "id").mapInArrow(fire, ordered.select(key, "ts", "id").schema)


def dispatch(candidates: DataFrame) -> DataFrame:
    """Of answers (gap_id, tier, answer) the cheapest tier's: mesh before free before paid."""
    order = F.array_position(F.array(F.lit("mesh"), F.lit("free"), F.lit("paid")), F.col("tier"))
    return candidates.groupBy("gap_id").agg(F.min_by(F.struct("tier", "answer"), F.struct(order, "answer")).alias("_b")).select("gap_id", "_b.*")
