"""Edges and nodes in time. Validity is half-open: from ``valid_from`` up to, not including, ``valid_to``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def of_entity(edges: DataFrame, label: str) -> DataFrame:
    return edges.where((F.col("src") == label) | (F.col("dst") == label))


def during(edges: DataFrame, since: str, until: str) -> DataFrame:
    """Edges whose validity meets [since, until)."""
    a, b = F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")
    return edges.where((F.col("valid_from").isNull() | (F.col("valid_from") < b)) & (F.col("valid_to").isNull() | (F.col("valid_to") > a)))


def current(edges: DataFrame, now: str) -> DataFrame:
    return edges.where(F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(now).cast("timestamp")))


def timeline(edges: DataFrame, label: str, limit: int = 50) -> DataFrame:
    return of_entity(edges, label).orderBy(F.col("valid_from").asc_nulls_last(), "src", "rel", "dst").limit(limit)


def situation_at(edges: DataFrame, when: str) -> DataFrame:
    """The latest edge of each (src, rel) that holds at a time."""
    t = F.lit(when).cast("timestamp")
    own = edges.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
    return own.groupBy("src", "rel").agg(F.max_by(F.struct("dst", "confidence", "valid_from"), F.struct("valid_from", "dst")).alias("_l")).select("src", "rel", "_l.*")


def changes(g: Graph, since: str) -> DataFrame:
    """(label, change): nodes created or updated since a time."""
    t = F.lit(since).cast("timestamp")
    return g.live_nodes().where((F.col("created_at") >= t) | (F.col("updated_at") >= t)).select("label", F.when(F.col("created_at") >= t, "created").otherwise("updated").alias("change"))


def watch(g: Graph, label: str) -> Graph:
    marked = F.when(F.col("label_key") == label.lower(), F.map_concat(F.map_filter("props", lambda k, v: k != "_watched"), F.create_map(F.lit("_watched"), F.lit("true")))).otherwise(F.col("props"))
    return Graph(g.nodes.withColumn("props", marked), g.edges)
