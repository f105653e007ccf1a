"""The graph: immutable node and edge tables, and how lineage of loops is cut."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize

_TEXT, _REAL, _TIME, _FLAG = T.StringType(), T.DoubleType(), T.TimestampType(), T.BooleanType()
_NODE = {"label": _TEXT, "label_key": _TEXT, "type": _TEXT, "props": T.MapType(_TEXT, _TEXT), "confidence": _REAL, "source": _TEXT, "created_at": _TIME, "updated_at": _TIME, "last_accessed": _TIME, "deleted": _FLAG}
_EDGE = {"src": _TEXT, "rel": _TEXT, "dst": _TEXT, "confidence": _REAL, "valid_from": _TIME, "valid_to": _TIME, "source": _TEXT, "derived_by": _TEXT, "deleted": _FLAG}
NODE = T.StructType([T.StructField(n, t) for n, t in _NODE.items()])
EDGE = T.StructType([T.StructField(n, t) for n, t in _EDGE.items()])
DEFAULT_CONFIDENCE = 0.80
#: Fixed values: (initial, cap) of a fact's confidence by the class of its source.
SOURCE_CONFIDENCE = {
    "sensor": (0.95, 0.99),
    "api": (0.90, 0.95),
    "user": (0.80, 0.95),
    "derived": (0.50, 0.80),
    "llm": (0.30, 0.70),
    "correction": (0.90, 0.95),
}


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; those it lacks are null."""
    has = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in has else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def cut_lineage(df: DataFrame) -> DataFrame:
    """The table as written to the shared folder: small ones are known to be small, so joins with them send no edges."""
    return materialize(df, "round")


@dataclass(frozen=True)
class Graph:
    """Operators take a graph and give a table or another graph; nothing is changed in place."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def live_nodes(self) -> DataFrame:
        return self.nodes.where(~F.coalesce("deleted", F.lit(False)))

    def live_edges(self) -> DataFrame:
        return self.edges.where(~F.coalesce("deleted", F.lit(False)))

    def store(self, entities: DataFrame, order_by: list[str] | None = None) -> Graph:
        """Upsert by case-folded label: the first casing, type and confidence stay, properties merge (later ones win).

        Later means greater in the columns ``order_by`` of ``entities``; without them, in all of its columns, so the result never depends
        on how rows lie.
        """
        place = F.struct(*[F.col(c) for c in order_by]) if order_by else F.to_json(F.struct(*[F.col(c) for c in sorted(entities.columns)]))
        new = shaped(entities.withColumn("_place", place), T.StructType([*NODE, T.StructField("_place", entities.select(place.alias("p")).schema["p"].dataType)]))
        new = new.withColumns(
            {
                "label_key": F.lower("label"),
                "confidence": F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)),
                "props": F.coalesce("props", F.create_map().cast("map<string,string>")),
                "deleted": F.coalesce("deleted", F.lit(False)),
            }
        ).where("label is not null and label <> ''")
        none = F.lit(None).cast(new.schema["_place"].dataType).alias("place")
        both = self.nodes.withColumn("_age", F.struct(F.lit(0).alias("new"), none)).unionByName(new.withColumn("_age", F.struct(F.lit(1).alias("new"), F.col("_place").alias("place"))).drop("_place"))
        first = [F.expr(f"min_by({c}, _age)").alias(c) for c in NODE.names if c not in ("label_key", "props", "type")]
        merged = both.groupBy("label_key").agg(*first, F.expr("min_by(type, _age) filter (where type is not null)").alias("type"))
        # each property on its own first: a label with very many versions is no array of them
        pairs = both.select("label_key", "_age", F.explode("props").alias("_k", "_v")).groupBy("label_key", "_k").agg(F.max_by("_v", "_age").alias("_v"))
        props = pairs.groupBy("label_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("props"))
        none = F.create_map().cast("map<string,string>")
        return replace(self, nodes=merged.join(props, "label_key", "left").withColumn("props", F.coalesce("props", none)).select(*NODE.names))

    def relate(self, relations: DataFrame) -> tuple[Graph, DataFrame]:
        """Add edges (a multigraph: equal ones stay apart). Returns the graph and the rejected rows, of which an end is missing."""
        new = shaped(relations, EDGE).withColumns({"confidence": F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)), "deleted": F.coalesce("deleted", F.lit(False))})
        known = self.nodes.select("label_key", "label")
        a, b = known.select(F.col("label_key").alias("_a"), F.col("label").alias("_src")), known.select(F.col("label_key").alias("_b"), F.col("label").alias("_dst"))
        ends = new.join(a, F.lower("src") == F.col("_a"), "left").join(b, F.lower("dst") == F.col("_b"), "left")
        good = ends.where("_a is not null and _b is not null").withColumns({"src": F.col("_src"), "dst": F.col("_dst")}).select(*EDGE.names)
        bad = ends.where("_a is null or _b is null").select("src", "rel", "dst", F.lit("node not found").alias("error"))
        return replace(self, edges=self.edges.unionByName(good)), bad

    def batch(self, entities: DataFrame, relations: DataFrame, order_by: list[str] | None = None) -> tuple[Graph, DataFrame]:
        """Entities and relations in one call: the graph, and the rows that it didn't take (kind, key, error). Relations may name entities of the same batch."""
        grown, bad = self.store(entities, order_by).relate(relations)
        nameless = shaped(entities, NODE).where("label is null or label = ''")
        errors = nameless.select(F.lit("node").alias("kind"), F.to_json(F.struct("type", "props", "confidence")).alias("key"), F.lit("label is missing").alias("error"))
        return grown, errors.unionByName(bad.select(F.lit("edge").alias("kind"), F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("src", "rel", "dst"))).alias("key"), "error"))

    def soft_delete(self, label: str) -> Graph:
        """The node stays with confidence 0 and a mark."""
        own = F.col("label_key") == label.lower()
        return replace(self, nodes=self.nodes.withColumns({"confidence": F.when(own, 0.0).otherwise(F.col("confidence")), "deleted": own | F.coalesce("deleted", F.lit(False))}))

    def delete_edge(self, src: str, rel: str, dst: str) -> Graph:
        own = (F.lower("src") == src.lower()) & (F.col("rel") == rel) & (F.lower("dst") == dst.lower())
        return replace(self, edges=self.edges.withColumn("deleted", own | F.coalesce("deleted", F.lit(False))))

    def patch_nodes(self, where: str, **values) -> Graph:
        """Set columns (SQL texts) of the nodes that meet a condition."""
        return replace(self, nodes=self.nodes.withColumns({c: F.when(F.expr(where), F.expr(v)).otherwise(F.col(c)) for c, v in values.items()}))

    def patch_edges(self, where: str, **values) -> Graph:
        return replace(self, edges=self.edges.withColumns({c: F.when(F.expr(where), F.expr(v)).otherwise(F.col(c)) for c, v in values.items()}))


def empty(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE))


def from_rows(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> Graph:
    """A small graph of literal rows; labels are folded and edges checked as for any input."""
    g = empty(spark).store(shaped(spark.createDataFrame([{k: n.get(k) for k in ("label", "type", "props", "confidence", "source")} for n in nodes], "label string, type string, props map<string,string>, confidence double, source string"), NODE))
    rows = [{k: e.get(k) for k in ("src", "rel", "dst", "confidence")} for e in edges]
    return g.relate(spark.createDataFrame(rows, "src string, rel string, dst string, confidence double"))[0] if rows else g
