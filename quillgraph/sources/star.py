"""The star schema's tables as a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import EDGE, NODE, Graph
from ..shared import fit_plans, fit_tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    fit_tasks(spark, [f"{sf_dir}/{name}.parquet"])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def from_star(spark: SparkSession, sf_dir: str) -> Graph:
    """Nodes ``kind:key`` with their texts as properties, and edges between them. Narrow scans but for the pairs of ``lineitem``."""
    kinds = [
        ("region", "r_regionkey", 1.0, ["r_name"], None),
        ("nation", "n_nationkey", 0.95, ["n_name"], None),
        ("customer", "c_custkey", 0.90, ["c_name", "c_mktsegment"], None),
        ("supplier", "s_suppkey", 0.90, ["s_name"], None),
        ("part", "p_partkey", 0.85, ["p_name", "p_brand", "p_type"], None),
        ("orders", "o_orderkey", 0.80, ["o_orderstatus", "o_orderpriority"], "o_orderdate"),
    ]
    tables = {name: table(spark, sf_dir, name) for name in [*(k[0] for k in kinds), "lineitem"]}
    fit_plans(spark, [f"{sf_dir}/{name}.parquet" for name in tables])
    nodes = None
    for name, key, confidence, props, date in kinds:
        kind = "order" if name == "orders" else name
        own = {"label": f"concat('{kind}:', {key})", "type": f"'{kind}'", "props": f"map({', '.join(f"'{p}', {p}" for p in props)})", "confidence": f"{confidence!r}D", "source": "'star'", "deleted": "false"}
        own |= {"label_key": own["label"]} | {c: date or "NULL" for c in ("created_at", "updated_at", "last_accessed")}
        rows = tables[name].selectExpr(*_columns(NODE, own))
        nodes = rows if nodes is None else nodes.unionByName(rows)
    # the pairs of lineitem are counted by their keys, before labels are made
    pairs = tables["lineitem"].groupBy("l_orderkey", "l_partkey").agg(F.max(F.expr("round(1 - l_discount, 2)")).alias("c"))
    supplies = tables["lineitem"].select("l_partkey", "l_suppkey").distinct()
    edges = None
    for df, src, rel, dst, confidence, date in [
        (tables["nation"], "nation:n_nationkey", "in_region", "region:n_regionkey", "0.95D", None),
        (tables["customer"], "customer:c_custkey", "located_in", "nation:c_nationkey", "0.90D", None),
        (tables["supplier"], "supplier:s_suppkey", "located_in", "nation:s_nationkey", "0.90D", None),
        (tables["orders"], "order:o_orderkey", "placed_by", "customer:o_custkey", "0.85D", "o_orderdate"),
        (pairs, "order:l_orderkey", "contains", "part:l_partkey", "c", None),
        (supplies, "part:l_partkey", "supplied_by", "supplier:l_suppkey", "0.80D", None),
    ]:
        ends = {c: f"concat('{e.split(':')[0]}:', {e.split(':')[1]})" for c, e in (("src", src), ("dst", dst))}
        rows = df.selectExpr(*_columns(EDGE, ends | {"rel": f"'{rel}'", "confidence": confidence, "valid_from": date or "NULL", "source": "'star'", "deleted": "false"}))
        edges = rows if edges is None else edges.unionByName(rows)
    return Graph(nodes, edges)


def _columns(schema: T.StructType, own: dict[str, str]) -> list[str]:
    """SQL of all columns of a schema; those without an expression are null."""
    return [f"cast({own.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema]
