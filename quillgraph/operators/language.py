"""Questions and statements in plain words, by patterns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .search import bm25, knn, searchable
from .traverse import neighbours, node_detail, shortest_path

#: (pattern, what it asks for); the first that fits is taken.
QUESTIONS = [
    (r"how (?:are|is) (.+?) and (.+?) (?:related|connected)", "path"),
    (r"what does (.+?) (?:connect|relate) to", "outgoing"),
    (r"what is (.+?) related to", "outgoing"),
    (r"what connects to (.+)", "incoming"),
    (r"what uses (.+)", "incoming:uses"),
    (r"who created (.+)", "outgoing:created_by"),
    (r"what are the types of (.+)", "incoming:is_a"),
    (r"(?:what|who) is (.+)", "lookup"),
    (r"find (?:things|entities) like (.+)", "similar"),
    (r"search for (.+)", "search"),
]
#: Relation of each verb in "X <verb> Y".
VERBS = {"is a": "is_a", "is an": "is_a", "causes": "causes", "depends on": "depends_on", "runs on": "runs_on", "uses": "uses", "was developed at": "developed_at"}


def ask(g: Graph, question: str, limit: int = 10, vectors: DataFrame | None = None) -> tuple[str, DataFrame]:
    """(interpretation, results). With ``vectors`` (id: a label, embedding) things are like each other by cosine; a thing without a vector is compared by its words."""
    text = question.strip().rstrip("?.! ")
    for pattern, what in QUESTIONS:
        m = re.fullmatch(pattern, text, re.I)
        if not m:
            continue
        kind, _, rel = what.partition(":")
        if kind == "path":
            return "path", shortest_path(g, m[1], m[2])
        if kind in ("outgoing", "incoming"):
            found = neighbours(g, m[1], "out" if kind == "outgoing" else "in")
            return kind, found.where(F.col("rel") == rel) if rel else found
        if kind == "lookup":
            return kind, node_detail(g, re.sub(r"^(?:an?|the) ", "", m[1], flags=re.I))
        if kind == "similar" and vectors is not None:
            own = vectors.where((F.lower("id") == m[1].lower()) & F.col("embedding").isNotNull()).first()
            if own is not None:
                live = vectors.join(g.live_nodes().select(F.col("label").alias("id")), "id", "left_semi").where(F.col("id") != own.id)
                return kind, knn(live, [float(x) for x in own.embedding], limit)
        return kind, bm25(searchable(g.live_nodes()), m[1], limit)
    return "search", bm25(searchable(g.live_nodes()), text, limit)


def tell(statements: DataFrame) -> DataFrame:
    """(subject, rel, object, key, value) of a column ``text``: "X uses Y" and the like, and "X has property K = V"; others are dropped."""
    prop = r"(?i)^\s*(.+?) has property (\S+)\s*=\s*(.+?)\s*\.?\s*$"
    verbs = "|".join(sorted(VERBS, key=len, reverse=True))
    fact = rf"(?i)^\s*(.+?) ({verbs}) (.+?)\s*\.?\s*$"
    table = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])
    is_prop = F.col("text").rlike(prop)
    part = lambda p, i: F.nullif(F.regexp_extract("text", p, i), F.lit(""))
    out = statements.where(F.col("text").rlike(prop) | F.col("text").rlike(fact)).select(
        F.when(is_prop, part(prop, 1)).otherwise(part(fact, 1)).alias("subject"),
        F.when(~is_prop, F.element_at(table, F.lower(F.regexp_extract("text", fact, 2)))).alias("rel"),
        F.when(~is_prop, part(fact, 3)).alias("object"),
        F.when(is_prop, part(prop, 2)).alias("key"),
        F.when(is_prop, part(prop, 3)).alias("value"),
    )
    return out
