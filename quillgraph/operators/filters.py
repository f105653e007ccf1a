"""The search language's filters: a boolean text becomes one Column, so Catalyst can push its parts down.

Terms: ``type:x``, ``tier:x``, ``prop:k`` (present), ``prop:k=v`` (equal; v may hold spaces up to the next operator),
``confidence>0.8`` (and >=, <, <=), ``"a phrase"`` and bare words. NOT binds before AND, AND before OR; terms
that merely follow one another are joined by AND where one is a filter and by OR where both are words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

PART = re.compile(r'\(|\)|\b(?:AND|OR|NOT)\b|"[^"]*"|(?:type|tier):[^\s()]+|prop:[^\s()=]+(?:=(?:(?!\s+(?:AND|OR|NOT)\b|[()]).)*)?|confidence\s*(?:>=|<=|>|<)\s*[0-9.]+|[^\s()"]+')


def _term(part: str) -> tuple[Column, bool]:
    """A condition, and whether it is a bare word."""
    if part.startswith("type:"):
        return F.col("type") == part[5:], False
    if part.startswith("tier:"):
        return F.col("tier") == part[5:], False
    if part.startswith("prop:"):
        key, equals, value = part[5:].partition("=")
        own = F.element_at("props", F.lit(key))
        return (F.coalesce(own == value.strip(), F.lit(False)) if equals else F.map_contains_key("props", key)), False
    m = re.fullmatch(r"confidence\s*(>=|<=|>|<)\s*([0-9.]+)", part)
    if m:
        return F.expr(f"confidence {m[1]} {float(m[2])!r}"), False
    words = [w for w in re.split(r"[^\w]+", part.strip('"').lower()) if w]
    text = tokens(F.concat_ws(" ", "label", F.map_values("props")))
    if part.startswith('"'):
        return F.concat(F.lit(" "), F.array_join(text, " "), F.lit(" ")).contains(" " + " ".join(words) + " "), True
    return F.arrays_overlap(text, F.array(*[F.lit(w) for w in words] or [F.lit("")])), True


def condition(query: str) -> Column:
    """The Column of a query text; an empty one holds for all nodes."""
    parts = PART.findall(query)
    if not parts:
        return F.lit(True)

    def either() -> tuple[Column, bool]:
        left = both()
        while parts and parts[0] == "OR":
            parts.pop(0)
            left = (left[0] | both()[0], False)
        return left

    def both() -> tuple[Column, bool]:
        left = one()
        while parts and parts[0] not in ("OR", ")"):
            joined = parts[0] == "AND"
            if joined:
                parts.pop(0)
            right = one()
            left = (left[0] | right[0], True) if not joined and left[1] and right[1] else (left[0] & right[0], False)
        return left

    def one() -> tuple[Column, bool]:
        if not parts:
            raise ValueError(f"a term is missing in {query!r}")
        part = parts.pop(0)
        if part == "NOT":
            return ~one()[0], False
        if part == "(":
            inside = either()
            if not parts or parts.pop(0) != ")":
                raise ValueError(f"a bracket isn't closed in {query!r}")
            return inside[0], False
        if part in (")", "AND", "OR"):
            raise ValueError(f"unexpected {part} in {query!r}")
        return _term(part)

    out = either()[0]
    if parts:
        raise ValueError(f"unexpected {parts[0]} in {query!r}")
    return out


def search_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes that meet a query, surest first."""
    return nodes.where(condition(query)).orderBy(F.desc("confidence"), "label")


def hide(nodes: DataFrame, edges: DataFrame, types: list[str] = (), rels: list[str] = (), keep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Without these types and relations, and without nodes that lost all edges, but for ``keep``."""
    shown = nodes.where(~F.coalesce(F.col("type").isin(list(types)), F.lit(False)))
    labels = shown.select("label")
    left = edges.where(~F.col("rel").isin(list(rels)))
    for end in ("src", "dst"):
        left = left.join(labels.withColumnRenamed("label", end), end, "left_semi")
    ends = left.select(F.explode(F.array("src", "dst")).alias("label")).distinct()
    if keep is not None:
        ends = ends.unionByName(nodes.sparkSession.createDataFrame([(keep,)], "label string")).distinct()
    return shown.join(ends, "label", "left_semi"), left


#: Sensitivity labels, least first.
SENSITIVITY = ("public", "internal", "confidential", "restricted")


def cleared(df: DataFrame, clearance: str) -> DataFrame:
    """Rows whose ``sensitivity`` is at most ``clearance``; an unknown label counts as the highest."""
    level = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SENSITIVITY)), F.col("sensitivity")), F.lit(0)), F.lit(len(SENSITIVITY)))
    return df.where(level <= SENSITIVITY.index(clearance) + 1)
