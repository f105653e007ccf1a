"""Forward chaining: rule texts become joins, repeated to a fixed point.

    rule NAME
    when edge(A, "rel", B)
    when prop(B, "key", "value")
    when confidence(B, ">", 0.5)
    then edge(A, "other", B, min(e1, e2))

``eN`` is the confidence of the N-th edge condition; product(e1, e2) and numbers work too. ``then prop(V, "key", "value")`` sets
a property and ``then flag(V, "reason")`` marks a node. Variables need not differ from each other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import EDGE, Graph, cut_lineage, shaped

ATOM = re.compile(r'\s*(edge|prop|confidence|flag)\s*\((.*)\)\s*')
ARGUMENT = re.compile(r'\s*("[^"]*"|(?:min|product)\([^)]*\)|[^,"()]+)\s*(?:,|$)')


@dataclass
class Rule:
    name: str
    body: list[tuple] = field(default_factory=list)
    heads: list[tuple] = field(default_factory=list)


def parse(text: str) -> list[Rule]:
    """The rules of a text; a line that isn't one raises ValueError."""
    rules: list[Rule] = []
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        word, _, rest = line.partition(" ")
        m = ATOM.fullmatch(rest)
        if word == "rule" and rest.strip():
            rules.append(Rule(rest.strip()))
        elif word in ("when", "then") and m and rules:
            args = [a.strip().strip('"') for a in ARGUMENT.findall(m[2])]
            sizes = {"edge": (3, 4), "prop": (3, 3), "confidence": (3, 3), "flag": (2, 2)}[m[1]]
            if not sizes[0] <= len(args) <= sizes[1] or word == "when" and m[1] == "flag" or word == "then" and m[1] == "confidence":
                raise ValueError(f"invalid rule syntax in line {number}: {line}")
            (rules[-1].body if word == "when" else rules[-1].heads).append((m[1], *args))
        else:
            raise ValueError(f"invalid rule syntax in line {number}: {line}")
    for r in rules:
        bound = {v for kind, *a in r.body for v in ((a[0], a[2]) if kind == "edge" else (a[0],))}
        used = {v for kind, *a in r.heads for v in ((a[0], a[2]) if kind == "edge" else (a[0],))}
        if not r.body or not r.heads or not used <= bound:
            raise ValueError(f"rule {r.name} has no condition, no result, or a variable that no condition binds")
    return rules


def rule_table(spark: SparkSession, text: str) -> DataFrame:
    """(name, place, kind, arguments): the conditions and results of a text as a table, to be stored, listed, appended to or cleared."""
    rows = [(r.name, k, f"{word} {kind}", list(a)) for r in parse(text) for k, (word, (kind, *a)) in enumerate([*(("when", x) for x in r.body), *(("then", x) for x in r.heads)])]
    return spark.createDataFrame(rows, "name string, place int, kind string, arguments array<string>")


def rule_text(rules: DataFrame) -> str:
    """The text of a stored rule table, rules in order of their names; a rule book is small."""
    lines: list[str] = []
    for r in sorted(rules.collect(), key=lambda r: (r.name, r.place)):
        if not r.place:
            lines.append(f"rule {r.name}")
        word, kind = r.kind.split()
        quoted = {"edge": (1,), "prop": (1, 2), "confidence": (1,), "flag": (1,)}[kind]
        lines.append(f"{word} {kind}({', '.join(f'"{a}"' if i in quoted else a for i, a in enumerate(r.arguments))})")
    return "\n".join(lines)


def confidence_of(text: str | None, edges: int) -> Column:
    """min(e1, e2), product(e1, e2) or a number; without one the least of all edges' confidences."""
    names = [f"e{i + 1}" for i in range(edges)]
    m = re.fullmatch(r"(min|product)\((.*)\)", text or "")
    if m:
        names = [x.strip() for x in m[2].split(",")]
    elif text:
        return F.lit(float(text))
    cols = [F.col(n) for n in names]
    if m and m[1] == "product":
        out = cols[0]
        for c in cols[1:]:
            out = out * c
        return out
    return F.least(*cols) if len(cols) > 1 else cols[0] if cols else F.lit(1.0)


def _labels(kind: str, a: list[str], nodes: DataFrame) -> DataFrame:
    """(v_X) of the nodes that meet a condition on properties or confidence."""
    holds = F.element_at("props", F.lit(a[1])) == a[2] if kind == "prop" else F.expr(f"confidence {a[1]} {float(a[2])!r}")
    return nodes.where(holds).select(F.col("label").alias(f"v_{a[0]}"))


def matches(rule: Rule, sources: list[DataFrame], first: int = 0) -> DataFrame:
    """Bindings of a rule's variables (columns v_X) with the confidences e1, e2, ... of its edges, and for how many matches each stands (n).

    ``sources`` has a table for each condition: edges (src, rel, dst, confidence), or labels (v_X). The join begins with condition ``first`` and goes on
    to those that share a variable. A variable that one edge condition alone has, and no result, needs no binding of its own: such edges are counted for each
    binding of their other end first, with the greatest confidence among them (results keep the surest match). So three conditions on
    one hub join three rows, not the cube of its edges.
    """
    uses: dict[str, int] = {}
    for kind, *a in [*rule.body, *rule.heads]:
        for v in (a[0], a[2]) if kind == "edge" else (a[0],):
            uses[v] = uses.get(v, 0) + 1
    number = {i: k for k, i in enumerate((i for i, x in enumerate(rule.body) if x[0] == "edge"), 1)}
    out, bound, left = None, set(), list(range(len(rule.body)))
    while left:
        ready = [i for i in left if out is None and i == first or out is not None and {v for v in (rule.body[i][1], *(rule.body[i][3:] if i in number else ())) if v in bound}]
        if not ready:
            raise ValueError(f"rule {rule.name}: {rule.body[left[0]][0]}({', '.join(rule.body[left[0]][1:])}) shares no variable with the ones before it")
        i = min(ready, key=lambda i: (i in number, i))  # conditions on nodes leave fewer rows to join
        left.remove(i)
        kind, *a = rule.body[i]
        if i not in number:
            out = sources[i] if out is None else out.join(sources[i], f"v_{a[0]}", "left_semi")
            bound.add(a[0])
            continue
        e = f"e{number[i]}"
        own = sources[i].where(F.col("rel") == a[1]).select(F.col("src").alias(f"v_{a[0]}"), F.col("dst").alias("_d" if a[0] == a[2] else f"v_{a[2]}"), F.col("confidence").alias(e))
        own = own.where(F.col(f"v_{a[0]}") == F.col("_d")).drop("_d") if a[0] == a[2] else own
        free = [v for v in (a[2], a[0]) if uses[v] == 1 and a[0] != a[2]][:1]
        if free:
            kept = a[0] if free[0] == a[2] else a[2]
            own = own.groupBy(f"v_{kept}").agg(F.max(e).alias(e), F.count(F.lit(1)).alias(f"_n{number[i]}"))
        keys = [f"v_{v}" for v in dict.fromkeys((a[0], a[2])) if v in bound]
        out = own if out is None else out.join(own, keys)
        bound |= {a[0], a[2]} - set(free)
    columns = [*(f"v_{v}" for v in sorted(bound)), *(f"e{k}" for k in number.values())]
    counts = [c for c in out.columns if c.startswith("_n")]
    return out.select(*columns, F.expr(" * ".join(counts) or "1L").cast("long").alias("n"))


@dataclass
class _State:
    """Nodes and edges, what they were before the last round, and what it added."""

    nodes: DataFrame
    edges: DataFrame
    old_nodes: DataFrame | None = None
    old_edges: DataFrame | None = None
    new_edges: DataFrame | None = None
    changed: set[str] | None = None  #: relations that grew, and "" for properties; None: all is new


def new_matches(rule: Rule, state: _State) -> DataFrame | None:
    """Matches that hold something of the last round: for each condition that it changed, new rows there, old ones in the conditions before
    and all in those behind it, so that no match comes twice. None: nothing that the rule reads has changed."""
    reads = [a[1] if kind == "edge" else "" if kind == "prop" else None for kind, *a in rule.body]

    def whole(i: int, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        kind, *a = rule.body[i]
        return edges if kind == "edge" else _labels(kind, a, nodes)

    if state.changed is None:
        return matches(rule, [whole(i, state.nodes, state.edges) for i in range(len(reads))])
    out = None
    for i, name in enumerate(reads):
        if name not in state.changed:
            continue
        sources = [whole(j, state.old_nodes if j < i else state.nodes, state.old_edges if j < i else state.edges) for j in range(len(reads))]
        sources[i] = state.new_edges if name else sources[i].join(whole(i, state.old_nodes, state.old_edges), sources[i].columns, "left_anti")
        part = matches(rule, sources, i)
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Derived:
    graph: Graph
    edges: DataFrame  #: derived edges: src, rel, dst, confidence, derived_by, round
    flags: DataFrame  #: label, reason, rule_no
    fired: int  #: matches of all rules, summed over all rounds with the last one
    rounds: int


def derive(g: Graph, text: str, max_rounds: int = 10, derived_cap: float | None = None) -> Derived:
    """Apply all rules until nothing new comes, ``max_rounds`` at most; ``rounds`` equal to it says that they may have been cut.

    Edges, properties and flags that exist are skipped, so what an early round found stays; of equal results of one round the surest
    is kept. After the first round only matches that hold a new edge or property are joined (semi-naive); ``fired`` counts the matches of every
    round, for which the old ones' number is carried on.
    """
    spark, rules = g.spark, parse(text)
    nodes, edges = g.live_nodes().select("label", "props", "confidence"), g.live_edges().select("src", "rel", "dst", "confidence")
    # only relations of the rules take part; they are written once, however many rounds there are
    edges = cut_lineage(edges.where(F.col("rel").isin(*{a[1] for r in rules for kind, *a in [*r.body, *r.heads] if kind == "edge"}) if any(x[0] == "edge" for r in rules for x in r.body) else F.lit(False)))
    nodes = cut_lineage(nodes) if any(x[0] != "edge" for r in rules for x in [*r.body, *r.heads]) else nodes
    found = spark.createDataFrame([], "src string, rel string, dst string, confidence double, derived_by string, round int")
    flags = spark.createDataFrame([], "label string, reason string, rule_no int")
    fired = done = 0
    state = _State(nodes, edges)
    standing = [0] * len(rules)  # matches of each rule so far
    for done in range(1, max_rounds + 1):
        new_edges = new_flags = new_props = None
        for number, r in enumerate(rules):
            m = new_matches(r, state)
            if m is None:
                fired += standing[number]
                continue
            m = cut_lineage(m)
            standing[number] += m.agg(F.sum("n")).first()[0] or 0
            fired += standing[number]
            n = sum(kind == "edge" for kind, *_ in r.body)
            for kind, *a in r.heads:
                if kind == "edge":
                    c = confidence_of(a[3] if len(a) > 3 else None, n)
                    c = F.least(c, F.lit(derived_cap)) if derived_cap is not None else c
                    own = m.select(F.col(f"v_{a[0]}").alias("src"), F.lit(a[1]).alias("rel"), F.col(f"v_{a[2]}").alias("dst"), c.cast("double").alias("confidence"), F.lit(r.name).alias("derived_by"))
                    new_edges = own if new_edges is None else new_edges.unionByName(own)
                elif kind == "flag":
                    own = m.select(F.col(f"v_{a[0]}").alias("label"), F.lit(a[1]).alias("reason"), F.lit(number).alias("rule_no")).distinct()
                    new_flags = own if new_flags is None else new_flags.unionByName(own)
                else:
                    own = m.select(F.col(f"v_{a[0]}").alias("label"), F.lit(a[1]).alias("_k"), F.lit(a[2]).alias("_v")).distinct()
                    new_props = own if new_props is None else new_props.unionByName(own)
        grown, changed = False, set()
        state = _State(state.nodes, state.edges, state.nodes, state.edges)
        if new_edges is not None:
            best = new_edges.groupBy("src", "rel", "dst").agg(F.max_by(F.struct("confidence", "derived_by"), F.struct("confidence", "derived_by")).alias("_b"))
            fresh = cut_lineage(best.select("src", "rel", "dst", "_b.*").join(state.edges, ["src", "rel", "dst"], "left_anti").withColumn("round", F.lit(done)))
            changed = {x.rel for x in fresh.select("rel").distinct().collect()}
            if changed:
                grown = True
                found = found.unionByName(fresh)
                state.new_edges = fresh.select("src", "rel", "dst", "confidence")
                state.edges = state.edges.unionByName(state.new_edges)
        if new_flags is not None:
            fresh = cut_lineage(new_flags.join(flags, ["label", "reason", "rule_no"], "left_anti"))
            grown |= not fresh.isEmpty()
            flags = flags.unionByName(fresh)
        if new_props is not None:
            own = new_props.groupBy("label").agg(F.map_from_entries(F.collect_set(F.struct("_k", "_v"))).alias("_p"))
            joined = cut_lineage(state.nodes.join(own, "label", "left").withColumn("_new", F.coalesce(F.size(F.map_filter("_p", lambda k, v: ~F.coalesce(F.map_contains_key("props", k), F.lit(False)))), F.lit(0)) > 0))
            if not joined.where("_new").isEmpty():
                grown = True
                changed |= {""}
            state.nodes = joined.withColumn("props", F.when(F.col("_new"), F.map_concat(F.map_filter("_p", lambda k, v: ~F.map_contains_key("props", k)), "props")).otherwise(F.col("props"))).drop("_p", "_new")
        state.changed = changed
        if not grown:
            break
    last = flags.groupBy("label").agg(F.max_by("reason", "rule_no").alias("_flag"))
    kept = g.nodes.drop("props").join(state.nodes.select("label", "props"), "label", "left").join(last, "label", "left")
    flagged = F.when(F.col("_flag").isNotNull(), F.map_concat(F.map_filter("props", lambda k, v: k != "_flag"), F.create_map(F.lit("_flag"), "_flag"))).otherwise(F.col("props"))
    out = Graph(kept.withColumn("props", flagged).drop("_flag").select(*g.nodes.columns), g.edges.unionByName(shaped(found.withColumns({"source": F.lit("derived"), "deleted": F.lit(False)}), EDGE)))
    return Derived(out, found, flags, fired, done)
