"""Golden values of small graphs, properties of operators, and agreement of streams with tables."""

from __future__ import annotations

import json
import random

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillgraph import graph, shared
from quillgraph.operators import analyze, filters, ingest, language, learn, search, traverse, workflow
from quillgraph.plans.rules import derive, parse, rule_table, rule_text
from quillgraph.sources import files
from quillgraph.sources.star import from_star, table
from quillgraph.streaming import changes

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def chain(spark):
    nodes = [{"label": x, "type": "service", "confidence": c} for x, c in (("Web", 0.9), ("Api", 0.85), ("Db", 0.95), ("Disk", 0.8))]
    edges = [{"src": a, "rel": "depends_on", "dst": b, "confidence": c} for a, b, c in (("web", "api", 0.9), ("api", "db", 0.8), ("db", "disk", 0.95))]
    return graph.from_rows(spark, nodes, edges)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["bfs_in", "get_node", "compare", "filter_dsl", "rule_flag", "correct", "situation_at", "bm25", "knn_exact", "hybrid_rrf", "gaps_frontier", "mesh_merge", "events_window", "assess_evaluate", "kge_predict", "shortest_path", "all_paths", "action_cooldown", "resolve", "src_ndjson", "src_csv_nodes", "src_store", "src_relate", "edit_deletes", "f_tier", "f_acl", "search_prefiltered", "tell_all", "rules_fired", "rule_tie_break", "resolve_conflict", "ingest_staged", "gap_asymmetric", "action_effects", "action_apply", "assess_crud", "mesh_query_cleared"])
def test_matches_sql(spark, oracle, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = oracle.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_searches_ask_every_hundredth_vector(spark, oracle):
    ids = {r[0] for r in oracle.execute("SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0").fetchall()}
    got = {n: {(r["query"], r["id"]) for r in entry.queries()[n](spark, SMALL).collect()} for n in ("knn_exact_block", "knn_int8", "ann")}
    want = {r[:2] for r in oracle.execute(entry.oracle_sql()["knn_exact_block"]).fetchall()}
    assert got["knn_exact_block"] == want and {q for q, _ in want} == ids and len(want) == 10 * len(ids)
    for name in ("knn_int8", "ann"):
        assert len(got[name] & want) >= 0.9 * len(want)
    fused = {tuple(r) for r in entry.queries()["hybrid_rrf_block"](spark, SMALL).collect()}
    assert fused == set(oracle.execute(entry.oracle_sql()["hybrid_rrf_block"]).fetchall()) and {r[0] for r in fused} == ids


def test_history_holds_all_evidence(spark, oracle):
    got = [r.id for r in entry.queries()["assess_history"](spark, SMALL).select("id").collect()]
    want = [r[0] for r in oracle.execute("SELECT l_suppkey FROM lineitem").fetchall()]
    assert sorted(got) == sorted(want)


def holes(edges, asked):
    """{(a, b): common} of unlinked pairs that have one of ``asked``."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    pairs = {(min(a, b), max(a, b)) for a in asked for hub in near.get(a, ()) for b in near[hub] if a != b}
    return {(a, b): n for a, b in pairs if b not in near[a] and (n := len(near[a] & near[b])) >= 2}


def test_holes_match_brute_force(spark):
    edges = [(f"x{i}", f"hub{j}") for j in range(2) for i in range(1100)] + [("x0", "x1"), ("x1", "x0"), ("x5", "y"), ("x6", "y")]
    rows = [{"src": a, "rel": "r", "dst": b, "confidence": 0.9} for a, b in edges]
    g = graph.from_rows(spark, [{"label": x, "type": "t", "confidence": 0.9} for x in sorted({x for e in edges for x in e})], rows)
    asked = ["x0", "x5", "hub1"]
    found = analyze.hole_gaps(g, 2, spark.createDataFrame([(x,) for x in asked], "label string")).collect()
    got = {tuple(r.subject.split("|")): r.severity for r in found}
    want = holes(edges, asked)
    assert len(found) == len(got) and got == {k: round(1 - 1 / n, 4) for k, n in want.items()} and got["x5", "x6"] == 0.6667


def test_holes_of_the_star_count_all_edges(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(analyze, "hole_gaps", lambda *a, f=analyze.hole_gaps, **b: seen.append(f(*a, **b)) or seen[0])
    entry.queries()["gaps"](spark, SMALL)
    edges = {(r.src, r.dst) for r in from_star(spark, SMALL).edges.select("src", "dst").collect()}
    want = holes(edges, {x for e in edges for x in e if int(x.split(":")[1]) % 100 == 0})
    assert {r.subject for r in seen[0].collect()} == {"|".join(k) for k in want} and want


def test_gaps_hold_the_best_holes_of_all_nodes(spark, monkeypatch):
    """No node of these pairs is one of every hundredth."""
    monkeypatch.setattr(search, "HEAVY", 2)
    edges = [(f"part:{i}", f"supplier:{j}") for k, j in enumerate((101, 102, 103)) for i in range(1, 60 - 5 * k)] + [(f"part:{i}", f"supplier:{100 * (i % 3)}") for i in range(1, 12)] + [("supplier:101", "supplier:102")]
    g = graph.from_rows(spark, [{"label": x, "confidence": 0.9} for x in sorted({x for e in edges for x in e})], [{"src": a, "rel": "r", "dst": b} for a, b in edges])
    want = sorted(((round(1 - 1 / n, 4), f"hole:{a}|{b}") for (a, b), n in holes(edges, {x for e in edges for x in e}).items()), key=lambda x: (-x[0], x[1]))
    for limit in (2, 5):
        got = analyze.best_gaps(g, analyze.hole_gaps(g, 2, g.nodes.where("label like '%00'").select("label")), analyze.desert_gaps(g, 0.5), limit=limit).collect()
        assert [(r.severity, r.gap_id) for r in got] == want[:limit]
    assert want[0] == (0.9796, "hole:supplier:101|supplier:103")


def test_store_folds_labels_and_keeps_confidence(spark):
    g = chain(spark)
    more = spark.createDataFrame([("WEB", "other", {"k": "1"}, 0.1), ("web", None, {"k": "2", "j": "3"}, 0.2), ("", None, {}, 0.5)], "label string, type string, props map<string,string>, confidence double")
    row = g.store(more).nodes.where("label_key = 'web'").collect()
    assert len(row) == 1 and row[0].label == "Web" and row[0].confidence == 0.9 and row[0].type == "service"
    assert row[0].props == {"k": "2", "j": "3"}
    rows = more.where("label <> ''").withColumn("at", F.when(F.col("label") == "WEB", 9).otherwise(5))
    assert g.store(rows, ["at"]).nodes.where("label_key = 'web'").first().props == {"k": "1", "j": "3"}


def test_relate_needs_both_ends_and_keeps_copies(spark):
    g, bad = chain(spark).relate(spark.createDataFrame([("Web", "x", "nobody"), ("web", "depends_on", "API")], "src string, rel string, dst string"))
    assert [r.dst for r in bad.collect()] == ["nobody"]
    assert g.edges.count() == 4 and g.edges.where("src = 'Web' and dst = 'Api'").count() == 2


def test_closure_reaches_its_fixed_point_and_counts_all_matches(spark):
    d = derive(chain(spark), 'rule t\nwhen edge(a, "depends_on", b)\nwhen edge(b, "depends_on", c)\nthen edge(a, "depends_on", c, product(e1, e2))')
    got = {(r.src, r.dst): round(r.confidence, 4) for r in d.edges.collect()}
    assert got == {("Web", "Db"): 0.72, ("Api", "Disk"): 0.76, ("Web", "Disk"): round(max(0.9 * 0.76, 0.72 * 0.95), 4)}
    assert d.rounds == 3 and d.fired == 2 + 4 + 4
    again = derive(d.graph, 'rule t\nwhen edge(a, "depends_on", b)\nwhen edge(b, "depends_on", c)\nthen edge(a, "depends_on", c)')
    assert again.edges.count() == 0


def test_self_matches_count_and_the_last_flag_wins(spark):
    g = graph.from_rows(spark, [{"label": x, "props": {"p": "1"}} for x in "ab"] + [{"label": "ip"}], [{"src": x, "rel": "at", "dst": "ip"} for x in "ab"])
    d = derive(g, 'rule same\nwhen edge(x, "at", i)\nwhen edge(y, "at", i)\nthen edge(x, "near", y)\nrule f\nwhen prop(x, "p", "1")\nthen flag(x, "first")\nrule g\nwhen prop(x, "p", "1")\nthen flag(x, "second")')
    assert d.edges.count() == 4
    assert {r.f for r in d.graph.nodes.selectExpr("props['_flag'] f").collect()} == {"second", None}


def test_rule_syntax_errors():
    for text in ("when edge(a, b)", 'rule x\nwhen edge(a, "r", b)', 'rule x\nwhen edge(a, "r", b)\nthen edge(a, "r", z)', "nonsense"):
        with pytest.raises(ValueError):
            parse(text)


def test_learning_values(spark):
    g = graph.from_rows(spark, [{"label": "claim", "confidence": 0.70}, {"label": "mars", "confidence": 0.60}, {"label": "sun", "confidence": 0.95}, {"label": "other", "confidence": 0.5}], [{"src": "claim", "rel": "about", "dst": "mars"}, {"src": "mars", "rel": "orbits", "dst": "sun"}, {"src": "other", "rel": "about", "dst": "claim"}])
    got = {r.label: round(r.new, 4) for r in learn.correct(g, "Claim").collect()}
    assert got == {"claim": 0.0, "mars": 0.25, "sun": 0.775}
    uses = spark.createDataFrame([("mars", "confirm"), ("sun", "confirm"), ("sun", "access")], "label string, kind string")
    assert {r.label: round(r.new, 4) for r in learn.reinforce(g.nodes, uses).collect()} == {"mars": 0.7, "sun": 0.95}
    aged = g.nodes.selectExpr("label", "0.5D confidence", "timestamp '2024-01-01' last_accessed")
    assert {round(r.new, 3) for r in learn.decay(aged, "2024-01-31").collect()} == {0.485}


def test_paths_proof_and_walks(spark):
    g = chain(spark)
    assert {r.label: r.depth for r in traverse.bfs(g, "WEB", 2, "out").collect()} == {"Web": 0, "Api": 1, "Db": 2}
    assert traverse.bfs(g, "missing").count() == 0
    p = traverse.prove(g, "web", "depends_on", "db").first()
    assert p.supported and round(p.confidence, 4) == 0.72
    assert not traverse.prove(g, "db", "depends_on", "web").first().supported
    assert [r.path for r in traverse.all_paths(g, "web", "disk").collect()] == ["Web > Api > Db > Disk"]
    assert traverse.components(g).select("component").distinct().count() == 1


def test_filter_language(spark):
    g = graph.from_rows(spark, [{"label": "mysql db", "type": "database", "props": {"k": "a b"}, "confidence": 0.9}, {"label": "pg", "type": "database", "confidence": 0.4}], [])
    labels = lambda q: sorted(r.label for r in g.nodes.where(filters.condition(q)).collect())
    assert labels("type:database NOT mysql") == ["pg"]
    assert labels("prop:k=a b AND confidence>0.5") == ["mysql db"]
    assert labels("prop:k") == ["mysql db"] and labels('"mysql db"') == ["mysql db"] and labels("mysql pg") == ["mysql db", "pg"]
    for bad in ("(a", "AND", "a )"):
        with pytest.raises(ValueError):
            filters.condition(bad)


def test_fusion_ignores_the_order_of_lists(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id long, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 4.0)], "id long, score double")
    assert search.rank_fusion(a, b).collect() == search.rank_fusion(b, a).collect()
    assert search.rank_fusion(a, b).first().id == 2


def test_language_and_actions(spark):
    said = spark.createDataFrame([("A depends on B",), ("x has property k = v w",), ("nothing here",)], "text string")
    assert {tuple(r) for r in language.tell(said).collect()} == {("A", "depends_on", "B", None, None), ("x", None, None, "k", "v w")}
    assert language.ask(chain(spark), "How are web and db related?")[0] == "path"
    with pytest.raises(ValueError):
        analyze.action_condition("entity.type == 'x'; drop table y")


def test_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text("name,type,confidence,team\nA,x,bad,t\n,x,0.5,\nB,y,0.5,\n")
    rows = {r.label: r for r in files.read_csv_nodes(spark, str(tmp_path / "n.csv")).collect()}
    assert rows["A"].confidence == 0.75 and rows["A"].props == {"team": "t"} and rows["B"].props == {} and len(rows) == 2
    assert files.read_graph(spark, str(tmp_path / "n.csv"))[0].count() == 2
    (tmp_path / "e.csv").write_text("from,to,relationship\nA,B,r\n,B,r\n")
    nodes, edges = files.read_graph(spark, str(tmp_path / "e.csv"))
    assert nodes.count() == 0 and [(r.src, r.rel, r.dst, r.confidence) for r in edges.collect()] == [("A", "r", "B", 0.75)]
    (tmp_path / "t.html").write_text("<p>x</p><table><tr><th>Name</th><th>Age</th></tr><tr><td>Ann</td><td>7</td></tr></table>")
    assert {(r.label, r.props["cell_2"]) for r in files.read_graph(spark, str(tmp_path / "t.html"))[0].collect()} == {("Name", "Age"), ("Ann", "7")}
    (tmp_path / "g.json").write_text(json.dumps({"entities": [{"entity": "A"}, {"entity": "B"}], "relationships": [{"from": "A", "to": "B", "relationship": "r"}]}))
    nodes, edges = files.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and edges.first().rel == "r"
    (tmp_path / "x.jsonld").write_text(json.dumps({"@graph": [{"@id": "kg:A", "@type": "schema:Drug", "rdfs:label": "A", "kg:inhibits": {"@id": "kg:B"}, "kg:k": "v"}, {"@id": "kg:B"}]}))
    nodes, edges = files.read_graph(spark, str(tmp_path / "x.jsonld"))
    assert {(r.label, r.type) for r in nodes.collect()} == {("A", "drug"), ("B", None)}
    assert [(r.src, r.rel, r.dst) for r in edges.collect()] == [("A", "inhibits", "B")]
    (tmp_path / "d.md").write_text("---\nauthor: Ann\n---\n# Title\n\nshort\n\nA paragraph that is long enough.\n")
    r = files.read_markdown(spark, str(tmp_path / "d.md")).first()
    assert (r.title, r.author, r.excerpt) == ("Title", "Ann", "A paragraph that is long enough.")
    nodes, edges = files.read_graph(spark, str(tmp_path / "d.md"))
    assert {(r.label, r.type) for r in nodes.collect()} == {("d.md", "document"), ("Ann", "person")} and edges.first().rel == "authored_by"


def test_entities_and_resolution(spark):
    docs = spark.createDataFrame([(1, "Today Alice met Bob Lee. The end. Redis is a database.")], "doc long, text string")
    assert {r.label for r in ingest.capital_entities(docs).collect()} == {"Alice", "Bob", "Lee"}
    assert ("Redis", "is_a", "database") in {(r.src, r.rel, r.dst) for r in ingest.pattern_relations(ingest.sentences(docs)).collect()}
    names = spark.createDataFrame([("New York",), ("new york",), ("York, New",), ("New Yorck",), ("Microsoft Corporation",), ("Microsfot Corporation",), ("Other",)], "label string")
    got = {(r.a, r.b): r.step for r in ingest.resolve_entities(names).collect()}
    assert got == {("New York", "new york"): 1, ("New York", "York, New"): 3, ("New Yorck", "New York"): 4, ("New Yorck", "new york"): 4, ("Microsfot Corporation", "Microsoft Corporation"): 4}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_resolution_has_no_misses(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(6, 15))) for _ in range(250)})
    got = {(r.a, r.b) for r in ingest.resolve_entities(spark.createDataFrame([(n,) for n in names], "label string"), 0.75).collect()}
    want = {(a, b) for a in names for b in names if a < b and edits(a, b) <= int(0.25 * max(len(a), len(b)) + 1e-9)}
    assert got == want and want


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = changes.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    rows = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert rows(spark.table("w")) == rows(changes.windowed_counts(events))


def test_streamed_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"entity": "A"}\n{"entity": "B"}\n{"from": "a", "to": "B", "relationship": "r"}\n')
    got = []

    def land(entities, relations, number):
        g = changes.push_rules(graph.empty(spark), entities, relations, 'rule back\nwhen edge(x, "r", y)\nthen edge(y, "s", x)')
        got.extend((r.src, r.rel, r.dst) for r in g.edges.collect())

    changes.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "c"), land).awaitTermination(120)
    assert sorted(got) == [("A", "r", "B"), ("B", "s", "A")]


def test_cooldown_counts_from_the_last_firing(spark):
    rows = [("r", i, f"2024-01-01 00:{m:02d}:00") for i, m in enumerate((0, 5, 10, 15, 20))] + [("q", 9, "2024-01-01 00:07:00")]
    own = spark.createDataFrame(rows, "rule string, id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {(r.rule, r.id) for r in analyze.cooled_down(own, 600).collect()} == {("r", 0), ("r", 2), ("r", 4), ("q", 9)}


def test_shortest_path_of_any_length(spark):
    names = [f"n{i:02d}" for i in range(9)]
    g = graph.from_rows(spark, [{"label": n} for n in [*names, "x", "alone"]], [{"src": a, "rel": "r", "dst": b, "confidence": 0.5} for a, b in zip(names, names[1:])] + [{"src": "n00", "rel": "r", "dst": "x"}, {"src": "x", "rel": "r", "dst": "n02"}])
    r = traverse.shortest_path(g, "N00", "n08").first()
    assert r.path == " > ".join(names) and r.hops == 8 and round(r.confidence, 6) == round(0.5**8, 6)
    assert traverse.shortest_path(g, "n00", "alone").count() == 0 == traverse.shortest_path(g, "n00", "n00").count()


def test_three_conditions_on_a_hub_are_counted_not_made(spark):
    g = graph.from_rows(spark, [{"label": x} for x in ("h", "a", "b", "c")], [{"src": "h", "rel": "r", "dst": x, "confidence": c} for x, c in (("a", 0.2), ("b", 0.6), ("c", 0.4))])
    d = derive(g, 'rule t\nwhen edge(h, "r", x)\nwhen edge(h, "r", y)\nwhen edge(h, "r", z)\nthen edge(h, "s", x, product(e1, e2))')
    assert {(r.dst, round(r.confidence, 4)) for r in d.edges.collect()} == {("a", 0.12), ("b", 0.36), ("c", 0.24)} and d.fired == 54
    text = 'rule a\nwhen edge(x, "r", y)\nthen edge(y, "s", x, e1)\nrule b\nwhen prop(x, "k", "v w")\nwhen confidence(x, ">", 0.5)\nthen flag(x, "why")'
    assert parse(rule_text(rule_table(spark, text))) == parse(text)


def test_communities_settle(spark):
    clique = lambda names: [(a, b) for a in names for b in names if a < b]
    pairs = clique("abcd") + clique("wxyz") + [("d", "w"), ("p", "q")]
    g = graph.from_rows(spark, [{"label": x} for x in "abcdwxyzpqs"], [{"src": a, "rel": "r", "dst": b} for a, b in pairs])
    got = {r.label: r.community for r in traverse.communities(g).collect()}
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    for x, own in near.items():  # settled: no other label has more votes
        votes = [got[y] for y in own]
        assert votes.count(got[x]) == max(map(votes.count, votes))
    assert len({got[x] for x in "abcd"}) == len({got[x] for x in "wxyz"}) == 1 and got["a"] != got["w"] and got["s"] == "s"


def test_communities_of_neighbours_in_one_half_settle(spark):
    pairs = [(f"a{i}", f"b{i}") for i in range(12)]
    g = graph.from_rows(spark, [{"label": x} for p in pairs for x in p], [{"src": a, "rel": "r", "dst": b} for a, b in pairs])
    halves = {r.label: r.h for r in g.nodes.select("label", F.expr("pmod(xxhash64(label), 2)").alias("h")).collect()}
    assert any(halves[a] == halves[b] for a, b in pairs)
    got = {r.label: r.community for r in traverse.communities(g, 24).collect()}
    assert all(got[a] == got[b] and got[a] in (a, b) for a, b in pairs)


def test_staged_ingest_skips_and_stores(spark):
    docs = spark.createDataFrame([(1, "We met Ada Lovelace. Redis is a database."), (2, "we met ada lovelace. redis is a database."), (3, "")], "doc long, text string")
    known = spark.createDataFrame([("Ada Lovelace", "person")], "label string, type string")
    g, counts = workflow.ingest_texts(graph.empty(spark), docs, known)
    assert {r.label: r.type for r in g.nodes.collect()} == {"Ada Lovelace": "person", "Redis": "concept", "database": "concept"}
    assert [(r.src, r.rel, r.dst) for r in g.edges.collect()] == [("Redis", "is_a", "database")]
    n = {r.stage: r.n for r in counts.collect()}
    assert set(n) == set(workflow.STAGES) and n["dedup"] == 2
    g, counts = workflow.ingest_texts(graph.empty(spark), docs, known, config=ingest.IngestConfig(skip=("dedup", "coref", "resolve", "relations", "conflicts", "store")))
    assert g.nodes.count() == 0 and {r.stage for r in counts.collect()} == {"extract", "relations"}


def test_effects_chain_and_stop(spark):
    g = chain(spark)
    first = spark.createDataFrame([("r", "Web", "2024-01-01", "set_confidence", "", "0.2"), ("r", "Api", "2024-01-01", "notify", "ops", "")], "rule string, id string, ts string, effect string, target string, value string")
    done, depth = workflow.apply_effects(g, first, lambda g, k: first.limit(1 if k < 9 else 0), 3)
    assert depth == 3 and {r.label: r.confidence for r in done.nodes.collect()}["Web"] == 0.2


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=12), st.integers(0, 6))
def test_walks_agree_with_a_plain_search(spark, edges, start):
    g = graph.from_rows(spark, [{"label": f"n{i}"} for i in range(7)], [{"src": f"n{a}", "rel": "r", "dst": f"n{b}"} for a, b in edges])
    depth, level = {start: 0}, [start]
    while level:
        level = [b for x in level for a, b in edges if a == x and b not in depth and not depth.update({b: depth[x] + 1})]
    assert {r.label: r.depth for r in traverse.bfs(g, f"n{start}", 9, "out").collect()} == {f"n{k}": v for k, v in depth.items()}
    assert {(r.path.split(" > ")[-1], r.hops) for k in (0, 3) for r in traverse.shortest_path(g, f"n{start}", f"n{k}", direction="out").collect()} == {(f"n{k}", v) for k, v in depth.items() if v and k in (0, 3)}


def test_tables_that_are_small_in_files_alone_are_not_broadcast(spark):
    from quillgraph.shared import materialize
    from quillgraph.sources import star

    star.from_star(spark, SMALL)
    own = spark.range(2_000_000).select(F.concat(F.lit("order:"), "id").alias("label"), F.lit("customer:1").alias("component"))
    once, again = materialize(own, "labels"), materialize(own, "labels")
    joined = once.join(again.withColumnRenamed("component", "other"), "label", "left")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    few = materialize(own.limit(20), "labels")
    assert "BroadcastHashJoin" in once.join(few.withColumnRenamed("component", "other"), "label")._jdf.queryExecution().executedPlan().toString()


def test_shuffles_have_partitions_by_the_size_of_the_tables(spark, tmp_path):
    from quillgraph.shared import PARTITION_BYTES, fit_plans

    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part").write_bytes(bytes(PARTITION_BYTES) * 9)
    try:
        spark.conf.unset(name)
        fit_plans(spark, [f"{tmp_path}/t"])
        assert int(spark.conf.get(name)) == 9
        spark.conf.set(name, 50)
        fit_plans(spark, [f"{tmp_path}/t"])
        assert int(spark.conf.get(name)) == 50
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_tasks_by_the_size_of_tables(spark, tmp_path):
    """A task reads no more of a table than ``TASK_BYTES``, however large it is; what a session sets itself stays."""
    spark.range(6_000_000, numPartitions=1).selectExpr("id", "xxhash64(id) AS x").write.option("parquet.block.size", 4 << 20).parquet(f"{tmp_path}/t.parquet")
    size = sum(f.stat().st_size for f in tmp_path.glob("t.parquet/*.parquet"))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    own = spark.newSession()
    own.conf.set("spark.sql.files.minPartitionNum", 1)
    assert table(own, str(tmp_path), "t").rdd.getNumPartitions() >= size // shared.TASK_BYTES > 3
    assert {own.conf.get(n) for n in names} == {f"{shared.TASK_BYTES}b"}
    other = spark.newSession()
    for n in names:
        other.conf.set(n, "1m")
    table(other, str(tmp_path), "t")
    assert {other.conf.get(n) for n in names} == {"1m"}


def test_paths_take_moves_around_their_start(spark):
    """Of a graph with a part far from the start, that part's edges aren't among the moves; paths are the same as without it."""
    near, far = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], [(f"x{i}", "d") for i in range(50)]
    edges = [{"src": a, "rel": "r", "dst": b, "confidence": 0.5} for a, b in near + far]
    g = graph.from_rows(spark, [{"label": x} for x in sorted({x for e in near + far for x in e})], edges)
    moves, left = traverse._ways(g, "a", "d", 3, "out", None)
    assert sorted((r.a, r.b) for r in moves.collect()) == sorted(near)
    assert {r.b: r._left for r in left.collect()} == {"d": 0, "c": 1, "a": 2, "b": 2}
    assert sorted(">".join(r.path) for r in traverse.paths(g, "a", "d", 3).collect()) == ["a>b>c>d", "a>c>d"]


def test_nodes_are_numbered_in_the_order_of_their_labels(spark):
    labels = [f"n{i * 7919 % 1000}" for i in range(1000)]
    ids = {r.label: r.id for r in traverse._numbered(spark.createDataFrame([(x,) for x in labels], "label string").repartition(7)).collect()}
    assert sorted(ids, key=ids.get) == sorted(labels) and sorted(ids.values()) == list(range(1, 1001))


def test_holes_are_not_made_by_the_largest_hub(spark, monkeypatch):
    """Nodes that share one hub alone make no pair; those that share another one count both."""
    rows = [(f"n{i}", "hub") for i in range(200)] + [("n0", "y"), ("n1", "y"), ("n2", "z"), ("n3", "z"), ("n2", "y")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    every, made = search.link_candidates(edges), []
    wanted = {(r.a, r.b, r.common) for r in every.where("common >= 2").collect()}
    cut = search.cut_lineage
    monkeypatch.setattr(search, "cut_lineage", lambda df: made.append(df.count()) or cut(df))
    assert {(r.a, r.b, r.common) for r in search.link_candidates(edges, None, 2).collect()} == wanted
    asked = spark.createDataFrame([("n0",), ("n3",)], "label string")
    assert {(r.a, r.b, r.common) for r in search.link_candidates(edges, asked, 2).collect()} == {w for w in wanted if {"n0", "n3"} & set(w[:2])}
    assert len(wanted) == 6 and made and max(made) < 450
