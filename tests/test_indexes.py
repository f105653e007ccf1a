"""Stored indexes, similarity joins, sweeps, rules by deltas, embeddings and digests against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillgraph import graph
from quillgraph.operators import embeddings, ingest, learn, mesh_digest, search, similar, text_index, traverse, vector_index, workflow
from quillgraph.plans import rules
from quillgraph.registry import _query_vectors, _vectors
from quillgraph.shared import materialize, new_path

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


# --- similar texts


def word_sets(rows):
    return [frozenset(re.findall(r"[^\W_]+", (t or "").lower())) for _, t in rows]


def test_similar_texts_match_all_pairs(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(60), rng.randrange(0, 7)):
            words[at] = f"x{rng.randrange(10**9)}"
        rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, " ".join(f"g{k}q{i}" for i in range(k % 9 + 1))) for k in range(40)]
    rows += [(200 + k, "the same text of several words") for k in range(30)]
    rows += [(300, None), (301, ""), (302, "--"), (303, "one"), (304, "ONE"), (None, "no id here"), (None, "the same text of several words"), (305, "a b c d e f g"), (306, "a b c d e f g h"), (307, "b c d e f g h")]
    got = Counter((r.id, r.class_id) for r in similar.dedup_semantic(spark.createDataFrame([(i, t, 1) for i, t in rows], "id long, text string, n int")).collect())
    sets = word_sets(rows)
    top = {s: s for s in sets if s}

    def root(s):
        while top[s] is not s:
            s = top[s]
        return s

    for a, b in itertools.combinations(top, 2):
        if 100 * len(a & b) >= 85 * len(a | b):
            top[root(a)] = root(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[root(s)] = min(i, least.get(root(s), i))
    assert got == Counter((i, least.get(root(s)) if s else i) for (i, _), s in zip(rows, sets))
    assert similar.dedup_semantic(spark.createDataFrame([], "id long, text string")).count() == 0


# --- vectors


def test_vector_index_reads_less_and_finds_most(spark):
    vectors, asked = _vectors(spark, LARGER), _query_vectors(spark, LARGER)
    index = vector_index.build(vectors)
    assert index.codes(spark).count() == index.floats(spark).count() == vectors.count()
    exact = {(r.query, r.id) for r in search.knn_block(vectors, asked).collect()}
    half = -(-len(index.centres) // 2)
    got = vector_index.search(index, asked, count=half).collect()
    assert len(exact & {(r.query, r.id) for r in got}) >= 0.9 * len(exact)
    assert vector_index.comparisons(index, asked, half) < 0.6 * vectors.count() * asked.count()
    assert all(abs(r.score) <= 1 for r in got) and max(Counter(r.query for r in got).values()) <= 10


def test_vectors_in_clusters_need_few_lists(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.3 * rng.normal(size=24)]) for i in range(3000)] + [(3000 + i, [1.0] * 24) for i in range(1500)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = vectors.where("id % 50 = 0 AND id < 3000")
    index = vector_index.build(vectors.where("id % 3 <> 1"))  # a third of all vectors are one and the same
    vector_index.add(index, vectors.where("id % 3 = 1"))
    exact = {(r.query, r.id) for r in search.knn_block(vectors, asked).collect()}
    got = {(r.query, r.id) for r in vector_index.search(index, asked, count=12).collect()}
    assert len(exact & got) >= 0.95 * len(exact)
    assert vector_index.comparisons(index, asked, 12) < 0.1 * vectors.count() * asked.count()


def test_codes_are_read_apart_from_floats(spark):
    index = vector_index.build(_vectors(spark, SMALL), lists=1)
    scan = index.codes(spark)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in scan and "q#" in scan
    exact = {(r.query, r.id) for r in search.knn_block(_vectors(spark, SMALL), _query_vectors(spark, SMALL)).collect()}
    got = {(r.query, r.id) for r in vector_index.search(index, _query_vectors(spark, SMALL), count=1, widen=10).collect()}
    assert len(got & exact) >= 0.95 * len(exact)


def test_vectors_that_cannot_be_indexed(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [0.0, 2.0]), (5, [1.0, 2.0, 3.0]), (6, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    index = vector_index.build(vectors)
    got = {(r.query, r.id): r.score for r in vector_index.search(index, vectors, count=99).collect()}
    assert set(got) == {(a, b) for a in (1, 4, 6) for b in (1, 4, 6)} and got[(1, 6)] == 1.0 and got[(1, 4)] == 0.0
    none = vector_index.build(vectors.limit(0))
    assert vector_index.search(none, vectors).count() == 0


# --- texts


@pytest.fixture(scope="module")
def many_texts(spark):
    rng = random.Random(5)
    common, rows = [f"c{i}" for i in range(30)], []
    for i in range(6000):
        words = rng.choices(common, weights=[1 / (k + 1) for k in range(30)], k=rng.randrange(5, 40))
        if rng.random() < 0.01:
            words += ["rare"] * rng.randrange(1, 9)
        rows.append((i, " ".join(words)))
    rows += [(6000, None), (6001, "")]
    return rows


def test_text_index_equals_a_scan(spark, many_texts):
    docs = spark.createDataFrame(many_texts, "id long, text string")
    index = text_index.build(docs.where("id % 2 = 0"), folders=8)
    text_index.add(index, docs.where("id % 2 = 1"))
    for text in ("rare c1", "c0 c5 c29", "C3 c3, nothing", "nothing at all"):
        want = [(r.id, r.score) for r in search.bm25(docs, text, 10).collect()]
        asked = spark.createDataFrame([(7, text)], "query long, text string")
        got = sorted((-r.score, r.id) for r in text_index.search(index, asked).collect())
        assert [i for _, i in got] == [i for i, _ in want]
        assert all(abs(a + s) < 2e-6 for (a, _), (_, s) in zip(got, want))
    every = text_index.search(index, spark.createDataFrame([(7, "rare c1")], "query long, text string"), None)
    assert every.count() == search.bm25(docs, "rare c1", None).count()


def test_text_index_stops_early_and_reads_its_terms_alone(spark, many_texts):
    docs = spark.createDataFrame(many_texts, "id long, text string")
    index = text_index.build(docs, folders=8)
    asked = spark.createDataFrame([(1, "c20 c21"), (2, "c2"), (3, "rare c0")], "query long, text string")
    need, every = text_index.needed_blocks(index, asked)
    n = {r.query: r.n for r in need.groupBy("query").agg(F.sum("n").alias("n")).collect()}
    whole = {r.query: r.n for r in every.groupBy("query").agg(F.sum("n").alias("n")).collect()}
    assert n[2] < 0.5 * whole[2] and all(n[q] <= whole[q] for q in n)
    assert {r.term for r in every.select("term").distinct().collect()} == {"rare", "c0", "c20", "c21", "c2"}
    allowed = spark.createDataFrame([(i,) for i in range(0, 6000, 7)], "id long")
    got = text_index.search(index, asked, 5, allowed).collect()
    assert got and all(r.id % 7 == 0 for r in got)


# --- names


@pytest.mark.parametrize("most", [1 << 22, 0])
def test_gazetteer_finds_names_of_any_length(spark, monkeypatch, most):
    monkeypatch.setattr(ingest, "AUTOMATON_BYTES", most)
    monkeypatch.setattr(ingest, "SLICE_BYTES", 200)
    long = " ".join(f"n{i}" for i in range(50))
    docs = [(1, f"We saw {long}, twice: {long}!"), (2, "New York, new york city"), (3, None), (4, ""), (5, "york new"), (6, "NEW-YORK and n0 n1"), (7, "c'est l'été à Paris")]
    known = [("New York", "city"), ("New York", "team"), ("new york city", "city"), (long, "thing"), ("n0 n1", "pair"), ("", "none"), (None, "none"), ("--", "none"), ("été", "season"), ("absent name", "x")]
    got = {tuple(r) for r in ingest.gazetteer_entities(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(known, "label string, type string")).collect()}
    want = set()
    for doc, text in docs:
        words = " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "
        for label, kind in known:
            key = " ".join(re.findall(r"[^\W_]+", (label or "").lower()))
            if key and f" {key} " in words:
                want.add((doc, label, kind))
    assert got == want and (1, long, "thing") in got


# --- contradictions


@pytest.mark.parametrize("seed", range(3))
def test_sweeps_match_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(140):
        a = rng.randrange(0, 40)
        rows.append((f"s{rng.randrange(5)}", rng.choice(["r", "q"]), f"v{rng.randrange(4)}", a if rng.random() > 0.1 else None, a + rng.randrange(-1, 7) if rng.random() > 0.1 else None))
    time = lambda c: F.timestamp_seconds(c)
    edges = spark.createDataFrame(rows, "src string, rel string, dst string, a long, b long").select("src", "rel", "dst", time("a").alias("valid_from"), time("b").alias("valid_to"))
    live = sorted({x for x in rows if x[1] == "r" and (x[3] is None or x[4] is None or x[3] < x[4])}, key=lambda x: (x[0], -math.inf if x[3] is None else x[3], x[2], math.inf if x[4] is None else x[4]))
    want = Counter()
    for i, x in enumerate(live):
        start = -math.inf if x[3] is None else x[3]
        before = [(math.inf if y[4] is None else y[4], y[2]) for y in live[:i] if y[0] == x[0] and y[2] != x[2]]
        if before and max(before)[0] > start:
            want[(x[0], x[2], x[3], max(before)[1])] += 1
    got = learn.contradiction_witnesses(edges, ["r"]).select("src", "dst", F.unix_seconds("valid_from").alias("a"), "other").collect()
    assert Counter(tuple(r) for r in got) == want
    pairs = {(r.src, r.dst_a, r.dst_b) for r in learn.contradictions(edges.where("valid_from IS NULL OR valid_to IS NULL OR valid_from < valid_to"), ["r"]).collect()}
    assert {(s, *sorted((d, o))) for s, d, _, o in want} <= pairs and {p[0] for p in pairs} == {w[0] for w in want}
    classes = learn.contradiction_classes(edges, ["r"]).collect()
    assert {r.src for r in classes} == {w[0] for w in want} and all(r["values"] > 1 for r in classes)


def test_a_subject_with_many_values_is_one_pass(spark):
    n = 100_000
    edges = spark.range(n).select(F.lit("s").alias("src"), F.lit("r").alias("rel"), F.concat(F.lit("v"), F.col("id") % 1000).alias("dst"), F.timestamp_seconds(F.col("id")).alias("valid_from"), F.timestamp_seconds(F.col("id") + 50_000).alias("valid_to"))
    assert learn.contradiction_witnesses(edges, ["r"]).count() == n - 1
    assert [(r["values"], r.rows) for r in learn.contradiction_classes(edges, ["r"]).collect()] == [(1000, n)]


# --- rules


def naive(edges, nodes, texts):
    """(edges with confidence, matches of all rounds) by joining everything in every round."""
    fired = 0
    while True:
        new = {}
        for body, head in texts:
            labels = sorted({x for e in edges for x in (e[0], e[2])} | set(nodes))
            variables = sorted({v for kind, *a in body for v in ((a[0], a[2]) if kind == "edge" else (a[0],))})
            for values in itertools.product(labels, repeat=len(variables)):
                at, times, sure = dict(zip(variables, values)), 1, []
                for kind, *a in body:
                    own = [c for s, r, d, c in edges if (s, r, d) == (at[a[0]], a[1], at[a[2]])] if kind == "edge" else [1.0] * (nodes.get(at[a[0]], {}).get(a[1]) == a[2])
                    times *= len(own)
                    sure += [max(own)] if own and kind == "edge" else []
                if times:
                    fired += times
                    key = (at[head[0]], head[1], at[head[2]])
                    new[key] = max(new.get(key, 0), min(sure))
        held = {e[:3] for e in edges}
        fresh = [(*k, c) for k, c in new.items() if k not in held]
        if not fresh:
            return Counter(edges), fired
        edges = edges + fresh


@pytest.mark.parametrize("seed", range(3))
def test_rules_by_deltas_equal_rules_by_all_edges(spark, seed):
    rng = random.Random(seed)
    names = "abcde"
    edges = [(rng.choice(names), rng.choice("pq"), rng.choice(names), rng.choice([0.5, 0.7, 0.9])) for _ in range(9)]
    nodes = {x: {"k": rng.choice(["yes", "no"])} for x in names}
    text = """rule up
when edge(X, "p", Y)
when edge(Y, "p", Z)
then edge(X, "p", Z)
rule across
when edge(X, "p", Y)
when edge(X, "q", Y)
when prop(X, "k", "yes")
then edge(Y, "r", X)
rule back
when edge(X, "r", Y)
when edge(Y, "p", Z)
then edge(Z, "q", X)"""
    plain = [([("edge", "X", "p", "Y"), ("edge", "Y", "p", "Z")], ("X", "p", "Z")), ([("edge", "X", "p", "Y"), ("edge", "X", "q", "Y"), ("prop", "X", "k", "yes")], ("Y", "r", "X")), ([("edge", "X", "r", "Y"), ("edge", "Y", "p", "Z")], ("Z", "q", "X"))]
    g = graph.from_rows(spark, [{"label": x, "type": "t", "props": p, "confidence": 0.8} for x, p in nodes.items()], [dict(zip(("src", "rel", "dst", "confidence"), e)) for e in edges])
    got = rules.derive(g, text, max_rounds=30)
    want, fired = naive(edges, nodes, plain)
    assert Counter((r.src, r.rel, r.dst, round(r.confidence, 6)) for r in got.graph.edges.collect()) == Counter({(s, r, d, round(c, 6)): n for (s, r, d, c), n in want.items()})
    assert got.fired == fired


# --- walks


def test_walks_have_no_silent_ends(spark):
    g = graph.from_rows(spark, [{"label": f"n{i}", "type": "t"} for i in range(25)], [{"src": f"n{i}", "rel": "r", "dst": f"n{i + 1}", "confidence": 0.9} for i in range(24)])
    assert traverse.reach(g, "N0", "out").count() == 24
    assert [r.hops for r in traverse.shortest_path(g, "n0", "n24").collect()] == [24]
    assert traverse.shortest_path(g, "n0", "n24", max_edges=5).count() == 0 and traverse.shortest_path(g, "n3", "n3").count() == 0
    odd = graph.from_rows(spark, [{"label": x, "type": "t"} for x in ("a > b", "c", "d")], [{"src": "a > b", "rel": "r", "dst": "c", "confidence": 0.9}, {"src": "c", "rel": "r", "dst": "d", "confidence": 0.9}])
    assert [r.hops for r in traverse.shortest_path(odd, "a > b", "d").collect()] == [2]
    assert odd.delete_edge("A > B", "r", "C").live_edges().count() == 1


# --- store and batches


def test_store_keeps_the_last_property_of_a_hot_label(spark):
    rows = [("Hub", "t", {f"k{i % 7}": str(i)}, i) for i in range(2000)] + [("Other", None, None, 5), (None, "t", None, 6), ("", "t", None, 7)]
    g, errors = graph.empty(spark).batch(spark.createDataFrame(rows, "label string, type string, props map<string,string>, n int"), spark.createDataFrame([("hub", "r", "other"), ("hub", "r", "gone"), (None, "r", "hub")], "src string, rel string, dst string"), ["n"])
    props = {r.label: r.props for r in g.nodes.collect()}
    assert props == {"Hub": {f"k{k}": str(max(i for i in range(2000) if i % 7 == k)) for k in range(7)}, "Other": {}}
    assert [(r.src, r.dst) for r in g.edges.collect()] == [("Hub", "Other")]
    assert Counter((r.kind, r.error) for r in errors.collect()) == {("node", "label is missing"): 2, ("edge", "node not found"): 2}


def test_ingest_twice_adds_nothing_and_names_are_classes(spark):
    texts = ["Ada Lovelace was here. She is a mathematician.", "Redis is a database. It was created by Salvatore.", "abcdefghijklmn is a thing. Bob works at Acme Corp today.", "abcdefghijklmx is a thing.", "abcdefghijkyzx is a thing.", "redis is a DATABASE. it was created by salvatore."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    known = spark.createDataFrame([("Ada Lovelace", "person"), ("Acme Corp", "organization")], "label string, type string")
    config = ingest.IngestConfig(templates={"works_at": "{head} works at {tail}"})
    g, counts = workflow.ingest_texts(graph.empty(spark), docs, known, config=config)
    n = {r.stage: r.n for r in counts.collect()}
    edges = {(r.src, r.rel, r.dst) for r in g.edges.collect()}
    assert n["coref"] == 2 and ("Ada Lovelace", "is_a", "mathematician") in edges and ("Redis", "created_by", "Salvatore") in edges
    assert any(s == "Bob" and r == "works_at" and d.startswith("Acme Corp") for s, r, d in edges)
    # within two edits of each other one after the next: one class, whoever was compared with whom
    labels = {r.label for r in g.nodes.collect()}
    assert "abcdefghijklmx" not in labels and len([x for x in labels if x.startswith("abcdefghij")]) <= 2
    again, counts = workflow.ingest_texts(g, docs, known, config=config)
    assert {r.stage: r.n for r in counts.collect()}["store"] == 0
    assert (again.nodes.count(), again.edges.count()) == (g.nodes.count(), g.edges.count())
    with pytest.raises(ValueError):
        ingest.template_patterns({"x": "{tail} of {head}"})


def test_review_commits_what_was_accepted(spark):
    g = graph.from_rows(spark, [{"label": "A", "type": "t"}, {"label": "B", "type": "t"}], [{"src": "A", "rel": "r", "dst": "B", "confidence": 0.5}])
    staged = spark.createDataFrame([(1, "a", "r", "b", 0.9), (2, "A", "s", "C", 0.6), (3, "B", "r", "A", 0.6), (4, "B", "r", "D", 0.6)], "idx long, src string, rel string, dst string, confidence double")
    decided = spark.createDataFrame([(1, "accepted", None), (2, "modified", "renamed"), (3, "rejected", None)], "idx long, action string, new_rel string")
    out, left = workflow.commit_review(g, staged, decided)
    assert {(r.src, r.rel, r.dst, r.confidence) for r in out.edges.collect()} == {("A", "r", "B", 0.9), ("A", "renamed", "C", 0.6)}
    assert [r.idx for r in left.collect()] == [4] and {r.label for r in out.nodes.collect()} == {"A", "B", "C"}
    again, _ = workflow.commit_review(out, staged, decided)
    assert again.edges.count() == 2


# --- embeddings


def test_embeddings_rank_held_out_links_above_common_neighbours(spark):
    rng = random.Random(1)
    pairs = sorted({(f"p{i}", f"s{(i % 4) * 10 + rng.randrange(10)}") for i in range(240) for _ in range(6)})
    rng.shuffle(pairs)
    held, kept = pairs[:150], pairs[150:]
    edges = spark.createDataFrame([(a, "supplied_by", b) for a, b in kept] + [(f"p{i}", "kind", f"k{i % 4}") for i in range(0, 240, 2)], "src string, rel string, dst string")
    model = embeddings.train(edges, dim=12, epochs=3, buckets=3)
    wrong = [(a, f"s{(int(b[1:]) + 10 * rng.randrange(1, 4)) % 40}") for a, b in held]
    both = spark.createDataFrame([(a, "supplied_by", b, k) for k, own in ((1, held), (0, wrong)) for a, b in own], "src string, rel string, dst string, good int")
    score = {(r.src, r.dst): r.score for r in embeddings.scored(model, both).collect()}
    better = np.mean([score[x] > score[y] for x, y in zip(held, wrong)])
    # parts and suppliers share no neighbours, so common neighbours rank all of these alike
    common = {(r.a, r.b) for r in search.link_candidates(edges.where("rel = 'supplied_by'")).collect()}
    assert better > 0.85 and not common & {tuple(sorted(x)) for x in held}
    best = embeddings.predict(model, edges.where("rel = 'supplied_by'").select("src", "rel").distinct().limit(40), edges, 5).collect()
    assert max(Counter(r.src for r in best).values()) == 5 and not {(r.src, r.dst) for r in best} & set(kept)
    assert np.mean([int(r.dst[1:]) // 10 == int(r.src[1:]) % 4 for r in best]) > 0.7


def test_rounds_of_training_do_not_grow_with_its_tasks(spark, monkeypatch):
    written = []
    monkeypatch.setattr(embeddings, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    edges = spark.range(300).select(F.concat(F.lit("a"), F.col("id") % 40).alias("src"), F.lit("r").alias("rel"), F.concat(F.lit("b"), F.col("id") % 7).alias("dst"))
    model = embeddings.train(edges, dim=4, epochs=2, passes=1, buckets=5)
    assert written.count("embedding-round") == 2
    assert model.entities.count() == 47 == model.entities.select("label").distinct().count() and model.relations.count() == 1


# --- digests


def test_bytes_follow_the_differences(spark):
    theirs = spark.range(20_000).select("id", F.concat(F.lit("value "), F.col("id") * 7).alias("v"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).alias("w"))
    sent = {}
    for missing in (0, 20, 2000):
        mine = theirs.where(f"id >= {missing}").unionByName(spark.createDataFrame([(-1, "mine alone", 1)], "id long, v string, w long"))
        found = mesh_digest.delta(mine, theirs, ["id", "v", "w"])
        assert {r.id for r in found.rows.collect()} == set(range(missing))
        sent[missing] = sum(r.bytes for r in found.sent.collect())
    whole = theirs.agg(F.sum(F.octet_length(F.to_json(F.struct("id", "v", "w"))))).first()[0]
    assert sent[0] < sent[20] < sent[2000] < whole and sent[20] < 0.1 * whole
    assert mesh_digest.delta(theirs.limit(0), theirs, ["id"]).rows.count() == 20_000
    assert mesh_digest.delta(theirs, theirs.limit(0), ["id"]).rows.count() == 0


@pytest.mark.parametrize("name", ["dedup_semantic", "bm25_index", "contradiction_witnesses", "contradiction_classes", "ner_gazetteer", "ingest_staged"])
def test_new_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = entry.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want)
    assert new_path(spark, "x")


def _stages(spark):
    """Of each stage so far: bytes shuffled and written, by stage and attempt."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(None, False, False, none, None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.outputBytes() for s in map(stages.apply, range(stages.size()))}


def _moved(spark, run):
    """What ``run`` gives, and the bytes it shuffles and writes."""
    before = _stages(spark)
    out = run()
    return out, sum(n for key, n in _stages(spark).items() if key not in before)


def _prose(n):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(4000)]
    return [(i, " ".join(rng.choices(words, k=300))) for i in range(n)]


def test_an_index_moves_its_postings_once(spark):
    rows = _prose(1500)
    texts = materialize(spark.createDataFrame(rows, "id long, text string"), "texts")
    index, moved = _moved(spark, lambda: text_index.build(texts, folders=2))
    assert moved < 1.6 * sum(len(t) for _, t in rows)
    held = index.postings(spark)
    assert held.where("n > 1024 or size(postings) <> n").count() == 0
    want = Counter((w, i, n) for i, t in rows for w, n in Counter(t.split()).items())
    assert Counter(tuple(r) for r in held.select("term", F.explode("postings").alias("p")).select("term", "p.id", "p.tf").collect()) == want


def test_similar_texts_move_less_than_thrice_their_size(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    classes, moved = _moved(spark, lambda: similar.dedup_semantic(texts).count())
    assert classes == texts.count() and moved < 3 * size


def test_a_word_of_many_sets_makes_no_pairs_that_sizes_and_places_rule_out(spark):
    rows = [(i, f"firm{i} is a carrier it ships from nation{i % 3}") for i in range(600)]
    got = similar.dedup_semantic(spark.createDataFrame(rows, "id long, text string")).collect()
    assert {(r.id, r.class_id) for r in got} == {(i, i) for i, _ in rows}


def test_pairs_of_documents_with_one_entity_are_not_shuffled(spark):
    rows = [(i, f"e{i % 2}") for i in range(2000)]
    single = materialize(spark.createDataFrame(rows, "doc long, label string"), "mentions")
    pairs, moved = _moved(spark, lambda: ingest.document_links(single).agg(F.count(F.lit(1)), F.sum("shared")).first())
    assert tuple(pairs) == (1000 * 999, 1000 * 999) and moved < 3_000_000
    rng = random.Random(5)
    mixed = {(rng.randrange(60), f"e{rng.randrange(25)}") for _ in range(110)} | {(100, "e1"), (101, "e1"), (101, "e2"), (102, "e2"), (102, "e1")}
    want = Counter((a, b) for a, x in mixed for b, y in mixed if x == y and a < b)
    for least in (1, 2):
        got = ingest.document_links(spark.createDataFrame([*mixed, (None, "e1"), (7, None)], "doc long, label string"), least).collect()
        assert sorted(map(tuple, got)) == sorted((*p, n) for p, n in want.items() if n >= least)


def test_pairs_of_common_neighbours_are_not_shuffled(spark):
    rng = random.Random(8)
    near = {f"n{i}": {f"h{rng.randrange(20)}" for _ in range(6)} for i in range(1000)}
    edges = materialize(spark.createDataFrame([(a, b) for a, own in near.items() for b in own], "src string, dst string"), "edges")
    asked = spark.createDataFrame([(f"n{i}",) for i in range(0, 1000, 4)], "label string")
    got, moved = _moved(spark, lambda: search.link_candidates(edges, asked).where("a like 'n%'").agg(F.count(F.lit(1)), F.sum("common")).first())
    names = list(near)
    want = [len(near[a] & near[b]) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and not (i % 4 and j % 4)]
    assert tuple(got) == (sum(n > 0 for n in want), sum(want)) and moved < 2_000_000


def test_long_names_of_common_words_go_to_few_slices(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 120))) for _ in range(2000)]
    names = sorted({" ".join(t.split()[: 1 + i % 40]) for i, t in enumerate(texts)} | {"w1 nobody", "w60"})
    docs = materialize(spark.createDataFrame(list(enumerate(texts)), "doc long, text string"), "texts")
    known = materialize(spark.createDataFrame([(n, "t") for n in names], "label string, type string"), "names")
    monkeypatch.setattr(ingest, "AUTOMATON_BYTES", 0)
    monkeypatch.setattr(ingest, "SLICE_BYTES", 3000)
    got, moved = _moved(spark, lambda: {(r.doc, r.label) for r in ingest.gazetteer_entities(docs, known).collect()})
    padded = [f" {t} " for t in texts]
    assert got == {(i, n) for n in names for i, t in enumerate(padded) if f" {n} " in t}
    assert moved < 3_000_000


def test_python_sources_are_parsed_by_pieces(spark, monkeypatch):
    import ast
    import tracemalloc

    long = "\n".join(f"import pkg.p{i}" for i in range(40_000)) + "\n\ndef run():\n    pass\n"
    tracemalloc.start()
    assert len(ingest._named("m", long)) == 40_002
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    ast.parse(long)
    assert peak * 2 < tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    monkeypatch.setattr(ingest, "PARSED", 8)
    odd = [
        "if a:\n    import x\nelse:\n    import y\n",
        "try:\n    import x\nexcept E:\n    import y\nfinally:\n    import z\nimport w",
        "@a\n@b(\n1)\ndef f():\n    class C: pass\n\nasync def g(): import q",
        's = """\nimport no\n"""\nimport yes\n',
        "import a\\\n, b\nfrom c import (\nd,\n)\nfrom . import e\n",
        "import a\nimport b\nimport (\n", "import a\n'''\nimport b\n", "x = [\n1,\n\n", "import a\r\nimport b\rimport c\n\x0cimport d\n", "", None, "# import a\n",
    ]
    got = ingest.python_modules(spark.createDataFrame([(str(i), t) for i, t in enumerate(odd)], "path string, text string")).collect()
    for i, text in enumerate(odd):
        try:
            nodes = list(ast.walk(ast.parse(text or "")))
        except SyntaxError:
            want = ["not Python"]
        else:
            want = [str(i), *(n.name for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)))]
            want += [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names] + [n.module for n in nodes if isinstance(n, ast.ImportFrom) and n.module]
        assert sorted(r.name for r in got if r.path == str(i)) == sorted(want)
