"""The similarity join of shingle sets against all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import jaccard_join, queries

SMALL = "/root/testdata/sf0.001"


def members(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def grouped(rows):
    """(doc_id, n_shingles, component_id) by comparing all distinct sets."""
    sets = [members(t) for _, t in rows]
    root = {s: s for s in sets if s}
    distinct = list(root)

    def top(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                root[top(a)] = top(b)
    least = {}
    for (doc_id, _), s in zip(rows, sets):
        if s and doc_id is not None:
            least[top(s)] = min(doc_id, least.get(top(s), doc_id))
    return Counter((doc_id, len(s), least.get(top(s)) if s else doc_id) for (doc_id, _), s in zip(rows, sets))


def edited(words, rng, changes):
    words = list(words)
    for at in rng.integers(0, len(words), changes):
        words[at] = f"new{rng.integers(1 << 40)}"
    return " ".join(words)


def corpus():
    """Near copies at all distances from the threshold, of sizes from a few words to thousands; shared passages; odd texts."""
    rng = np.random.default_rng(13)
    rows, passage = [], [f"common{i}" for i in range(40)]
    for size in (6, 9, 12, 14, 20, 33, 60, 75, 120, 300, 900):
        for k in range(4):
            words = [f"w{size}x{k}x{i}" for i in range(size)]
            for changes in range(0, max(3, size // 12)):
                rows.append((len(rows), edited(words, rng, changes)))
            rows.append((len(rows), " ".join(words[: size * 5 // 6])))
            rows.append((len(rows), " ".join(words + passage)))
    base = [f"hot{i}" for i in range(200)]
    rows += [(len(rows) + k, edited(base, rng, 3)) for k in range(120)]
    rows += [(len(rows) + k, " ".join(base)) for k in range(50)]
    rows += [(None, " ".join(base).upper()), (None, None), (None, "only null ids here"), (3, "another text with id three"), (3, "another text with id three")]
    rows += [(90_001, None), (90_002, ""), (90_003, " \t\n"), (90_004, "one"), (90_005, "ONE"), (90_006, "a b c d"), (90_007, "a  b c D"), (90_008, "é É ß x y z"), (90_009, "é é ß x y z")]
    rows += [(90_010, "ab " * 40_000), (90_011, "ab " * 30), (90_012, " ".join(f"n{i}" for i in range(30_000))), (90_013, " ".join(f"n{i}" for i in range(29_000)))]
    return rows


def test_four_shingles_of_five_are_a_link(spark):
    texts = ["a b c d e f g h", "a b c d e f g h i", "x a b c d e f g h", "p q r s t u v w", "p q r s t u v w w w"]
    rows = list(enumerate(texts))
    got = Counter(tuple(r) for r in jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == grouped(rows)
    assert {c for i, _, c in got if i < 3} == {0} and got[(3, 4, 3)] == got[(4, 6, 4)] == 1


@pytest.mark.parametrize("cells", [jaccard_join.CELLS, 2])
def test_components_match_all_pairs(spark, cells):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, tokens string, h1 int, key int")
    got = Counter(tuple(r) for r in jaccard_join.groups(docs, cells=cells).select("doc_id", "n_shingles", "component_id").collect())
    assert got == grouped(rows)


def test_components_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = Counter(tuple(r) for r in queries.op13_jaccard_join(spark, SMALL).select("doc_id", "n_shingles", "component_id").collect())
    assert got == grouped(rows)
    assert len({r[2] for r in got}) < len(rows)


def test_large_sets_far_from_similar_part_where_entries_meet(spark, monkeypatch):
    """Sets of some 2000 shingles that have half of them in common share entries, but no pair of them leaves the join."""
    rng, made = np.random.default_rng(7), []
    common = [f"c{i}" for i in range(1400)]
    rows = [(k, " ".join(common + [f"own{k}x{i}" for i in range(600)])) for k in range(40)]
    rows += [(100 + k, edited(rows[k][1].split(), rng, 4)) for k in range(40)]
    ordered = jaccard_join._ordered
    monkeypatch.setattr(jaccard_join, "_ordered", lambda pairs: made.append(pairs.count()) or ordered(pairs))
    got = Counter(tuple(r) for r in jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == grouped(rows)
    assert made[-1] < len(rows)


def test_empty_table(spark):
    assert jaccard_join.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_allocation_finds_sets_within_its_units():
    rng = np.random.default_rng(5)
    for _ in range(300):
        band = int(rng.integers(5, 22))
        high, m, thin = jaccard_join.scheme(band)
        small = int(rng.integers(jaccard_join.bands()[band], high + 1))
        large = int(rng.integers(small, small * 5 // 4 + 1))
        most = (small + large) // 9
        own = (most - (large - small)) // 2
        if own < 0:
            continue
        common = rng.integers(0, 2**64, small - own, dtype=np.uint64)
        s = np.sort(np.r_[common, rng.integers(0, 2**64, own, dtype=np.uint64)])
        r = np.sort(np.r_[common, rng.integers(0, 2**64, large - len(common), dtype=np.uint64)])
        index, roles = jaccard_join._index_rows(1, s, band)
        costs = rng.integers(0, 9, 64).astype(np.float32)
        asked, kinds = jaccard_join._probe_rows(r, band, costs)
        plain = set(index[roles == jaccard_join.INDEX].tolist())
        assert set(asked.tolist()) & plain or set(asked[kinds == jaccard_join.PROBE].tolist()) & set(index.tolist())


def test_near_copies_of_one_text_meet_in_rows_by_their_number(spark, monkeypatch):
    """Copies with an edit of their own are like the text itself and seldom like each other."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for k in range(1, 200):
        words = list(base)
        words[rng.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(words)))
    made = []
    ordered = jaccard_join._ordered
    monkeypatch.setattr(jaccard_join, "_ordered", lambda pairs: made.append(pairs.count()) or ordered(pairs))
    got = jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
    # the last join is the one of all pairs that are still open
    assert made[-1] < 40 * len(rows)


def test_entries_of_few_sets_are_left_out_of_the_rounds_of_hubs(spark, monkeypatch):
    """Texts in fours that share half of their words leave entries open, all of them small."""
    rows = []
    for group in range(30):
        common = [f"g{group}x{i}" for i in range(40)]
        rows += [(len(rows) + k, " ".join(common + [f"o{group}x{k}x{i}" for i in range(40)])) for k in range(4)]
    # half of a text is in no other set: a copy with another end brings it back
    rows += [(1000 + i, text.rsplit(" ", 1)[0] + " end") for i, text in rows]
    made, write = {}, jaccard_join.materialize

    def counted(df, name):
        out = write(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    got = Counter(tuple(r) for r in jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == grouped(rows)
    assert made["open-entries"][0] > 0 and "hub-pairs" not in made
