"""Divergence of sources and alignment of tokenizers against brute-force versions, odd rows included."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter

import pytest

from quillgraph.llm import divergence, queries, token_align

SMALL = "/root/testdata/sf0.001"
ODD = [
    (1, "The cat sat on the mat. THE Cat", "en", "a", 1, "x"),
    (1, "The cat sat on the mat. THE Cat", "en", "a", 1, "x"),
    (2, "die Katze saß auf der Matte, die Matte", "de", "b", 2, "x"),
    (2, "die Katze aß; die Maus lief", "de", "c", 2, "x"),
    (None, "the the the dog", "en", "b", 3, None),
    (3, None, None, None, None, None),
    (4, "", "en", "c", 4, None),
    (5, "1234 5678 -- <|endoftext|> </s> <s> it's  two   blanks \t\n tab ", "en", "a", 5, None),
    (6, "U+2581 ▁ inside", "fr", "a", 6, None),
    (7, "emoji \U0001f600 and é́ ideographs 漢字 zero​width  nbsp", "", "a", 7, None),
    (8, " " * 12_000 + "long blank" + "\n" * 12_000, "en", "a", 8, None),
    (9, "x" * 3_000 + " " + " ".join(f"w{i * i}q" for i in range(20_000)), "en", "a", 9, None),
    (10, "the cat", "en", "a", 10, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, slice long, term string")


def audited(rows, min_docs, top):
    """(lang, source, part, item, value, rank) from (text, lang, source)."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))) for text, lang, source in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= min_docs]
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in mine}}
        shares = {s: {t: 1 + 10**9 * (c[t] + 5) // (c.total() + 5 * len(kept)) for t in kept} for s, c in counts.items()}
        every = sum(counts.values(), Counter())
        whole = {t: 1 + 10**9 * (every[t] + 5) // (every.total() + 5 * len(kept)) for t in kept}
        for s in counts:
            pairs = [(o, sum(abs(shares[s][t] - shares[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, shares[s][t] - whole[t]) for t in kept if counts[s][t] and shares[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out[(lang, s, part, item, value, k + 1)] += 1
    return out


@pytest.mark.parametrize("slice_bytes, cells, sources", [(1 << 20, 1 << 20, 512), (60, 4, 1)])
def test_divergence_matches_brute_force(odd, monkeypatch, slice_bytes, cells, sources):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "SLICE", slice_bytes)
    got = Counter(tuple(r) for r in divergence.audit(odd, min_docs=2, top=3).collect())
    assert got == audited([(r[1], r[2], r[3]) for r in ODD], 2, 3)


def test_divergence_of_the_table(spark):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op11_divergence(spark, SMALL).collect()) == audited(rows, 30, 50)


def test_divergence_without_rows_or_terms(odd):
    assert divergence.audit(odd.limit(0)).count() == 0
    nothing = divergence.audit(odd.limit(1000))
    assert {(r.part, r.value) for r in nothing.collect()} == {("pair", 0)}


def aligned(rows):
    """Whole texts by both tokenizers, and dictionaries of counts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(os.path.join(token_align.TOKENIZERS, token_align.FILE_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(token_align.TOKENIZERS, token_align.FILE_B))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    name = {i: t for t, i in a.get_vocab().items()}
    counts, docs = Counter(), []
    for doc_id, text in rows:
        target = (" " + (text or "")).encode()
        ids_a = a.encode(target.decode(), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(byte_of[c] for c in name[i]) for i in ids_a]
        bytes_b = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not text or b"".join(bytes_a) != target or b"".join(bytes_b) != target:
            docs.append((doc_id, 0, 0, [], ""))
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            at, found = 0, []
            for p in parts:
                at += len(p)
                found.append(at)
            ends.append(found)
        both = sorted(set(ends[0]) & set(ends[1]))
        of_a, of_b = dict(zip(ends[0], ids_a)), dict(zip(ends[1], ids_b))
        links = [(of_a[e], of_b[e]) for e in both]
        counts.update(links)
        groups, i, j = [], 0, 0
        for e in both:
            part = [[], []]
            while i < len(ids_a) and ends[0][i] <= e:
                part[0].append(str(ids_a[i]))
                i += 1
            while j < len(ids_b) and ends[1][j] <= e:
                part[1].append(str(ids_b[j]))
                j += 1
            groups.append("|".join(",".join(p) for p in part))
        docs.append((doc_id, len(ids_a), len(ids_b), links, ";".join(groups)))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = Counter()
    for doc_id, n_a, n_b, links, groups in docs:
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        out[(doc_id, n_a, n_b, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest)] += 1
    return out, counts


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("shard, keys", [(1 << 16, 1 << 22), (5, 50)])
def test_alignment_matches_brute_force(odd, monkeypatch, shard, keys):
    monkeypatch.setattr(token_align, "SHARD", shard)
    monkeypatch.setattr(token_align, "KEYS", keys)
    scored, counts = token_align.align(odd.where("doc_id is null or doc_id <> 9") if shard == 5 else odd)
    want, pairs = aligned([(r[0], r[1]) for r in ODD if shard != 5 or r[0] != 9])
    assert Counter(tuple(r) for r in scored.select(COLUMNS).collect()) == want
    assert {(r.id_a, r.id_b): r.n for r in counts.collect()} == pairs
    assert counts.count() == len(pairs)


def test_alignment_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want, pairs = aligned(rows)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in queries.op12_token_alignment(spark, SMALL).collect()) == want
    assert len(pairs) < token_align.most_pairs()


def test_alignment_without_rows(odd):
    scored, counts = token_align.align(odd.limit(0))
    assert scored.count() == counts.count() == 0
