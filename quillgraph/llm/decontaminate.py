"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words and inserted into one automaton. Documents stream through it: the
state after each word tells the longest run of words, ending there, that occurs in some item. Runs of
``window`` words or more are hits, and so are whole items that are shorter than a window.

Most words can't be part of a hit. Hashes of all runs of q words (q: the shortest item, 4 at most) of the
items are a filter without misses: only maximal runs of document words that it covers are streamed.

The items are cut into blocks of at most ``block_bytes`` of text, each broadcast by itself; a block is one narrow pass over the
documents that adds to their hits, so a large benchmark costs more passes and never more memory. Of ties nothing depends on order; texts of any
length are streamed once a pass, and only their covered runs word by word; empty tables give no rows, an empty benchmark no hits.

Defined cases: null texts have no words; an item without words matches nothing; an item with a null id
is listed with an empty id; rows of one item id are one item; documents keep their rows, repeated or not; columns
called like those that ``find_overlaps`` adds are replaced there and kept by ``remove_overlaps``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialize
from .textkit import LOWER, Rolling, Words, find_words, slices, text_bytes, tidy

WINDOW = 10
BLOCK_BYTES = 1 << 20
#: After so many passes what is found so far is written, so plans stay short and workers hold few automata.
PASSES = 8
MIN_SPAN = 10
MAX_COVERAGE = 0.5

#: Bytes between words: ASCII other than digits and lower-case letters.
BREAK = np.zeros(256, bool)
BREAK[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("first", "last", "start", "end")]))


def item_words(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    words = find_words(data, np.array([0, len(data)]), BREAK)
    return [words.text(i) for i in range(len(words.start))]


class Automaton:
    """Suffix automaton of several sequences of words, with the items of each window."""

    def __init__(self, items: tuple[tuple[str, tuple[bytes, ...]], ...], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
        self.items: dict[int, set[str]] = {}
        #: state: whole short items that are a suffix of its longest string, as (length, name)
        self.short: dict[int, set[tuple[int, str]]] = {}
        for name, codes in coded:
            state = length = 0
            for code in codes:
                state, length = self.step(state, length, code)
                if length >= window:
                    self.items.setdefault(self.window_state(state), set()).add(name)
            if len(codes) < window:
                while self.length[self.link[state]] >= len(codes):
                    state = self.link[state]
                self.short.setdefault(state, set()).add((len(codes), name))
        #: the nearest state with short items on the way up, itself included; -1: none
        self.up = [-1] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.up[state] = state if state in self.short else self.up[self.link[state]] if state else -1
        self.least = min([window, *(len(codes) for _, codes in coded)])
        self.words = [words for _, words in items if words]

    def _extend(self, last: int, code: int) -> int:
        """Append a word after state ``last``; an existing transition is reused or split."""
        known = self.next[last].get(code)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, code, known)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and code not in self.next[at]:
            self.next[at][code] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][code]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, code, target)
        return new

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, code: int, target: int) -> int:
        copy = self._state(self.length[at] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while at >= 0 and self.next[at].get(code) == target:
            self.next[at][code] = copy
            at = self.link[at]
        return copy

    def step(self, state: int, length: int, code: int | None) -> tuple[int, int]:
        while state and code not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(code)
        return (0, 0) if to is None else (to, length + 1)

    def window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, codes: list[int | None]) -> Iterator[tuple[int, int, set[str]]]:
        """(end, length, items) of the hits that end at each place."""
        state = length = 0
        for end, code in enumerate(codes, 1):
            state, length = self.step(state, length, code)
            if length >= self.window:
                yield end, length, self.items[self.window_state(state)]
            at = self.up[state]
            while at >= 0:
                found = [(n, name) for n, name in self.short[at] if n <= length]
                if found:
                    yield end, max(n for n, _ in found), {name for _, name in found}
                at = self.up[self.link[at]] if at else -1


@lru_cache(maxsize=2)
def _prepared(items: tuple, window: int) -> tuple[Automaton, Rolling, Rolling, np.ndarray, int]:
    """Built once in a worker for each block of items."""
    automaton = Automaton(tuple((name, tuple(item_words(text))) for name, text in items), window)
    q = min(automaton.least, 4)
    by_byte, by_word = Rolling(11), Rolling(12)
    grams = []
    for words in automaton.words:
        ends = np.cumsum([len(w) for w in words])
        sums = by_byte.byte_sums(np.frombuffer(b"".join(words), np.uint8))
        hashes = by_byte.ranges(sums, np.r_[0, ends[:-1]], ends)
        n = np.arange(len(words) - q + 1)
        grams.append(by_word.ranges(by_word.sums(hashes), n, n + q))
    known = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
    return automaton, by_byte, by_word, known, q


def _runs(words: Words, by_byte: Rolling, by_word: Rolling, known: np.ndarray, q: int) -> list[tuple[int, int, int]]:
    """(document, first word, end) of maximal runs whose every q words occur in an item."""
    if len(words.start) < q or not len(known):
        return []
    hashes = by_byte.ranges(by_byte.byte_sums(words.data), words.start, words.end)
    at = np.arange(len(hashes) - q + 1)
    grams = by_word.ranges(by_word.sums(hashes), at, at + q)
    place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    doc = words.doc
    hit = np.flatnonzero((known[place] == grams) & (doc[at] == doc[at + q - 1]))
    if not len(hit):
        return []
    new = np.r_[True, (np.diff(hit) > 1) | (np.diff(doc[hit]) > 0)]
    first = hit[new]
    last = hit[np.r_[new[1:], True]] + q
    return list(zip(doc[first].tolist(), first.tolist(), last.tolist()))


def _scan(part: pa.RecordBatch, items: tuple, window: int) -> tuple[list, list, list]:
    """For each document of a slice: words, merged word ranges that are hit (relative to the document), items."""
    automaton, by_byte, by_word, known, q = _prepared(items, window)
    data, offsets = text_bytes(part.column("text"))
    words = find_words(LOWER[data], offsets, BREAK)
    n = np.diff(words.first)
    spans: list[list] = [[] for _ in n]
    names: list[set] = [set() for _ in n]
    for doc, a, b in _runs(words, by_byte, by_word, known, q):
        codes = [automaton.vocabulary.get(words.text(i)) for i in range(a, b)]
        for end, length, found in automaton.stream(codes):
            start, stop = a + end - length, a + end
            while spans[doc] and spans[doc][-1][0] >= start:
                spans[doc].pop()
            if spans[doc] and spans[doc][-1][1] >= start:
                spans[doc][-1][1] = stop
            else:
                spans[doc].append([start, stop])
            names[doc] |= found
    out = [
        [(s - words.first[d], e - words.first[d], words.start[s] - offsets[d], words.end[e - 1] - offsets[d]) for s, e in own]
        for d, own in enumerate(spans)
    ]
    return n.tolist(), out, names


def _merge(one: list, other: list) -> list:
    merged: list = []
    for s in sorted([*map(tuple, one), *map(tuple, other)]):
        if merged and s[0] < merged[-1][1]:
            if s[1] > merged[-1][1]:
                merged[-1] = (merged[-1][0], s[1], merged[-1][2], s[3])
        else:
            merged.append(s)
    return merged


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple]:
    """Tuples of (id, text) of at most ``block_bytes`` of text, or a single item; the driver holds one of them at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").where("text is not null")
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r.text) > block_bytes:
            yield tuple(sorted(block))
            block, size = [], 0
        block.append((r.i, r.text))
        size += len(r.text)
    yield tuple(sorted(block))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_match_words (long), match_spans and match_items.

    A span has its first word and the word after its last one, and the bytes from the start of the first to
    the end of the last. Spans that touch or overlap are one.
    """
    added = [T.StructField("n_match_words", T.LongType()), T.StructField("match_spans", SPANS), T.StructField("match_items", T.ArrayType(T.StringType()))]
    names = [f.name for f in added]
    out = docs = docs.drop(*names)
    context = docs.sparkSession.sparkContext
    for k, block in enumerate(_blocks(benchmark, block_bytes)):
        # a block goes to the executors' disks as a broadcast of bounded size, not into the plan
        shared = context.broadcast(block)
        if k and k % PASSES == 0:
            out = materialize(out, "benchmark-passes")

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, later=bool(k)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    n, spans, found = _scan(part, shared.value, window)
                    if later:
                        before = part.column("match_spans").to_pylist()
                        spans = [_merge([tuple(s.values()) for s in x or []], y) for x, y in zip(before, spans)]
                        found = [y | set(x or []) for x, y in zip(part.column("match_items").to_pylist(), found)]
                    own = [c for c in part.schema.names if c not in names]
                    spans = [[dict(zip(("first", "last", "start", "end"), map(int, s))) for s in x] for x in spans]
                    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("first", "last", "start", "end")]))
                    arrays = [pa.array(n, pa.int64()), pa.array(spans, kind), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *arrays], [*own, *names])

        out = out.mapInArrow(tidy(scan), T.StructType([*docs.schema.fields, *added]))
    return out


def match_words() -> str:
    """SQL of the number of words in the spans of a row."""
    return "aggregate(match_spans, 0L, (n, s) -> n + s.last - s.first)"


def remove_overlaps(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_span: int = MIN_SPAN, max_coverage: float = MAX_COVERAGE
) -> DataFrame:
    """``docs`` without spans of ``min_span`` words or more and without whole short items.

    Rows of which more than ``max_coverage`` of the words are hit go. n_chars, where there is such a
    column, is counted again. Untouched texts stay as they are, null included.
    """
    taken = {c: f"_in_{c}" for c in docs.columns if c in ("n_match_words", "match_spans", "match_items", "_was")}
    found = find_overlaps(docs.withColumnsRenamed(taken), benchmark, window)
    found = found.where(f"{match_words()} <= {max_coverage!r} * n_match_words").withColumn("_was", F.col("text"))
    schema = T.StructType([f for f in found.schema.fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("match_spans").to_pylist()):
                if spans:
                    raw, at, kept = texts[i].encode(), 0, []
                    for s in spans:
                        kept.append(raw[at : s["start"]])
                        at = s["end"]
                    texts[i] = b"".join([*kept, raw[at:]]).decode()
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    clean = found.mapInArrow(tidy(cut), schema)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text") != F.col("_was"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*[F.col(taken.get(c, c)).alias(c) for c in docs.columns])


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l
  FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT item_id, array_to_string(l[i:i + 9], ' ') AS s, least(10, len(l)) AS n
  FROM items, unnest(range(1, greatest(2, len(l) - 8))) AS r(i) WHERE len(l) > 0),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, n, array_to_string(l[i:i + n - 1], ' ') AS s FROM words, sizes, unnest(range(1, len(l) - n + 2)) AS r(i)),
hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(0, n)) AS r(k) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
