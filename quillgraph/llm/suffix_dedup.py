"""Suffix-array deduplication: bytes covered by 400-byte strings that also start somewhere else.

(1) Candidate search without misses. Of every ``gap`` consecutive places of a text, the one whose 16-byte gram
has the least hash is an anchor, so equal strings have equal anchors at equal places. An anchor is filed
under the hash of the bytes that all strings it is chosen for share (``window`` - ``gap`` + 1 of them),
with a second hash of all bytes that these strings can reach. Sorted runs of these entries meet by parts of
the key space. Where both hashes repeat, all strings of the anchor are hits; where only the first one does, it is a candidate.
(2) Shards. The strings of candidates form segments of texts. Each shard (the segments of 1 MB of text) gets a
suffix array by Larsson-Sadakane refinement, then common prefixes by Kasai's rule; suffixes that share
``window`` bytes are one string of the shard. Of anchors that are hits already but share their first hash with a
candidate, one for each second hash takes part as well.
(3) Cross-shard merging. The strings of a shard, once each, form a sorted run of 128-bit hashes; for each
part of the key space the runs are merged by binary search, and strings in two shards, or twice in one, are hits.

A string that comes back in a task is sent once from it, so a passage that a third of all documents share
reaches its part once for each task; marks of places go back to their documents only.

Defined cases: a null text is empty; texts shorter than ``window`` keep all bytes; rows with equal id and text
repeat each other; null ids are told apart by their texts; what stays may be cut inside a character, so it is binary. Texts of any length are read
whole; of equal strings all go, whatever their order; an empty table gives no rows; columns called like working ones (``marks``, ``strings``, ``_row``) are kept, those called
like added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packed import CANDIDATE, ENTRY, HIT, U64, WITNESS, Anchors, batch_of, entry_rows, grouped, mark_lists, mark_rows, parts_for, passed_marks, runs_of, unpack
from .storage import put_back, set_aside
from .textkit import BLANK, Rolling, covered, mixed, slices, text_bytes

WINDOW = 400
GAP = 64
GRAM = 16
#: Passages of more than this many words are told apart from shorter repetitions by strings of so many bytes.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200
#: Bytes of text that are hashed at once: their arrays take some 100 bytes for each.
SLICE = 1 << 20
#: Entries that a task holds before it sends them.
HELD = 1 << 19


class _Anchors(Anchors):
    """Anchors of a slice's texts, by bytes."""

    def __init__(self, window: int, gap: int) -> None:
        self.size = (window, gap)
        self.rolls = [Rolling(s) for s in (31, 32)]

    def load(self, column: pa.Array) -> None:
        self.data, self.offsets = text_bytes(column)
        self.sums = [r.byte_sums(self.data) for r in self.rolls]
        at = np.arange(max(0, len(self.data) - GRAM + 1))
        self.place(self.offsets, self.rolls[0].ranges(self.sums[0], at, at + GRAM), *self.size)

    def hashes(self, at: np.ndarray, length: int, which: int) -> np.ndarray:
        return self.rolls[which].ranges(self.sums[which], at, at + length)


def _settled(h1, h2, doc, at, parts: int) -> Iterator[tuple]:
    """Rows of a task's anchors: each pair of hashes once, with whether it has it twice; its other places as hits."""
    h1, h2, doc, at, group, _ = grouped(h1, h2, doc, at)
    if len(h1):
        first = np.r_[True, np.diff(group) > 0]
        many = np.bincount(group)[group] > 1
        yield from entry_rows(h1[first], h2[first], doc[first], (at * 2 + many)[first], 0, parts)
        yield from mark_rows(doc[~first], h1[~first], (at * 4 + HIT)[~first], parts)


def _scan(window: int, gap: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held = _Anchors(window, gap), []
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                anchors.load(part.column("text"))
                if not len(anchors.starts):
                    continue
                at, doc, number = anchors.anchors()
                first, last = anchors.reach(at, doc)
                second = mixed(anchors.rolls[1].ranges(anchors.sums[1], first, last) + (at - first).astype(U64))
                held.append((anchors.hashes(at, window - gap + 1, 0), second, part.column("id").to_numpy()[doc], number))
                if sum(len(x[0]) for x in held) > HELD:
                    yield batch_of(list(_settled(*(np.concatenate(x) for x in zip(*held)), parts)))
                    held = []
        if held:
            yield batch_of(list(_settled(*(np.concatenate(x) for x in zip(*held)), parts)))

    return run


def _merge_anchors(parts: int):
    """Of a part: marks of anchors whose first hash repeats."""

    def run(table: pa.Table) -> pa.Table:
        rows, runs = passed_marks(table), runs_of(table)
        h1, h2, doc, at = shared_entries(runs) if runs else (np.zeros(0, U64),) * 4
        if len(h1):
            outer = np.r_[True, h1[1:] != h1[:-1]]
            inner = outer | np.r_[True, h2[1:] != h2[:-1]]
            g1, g2 = np.cumsum(outer) - 1, np.cumsum(inner) - 1
            repeated = (np.bincount(g2)[g2] > 1) | (np.bincount(g2, at & 1)[g2] > 0)
            mixed_class = np.bincount(g1, inner)[g1] > 1
            kind = np.where(repeated, np.where(mixed_class & inner, WITNESS, HIT), CANDIDATE)
            rows += mark_rows(doc, h1, (at >> 1) * 4 + kind, parts)
        return pa.Table.from_batches([batch_of(rows)])

    return run


def shared_entries(runs: list[tuple]) -> tuple:
    """The entries of sorted runs whose first hash is there twice, by binary search, or that say so (lowest bit of the place); sorted by both hashes."""
    every = np.sort(np.concatenate([r[0] for r in runs]))
    shared = [(np.searchsorted(every, r[0], "right") - np.searchsorted(every, r[0], "left") > 1) | (r[3] & 1 > 0) for r in runs]
    h1, h2, doc, at = (np.concatenate([r[i][s] for r, s in zip(runs, shared)]) for i in range(4))
    order = np.lexsort((h2, h1))
    return h1[order], h2[order], doc[order], at[order]


def suffix_array(data: np.ndarray, end: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of all suffixes that stop at the end of their segment, their ranks, and the eight bytes at each place.

    Larsson-Sadakane: sort by a prefix, then split groups of equal prefixes of length h by the rank of what
    stands h further on, doubling h, until each group is one suffix. Suffixes of equal content are ordered by segment.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U64)
    words = np.zeros(n, U64)
    for k in range(8):
        words = (words << U64(8)) | padded[k : k + n]
    left = end - np.arange(n)
    short = np.minimum(left, 7)
    first = (words >> U64(8)) >> (U64(8) * (7 - short).astype(U64)) << (U64(8) * (7 - short).astype(U64))
    key = (first << U64(8)) | short.astype(U64)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n, np.int64)
    group = np.flatnonzero(head)
    rank[order] = group[np.cumsum(head) - 1]
    segments = int(segment[-1]) + 1 if n else 0
    alone = head & np.r_[head[1:], True]
    place = np.flatnonzero(~alone)  # places of the order that aren't settled
    h = 7
    while len(place):
        at = order[place]
        beyond = at + h
        inside = beyond < end[at]
        second = np.where(inside, segments + rank[np.minimum(beyond, n - 1)], segment[at])
        split = np.lexsort((second, rank[at]))
        at, second = at[split], second[split]
        order[place] = at
        own = rank[at]
        fresh = np.r_[True, (own[1:] != own[:-1]) | (second[1:] != second[:-1])]
        rank[at] = place[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        single = fresh & np.r_[fresh[1:], True]
        place = place[~single]
        h *= 2
    return order, rank, words


def common_prefixes(data: np.ndarray, end: np.ndarray, start: np.ndarray, order: np.ndarray, rank: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Bytes that each suffix of the order shares with the one before it.

    Kasai's rule: a place that continues its neighbour's match shares one byte less than the place before it, so
    only places where a match begins are compared, eight bytes at a time.
    """
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    has = before >= 0
    follows = has & (at > start) & (before > start[before]) & np.r_[False, before[:-1] >= 0]
    follows[1:] &= data[at[1:] - 1] == data[np.maximum(before[1:] - 1, 0)]
    begins = np.flatnonzero(has & ~follows)
    length = np.zeros(len(begins), np.int64)
    limit = np.minimum(end[begins] - begins, end[before[begins]] - before[begins])
    open_ = np.flatnonzero(limit > 0)
    while len(open_):
        a, b = begins[open_] + length[open_], before[begins[open_]] + length[open_]
        differ = words[a] ^ words[b]
        same = np.full(len(open_), 8)
        for k in range(8):
            same[(differ >> U64(8 * (7 - k))) > 0] = np.minimum(same[(differ >> U64(8 * (7 - k))) > 0], k)
        length[open_] += same
        open_ = open_[(same == 8) & (length[open_] < limit[open_])]
    reach = np.zeros(n, np.int64)
    reach[begins] = np.minimum(length, limit) + begins
    reach[~has] = at[~has]
    shared = np.maximum(0, np.maximum.accumulate(reach) - at)
    out = np.zeros(n, np.int64)
    out[rank] = np.where(has, np.minimum(shared, end - at), 0)
    return out


def repeated_strings(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A number for each string data[s : s + window]; equal ones have equal numbers. ``starts`` ascend."""
    breaks = np.r_[True, np.diff(starts) > 1]
    first, last = starts[breaks], starts[np.r_[breaks[1:], True]] + window
    size = last - first
    end = np.cumsum(size)
    begin = end - size
    segment = np.repeat(np.arange(len(size)), size)
    own = np.repeat(first - begin, size) + np.arange(end[-1])
    block = data[own]
    order, rank, words = suffix_array(block, end[segment], segment)
    shared = common_prefixes(block, end[segment], begin[segment], order, rank, words)
    number = np.cumsum(shared < window)
    places = starts - (first - begin)[np.cumsum(breaks) - 1]
    return number[rank[places]]


def _shards(window: int, gap: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held = _Anchors(window, gap), []
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                anchors.load(part.column("text"))
                if not len(anchors.starts):
                    continue
                kind = anchors.kinds(part.column("marks").to_pylist())
                own = np.flatnonzero(kind >= CANDIDATE)
                if not len(own):
                    continue
                s, doc, known = anchors.starts[own], anchors.doc[own], kind[own] == WITNESS
                number = repeated_strings(anchors.data, s, window)
                order = np.argsort(number, kind="stable")
                s, doc, number, known = s[order], doc[order], number[order], known[order]
                first = np.r_[True, number[1:] != number[:-1]]
                group = np.cumsum(first) - 1
                several = (np.bincount(group) > 1) | (np.bincount(group, known) > 0)
                own = part.column("id").to_numpy()[doc]
                at = s - anchors.offsets[doc]
                rows = list(mark_rows(own[~first], number[~first].astype(U64), at[~first], parts))
                if rows:
                    yield batch_of(rows)
                held.append((anchors.hashes(s[first], window, 0), anchors.hashes(s[first], window, 1), own[first], at[first] * 2 + several))
                if sum(len(x[0]) for x in held) > HELD:
                    yield batch_of(list(_once(*(np.concatenate(x) for x in zip(*held)), parts)))
                    held = []
        if held:
            yield batch_of(list(_once(*(np.concatenate(x) for x in zip(*held)), parts)))

    return run


def _once(h1, h2, doc, at, parts: int) -> Iterator[tuple]:
    """A task's strings, each once, with whether it has it twice; its other places as marks."""
    h1, h2, doc, at, group, _ = grouped(h1, h2, doc, at)
    first = np.r_[True, np.diff(group) > 0]
    many = (np.bincount(group)[group] > 1) | (np.bincount(group, at & 1)[group] > 0)
    yield from entry_rows(h1[first], h2[first], doc[first], (at >> 1 << 1 | many)[first], 0, parts)
    yield from mark_rows(doc[~first], h1[~first], (at >> 1)[~first], parts)


def _merge_strings(parts: int):
    """Of a part: marks of strings that several shards have, or one has twice."""

    def run(table: pa.Table) -> pa.Table:
        rows, runs = passed_marks(table), runs_of(table)
        h1, h2, doc, at = shared_entries(runs) if runs else (np.zeros(0, U64),) * 4
        if len(h1):
            g = np.cumsum(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) - 1
            hit = (np.bincount(g)[g] > 1) | (np.bincount(g, at & 1)[g] > 0)
            rows += mark_rows(doc[hit], h1[hit], (at >> 1)[hit], parts)
        return pa.Table.from_batches([batch_of(rows)])

    return run


def _cut(window: int, gap: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))
        anchors = _Anchors(window, gap)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                anchors.load(part.column("text"))
                found = [anchors.starts[anchors.kinds(part.column("marks").to_pylist()) % 2 == 1]] if len(anchors.starts) else []
                for d, blobs in enumerate(part.column("strings").to_pylist()):
                    found += [unpack(b, True).astype(np.int64) + anchors.offsets[d] for b in blobs or []]
                gone = covered(np.concatenate([*found, np.zeros(0, np.int64)]), window, len(anchors.data))
                removed, spans, left = [], [], []
                # words that begin before each byte
                solid = ~BLANK[anchors.data]
                begun = np.r_[0, np.cumsum(solid & np.r_[True, ~solid[:-1]])] if len(solid) else np.zeros(1, np.int64)
                for a, b in zip(anchors.offsets[:-1], anchors.offsets[1:]):
                    own = gone[a:b]
                    turns = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8))).reshape(-1, 2)
                    removed.append(int(own.sum()))
                    spans.append([{"start": int(x), "end": int(y), "words": int(begun[a + y] - begun[a + x])} for x, y in turns])
                    left.append(anchors.data[a:b][~own].tobytes())
                arrays = [pa.array(np.diff(anchors.offsets)), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(left, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *arrays], [*names, "n_bytes", "n_removed", "spans", "kept"])

    return run


def remove_repeated(docs: DataFrame, window: int = WINDOW, gap: int = GAP, parts: int | None = None) -> DataFrame:
    """``docs`` less text, with n_bytes, n_removed (long), spans (byte ranges, with the words that begin in them) and kept (binary)."""
    added = ("n_bytes", "n_removed", "spans", "kept")
    docs, aside = set_aside(docs, {"_row", "id", "marks", "strings"})
    names = [c for c in docs.columns if c != "text" and c not in added]
    own = docs.select(*names, "text").withColumn("_row", F.xxhash64("doc_id", "text"))
    texts = own.select(F.col("_row").alias("id"), "text").where(F.octet_length("text") >= window)
    parts = parts or parts_for(texts)
    found = texts.mapInArrow(_scan(window, gap, parts), ENTRY).groupBy("part").applyInArrow(_merge_anchors(parts), ENTRY)
    marks = mark_lists(found, "anchor-marks", "marks")
    shards = texts.join(marks, "id").mapInArrow(_shards(window, gap, parts), ENTRY)
    strings = mark_lists(shards.groupBy("part").applyInArrow(_merge_strings(parts), ENTRY), "string-marks", "strings")
    marked = own.join(marks.withColumnRenamed("id", "_row"), "_row", "left").join(strings.withColumnRenamed("id", "_row"), "_row", "left")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("words", T.IntegerType())]))
    kinds = [T.LongType(), T.LongType(), span, T.BinaryType()]
    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, k) for c, k in zip(added, kinds))])
    return put_back(marked.select(*names, "text", "marks", "strings").mapInArrow(_cut(window, gap, names), schema), aside)


def repeated_passages(docs: DataFrame, more_than: int = PASSAGE_WORDS, window: int = PASSAGE_BYTES) -> DataFrame:
    """(doc_id, n_passage_words): the words of a document in passages of more than ``more_than`` words that strings of ``window`` bytes cover which
    also start elsewhere. Only documents that have some; rows of one id are one document, of which the greatest number counts; none for null ids."""
    found = remove_repeated(docs.select("doc_id", "text"), window)
    words = F.expr(f"aggregate(spans, 0L, (n, s) -> n + if(s.words > {more_than}, s.words, 0))")
    return found.where("doc_id IS NOT NULL").select("doc_id", words.alias("w")).where("w > 0").groupBy("doc_id").agg(F.max("w").alias("n_passage_words"))
