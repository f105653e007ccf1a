"""Incremental deduplication of 13-word windows with a log-structured index of window hashes.

Of every nine consecutive places of a text, the first one with the least five-word hash is an anchor: equal
windows have equal anchors at equal places. An anchor is filed under the hash of its five words, with a second hash of
all words that its windows can reach. The index is a list of immutable runs: Parquet tables with a row of
sorted, packed entries for each part of the key space, one entry for each pair of hashes and its first document.

A batch is added in three steps. (1) Its entries are sorted, grouped by part and merged with all runs. Where
both hashes have an earlier document, all windows of the anchor are hits; where only the first hash is shared, the first
document of each pair is a candidate. (2) Candidates are verified: texts are read again, and the windows of
candidate anchors are compared by two independent 64-bit hashes of all 13 words; a window that also starts in a document
with a smaller id is a hit. (3) New pairs become a run. When there would be ``fan_out`` runs, the same merge writes
all entries as one run instead, and the old runs are removed. Batches must come in ascending order of ids; one that doesn't raises ValueError.

A task sends a pair, or a window, only for the least document that it has of it: other documents are settled there. So a
passage that a third of all documents holds reaches its part once for each task.

Defined cases: null texts have no words; null ids count as larger than all others (which are below 2**62), in the order of a
hash of their texts; rows with the same id don't remove each other's words, and hits of that id hold for all its rows that have such
places; white space between words isn't compared. Texts of any length are read whole; of equal windows in one document
none removes another; an empty table gives no rows; columns called like working ones (``marks``, ``places``, ``_id``) are kept, those called like added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packed import CANDIDATE, ENTRY, HIT, U64, Anchors, batch_of, entry_rows, grouped, mark_lists, mark_rows, parts_for, passed_marks, runs_of, unpack
from .storage import new_path, put_back, remove, set_aside
from .textkit import Rolling, covered, find_words, mixed, slices, text_bytes

WINDOW = 13
GRAM = 5
FAN_OUT = 2
#: Null ids become numbers from here on, by a hash of the text.
BEYOND = 1 << 62
SLICE = 1 << 20
#: Entries that a task holds before it sends them.
HELD = 1 << 19
#: Roles of rows: entries of the batch, marks, entries of runs as read, entries of the run that is written.
NEW, MARK, OLD, STORED = 0, 1, 2, 3


class _Windows(Anchors):
    """Anchors of a slice's texts, by words, and hashes of ranges of words."""

    def __init__(self, window: int, gram: int) -> None:
        self.size, self.gram = (window, window - gram + 1), gram
        self.rolls = [(Rolling(a), Rolling(b)) for a, b in ((21, 22), (23, 24))]

    def load(self, column: pa.Array) -> None:
        data, offsets = text_bytes(column)
        self.words = words = find_words(data, offsets)
        self.sums = [by_word.sums(by_byte.ranges(by_byte.byte_sums(data), words.start, words.end)) for by_byte, by_word in self.rolls]
        at = np.arange(max(0, len(words.start) - self.gram + 1))
        self.place(words.first, self.hashes(at, at + self.gram, 0), *self.size)

    def hashes(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        return self.rolls[which][1].ranges(self.sums[which], start, end)


def _least_only(h1, h2, doc, at, parts: int, mark: int) -> Iterator[tuple]:
    """A task's entries of the least document of each pair of hashes; those of other documents are marks (times 4 plus ``mark``, if any)."""
    h1, h2, doc, at, _, least = grouped(h1, h2, doc, at)
    first = doc == least
    yield from entry_rows(h1[first], h2[first], doc[first], at[first], NEW, parts)
    yield from mark_rows(doc[~first], h1[~first], at[~first] * 4 + mark if mark else at[~first], parts)


def _sent(pieces: Iterator[tuple], parts: int, mark: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for piece in pieces:
        held.append(piece)
        if sum(len(x[0]) for x in held) > HELD:
            yield batch_of(list(_least_only(*(np.concatenate(x) for x in zip(*held)), parts, mark)))
            held = []
    if held:
        yield batch_of(list(_least_only(*(np.concatenate(x) for x in zip(*held)), parts, mark)))


def _scan(window: int, gram: int, parts: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        windows = _Windows(window, gram)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                windows.load(part.column("text"))
                at, doc, number = windows.anchors()
                first, last = windows.reach(at, doc)
                second = mixed(windows.hashes(first, last, 1) + (at - first).astype(U64))
                yield windows.hashes(at, at + gram, 0), second, part.column("id").to_numpy()[doc], number

    return lambda batches: _sent(pieces(batches), parts, HIT)


def _merge_anchors(parts: int, all_stored: bool):
    """Of a part: marks of anchors, and the entries of the run that is written: new pairs, or all of them."""

    def run(table: pa.Table) -> pa.Table:
        rows = passed_marks(table)
        new, old = runs_of(table, NEW), runs_of(table, OLD)
        if new or old:
            columns = [np.concatenate([r[i] for r in new + old]) for i in range(4)]
            fresh = np.repeat([1, 0], [sum(len(r[0]) for r in new), sum(len(r[0]) for r in old)])
            h1, h2, doc, at, pair, least = grouped(*columns[:3], columns[3] * 2 + fresh)
            fresh, at = at & 1, at >> 1
            outer = np.r_[True, h1[1:] != h1[:-1]]
            key = np.cumsum(outer) - 1
            pairs = np.bincount(key, np.r_[True, np.diff(pair) > 0])[key]
            lowest, highest = np.minimum.reduceat(doc, np.flatnonzero(outer))[key], np.maximum.reduceat(doc, np.flatnonzero(outer))[key]
            hit = (doc > least) & (fresh > 0)
            candidate = (doc == least) & (pairs > 1) & (lowest < highest) & (np.bincount(key, fresh)[key] > 0)
            marked = hit | candidate
            rows += mark_rows(doc[marked], h1[marked], (at * 4 + np.where(hit, HIT, CANDIDATE))[marked], parts)
            known = np.bincount(pair, 1 - fresh)[pair] > 0
            kept = (doc == least) & ((fresh == 0) | ~known) & ((fresh > 0) | all_stored)
            rows += entry_rows(h1[kept], h2[kept], doc[kept], at[kept], STORED, parts)
        return pa.Table.from_batches([batch_of(rows)])

    return run


def _verify(window: int, gram: int, parts: int):
    """Of documents with candidates: full hashes of the windows of these anchors, with their first words."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        windows = _Windows(window, gram)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                windows.load(part.column("text"))
                if not len(windows.starts):
                    continue
                own = np.flatnonzero(windows.kinds(part.column("marks").to_pylist()) == CANDIDATE)
                s, doc = windows.starts[own], windows.doc[own]
                yield windows.hashes(s, s + window, 0), windows.hashes(s, s + window, 1), part.column("id").to_numpy()[doc], s - windows.edges[doc]

    return lambda batches: _sent(pieces(batches), parts, 0)


def _merge_windows(parts: int):
    """Of a part: places of windows that also start in a document with a smaller id."""

    def run(table: pa.Table) -> pa.Table:
        rows, runs = passed_marks(table), runs_of(table)
        if runs:
            h1, _, doc, at, _, least = grouped(*(np.concatenate([r[i] for r in runs]) for i in range(4)))
            hit = doc > least
            rows += mark_rows(doc[hit], h1[hit], at[hit], parts)
        return pa.Table.from_batches([batch_of(rows)])

    return run


def _cut(window: int, gram: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(window, gram)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                windows.load(part.column("text"))
                edges, words = windows.edges, windows.words
                found = [windows.starts[windows.kinds(part.column("marks").to_pylist()) == HIT]] if len(windows.starts) else []
                for d, blobs in enumerate(part.column("places").to_pylist()):
                    for b in blobs or []:
                        at = unpack(b, True).astype(np.int64)
                        found.append(at[at <= edges[d + 1] - edges[d] - window] + edges[d])
                gone = covered(np.concatenate([*found, np.zeros(0, np.int64)]), window, len(words.start))
                texts, removed, spans = [], [], []
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    own = gone[a:b]
                    texts.append(b" ".join(words.text(i) for i in (np.flatnonzero(~own) + a).tolist()))
                    removed.append(int(own.sum()))
                    turns = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8))).reshape(-1, 2)
                    spans.append([{"first": int(x), "last": int(y)} for x, y in turns])
                arrays = [pa.array(np.diff(edges)), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *arrays], [*names, "n_words", "n_removed", "spans", "kept_text"])

    return run


class WindowIndex:
    """The runs of one corpus. ``add`` takes batches in ascending order of ids and returns their results."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, parts: int = 64, fan_out: int = FAN_OUT) -> None:
        self.spark, self.window, self.gram, self.parts, self.fan_out = spark, window, gram, parts, fan_out
        self.runs: list[str] = []
        self.most: int | None = None  #: the greatest id so far

    def add(self, docs: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
        """``docs`` less text, with n_words, n_removed, spans (word ranges) and kept_text. ``earlier`` has the documents added before."""
        docs, aside = set_aside(docs, {"_id", "id", "marks", "places"})
        size = (self.window, self.gram, self.parts)
        keyed = lambda df: df.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit(BEYOND - 1)) + F.lit(BEYOND)))
        least, most, nulls = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
        if least is not None or nulls:
            least = BEYOND if least is None else least
            if self.most is not None and (least < self.most or self.most == BEYOND):
                raise ValueError(f"batches come in ascending order of ids, null ids last: {least} after {self.most}")
            self.most = BEYOND if nulls else most
        light = lambda df: keyed(df).select(F.col("_id").alias("id"), "text")
        entries = light(docs).mapInArrow(_scan(*size), ENTRY)
        for path in self.runs:
            stored = self.spark.read.schema(entries.schema).parquet(path).where(f"role = {STORED}")
            entries = entries.unionByName(stored.withColumn("role", F.lit(OLD)))
        compacts = len(self.runs) + 1 >= self.fan_out
        path = new_path(self.spark, "window-run")
        entries.groupBy("part").applyInArrow(_merge_anchors(self.parts, compacts), ENTRY).write.option("compression", "uncompressed").parquet(path)
        marks = mark_lists(self.spark.read.schema(entries.schema).parquet(path), "anchor-marks", "marks")
        if compacts:
            for old in self.runs:
                remove(self.spark, old)
        self.runs = [path] if compacts else [*self.runs, path]
        texts = light(docs) if earlier is None else light(docs).unionByName(light(earlier))
        windows = texts.join(marks, "id").mapInArrow(_verify(*size), ENTRY).groupBy("part").applyInArrow(_merge_windows(self.parts), ENTRY)
        hits = mark_lists(windows, "window-marks", "places")
        names = [c for c in docs.columns if c not in ("text", "n_words", "n_removed", "spans", "kept_text")]
        marked = keyed(docs).join(marks.withColumnRenamed("id", "_id"), "_id", "left").join(hits.withColumnRenamed("id", "_id"), "_id", "left")
        schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "n_words long, n_removed long, spans array<struct<first: int, last: int>>, kept_text string"])
        return put_back(marked.select(*names, "text", "marks", "places").mapInArrow(_cut(self.window, self.gram, names), schema), aside)


def deduplicate(docs: DataFrame, batches: int = 2, **options) -> DataFrame:
    """All documents, added in ``batches`` ranges of ids."""
    index = WindowIndex(docs.sparkSession, **{"parts": parts_for(docs), **options})
    cuts = docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    bounds = sorted({int(c) for c in cuts})
    out = None
    for k in range(len(bounds) + 1):
        after = F.col("doc_id") > bounds[k - 1] if k else F.lit(True)
        own = docs.where(after & (F.col("doc_id") <= bounds[k])) if k < len(bounds) else docs.where(after | F.col("doc_id").isNull())
        result = index.add(own, docs.where(F.col("doc_id") <= bounds[k - 1]) if k else None)
        out = result if out is None else out.unionByName(result)
    return out


SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(l[i:i + 12], ' ') AS s FROM words, unnest(range(1, len(l) - 11)) AS r(i)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (
  SELECT doc_id, list(DISTINCT i + k) AS places FROM windows JOIN firsts USING (s), unnest(range(0, 13)) AS r(k)
  WHERE doc_id > first GROUP BY doc_id),
judged AS (
  SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: NOT coalesce(list_contains(places, i), false)) AS kept
  FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(l)::BIGINT AS n_words, (len(l) - len(kept))::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_transform(kept, lambda i: l[i]), ' '), '')) AS kept_sha256
FROM judged
"""
