"""Sorted entries of hashes, packed: what deduplication operators send between tasks.

A row of ENTRY holds many entries (two hashes, a document, a place) of one part of the key space, sorted
by the first hash and compressed. Rows of role 1 are marks: places of documents, dealt by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .textkit import sliding_min

U64 = np.uint64
#: Lists of marks are broadcast up to this size; beyond it they are joined by id.
BROADCAST_BYTES = 48 << 20
#: Bytes of text whose entries make a part of the key space.
PART_BYTES = 8 << 20
#: What the marks of anchors say: all its windows are hits, it is a candidate, or a hit whose windows are compared too.
HIT, CANDIDATE, WITNESS = 1, 2, 3
ENTRY = "part int, role int, h1 binary, h2 binary, doc binary, at binary"
NAMES = ["part", "role", "h1", "h2", "doc", "at"]


def pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit values by planes of equal significance, as differences if they ascend."""
    if ascending and len(x):
        x = np.diff(x, prepend=x.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(b: bytes, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if ascending else x


def entry_rows(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, at: np.ndarray, role: int, parts: int) -> Iterator[tuple]:
    """Rows of ENTRY for entries that are sorted by h1."""
    part = (h1 >> U64(32)).astype(np.int64) * parts >> 32
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for a, b in zip(cuts, [*cuts[1:], len(part)]):
        yield int(part[a]), role, pack(h1[a:b], True), pack(h2[a:b]), pack(doc[a:b].view(U64)), pack(at[a:b].view(U64))


def mark_rows(doc: np.ndarray, h1: np.ndarray, at: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows of ENTRY with role 1, dealt by document and sorted by it."""
    part = doc.view(U64) * U64(0x9E3779B97F4A7C15) >> U64(32)
    part = (part.astype(np.int64) * parts) >> 32
    order = np.lexsort((doc, part))
    doc, h1, at, part = doc[order], h1[order], at[order], part[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for a, b in zip(cuts, [*cuts[1:], len(part)]):
        yield int(part[a]), 1, pack(h1[a:b]), b"", pack(doc[a:b].view(U64)), pack(at[a:b].view(U64))


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], NAMES)


def grouped(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple:
    """Entries sorted by hash and document; where a hash begins; each entry's hash number and its least document."""
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
    new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] if len(h1) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    return h1, h2, doc, at, group, doc[new][group] if len(h1) else doc


def passed_marks(table: pa.Table) -> list[tuple]:
    return [tuple(r[n] for n in NAMES) for r in table.to_pylist() if r["role"] == 1]


def runs_of(table: pa.Table, role: int = 0) -> list[tuple]:
    """The sorted runs of a part: (h1, h2, doc, at) for each row of ``role``."""
    rows = [r for r in table.to_pylist() if r["role"] == role]
    return [(unpack(r["h1"], True), unpack(r["h2"]), unpack(r["doc"]).view(np.int64), unpack(r["at"]).view(np.int64)) for r in rows]


def _by_document(table: pa.Table) -> pa.Table:
    """Of a part of documents: a row (id, at) for each document, with its marks packed."""
    doc = np.concatenate([unpack(b).view(np.int64) for b in table.column("doc").to_pylist()])
    at = np.concatenate([unpack(b) for b in table.column("at").to_pylist()])
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    lists = [pack(np.unique(at[a:b]), True) for a, b in zip(cuts, [*cuts[1:], len(doc)])]
    return pa.table({"id": pa.array(doc[cuts], pa.int64()), "at": pa.array(lists, pa.binary())})


def mark_lists(merged: DataFrame, name: str, column: str) -> DataFrame:
    """(id, ``column``): each document's marks, written once; a small table is broadcast.

    Marks travel packed and meet by parts of documents, so there is a row for each document, however many tasks marked it.
    """
    rows = merged.where("role = 1").select("part", "doc", "at").groupBy("part").applyInArrow(_by_document, "id long, at binary")
    lists = materialize(rows.select("id", F.array("at").alias(column)), name)
    size = lists.agg(F.sum(96 + F.length(F.col(column)[0]))).first()[0]
    return F.broadcast(lists) if (size or 0) <= BROADCAST_BYTES else lists


def parts_for(docs: DataFrame) -> int:
    """Parts of the key space for entries of ``docs``, by their bytes of text."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return int(max(16, -(-total // PART_BYTES)))


class Anchors:
    """Anchors of sequences that lie one after another, between ``offsets``.

    Of every ``gap`` consecutive places, the first one with the least hash is an anchor. ``starts`` has the places where
    whole windows start, ``own`` the anchor of each, ``doc`` its sequence. Anchors are numbered within their sequence.
    """

    def place(self, offsets: np.ndarray, hashes: np.ndarray, window: int, gap: int) -> None:
        self.edges, self.window, self.gap = offsets, window, gap
        whole = np.maximum(0, np.diff(offsets) - window + 1)
        first = np.cumsum(whole) - whole
        self.doc = np.repeat(np.arange(len(whole)), whole)
        self.starts = np.arange(whole.sum()) + np.repeat(offsets[:-1] - first, whole)
        self.first, self.number = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.own, self.kept = self.starts, np.zeros(0, np.int64)
        if len(self.starts):
            bits = U64(max(len(hashes).bit_length(), 24))
            least = sliding_min((hashes >> bits << bits) | np.arange(len(hashes)).astype(U64), gap)
            self.own = (least[self.starts] & ((U64(1) << bits) - U64(1))).astype(np.int64)
            new = np.r_[True, (np.diff(self.own) != 0) | (np.diff(self.doc) != 0)]
            self.kept = np.flatnonzero(new)
            self.number = np.cumsum(new) - 1
            self.first = np.searchsorted(self.doc[self.kept], np.arange(len(whole) + 1))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, sequences and numbers of all anchors."""
        doc = self.doc[self.kept]
        return self.own[self.kept], doc, np.arange(len(doc)) - self.first[doc] if len(doc) else doc

    def reach(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges that the windows of these anchors can reach."""
        return np.maximum(self.edges[doc], at - self.gap + 1), np.minimum(self.edges[doc + 1], at + self.window)

    def kinds(self, marks: list) -> np.ndarray:
        """What the marks of each sequence (packed lists, or None) say of the anchors of ``starts``; 0: nothing."""
        kind = np.zeros(len(self.kept) + 1, np.int8)
        for d, blobs in enumerate(marks):
            for blob in blobs or []:
                at = unpack(blob, True).astype(np.int64)
                at = at[(at >> 2) < self.first[d + 1] - self.first[d]]  # another row of the same id may be longer
                place = (at >> 2) + self.first[d]
                kind[place] = np.maximum(kind[place], at & 3)
        return kind[self.number]
