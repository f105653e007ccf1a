"""SimHash near-duplicates: tiled exact comparison of all distinct fingerprints.

A fingerprint has a bit where more than half the XXH64 values (seed 42) of the text's four-word shingles
have it. Fingerprints within ``radius`` bits are linked, and components of links are the groups.

Equal fingerprints are merged first, so copies never meet as pairs. Distinct ones are dealt into tiles of about ``tile``
by the population counts of their four quarters: the counts' histogram (of 17**4 classes at most, whatever the input) is laid out
in order, and cut every ``tile`` fingerprints. A difference of r bits moves the four counts by r in sum, so pairs of tiles whose counts
lie further apart are skipped; the pairs are planned by a join of the tiles' bounds, and a pair is a task. Inside it,
blocks whose counts differ by more than the radius are skipped in the same way, all others are compared by exclusive-or and bit
counts. A task returns a spanning forest of its links, never the pairs.

Defined cases: a text without words, null included, has fingerprint zero and links like any other; fewer
than four words are one shingle; rows with the same id are one document in the groups; a row with a null id has its
fingerprint and the component's least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import connected_components
from .storage import materialize
from .textkit import LOWER, find_words, slices, text_bytes, tidy

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Tiles have about a TILES-th of the fingerprints each, so a fingerprint is sent to no more than TILES tasks, but at most
#: MOST of them, so that a task holds two lists of 2 MB; below LEAST a task isn't worth its start.
TILES, LEAST, MOST = 64, 1 << 11, 1 << 18
#: A class of rows that has more than this part of them is joined apart; there are no more such classes than its inverse.
HOT = 1 / 1024
BLOCK = 1024
BITS = np.array([((np.arange(256) >> b) & 1) for b in range(8)], np.uint8).T.copy()


def fingerprints_of(column: pa.Array, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprints of a slice of texts, as unsigned 64-bit integers."""
    import xxhash

    data, offsets = text_bytes(column)
    words = find_words(LOWER[data], offsets)
    counts = np.diff(words.first)
    # words joined by one space each: shingles are ranges of this string
    lengths = words.end - words.start
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths + 1, out=at[1:])
    joined = np.full(at[-1], 0x20, np.uint8)
    from_word = np.repeat(words.start - at[:-1], lengths)
    place = np.ones(at[-1], bool)
    place[at[1:] - 1] = False
    place = np.flatnonzero(place)
    joined[place] = words.data[place + from_word]
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(shingles, out=first[1:])
    begin = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], shingles)
    end = np.minimum(begin + size, np.repeat(words.first[1:], shingles))
    whole, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(whole[a:b], seed) for a, b in zip(at[begin].tolist(), (at[end] - 1).tolist())), np.uint64, len(begin))
    out = np.zeros(len(counts), np.uint64)
    bits = np.arange(64, dtype=np.uint64)
    step = 1 << 14
    sums = np.zeros((len(counts), 64), np.int64)
    doc = np.repeat(np.arange(len(counts)), shingles)
    for a in range(0, len(hashes), step):
        part = BITS[hashes[a : a + step].astype("<u8").view(np.uint8)].reshape(-1, 64)
        own = doc[a : a + step]
        edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sums[own[edges]] += np.add.reduceat(part, edges, axis=0, dtype=np.int64)
    out = ((sums * 2 > shingles[:, None]).astype(np.uint64) << bits).sum(axis=1, dtype=np.uint64)
    return out


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            prints = fingerprints_of(part.column("text")).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's 64 bits as a signed integer."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(tidy(_hash_batches), "doc_id long, fp long")


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((x >> np.uint64(16 * q)) & np.uint64(0xFFFF)) for q in range(4)], axis=1).astype(np.int16)


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b), as least indices: minimum of both ends, then pointer jumping."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def linked(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside ``left``, or between it and ``right``, as pairs of fingerprints."""

    def arranged(x):
        q = _quarters(x)
        order = np.lexsort(q.T[::-1])
        x, q = x[order], q[order]
        cuts = np.arange(0, len(x), block)
        return x, cuts, np.minimum.reduceat(q, cuts, axis=0), np.maximum.reduceat(q, cuts, axis=0)

    if not len(left) or right is not None and not len(right):
        return left[:0], left[:0]
    x, cx, lx, hx = arranged(left)
    y, cy, ly, hy = (x, cx, lx, hx) if right is None else arranged(right)
    shift = 0 if right is None else len(x)
    label = np.arange(len(x) + (0 if right is None else len(y)))
    for i, a in enumerate(cx):
        # least possible sum of the differences between the counts of quarters of two blocks
        gap = np.maximum(np.maximum(ly - hx[i], lx[i] - hy), 0).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            if right is None and j < i:
                continue
            b = cy[j]
            near = np.bitwise_count(x[a : a + block, None] ^ y[None, b : b + block]) <= radius
            if right is None and i == j:
                near = np.triu(near, 1)
            r, c = np.nonzero(near)
            if len(r):
                label = _roots(len(label), r + a, c + b + shift, label)
    both = x if right is None else np.concatenate([x, y])
    child = np.flatnonzero(label != np.arange(len(label)))
    return both[child], both[label[child]]


def _tiles(prints: DataFrame, tile: int) -> DataFrame:
    """(tile, fps, low, high): lists of about ``tile`` fingerprints, with the bounds of their quarters' population counts."""
    quarters = F.array(*[F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)])
    located = prints.select("fp", quarters.alias("q"))
    # 17**4 rows at most, so the running sum and the broadcast are bounded
    sizes = located.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("before", F.sum("n").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.coalesce("before", F.lit(0)) + F.pmod(F.xxhash64("fp"), F.col("n"))
    dealt = located.join(F.broadcast(sizes), "q").select("fp", "q", F.floor(place / tile).cast("int").alias("tile"))
    bounds = [F.array(*[f(F.col("q")[k]) for k in range(4)]).alias(name) for name, f in (("low", F.min), ("high", F.max))]
    return dealt.groupBy("tile").agg(F.collect_list("fp").alias("fps"), *bounds)


def _pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """(a, b), a <= b: tiles whose bounds are no more than ``radius`` apart. They meet along the first count, not each with all."""
    bounds = tiles.select("tile", "low", "high")
    one = bounds.select(F.col("tile").alias("a"), F.col("low").alias("l"), F.col("high").alias("h"), F.explode(F.sequence(F.col("low")[0], F.col("high")[0])).alias("c"))
    reach = F.explode(F.sequence(F.col("low")[0] - radius, F.col("high")[0] + radius))
    other = bounds.select(F.col("tile").alias("b"), F.col("low").alias("l2"), F.col("high").alias("h2"), reach.alias("c"))
    gap = sum((F.greatest(F.lit(0), F.col("l2")[k] - F.col("h")[k], F.col("l")[k] - F.col("h2")[k]) for k in range(4)), F.lit(0))
    return one.join(other, "c").where((F.col("a") <= F.col("b")) & (gap <= radius)).select("a", "b").distinct()


def links(prints: DataFrame, radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) within ``radius`` bits of each other."""
    if tile is None:
        tile = min(max(prints.count() // TILES, LEAST), MOST)
    tiles = materialize(_tiles(prints, tile), "tiles")
    pairs = materialize(_pairs(tiles, radius), "tile-pairs")
    sides = pairs.select("a", "b", F.col("a").alias("tile")).unionByName(pairs.where("a < b").select("a", "b", F.col("b").alias("tile")))
    # tasks of many comparisons and few bytes: their number follows the pairs, not the bytes
    sent = sides.join(tiles.select("tile", "fps"), "tile").repartition(max(1, pairs.count() // 4), "a", "b")

    def compare(rows: pa.Table) -> pa.Table:
        lists = [np.asarray(x.values).view(np.uint64) for x in rows.column("fps").combine_chunks()]
        a, b = linked(lists[0], lists[1] if len(lists) > 1 else None, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return sent.groupBy("a", "b").applyInArrow(compare, "a long, b long")


def _joined(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """``left`` joined to ``right``, which has each key once and how many rows of ``left`` have it (n); keys with a great part of ``rows`` are
    broadcast (1 / HOT of them at most), so that none is a single task."""
    hot = right.where(F.col("n") > HOT * rows).drop("n")
    mine = left.join(F.broadcast(hot), key)
    others = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col("n") <= HOT * rows).drop("n"), key)
    return mine.unionByName(others)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    prints = materialize(fingerprints(docs), "fingerprints")
    merged = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = connected_components(links(merged.select("fp"), radius, tile))
    groups = materialize(merged.join(roots, merged.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "roots")
    ids = groups.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    by_print = _joined(groups.select("root", "fp", F.col("n").alias("m")), ids, "root", merged.count())
    by_print = materialize(by_print.select("fp", "component_id", F.col("m").alias("n")), "groups")
    return _joined(prints, by_print, "fp", prints.count()).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents whose id is the least of their group; rows without an id stay, for nothing tells them apart."""
    groups = near_duplicates(docs, radius)
    later = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)
