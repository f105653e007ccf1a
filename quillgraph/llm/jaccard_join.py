"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.8 or more, and their components.

Two sets of l and s shingles are that similar only if they differ in no more than (l + s) / 9 of them. Sizes are cut into bands, each 1.25
times the one before, so a set's partners of at most its own size lie in its band or the one below. The scheme of a band deals the universe of shingles by a hash into m segments, one
more than the largest difference of its pairs. Sets of the band are indexed: by the subset of shingles that falls into each segment, and, for a part of the segments, by
each such subset less one shingle. A larger set probes the index. For each segment it may skip (0 units), ask for an equal subset (1 unit), or for one
that differs by one shingle (2 units: its own subset and its one-deletion neighbours). If it asks for more units than the two sets can differ by, an equal or nearly equal subset must be found (pigeonhole). So every
allocation of that many units is complete, and each set takes the cheapest: costs are counts of the index's entries by cells of a hash, a table of a fixed size.

Before that, a set goes if more than a fifth of its shingles are in no other set: it can't reach 0.8 with any. A fixed part of the universe (``SAMPLED``) is counted for that,
and what goes by it would go by the whole as well. Equal sets are merged first. Sets that share an entry meet as stars: all with the entry's
first set, and all with its last. Entries whose sets are in one component are then settled. Of the others, large ones meet again in a few rounds, in which each entry has two hubs of its own; of those that stay open every pair from two components is
compared. A sketch of a set has the parity of its members in each of 512 cells: sketches that differ in more cells than two sets may differ in members
settle a pair for sure (short sketches where entries meet, ones of 4096 cells for the pairs that are left), so few pairs are compared in full. Those comparisons are exact intersections of the sets' 64-bit shingle hashes. So copies and near copies cost rows in proportion to their number, and no link that joins two components is lost.

Defined cases: a document without words, null included, has size 0 and is linked with nothing; fewer than five words are one shingle; rows of one
id are told apart by their sets; a row with a null id gets the least id of its component, null if there is none. Texts of any length are read whole. Ties don't
matter, for components don't depend on order. Sets are told apart by two 64-bit hashes. An empty table
gives no rows. Only ``doc_id`` and ``text`` are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .packed import BROADCAST_BYTES
from .simhash import _joined
from .storage import materialize
from .textkit import LOWER, Rolling, find_words, mixed, slices, text_bytes, tidy

U64 = np.uint64
SHINGLE = 5
SEED = 11
#: Sixteenths of the universe that are counted before the join.
SAMPLED = 5
#: Cells of the table of costs.
CELLS = 1 << 20
#: Sets up to this size have one-deletion neighbours in all segments, larger ones in one of THIN.
SMALL, THIN = 48, 12
#: Longs of a set's sketches, the short one a fold of the wide one; sets below WIDE_FROM have no wide one, for they are short themselves.
SKETCH, WIDE, WIDE_FROM = 8, 64, 96
#: Sets from this size on bring the wide sketch to where entries meet: the short one's cells are half full of their differences alone, so it settles few of their pairs.
WIDE_MEETS = 384
#: Rounds in which entries that are still open choose hubs of their own.
TURNS = 4
#: Entries up to so many rows are left out of these rounds: their pairs are at most eight a row, no more than two hubs in four rounds make.
FEW = 32
INDEX, DELETED, PROBE, PROBE_DELETED = 1, 2, 4, 8
ENTRY = "key long, h1 long, n int, role int"


def shingles(column: pa.Array, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice of texts, sorted within each document, and the offsets between documents."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    words = find_words(data, offsets)
    rolling = _rolling(seed)
    of_word = rolling.ranges(rolling.byte_sums(data), words.start, words.end)
    counts = np.diff(words.first)
    several = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(several)])
    begin = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], several)
    end = np.minimum(begin + SHINGLE, np.repeat(words.first[1:], several))
    hashes = rolling.ranges(rolling.sums(of_word), begin, end)
    doc = np.repeat(np.arange(len(counts)), several)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])][: len(hashes)]
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(counts) + 1))


@lru_cache(maxsize=2)
def _rolling(seed: int) -> Rolling:
    return Rolling(seed)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums between offsets, modulo 2**64."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, dtype=U64, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def set_hashes(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; neither depends on the order of its members."""
    return tuple(mixed(_sums(mixed(hashes ^ U64(salt)), first) + U64(salt)).view(np.int64) for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def _prints(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, first = shingles(part.column("text"), seed)
                h1, h2 = set_hashes(hashes, first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), pa.array(h1), pa.array(h2)], ["doc_id", "n", "h1", "h2"])

    return tidy(run)


def _sampled(seed: int):
    """The counted part of the universe: (token, h1) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, first = shingles(part.column("text"), seed)
                mine = np.repeat(set_hashes(hashes, first)[0], np.diff(first))
                some = (hashes & U64(15)) < SAMPLED
                yield pa.RecordBatch.from_arrays([pa.array(hashes[some].view(np.int64)), pa.array(mine[some])], ["token", "h1"])

    return tidy(run)


def sketches(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each set's members by parity: a row of WIDE longs."""
    out = np.zeros(((len(first) - 1), WIDE), U64)
    cell = ((hashes >> U64(16)) % U64(64 * WIDE)).astype(np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    np.bitwise_xor.at(out.reshape(-1), doc * WIDE + cell // 64, U64(1) << (cell % 64).astype(U64))
    return out


def _lists(m: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(m.view(np.int64).ravel()), m.shape[1]).cast(pa.list_(pa.int64()))


def _tokens(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, first = shingles(part.column("text"), seed)
                lists = pa.LargeListArray.from_arrays(pa.array(first), pa.array(hashes.view(np.int64))).cast(pa.list_(pa.int64()))
                wide = sketches(hashes, first)
                marks = [_lists(x) for x in (np.bitwise_xor.reduce(wide.reshape(len(wide), -1, SKETCH), axis=1), wide)]
                marks[1] = pa.compute.if_else(pa.array(np.diff(first) >= WIDE_FROM), marks[1], pa.scalar(None, marks[1].type))
                yield pa.RecordBatch.from_arrays([*map(pa.array, set_hashes(hashes, first)), lists, *marks], ["h1", "h2", "tokens", "sketch", "wide"])

    return tidy(run)


@lru_cache(maxsize=1)
def bands(most: int = 1 << 40) -> np.ndarray:
    """The least size of each band: each at least 1.25 times the one before."""
    out = [1]
    while out[-1] < most:
        out.append(-(-5 * out[-1] // 4))
    return np.array(out, np.int64)


def scheme(band: int) -> tuple[int, int, int]:
    """Of a band: its greatest size, its number of segments, and how many of them have one-deletion neighbours."""
    high = int(bands()[band + 1]) - 1
    m = high // 4 + 1
    return high, m, m if high <= SMALL else m // THIN


def subsets(tokens: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set's segments; its tokens by segment with the keys of what is left without each; where each segment begins."""
    _, m, _ = scheme(band)
    salt = U64(((band + 1) * 0xA0761D6478BD642F) & (2**64 - 1))
    value = mixed(tokens ^ salt)
    segment = ((value >> U64(33)).astype(np.int64) * m) >> 31
    order = np.argsort(segment, kind="stable")
    value, segment = value[order], segment[order]
    first = np.searchsorted(segment, np.arange(m + 1))
    total, count = _sums(value, first), np.diff(first).astype(U64)
    place = mixed(np.arange(m).astype(U64) + salt)
    keys = mixed(total * U64(0x2545F4914F6CDD1D) ^ place + count)
    less = mixed((total[segment] - value) * U64(0x2545F4914F6CDD1D) ^ place[segment] + count[segment] - U64(1))
    return keys, segment, less, first, count


def allocate(single: np.ndarray, double: np.ndarray, units: int) -> np.ndarray:
    """Units for each segment, ``units`` in all, at small cost: one costs ``single``, two ``double`` (infinite: not on offer)."""
    second = double - single
    pair = second < single  # two are cheaper than twice the first: both at half the price
    first_cost, second_cost = np.where(pair, double / 2, single), np.where(pair, double / 2, second)
    cost = np.stack([first_cost, second_cost], axis=1).ravel()
    chosen = np.argsort(cost, kind="stable")[:units]
    return np.bincount(chosen // 2, minlength=len(single))


def _index_rows(h1: int, tokens: np.ndarray, band: int):
    keys, segment, less, _, _ = subsets(tokens, band)
    thin = less[segment < scheme(band)[2]]
    return np.r_[keys, thin], np.r_[np.full(len(keys), INDEX), np.full(len(thin), DELETED)]


def _probe_rows(tokens: np.ndarray, band: int, costs: np.ndarray):
    """What a set asks of the index of a band: keys and roles."""
    high, _, thin = scheme(band)
    size = len(tokens)
    units = (size + min(size, high)) // 9 + 1
    keys, segment, less, _, _ = subsets(tokens, band)
    cell = U64(len(costs) - 1)
    single = costs[keys & cell].astype(np.float64) + 1e-3
    double = single + np.bincount(segment, costs[less & cell] + 1e-3, len(keys)) + 1e-3
    double[thin:] = np.inf
    taken = allocate(single, double, units)
    more = taken[segment] == 2
    return np.r_[keys[taken > 0], less[more]], np.r_[np.full((taken > 0).sum(), PROBE), np.full(more.sum(), PROBE_DELETED)]


def _entries(rows_of):
    """A task over (h1, tokens): rows of ENTRY; ``rows_of(h1, tokens, band)`` yields keys and roles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for h1, tokens in zip(batch.column("h1").to_numpy(), batch.column("tokens")):
                tokens = np.asarray(tokens.values).view(U64)
                band = int(np.searchsorted(bands(), len(tokens), "right")) - 1
                for keys, roles in rows_of(h1, tokens, band):
                    found.append((keys.view(np.int64), np.full(len(keys), h1), np.full(len(keys), len(tokens), np.int32), roles.astype(np.int32)))
                    held += len(keys)
                if held > 1 << 20:
                    yield _batch(found)
                    found, held = [], 0
            if found:
                yield _batch(found)

    return tidy(run)


def _batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(4)], ["key", "h1", "n", "role"])


def entries(sets: DataFrame, cells: int = CELLS) -> DataFrame:
    """(key, h1, n, role) of all sets that can have a partner; the index's entries are counted before sets probe it."""
    possible = sets.where("n > 3").select("h1", "tokens")  # smaller ones have no unequal partner; 4 of 5 shingles are one
    index = materialize(possible.mapInArrow(_entries(lambda h, t, b: [_index_rows(h, t, b)]), ENTRY), "index")
    counted = index.groupBy(F.col("key").bitwiseAND(F.lit(cells - 1)).alias("cell")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    costs = np.zeros(cells, np.float32)
    costs[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    sent = sets.sparkSession.sparkContext.broadcast(costs)

    def probes(h1, tokens, band):
        for own in (band, band - 1):
            if own >= 0 and (len(tokens) + min(len(tokens), scheme(own)[0])) // 9:
                yield _probe_rows(tokens, own, sent.value)

    return index.unionByName(materialize(possible.mapInArrow(_entries(probes), ENTRY), "probes"))


def _near(x: str, y: str, n: str, longs: int = SKETCH) -> str:
    """SQL: two sketches don't rule out that the sets, of ``n`` members together, are similar."""
    return f"9 * ({' + '.join(f'bit_count({x}[{k}] ^ {y}[{k}])' for k in range(longs))}) <= {n}"


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of sets that are similar: by their sketches first, then by exact intersection."""
    rough = [sets.select(F.col("h1").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"s_{c}")) for c in ("a", "b")]
    maybe = F.coalesce(F.expr(_near("s_a", "s_b", "(n_a + n_b)", WIDE)), F.lit(True))
    pairs = materialize(pairs.join(rough[0], "a").join(rough[1], "b").where(maybe).select("a", "b"), "near-pairs")
    # only sets of such pairs move
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct(), "near-ids")
    sets = sets.join(F.broadcast(ids) if ids.count() * 16 <= BROADCAST_BYTES else ids, "h1", "left_semi")
    left = sets.select(F.col("h1").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("h1").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
    return both.where(100 * F.col("i") >= 80 * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs that sizes allow, each once, the lesser first."""
    fit = pairs.where("a <> b and 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
    return fit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _asked(role: str) -> F.Column:
    return F.col(role).bitwiseAND(PROBE | PROBE_DELETED) > 0


def _open(every: DataFrame, found: DataFrame) -> DataFrame:
    """Entries (key, h1, n, role, root, rows) whose sets aren't all in one component yet; ``rows`` is what the entry has of them."""
    roots = connected_components(found)
    labelled = every.join(roots, every.h1 == roots.node, "left").select("key", "h1", "n", "role", F.coalesce(roots.root, "h1").alias("root"))
    labelled = materialize(labelled, "labelled-entries")
    open_ = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("rows")).where("low < high").select("key", "rows")
    return materialize(labelled.join(open_, "key"), "open-entries")


def links(sets: DataFrame, cells: int = CELLS) -> DataFrame:
    """Links (a, b) that join all sets (h1, n, tokens, sketch, wide) that are similar or joined by similar ones: a connected part has links enough, not all."""
    every = entries(sets, cells)
    has = [F.max(_asked("role")).alias("asked"), F.max(~_asked("role")).alias("indexed"), F.min("h1").alias("low"), F.max("h1").alias("high")]
    shared = every.groupBy("key").agg(*has).where("asked and indexed and low < high").select("key")
    every = materialize(every.join(shared, "key"), "shared-entries")
    ends = [(F.min, F.min_by, "low"), (F.max, F.max_by, "high")]
    stars = every.groupBy("key").agg(*(c for f, by, name in ends for c in (f("h1").alias(name), by("n", "h1").alias(f"n_{name}"))))
    hub = F.explode(F.array(*(F.struct(F.col(end).alias("b"), F.col(f"n_{end}").alias("n_b")) for end in ("low", "high"))))
    met = every.join(stars, "key").select(F.col("h1").alias("a"), F.col("n").alias("n_a"), hub.alias("hub")).select("a", "n_a", "hub.b", "hub.n_b")
    tried = materialize(_ordered(met), "star-pairs")
    found = materialize(_similar(tried, sets), "star-links")
    marks = sets.select("h1", "sketch", F.when(F.col("n") >= WIDE_MEETS, F.col("wide")).alias("wide"))
    open_, before = _open(every, found), None
    # each entry has hubs of its own now, so a set of a large group meets many others and not the same two
    for turn in range(TURNS):
        large = materialize(open_.where(F.col("rows") > FEW).join(marks, "h1"), "large-entries")
        size = large.count()
        if not size or before is not None and 10 * size > 9 * before:
            break  # a round that settles less than a tenth isn't worth another one
        before = size
        hubs = large.groupBy("key").agg(*(F.min_by(F.struct("h1", "n", "root", "sketch", "wide"), F.xxhash64("h1", "key", F.lit(2 * turn + k))).alias(f"hub{k}") for k in (0, 1)))
        met = large.join(hubs, "key").withColumn("hub", F.explode(F.array("hub0", "hub1"))).where("root <> hub.root")
        met = met.select(F.col("h1").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"), F.col("wide").alias("w_a"), F.col("hub.h1").alias("b"), F.col("hub.n").alias("n_b"), F.col("hub.sketch").alias("s_b"), F.col("hub.wide").alias("w_b"))
        met = met.where(_near("s_a", "s_b", "(n_a + n_b)")).where(F.coalesce(F.expr(_near("w_a", "w_b", "(n_a + n_b)", WIDE)), F.lit(True)))
        new = materialize(_ordered(met.select("a", "n_a", "b", "n_b")).join(tried, ["a", "b"], "left_anti"), "hub-pairs")
        joined = materialize(_similar(new, sets), "hub-links")
        tried = tried.unionByName(new)
        if not joined.count():
            break
        found = found.unionByName(joined)
        open_ = _open(open_, found)
    marked = materialize(open_.join(marks, "h1"), "marked-entries")
    asked, held = (marked.where(own).select("key", *(F.col(c).alias(f"{d}_{side}") for c, d in (("h1", "h1"), ("n", "n"), ("role", "role"), ("root", "root"), ("sketch", "s"), ("wide", "w")))) for side, own in (("a", _asked("role")), ("b", ~_asked("role"))))
    asked, held = asked.withColumnRenamed("h1_a", "a"), held.withColumnRenamed("h1_b", "b")
    rule = (asked.key == held.key) & (F.col("root_a") != F.col("root_b")) & (F.col("n_a") >= F.col("n_b")) & (5 * F.col("n_b") >= 4 * F.col("n_a"))
    rule &= ~((F.col("role_a") == PROBE_DELETED) & (F.col("role_b") == DELETED)) & F.expr(_near("s_a", "s_b", "(n_a + n_b)"))
    rule &= F.coalesce(F.expr(_near("w_a", "w_b", "(n_a + n_b)", WIDE)), F.lit(True))
    rest = _ordered(asked.join(held, rule).select("a", "n_a", "b", "n_b")).join(tried, ["a", "b"], "left_anti")
    return found.unionByName(materialize(_similar(materialize(rest, "other-pairs"), sets), "other-links"))


def _merged(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each row's set (doc_id, n, h1, h2), a row for each distinct set (h1, h2, n, least, rows), and names for sets that share their first hash with another one."""
    prints = materialize(docs.mapInArrow(_prints(seed), "doc_id long, n long, h1 long, h2 long"), "sets")
    merged = prints.where("n > 0").groupBy("h1", "h2").agg(F.max("n").alias("n"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    merged = materialize(merged, "distinct-sets")
    shared = merged.groupBy("h1").agg(F.min("h2").alias("low"), F.max("h2").alias("high")).where("low < high").select("h1", "low")
    # of 10**10 sets some three pairs share 64 bits: a list of a few rows
    twins = materialize(merged.join(shared, "h1").where("h2 <> low").select("h1", "h2", F.xxhash64("h1", "h2").alias("name")), "twins")
    return prints, merged, F.broadcast(twins)


def _named(sets: DataFrame, twins: DataFrame) -> DataFrame:
    """``sets`` with h1 a name that no other set has."""
    return sets.join(twins, ["h1", "h2"], "left").withColumn("h1", F.coalesce("name", "h1")).drop("h2", "name")


def _possible(docs: DataFrame, merged: DataFrame, twins: DataFrame, seed: int) -> DataFrame:
    """Sets (h1, n, tokens, sketch, wide) of which no more than a fifth of the members are in no other set."""
    tokens = docs.mapInArrow(_sampled(seed), "token long, h1 long").groupBy("token").agg(F.min("h1").alias("h1"), F.max("h1").alias("other"))
    alone = tokens.where("h1 = other").groupBy("h1").agg(F.count(F.lit(1)).alias("alone"))
    alive = materialize(merged.join(alone, "h1", "left").where("5 * coalesce(alone, 0) <= n").select("h1", "h2", "n", "least"), "possible-sets")
    size = alive.count()
    small = F.broadcast if size * 32 <= BROADCAST_BYTES else (lambda x: x)
    ids = alive.where("least is not null").select(F.col("least").alias("doc_id")).distinct()
    texts = docs.join(small(ids), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    members = texts.mapInArrow(_tokens(seed), "h1 long, h2 long, tokens array<bigint>, sketch array<bigint>, wide array<bigint>").join(small(alive.select("h1", "h2", "n")), ["h1", "h2"])
    return materialize(_named(members.dropDuplicates(["h1", "h2"]), twins), "members")


def groups(docs: DataFrame, seed: int = SEED, cells: int = CELLS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    prints, merged, twins = _merged(docs, seed)
    roots = connected_components(links(_possible(docs, merged, twins, seed), cells))
    merged = _named(merged, twins)
    by_root = merged.join(roots, merged.h1 == roots.node, "left").select("h1", "least", "rows", F.coalesce("root", "h1").alias("root"))
    by_root = materialize(by_root, "roots")
    ids = by_root.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    by_set = materialize(_joined(by_root.select("root", "h1", "rows"), ids, "root", merged.count()).select("h1", "component_id", F.col("rows").alias("n")), "groups")
    rows = _named(prints.withColumnRenamed("n", "n_shingles"), twins).select("doc_id", "n_shingles", "h1")
    with_words = _joined(rows.where("n_shingles > 0"), by_set, "h1", prints.count())
    without = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_words.select("doc_id", "n_shingles", "component_id").unionByName(without)


SQL = r"""
with recursive docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
    from documents
),
members as (
    select distinct doc_id, array_to_string(words[i : i + 4], ' ') as shingle
    from (select doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) as i from docs where len(words) > 0)
),
sizes as (select doc_id, count(*) as n from members group by doc_id),
common as (
    select a.doc_id as a, b.doc_id as b, count(*) as i
    from members a join members b on a.shingle = b.shingle and a.doc_id <> b.doc_id
    group by all
),
links as (
    select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * i >= 80 * (x.n + y.n - i)
),
reach as (
    select a, b from links
    union
    select r.a, l.b from reach r join links l on l.a = r.b
)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id)) as component_id
from docs d left join sizes s using (doc_id) left join (select a, min(b) as least from reach group by a) r on r.a = d.doc_id
"""
