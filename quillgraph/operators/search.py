"""Full-text and vector search over whole tables, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import cut_lineage
from ..functions.text import cosine, dot, quantized, scale_of, tokens

K1, B, RRF_K = 1.2, 0.75, 60
#: Queries of a block, vectors that meet it at once, and blocks that one scan of the vectors is asked for (16,384 queries).
QUERY_BLOCK, ROW_BLOCK, SCAN_BLOCKS = 1024, 2048, 16
#: Neighbours in a row of a hub's list, rows of lists of a block of nodes, and neighbours of a hub that is heavy.
LIST_ROWS, BLOCK_ROWS, HEAVY = 1 << 16, 2 << 20, 128


def searchable(nodes: DataFrame) -> DataFrame:
    """(id, text) of nodes: the label and the values of its properties."""
    return nodes.select(F.col("label").alias("id"), F.concat_ws(" ", "label", F.map_values("props")).alias("text"))


def bm25(docs: DataFrame, query: str, limit: int | None = 10, where: Column | str | None = None) -> DataFrame:
    """(id, score) of texts that hold a word of the query, best first; ``where`` is a condition on ``docs`` that is met before any text is read.

    Only the query's words are counted, within each row and once; the counts are a small table, from which the corpus statistics (one
    row of sums) and the scores are taken, so no posting list is shuffled.
    """
    words = sorted({w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()})
    if not words:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    docs = docs if where is None else docs.where(where)
    asked = ", ".join(f"'{w}'" for w in words)
    counted = docs.withColumn("_t", tokens("text")).select("id", F.size("_t").alias("_n"), F.expr(f"transform(array({asked}), q -> size(filter(_t, t -> t = q)))").alias("_f"))
    counted = cut_lineage(counted)
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("_n").alias("length"), *[F.count_if(F.col("_f")[i] > 0).alias(f"d{i}") for i in range(len(words))]).first()
    if not stats.n:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    norm = K1 * (1 - B + B * F.col("_n") / F.lit(float(stats.length or 1)))
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.ln(1 + (F.lit(float(stats.n)) - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5))
        score = score + idf * F.col("_f")[i] * (K1 + 1) / (F.col("_f")[i] + norm)
    hits = counted.where("exists(_f, f -> f > 0)").select("id", F.round(score, 6).alias("score"))
    return hits.orderBy(F.desc("score"), "id").limit(limit) if limit else hits


def knn(vectors: DataFrame, query: list[float], limit: int | None = 10) -> DataFrame:
    """(id, score): exact cosine similarity; the query is a literal in the plan, so vectors are only scanned."""
    scored = vectors.withColumn("_q", F.array(*map(F.lit, query))).select("id", F.round(F.expr(cosine("embedding", "_q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit) if limit else scored


def quantize(vectors: DataFrame) -> DataFrame:
    """``vectors`` with q (int8) and q_scale: q times q_scale is about the vector."""
    return vectors.withColumns({"q_scale": F.expr(scale_of("embedding")), "q": F.expr(quantized("embedding"))})


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.where("id IS NOT NULL AND exists(embedding, x -> x <> 0)")


def _best(query: np.ndarray, ids: np.ndarray, key: np.ndarray, score: np.ndarray, limit: int) -> tuple[np.ndarray, ...]:
    """For each query its ``limit`` rows of the greatest key, the least id of equals."""
    order = np.lexsort((ids, -key, query))
    start = np.searchsorted(query[order], query[order], side="left")
    order = order[np.arange(len(order)) - start < limit]
    return query[order], ids[order], key[order], score[order]


def _nearest(vectors: DataFrame, queries: DataFrame, keep: int, compare) -> DataFrame:
    """(query, id, key, score): for each row of ``queries`` the ``keep`` rows of the greatest key among all of ``vectors``.

    Blocks of queries are broadcast, several for one scan, and every task returns its own best rows of each; only these are shuffled. ``compare`` takes
    columns of both sides as matrices to (key, score), each queries by rows; a key of -inf is no candidate.
    """
    columns = [c for c in vectors.columns if c != "id"]
    context = vectors.sparkSession.sparkContext

    def scan(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = sent.value
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)) for _ in blocks]
            for batch in batches:
                for at in range(0, batch.num_rows, ROW_BLOCK):
                    part = batch.slice(at, ROW_BLOCK)
                    ids = part.column("id").to_numpy(zero_copy_only=False)
                    rows = {c: _matrix(part.column(c)) for c in columns}
                    for b, (_, own) in enumerate(blocks):
                        key, score = compare(own, rows)
                        key = np.round(key, 6)
                        n = min(keep, len(ids))
                        least = -np.partition(-key, n - 1, axis=1)[:, n - 1 : n]
                        q, r = np.nonzero((key >= least) & (key > -np.inf))
                        best[b] = _best(*(np.concatenate(x) for x in zip(best[b], (q, ids[r], key[q, r], np.round(score[q, r], 6)))), keep)
            for (names, _), found in zip(blocks, best):
                yield pa.RecordBatch.from_arrays([pa.array(names[found[0]], pa.int64()), *map(pa.array, found[1:])], ["query", "id", "key", "score"])

        return run

    def scanned(blocks: list) -> DataFrame:
        return vectors.mapInArrow(scan(context.broadcast(blocks)), "query long, id long, key double, score double")

    def block(rows: list) -> tuple:
        return np.array([r.id for r in rows], dtype=np.int64), {c: np.array([list(r[c]) for r in rows], dtype=np.float64) for c in columns}

    found, blocks, rows = None, [], []
    for row in queries.select("id", *columns).toLocalIterator():
        rows.append(row)
        if len(rows) == QUERY_BLOCK:
            blocks, rows = [*blocks, block(rows)], []
        if len(blocks) == SCAN_BLOCKS:
            found, blocks = scanned(blocks) if found is None else found.unionByName(scanned(blocks)), []
    blocks = [*blocks, block(rows)] if rows else blocks
    if blocks:
        found = scanned(blocks) if found is None else found.unionByName(scanned(blocks))
    if found is None:
        return vectors.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("key"), F.lit(0.0).alias("score")).limit(0)
    return _first(found, "key", keep)


def _first(found: DataFrame, by: str, limit: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(by), "id"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def _cosines(own: dict, rows: dict) -> np.ndarray:
    return _unit(own["embedding"]) @ _unit(rows["embedding"]).T


def knn_block(vectors: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query, id, score): ``knn`` for every row of ``queries`` (id, embedding)."""

    def compare(own: dict, rows: dict):
        score = _cosines(own, rows)
        return score, score

    return _nearest(_usable(vectors), _usable(queries), limit, compare).select("query", "id", "score")


def rank_fusion(*ranked: DataFrame, k: int = RRF_K, limit: int = 10) -> DataFrame:
    """(id, score): sum of 1 / (k + rank) over lists of (id, score), as from ``bm25`` and ``knn`` with a limit."""
    lists = None
    for r in ranked:
        own = r.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("_rank"))
        lists = own if lists is None else lists.unionByName(own)
    fused = lists.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("_rank"))), 6).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(limit)


def rank_fusion_block(texts: DataFrame, nearest: DataFrame, queries: DataFrame, k: int = RRF_K, limit: int = 10) -> DataFrame:
    """(query, id, score): ``rank_fusion`` of one list of texts (id, score) with each query's list (query, id, score)."""
    each = queries.select(F.col("id").alias("query")).crossJoin(F.broadcast(texts.select("id", "score")))
    ranked = [r.select("query", "id", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")).alias("_rank")) for r in (each, nearest)]
    fused = ranked[0].unionByName(ranked[1]).groupBy("query", "id").agg(F.round(F.sum(1.0 / (k + F.col("_rank"))), 6).alias("score"))
    return _first(fused, "score", limit)


def autocomplete(types: DataFrame, text: str) -> DataFrame:
    """Types that hold the text, where case, spaces and dashes don't count."""
    folded = lambda c: F.regexp_replace(F.lower(c), r"[\s-]", "_")
    return types.where(folded("type").contains(folded(F.lit(text))))


def _lists(near: DataFrame) -> DataFrame:
    """(hub, names, asked, heavy, bits, n): the neighbours of each hub of ``near`` (a, hub, d, asked, heavy, bits), those of a large one in several rows."""
    chunk = F.pmod(F.xxhash64("a"), F.ceil(F.col("d") / LIST_ROWS))
    rows = near.groupBy("hub", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("a", "asked", "heavy", "bits"))).alias("_l"))
    return rows.select("hub", F.expr("_l.a").alias("names"), F.expr("_l.asked").alias("asked"), F.expr("_l.heavy").alias("heavy"), F.expr("_l.bits").alias("bits"), F.size("_l").alias("n"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (part, a, n) of a part in blocks of neighbouring ones, which have some ``BLOCK_ROWS`` rows of lists together."""
    done = 0
    for batch in batches:
        upto = done + np.cumsum(batch.column("n").to_numpy())
        if len(upto):
            block = (batch.column("part").to_numpy().astype(np.int64) << 32) + upto // BLOCK_ROWS
            done = int(upto[-1])
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(block)], ["a", "block"])


def _pairs(least: int):
    """A task over a block: its nodes' hubs (a, hub, d) and these hubs' lists."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("of")
        names = right.column("names").combine_chunks()
        codes = names.flatten().dictionary_encode()
        known, code = codes.dictionary, codes.indices.to_numpy()
        size = len(known)
        asked, heavy, bits = np.zeros(size, bool), np.zeros(size, np.int64), np.zeros(size, np.uint64)
        asked[code] = right.column("asked").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        heavy[code] = right.column("heavy").combine_chunks().flatten().to_numpy()
        bits[code] = right.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64)
        rank = np.empty(size, np.int64)
        rank[pc.sort_indices(known).to_numpy()] = np.arange(size)
        lengths = pc.list_value_length(names).to_numpy()
        hubs = right.column("of").combine_chunks().dictionary_encode()
        several = np.bincount(hubs.indices.to_numpy(), minlength=len(hubs.dictionary)).astype(np.int64)
        first, total = np.cumsum(several) - several, np.cumsum(np.r_[0, lengths])
        # a hub's lists are neighbours, so they are one run of codes
        place = pc.index_in(left.column("hub").combine_chunks(), value_set=hubs.dictionary).to_numpy(zero_copy_only=False)
        a = pc.index_in(left.column("a").combine_chunks(), value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(a, kind="stable")
        place, a, weight = place[order], a[order], 1 / np.log(left.column("d").to_numpy()[order])
        start, n = total[first[place]], total[first[place] + several[place]] - total[first[place]]
        linked = pc.index_in(left.column("hub").combine_chunks(), value_set=known).fill_null(-1).to_numpy()[order].astype(np.int64)
        linked = (a * size + linked)[linked >= 0]
        ends = np.flatnonzero(np.r_[a[1:] != a[:-1], True]) + 1
        upto, out, at = np.cumsum(n), [], 0
        while at < len(a):
            # whole nodes, one at least
            most = np.searchsorted(upto[ends - 1], (upto[at - 1] if at else 0) + BLOCK_ROWS, side="right")
            end = max(ends[most - 1] if most else 0, ends[np.searchsorted(ends, at, side="right")])
            own = n[at:end]
            lie = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(start[at:end], own)
            key, inverse, common = np.unique(np.repeat(a[at:end], own) * size + code[lie], return_inverse=True, return_counts=True)
            score = np.bincount(inverse, np.repeat(weight[at:end], own), len(key))
            x, y = key // size, key % size
            # heavy hubs whose bit the other one lacks aren't shared
            shared = np.minimum(heavy[x] - np.bitwise_count(bits[x] & ~bits[y]), heavy[y] - np.bitwise_count(bits[y] & ~bits[x]))
            good = (x != y) & (~asked[y] | (rank[x] < rank[y])) & (common + shared >= least)
            good[good] = ~np.isin(key[good], linked)
            out.append((x[good], y[good], common[good], score[good]))
            at = end
        x, y, common, score = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [()] * 4))
        return pa.table({"x": known.take(pa.array(x)), "y": known.take(pa.array(y)), "common": pa.array(common.astype(np.int64)), "score": pa.array(score.astype(np.float64))})

    return run


def _met(one: DataFrame, lists: DataFrame, least: int) -> DataFrame:
    """(x, y, common, score): each pair of a node of ``one`` (a, hub, d) and another one of its hubs' lists once, where ``common`` and their heavy hubs make ``least``.

    Nodes are dealt to blocks, and each list goes once to every block that asks for it; pairs are made and counted in the block's task, so none is shuffled.
    """
    lists = cut_lineage(lists)
    sizes = one.join(lists.groupBy("hub").agg(F.sum("n").alias("n")), "hub").groupBy("a").agg(F.sum("n").alias("n"))
    dealt = sizes.repartitionByRange("a").sortWithinPartitions("a").withColumn("part", F.spark_partition_id())
    dealt = cut_lineage(dealt.select("part", "a", "n").mapInArrow(_blocks, "a string, block long"))
    left = cut_lineage(one.join(dealt, "a").select("block", "a", "hub", "d"))
    right = left.select("block", "hub").distinct().join(lists, "hub").select(F.col("block").alias("of_block"), F.col("hub").alias("of"), "names", "asked", "heavy", "bits")
    return left.groupBy("block").cogroup(right.groupBy("of_block")).applyInArrow(_pairs(least), "x string, y string, common long, score double")


def link_candidates(edges: DataFrame, asked: DataFrame | None = None, least: int = 1) -> DataFrame:
    """(a, b, common, score): pairs without an edge that share ``least`` neighbours or more, by the Adamic-Adar sum over all hubs.

    With ``asked`` (label), the pairs that have one of these at least. Degrees are always those of the whole graph. A pair is made and counted in one task (``_met``).

    Where all nodes are asked for several common neighbours, a node's ``least`` - 1 largest hubs of more than ``HEAVY`` neighbours make no pairs: of the hubs that a pair
    shares, ordered by size, the first that are dropped are less than ``least``, so one is left. Pairs that the other hubs, the number of heavy ones and 64 bits of these
    allow are counted anew over all hubs of the one that has fewer.
    """
    ends = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends = cut_lineage(ends)
    near = ends.select("a", F.col("b").alias("hub")).unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("hub")))
    degree = cut_lineage(near.groupBy("hub").agg(F.count(F.lit(1)).alias("d")).where("d >= 2"))
    if asked is not None:
        named = cut_lineage(asked.select(F.col("label").alias("a")).distinct())
        one = cut_lineage(near.join(named, "a", "left_semi").join(degree, "hub").select("a", "hub", "d"))
        # only the hubs of these nodes have lists
        near = near.join(named.withColumn("asked", F.lit(True)), "a", "left").join(one.select("hub", "d").distinct(), "hub")
        met = _met(one, _lists(near.withColumns({"asked": F.coalesce("asked", F.lit(False)), "heavy": F.lit(0), "bits": F.lit(0).cast("long")})), least)
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "common", "score")
    near = near.join(degree, "hub").withColumn("asked", F.lit(True))
    if least == 1:
        met = _met(near.select("a", "hub", "d"), _lists(near.withColumns({"heavy": F.lit(0), "bits": F.lit(0).cast("long")})), 1)
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "common", "score")
    large = F.col("d") > HEAVY
    near = near.join(degree.where(F.col("d") >= least).select(F.col("hub").alias("a")), "a", "left_semi")
    every, by_size = Window.partitionBy("a"), Window.partitionBy("a").orderBy(F.desc("d"), "hub")
    bit = F.when(large, F.expr("shiftleft(1L, cast(pmod(xxhash64(hub), 64) AS int))")).otherwise(F.lit(0).cast("long"))
    near = near.withColumns({"place": F.row_number().over(by_size), "heavy": F.sum(large.cast("int")).over(every).cast("int"), "bits": F.bit_or(bit).over(every), "n": F.count(F.lit(1)).over(every)})
    near = cut_lineage(near)
    kept = near.where(~(large & (F.col("place") < least)))
    pairs = cut_lineage(_met(kept.select("a", "hub", "d"), _lists(kept), least).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).join(ends, ["a", "b"], "left_anti")
    sizes = near.groupBy("a").agg(F.first("n").alias("n"))
    sized = pairs.join(sizes, "a").join(sizes.select(F.col("a").alias("b"), F.col("n").alias("_n")), "b")
    fewer = F.col("n") <= F.col("_n")
    sized = sized.select("a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("_one"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("_other"))
    both = sized.join(near.select(F.col("a").alias("_one"), "hub", "d"), "_one").join(near.select(F.col("a").alias("_other"), "hub"), ["_other", "hub"], "left_semi")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.sum(1 / F.ln("d")).alias("score")).where(F.col("common") >= least)
