"""An inverted-file index of vectors: lists around k-means centres, int8 codes apart from the floats, and searches that read only what they probe.

The centres are fitted on a bounded sample; every vector is then put into the list of its nearest centre and both tables are written partitioned by list: ``codes``
(id, q) and ``floats`` (id, embedding). A query goes to its nearest lists. Only those lists' codes are read, by partition pruning; they meet the
queries in tasks of bounded size (parts of a list, blocks of its queries). The best of the rough scores are the candidates, and only their floats are fetched for
the exact cosine. New vectors are appended to the lists; the centres stay.

A long list, even one that holds a third of all vectors, is dealt into parts by its count, and a list that very many queries probe deals its queries into blocks.
Vectors that are null, all zeros or of another length than the first centre's aren't indexed, and such queries find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import materialize, new_path

#: Vectors that centres are fitted on (those of the least hash of their id), and rounds of the fit.
SAMPLE, ROUNDS = 50_000, 12
#: Most lists: the centres of 4096 lists of 1024 dimensions are 16 MB, which every task gets.
MOST_LISTS = 4096
#: Vectors and queries of a task.
PART, BLOCK = 1 << 15, 1 << 11


@dataclass(frozen=True)
class VectorIndex:
    """An index at ``path``; ``centres`` has a unit vector for each list."""

    path: str
    centres: np.ndarray

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id long, q binary, list int").parquet(f"{self.path}/codes")

    def floats(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id long, embedding array<float>, list int").parquet(f"{self.path}/floats")


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=np.float32).reshape(-1, width)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _codes(m: np.ndarray) -> np.ndarray:
    """Vectors as int8, each scaled by its largest value; a cosine needs no scale."""
    return np.round(m / np.abs(m).max(axis=1, keepdims=True) * 127).astype(np.int8)


def usable(vectors: DataFrame, width: int | None = None) -> DataFrame:
    right = "id IS NOT NULL AND exists(embedding, x -> x <> 0) AND NOT exists(embedding, x -> x IS NULL OR isnan(x))"
    return vectors.where(right if width is None else f"{right} AND size(embedding) = {width}")


def fit_centres(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit vectors of about 4 sqrt(rows) lists by spherical k-means on the sample; empty lists take a random member."""
    picked = usable(vectors).select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = picked.select("embedding").toArrow().column("embedding")
    if not len(rows):
        return np.zeros((0, 0), np.float32)
    width = len(rows[0])
    m = _unit(np.array([r for r in rows.to_pylist() if len(r) == width], np.float32))
    k = min(lists or 4 * int(np.sqrt(vectors.count())) or 1, MOST_LISTS, len(m))
    random = np.random.default_rng(seed)
    centres = m[random.choice(len(m), k, replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([(m[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(m), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        none = np.flatnonzero(np.linalg.norm(sums, axis=1) == 0)
        sums[none] = m[random.choice(len(m), len(none))]
        centres = _unit(sums)
    return centres


def _assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, embedding, q, list) of vectors: each in the list of its nearest centre."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            m = _matrix(batch.column("embedding"), own.shape[1])
            lists = (m @ own.T).argmax(axis=1).astype(np.int32)
            codes = pa.array([c.tobytes() for c in _codes(m)] if len(m) else [], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), codes, pa.array(lists)], ["id", "embedding", "q", "list"])

    read = usable(vectors, centres.shape[1]).select(F.col("id").cast("long"), F.col("embedding").cast("array<float>"))
    return read.mapInArrow(run, "id long, embedding array<float>, q binary, list int")


def _append(index: VectorIndex, vectors: DataFrame) -> None:
    if not len(index.centres):
        return  # fitted on nothing: there are no lists
    placed = materialize(_assigned(vectors, index.centres), "assigned-vectors")
    sizes = F.broadcast(placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")))  # a row for each list
    dealt = placed.join(sizes, "list").repartition(F.col("list"), F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt.select("id", "q", "list").write.mode("append").partitionBy("list").parquet(f"{index.path}/codes")
    dealt.select("id", "embedding", "list").write.mode("append").partitionBy("list").parquet(f"{index.path}/floats")


def build(vectors: DataFrame, lists: int | None = None, path: str | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Index all of ``vectors`` (id, embedding) in a new folder of the shared one, or at ``path``."""
    index = VectorIndex(path or new_path(vectors.sparkSession, "vector-index"), fit_centres(vectors, lists, sample))
    _append(index, vectors)
    return index


def add(index: VectorIndex, vectors: DataFrame) -> None:
    """Append vectors to their lists; what is indexed stays as it lies."""
    _append(index, vectors)


def probes(index: VectorIndex, queries: DataFrame, count: int) -> DataFrame:
    """(query, embedding, list): each query with its ``count`` nearest lists."""
    sent = queries.sparkSession.sparkContext.broadcast(index.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        n = min(count, len(own))
        for batch in batches:
            m = _matrix(batch.column("embedding"), own.shape[1])
            near = np.argsort(-(m @ own.T), axis=1, kind="stable")[:, :n].astype(np.int32)
            rows = pa.array(np.repeat(np.arange(len(m)), n))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("embedding").take(rows), pa.array(near.ravel())], ["query", "embedding", "list"])

    read = usable(queries, index.centres.shape[1]).select(F.col("id").cast("long"), F.col("embedding").cast("array<float>"))
    return materialize(read.mapInArrow(run, "query long, embedding array<float>, list int"), "probes")


def _rough(keep: int, width: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best codes of a part of a list (left) for a block of its queries (right)."""
        ids, names = left.column("id").to_numpy(), right.column("query").to_numpy()
        if not len(ids) or not len(names):
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "list": pa.array([], pa.int32()), "rough": pa.array([], pa.float32())})
        codes = np.frombuffer(b"".join(left.column("q").to_pylist()), np.int8).reshape(-1, width).astype(np.float32)
        asked = _unit(_matrix(right.column("embedding"), width))
        order = np.argsort(ids, kind="stable")
        ids, codes = ids[order], _unit(codes[order])
        q, r, s = [], [], []
        for at in range(0, len(asked), 256):
            score = asked[at : at + 256] @ codes.T
            best = np.argsort(-score, axis=1, kind="stable")[:, :keep]
            q.append(np.repeat(np.arange(at, at + len(score)), best.shape[1]))
            r.append(best.ravel())
            s.append(np.take_along_axis(score, best, axis=1).ravel())
        q, r = np.concatenate(q), np.concatenate(r)
        lists = np.full(len(q), left.column("list")[0].as_py(), np.int32)
        return pa.table({"query": names[q], "id": ids[r], "list": lists, "rough": np.concatenate(s).astype(np.float32)})

    return run


def search(index: VectorIndex, queries: DataFrame, limit: int = 10, count: int = 8, widen: int = 4) -> DataFrame:
    """(query, id, score) for every row of ``queries`` (id, embedding): the ``limit`` best by exact cosine among ``widen`` times as many by codes of the ``count`` nearest lists."""
    spark, width = queries.sparkSession, index.centres.shape[1]
    if not len(index.centres):
        return queries.select(F.col("id").cast("long").alias("query"), F.col("id").cast("long").alias("id"), F.lit(0.0).alias("score")).limit(0)
    asked = probes(index, queries, count)
    of_list = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    lists = [r.list for r in of_list.collect()]  # MOST_LISTS at most
    codes = index.codes(spark).where(F.col("list").isin(lists))
    sizes = codes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    plan = F.broadcast(materialize(of_list.join(sizes, "list"), "probed-lists"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    block = F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")
    left = codes.join(plan, "list").select("id", "q", "list", part.alias("part"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    right = asked.join(plan, "list").select("query", "embedding", "list", block.alias("block"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    key = ["list", "part", "block"]
    rough = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_rough(limit * widen, width), "query long, id long, list int, rough float")
    candidates = materialize(_first(rough, "rough", limit * widen).select("query", "id", "list"), "candidates")
    return _exact(candidates, index.floats(spark).where(F.col("list").isin(lists)), queries, limit)


def _exact(candidates: DataFrame, floats: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The best of the candidates (query, id, ...) by their floats: a join that reads no other vector's."""
    own = queries.select(F.col("id").cast("long").alias("query"), F.col("embedding").alias("asked"))
    on = [c for c in ("list", "id") if c in candidates.columns]
    both = candidates.join(floats, on).join(own, "query")
    terms = [f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS double) * cast(y AS double)), 0.0D, (s, x) -> s + x)" for a, b in (("embedding", "asked"), ("embedding", "embedding"), ("asked", "asked"))]
    scored = both.select("query", "id", F.round(F.expr(f"{terms[0]} / sqrt({terms[1]} * {terms[2]})"), 6).alias("score"))
    return _first(scored, "score", limit)


def _first(found: DataFrame, by: str, limit: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(by), "id"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def comparisons(index: VectorIndex, queries: DataFrame, count: int = 8) -> int:
    """How many codes a search compares: for each list its vectors times the queries that probe it."""
    asked = probes(index, queries, count).groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    held = index.codes(queries.sparkSession).groupBy("list").agg(F.count(F.lit(1)).alias("m"))
    return asked.join(held, "list").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
