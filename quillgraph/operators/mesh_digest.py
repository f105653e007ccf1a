"""What a peer lacks, by digests first: rows travel only where key ranges differ, and the bytes sent follow the differences.

1. Each side sums its rows' hashes by ranges of the hash, about ``RANGE`` rows each: (part, n, sum). Ranges with equal sums are done.
2. Of the others, the asking side sends a Bloom filter of its rows. What the filter doesn't have is new for sure, and is sent.
3. What it seems to have is new by a false positive at most. If the sums agree once the sent rows are taken off, there was none; of the other ranges the hashes are sent, and
   the asking side says which it lacks.

The result equals an anti-join of whole rows (told apart by 128 bits of hashes); repeated rows are rows of one content.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize

#: Rows of a range, about; bits of a filter for each row, and places of each row in it.
RANGE, BITS, PLACES = 256, 12, 6
_HASHES = "part long, h long, g long"


@dataclass(frozen=True)
class Delta:
    rows: DataFrame  #: the rows of the other side that are new
    sent: DataFrame  #: step, messages, bytes


def _hashed(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Adds h and g, two hashes of a row's content, and its range."""
    content = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    named = rows.withColumns({"h": F.xxhash64(content), "g": F.xxhash64(F.lit(1), content)})
    # the upper bits of the hash: ranges of it
    return named.withColumn("part", F.expr(f"cast(floor((h / 18446744073709551616D + 0.5D) * {parts}) AS bigint)"))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"))


def _places(h: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    steps = np.arange(PLACES, dtype=np.uint64)[:, None]
    return ((h.view(np.uint64) + steps * (g.view(np.uint64) | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def _filter(table: pa.Table) -> pa.Table:
    h, g = table.column("h").to_numpy(), table.column("g").to_numpy()
    bits = np.zeros(max(64, BITS * len(h) // 8 * 8), bool)
    bits[_places(h, g, len(bits)).ravel()] = True
    return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _tested(left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows (left) with whether the filter (right; none: it has nothing) seems to have them."""
    seen = np.zeros(left.num_rows, bool)
    if right.num_rows and left.num_rows:
        bits = np.unpackbits(np.frombuffer(right.column("bits")[0].as_py(), np.uint8)).astype(bool)
        seen = bits[_places(left.column("h").to_numpy(), left.column("g").to_numpy(), len(bits))].all(axis=0)
    return left.append_column("seen", pa.array(seen))


def delta(mine: DataFrame, theirs: DataFrame, keys: list[str], rows_per_range: int = RANGE) -> Delta:
    """The rows of ``theirs`` whose content (``keys``) isn't among ``mine``, and what was sent to find and bring them."""
    parts = max(1, theirs.count() // rows_per_range)
    own = materialize(_hashed(mine, keys, parts).select("part", "h", "g").distinct(), "own-hashes")
    other = materialize(_hashed(theirs, keys, parts), "other-rows")
    held = materialize(other.select("part", "h", "g").distinct(), "other-hashes")
    a, b = _sums(own), _sums(held)
    both = b.join(a.withColumnsRenamed({"n": "n_own", "sum": "sum_own"}), "part", "left")
    differ = materialize(both.where("NOT (n <=> n_own AND sum <=> sum_own)").select("part", "sum", "sum_own"), "differing-ranges")
    filters = materialize(own.join(differ.select("part"), "part", "left_semi").groupBy("part").applyInArrow(_filter, "part long, bits binary"), "filters")
    asked = held.join(differ.select("part"), "part", "left_semi")
    tested = materialize(asked.groupBy("part").cogroup(filters.toDF("part", "bits").groupBy("part")).applyInArrow(_tested, f"{_HASHES}, seen boolean"), "tested")
    new = tested.where("NOT seen").select("part", "h", "g")
    left = tested.where("seen").groupBy("part").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("left"))
    # ranges of which the filter may have claimed a row too many
    unsure = left.join(differ, "part").where("NOT (left <=> sum_own)").select("part")
    claimed = materialize(tested.where("seen").select("part", "h", "g").join(unsure, "part", "left_semi"), "claimed")
    late = claimed.join(own, ["part", "h", "g"], "left_anti")
    found = materialize(new.unionByName(late), "new-hashes")
    rows = other.join(found, ["part", "h", "g"], "left_semi").select(*theirs.columns)
    size = F.sum(F.octet_length(F.to_json(F.struct(*keys))).cast("long"))
    told = [
        a.agg(F.lit("sums").alias("step"), F.count(F.lit(1)).alias("messages"), (F.count(F.lit(1)) * 32).alias("bytes")),
        filters.agg(F.lit("filters").alias("step"), F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum(F.octet_length("bits").cast("long") + 8), F.lit(0)).alias("bytes")),
        claimed.agg(F.lit("hashes").alias("step"), F.count(F.lit(1)).alias("messages"), (F.count(F.lit(1)) * 16).alias("bytes")),
        rows.agg(F.lit("rows").alias("step"), F.count(F.lit(1)).alias("messages"), F.coalesce(size, F.lit(0)).alias("bytes")),
    ]
    return Delta(rows, told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3]))
