"""Two-pass external shuffle into shards of equal row counts.

First pass: every record goes to one of many memory-sized buckets by a seeded hash of all its columns; rows that
are equal in all columns are counted, and a copy's number goes into the hash too where there are many of them.
Second pass: each bucket is put into a fixed order, shuffled by Fisher-Yates with a generator of its own
(seed and bucket number) and written. Buckets lie one after another in the final order, whose
positions are cut into ``shards`` ranges; row counts of shards differ by one at most (law ``rows``).
The buckets' first positions are a table that meets its buckets in their tasks, so any number of buckets will do.

Hashes, orders and generators depend on nothing but rows and seed, so a task that runs again
gives the same rows. Defined cases: a null text has size 1 and the checksum of an empty text; rows that are
equal in all columns are interchangeable; an empty table gives no rows; a text larger than a bucket makes its bucket
larger; columns of the input that are called shard or slot are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import free_name, materialize, new_path
from .textkit import release

SHARDS = 16
SEED = 20240229
BUCKET_BYTES = 16 << 20
#: Equal rows with more than this part of all rows or of a bucket's bytes are dealt copy by copy.
HOT = 1 / 1024
#: Buckets whose counts are summed up in one task.
RUN = 1 << 12


def size() -> F.Column:
    """UTF-8 bytes of the text plus one."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def _offsets(kinds: DataFrame, buckets: int) -> DataFrame:
    """(bucket, first): the final position of each bucket's first row; ``kinds`` has a hash, its rows (n) and whether copies are dealt apart (hot)."""
    copies = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.array(F.lit(0).cast("long"))))
    each = kinds.withColumn("copy", copies).select(_bucket("hash", "copy", buckets).alias("bucket"), F.when(F.col("hot"), 1).otherwise(F.col("n")).alias("n"))
    counts = each.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("run", F.floor(F.col("bucket") / RUN))
    # a running sum in two steps: over runs of buckets, then inside each run
    runs = counts.groupBy("run").agg(F.sum("n").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", F.coalesce(F.sum("n").over(before.orderBy("run")), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("n").over(before.partitionBy("run").orderBy("bucket")), F.lit(0))
    return counts.withColumn("inside", inside).join(runs, "run").select("bucket", (F.col("start") + F.col("inside")).alias("first"))


def _bucket(hash_: str, copy: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(hash_), F.col(copy)), F.lit(buckets))


def shuffle_to_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, path: str | None = None, hot: float = HOT) -> DataFrame:
    """``docs`` with shard (int) and slot (long), written below ``path`` with a folder for each shard, and read again."""
    spark = docs.sparkSession
    path = path or new_path(spark, "shards")
    docs = docs.drop("shard", "slot")
    names = docs.columns
    own, copy, bucket = (free_name(c, names) for c in ("_hash", "_copy", "_bucket"))
    hashed = docs.withColumn(own, F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in names]))
    # a row for each hash: all that is planned comes from here, so texts are read twice in all
    kinds = materialize(hashed.select(F.col(own).alias("hash"), size().alias("b")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")), "row-hashes")
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    n, buckets = total.n, max(1, -(-total.b // bucket_bytes))
    # no more than 1 / hot of each kind
    kinds = kinds.withColumn("hot", (F.col("n") > 1) & ((F.col("n") > hot * n) | (F.col("b") > F.greatest(F.lit(float(bucket_bytes)), F.lit(hot * total.b)))))
    first = _offsets(kinds, buckets).withColumnRenamed("bucket", bucket)
    many = F.broadcast(kinds.where("hot").select(F.col("hash").alias(own)))
    # equal rows travel as one row and its count until they are dealt
    columns = [F.col(f"`{c}`") for c in names]
    equal = hashed.join(many, own, "left_semi").groupBy(*columns, own).agg(F.count(F.lit(1)).alias(copy))
    equal = equal.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copy) - 1)))
    rest = hashed.join(many, own, "left_anti").withColumn(copy, F.lit(0).cast("long"))
    dealt = rest.unionByName(equal).withColumn(bucket, _bucket(own, copy, buckets))
    starts = np.array([-(-s * n // shards) for s in range(shards)], np.int64)
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def fisher_yates(key: tuple, rows: pa.Table, begin: pa.Table) -> pa.Table:
        order = np.lexsort((rows.column(copy).to_numpy(), rows.column(own).to_numpy()))
        order = order[np.random.default_rng([seed, key[0].as_py()]).permutation(len(order))]
        place = (begin.column("first")[0].as_py() if len(order) else 0) + np.arange(len(order), dtype=np.int64)
        shard = place * shards // max(n, 1)
        slot = place - starts[shard]
        out = rows.select(names).take(pa.array(order))
        release()
        return out.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot))

    placed = dealt.groupBy(bucket).cogroup(first.groupBy(bucket)).applyInArrow(fisher_yates, schema)
    placed.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)
