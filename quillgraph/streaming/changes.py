"""Change streams: events from version differences, streamed ingest, push rules and windows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..graph import Graph
from ..plans.rules import derive
from ..sources.files import RECORD, split_records


def graph_events(old: Graph, new: Graph) -> DataFrame:
    """(event, key, detail): node_created, edge_added and confidence_updated between two versions."""
    a, b = old.live_nodes().select("label", F.col("confidence").alias("_old")), new.live_nodes().select("label", "type", "confidence")
    both = b.join(a, "label", "left")
    created = both.where("_old is null").select(F.lit("node_created").alias("event"), F.col("label").alias("key"), F.to_json(F.struct("type", "confidence")).alias("detail"))
    moved = both.where("_old <> confidence").select(F.lit("confidence_updated").alias("event"), F.col("label").alias("key"), F.to_json(F.struct(F.col("_old").alias("old"), F.col("confidence").alias("new"))).alias("detail"))
    keys = ["src", "rel", "dst"]
    counted = new.live_edges().groupBy(*keys).count().join(old.live_edges().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, "left")
    added = counted.where("count > coalesce(_n, 0)").select(F.lit("edge_added").alias("event"), F.concat_ws("|", *keys).alias("key"), F.to_json(F.struct((F.col("count") - F.coalesce("_n", F.lit(0))).alias("n"))).alias("detail"))
    return created.unionByName(moved).unionByName(added)


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New NDJSON files of a folder, as records; also the landing place of webhooks and sockets."""
    return spark.readStream.schema(RECORD).json(folder)


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Records of NDJSON lines from a socket, such as a bridge of web sockets writes; lines that aren't JSON have no fields."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.select(F.from_json("value", RECORD).alias("r")).select("r.*")


def answers_as_they_come(*sources: DataFrame) -> DataFrame:
    """Streams of answers (source, gap_id, answer) as one stream."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    return every


def progress(query: StreamingQuery) -> list[dict]:
    """(batch, rows, seconds) of a stream's recent batches, the counters of a job's progress."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "seconds": p["batchDuration"] / 1000} for p in query.recentProgress]


class ProgressLog(StreamingQueryListener):
    """Counters of all streams of a session while they run, the last ``keep`` of them, also of streams that ended or failed: add it by ``spark.streams.addListener``."""

    def __init__(self, keep: int = 1000) -> None:
        self.rows: deque[dict] = deque(maxlen=keep)

    def _told(self, event: str, run, batch: int | None = None, rows: int | None = None, seconds: float | None = None, error: str | None = None) -> None:
        self.rows.append({"event": event, "run": str(run), "batch": batch, "rows": rows, "seconds": seconds, "error": error})

    def onQueryStarted(self, event) -> None:
        self._told("started", event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._told("batch", p.runId, p.batchId, p.numInputRows, p.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:
        self._told("idle", event.runId)

    def onQueryTerminated(self, event) -> None:
        self._told("failed" if event.exception else "ended", event.runId, error=event.exception)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), "event string, run string, batch long, rows long, seconds double, error string")


def ingest_stream(spark: SparkSession, folder: str, checkpoint: str, land: Callable[[DataFrame, DataFrame, int], None]) -> StreamingQuery:
    """Hands entities and relations of each micro-batch to ``land`` with the batch's number, by which it can tell a repeated batch."""

    def batch(df: DataFrame, number: int) -> None:
        entities, relations = split_records(df)
        land(entities, relations, number)

    return read_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def push_rules(g: Graph, entities: DataFrame, relations: DataFrame, rules: str) -> Graph:
    """The graph after a batch and after the rules that it sets off."""
    grown, _ = g.store(entities).relate(relations)
    return derive(grown, rules).graph


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """Events with a time that watermarks accept."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): tumbling or sliding windows; the same for tables and streams."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = timed(events).withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a pause of ``gap``."""
    grouped = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
