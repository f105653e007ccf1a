"""A stored graph in versions: each write adds the rows it changes, a commit file makes them count, and its change events can be followed as a stream.

``data/<version>/`` has the changed ``nodes``, the new ``edges`` and the ``events`` of a version. A version counts when ``log/<version>`` exists; that file is made in
one step and only if it isn't there yet, so of two writers of one version one fails, and a writer that dies leaves nothing. The file names the stream and batch that it
came from: a batch that is written again is recognised and changes nothing. Events are moved to ``events/<version>`` after the commit; if that was cut off, the next
writer does it. ``compact`` writes the whole graph as one version that later reads begin with.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..graph import EDGE, NODE, Graph, shaped
from ..plans.rules import derive
from ..shared import materialize
from .changes import graph_events, read_stream, split_records

EVENT = T.StructType([T.StructField("version", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("event", "key", "detail"))])


@dataclass(frozen=True)
class GraphStore:
    spark: SparkSession
    path: str

    # --- the log

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _names(self, folder: str) -> list[str]:
        fs, target = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def log(self) -> list[dict]:
        """All commits, in order: version, stream, batch, and data, the folder of its rows; base: it holds the whole graph."""
        out = []
        for name in self._names("log"):
            fs, target = self._fs(f"{self.path}/log/{name}")
            stream = fs.open(target)
            out.append(json.loads(bytes(stream.readAllBytes()).decode()))
            stream.close()
        return out

    def version(self) -> int:
        names = self._names("log")
        return int(names[-1]) if names else 0

    def _commit(self, entry: dict) -> None:
        fs, target = self._fs(f"{self.path}/log/{entry['version']:012d}")
        stream = fs.create(target, False)  # fails if another writer was first
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()

    def _publish(self, entry: dict) -> None:
        for_all, source = self._fs(f"{self.path}/data/{entry['data']}/events")
        if for_all.exists(source):
            _, target = self._fs(f"{self.path}/events/{entry['version']:012d}")
            for_all.mkdirs(target.getParent())
            for_all.rename(source, target)

    # --- reading

    def read(self, version: int | None = None) -> Graph:
        """The graph as of a version (None: the last)."""
        entries = [e for e in self.log() if version is None or e["version"] <= version]
        bases = [k for k, e in enumerate(entries) if e.get("base")]
        entries = entries[bases[-1] :] if bases else entries
        nodes, edges = (self.spark.createDataFrame([], s) for s in (NODE, EDGE))
        if not entries:
            return Graph(nodes, edges)
        rows = None
        for e in entries:
            own = self.spark.read.schema(NODE).parquet(f"{self.path}/data/{e['data']}/nodes").withColumn("_version", F.lit(e["version"]))
            rows = own if rows is None else rows.unionByName(own)
        if len(entries) > 1:
            last = rows.groupBy("label_key").agg(F.max("_version").alias("_version"))
            rows = rows.join(last, ["label_key", "_version"])
        edges = self.spark.read.schema(EDGE).parquet(*[f"{self.path}/data/{e['data']}/edges" for e in entries])
        return Graph(rows.select(*NODE.names), edges)

    def events(self, since: int = 0) -> DataFrame:
        """(version, event, key, detail) of the versions after ``since``."""
        folders = [f"{self.path}/events/{n}" for n in self._names("events") if int(n) > since]
        return self.spark.read.schema(EVENT).parquet(*folders) if folders else self.spark.createDataFrame([], EVENT)

    def event_stream(self) -> DataFrame:
        """The same as a stream that follows the store; write it to any sink (see ``follow``)."""
        fs, target = self._fs(f"{self.path}/events")
        fs.mkdirs(target)
        return self.spark.readStream.schema(EVENT).parquet(f"{self.path}/events/*")

    # --- writing

    def append(self, entities: DataFrame, relations: DataFrame, stream: str = "", batch: int | None = None, rules: str | None = None) -> int:
        """Store entities and relations, and what ``rules`` derive, as one version; the version that holds them.

        A batch that the stream has written before adds nothing. Only nodes that the batch names are read and written; rules read the whole graph.
        """
        entries = self.log()
        if entries:
            self._publish(entries[-1])
        if batch is not None and any(e["stream"] == stream and e["batch"] is not None and e["batch"] >= batch for e in entries):
            return self.version()
        old = self.read()
        keys = entities.select(F.lower("label").alias("label_key")).unionByName(relations.select(F.explode(F.array(F.lower("src"), F.lower("dst"))).alias("label_key"))).distinct()
        keys = materialize(keys, "touched-keys")
        touched = Graph(materialize(old.nodes.join(keys, "label_key", "left_semi").select(*NODE.names), "touched-nodes"), self.spark.createDataFrame([], EDGE))
        grown, _ = touched.store(entities).relate(relations)
        nodes, edges = materialize(grown.nodes, "batch-nodes"), materialize(grown.edges, "batch-edges")
        if rules:
            rest = old.nodes.join(keys, "label_key", "left_anti").select(*NODE.names)
            whole = Graph(materialize(rest.unionByName(nodes), "whole-nodes"), old.edges.unionByName(edges))
            done = derive(whole, rules)
            # nodes that rules changed, and edges that they made
            before = whole.nodes.select("label_key", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("props")))).alias("_before"))
            after = done.graph.nodes.join(before, "label_key").withColumn("_after", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("props")))))
            moved = after.where("_after <> _before").select(*NODE.names)
            nodes = materialize(nodes.join(moved.select("label_key"), "label_key", "left_anti").select(*NODE.names).unionByName(moved), "derived-nodes")
            made = shaped(done.edges.withColumns({"source": F.lit("derived"), "deleted": F.lit(False)}), EDGE)
            edges = materialize(edges.unionByName(made), "derived-edges")
            touched = Graph(materialize(old.nodes.join(nodes.select("label_key"), "label_key", "left_semi").select(*NODE.names), "old-nodes"), touched.edges)
        return self._write(Graph(nodes, edges), touched, stream, batch)

    def _write(self, new: Graph, old: Graph, stream: str, batch: int | None, base: bool = False) -> int:
        version = self.version() + 1
        data = f"{version:012d}-{uuid.uuid4().hex}"
        new.nodes.write.parquet(f"{self.path}/data/{data}/nodes")
        new.edges.write.parquet(f"{self.path}/data/{data}/edges")
        if not base:
            events = graph_events(old, new).withColumn("version", F.lit(version).cast("long")).select(*EVENT.names)
            events.write.parquet(f"{self.path}/data/{data}/events")
        entry = {"version": version, "stream": stream, "batch": batch, "data": data, "base": base}
        self._commit(entry)
        self._publish(entry)
        return version

    def compact(self) -> int:
        """The whole graph as a version of its own; later reads begin with it, earlier versions stay readable."""
        whole = self.read()
        return self._write(whole, whole, "", None, True)

    # --- streams

    def ingest(self, folder: str, checkpoint: str, rules: str | None = None, stream: str = "ingest") -> StreamingQuery:
        """Follow the NDJSON files of a folder until no new ones are left: each micro-batch is a version, and rules are applied to it."""

        def batch(df: DataFrame, number: int) -> None:
            entities, relations = split_records(df)
            self.append(entities, relations, stream, number, rules)

        return read_stream(self.spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def follow(self, folder: str, checkpoint: str) -> StreamingQuery:
        """A sink of change events: JSON lines in ``folder``, each event once, also after a restart."""
        lines = self.event_stream().writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint)
        return lines.outputMode("append").trigger(availableNow=True).start()
