"""Streams with state, the versioned store and the feed, each against the whole table and after a restart."""

from __future__ import annotations

import json
import socketserver
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import analyze
from quillgraph.streaming import changes, cooldown, feed
from quillgraph.streaming.changes import timed
from quillgraph.streaming.store import GraphStore

SMALL = "/root/testdata/sf0.001"


def files(spark, path, lines, n):
    with open(f"{path}/{n:03d}.json", "w") as f:
        f.write("\n".join(json.dumps(x) for x in lines) + "\n")


def test_cooldown_stream_equals_the_table_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", cooldown.PROVIDER)
    events = timed(spark.read.parquet(f"{SMALL}/events.parquet")).select(F.col("event_type").alias("rule"), "ts", F.col("event_id").alias("id"))
    rows = events.orderBy("ts").collect()
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    third = len(rows) // 3
    parts = [rows[:third], rows[third : 2 * third], rows[2 * third :]]

    def run():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        fired = cooldown.cooled_down_stream(stream, 3600, late="0 seconds")
        q = fired.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        assert q.awaitTermination(300) and q.exception() is None

    for k, part in enumerate(parts):
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(source)
        if k:  # the second run goes on with the state of the first
            run()
    heartbeat = events.limit(1).select(F.lit("").alias("rule"), (F.col("ts") + F.expr("INTERVAL 10 YEARS")).alias("ts"), F.lit(-1).cast("long").alias("id"))
    heartbeat.coalesce(1).write.mode("append").parquet(source)
    run()
    got = Counter((r.rule, r.id) for r in spark.read.parquet(out).where("rule <> ''").collect())
    assert got == Counter((r.rule, r.id) for r in analyze.cooled_down(events, 3600).collect())


RULES = """rule up
when edge(A, "part_of", B)
when edge(B, "part_of", C)
then edge(A, "part_of", C, product(e1, e2))
rule mark
when edge(A, "part_of", B)
when prop(B, "hot", "yes")
then flag(A, "near heat")"""


def records(k):
    nodes = [{"entity": f"N{i}", "type": "thing", "properties": {"hot": "yes" if i == 6 else "no"}, "confidence": 0.9} for i in range(k * 3, k * 3 + 4)]
    return nodes + [{"from": f"n{i}", "to": f"N{i + 1}", "relationship": "part_of", "confidence": 0.8} for i in range(k * 3, k * 3 + 3)]


def plain(g):
    nodes = {r.label: r.props.get("_flag") for r in g.nodes.collect()}
    return nodes, Counter((r.src, r.rel, r.dst) for r in g.edges.collect())


@pytest.fixture()
def filled(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = GraphStore(spark, f"file://{tmp_path}/graph")
    return store, tmp_path


def test_stream_of_versions_equals_one_batch(spark, filled):
    store, path = filled
    for k in range(3):
        files(spark, path / "in", records(k), k)
        store.ingest(str(path / "in"), str(path / "check"), RULES).awaitTermination(200)
    assert store.version() == 3
    (path / "all").mkdir()
    files(spark, path / "all", [x for k in range(3) for x in records(k)], 0)
    one = GraphStore(spark, f"file://{path}/one")
    one.ingest(str(path / "all"), str(path / "check-one"), RULES).awaitTermination(200)
    assert plain(store.read()) == plain(one.read())
    # a batch that comes again adds nothing
    from quillgraph.sources.files import split_records
    from quillgraph.streaming.changes import RECORD

    again = split_records(spark.read.schema(RECORD).json(str(path / "in" / "000.json")))
    before = plain(store.read())
    assert store.append(*again, stream="ingest", batch=2, rules=RULES) == 3 and plain(store.read()) == before
    # versions stay readable, also behind a compaction
    first = plain(store.read(1))
    assert store.compact() == 4 and plain(store.read()) == before and plain(store.read(1)) == first
    assert set(first[0]) == {"N0", "N1", "N2", "N3"}


def test_events_are_followed_once(spark, filled):
    store, path = filled
    for k in range(2):
        files(spark, path / "in", records(k), k)
        store.ingest(str(path / "in"), str(path / "check")).awaitTermination(200)
        store.follow(str(path / "out"), str(path / "check-out")).awaitTermination(200)
    got = Counter((r.event, r.key) for r in spark.read.json(str(path / "out")).collect())
    assert got == Counter((r.event, r.key) for r in store.events().collect()) and max(got.values()) == 1
    assert ("node_created", "N6") in got and ("edge_added", "N0|part_of|N1") in got and store.events(1).where("key = 'N0'").count() == 0


class Spool(socketserver.StreamRequestHandler):
    lines: list[str] = []

    def handle(self):
        words = self.rfile.readline().decode().split()
        if words[0] == "SIZE":
            self.wfile.write(f"{len(self.lines)}\n".encode())
        else:
            start, most = int(words[1]), int(words[2])
            self.wfile.write("".join(x + "\n" for x in self.lines[start : start + most]).encode())


def test_feed_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "TASK", 3)
    Spool.lines = [json.dumps({"entity": f"E{i}"}) for i in range(10)]
    server = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Spool)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run(n):
        q = feed.read_feed(spark, "127.0.0.1", server.server_address[1]).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        q.processAllAvailable()
        q.stop()
        got = [(r.number, r.entity) for r in spark.read.parquet(out).orderBy("number").collect()]
        assert got == [(i, f"E{i}") for i in range(n)]

    try:
        run(10)
        Spool.lines += [json.dumps({"entity": f"E{i}"}) for i in range(10, 25)]
        run(25)
    finally:
        server.shutdown()


def test_listener_counts_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files(spark, tmp_path / "in", records(0), 0)
    log = changes.ProgressLog()
    spark.streams.addListener(log)
    try:
        changes.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "check"), lambda e, r, n: e.unionByName(r, allowMissingColumns=True).collect()).awaitTermination(100)
        deadline = time.time() + 30
        while time.time() < deadline and not any(r["event"] == "ended" for r in log.rows):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    seen = log.table(spark).groupBy("event").agg(F.sum("rows").alias("rows")).collect()
    assert {r.event for r in seen} >= {"started", "batch", "ended"} and {r.event: r.rows for r in seen}["batch"] >= len(records(0))


def test_cooldown_calls_of_the_state_follow_spans_of_time():
    import numpy as np
    import pandas as pd

    class Held(dict):
        calls = 0

        def containsKey(self, key):
            Held.calls += 1
            return key in self

        def getValue(self, key):
            Held.calls += 1
            return self[key]

        def updateValue(self, key, value):
            Held.calls += 1
            self[key] = value

    us = np.random.default_rng(3).permutation(20_000) * 100_000
    state = cooldown.Cooldown(60)
    state.waiting, state._settled = Held(), lambda key, timer: iter(())
    list(state.handleInputRows(("a",), iter(pd.DataFrame({"us": part, "id": part}) for part in np.split(us, 20)), None))
    assert Held.calls < 100
    times = np.concatenate([cooldown._unpacked(state.waiting[k][0])[0] for k in sorted(state.waiting)])
    assert times.tolist() == sorted(us.tolist())
