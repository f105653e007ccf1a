"""A line feed over a socket that can be replayed: a Python data source whose offsets are the numbers of the lines.

The server keeps its lines, such as a bridge of web sockets or web hooks that spools what it receives. A client sends ``FROM <n> <most>`` and a line end; the server answers
with at most so many lines from number n on, each a JSON text, and closes. A stream that starts again asks from the offset of its checkpoint: nothing is read twice or lost.
"""

from __future__ import annotations

import socket
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .changes import RECORD

#: Lines of a task.
TASK = 10_000


class Lines(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


def ask(host: str, port: int, start: int, most: int) -> Iterator[str]:
    """Lines from number ``start`` on, ``most`` at most."""
    with socket.create_connection((host, port), timeout=30) as connection:
        connection.sendall(f"FROM {start} {most}\n".encode())
        with connection.makefile("r", encoding="utf-8", newline="\n") as answer:
            for line in answer:
                yield line.rstrip("\n")


def held(host: str, port: int) -> int:
    """How many lines the server has: it answers ``SIZE`` with their number."""
    with socket.create_connection((host, port), timeout=30) as connection:
        connection.sendall(b"SIZE\n")
        with connection.makefile("r", encoding="utf-8") as answer:
            return int(answer.readline())


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.host, self.port = options["host"], int(options["port"])

    def initialOffset(self) -> dict:
        return {"line": 0}

    def latestOffset(self) -> dict:
        return {"line": held(self.host, self.port)}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        return [Lines(a, min(a + TASK, end["line"])) for a in range(start["line"], end["line"], TASK)]

    def read(self, partition: Lines) -> Iterator[tuple]:
        got = 0
        for got, line in enumerate(ask(self.host, self.port, partition.start, partition.end - partition.start), 1):
            yield partition.start + got - 1, line
        if got != partition.end - partition.start:
            raise ConnectionError(f"the feed gave {got} of the lines {partition.start} to {partition.end}")

    def commit(self, end: dict) -> None:
        pass  # the server keeps its lines


class Feed(DataSource):
    """``spark.readStream.format("quillgraph_feed").option("host", ...).option("port", ...)``"""

    @classmethod
    def name(cls) -> str:
        return "quillgraph_feed"

    def schema(self) -> str:
        return "number long, value string"

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def read_feed(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Numbered records of the feed's lines; a line that isn't JSON has no fields."""
    spark.dataSource.register(Feed)
    lines = spark.readStream.format("quillgraph_feed").option("host", host).option("port", str(port)).load()
    return lines.select("number", F.from_json("value", RECORD).alias("r")).select("number", "r.*")
