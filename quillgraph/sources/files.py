"""Files in and out: JSON graphs, NDJSON, CSV, JSON-LD, Markdown, HTML and subgraph export."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import EDGE, NODE, Graph, shaped

RECORD = "entity string, type string, properties map<string,string>, source string, confidence double, `from` string, `to` string, relationship string"


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of mixed records, told apart by their fields."""
    nodes = records.where("entity is not null").select(F.col("entity").alias("label"), "type", F.col("properties").alias("props"), "confidence", "source")
    edges = records.where("entity is null and `from` is not null").select(F.col("from").alias("src"), F.col("relationship").alias("rel"), F.col("to").alias("dst"), "confidence", "source")
    return shaped(nodes, NODE), shaped(edges, EDGE)


def read_ndjson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return split_records(spark.read.schema(RECORD).json(path))


def read_json_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A document with the arrays ``entities`` and ``relationships`` (or ``relations``)."""
    item = f"array<struct<{RECORD.replace(' string', ': string').replace(' map', ': map').replace(' double', ': double')}>>"
    doc = spark.read.schema(f"entities {item}, relationships {item}, relations {item}").json(path, multiLine=True)
    return split_records(doc.select(F.inline(F.concat(*[F.coalesce(c, F.array().cast(item)) for c in ("entities", "relationships", "relations")]))))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip().lower()) for c in df.columns])


def read_csv_nodes(spark: SparkSession, path: str, default: float = 0.75) -> DataFrame:
    """Columns name, type, confidence; all others that have a value become properties. Rows without a name are skipped."""
    df = _csv(spark, path)
    known = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("name", "type", "confidence")}
    more = [x for c in df.columns if c not in known for x in (F.lit(c), F.col(f"`{c}`"))]
    props = F.map_filter(F.create_map(*more), lambda k, v: v.isNotNull() & (v != "")) if more else F.create_map().cast("map<string,string>")
    own = df.select(known["name"].alias("label"), known["type"].alias("type"), props.alias("props"), F.coalesce(known["confidence"].try_cast("double"), F.lit(default)).alias("confidence"))
    return shaped(own.where("label is not null and label <> ''"), NODE)


def read_csv_edges(spark: SparkSession, path: str, default: float = 0.75) -> DataFrame:
    """Columns from, to, relationship, confidence; rows that lack one of the first three are skipped."""
    df = _csv(spark, path)
    sure = F.col("confidence").try_cast("double") if "confidence" in df.columns else F.lit(None).cast("double")
    own = df.select(F.col("from").alias("src"), F.col("relationship").alias("rel"), F.col("to").alias("dst"), F.coalesce(sure, F.lit(default)).alias("confidence"))
    return shaped(own.where("coalesce(src, '') <> '' and coalesce(rel, '') <> '' and coalesce(dst, '') <> ''"), EDGE)


def read_jsonld(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Items of ``@graph``: objects with an ``@id`` are edges, other values are properties."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$['@graph']"), "array<string>")).alias("item"))
    pairs = raw.select(F.from_json("item", "map<string,string>").alias("m"))
    local = F.regexp_extract(F.element_at("m", "@id"), r"([^/:#]*)$", 1)
    named = pairs.select("m", F.coalesce(F.element_at("m", "rdfs:label"), F.element_at("m", "schema:name"), local).alias("label"), F.element_at("m", "@id").alias("id"))
    kind = F.lower(F.regexp_extract(F.element_at("m", "@type"), r"([^/:#\"\]]*)\W*$", 1))
    props = F.map_filter("m", lambda k, v: ~k.isin("@id", "@type", "rdfs:label", "schema:name") & ~F.coalesce(v, F.lit("")).contains('"@id"'))
    nodes = named.select("label", F.nullif(kind, F.lit("")).alias("type"), F.transform_keys(props, lambda k, v: F.regexp_replace(k, "^.*[:/#]", "")).alias("props"))
    links = named.select("label", F.explode(F.map_filter("m", lambda k, v: F.coalesce(v, F.lit("")).contains('"@id"'))))
    many = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    flat = links.select(F.col("label").alias("src"), F.regexp_replace("key", "^.*[:/#]", "").alias("rel"), F.explode(many).alias("target"))
    flat = flat.select("src", "rel", F.get_json_object("target", "$['@id']").alias("id"), F.get_json_object("target", "$.confidence").cast("double").alias("confidence"))
    edges = flat.join(named.select("id", F.col("label").alias("dst")), "id", "left").withColumn("dst", F.coalesce("dst", F.regexp_extract("id", r"([^/:#]*)$", 1)))
    return shaped(nodes, NODE), shaped(edges, EDGE)


def to_jsonld(g: Graph, prefix: str = "kg:") -> DataFrame:
    """(label, item): a JSON-LD object for each node, with its outgoing edges and their confidence."""
    out = g.live_edges().groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rel", F.concat(F.lit(prefix), "dst").alias("id"), "confidence"))).alias("edges"))
    joined = g.live_nodes().join(out, F.col("label") == F.col("src"), "left")
    body = F.struct(F.concat(F.lit(prefix), "label").alias("@id"), F.col("type").alias("@type"), F.col("label").alias("rdfs:label"), "confidence", F.col("props").alias("properties"), "edges")
    return joined.select("label", F.to_json(body).alias("item"))


def subgraph_json(g: Graph, start: str, depth: int = 2) -> DataFrame:
    """(kind, key, item): nodes and edges around an entity, a JSON object each."""
    from ..operators.traverse import bfs, bfs_edges

    near = bfs(g, start, depth)
    nodes = near.select(F.lit("node").alias("kind"), F.col("label").alias("key"), F.to_json(F.struct("label", "depth")).alias("item"))
    edges = bfs_edges(g, near, depth)
    return nodes.unionByName(edges.select(F.lit("edge").alias("kind"), F.concat_ws("|", "src", "rel", "dst").alias("key"), F.to_json(F.struct("src", "rel", "dst", "confidence")).alias("item")))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(filename, title, author, date, excerpt, text) of Markdown files with optional front matter."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("text"))
    return markdown_parts(raw)


def markdown_parts(raw: DataFrame) -> DataFrame:
    front = F.regexp_extract("text", r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1)
    body = F.regexp_replace("text", r"(?s)\A---\s*\n.*?\n---\s*\n", "")
    field = lambda k: F.nullif(F.trim(F.regexp_extract("_front", rf"(?m)^{k}:\s*(.*)$", 1)), F.lit(""))
    df = raw.withColumns({"_front": front, "_body": body})
    paragraphs = F.filter(F.transform(F.split("_body", r"\n\s*\n"), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: (F.length(p) >= 20) & ~p.startswith("#"))
    heading = F.nullif(F.trim(F.regexp_extract("_body", r"(?m)^#\s+(.*)$", 1)), F.lit(""))
    cols = {"title": F.coalesce(field("title"), heading, F.col("filename")), "author": field("author"), "date": field("date"), "excerpt": F.substring(F.get(paragraphs, F.lit(0)), 1, 200)}
    return df.withColumns(cols).select("filename", "title", "author", "date", "excerpt", "text")


def html_tables(pages: DataFrame) -> DataFrame:
    """(page_id, row, cells): the rows of all tables in a column ``html``; text outside tables has row -1."""
    from html.parser import HTMLParser

    class Rows(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.rows, self.cell, self.text, self.skip = [], None, [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th") and self.rows:
                self.cell = []

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style") and self.skip > 0
            if tag in ("td", "th") and self.cell is not None:
                self.rows[-1].append(" ".join("".join(self.cell).split()))
                self.cell = None

        def handle_data(self, data):
            if not self.skip:
                (self.text if self.cell is None else self.cell).append(data)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, source in zip(frame["page_id"], frame["html"]):
                p = Rows()
                p.feed(source or "")
                out += [(page, i, r) for i, r in enumerate(p.rows)] + [(page, -1, [" ".join(" ".join(p.text).split())])]
            yield pd.DataFrame(out, columns=["page_id", "row", "cells"])

    return pages.select("page_id", "html").mapInPandas(parse, "page_id long, row int, cells array<string>")


def read_csv_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges where the header has from and to, nodes otherwise."""
    header = {c.strip().lower() for c in spark.read.csv(path, header=True).columns}
    if {"from", "to"} <= header:
        return spark.createDataFrame([], NODE), read_csv_edges(spark, path)
    return read_csv_nodes(spark, path), spark.createDataFrame([], EDGE)


def read_markdown_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A document for each file with its front matter as properties, its author as a person, and an edge between them."""
    docs = read_markdown(spark, path)
    props = F.map_filter(F.create_map(*[x for c in ("title", "author", "date", "excerpt") for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    people = docs.where("author is not null").select(F.col("author").alias("label"), F.lit("person").alias("type")).distinct()
    nodes = shaped(docs.select(F.col("filename").alias("label"), F.lit("document").alias("type"), props.alias("props")), NODE).unionByName(shaped(people, NODE))
    return nodes, shaped(docs.where("author is not null").select(F.col("filename").alias("src"), F.lit("authored_by").alias("rel"), F.col("author").alias("dst")), EDGE)


def read_html_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A node for each table row of HTML files: the first cell is its label, the others are properties by their place."""
    raw = spark.read.text(path, wholetext=True).select(F.lit(0).cast("long").alias("page_id"), F.col("value").alias("html"))
    rows = html_tables(raw).where("row >= 0 AND size(cells) > 0 AND cells[0] <> ''")
    props = F.map_from_entries(F.transform(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda x, i: F.struct(F.concat(F.lit("cell_"), (i + 2).cast("string")), x)))
    return shaped(rows.select(F.col("cells")[0].alias("label"), F.lit("row").alias("type"), props.alias("props")), NODE), spark.createDataFrame([], EDGE)


FORMATS = {"csv": read_csv_graph, "md": read_markdown_graph, "html": read_html_graph, "json": read_json_graph, "ndjson": read_ndjson, "jsonl": read_ndjson, "jsonld": read_jsonld}


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a file, by its extension."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise ValueError(f"no reader for .{kind}; there are {sorted(FORMATS)}")
    return FORMATS[kind](spark, path)

