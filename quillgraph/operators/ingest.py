"""From texts to facts: entities, relations, resolution, review, deduplication and provenance, each a step on tables."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..graph import cut_lineage


@dataclass(frozen=True)
class IngestConfig:
    """What a staged ingest keeps and leaves out; ``skip`` names stages, ``templates`` has relations as texts, such as {"works_at": "{head} works at {tail}"}."""

    min_entity_confidence: float = 0.6
    dedup_threshold: float = 0.85
    enable_coref: bool = True
    skip: tuple[str, ...] = ()
    templates: dict[str, str] = field(default_factory=dict)


#: Entity types of common taggers, and the types that are dropped.
TYPE_OF = {
    "PERSON": "person", "PER": "person", "ORG": "organization", "GPE": "location", "LOC": "location", "FAC": "facility",
    "PRODUCT": "product", "EVENT": "event", "WORK_OF_ART": "work", "LAW": "law", "NORP": "group", "LANGUAGE": "language", "DATE": "date", "TIME": "time", "MONEY": "monetary_value", "QUANTITY": "quantity",
}
DROPPED_TYPES = ("CARDINAL", "ORDINAL", "PERCENT")
#: Relations between two types where no pattern says which.
RELATION_OF = {("person", "person"): "works_with", ("person", "location"): "based_in"}
STOP = ("the", "this", "that", "these", "those", "there", "and", "but", "for", "with", "from", "when", "what", "where", "which", "who", "how", "its", "our", "their")


def sentences(docs: DataFrame) -> DataFrame:
    """(doc, n, sentence) of texts."""
    return docs.select("doc", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("n", "sentence"))


#: Names up to so many bytes are one automaton for every task; of more, each slice of texts gets those that can occur in it.
AUTOMATON_BYTES = 4 << 20
#: Bytes of text in such a slice.
SLICE_BYTES = 16 << 20


def _automaton(keys: list[str]):
    """An automaton with failure links that finds whole names (words with one space between) in one pass, however long or nested they are."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for key in keys:
        out.add_word(f" {key} ", key)
    if keys:
        out.make_automaton()
    return out


def _found_in(automaton, words: str | None) -> set[str]:
    return {key for _, key in automaton.iter(f" {words} ")} if words and len(automaton) else set()


def gazetteer_entities(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc, label, type): names of ``known`` (label, type) among the words of a text, each once for a text.

    A text is read once, whatever the lengths and the number of the names. A small list of names is sent to all tasks. For a large one, each slice of texts meets the names
    whose first words stand in it, and builds its automaton of those.
    """
    kind = docs.schema["doc"].dataType.simpleString()
    names = known.where("label IS NOT NULL").select("label", "type", F.array_join(tokens("label"), " ").alias("key")).where("key <> ''").distinct()
    names = cut_lineage(names)
    texts = docs.select("doc", F.array_join(tokens("text"), " ").alias("words"))
    if (names.agg(F.sum(F.octet_length("key"))).first()[0] or 0) <= AUTOMATON_BYTES:
        sent = docs.sparkSession.sparkContext.broadcast([r.key for r in names.select("key").distinct().collect()])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(sent.value)
            for batch in batches:
                found = [(i, key) for i, words in enumerate(batch.column("words").to_pylist()) for key in _found_in(automaton, words)]
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array([i for i, _ in found], pa.int64())), pa.array([k for _, k in found], pa.string())], ["doc", "key"])

        hits = texts.mapInArrow(scan, f"doc {kind}, key string")
    else:
        hits = _sliced_hits(texts, names.select("key").distinct(), kind)
    return hits.join(names, "key").select("doc", "label", "type").distinct()


#: Lengths of the openings of names (in words) by which slices are found; a name goes by the longest that it has.
OPENINGS = (1, 2, 4, 8)
#: Names' openings up to so many are looked up as bits, ``OPENING_BITS`` for each; of more, more of what a text has passes.
MOST_OPENINGS, OPENING_BITS = 1 << 20, 64
#: Words that a task looks up at once.
READ_WORDS = 1 << 20


def _openings(word: np.ndarray) -> list[np.ndarray]:
    """For each of ``OPENINGS`` a hash of so many words from every place on; the last places run over the end."""
    out, runs = [], word.astype(np.uint64)
    for k in OPENINGS:
        if k > 1:
            after = np.r_[runs[k // 2 :], np.zeros(min(k // 2, len(runs)), np.uint64)]
            runs = (runs * np.uint64(0x9E3779B97F4A7C15)) ^ (after + np.uint64(0x632BE59BD9B4E019) + (runs >> np.uint64(29)))
        out.append(runs)
    return out


def _key_openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, opening) of names (key, words as hashes)."""
    for batch in batches:
        n = pc.list_value_length(batch.column("words")).to_numpy()
        first = np.cumsum(n) - n
        runs = _openings(batch.column("words").flatten().to_numpy())
        kind = np.searchsorted(OPENINGS, n, side="right") - 1
        own = np.stack(runs)[kind, first] if len(n) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(own.view(np.int64))], ["key", "opening"])


def _text_openings(sent):
    """A task over (slice, words as hashes): (slice, opening) of those openings of a text that some name may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            piece = np.cumsum(pc.list_value_length(batch.column("words")).to_numpy(), dtype=np.int64) // READ_WORDS
            for p in np.unique(piece):
                here = np.flatnonzero(piece == p)
                part = batch.slice(here[0], len(here))
                n = pc.list_value_length(part.column("words")).to_numpy()
                left = np.repeat(np.cumsum(n), n) - np.arange(n.sum())
                row = np.repeat(part.column("slice").to_numpy(), n)
                slices, found = [], []
                for k, hashes in zip(OPENINGS, _openings(part.column("words").flatten().to_numpy())):
                    place = hashes % np.uint64(8 * len(bits))
                    good = (left >= k) & ((bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                    slices.append(row[good])
                    found.append(hashes[good].view(np.int64))
                at, opening = np.concatenate(slices), np.concatenate(found)
                order = np.lexsort((opening, at))
                at, opening = at[order], opening[order]
                new = np.r_[True, (at[1:] != at[:-1]) | (opening[1:] != opening[:-1])][: len(at)]
                yield pa.RecordBatch.from_arrays([pa.array(at[new]), pa.array(opening[new])], ["slice", "opening"])

    return run


def _sliced_hits(texts: DataFrame, keys: DataFrame, kind: str) -> DataFrame:
    """Slices of texts meet the names whose first words (eight, four, two or one) stand somewhere in them, so a long name goes to few slices however common its words are."""
    size = texts.agg(F.sum(F.octet_length("words").cast("long"))).first()[0] or 0
    slices = max(1, size // SLICE_BYTES)
    texts = texts.withColumn("slice", F.pmod(F.xxhash64(F.to_json(F.struct("doc")), "words"), F.lit(slices)))
    opened = cut_lineage(keys.select("key", F.expr("transform(split(key, ' '), w -> xxhash64(w))").alias("words")).mapInArrow(_key_openings, "key string, opening long"))
    several = opened.select("opening").distinct()
    width = 8 * max(1, min(several.count(), MOST_OPENINGS) * OPENING_BITS // 8)
    # bits by bytes, so the driver gets no more rows than the bits have bytes
    place = F.expr(f"cast(pmod(cast(if(opening < 0, opening + 18446744073709551616BD, opening) AS decimal(20,0)), {width}BD) AS long)")
    marked = several.select(place.alias("p")).groupBy(F.expr("p div 8").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(p % 8 AS int))")).alias("b")).toArrow()
    bits = np.zeros(width // 8, np.uint8)
    bits[marked.column("byte").to_numpy()] = marked.column("b").to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(bits.tobytes())
    held = texts.select("slice", F.expr("transform(split(words, ' '), w -> xxhash64(w))").alias("words")).mapInArrow(_text_openings(sent), "slice long, opening long").distinct()
    local = cut_lineage(opened.join(held, "opening").select("slice", "key"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        automaton = _automaton(right.column("key").to_pylist())
        found = [(i, key) for i, text in enumerate(left.column("words").to_pylist()) for key in _found_in(automaton, text)]
        return pa.table({"doc": left.column("doc").take(pa.array([i for i, _ in found], pa.int64())), "key": pa.array([k for _, k in found], pa.string())})

    return texts.groupBy("slice").cogroup(local.groupBy("slice")).applyInArrow(scan, f"doc {kind}, key string")


def capital_entities(docs: DataFrame) -> DataFrame:
    """(doc, label): words of three letters or more with a capital that don't begin a sentence and aren't stop words."""
    words = sentences(docs).select("doc", F.explode(F.expr("slice(split(sentence, '\\\\s+'), 2, greatest(size(split(sentence, '\\\\s+')) - 1, 0))")).alias("w"))
    clean = words.select("doc", F.regexp_replace("w", r"^[^\p{L}]+|[^\p{L}\p{N}]+$", "").alias("label"))
    return clean.where(F.col("label").rlike(r"^\p{Lu}[\p{L}\p{N}-]{2,}$") & ~F.lower("label").isin(*STOP)).distinct()


def first_tier(mentions: DataFrame) -> DataFrame:
    """Of mentions (doc, start, label, type, tier) with the same place, the one of the lowest tier number."""
    order = Window.partitionBy("doc", "start").orderBy("tier", "label")
    return mentions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def typed(mentions: DataFrame) -> DataFrame:
    """Mentions with our types for a tagger's ``ner_label``; numbers are dropped, unknown labels are concepts."""
    table = F.create_map(*[F.lit(x) for pair in TYPE_OF.items() for x in pair])
    return mentions.where(~F.col("ner_label").isin(*DROPPED_TYPES)).withColumn("type", F.coalesce(F.element_at(table, F.col("ner_label")), F.lit("concept")))


def mention_confidence(mentions: DataFrame) -> DataFrame:
    """Adds confidence from ner_label, label and at_edge (whether it stands at a sentence's edge)."""
    sure = F.lit(0.70) + F.when(F.col("ner_label").isin("ORG", "PERSON", "GPE"), 0.10).otherwise(0.0)
    sure = sure + F.when(F.trim("label").contains(" "), 0.05).otherwise(0.0) - F.when(F.col("at_edge"), 0.05).otherwise(0.0)
    return mentions.withColumn("confidence", F.round(F.least(sure, F.lit(0.95)), 4))


#: (relation, pattern) of sentences; the groups are subject and object.
PATTERNS = [
    ("is_a", r"(?i)\b([\p{L}][\p{L}\p{N} -]{1,40}?) is an? ([\p{L}][\p{L}\p{N}-]*(?: [\p{L}\p{N}-]+)?)"),
    ("created_by", r"(?i)\b([\p{L}][\p{L}\p{N} -]{1,40}?) was (?:created|developed|founded) by ([\p{L}][\p{L}\p{N}-]*(?: [\p{Lu}][\p{L}\p{N}-]+)*)"),
    ("used_for", r"(?i)\b([\p{L}][\p{L}\p{N} -]{1,40}?) is used for ([\p{L}][\p{L}\p{N} -]{1,40})"),
    ("supports", r"(?i)\b([\p{L}][\p{L}\p{N}-]*) supports ([\p{L}][\p{L}\p{N} -]{1,40})"),
]


def template_patterns(templates: dict[str, str]) -> list[tuple[str, str]]:
    """(relation, pattern) of templates; one without both ends, or with a name that isn't letters, digits and _, raises ValueError."""
    ends = {"{head}": r"([\p{L}][\p{L}\p{N}_ -]{0,40}?)", "{tail}": r"([\p{L}][\p{L}\p{N}_-]*(?: [\p{Lu}][\p{L}\p{N}_-]+)*)"}
    out = []
    for rel, text in templates.items():
        parts = re.split(r"(\{head\}|\{tail\})", text)
        if not re.fullmatch(r"\w+", rel) or [p for p in parts if p in ends] != ["{head}", "{tail}"] or not parts[2].strip() or "'" in text or '"' in text:
            raise ValueError(f"template {rel}: {text!r} needs {{head}}, words and {{tail}}, without quotes")
        escaped = (ends.get(p) or r"\s+".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in re.split(r"\s+", p)) for p in parts)
        out.append((rel, r"(?i)\b" + "".join(escaped)))
    return out


def pattern_relations(found: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc, src, rel, dst) of sentences (doc, n, sentence), by the fixed patterns and those of ``templates``."""
    each = [
        f"zip_with(regexp_extract_all(sentence, r\"{p}\", 1), regexp_extract_all(sentence, r\"{p}\", 2), (s, o) -> named_struct('src', trim(s), 'rel', '{rel}', 'dst', trim(o)))"
        for rel, p in [*PATTERNS, *template_patterns(templates or {})]
    ]
    pairs = F.expr(f"concat({', '.join(each)})")
    return found.select("doc", F.inline(pairs)).where("src <> '' AND dst <> ''").distinct()


#: Pronouns that a sentence may begin with, and whether they stand for persons (None: for either).
PRONOUNS = {"He": True, "She": True, "It": False, "They": None}


def name_pronouns(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` (doc, text) with names for the pronouns that begin sentences, and how many (pronouns).

    A pronoun stands for the last entity before it in its document that may be meant: a known name (label, type), or the subject of a relation. Persons
    answer to He and She, others to It. One that has none before it stays; so does the text of a document without any.
    """
    cut = cut_lineage(sentences(docs))
    which = F.regexp_extract("sentence", rf"^({'|'.join(PRONOUNS)})\b", 1)
    marked = cut.withColumn("pronoun", which)
    asked = marked.where("pronoun <> ''")
    cut = cut.join(asked.select("doc").distinct(), "doc", "left_semi")
    own = cut.select(F.struct("doc", "n").alias("doc"), F.col("sentence").alias("text"))
    named = gazetteer_entities(own, known).select("doc", "label", F.col("type") == "person")
    subjects = pattern_relations(own.select("doc", F.lit(0).alias("n"), F.col("text").alias("sentence"))).select("doc", F.col("src").alias("label"), F.lit(False))
    subjects = subjects.where(~F.col("label").isin(*PRONOUNS))
    every = named.toDF("at", "label", "person").unionByName(subjects.toDF("at", "label", "person")).select("at.doc", "at.n", "label", "person")
    # of a name that is both, the known one counts
    every = every.groupBy("doc", "n", "label").agg(F.max("person").alias("person")).join(cut, ["doc", "n"])
    rows = every.select("doc", "n", F.expr("instr(lower(sentence), lower(label))").alias("place"), "label", "person", F.lit("").alias("pronoun"))
    rows = rows.unionByName(asked.select("doc", "n", F.lit(0).alias("place"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("boolean").alias("person"), "pronoun"))
    before = Window.partitionBy("doc").orderBy("n", "place", "label").rowsBetween(Window.unboundedPreceding, -1)
    last = {p: F.last(F.when(F.lit(True) if p is None else F.col("person") == p, F.col("label")), ignorenulls=True).over(before) for p in (True, False, None)}
    meant = F.coalesce(*(F.when(F.col("pronoun") == w, last[p]) for w, p in PRONOUNS.items()))
    meant = rows.withColumn("meant", meant).where("pronoun <> '' AND meant IS NOT NULL").select("doc", "n", "pronoun", "meant")
    told = marked.drop("pronoun").join(meant, ["doc", "n"], "left").withColumn("sentence", F.expr("if(meant IS NULL, sentence, concat(meant, substring(sentence, length(pronoun) + 1)))"))
    new = told.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda x: x.sentence), " ").alias("_text"), F.count("meant").alias("pronouns"))
    return docs.join(new, "doc", "left").select("doc", F.when(F.col("pronouns") > 0, F.col("_text")).otherwise(F.col("text")).alias("text"), F.coalesce("pronouns", F.lit(0)).alias("pronouns"))


def co_mentions(mentions: DataFrame) -> DataFrame:
    """(a, b, n, confidence): labels in the same sentence; ``mentions`` is (doc, n, label)."""
    own = mentions.select("doc", "n", "label").distinct()
    pairs = own.alias("x").join(own.alias("y"), F.expr("x.doc = y.doc AND x.n = y.n AND x.label < y.label"))
    return pairs.groupBy(F.expr("x.label AS a"), F.expr("y.label AS b")).agg(F.count(F.lit(1)).alias("n")).withColumn("confidence", F.lit(0.40))


def default_relations(pairs: DataFrame) -> DataFrame:
    """Adds rel to pairs (type_a, type_b) by the table of defaults, in either order."""
    table = F.create_map(*[F.lit(x) for (a, b), r in RELATION_OF.items() for x in (f"{a}|{b}", r)])
    return pairs.withColumn("rel", F.coalesce(F.element_at(table, F.concat_ws("|", "type_a", "type_b")), F.element_at(table, F.concat_ws("|", "type_b", "type_a")), F.lit("related_to")))


def triage(relations: DataFrame) -> DataFrame:
    """Adds tier: confirmed from .70, likely from .50, uncertain below, no_relation without a relation."""
    c = F.col("confidence")
    return relations.withColumn("tier", F.when(F.col("rel").isNull(), "no_relation").when(c >= 0.70, "confirmed").when(c >= 0.50, "likely").otherwise("uncertain"))


def review(staged: DataFrame, decisions: DataFrame) -> DataFrame:
    """Staged relations (idx, ...) that decisions (idx, action, new_rel) accept or modify."""
    joined = staged.join(decisions, "idx").where(F.col("action").isin("accepted", "modified"))
    return joined.withColumn("rel", F.when(F.col("action") == "modified", F.col("new_rel")).otherwise(F.col("rel"))).select(*staged.columns)


def resolve_entities(labels: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, step, similarity): labels that mean the same.

    Steps: equal but for case, equal letters and digits, equal sets of words (each with the least label of its class), and edit distance over
    the longer length. Candidates of the last step are found without misses: labels within d edits differ in at most 2 d of their pairs of
    letters, so of each label's pairs, in a fixed order with the rarest first, the first 2 d + 1 must hold one that they share.
    """
    own = labels.select("label").distinct().withColumns(
        {"_lower": F.lower("label"), "_plain": F.regexp_replace(F.lower("label"), r"[^\p{L}\p{N}]+", ""), "_set": F.array_join(F.array_sort(F.array_distinct(tokens("label"))), " ")}
    )
    own = cut_lineage(own)
    out = None
    for number, key in enumerate(("_lower", "_plain", "_set"), 1):
        pairs = own.where(F.col(key) != "").select(F.col(key).alias("_k"), F.col("label").alias("b")).join(own.groupBy(F.col(key).alias("_k")).agg(F.min("label").alias("a")), "_k").where("a < b")
        found = pairs.select("a", "b", F.lit(number).alias("step"), F.lit(1.0).alias("similarity"))
        out = found if out is None else out.unionByName(found)
    # pairs of letters, numbered where they repeat, of the label with a mark at both ends
    grams = own.where("_lower <> ''").withColumn("_g", F.expr("transform(sequence(1, length(_lower) + 1), i -> substring(concat(chr(2), _lower, chr(3)), i, 2))"))
    grams = grams.withColumn("_g", F.expr("transform(_g, (g, i) -> concat(g, size(filter(slice(_g, 1, i), h -> h = g))))"))
    rare = grams.select(F.explode("_g").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # edits that the longest label it may be like would allow
    allowed = F.floor((1 - threshold) * F.length("_lower") / threshold + 1e-9).cast("int")
    ranked = grams.select("label", "_lower", "_plain", "_set", allowed.alias("_d"), F.explode("_g").alias("g")).join(rare, "g")
    ranked = ranked.groupBy("label", "_lower", "_plain", "_set", "_d").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("_g"))
    first = cut_lineage(ranked.select("label", "_lower", "_plain", "_set", F.explode(F.expr("slice(_g, 1, 2 * _d + 1)")).alias("_e")).withColumn("_e", F.col("_e.g")))
    near = first.alias("x").join(first.alias("y"), F.expr("x._e = y._e AND x.label < y.label AND x._plain <> y._plain AND x._set <> y._set"))
    most = F.floor((1 - threshold) * F.greatest(F.length("x._lower"), F.length("y._lower")) + 1e-9)
    near = near.where(F.abs(F.length("x._lower") - F.length("y._lower")) <= most).select(F.expr("x.label AS a"), F.expr("y.label AS b"), F.expr("x._lower AS la"), F.expr("y._lower AS lb"), most.alias("_m")).distinct()
    size = F.greatest(F.length("la"), F.length("lb"))
    near = near.withColumn("_l", F.levenshtein("la", "lb")).where("_l <= _m").select("a", "b", F.lit(4).alias("step"), F.round(1 - F.col("_l") / size, 4).alias("similarity"))
    every = out.unionByName(near)
    return every.groupBy("a", "b").agg(F.min("step").alias("step"), F.max("similarity").alias("similarity"))


def cross_document(mentions: DataFrame) -> DataFrame:
    """(label, docs, confirmations): an entity in n documents has n - 1 confirmations."""
    return mentions.groupBy("label").agg(F.countDistinct("doc").alias("docs")).withColumn("confirmations", F.col("docs") - 1)


#: A label's documents are dealt to so many tasks.
SALTS = 64


def document_links(mentions: DataFrame, least: int = 1) -> DataFrame:
    """(doc_a, doc_b, shared): documents that share entities.

    A document with one entity shares no other, so only pairs of documents with several are counted; the rest are rows of a join that holds none
    of them. The documents of a label are dealt by salt, so that no label is a single task.
    """
    own = mentions.where("doc IS NOT NULL AND label IS NOT NULL").select("doc", "label").distinct()
    several = own.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", F.lit(True).alias("several"))
    own = cut_lineage(own.join(several, "doc", "left").withColumn("several", F.coalesce("several", F.lit(False))))
    one = own.select(F.col("doc").alias("doc_a"), "label", F.col("several").alias("_a"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("_s"))
    other = own.select(F.col("doc").alias("doc_b"), "label", F.col("several").alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_s"))
    # sorted runs are read row by row: neither side is a table in memory
    pairs = one.hint("merge").join(other, ["label", "_s"]).where("doc_a < doc_b")
    single = pairs.where("NOT (_a AND _b)").select("doc_a", "doc_b", F.lit(1).cast("long").alias("shared")).where(F.col("shared") >= least)
    both = one.where("_a").hint("merge").join(other.where("_b"), ["label", "_s"]).where("doc_a < doc_b")
    return single.unionByName(both.groupBy("doc_a", "doc_b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least))


def content_hash(docs: DataFrame) -> DataFrame:
    """Adds hash: SHA-256 of the text in lower case without white space around it."""
    return docs.withColumn("hash", F.sha2(F.lower(F.trim("text")), 256))


def drop_copies(docs: DataFrame) -> DataFrame:
    """(hash, doc, copies): the least document of each content."""
    return content_hash(docs).groupBy("hash").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"))


COMMON_WORDS = {
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "zu", "den", "mit"],
    "en": ["the", "and", "of", "to", "in", "is", "that", "it", "for", "with"],
    "es": ["el", "los", "que", "y", "las", "por", "una", "con", "para", "del"],
    "fr": ["le", "les", "et", "est", "une", "dans", "qui", "pour", "pas", "du"],
}


def detect_language(docs: DataFrame) -> DataFrame:
    """Adds detected: the language with most of its commonest words in the text, the alphabetically first of equals."""
    words = docs.withColumn("_w", tokens("text"))
    votes = F.array(*[F.struct(F.expr("size(filter(_w, w -> w IN ({})))".format(", ".join(f"'{x}'" for x in ws))).alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")) for i, (lang, ws) in enumerate(COMMON_WORDS.items())])
    return words.withColumn("detected", F.array_max(votes)["lang"]).drop("_w")


def provenance(entities: DataFrame, facts: DataFrame, docs: DataFrame) -> DataFrame:
    """(label, fact_id, doc, publisher): entity, its facts (fact_id, label, doc), their documents (doc, publisher)."""
    return entities.select("label").join(facts, "label").join(docs.select("doc", "publisher"), "doc", "left").select("label", "fact_id", "doc", "publisher")


def set_status(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Facts after reviews (fact_id, decision): confirmed or debunked; debunked ones have confidence 0."""
    joined = facts.join(decisions, "fact_id", "left")
    return joined.withColumns({"status": F.coalesce("decision", "status"), "confidence": F.when(F.col("decision") == "debunked", 0.0).otherwise(F.col("confidence"))}).drop("decision")


def ledger(queries: DataFrame) -> DataFrame:
    """(source, total, dedup_hits, cache_hit_rate, error_rate) of queries (source, text, cached, failed)."""
    seen = queries.groupBy("source", F.lower(F.trim("text")).alias("_t")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cached")).alias("c"), F.count_if("failed").alias("f"))
    return seen.groupBy("source").agg(F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("dedup_hits"), F.round(F.sum("c") / F.sum("n"), 4).alias("cache_hit_rate"), F.round(F.sum("f") / F.sum("n"), 4).alias("error_rate"))


def subsumed(queries: DataFrame) -> DataFrame:
    """(text, by): queries whose words are all in an earlier one's; compared along shared words."""
    own = queries.select("text", "ts", F.array_distinct(tokens("text")).alias("w")).where("size(w) > 0")
    rare = own.select(F.explode("w").alias("k")).groupBy("k").count()
    key = own.select("text", "ts", "w", F.explode("w").alias("k")).join(rare, "k").groupBy("text", "ts", "w").agg(F.min_by("k", F.struct("count", "k")).alias("k"))
    other = own.select(F.col("text").alias("by"), F.col("ts").alias("_ts"), F.col("w").alias("_w"), F.explode("w").alias("k"))
    return key.join(other, "k").where("_ts < ts AND size(array_except(w, _w)) = 0").groupBy("text").agg(F.min("by").alias("by"))


#: Characters of a Python source that are parsed at once, where its statements allow it.
PARSED = 1 << 16
#: Where a statement of a module may begin: no blank, comment or clause of the statement before.
_STATEMENT = re.compile(r"^(?!(?:else|elif|except|finally)\b)[^\s#]", re.MULTILINE)


def _pieces(text: str) -> Iterator[ast.Module]:
    """Trees of a source's statements, some at a time, so that the memory doesn't follow the length of the file.

    A piece ends before a line that may begin a statement. If it isn't whole there (an open bracket or string, a decorator alone), it goes on
    for twice as long; an error is one only if it is left at the end of the file.
    """
    at, want = 0, PARSED
    while at < len(text) or not at:
        cut = None
        if at + want < len(text):
            # lines end with a line feed alone here, so what looks like a line's start is one
            newline = text.find("\n", at + want)
            cut = _STATEMENT.search(text, newline + 1) if newline >= 0 else None
            while cut and text[cut.start() - 1] != "\n":
                cut = _STATEMENT.search(text, cut.end())
        end = cut.start() if cut else len(text)
        try:
            tree = ast.parse(text[at:end])
        except (SyntaxError, ValueError):
            if end == len(text):
                raise
            want *= 2
            continue
        yield tree
        at, want = max(end, 1), PARSED


def _named(path: str, text: str | None) -> pa.RecordBatch:
    kinds, names = [["module"]], [[re.sub(r"\.py$", "", path.rsplit("/", 1)[-1])]]
    try:
        for tree in _pieces(text or ""):
            found = []
            for node in ast.walk(tree):
                if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    found.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name))
                elif isinstance(node, ast.Import):
                    found += [("import", a.name) for a in node.names]
                elif isinstance(node, ast.ImportFrom) and node.module:
                    found.append(("import", node.module))
            kinds.append(pa.array([k for k, _ in found], pa.string()))
            names.append(pa.array([n for _, n in found], pa.string()))
    except (SyntaxError, ValueError):
        kinds, names = [["error"]], [["not Python"]]
    kinds, names = (pa.concat_arrays([pa.array(x, pa.string()) for x in c]) for c in (kinds, names))
    return pa.RecordBatch.from_arrays([pa.array([path], pa.string()).take(pa.array(np.zeros(len(kinds), np.int64))), kinds, names], ["path", "kind", "name"])


def python_modules(files: DataFrame) -> DataFrame:
    """(path, kind, name): modules, classes, functions and imports of Python sources (path, text)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path"), batch.column("text")):
                yield _named(path.as_py(), text.as_py())

    return files.select("path", "text").mapInArrow(parse, "path string, kind string, name string")
