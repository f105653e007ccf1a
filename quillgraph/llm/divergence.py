"""Source divergence audit: how far the term shares of each (lang, source) lie from each other source's and from the whole language's.

Two passes. The first normalises the texts once, cuts them into slices of about ``SLICE`` bytes and writes each slice with the
terms of its documents and the number of documents that have each; their sums are exact document frequencies, and a language keeps the terms
of at least ``MIN_DOCS`` documents. The second meets each slice with the kept terms that occur in it, builds a pyahocorasick automaton of
them, padded with the delimiter on both sides, and recounts their occurrences in the slice. So a task's automaton is bounded by its slice, whatever the vocabulary.

Counts are sparse postings (lang, source, term, n): a term that a source lacks has no row. For pairs of sources, postings are dealt by blocks of terms
and of sources; a task fills in the smoothed shares of what is missing and sums the absolute differences, and terms that neither block has are added by
their number. All shares are integers (billionths, rounded down), so sums don't depend on order.

Defined cases: null text, lang and source are ''; a group without terms still has its pairs, and a language without kept terms gives 0 for them; repeated
rows are documents of their own; texts of any length are read whole, and a slice is never less than a document; of equal values the item that comes first in UTF-8
has the lower rank; an empty table gives no rows. Only text, lang and source are read, so other columns can't clash.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize
from .textkit import tidy

MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
SLICE = 16 << 20
#: Sources in a block, and least cells (terms by sources) of a task's matrix; it has as many terms as sources at least, for it returns every pair of sources.
SOURCES, CELLS = 512, 1 << 16
#: Letters lower-cased, bytes of other characters kept, all else a space.
TERM_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])
SLICES = "slice long, lang string, source string, body binary, terms array<string>, n array<long>"


def _rows(bodies: dict[tuple[str, str], list[bytes]], found: dict[str, Counter]) -> pa.RecordBatch:
    """A slice: a row for each group with its texts, and one for each language with its terms."""
    number = uuid.uuid4().int >> 65
    pressed = zstandard.ZstdCompressor(level=3)
    rows = [(number, lang, source, pressed.compress(b" ".join(parts)), None, None) for (lang, source), parts in bodies.items()]
    rows += [(number, lang, None, None, [t.decode() for t in terms], list(terms.values())) for lang, terms in found.items()]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["slice", "lang", "source", "body", "terms", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bodies: dict[tuple[str, str], list[bytes]] = {}
    found: dict[str, Counter] = {}
    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            words = text.encode().translate(TERM_BYTES).split()
            found.setdefault(lang, Counter()).update(set(words))
            bodies.setdefault((lang, source), []).append(b" ".join(words))
            held += len(text)
            if held > SLICE:
                yield _rows(bodies, found)
                bodies, found, held = {}, {}, 0
    if bodies:
        yield _rows(bodies, found)


def _recount(left: pa.Table, right: pa.Table) -> pa.Table:
    """Occurrences of the kept terms (right) in the texts of a slice (left)."""
    import ahocorasick

    kept: dict[str, list[str]] = {}
    for lang, term in zip(right.column("lang").to_pylist(), right.column("term").to_pylist()):
        kept.setdefault(lang, []).append(term)
    parts = []
    for lang, terms in kept.items():
        automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            automaton.add_word(f" {term} ", i)
        automaton.make_automaton()
        names = pa.array(terms, pa.string())
        mine = left.filter(pa.compute.equal(left.column("lang"), lang))
        for source, body in zip(mine.column("source").to_pylist(), mine.column("body").to_pylist()):
            text = zstandard.ZstdDecompressor().decompress(body).decode()
            times = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(f" {text} ")), np.int64), minlength=len(terms))
            held = np.flatnonzero(times)
            repeated = [pa.repeat(pa.scalar(x, pa.string()), len(held)) for x in (lang, source)]
            parts.append(pa.table([*repeated, names.take(pa.array(held)), pa.array(times[held], pa.int64())], COUNTED.names))
    return pa.concat_tables(parts) if parts else COUNTED.empty_table()


def postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept terms (lang, term), their occurrences (lang, source, term, n), and all groups (lang, source) that occur."""
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    cut = materialize(read.mapInArrow(tidy(_cut), SLICES), "slices")
    bodies = cut.where("source is not null").select("slice", "lang", "source", "body")
    terms = cut.where("source is null").select("slice", "lang", F.explode(F.arrays_zip("terms", "n")).alias("t")).select("slice", "lang", "t.terms", "t.n")
    terms = terms.withColumnRenamed("terms", "term")
    kept = materialize(terms.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term"), "kept-terms")
    local = terms.join(kept, ["lang", "term"]).select("lang", "term", "slice")
    local = local.toDF("lang", "term", "slice")  # new names of the columns, for both sides come from one table
    counted = bodies.groupBy("slice").cogroup(local.groupBy("slice")).applyInArrow(_recount, "lang string, source string, term string, n long")
    counts = materialize(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "postings")
    return kept, counts, bodies.select("lang", "source").distinct()


def _share(n: str, total: str) -> F.Column:
    """The smoothed share of a term: exact integers, for the product passes 64 bits."""
    return F.expr(f"1 + cast({SCALE} as decimal(20, 0)) * ({n} + {SMOOTH}) div ({total} + {SMOOTH} * v)")


def _differences(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of two blocks of sources (left) and some terms (right): the summed differences of each pair, and the number of terms seen."""
    lang, low, high = (left.column(c)[0].as_py() for c in ("lang", "low", "high"))
    name = left.column("source").to_pylist()
    block, rest = left.column("own").to_numpy(), left.column("p0").to_numpy()
    place = {s: i for i, s in enumerate(name)}
    terms = right.column("term").combine_chunks().dictionary_encode()
    width = len(terms.dictionary)
    shares = np.repeat(rest[:, None], width, axis=1)
    shares[[place[s] for s in right.column("source").to_pylist()], terms.indices.to_numpy(zero_copy_only=False)] = right.column("p").to_numpy()
    a, b, value = [], [], []
    of_low, of_high = np.flatnonzero(block == low), np.flatnonzero(block == high)
    for k, i in enumerate(of_low):
        others = of_high[k + 1 :] if low == high else of_high
        a += [name[i]] * len(others)
        b += [name[j] for j in others]
        value += np.abs(shares[others] - shares[i]).sum(axis=1).tolist()
    columns = [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())]
    rests = [pa.array(rest[[place[s] for s in side]] if side else [], pa.int64()) for side in (a, b)]
    return pa.table([*columns, pa.array([width] * len(a), pa.int64()), *rests], ["lang", "a", "b", "value", "seen", "p0_a", "p0_b"])


def distances(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, item, value): each source of a language against each other one. ``groups`` has total and v, counts too."""
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s"), F.first("v").alias("v"))
    sizes = sizes.withColumn("w", F.least("s", F.lit(2 * SOURCES)))
    sizes = sizes.select("lang", F.ceil(F.col("s") / SOURCES).cast("int").alias("blocks"), F.ceil(F.col("v") * F.col("w") / F.greatest(F.lit(CELLS), F.col("w") * F.col("w"))).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    pair = F.explode(F.expr("transform(sequence(0, blocks - 1), o -> struct(least(own, o) as low, greatest(own, o) as high))"))

    def dealt(df: DataFrame, part: F.Column) -> DataFrame:
        met = df.join(sizes, "lang").withColumn("own", own).withColumn("part", part)
        return met.withColumn("pair", pair).select(*df.columns, "own", "part", "pair.low", "pair.high")

    heads = dealt(groups.select("lang", "source", F.when(F.col("v") > 0, _share("0", "total")).otherwise(F.lit(0)).alias("p0")), F.explode(F.expr("sequence(0, greatest(parts, 1) - 1)")))
    shares = dealt(counts.select("lang", "source", "term", _share("n", "total").alias("p")), F.pmod(F.xxhash64("term"), F.greatest(F.col("parts"), F.lit(1))).cast("int"))
    key = ["lang", "part", "low", "high"]
    kinds = "lang string, a string, b string, value long, seen long, p0_a long, p0_b long"
    shares = shares.toDF(*shares.columns)
    summed = heads.groupBy(*key).cogroup(shares.groupBy(*key)).applyInArrow(_differences, kinds)
    summed = summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.first("p0_a").alias("p0_a"), F.first("p0_b").alias("p0_b"))
    whole = F.col("value") + (F.col("v") - F.col("seen")) * F.abs(F.col("p0_a") - F.col("p0_b"))
    one = summed.join(groups.select("lang", "v").distinct(), "lang").select("lang", "a", "b", whole.alias("value"))
    one = materialize(one, "distances")
    return one.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(one.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has all other sources of the language, ``term`` the ``top`` terms used more than in it."""
    kept, counts, groups = postings(docs, min_docs)
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = materialize(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v"))), "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    sized = counts.join(groups, ["lang", "source"])
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")).join(langs, "lang")
    p, q = _share("n", "total"), _share("lang_n", "lang_total")
    terms = sized.join(of_lang, ["lang", "term"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (distances(groups, sized), terms)]
    pairs, terms = ranked[0].withColumn("part", F.lit("pair")), ranked[1].where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


SQL = f"""
with docs as (
    select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as words
    from documents
),
words as (select lang, source, row, unnest(words) as term from docs),
kept as (select lang, term from words group by lang, term having count(distinct row) >= {MIN_DOCS}),
counts as (select w.lang, w.source, w.term, count(*) as n from words w join kept using (lang, term) group by all),
groups as (
    select g.lang, g.source, coalesce(t.total, 0) as total, coalesce(v.v, 0) as v
    from (select distinct lang, source from docs) g
    left join (select lang, source, sum(n) as total from counts group by all) t on t.lang = g.lang and t.source = g.source
    left join (select lang, count(*) as v from kept group by lang) v on v.lang = g.lang
),
shares as (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + {SMOOTH})) // (g.total + {SMOOTH} * g.v) as p
    from groups g join kept k on k.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
),
whole as (
    select lang, term, 1 + ({SCALE}::hugeint * (sum(n) + {SMOOTH})) // (sum(sum(n)) over (partition by lang) + {SMOOTH} * count(*) over (partition by lang)) as q
    from shares group by lang, term
),
pairs as (
    select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join shares x on x.lang = a.lang and x.source = a.source
    left join shares y on y.lang = b.lang and y.source = b.source and y.term = x.term
    group by all
),
terms as (
    select s.lang, s.source, s.term as item, (s.p - w.q)::bigint as value
    from shares s join whole w using (lang, term) where s.n > 0 and s.p > w.q
),
ranked as (
    select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
    union all
    select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from terms
)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= {TOP}
"""
