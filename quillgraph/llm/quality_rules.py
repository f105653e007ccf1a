"""Quality rules whose cutoffs are certified on labelled holdouts. DataFrame functions only.

Every rule is a share between 0 and 1 that is high in bad text. For each rule, stratum (language) and
cutoff of the rule's grid, the labelled good documents beyond the cutoff are counted. A cutoff may be used
when the exact binomial test refutes "the rule rejects more than its part of ``max_false_rejection`` of
the stratum's good documents": P(Bin(n, a) <= k) <= level. The level is divided by the number of
all tests (rules, cutoffs and strata: Bonferroni), so with probability 1 - delta no cutoff in use breaks
its limit; the limits of a stratum's rules, PARTS of it, sum up to ``max_false_rejection``. Of the cutoffs that
may be used, the lowest is taken; a rule that has none in a stratum is off there. Good documents are those of quality 1 that aren't toxic.

One rule is the share of words that toxic documents hold and others don't. Labels are split in two halves by a mix of the id's bits: the words are learned from one
half, of which SAMPLE toxic and SAMPLE other labels at most are read (those of the least mix), and every cutoff is certified on the other half alone, which no word has seen.
At least a tenth of a language's sampled toxic documents and ten of them hold a word, and by share a hundred times as many as of its others; the words count in texts of that
language, and each language has all of its own (no more than ten times the mean number of words of a toxic document can reach the tenth).

Nulls and odd rows: a null text has no words and fails the base rules; a null language is a stratum of its own; labels
with a null id, quality or toxic count nowhere (a null toxic is no toxic document where quality is known); documents whose id has two labels, and
equal rows, count once for each pair. Empty tables: without documents there are no rows, without labels all rules are off. Texts of any length are
counted within their row. Of cutoffs with equal counts the lowest is taken, of words with equal counts the alphabetically first.
Columns of the input called like the added ones are kept by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

WHITE = r"[\x20\x09-\x0D]"
GRID = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)
#: Rule: numerator and denominator among the columns of ``signals``.
GRIDS = {"symbol_share": GRID, "dup_line_share": GRID, "repeat_share": GRID, "toxic_share": (0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2)}
RULES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "toxic_share": ("n_toxic_words", "n_words"),
}
#: Each rule's part of the false rejections that are allowed.
PARTS = {"symbol_share": 0.1, "dup_line_share": 0.1, "repeat_share": 0.1, "toxic_share": 0.7}
#: Rows of labels that toxic words are learned from, of each class.
SAMPLE = 10_000
#: SQL of a mix of an id's bits, the same in both dialects; its lowest bit deals labels to learning (0) and certifying (1).
MIXED = "(doc_id + doc_id // 32 + doc_id // 2048 + doc_id // 131072)"
LEARN, CERTIFY = 0, 1
#: White space and ASCII punctuation, between the words that are compared with toxic ones.
BETWEEN = r"[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"
ADDED = ("word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_repeat_words", "n_toxic_words", "base_failed", "kept")
MAX_FALSE_REJECTION = 0.02
DELTA = 0.05
WORK = ("_w", "_h", "_k", "_s", "_t", "_lines")


def _half(which: int) -> Column:
    mixed = MIXED.replace("doc_id // 32", "shiftright(doc_id, 5)").replace("doc_id // 2048", "shiftright(doc_id, 11)").replace("doc_id // 131072", "shiftright(doc_id, 17)")
    return F.expr(f"pmod({mixed}, 2) = {which}")


def toxic_words(docs: DataFrame, labels: DataFrame) -> dict[str, list[str]]:
    """The words of each language's toxic documents (a null language is the empty one), from a sample of the learning half; their number is bounded by the sample."""
    known = labels.where(F.col("doc_id").isNotNull()).where(_half(LEARN)).select("doc_id", "toxic")
    order = F.expr("pmod(doc_id, 1009)")
    classes = [known.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(SAMPLE) for t in (1, 0)]
    held = F.broadcast(classes[0].unionByName(classes[1]))
    lang = F.coalesce("lang", F.lit("")).alias("lang")
    words = docs.select("doc_id", lang, "text").join(held, "doc_id").select("toxic", "lang", F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), BETWEEN)).alias("_w"))
    words = materialize(words, "labelled-words")
    t, c = F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)
    counts = words.select("toxic", "lang", F.explode("_w").alias("w")).where("w <> ''").groupBy("lang", "w").agg(t.alias("t"), c.alias("c"))
    counts = counts.where("t >= 10").join(words.groupBy("lang").agg(t.alias("nt"), c.alias("nc")), "lang")
    telling = counts.where("10 * t >= nt AND t * nc >= 100 * (c + 1) * nt").orderBy("lang", "w")
    found: dict[str, list[str]] = {}
    for r in telling.collect():
        found.setdefault(r.lang, []).append(r.w)
    return found


def _n_toxic(text: Column, toxic: dict[str, list[str]]) -> Column:
    """How many words of a text are among those of its language."""
    found = F.lit(0)
    for lang, words in sorted(toxic.items()):
        held = (lambda known: lambda x: x.isin(*known))(words)
        own = F.size(F.filter(F.split(F.lower(text), BETWEEN), held))
        found = F.when(F.coalesce("lang", F.lit("")) == lang, own).otherwise(found)
    return found.cast("long")


def signals(docs: DataFrame, toxic: dict[str, list[str]]) -> DataFrame:
    """``docs`` and the counts that rules use; ``toxic`` as from ``toxic_words``.

    Repeated three-word windows are found within the row: hashes are sorted, and only a text that has
    equal ones sorts hashes with their places, to find the places; n log n for any text. Put a table or a
    row number between these columns and a filter on them, as ``measure`` and ``keep_good`` do.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.withColumns(
        {
            "_w": F.array_remove(F.split(text, WHITE + "+"), ""),
            "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_toxic_words": _n_toxic(text, toxic),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
        }
    )
    base = base.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.concat_ws("", "_w")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": F.expr("CASE WHEN size(_w) < 3 THEN array() ELSE transform(sequence(0, size(_w) - 3), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))) END"),
        }
    )
    # a sorted long holds the hash's upper bits and, in the _k lower ones, the place
    base = base.withColumn("_k", F.length(F.bin(F.size("_h").cast("long"))))
    base = base.withColumn(
        "_s",
        F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> (h & shiftleft(-1L, _k)) | cast(i AS bigint))) END"),
    )
    same = "shiftright(x, _k) = shiftright(get(_s, {0}), _k) AND get(_h, cast(x & ~shiftleft(-1L, _k) AS int)) = get(_h, cast(get(_s, {0}) & ~shiftleft(-1L, _k) AS int))"
    base = base.withColumn(
        "_t",
        F.expr(
            "CASE WHEN _s IS NOT NULL THEN sort_array(filter(transform(_s, (x, j) -> CASE WHEN"
            f" coalesce({same.format('j - 1')}, false) OR coalesce({same.format('j + 1')}, false) THEN cast(x & ~shiftleft(-1L, _k) AS int) ELSE -1 END), p -> p >= 0)) END"
        ),
    )
    base = base.withColumn("n_repeat_words", F.expr("coalesce(aggregate(transform(_t, (p, j) -> least(3, coalesce(p - get(_t, j - 1), 3))), 0L, (a, x) -> a + x), 0L)"))
    return base.drop(*WORK)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def share(rule: str) -> Column:
    part, whole = RULES[rule]
    return F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole)).otherwise(F.lit(0.0))


def binomial_tail(k: str, n: str, a: float) -> str:
    """SQL of P(Bin(n, a) <= k), exact up to rounding: the term of k in logarithms, lower terms as its ratios."""
    return (
        f"CASE WHEN {k} >= {a!r} * {n} THEN 1.0D ELSE exp("
        f"aggregate(CASE WHEN {k} > 0 THEN sequence(1L, {k}) ELSE array() END, 0.0D, (s, i) -> s + ln(({n} - {k} + i) / cast(i AS double)))"
        f" + {k} * ln({a!r}D) + ({n} - {k}) * ln(1.0D - {a!r}D)"
        f" + ln(aggregate(CASE WHEN {k} > 0 THEN sequence(1L, {k}) ELSE array() END, named_struct('t', 1.0D, 's', 1.0D),"
        f" (x, i) -> named_struct('t', x.t * ({k} - i + 1) / ({n} - {k} + i) * ((1.0D - {a!r}D) / {a!r}D),"
        f" 's', x.s + x.t * ({k} - i + 1) / ({n} - {k} + i) * ((1.0D - {a!r}D) / {a!r}D)), x -> x.s))) END"
    )


def certify(
    labelled: DataFrame, stratum: str = "lang", max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA, grids: dict[str, tuple] = GRIDS
) -> DataFrame:
    """One row for each stratum: its certified cutoff of each rule, null where a rule is off.

    ``labelled`` has doc_id, the signals, the stratum, ``quality`` and ``toxic``; only its certifying half counts. The grids are counted in one aggregation, so
    what is shuffled has a row for each stratum and task.
    """
    places = [(r, j, float(c)) for r in RULES for j, c in enumerate(grids[r])]
    good = labelled.where(_half(CERTIFY)).where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1) & ~base_failed())
    counts = materialize(
        good.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(share(r) > c).alias(f"{r}_{j}") for r, j, c in places]),
        "holdout",
    )
    tests = counts.select(
        "stratum", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{j}").alias("k")) for r, j, c in places])).alias("x")
    ).select("stratum", "n", "x.*")
    level = delta / (max(counts.count(), 1) * len(places))
    chance = F.lit(1.0)
    for rule in RULES:
        chance = F.when(F.col("rule") == rule, F.expr(binomial_tail("k", "n", max_false_rejection * PARTS[rule]))).otherwise(chance)
    passed = tests.where(chance <= level)
    return passed.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES])


def cutoffs_for(measured: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Certified cutoffs from all labelled documents, as a small table that is written once; ``measured`` has doc_id and the signals."""
    held = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", "quality", "toxic")
    own = measured.select("doc_id", "lang", *sorted({c for pair in RULES.values() for c in pair}))
    return materialize(certify(own.join(held, "doc_id"), **options), "cutoffs")


def measure(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The signals of all documents without their texts, written once."""
    own = docs.select("doc_id", "lang", "text")
    return materialize(signals(own, toxic_words(own, labels)).drop("text"), "signals")


def judge(counted: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds ``base_failed`` and ``kept``. Cutoffs are a row for each stratum; Spark broadcasts them if they are small."""
    failed = F.lit(False)
    for rule in RULES:
        failed = failed | F.coalesce(share(rule) > F.col(f"max_{rule}"), F.lit(False))
    joined = counted.join(cutoffs, counted[stratum].eqNullSafe(cutoffs["stratum"]), "left")
    joined = joined.withColumn("base_failed", base_failed())
    return joined.withColumn("kept", ~F.col("base_failed") & ~failed).drop("stratum", *[f"max_{r}" for r in RULES])


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns.

    Signals are counted once, where a row lies, and written next to it; the cutoffs and the rows kept are both read from there.
    """
    columns = docs.columns
    names = {c: f"_in_{c}" for c in columns if c in ADDED}
    counted = materialize(signals(docs.withColumnsRenamed(names), toxic_words(docs, labels)), "measured")
    kept = judge(counted, cutoffs_for(counted, labels, **options)).where("kept")
    return kept.select(*[F.col(names.get(c, c)).alias(c) for c in columns])


def sql(max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA, grids: dict[str, tuple] = GRIDS) -> str:
    """DuckDB SQL of the registered query; the binomial tail is a sum of terms by their logarithms."""
    rules = list(RULES)
    part = " ".join(f"WHEN rule = '{r}' THEN {max_false_rejection * PARTS[r]!r}" for r in rules)
    shares = {r: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END" for r, (a, b) in RULES.items()}
    tests = " UNION ALL ".join(f"SELECT lang, '{r}' AS rule, {c}::DOUBLE AS cutoff, count(*) AS n, count(*) FILTER ({r} > {c}) AS k FROM good GROUP BY lang" for r in rules for c in grids[r])
    cuts = ", ".join(f"min(cutoff) FILTER (rule = '{r}') AS max_{r}" for r in rules)
    beyond = " OR ".join(f"coalesce({r} > max_{r}, false)" for r in rules)
    return rf"""
WITH words AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM words, unnest(range(1, len(w) - 1)) AS r(i)),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM windows), unnest([0, 1, 2]) AS r(k)
  WHERE c > 1 GROUP BY doc_id),
labelled AS (
  (SELECT doc_id, toxic FROM labels WHERE toxic = 1 AND {MIXED} % 2 = {LEARN} ORDER BY doc_id % 1009, doc_id LIMIT {SAMPLE}) UNION ALL
  (SELECT doc_id, toxic FROM labels WHERE toxic = 0 AND {MIXED} % 2 = {LEARN} ORDER BY doc_id % 1009, doc_id LIMIT {SAMPLE})),
loose AS (SELECT doc_id, coalesce(lang, '') AS l, regexp_split_to_array(lower(text), '{BETWEEN}') AS lw FROM words),
sampled AS (SELECT toxic, l, list_distinct(lw) AS lw FROM loose JOIN labelled USING (doc_id)),
sizes AS (SELECT l, count(*) FILTER (toxic = 1) AS nt, count(*) FILTER (toxic = 0) AS nc FROM sampled GROUP BY l),
telling AS (
  SELECT l, w FROM (SELECT l, w, count(*) FILTER (toxic = 1) AS t, count(*) FILTER (toxic = 0) AS c FROM sampled, unnest(lw) AS r(w) WHERE w <> '' GROUP BY l, w) JOIN sizes USING (l)
  WHERE t >= 10 AND 10 * t >= nt AND t * nc >= 100 * (c + 1) * nt),
toxic_list AS (SELECT l, list(w) AS tw FROM telling GROUP BY l),
counted AS (
  SELECT words.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(lw, lambda x: coalesce(list_contains(tw, x), false)))::BIGINT AS n_toxic_words
  FROM words JOIN loose USING (doc_id) LEFT JOIN repeats ON words.doc_id = repeats.doc_id LEFT JOIN toxic_list ON loose.l = toxic_list.l),
shares AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{v} AS {r}" for r, v in shares.items())} FROM counted),
good AS (SELECT shares.* FROM shares JOIN labels USING (doc_id) WHERE quality = 1 AND coalesce(toxic, 0) <> 1 AND NOT base_failed AND {MIXED} % 2 = {CERTIFY}),
tests AS (SELECT *, CASE {part} END AS a FROM ({tests})),
level AS (SELECT {delta} / (count(DISTINCT coalesce(lang, '')) * {sum(len(grids[r]) for r in rules)}) AS level FROM good),
passed AS (
  SELECT lang, rule, cutoff FROM tests, level
  WHERE k < a * n AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(a) + (n - i) * ln(1 - a)))) <= level),
cutoffs AS (SELECT lang AS stratum, {cuts} FROM passed GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_toxic_words, base_failed, NOT base_failed AND NOT ({beyond}) AS kept
FROM shares LEFT JOIN cutoffs ON lang IS NOT DISTINCT FROM stratum
"""
