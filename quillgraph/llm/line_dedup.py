"""Line deduplication by windows of three consecutive lines, with DataFrame functions.

Lines without a word are passed over; the others are compared without the white space around them. Each
window of three lines that follow one another this way is hashed to 128 bits. The first occurrence of
a window, by document id and place, stays; every later one marks its three lines, marks that overlap merge, and
marked lines go. Windows are judged on the input.

Shuffled are hashes and places, of which the first aggregation keeps a row for each window and
task; only repeated windows are joined back, a join whose large partitions Spark can split.

Defined cases: null texts have no lines and stay null; a text of fewer than three lines has no window;
null ids count as the largest id; rows of the same id and text are one occurrence and keep each other's fate. Texts of any length are
read whole; an empty table gives no rows; columns called like working ones (``_l``, ``_id`` and so on) are kept, those called like added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, put_back, set_aside

LINES = 3
BLANKS = " \t\n\x0b\x0c\r"


def _windows(docs: DataFrame) -> DataFrame:
    """(id, sha, at, h1, h2): a row for each window; ``at`` counts lines that have a word."""
    lined = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.xxhash64("text").alias("sha"),
        F.array_remove(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), "").alias("_l"),
    )
    within = ", ".join(f"get(_l, i + {k})" for k in range(LINES))
    hashed = lined.withColumn(
        "w",
        F.expr(
            f"CASE WHEN size(_l) >= {LINES} THEN transform(sequence(0, size(_l) - {LINES}), i -> named_struct("
            f"'at', i, 'h1', xxhash64({within}), 'h2', xxhash64('second', {within}))) END"
        ),
    )
    # outer: a plain generator lets the optimizer push size(w) > 0 below, with the split inside the lambda, once for each window
    return hashed.select("id", "sha", F.inline_outer("w")).where("h1 IS NOT NULL")


def marked_lines(docs: DataFrame) -> DataFrame:
    """(id, sha, starts): of each text that repeats windows, where these begin, in order."""
    windows = materialize(_windows(docs), "line-windows")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("id", "sha", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = windows.join(first, ["h1", "h2"]).where("id <> first.id OR sha <> first.sha OR at <> first.at")
    return later.groupBy("id", "sha").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the text of what stays, and n_lines and n_removed (long): lines with a word, and those that went."""
    docs, aside = set_aside(docs, {"_id", "_sha", "_starts", "_l", "_b", "_gone", "_at", "_cut", "_kept"})
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*columns).withColumns(
        {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "_sha": F.xxhash64("text")}
    )
    marks = marked_lines(docs).toDF("_id", "_sha", "_starts")
    joined = keyed.join(marks, ["_id", "_sha"], "left")
    # the lines with their rank among lines that have a word; then those whose rank no window covers
    ranked = joined.withColumn("_l", F.split("text", "\n")).withColumn("_b", F.expr(f"transform(_l, x -> btrim(x, '{BLANKS}') <> '')"))
    ranked = ranked.withColumn(
        "_gone",
        F.expr(
            "CASE WHEN _starts IS NULL THEN array() ELSE array_distinct(flatten(transform(_starts, s -> sequence(s, s + "
            f"{LINES - 1})))) END"
        ),
    ).withColumn(
        "_at", F.expr("CASE WHEN _starts IS NOT NULL THEN filter(transform(_b, (b, i) -> if(b, i, -1)), i -> i >= 0) END")
    )
    ranked = ranked.withColumn("_cut", F.expr("CASE WHEN _starts IS NOT NULL THEN transform(_gone, g -> get(_at, g)) END"))
    ranked = ranked.withColumn("_kept", F.expr("CASE WHEN _starts IS NOT NULL THEN array_except(sequence(0, size(_l) - 1), _cut) END"))
    out = ranked.withColumns(
        {
            "n_lines": F.expr("CASE WHEN text IS NULL THEN 0L ELSE cast(size(filter(_b, b -> b)) AS bigint) END"),
            "n_removed": F.size("_gone").cast("long"),
            "text": F.expr("CASE WHEN _starts IS NULL THEN text ELSE array_join(transform(_kept, i -> get(_l, i)), '\n') END"),
        }
    )
    return put_back(out.select(*columns, "n_lines", "n_removed"), aside)


#: The kept text is compared by its SHA-256.
SQL = r"""
WITH lined AS (
  SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS l,
    string_split(text, chr(10)) AS raw
  FROM documents),
windows AS (
  SELECT doc_id, i AS place, [l[i], l[i + 1], l[i + 2]] AS w
  FROM lined, unnest(range(1, len(l) - 1)) AS r(i) WHERE len(l) >= 3),
firsts AS (SELECT w, min({'doc_id': doc_id, 'place': place}) AS f FROM windows GROUP BY w HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, place + k AS line FROM windows JOIN firsts USING (w), unnest([0, 1, 2]) AS r(k)
  WHERE doc_id <> f.doc_id OR place <> f.place),
ranks AS (
  SELECT doc_id, i, raw[i] AS line, sum(CASE WHEN trim(raw[i], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> '' THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY i) AS rank,
    trim(raw[i], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> '' AS solid
  FROM lined, unnest(range(1, len(raw) + 1)) AS r(i)),
kept AS (
  SELECT ranks.doc_id, string_agg(ranks.line, chr(10) ORDER BY i) FILTER (WHERE gone.line IS NULL) AS text,
    count(*) FILTER (WHERE solid) AS n_lines, count(*) FILTER (WHERE gone.line IS NOT NULL) AS n_removed
  FROM ranks LEFT JOIN gone ON ranks.doc_id = gone.doc_id AND solid AND ranks.rank = gone.line GROUP BY ranks.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
