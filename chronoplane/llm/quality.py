"""Quality rules: counts within a text, and lines that recur over the documents of a host."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplane.llm.common import SPACES, words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits of the rules.

    least_words, repeat_percent, window: a text fails the base rules with fewer words, or with a larger share of words in
    repeated windows. line_documents, line_percent: a line is removed if more documents of its host have it than both
    this number and this share of the host's documents. left_percent: a text is depleted if fewer than least_words or
    less than this share of its words are left without such lines.
    """

    least_words: int = 20
    repeat_percent: int = 30
    window: int = 8
    line_documents: int = 20
    line_percent: int = 10
    left_percent: int = 30


def _bind(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(found: Column, window: int) -> Column:
    """How many words of an array lie in windows of `window` words that it holds twice or more, the first included."""

    def covered(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(r: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(r, j)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(r, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

        total = F.aggregate(
            _bind(ranked, starts),
            F.struct(F.lit(0).alias("total"), F.lit(-window).alias("last")),
            lambda a, i: F.struct((a["total"] + F.least(i - a["last"], F.lit(window))).alias("total"), i.alias("last")),
        )["total"]
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(total)

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    return F.when(F.size(found) <= window, F.lit(0)).otherwise(_bind(found, lambda w: _bind(hashes(w), covered)))


def _lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.translate(x, SPACES, "") != "")


def normalised(line: Column) -> Column:
    """A line with A-Z lower-cased and its white space turned to single spaces."""
    return F.regexp_replace(F.trim(F.translate(line, UPPER + SPACES, LOWER + " " * len(SPACES))), " +", " ")


def recurring_lines(docs: DataFrame, filled: DataFrame, rules: Rules) -> DataFrame:
    """(host, line): hashes of the lines above the limits. docs: host, text_hash, line (hash), a row per line.

    filled: host, text_hash of the texts that have a line, so that a host's texts are counted without making their lines.

    Copies of a text count as one document, so that copying a document doesn't make its lines boilerplate. Distinct
    (host, line, text) first, then counts: neither a frequent line nor a large host meets in one task.
    """
    texts = docs.select("host", "line", "text_hash").distinct()
    counts = texts.groupBy("host", "line").count().where(F.col("count") > rules.line_documents)
    hosts = filled.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    joined = counts.alias("c").join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
    return joined.where(F.col("count") * 100 > F.col("texts") * rules.line_percent).select("c.host", "line")


def quality(docs: DataFrame, rules: Rules = Rules(), *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: bool = False) -> DataFrame:
    """The counts of each text, whether it fails the base rules, and whether it is kept.

    Base: n_words, word_chars (code points in words), n_symbols (of `#*$%&|<>`), n_dup_lines (lines with a word that equal
    an earlier one), n_repeat_words (words in windows that occur twice or more). Across documents: normalised lines are
    hashed, the distinct documents of a host that have one are counted, lines above the limits are removed, and a text of
    which too little is left is rejected (`kept` false), as is one that fails the base rules.

    carry: returns a column `row` with the row as given, and `clean_text` without the removed lines.

    DataFrame functions only. A null text is empty: it has no words and fails. Null hosts are one host. Null ids are kept.
    Equal rows get equal results. No rows give no rows. Column names of the input don't matter.
    """
    given = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")) if carry else docs.select(F.struct(F.col(id_col), F.col(text_col), F.col(host_col)).alias("row"))
    text = F.col("row")[text_col].cast("string")
    base = given.select("row", F.col("row")[id_col].alias("doc_id"), F.col("row")[host_col].alias("host"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    line = lambda x, i: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words"), i.alias("at"))
    lines = base.select("doc_id", "host", "text_hash", F.inline(F.transform(_lines(F.col("text")), lambda x, i: _bind(normalised(x), lambda n: line(n, i)))))
    # A text has a line with a word if it has a word.
    filled = base.where(F.translate(F.coalesce("text", F.lit("")), SPACES, "") != "")
    frequent = recurring_lines(lines, filled, rules)
    f, x = frequent.alias("f"), lines.alias("x")
    hit = x.join(f, F.col("x.host").eqNullSafe(F.col("f.host")) & (F.col("x.line") == F.col("f.line")), "left_semi")
    # A set, as equal rows share a key.
    gone = hit.groupBy("doc_id", "host", "text_hash").agg(F.collect_set(F.struct("at", "line", "words")).alias("hits"))
    split = base.withColumn("w", words(F.col("text")))
    empty = F.coalesce(F.col("text"), F.lit(""))
    own = _lines(F.col("text"))
    counted = split.select(
        "doc_id", "host", "text_hash", *(["row", "text"] * carry),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate(empty, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(empty) - F.length(F.translate(empty, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _bind(own, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w"), rules.window).cast("long").alias("n_repeat_words"),
    )
    c, g = counted.alias("c"), gone.alias("g")
    joined = c.join(g, F.col("c.doc_id").eqNullSafe(F.col("g.doc_id")) & F.col("c.host").eqNullSafe(F.col("g.host")) & (F.col("c.text_hash") == F.col("g.text_hash")), "left")
    n = F.col("n_words")
    removed = F.aggregate(F.coalesce("hits", F.array().cast("array<struct<at:int,line:bigint,words:int>>")), F.lit(0), lambda a, x: a + x["words"])
    failed = (n < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * n)
    depleted = (removed > 0) & ((n - removed < rules.least_words) | (100 * (n - removed) < rules.left_percent * n))
    out = [F.col("c.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept")]
    if carry:
        left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("hits.line"), F.xxhash64(normalised(x))))
        out += ["row", F.when(F.col("hits").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("clean_text")]
    return joined.select(*out)


#: The same rows by DuckDB, for the rules' defaults.
QUALITY_SQL = r"""
WITH base AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
  FROM (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM base WHERE len(ws) > 8))
), repeats AS (
  SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, least(8, i - lag(i, 1, -8) OVER (PARTITION BY doc_id ORDER BY i)) AS c FROM windows WHERE n > 1)
  GROUP BY 1
), lines AS (
  SELECT doc_id, source, text, l, trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents)
), filled AS (SELECT * FROM lines WHERE norm <> ''),
hosts AS (SELECT source, count(DISTINCT text) AS texts FROM filled GROUP BY 1),
frequent AS (
  SELECT f.source, f.norm FROM filled f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
  GROUP BY f.source, f.norm, h.texts HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) * 100 > h.texts * 10
), gone AS (
  SELECT f.doc_id, sum(len(string_split(f.norm, ' '))) AS gone
  FROM filled f JOIN frequent q ON f.source IS NOT DISTINCT FROM q.source AND f.norm = q.norm GROUP BY 1
), dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM filled GROUP BY 1),
counted AS (
  SELECT b.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(coalesce(b.text, ''), '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(b.text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    coalesce(g.gone, 0) AS gone
  FROM base b LEFT JOIN repeats r USING (doc_id) LEFT JOIN gone g USING (doc_id) LEFT JOIN dups d USING (doc_id)
), judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (gone > 0 AND (n_words - gone < 20 OR 100 * (n_words - gone) < 30 * n_words)) AS kept
FROM judged
"""
