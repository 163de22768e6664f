"""Conversations from messages that quote each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplane.llm.common import SPACES, drop_stored, store
from chronoplane.llm.quality import LOWER, UPPER

MARKS = r"^(?:[ \t]*>)+"
HEADER = r"(?i)^on\b.{0,300}\bwrote:$"


def _bind(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def parsed(text: Column) -> Column:
    """Lines of a message: level (of nested `>` marks), body without them, and whether the line introduces a quote."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 0)
        level = F.length(marks) - F.length(F.translate(marks, ">", ""))
        return F.struct(level.alias("level"), F.regexp_replace(x, MARKS + r"[ \t]?", "").alias("body"))

    lines = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"), line)

    def header(p: Column) -> Column:
        deeper = lambda i, x: F.coalesce(F.get(p, i + 1)["level"] > x["level"], F.lit(False))
        return F.transform(p, lambda x, i: F.struct(x["level"].alias("level"), x["body"].alias("body"), (deeper(i, x) & F.trim(x["body"]).rlike(HEADER)).alias("header")))

    return _bind(lines, header)


def passages(lines: Column) -> Column:
    """Runs of lines of one level, between empty lines, headers and changes of level: (level, hash of the normalised text)."""

    def runs(p: Column) -> Column:
        full = lambda x: (F.translate(x["body"], SPACES, "") != "") & ~x["header"]
        joined = lambda a, b: F.coalesce(full(a) & full(b) & (a["level"] == b["level"]), F.lit(False))
        index = F.sequence(F.lit(0), F.size(p) - 1)
        first = F.filter(index, lambda i: full(F.get(p, i)) & ~joined(F.get(p, i - 1), F.get(p, i)))
        last = F.filter(index, lambda i: full(F.get(p, i)) & ~joined(F.get(p, i), F.get(p, i + 1)))

        def passage(a: Column, b: Column) -> Column:
            words = F.array_join(F.transform(F.slice(p, a + 1, b - a + 1), lambda x: x["body"]), " ")
            norm = F.regexp_replace(F.trim(F.translate(words, UPPER + SPACES, LOWER + " " * len(SPACES))), " +", " ")
            return F.struct(F.get(p, a)["level"].alias("level"), F.xxhash64(norm).alias("passage"))

        return F.zip_with(first, last, passage)

    return _bind(lines, runs)


def own_text(lines: Column) -> Column:
    """What a message says itself: its lines without quotes and their headers, trimmed."""
    own = F.filter(lines, lambda x: (x["level"] == 0) & ~x["header"])
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def linked(messages: DataFrame, *, scope_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(scope, at, parent, root, depth) of each message that has a place in the order.

    A quoted passage is joined, on the hash of its normalised text, to the message of the scope that first said it in its
    own words; only earlier messages count. The parent is the latest of those that quotes of level 1 lead to. Originals
    are aggregated to one row a passage before the join, so a phrase that many say and quote gives no pairs. Roots follow
    by pointer doubling, in as many rounds as the logarithm of the longest chain of replies.
    """
    spark = messages.sparkSession
    lines = messages.select(F.struct(F.col(scope_col).alias("key")).alias("scope"), F.col(order_col).alias("at"), parsed(F.col(text_col).cast("string")).alias("lines")).where("at IS NOT NULL")
    said = lines.select("scope", "at", F.inline(passages(F.col("lines"))))
    first = said.where("level = 0").groupBy("scope", "passage").agg(F.min("at").alias("original"))
    quotes = said.where("level = 1").join(first, ["scope", "passage"]).where("original < at")
    parents = quotes.groupBy("scope", "at").agg(F.max("original").alias("parent"))
    nodes = lines.select("scope", "at").distinct().join(parents, ["scope", "at"], "left")
    # `up` is an ancestor `steps` above; a row is done when that is the root. Only the others are joined again.
    first_up = nodes.select("scope", "at", "parent", F.coalesce("parent", "at").alias("up"), F.col("parent").isNotNull().cast("long").alias("steps"), F.col("parent").isNull().alias("done"))
    now, path = store(first_up, "replies")
    while now.where("NOT done").limit(1).count():
        above = now.select("scope", F.col("at").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("done").alias("found"))
        moved = now.where("NOT done").join(above, ["scope", "up"]).select("scope", "at", "parent", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("found").alias("done"))
        after, path_after = store(moved.union(now.where("done")), "replies")
        drop_stored(spark, path)
        now, path = after, path_after
    return now.select("scope", "at", "parent", F.col("up").alias("root"), F.col("steps").alias("depth"))


def conversations(messages: DataFrame, *, scope_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each message without its quotes, and its place among the replies: conv_id, turn, role, parent, root, depth, quote_levels, text.

    Sorted by conv_id, root, depth and turn, a conversation runs in the order of replies: each thread from its first
    message on, parents before answers.

    DataFrame functions only. Null texts are empty. Null scopes are one scope. A message without a place in the order
    keeps its row and has no parent, root or depth; nor can others find it. Messages that share a place are one node, and
    each gets its links. No rows give no rows. Other columns aren't read.
    """
    lines = parsed(F.col("text"))
    rows = messages.select(F.struct(F.col(scope_col).alias("key")).alias("scope"), F.col(order_col).alias("at"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("lines", lines)
    found = linked(messages, scope_col=scope_col, order_col=order_col, text_col=text_col)
    levels = F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).cast("long")
    out = rows.select("scope", "at", "role", levels.alias("quote_levels"), own_text(F.col("lines")).alias("text"))
    joined = out.join(found, ["scope", "at"], "left")
    return joined.select(F.col("scope.key").alias("conv_id"), F.col("at").alias("turn"), "role", "parent", "root", "depth", "quote_levels", "text")


def as_mail(messages: DataFrame) -> DataFrame:
    """The messages of a conversation as mail: every third answers the one before the last, the others the last; each quotes
    what it answers, and what that one answered one level deeper.

    The test tables hold conversations without quotes; this derives messages from them that have some.
    """
    at = F.col("turn")
    answered = F.when(at % 3 == 2, at - 2).when(at >= 1, at - 1)
    quoted = lambda text, marks: F.regexp_replace(text, r"(?m)^", marks)
    rows = messages.withColumn("up", answered)
    node = rows.select("conv_id", F.col("turn").alias("up"), F.col("role").alias("up_role"), F.col("text").alias("up_text"), F.col("up").alias("far"))
    far = rows.select("conv_id", F.col("turn").alias("far"), F.col("role").alias("far_role"), F.col("text").alias("far_text"))
    joined = rows.join(node, ["conv_id", "up"], "left").join(far, ["conv_id", "far"], "left")
    below = lambda role, text, marks, at: F.concat(F.lit("\n\n" if len(marks) == 2 else f"\n{marks[:-2]}\n{marks[:-2]}"), F.lit("On turn "), at.cast("string"), F.lit(" "), role, F.lit(" wrote:\n"), quoted(text, marks))
    text = F.concat("text", F.coalesce(below(F.col("up_role"), F.col("up_text"), "> ", F.col("up")), F.lit("")), F.coalesce(below(F.col("far_role"), F.col("far_text"), "> > ", F.col("far")), F.lit("")))
    return joined.select("conv_id", "turn", "role", text.alias("text"))


#: The same rows by DuckDB, from the conversations before they were turned to mail; their texts have no empty lines.
QUOTES_SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text, CASE WHEN turn % 3 = 2 THEN turn - 2 WHEN turn >= 1 THEN turn - 1 END AS up,
    trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM conversations
), firsts AS (SELECT conv_id, norm, min(turn) AS original FROM m WHERE norm <> '' GROUP BY 1, 2),
parents AS (
  SELECT m.conv_id, m.turn, m.role, m.text, m.up, CASE WHEN f.original < m.turn THEN f.original END AS parent
  FROM m LEFT JOIN m u ON u.conv_id = m.conv_id AND u.turn = m.up LEFT JOIN firsts f ON f.conv_id = u.conv_id AND f.norm = u.norm
), chains AS (
  SELECT conv_id, turn, turn AS root, CAST(0 AS BIGINT) AS depth FROM parents WHERE parent IS NULL
  UNION ALL
  SELECT p.conv_id, p.turn, c.root, c.depth + 1 FROM parents p JOIN chains c ON c.conv_id = p.conv_id AND c.turn = p.parent
)
SELECT p.conv_id, p.turn, p.role, p.parent, c.root, c.depth,
  CAST(CASE WHEN u.turn IS NULL THEN 0 WHEN g.turn IS NULL THEN 1 ELSE 2 END AS BIGINT) AS quote_levels, p.text
FROM parents p JOIN chains c USING (conv_id, turn)
LEFT JOIN m u ON u.conv_id = p.conv_id AND u.turn = p.up
LEFT JOIN m g ON g.conv_id = u.conv_id AND g.turn = u.up
"""
