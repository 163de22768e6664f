"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplane.llm.common import WORD_PATTERN, store, words

#: Sources whose quotas one task holds; more are split into groups.
GROUP_SOURCES = 50_000
#: Blocks that one draw can tell apart (a limit of numpy's).
DRAWN = 999_999_999


@dataclass(frozen=True)
class Mix:
    """How much of which source.

    weights: of the sources in the order of their names by code point, null last, repeating. share: size of the mix over
    the size of all sources. most: a source gives at most so many times its size, in whole passes. shards: output shards.
    blocks: blocks a small source is cut into; block_words: size of a block of a large one; most_blocks: of all sources.
    """

    weights: Sequence[float] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    shards: int = 64
    blocks: int = 4096
    block_words: int = 1024
    most_blocks: int = 1 << 27
    seed: int = 20


def _sliced(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """The rows stored with a column `slice`: ranges of the order, as many as shuffle partitions at most."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return store(rows.repartitionByRange(parts, *order).withColumn("slice", F.spark_partition_id()), name)[0]


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """Adds `rank` and `target` to a table with source and source_size: shares by weight, cut at `most` times the size, the excess reshared.

    Sources that are cut are those with the least size per weight, so one pass in that order finds the level at which the
    others share what is left. Ranks and running sums go in two levels, over ranges of the order and inside a range; only
    the windows over the ranges have one partition.
    """
    by_name = [F.col("source").cast("binary").asc_nulls_last()]
    named = _sliced(sources, by_name, "sources-by-name")
    slices = Window.orderBy("slice")
    earlier, later = slices.rowsBetween(Window.unboundedPreceding, -1), slices.rowsBetween(1, Window.unboundedFollowing)
    none = F.lit(0.0)
    starts = named.groupBy("slice").agg(F.count("*").alias("rows")).select("slice", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    rank = (F.col("start") + F.row_number().over(Window.partitionBy("slice").orderBy(*by_name))).cast("long")
    ranked = named.join(F.broadcast(starts), "slice").withColumn("rank", rank).drop("slice", "start")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), ((F.col("rank") - 1) % len(mix.weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(mix.most))
    by_ratio = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    rated = _sliced(ranked, by_ratio, "sources-by-ratio")
    sums = rated.groupBy("slice").agg(F.sum("cap").alias("caps"), F.sum("weight").alias("weights"))
    sums = sums.select("slice", F.coalesce(F.sum("caps").over(earlier), none).alias("caps"), F.coalesce(F.sum("weights").over(later), none).alias("weights"))
    inside = Window.partitionBy("slice").orderBy(*by_ratio)
    before, rest = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(0, Window.unboundedFollowing)
    total = rated.agg(F.sum("source_size").alias("total"))
    level = (F.col("total") * mix.share - F.col("caps") - F.coalesce(F.sum("cap").over(before), none)) / (F.col("weights") + F.sum("weight").over(rest))
    # Levels before the first that doesn't cut its own source lie above the caps, those after it are lower.
    levels = rated.join(F.broadcast(sums), "slice").crossJoin(F.broadcast(total)).withColumn("level", level)
    fits = levels.agg(F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).alias("fits"))
    found = rated.crossJoin(F.broadcast(fits)).withColumn("target", F.least("cap", F.coalesce(F.col("fits") * F.col("weight"), F.col("cap"))))
    return found.drop("weight", "cap", "fits", "slice")


def _draw(own: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `take` blocks, drawn without replacement, are each source's. Of more than DRAWN blocks, units of several are drawn and what a unit leaves over is filled up evenly."""
    unit = -(-int(own.sum()) // DRAWN) or 1
    units = own // unit
    drawn = rng.multivariate_hypergeometric(units, min(take // unit, int(units.sum())), method="marginals") * unit
    short = take - int(drawn.sum())
    if not short:
        return drawn
    room = np.cumsum((own - drawn).astype(object))
    return drawn + np.diff(room * short // room[-1], prepend=0).astype(np.int64)


def split_quotas(quotas: np.ndarray, shards: int, seed: int, group: int = 0, sizes: Sequence[int] | None = None) -> np.ndarray:
    """Block quotas of each source (rows) in each shard (columns), by a tree of multivariate hypergeometric draws.

    A node holds the quotas of its shards together; its left half gets as many blocks as its shards' share, drawn without
    replacement from the node's. Each source's quotas add up exactly, and the shards are equal in size within a block.
    """
    out = np.zeros((len(quotas), shards), np.int64)
    work = [(0, shards, quotas.astype(np.int64))]
    while work:
        lo, hi, own = work.pop()
        if hi - lo == 1:
            out[:, lo] = own
            continue
        mid = (lo + hi) // 2
        total = int(own.sum())
        take = total * (mid - lo) // (hi - lo) if sizes is None else int(sum(sizes[lo:mid]))
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi, *[group] * (group > 0)]))
        left = _draw(own, take, rng)
        work += [(lo, mid, left), (mid, hi, own - left)]
    return out


def plan(sources: DataFrame, mix: Mix) -> DataFrame:
    """(stream, source_size, target, taken_words, ends): what a source gives, and where each shard's part of it ends.

    A source is a stream of words cut into equal blocks; block b of n ends at word size * b div n. Its quota, in blocks,
    is the one nearest to its target. `ends` are word positions in the stream, which starts anew after each pass.

    Sources are grouped by rank. The quotas of whole groups are split among the shards first, a number per group; then
    each group is a task, which splits what its group received.
    """
    ranked = targets(sources, mix).withColumn("group", F.floor((F.col("rank") - 1) / GROUP_SOURCES).cast("int"))
    block = F.greatest(F.lit(mix.block_words), F.ceil(F.sum("source_size") / mix.most_blocks)).cast("long")
    size = F.col("source_size")
    blocks = F.greatest(F.lit(1), F.least(size, F.greatest(F.ceil(size / F.col("block")), F.lit(mix.blocks)))).cast("long")
    quota = F.when(size > 0, F.least(F.rint(F.col("target") * F.col("n") / size), F.col("n") * float(mix.most))).otherwise(0).cast("long")
    cut = ranked.crossJoin(F.broadcast(ranked.agg(block.alias("block")))).withColumn("n", blocks).withColumn("quota", quota)
    cut = cut.select("group", "rank", "stream", "source_size", "target", "n", "quota")
    totals = sorted(map(tuple, cut.groupBy("group").agg(F.sum("quota")).collect()))
    received = split_quotas(np.array([q for _, q in totals], np.int64), mix.shards, mix.seed)
    received = {g: row.tolist() for (g, _), row in zip(totals, received, strict=True)}

    def split(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        number, size, n = int(group["group"].iloc[0]), group["source_size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        last = np.cumsum(split_quotas(group["quota"].to_numpy(np.int64), mix.shards, mix.seed, number, received[number]), axis=1)
        whole, part = last // n[:, None], last % n[:, None]
        ends = whole * size[:, None] + np.array([[int(p) * int(s) // int(m) for p in row] for row, s, m in zip(part, size, n, strict=True)], np.int64).reshape(last.shape)
        return group[["stream", "source_size", "target"]].assign(taken_words=ends[:, -1], ends=list(ends))

    schema = f"stream {sources.schema['stream'].dataType.simpleString()}, source_size long, target double, taken_words long, ends array<long>"
    return cut.groupBy("group").applyInPandas(split, schema)


def mix_sources(docs: DataFrame, mix: Mix = Mix(), *, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, carry: bool = False) -> DataFrame:
    """Which words of which document the mix takes, and into which shard: doc_id, source, size, source_size, target, taken, pieces.

    A source's documents are put in a seeded random order, one stream of words; the stream is cut into blocks, block
    quotas are split exactly among the shards, and each shard draws the next blocks of the permuted stream: shards are
    disjoint within a pass, and a document is whole but where a shard or the quota ends in it. `pieces` holds (shard,
    pass, start, words); `shuffle_key` orders a shard's pieces at random (`shuffled` writes them out so).

    size: words of a row, by default counted in its column `text`. Positions in the stream are sums in two levels: of
    buckets of the random order, then inside a bucket; a source with a third of all rows spreads over all buckets.

    Null and wordless texts have size 0 and give nothing. Null sources are one source, last in the order. Null ids take
    part. Equal rows are taken each for itself; which of them comes first makes no difference. No rows give no rows.
    Other columns aren't read, or carried in a column `row` if carry is set.
    """
    spark = docs.sparkSession
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    if size is None:
        size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD_PATTERN))
    own = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] * carry
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.cast("long").alias("size"), *own)
    place = F.xxhash64(F.lit(mix.seed), "doc_id", "source", "size")
    stream = F.struct(F.col("source").isNull().alias("unnamed"), F.coalesce("source", F.lit("")).alias("name"))
    rows = rows.withColumns({"place": place, "stream": stream}).withColumn("bucket", F.pmod(F.shiftrightunsigned("place", 16), F.lit(buckets)))
    sums, _ = store(rows.groupBy("stream", "bucket").agg(F.sum("size").alias("words")), "stream-sums")
    source = F.when(~F.col("stream.unnamed"), F.col("stream.name"))
    planned = plan(sums.groupBy("stream").agg(F.sum("words").alias("source_size")).withColumn("source", source), mix)
    order = Window.partitionBy("stream").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("bucket_start", F.coalesce(F.sum("words").over(order), F.lit(0)))
    starts = starts.join(planned, "stream").select("stream", "bucket", "bucket_start", "source_size", "target", "ends")
    inside = Window.partitionBy("stream", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["stream", "bucket"])
    at = F.col("bucket_start") + F.col("before")

    def piece(i: Column, j: Column) -> Column:
        """The words that shard i takes in pass j."""
        low = F.when(i > 0, F.get("ends", i - 1)).otherwise(F.lit(0))
        begin = at + j * F.col("source_size")
        start = F.greatest(low, begin)
        stop = F.least(F.get("ends", i), begin + F.col("size"))
        key = F.xxhash64(F.lit(mix.seed), F.col("doc_id"), F.col("place"), i, j)
        return F.struct(i.alias("shard"), j.alias("pass"), (start - begin).alias("start"), (stop - start).alias("words"), key.alias("shuffle_key"))

    def in_pass(j: Column) -> Column:
        shards = F.transform(F.sequence(F.lit(0), F.lit(mix.shards - 1)), lambda i: piece(i, j))
        return F.filter(shards, lambda x: x["words"] > 0)

    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(mix.most - 1)), in_pass))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    out = placed.select("doc_id", "source", "size", "source_size", "target", pieces.alias("pieces"), *(["row"] * carry))
    return out.withColumn("taken", taken)


def mixed_texts(docs: DataFrame, mix: Mix = Mix(), *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = None) -> DataFrame:
    """The mix itself: the columns of docs, a row per document and pass; then _shard and _shuffle_key.

    A document whose words fall to two shards goes whole to the first, so a shard differs from its quota by less than a
    document of each source. Only where a source's quota ends is one cut; its words are then joined by single spaces.
    chars_col: a column that holds the text's code points and follows the cut.
    """
    size = F.size(words(F.col(text_col).cast("string")))
    found = mix_sources(docs, mix, id_col=id_col, source_col=source_col, size=size, carry=True)

    def whole(j: Column) -> Column:
        mine = F.filter("pieces", lambda x: x["pass"] == j)
        total = F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a + x["words"])
        return F.struct(F.get(mine, 0)["shard"].alias("shard"), F.get(mine, 0)["start"].alias("start"), total.alias("words"), F.get(mine, 0)["shuffle_key"].alias("shuffle_key"))

    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(mix.most - 1)), whole), lambda x: x["words"] > 0)
    rows = found.select("row", "size", F.inline(passes))
    text = F.col("row")[text_col].cast("string")
    cut = F.when(F.col("words") == F.col("size"), text).otherwise(F.array_join(F.slice(words(text), (F.col("start") + 1).cast("int"), F.col("words").cast("int")), " "))
    rows = rows.withColumn("_cut", cut)
    own = {text_col: F.col("_cut").cast(docs.schema[text_col].dataType)}
    if chars_col:
        own[chars_col] = F.length("_cut").cast(docs.schema[chars_col].dataType)
    return rows.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns], F.col("shard").alias("_shard"), F.col("shuffle_key").alias("_shuffle_key"))


def shuffled(mixed: DataFrame, shards: int) -> DataFrame:
    """The pieces dealt out by shard, each shard in its own random order, to be written with partitionBy("_shard")."""
    return mixed.repartition(shards, "_shard").sortWithinPartitions("_shard", "_shuffle_key")
