"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of
`documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplane.llm.common import store, vocabulary
from chronoplane.llm.mixing import Mix, mixed_texts, shuffled
from chronoplane.llm.packing import Limits, pack
from chronoplane.llm.quality import Rules, quality
from chronoplane.llm.secrets import labelled_findings, redact, train
from chronoplane.llm.similar import Similar, firsts

#: Ids of rows that have none start here.
UNNAMED = 1 << 62


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur over a host go, and documents that fail the rules; the others' texts stay as they are."""
    judged = quality(docs, Rules(), carry=True).where("kept")
    changed = ~F.col("clean_text").eqNullSafe(F.col("row.text"))
    chars = F.when(changed, F.length("clean_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    own = {"text": F.col("clean_text"), "n_chars": chars}
    return judged.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id, and of equal rows one.

    Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked. Rows without an id come
    after all others in their group; different texts under one id count as different documents. Null and empty texts are
    copies of each other. Rows with one id and text, which may differ in other columns, are one document: the row with the
    smallest hash stays.
    """
    number = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(UNNAMED)))
    keyed = docs.select(F.struct(number.alias("number"), F.xxhash64("text").alias("text_hash")).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    kept = firsts(keyed.select("key", F.col("row.text").alias("text")), Similar(size=5, percent=80))
    # Maps can't be hashed or ordered, their text can.
    parts = [F.to_json(F.struct(F.col("row")[f.name])) if "map<" in f.dataType.simpleString() else F.col("row")[f.name] for f in docs.schema]
    rows = keyed.join(kept, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64(*parts)).alias("row"))
    return rows.select("row.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays."""
    cleaned = redact(docs, train(labelled_findings(spark)), text_col="text", path_col="source")
    return cleaned.withColumn("n_chars", F.when(F.col("text").contains("[SECRET]"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, shard by shard in random order."""
    mix = Mix(weights=(5, 2, 1), share=1.5, most=2)
    return shuffled(mixed_texts(docs, mix, chars_col="n_chars"), mix.shards).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences; a row per piece, with its token ids."""
    return pack(docs, vocabulary(), Limits(tokens=2048, segments=512, loss=2048), keep_ids=True, kept_pieces=400_000)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicate_groups),
    ("secret scans", secret_scans),
    ("source mix", source_mix),
    ("packing", packing),
]

#: No SQL: hashes, the forest, the mix and tokens can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is stored, and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
