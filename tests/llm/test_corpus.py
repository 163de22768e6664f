"""The registered queries and the pipeline on the smallest tables."""

import random

import brute
import corpus_pipeline
import duckdb
import numpy as np
import pytest
from corpus_fixtures import small  # noqa: F401
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import TABLES, compare
from chronoplane.llm import packing, queries
from chronoplane.llm.common import table, words


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert compare(queries.QUERIES[name](spark, small), con, queries.SQL[name])[2] == "ok"


def test_all_are_registered():
    found = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in found if n.startswith("op") and n[2].isdigit()} == set(range(1, 14)) and "pipeline" in found


COLUMNS = {
    "op1_mix": "doc_id size source_size target taken",
    "op3_id_files": "doc_id start n_tokens ids_crc32",
    "op9_pack": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op5_substrings": "doc_id n_words n_removed kept_sha256",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, small, name):
    assert set(COLUMNS[name].split()) <= set(queries.QUERIES[name](spark, small).columns)


def test_simhash_query(spark, small):
    marks = [(r["doc_id"], brute.simhash(r["text"])) for r in table(spark, small, "documents").collect()]
    groups = brute.groups(marks)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op7_simhash"](spark, small).collect()}
    assert got == {d: (f"{f:016x}", groups[d]) for d, f in marks}


# -- pipeline --------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    """Three hosts: clean documents, copies, near copies, a line on most pages of a host, junk and a secret."""
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3_000)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    rows, i = [], 0

    def add(t, source):
        nonlocal i
        rows.append((i, t, "en", source, None if t is None else len(t)))
        i += 1
        return i - 1

    clean = [add(text(rng.randint(60, 200)), f"s{k % 3}") for k in range(90)]
    original = text(400)
    copies = [add(original, f"s{k % 3}") for k in range(5)]
    near = [add(original[:-12] + text(1), "s0") for _ in range(3)]
    banner = "This very line stands on most pages of the host\n"
    lined = [add(banner + text(80), "s1") for _ in range(40)]
    depleted = [add(banner * 8 + "few words left", "s1"), add(banner, "s1")]
    junk = [add("short text", "s2"), add("again and again " * 40, "s2"), add(None, "s2"), add("", None)]
    secret = add(text(60) + " password=0c6e1be69b81aa6f93 " + text(20), "s2")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, {"clean": clean, "copies": copies, "near": near, "banner": banner, "lined": lined, "depleted": depleted, "junk": junk, "secret": secret}


def test_pipeline_stage_by_stage(spark, corpus):
    docs, made = corpus
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality rules", "near-duplicates", "secret scans", "source mix", "packing"]
    given = {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = stage["quality rules"](spark, docs, "").cache()
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.columns == docs.columns
    assert set(given) - set(texts) == {*made["depleted"], *made["junk"]}
    assert all(texts[d] == (given[d].replace(made["banner"], "") if d in made["lined"] else given[d]) for d in texts)
    assert kept.where(F.length("text") != F.col("n_chars")).count() == 0

    alone = stage["near-duplicates"](spark, kept.union(kept.where("doc_id < 3")), "").cache()
    assert sorted(r["doc_id"] for r in alone.collect()) == sorted(set(brute.similar(texts).values()))
    assert {*made["clean"], made["copies"][0]} <= {r["doc_id"] for r in alone.collect()}

    safe = stage["secret scans"](spark, alone, "").cache()
    after = {r["doc_id"]: r["text"] for r in safe.collect()}
    before = {r["doc_id"]: r["text"] for r in alone.collect()}
    assert {d for d in after if after[d] != before[d]} == {made["secret"]} and "password=[SECRET]" in after[made["secret"]]
    assert set(after) == set(before)

    mixed = stage["source mix"](spark, safe, "").cache()
    sizes = {r[0]: r[1] for r in safe.groupBy("source").agg(F.sum(F.size(words(F.col("text"))))).collect()}
    got = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(F.size(words(F.col("text"))))).collect()}
    want = brute.targets(sizes)
    assert mixed.columns == docs.columns and all(abs(got.get(s, 0) - want[s]) <= 3 for s in sizes)
    assert all(" ".join(r["text"].split()) in " ".join(after[r["doc_id"]].split()) for r in mixed.collect())

    packed = stage["packing"](spark, mixed, "").collect()
    assert sum(r["length"] for r in packed) == packing.pack(mixed, queries.vocabulary()).agg(F.sum("length")).first()[0]
    lengths = {}
    for r in packed:
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
        assert len(r["ids"]) == r["length"]
    assert max(lengths.values()) <= 2048


def test_near_duplicates_without_ids(spark, corpus):
    docs, made = corpus
    stage = dict(corpus_pipeline.STAGES)["near-duplicates"]
    unnamed = docs.where("text IS NOT NULL AND text <> ''").limit(20).withColumn("doc_id", F.lit(None).cast("long"))
    got = stage(spark, unnamed.union(unnamed), "")
    assert got.count() == 20 and got.where("doc_id IS NULL").count() == 20


def test_near_duplicates_with_odd_columns(spark, corpus):
    docs, made = corpus
    stage = dict(corpus_pipeline.STAGES)["near-duplicates"]
    clash = docs.where(F.col("text").isNotNull()).withColumn("row", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("key", F.lit("x")).withColumn("node", F.lit(1))
    got = stage(spark, clash.union(clash.withColumn("row", F.create_map(F.lit("b"), F.col("doc_id")))), "")
    assert got.columns == clash.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in stage(spark, docs.where(F.col("text").isNotNull()), "").collect())


def test_pipeline_on_empty_and_whole_tables(spark, small):
    empty = table(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, small)
    assert empty.count() == 0
    rows = corpus_pipeline.run(spark, small).collect()
    lengths = {}
    for r in rows:
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
    assert rows and max(lengths.values()) <= 2048 and np.array(rows[0]["ids"]).dtype.kind == "i"
