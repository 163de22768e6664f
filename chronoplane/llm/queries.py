"""The operators of this package with production parameters over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplane.llm.common import table, vocabulary
from chronoplane.llm.crf import extract, labelled_pages, train_on
from chronoplane.llm.id_files import read_ids, write_ids
from chronoplane.llm.langid import language_id
from chronoplane.llm.mixing import Mix, mix_sources
from chronoplane.llm.packing import Limits, pack
from chronoplane.llm.phrases import PHRASES_SQL, collocations
from chronoplane.llm.prefix_hash import fingerprints as prefix_fingerprints
from chronoplane.llm.quality import QUALITY_SQL, Rules, quality
from chronoplane.llm.quotes import QUOTES_SQL, as_mail, conversations
from chronoplane.llm.secrets import labelled_findings, scan_secrets, train
from chronoplane.llm.simhash import near_duplicates
from chronoplane.llm.spelling import spelling_variants
from chronoplane.llm.substrings import remove_repeats
from chronoplane.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("op9_pack")
def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 tokens; a row per piece."""
    return pack(table(spark, sf_dir, "documents"), vocabulary(), Limits(tokens=2048, segments=512, loss=2048))


@query("op5_substrings")
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes words that an earlier window of 20 words repeats; a row per document."""
    return remove_repeats(table(spark, sf_dir, "documents"), window=20)


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the groups that 4 differing bits or fewer link."""
    found = near_duplicates(table(spark, sf_dir, "documents"), size=4, seed=42, distance=4)
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query("op8_quality", QUALITY_SQL)
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules for all documents."""
    return quality(table(spark, sf_dir, "documents"), Rules())


@query("op6_secrets")
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates for secrets in all documents, with the forest's verdict."""
    return scan_secrets(table(spark, sf_dir, "documents"), train(labelled_findings(spark)))


@query("op1_mix")
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words takes of each document, sources weighing 5, 2, 1 in turn."""
    found = mix_sources(table(spark, sf_dir, "documents"), Mix(weights=(5, 2, 1), share=1.5, most=2))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "pieces")


@query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-hash fingerprints of all documents and of their edited texts."""
    return prefix_fingerprints(table(spark, sf_dir, "documents"))


@query("op3_id_files")
def op3_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token ids of all documents, each text ended by id 0, and reads the files back."""
    path = work_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path, vocabulary(), end_id=0)
    return read_ids(spark, path, keep_ids=False)


@query("op10_main_text")
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages, by a field trained on labelled pages."""
    return extract(table(spark, sf_dir, "pages"), train_on(labelled_pages()))


@query("op2_quotes", QUOTES_SQL)
def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of the conversations, turned to mail that quotes, back in reply order and without quotes."""
    return conversations(as_mail(table(spark, sf_dir, "conversations")))


@query("op12_spelling")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of all documents; a row per word."""
    return spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_phrases", PHRASES_SQL)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


@query("op11_langid")
def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, by a model learned from those that are not held out."""
    return language_id(table(spark, sf_dir, "documents"))
