"""Token-id files: each document compressed on its own with a shared zstandard dictionary."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplane.llm.tokens import encoder

#: The dictionary is trained on so many documents at most, those with the least hashes of their ids, and so many bytes of each.
SAMPLE, SAMPLE_BYTES = 2_000, 8_192
DICTIONARY_BYTES = 112 << 10
#: Pieces whose ids a worker keeps while it writes files, some 80 MB; what it sends to be sorted needs memory too.
KEPT_PIECES = 400_000
#: A page is closed when it holds so many bytes or documents.
PAGE_BYTES, PAGE_DOCS = 1 << 20, 4_096
CUT_ACCURACY = 10_000
LAST_ID = (1 << 63) - 1

PAGE = "span int, page int, span_start long, dictionary string, width int, first_id long, last_id long, doc_ids array<long>, n_tokens array<int>, offsets array<long>, frames binary"


def _width(vocabulary: str, end_id: int) -> int:
    return 2 if max(encoder(vocabulary, KEPT_PIECES).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def _packed(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> bytes:
    """A zstandard dictionary for serialized ids, trained on a bounded sample.

    Where there are too few documents to train on, their ids themselves are the dictionary; without any it is empty.
    """
    end = np.array([end_id], "<u4").tobytes()

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, width = encoder(vocabulary, KEPT_PIECES), _width(vocabulary, end_id)
        for batch in batches:
            found = [_packed(enc.encode(t.as_py()) + end, width)[:SAMPLE_BYTES] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    # A byte of an id takes a character of text or less.
    text = F.substring(F.col(text_col).cast("string"), 1, 4 * SAMPLE_BYTES)
    picked = docs.orderBy(F.xxhash64(F.col(id_col)), F.xxhash64(F.col(text_col))).limit(SAMPLE).select(text.alias("text"))
    samples = [bytes(r[0]) for r in picked.mapInArrow(ids, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write_ids(docs: DataFrame, path: str, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, level: int = 3) -> None:
    """Writes the ids of whole texts in ascending order of ids under `path`.

    `path/dictionary` has the shared dictionary and its hash. `path/pages` has pages of consecutive documents: hash of the
    dictionary, offsets of the frames, one zstandard frame a document, so that any document is read by decompressing its
    own frame. Ids are serialized in two bytes where the vocabulary allows. Spans are ranges of ids cut at one aggregate;
    a page never crosses one, and `span_start` counts the ids before it in its span. `path/index` has a row per span:
    the ids before it, and its first and last document. Pages are rows of Parquet, so any store that Spark writes will
    do, and a lost task leaves nothing behind.

    Null and empty texts are the end id alone. Null ids come last. Equal rows are written each for itself.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    cuts = np.unique(np.array(base.agg(F.percentile_approx("id", shares, CUT_ACCURACY)).first()[0] or [], np.int64))
    trained = train_dictionary(docs, vocabulary, end_id, id_col, text_col)
    digest = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(digest, bytearray(trained), vocabulary.rpartition("/")[2], end_id)], "hash string, data binary, vocabulary string, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, width = encoder(vocabulary, KEPT_PIECES), _width(vocabulary, end_id)
        pack = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(trained), write_content_size=True).compress
        for batch in batches:
            ids = batch.column(0).fill_null(LAST_ID).to_numpy(zero_copy_only=False)
            counts, frames = [], []
            for t in batch.column(1):
                found = enc.encode(t.as_py()) + end
                counts.append(len(found) // 4)
                frames.append(pack(_packed(found, width)))
            spans = pa.array(np.searchsorted(cuts, ids, "right").astype(np.int32))
            yield pa.RecordBatch.from_arrays([spans, pa.array(ids), batch.column(0), pa.array(counts, pa.int32()), pa.array(frames, pa.binary())], names=["span", "rank", "id", "n", "frame"])

    def page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(vocabulary, end_id)
        span, number, before, held, size = None, 0, 0, [], 0

        def close() -> pa.RecordBatch:
            ids, counts, frames = zip(*held, strict=True)
            ends = np.cumsum([0, *map(len, frames)]).tolist()
            known = [i for i in ids if i is not None]
            row = (span, number, before, digest, width, min(known, default=None), max(known, default=None), list(ids), list(counts), ends, b"".join(frames))
            types = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in PAGE.split(", ")])

        for batch in batches:
            for s, i, n, frame in zip(*(batch.column(k) for k in range(4)), strict=True):
                if held and (s.as_py() != span or size >= PAGE_BYTES or len(held) >= PAGE_DOCS):
                    yield close()
                    number, before = (number + 1, before + sum(h[1] for h in held)) if s.as_py() == span else (0, 0)
                    held, size = [], 0
                span = s.as_py()
                held.append((i.as_py(), n.as_py(), frame.as_py()))
                size += len(held[-1][2])
        if held:
            yield close()

    encoded = base.mapInArrow(encode, "span int, rank long, id long, n int, frame binary")
    ordered = encoded.repartition(parts, "span").sortWithinPartitions("span", "rank", "n", F.xxhash64("frame")).select("span", "id", "n", "frame")
    ordered.mapInArrow(page, PAGE).write.parquet(f"{path}/pages")
    pages = spark.read.schema(PAGE).parquet(f"{path}/pages")
    tokens = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)
    spans = sorted(map(tuple, pages.groupBy("span").agg(F.max(F.col("span_start") + tokens), F.min("first_id"), F.max("last_id")).collect()))
    rows, start = [], 0
    for span, n, first, last in spans:
        rows.append((span, start, n, first, last))
        start += n
    spark.createDataFrame(rows, "span int, start long, tokens long, first_id long, last_id long").coalesce(1).write.parquet(f"{path}/index")


def _open(spark: SparkSession, path: str) -> tuple[bytes, str, dict[int, int]]:
    """The dictionary, its hash and where spans start; there are as many spans as shuffle partitions at most."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["data"])
    if hashlib.sha256(data).hexdigest() != row["hash"]:
        raise ValueError("the dictionary doesn't match its hash")
    return data, row["hash"], {r["span"]: r["start"] for r in spark.read.parquet(f"{path}/index").collect()}


def read_ids(spark: SparkSession, path: str, *, doc_id: int | None = None, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents, or of one: then only its page is read and only its frame decompressed."""
    trained, digest, starts = _open(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(trained)).decompress
        for batch in batches:
            for page in batch.to_pylist():
                if page["dictionary"] != digest:
                    raise ValueError("a page was written with another dictionary")
                at, out, frames, ends = starts[page["span"]] + page["span_start"], [], page["frames"], page["offsets"]
                for k, (i, n) in enumerate(zip(page["doc_ids"], page["n_tokens"], strict=True)):
                    if doc_id is None or i == doc_id:
                        ids = np.frombuffer(unpack(frames[ends[k] : ends[k + 1]]), f"<u{page['width']}").astype("<u4")
                        out.append((i, at, len(ids), zlib.crc32(ids.tobytes()), ids))
                    at += n
                if out:
                    cols = list(zip(*out, strict=True))
                    arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(list(cols[4]), pa.list_(pa.uint32())).cast(pa.list_(pa.int64()))] * keep_ids
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)

    pages = spark.read.schema(PAGE).parquet(f"{path}/pages")
    if doc_id is not None:
        pages = pages.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    return pages.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else ""))
