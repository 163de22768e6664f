"""Removal of long repeated word spans by a compacted De Bruijn graph of word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a window's hash that a packed row writes out; the bits above are its bucket and a histogram.
LOW_BITS = 48
#: Cuts of the id range in one aggregate; the number of ranges is bounded by the number of shuffle partitions.
CUT_ACCURACY = 10_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The 64-bit hash of each run of k words, from the words' hashes: sums of doubled runs, modulo 2^64."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    runs, size = {1: words}, 1
    power = {1: 0x9E3779B97F4A7C15}
    while size * 2 <= k:
        h = runs[size]
        runs[2 * size] = h[:-size] + np.uint64(power[size]) * h[size:]
        power[2 * size] = power[size] ** 2 % (1 << 64)
        size *= 2
    total, at, factor, n = np.zeros(len(words) - k + 1, np.uint64), 0, 1, len(words) - k + 1
    for size in sorted(runs, reverse=True):
        if k & size:
            total += np.uint64(factor) * runs[size][at : at + n]
            factor = factor * power[size] % (1 << 64)
            at += size
    return _mix(total)


def _documents(group: pd.DataFrame) -> list[tuple]:
    """(id, text) of a range in the order of ids, then of texts; equal rows stand side by side."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = [(i, unpack(t) if t else b"") for i, t in zip(group["id"], group["text"], strict=True)]
    return sorted(rows)


def _edges(docs: list[tuple], k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of all windows of a range in order, and how many each row has; a row that equals the one before has none.

    The first hash, of the words' low halves and cut to `bits`, leads edges to each other; the second, of the high
    halves, tells them apart inside a range.
    """
    lead, tell, counts, last = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [], None
    for row in docs:
        parts = row[1].split() if row != last else []
        halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), ">u8").astype(np.uint64).reshape(-1, 2)
        lead.append(window_hashes(np.ascontiguousarray(halves[:, 1]), k) >> np.uint64(64 - bits) << np.uint64(64 - bits))
        tell.append(window_hashes(np.ascontiguousarray(halves[:, 0]), k))
        counts.append(len(lead[-1]))
        last = row
    return np.concatenate(lead), np.concatenate(tell), np.array(counts, np.int64)


def _firsts(lead: np.ndarray, tell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first hash of each distinct edge, in order, and where it stands first."""
    order = np.argsort(lead, kind="stable")
    for again in (False, True):
        if again:
            order = np.lexsort((tell, lead))
        x, y = lead[order], tell[order]
        same, other = x[1:] == x[:-1], y[1:] != y[:-1]
        if not (same & other).any():
            break
    first = np.ones(len(order), bool)
    first[1:] = ~same | other
    return x[first], order[first]


class _Places:
    """Edges of a range by number: which words they cover. Numbers run through the documents in order."""

    def __init__(self, docs: list[tuple], k: int) -> None:
        self.k, last = k, None
        self.words = []
        for row in docs:
            self.words.append(row[1].split() if row != last else [])
            last = row
        self.starts = np.concatenate([[0], np.cumsum([max(0, len(w) - k + 1) for w in self.words])]).astype(np.int64)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def run(self, at: int, length: int) -> list[bytes] | None:
        """The words under `length` edges from `at`; None if they aren't edges of one document."""
        d = int(self.document(np.array([at]))[0])
        if at < 0 or d >= len(self.words) or at + length > self.starts[d + 1]:
            return None
        begin = at - int(self.starts[d])
        return self.words[d][begin : begin + length + self.k - 1]


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _narrow(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widen(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, keep_text: bool = False, hash_bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of each row after repeated spans are removed.

    A window of `window` consecutive words is an edge of a De Bruijn graph, from the words but its last to the words but
    its first. An edge is repeated where it also occurs earlier: in a document of smaller id, or earlier in its own. The
    words of repeated edges are removed.

    1. Documents are dealt out by ranges of ids, at the cut points of one aggregate, and their compressed texts shuffled once.
    2. A range sorts its edges and keeps the first of each. What it drops is repeated, so a passage that a third of all
       documents share leaves a range once. The rest goes to buckets of hashes, packed to 9 bytes or so an edge.
    3. A bucket's task joins equal edges of all ranges on their hashes; ranges are in the order of ids. Each edge but the
       first gets the coordinate of the first, its source, and goes back to its range.
    4. A range, joined with what came back, compacts paths: edges that follow each other in a document and whose sources
       follow each other, so that no other edge branches off between them. A path goes to its source's range with a
       128-bit digest of its words.
    5. The source's range, joined with the paths, compares the digest with that of the words at its own coordinates. A path
       that differs holds edges whose hashes are equal by chance. All occurrences of such an edge are fetched from the
       buckets and their ranges, and joined on the words themselves.
    6. A range, joined with the paths that hold, removes their words and those of step 2.

    Steps 2 and 4 to 6 read the same exchange. Equality of 64 bits alone removes nothing: between ranges the words' digest
    decides, inside a range another 64 bits of other word hashes. `hash_bits` below 64 makes chance equality frequent; the
    result is the same.

    Null, empty and short texts have no window and keep all words. Null ids come after all others. Equal rows are one
    document and get equal results; different texts under one id follow each other in byte order. No rows give no rows.
    Other columns aren't read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top_bits = max(8, (2 * parts - 1).bit_length())
    hist_bits = max(0, 64 - LOW_BITS - top_bits)
    shares = [i / parts for i in range(1, parts)]
    least = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), F.array(*map(F.lit, shares)), CUT_ACCURACY) if shares else F.array()).first()[0]
    cuts = np.unique(np.array(least or [], np.int64))
    last_id = (1 << 63) - 1
    spans = max(1, (len(cuts).bit_length() + 7) // 8)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = batch.column(0).fill_null(last_id).to_numpy(zero_copy_only=False)
            texts = [pack(t.as_py()) if t.is_valid else None for t in batch.column(1)]
            span = pa.array(np.searchsorted(cuts, ids, "right").astype(np.int32))
            yield pa.RecordBatch.from_arrays([span, pa.array(ids), batch.column(0).is_null(), pa.array(texts, pa.binary())], names=["span", "id", "unnamed", "text"])

    def send(group: pd.DataFrame) -> pd.DataFrame:
        lead, tell, _ = _edges(_documents(group), window, hash_bits)
        edges, at = _firsts(lead, tell)
        width = max(1, (int(at.max(initial=0)).bit_length() + 7) // 8)
        bucket = (edges >> np.uint64(64 - top_bits)).astype(np.int64)
        keys, starts = np.unique(bucket, return_index=True)
        rows = []
        for key, a, b in zip(keys.tolist(), starts.tolist(), [*starts[1:].tolist(), len(edges)], strict=False):
            part = edges[a:b]
            above = (part >> np.uint64(LOW_BITS)) & np.uint64((1 << hist_bits) - 1)
            hist = np.bincount(above.astype(np.int64), minlength=1 << hist_bits).astype("<u4")
            rows.append((key, int(group["span"].iloc[0]), width, hist.tobytes(), _narrow(part, LOW_BITS // 8), _narrow(at[a:b], width)))
        return pd.DataFrame(rows, columns=["bucket", "span", "width", "hist", "low", "at"])

    def read_edges(hist: bytes, low: bytes) -> np.ndarray:
        """Edges of a bucket and a range, without the bucket's bits."""
        above = np.repeat(np.arange(1 << hist_bits, dtype=np.uint64), np.frombuffer(hist, "<u4"))
        return (above << np.uint64(LOW_BITS)) | _widen(low, LOW_BITS // 8)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("span")
        found = [read_edges(hist, low) for hist, low in zip(group["hist"], group["low"], strict=True)]
        counts = np.array([len(f) for f in found])
        edges, wide = np.concatenate(found), int(group["width"].max())
        at = np.concatenate([_widen(a, w) for a, w in zip(group["at"], group["width"], strict=True)])
        order = np.argsort(edges, kind="stable")
        ordered = edges[order]
        first = np.ones(len(edges), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        source = np.empty(len(edges), np.int64)
        source[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(edges)), 0))]
        owner = np.repeat(group["span"].to_numpy(), counts)
        later, rows, start = source != np.arange(len(edges)), [], 0
        for span, n in zip(group["span"], counts.tolist(), strict=True):
            mine = np.flatnonzero(later[start : start + n]) + start
            if len(mine):
                rows.append((span, wide, _narrow(at[mine], wide), _narrow(owner[source[mine]], spans), _narrow(at[source[mine]], wide)))
            start += n
        return pd.DataFrame(rows, columns=["span", "width", "at", "source", "source_at"])

    def compact(group: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        names = ["source", "span", "at", "source_at", "length", "digest"]
        if not len(back) or not len(group):
            return pd.DataFrame([], columns=names)
        at, source_at = (np.concatenate([_widen(a, w) for a, w in zip(back[c], back["width"], strict=True)]).astype(np.int64) for c in ("at", "source_at"))
        source = np.concatenate([_widen(a, spans) for a in back["source"]]).astype(np.int64)
        order = np.argsort(at)
        at, source_at, source = at[order], source_at[order], source[order]
        places = _Places(_documents(group), window)
        document = places.document(at)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(source_at) != 1) | (np.diff(source) != 0) | (np.diff(document) != 0)
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(at)))
        digest = [_digest(places.run(i, n)) for i, n in zip(at[begin].tolist(), length.tolist(), strict=True)]
        rows = []
        for s in np.unique(source[begin]).tolist():
            mine = np.flatnonzero(source[begin] == s)
            b = begin[mine]
            rows.append((s, int(group["span"].iloc[0]), at[b].tobytes(), source_at[b].tobytes(), length[mine].tobytes(), b"".join(digest[i] for i in mine.tolist())))
        return pd.DataFrame(rows, columns=names)

    def verify(group: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
        names = ["span", "at", "length", "chance"]
        if not len(paths) or not len(group):
            return pd.DataFrame([], columns=names)
        places, rows = _Places(_documents(group), window), []
        edges = None
        for span, *packed, digest in zip(*(paths[c] for c in ("span", "at", "source_at", "length", "digest")), strict=True):
            at, source_at, length = (np.frombuffer(c, np.int64) for c in packed)
            runs = [places.run(i, n) for i, n in zip(source_at.tolist(), length.tolist(), strict=True)]
            holds = np.array([r is not None and _digest(r) == digest[16 * i : 16 * i + 16] for i, r in enumerate(runs)])
            chance = b""
            if not holds.all():
                edges = _edges(_documents(group), window, hash_bits)[0] if edges is None else edges
                chance = np.unique(np.concatenate([edges[i : i + n] for i, n in zip(source_at[~holds].tolist(), length[~holds].tolist(), strict=True)])).tobytes()
            rows.append((span, at[holds].tobytes(), length[holds].tobytes(), chance))
        return pd.DataFrame(rows, columns=names)

    def doubtful(group: pd.DataFrame) -> pd.DataFrame:
        """Edges whose hash stands for different words, by bucket."""
        edges = np.unique(np.concatenate([np.frombuffer(c, np.uint64) for c in group["chance"]]))
        bucket = (edges >> np.uint64(64 - top_bits)).astype(np.int64)
        return pd.DataFrame({"bucket": bucket, "edge": (edges & np.uint64((1 << (64 - top_bits)) - 1)).astype(np.int64)})

    def fetch(group: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        """Where the doubtful edges of a bucket stand in all ranges."""
        rows, want = [], np.unique(wanted["edge"].to_numpy().astype(np.uint64))
        for span, width, hist, low, at in zip(*(group[c] for c in ("span", "width", "hist", "low", "at")), strict=True) if len(want) else ():
            mine = np.isin(read_edges(hist, low), want)
            if mine.any():
                rows.append((span, _widen(at, width)[mine].tobytes()))
        return pd.DataFrame(rows, columns=["span", "at"])

    def read(group: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The words of doubtful edges."""
        if not len(asked) or not len(group):
            return pd.DataFrame([], columns=["words", "span", "at"])
        places, span = _Places(_documents(group), window), int(group["span"].iloc[0])
        at = np.concatenate([np.frombuffer(c, np.uint64) for c in asked["at"]]).tolist()
        return pd.DataFrame([(b" ".join(places.run(i, 1)), span, i) for i in at], columns=["words", "span", "at"])

    def finish(group: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
        docs = _documents(group)
        missing = dict(zip(group["id"], group["unnamed"], strict=True)) if group["unnamed"].any() else {}
        lead, tell, counts = _edges(docs, window, hash_bits)
        repeated = np.ones(len(lead), bool)
        repeated[_firsts(lead, tell)[1]] = False
        for at, length in zip(paths["at"], paths["length"], strict=True):
            for i, n in zip(np.frombuffer(at, np.int64).tolist(), np.frombuffer(length, np.int64).tolist(), strict=True):
                repeated[i : i + n] = True
        rows, start, last, result = [], 0, None, None
        for row, n in zip(docs, counts.tolist(), strict=True):
            if row != last:
                words, removed = row[1].split(), 0
                marks = np.flatnonzero(repeated[start : start + n])
                if len(marks):
                    turn = np.zeros(len(words) + 1, np.int32)
                    turn[marks] += 1
                    turn[marks + window] -= 1
                    kept = np.cumsum(turn[:-1]) == 0
                    removed = len(words) - int(kept.sum())
                    words = list(compress(words, kept))
                text = b" ".join(words)
                result = (len(words) + removed, removed, hashlib.sha256(text).hexdigest(), text.decode() if keep_text else None)
            rows.append((None if missing.get(row[0]) else row[0], *result))
            start, last = start + n, row
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out if keep_text else out.drop(columns="kept_text")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        at = group["at"].to_numpy(np.int64)
        return pd.DataFrame({"span": [group["span"].iloc[0]], "at": [at.tobytes()], "length": [np.ones_like(at).tobytes()], "chance": [b""]})

    text = F.col(text_col).cast("string").cast("binary")
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).mapInArrow(deal, "span int, id long, unnamed boolean, text binary")
    by_span = dealt.groupBy("span")
    sent = by_span.applyInPandas(send, "bucket long, span int, width int, hist binary, low binary, at binary")
    back = sent.groupBy("bucket").applyInPandas(join, "span int, width int, at binary, source binary, source_at binary")
    paths = by_span.cogroup(back.groupBy("span")).applyInPandas(compact, "source int, span int, at binary, source_at binary, length binary, digest binary")
    held = "span int, at binary, length binary, chance binary"
    verified = by_span.cogroup(paths.groupBy("source")).applyInPandas(verify, held)
    doubts = verified.groupBy("span").applyInPandas(doubtful, "bucket long, edge long")
    asked = sent.groupBy("bucket").cogroup(doubts.groupBy("bucket")).applyInPandas(fetch, "span int, at binary")
    words = by_span.cogroup(asked.groupBy("span")).applyInPandas(read, "words binary, span int, at long")
    order = Window.partitionBy("words").orderBy("span", "at")
    again = words.withColumn("n", F.row_number().over(order)).filter("n > 1").groupBy("span").applyInPandas(pack, held)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    # Not a union: `verified` is dealt by range once, for this and for the doubts.
    known = verified.groupBy("span").cogroup(again.groupBy("span")).applyInPandas(lambda x, y: pd.concat([x, y]), held)
    done = by_span.cogroup(known.groupBy("span")).applyInPandas(finish, schema)
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))
