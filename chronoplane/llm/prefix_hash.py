"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The modulus, a Mersenne prime, and the base of the polynomial.
P = (1 << 61) - 1
BASE = 0x1B873593CC9E2D51 % P
#: Cut points that a fingerprint keeps, at most; a longer text keeps those of the smallest hashes.
KEPT = 64
#: A cut stands before WINDOW code points whose hash is below those of all windows up to REACH before and after.
WINDOW, REACH = 8, 32
#: The bound on a cut's hash where a fingerprint keeps all cuts.
ALL = 1 << 32
CUT_ACCURACY = 10_000
#: Code points hashed at once.
BLOCK = 1 << 16

_M, _LOW = np.uint64(P), np.uint64((1 << 32) - 1)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo P, for x below 2^64."""
    x = (x & _M) + (x >> np.uint64(61))
    # Below P the difference wraps around and is the larger one.
    return np.minimum(x, x - _M)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo P, for a and b below P: the product in halves of 32 bits, folded at bit 61."""
    a1, a0, b1, b0 = a >> np.uint64(32), a & _LOW, b >> np.uint64(32), b & _LOW
    mid = a1 * b0 + a0 * b1
    # a1 b1 2^64 = a1 b1 8 (mod P); mid 2^32 splits at bit 29.
    high = _fold((a1 * b1) << np.uint64(3))
    middle = (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << np.uint64(32))
    return _fold(high + _fold(middle) + _fold(a0 * b0))


_powers = np.array([1], np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE^0 ... BASE^(n-1) modulo P, by doubling; a worker keeps the longest so far."""
    global _powers
    while len(_powers) < n:
        step = np.uint64(pow(BASE, len(_powers), P))
        _powers = np.concatenate([_powers, mulmod(_powers, np.full(len(_powers), step))])
    return _powers[:n]


class Prefixes:
    """Prefix array of a text: entry i is the sum of (code point + 1) * BASE^position before i, modulo P."""

    def __init__(self, points: np.ndarray) -> None:
        terms = mulmod(points.astype(np.uint64) + np.uint64(1), powers(len(points)))
        # Sums of halves stay below 2^64 for 2^31 terms.
        low = np.cumsum(terms & _LOW, dtype=np.uint64)
        high = _fold(np.cumsum(terms >> np.uint64(32), dtype=np.uint64))
        high = (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32))
        sums = _fold(_fold(low) + _fold(high))
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])

    def __len__(self) -> int:
        return len(self.sums) - 1

    def span(self, start: int, length: int) -> int:
        """The hash of a span, moved to the position `start`."""
        return (int(self.sums[start + length]) - int(self.sums[start])) % P

    def equal(self, start: int, other: 'Prefixes', at: int, length: int) -> bool:
        """Whether two spans are equal, up to a chance of length / P."""
        return self.span(start, length) * pow(BASE, at, P) % P == other.span(at, length) * pow(BASE, start, P) % P

    def common(self, start: int, other: 'Prefixes', at: int) -> int:
        """The longest common extension of two positions, by binary search."""
        low, high = 0, min(len(self) - start, len(other) - at)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(start, other, at, mid) else (low, mid - 1)
        return low


def prefix_at(points: np.ndarray, at: list[int]) -> list[int]:
    """The prefix hashes at ascending positions. Long texts go by blocks, so memory doesn't grow with them."""
    out, total, k = [], 0, 0
    for start in range(0, max(1, len(points)), BLOCK):
        sums, factor = Prefixes(points[start : start + BLOCK]).sums, pow(BASE, start, P)
        while k < len(at) and at[k] - start < len(sums):
            out.append((total + int(sums[at[k] - start]) * factor) % P)
            k += 1
        total = (total + int(sums[-1]) * factor) % P
    return out


def _local(points: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each window of WINDOW code points, modulo 2^64 by doubling: it only says where to cut."""
    h, size, factor = points.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while size < WINDOW:
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = 2 * size, factor**2 % (1 << 64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h >> np.uint64(32)).astype(np.uint32)


def cuts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Ascending cut points, their hashes, and the bound that these are below. The text by blocks, as `prefix_at`.

    A cut depends on the code points around it only, so an edit moves no cut but those near it. Of over KEPT cuts those
    stay whose hash is below the smallest that isn't kept: two texts compare by the cuts below both bounds. Equal
    windows close to each other have no least one, so a text that repeats itself in short periods has no cuts.
    """
    windows, places, hashes = max(0, len(points) - WINDOW + 1), [], []
    for start in range(0, windows, BLOCK):
        low, high = max(0, start - REACH), min(windows, start + BLOCK + REACH)
        h = _local(points[low : high + WINDOW - 1])
        edge = np.full(REACH, (1 << 32) - 1, np.uint32)
        least, size = np.concatenate([edge, h, edge]), 1
        while size < REACH:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        found = np.flatnonzero((h < least[: len(h)]) & (h < least[REACH + 1 : REACH + 1 + len(h)]))
        found = found[(found + low >= max(1, start)) & (found + low < start + BLOCK)]
        places.append(found + low)
        hashes.append(h[found])
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    marks = np.concatenate(hashes) if hashes else np.zeros(0, np.uint32)
    if len(at) <= KEPT:
        return at, marks, ALL
    bound = int(np.partition(marks, KEPT)[KEPT])
    kept = marks < bound
    return at[kept], marks[kept], bound


_CUT = np.dtype([("at", ">u4"), ("mark", ">u4"), ("sum", ">u8")])


def fingerprint(points: np.ndarray) -> str:
    """Length, bound of the cuts, prefix hash of the whole, then place, hash and prefix hash of each cut; all in hexadecimal."""
    at, marks, bound = cuts(points)
    *sums, whole = prefix_at(points, [*at.tolist(), len(points)])
    rows = np.empty(len(at), _CUT)
    rows["at"], rows["mark"], rows["sum"] = at, marks, sums
    return f"{len(points):010x}{bound:010x}{whole:016x}" + rows.tobytes().hex()


def power_at(exponents: np.ndarray) -> np.ndarray:
    """BASE to each exponent modulo P."""
    if exponents.max(initial=0) < BLOCK:
        return powers(BLOCK)[exponents]
    far = np.array([pow(BASE, BLOCK * q, P) for q in (exponents // BLOCK).tolist()], np.uint64)
    return mulmod(powers(BLOCK)[exponents % BLOCK], far)


def _spans(mark: str, bound: int, top: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Edges of the spans between the cuts below `bound`, and each span's length and hash, moved to the position `top`."""
    n, whole = int(mark[:10], 16), int(mark[20:36], 16)
    rows = np.frombuffer(bytes.fromhex(mark[36:]), _CUT)
    rows = rows[rows["mark"] < bound]
    edges = np.concatenate([[0], rows["at"].astype(np.int64), [n]])
    sums = np.concatenate([np.zeros(1, np.uint64), rows["sum"].astype(np.uint64), np.array([whole], np.uint64)])
    own = _fold(sums[1:] + np.uint64(P) - sums[:-1])
    return edges.tolist(), list(zip(np.diff(edges).tolist(), mulmod(own, power_at(top - edges[:-1])).tolist(), strict=True))


def extension(a: np.ndarray, b: np.ndarray) -> int:
    """How many code points from the front are equal: the longest common extension, by prefix hashes of growing pieces."""
    if not len(a) or not len(b) or a[0] != b[0]:
        return 0
    at, size = 0, 64
    while at < min(len(a), len(b)):
        x, y = Prefixes(a[at : at + size]), Prefixes(b[at : at + size])
        k = x.common(0, y, 0)
        at, size = at + k, min(4 * size, BLOCK)
        if k < min(len(x), len(y)):
            break
    return at


def likeness(a: str, b: str, texts: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """How alike two texts are: the code points in common spans over the longer length.

    The cuts below both bounds divide both texts. Spans are equal if length and hash are (wrong once in about 2^61 / length);
    each has one partner, if it can the span after the last one's partner, else the first that is free. So text that
    moves or has something put in still counts. With the `texts`, the longest common extensions into the differing
    spans count too: from the front of the texts or a common span before, and from the end or a common span behind.
    Without them, an edit costs the whole span around it.
    """
    if a == b:
        return 1.0
    n, m, bound = int(a[:10], 16), int(b[:10], 16), min(int(a[10:20], 16), int(b[10:20], 16))
    longer = max(n, m)
    (cuts_a, spans_a), (cuts_b, spans_b) = _spans(a, bound, longer), _spans(b, bound, longer)
    places: dict[tuple[int, int], list[int]] = {}
    for j in range(len(spans_b) - 1, -1, -1):
        places.setdefault(spans_b[j], []).append(j)
    partner, taken, common, last = [-1] * len(spans_a), [False] * len(spans_b), 0, -1
    for i, span in enumerate(spans_a):
        j = last + 1 if last + 1 < len(spans_b) and spans_b[last + 1] == span and not taken[last + 1] else -1
        free = places.get(span, [])
        while j < 0 and free:
            j = free.pop()
            j = -1 if taken[j] else j
        if j >= 0:
            partner[i], taken[j], last, common = j, True, j, common + span[0]
    if texts is not None:
        rest = [span[0] for span in spans_b]
        for i, span in enumerate(spans_a):
            if partner[i] >= 0:
                continue
            own, left = texts[0][cuts_a[i] : cuts_a[i + 1]], span[0]
            before = partner[i - 1] + 1 if i and partner[i - 1] >= 0 else 0 if not i else -1
            behind = len(spans_b) - 1 if i + 1 == len(spans_a) else partner[i + 1] - 1 if partner[i + 1] >= 0 else -1
            for j, step in ((before, 1), (behind, -1)):
                if 0 <= j < len(spans_b) and not taken[j]:
                    gain = min(left, rest[j], extension(own[::step], texts[1][cuts_b[j] : cuts_b[j + 1]][::step]))
                    left, rest[j], common = left - gain, rest[j] - gain, common + gain
    return common / longer


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited one, and how like the text the edited and the next one are (`likeness`).

    The next document is the one of the next smaller id, after the last the first; the edited text has its last
    floor(n_chars / 2) code points replaced by the first as many (or all) of the next document.

    Documents are dealt out by ranges of ids at the cut points of one aggregate; the first row of a range in that order also goes to
    the range above, whose last document it follows. So whole texts are shuffled once, and no range needs another one.

    Null texts are empty. Null ids come last. Rows of one id are in the order of their texts; equal rows follow each
    other. Of a single row the next document is itself. No rows give no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    last_id = -(1 << 63)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = np.unique(np.array(base.agg(F.percentile_approx("id", shares, CUT_ACCURACY)).first()[0] or [], np.int64))

    # The first row of each range in descending order; as many rows as ranges.
    span = F.aggregate(F.array(*[F.lit(int(c)) for c in cuts]).cast("array<bigint>"), F.lit(0), lambda a, c: a + (c <= F.coalesce("id", F.lit(last_id))).cast("int"))
    heads = base.select(span.alias("span"), F.struct(F.coalesce("id", F.lit(last_id)).alias("id"), F.xxhash64("text").alias("mark")).alias("row"))
    heads = sorted((r["span"], (r["row"]["id"], r["row"]["mark"])) for r in heads.groupBy("span").agg(F.max("row").alias("row")).collect())
    after = {heads[i][1]: heads[(i + 1) % len(heads)][0] for i in range(len(heads))}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = batch.column(0).fill_null(last_id).to_numpy(zero_copy_only=False)
            spans = np.searchsorted(cuts, ids, "right").tolist()
            marks, rows = batch.column(2).to_pylist(), []
            for k, (i, text) in enumerate(zip(ids.tolist(), batch.column(1), strict=True)):
                packed = pack(text.as_py())
                rows.append((spans[k], i, marks[k], not batch.column(0)[k].is_valid, False, packed))
                if (i, marks[k]) in after:
                    rows.append((after[i, marks[k]], i, marks[k], False, True, packed))
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["span", "id", "mark", "unnamed", "tail", "text"])

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        read = lambda packed: np.frombuffer(unpack(packed).decode().encode("utf-32-le"), "<u4")
        rows = group.sort_values(["tail", "id", "mark"], ascending=[True, False, False], kind="stable")
        out, held = [], None
        for i, unnamed, tail, packed in zip(rows["id"], rows["unnamed"], rows["tail"], rows["text"], strict=True):
            points = read(packed)
            mark = fingerprint(points)
            if held:
                now, own, own_mark = held
                half = len(own) // 2
                edited = np.concatenate([own[: len(own) - half], points[:half]])
                edited_mark = fingerprint(edited)
                digest = hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest()
                out.append((now, len(own), digest, own_mark, edited_mark, likeness(own_mark, edited_mark, (own, edited)), likeness(own_mark, mark, (own, points))))
            held = (None if unnamed else i, points, mark)
            if tail:
                break
        done = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        done["doc_id"] = done["doc_id"].astype("Int64")
        return done

    dealt = base.select("id", "text", F.xxhash64("text").alias("mark")).mapInArrow(deal, "span int, id long, mark long, unnamed boolean, tail boolean, text binary")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.groupBy("span").applyInPandas(finish, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
