"""Near-duplicates by Jaccard similarity: ball hashing over the segments of a wide SimHash, wider sketches of the texts that have
neighbours, links confirmed on shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.llm.common import store
from chronoplane.llm.components import components
from chronoplane.llm.simhash import ball

#: Bits of a fingerprint, of a segment of it, and the radius of a ball: half the distance at which segments meet.
BITS, SEGMENT, RADIUS = 128, 32, 2
#: Variants a task holds at once, and shingles whose bits are counted at once.
VARIANTS, CHUNK = 1 << 21, 1 << 14
#: Fingerprints of a bucket on average, before its neighbours' come in.
PER_BUCKET = 512
LINK = "a0 long, a1 long, b0 long, b1 long"
ENDS = "f0 long, f1 long, many long, bits long, b0 long, b1 long"
#: 64-bit words of a sketch, and shingles that a text needs for one: with fewer the bits of two texts differ more often.
SKETCH, SKETCHED = 8, 64
#: Further words, for texts that still have candidates in other components, and rounds in which components are found before.
MORE, ROUNDS = 24, 2


@dataclass(frozen=True)
class Similar:
    """size: words of a shingle. percent: Jaccard similarity of two texts' sets of shingles from which they are linked.

    apart: fingerprints with more differing bits are no candidates. At a similarity of 0.8, 19 of 128 bits differ on
    average, with a deviation of 4, so 30 leaves out one pair of 200; at 0.7 it is 24 bits, of unrelated texts 64.
    wide: the same for the 640 bits of fingerprint and sketch together. At 0.8 it is 97 bits with a deviation of 9, so 126 leaves
    out one pair of 1,400; at 0.7 it is 123, at 0.65 135.
    wider: the same for the 2,176 bits with the further words. At 0.8 it is 327 bits with a
    deviation of 17, at 0.7 417 with 18.
    """

    size: int = 5
    percent: int = 80
    apart: int = 30
    wide: int = 126
    wider: int = 384


def shingles(text: bytes, size: int) -> np.ndarray:
    """The set of hashes (two 64-bit words each) of the word shingles of a text, in order; a short text is one shingle."""
    parts = text.lower().split()
    if not parts:
        return np.empty((0, 2), np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1).tolist()
    digest = xxhash.xxh3_128_digest
    found = b"".join([digest(joined[a:b]) for a, b in zip(starts, ends[min(size, len(parts)) - 1 :].tolist())])
    return np.frombuffer(np.unique(np.frombuffer(found, "V16")).tobytes(), "<u8").reshape(-1, 2)


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """The majority bits over a set of hashes, as two words."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(found), CHUNK):
        counts += np.unpackbits(found[i : i + CHUNK].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(found), bitorder="little").view("<u8")


def marks(docs: DataFrame, size: int) -> DataFrame:
    """(key, node, f0, f1) of (key, text): node is the hash of the set of shingles, f0 and f1 the fingerprint."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints = [], np.empty((batch.num_rows, 2), np.uint64)
            for i, text in enumerate(batch.column(1)):
                found = shingles(text.as_py() or b"", size)
                nodes.append(xxhash.xxh3_128_digest(found.tobytes()))
                prints[i] = wide_fingerprint(found)
            signed = prints.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(signed[:, 0]), pa.array(signed[:, 1])], names=["key", "node", "f0", "f1"])

    return docs.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"key {kind}, node binary, f0 long, f1 long")


def _segment(prints: np.ndarray, s: int) -> np.ndarray:
    return (prints[:, s // 2] >> np.uint64(SEGMENT * (s % 2))) & np.uint64((1 << SEGMENT) - 1)


def sketch(hashes: np.ndarray, after: int = 0, words: int = SKETCH) -> np.ndarray:
    """The majority bits of more hashes, made of a set's 64-bit hashes; so many words, without those `after` which they come."""
    counts = np.zeros(64 * words, np.int64)
    steps = np.arange(after + 1, after + words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(hashes), CHUNK):
        z = hashes[i : i + CHUNK, None] + steps
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        counts += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def _apart(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bits of 640 differ between rows i and j; those of the fingerprints stand for all where there is no sketch."""
    bits = np.bitwise_count(rows[i, :2] ^ rows[j, :2]).sum(1, dtype=np.int64)
    if rows.shape[1] == 2:
        return bits
    own = slice(3, 3 + SKETCH)
    both = rows[i, own].any(1) & rows[j, own].any(1)
    return np.where(both, bits + np.bitwise_count(rows[i, own] ^ rows[j, own]).sum(1, dtype=np.int64), (1 + SKETCH // 2) * bits)


def _alike(rows: np.ndarray, i: np.ndarray, j: np.ndarray, apart: int, wide: int, wider: int = 0) -> np.ndarray:
    """Whether rows i and j are candidates by their fingerprints and, where both have them, their sketches and further words."""
    bits = np.bitwise_count(rows[i, :2] ^ rows[j, :2]).sum(1, dtype=np.int64)
    near = bits <= apart
    own, more = slice(3, 3 + SKETCH), slice(5 + SKETCH, None)
    for part, most in ((own, wide), (more, wider)):
        if rows[:1, part].shape[1]:
            at = np.flatnonzero(near & rows[i, part].any(1) & rows[j, part].any(1))
            bits[at] += np.bitwise_count(rows[i[at], part] ^ rows[j[at], part]).sum(1, dtype=np.int64)
            near[at] = bits[at] <= most
    return near


def _near(rows: np.ndarray, owner: np.ndarray, group: np.ndarray, apart: int, wide: int, wider: int = 0) -> np.ndarray:
    """Links (pairs of `rows`) within groups of equal variants: each to the first that is near it.

    owner, group: sorted by group, then owner. In a group the first owner takes all that are near it; the first of the
    others takes the next, and so on, so an unrelated owner hides no link. Rows of one component need no link.
    """
    out = []
    component = rows[:, 3 + SKETCH : 5 + SKETCH]
    while len(owner):
        cuts = np.flatnonzero(np.diff(group, prepend=~group[:1]))
        sizes = np.diff(np.append(cuts, len(group)))
        head = np.repeat(owner[cuts], sizes)
        near = _alike(rows, owner, head, apart, wide, wider) | (owner == head)
        link = near & (owner != head)
        if component.shape[1]:
            link[link] = (component[owner[link]] != component[head[link]]).any(1)
        out.append(np.unique(owner[link].astype(np.int64) * len(rows) + head[link]))
        owner, group = owner[~near], group[~near]
        many = np.repeat(np.diff(np.append(c := np.flatnonzero(np.diff(group, prepend=~group[:1])), len(group))), np.diff(np.append(c, len(group)))) > 1 if len(group) else np.empty(0, bool)
        owner, group = owner[many], group[many]
    code = np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)
    return np.stack(np.divmod(code, max(1, len(rows))), 1)


def _meetings(found: DataFrame, count: int, apart: int, wide: int, wider: int, ends: bool) -> DataFrame:
    """Links between fingerprints of which a segment differs by twice the radius or less, of each bucket.

    found: distinct (f0, f1), or (f0, f1, many, sketch, component[, more]), `count` of them; only links between components count. Of fingerprints that differ by 19 bits one of four
    segments differs by four or fewer. Each segment stands for its variants within the radius, which meet halfway; a bucket
    is the variants with the same low bits, whose number grows with the count. A segment's fingerprints go to the buckets
    of their variants, and the variants are made in the bucket's task, some slices of them at a time. ends: returns not the
    links, (a0, a1, b0, b1), but (f0, f1, many, bits, b0, b1): the fingerprints that have some, how many, and the nearest.
    """
    bits = min(SEGMENT - 8, max(6, math.ceil(math.log2(max(1, count) / PER_BUCKET + 1))))
    low = np.uint64((1 << bits) - 1)
    sketched = "sketch" in found.columns
    parts = {"sketch": SKETCH, "component": 2, "more": MORE}
    parts = {c: n for c, n in parts.items() if c in found.columns}
    width = 3 + sum(parts.values()) if sketched else 2

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = ball(bits, RADIUS)
        for batch in batches:
            rows = np.stack([c.to_numpy().astype(np.int64).view(np.uint64) for c in batch.columns[: min(width, 3)]], 1)
            if sketched:
                more = [np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, n) for c, n in zip(batch.columns[3:], parts.values(), strict=True)]
                rows = np.concatenate([rows, *more], 1)
            step = max(1, VARIANTS // (4 * width * len(masks)))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                for s in range(BITS // SEGMENT):
                    keys = ((_segment(part, s) & low)[:, None] ^ masks[None, :]).ravel()
                    order = np.argsort(keys, kind="stable")
                    data, keys = part[order // len(masks)], keys[order]
                    cuts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
                    blobs = [data[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True)]
                    bucket = (keys[cuts].view(np.int64) << 2) + s
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(blobs, pa.binary())], names=["bucket", "packed"])

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        key = int(group["bucket"].iloc[0])
        s, own = key & 3, np.uint64(key >> 2)
        raw = np.frombuffer(b"".join(group["packed"]), np.uint64).reshape(-1, width)
        rows = np.frombuffer(np.unique(np.ascontiguousarray(raw).view(f"V{8 * width}")).tobytes(), np.uint64).reshape(-1, width)
        if sketched:  # Those with most neighbours come first, so the heads of many variants are the same few.
            rows = rows[np.argsort(~rows[:, 2], kind="stable")]
        value = _segment(rows, s)
        left = RADIUS - np.bitwise_count((value & low) ^ own).astype(int)
        high = value >> np.uint64(bits)
        rest = SEGMENT - bits
        masks = [ball(rest, d) for d in range(RADIUS + 1)]
        total = sum(int((left == d).sum()) * len(masks[d]) for d in range(RADIUS + 1))
        cut = max(0, math.ceil(math.log2(max(1, total) / VARIANTS)))  # a slice: the variants with the same next bits
        cut = min(cut, rest)
        found = []
        for piece in range(1 << cut):
            variants, owners = [], []
            head = high >> np.uint64(rest - cut)
            off = np.bitwise_count(head ^ np.uint64(piece)).astype(int)
            tail = high & np.uint64((1 << (rest - cut)) - 1)
            for d in range(RADIUS + 1):
                mine = np.flatnonzero(left - off == d)
                reach = ball(rest - cut, d)
                variants.append((tail[mine, None] ^ reach[None, :]).ravel())
                owners.append(np.repeat(mine, len(reach)))
            v, o = np.concatenate(variants), np.concatenate(owners)
            order = np.lexsort((o, v))
            v, o = v[order], o[order]
            same = v[1:] == v[:-1]
            many = np.append(same, False) | np.append(False, same) if len(v) else np.empty(0, bool)
            found.append(_near(rows, o[many], v[many], apart, wide, wider))
        pairs = np.unique(np.concatenate(found), axis=0).astype(np.int64)
        prints = rows[:, :2].copy().view(np.int64)
        if ends:
            differ = np.tile(_apart(rows, pairs[:, 0], pairs[:, 1]), 2)
            mine, other = np.append(pairs[:, 0], pairs[:, 1]), np.append(pairs[:, 1], pairs[:, 0])
            order = np.lexsort((other, differ, mine))
            at, cuts, n = np.unique(mine[order], return_index=True, return_counts=True)
            near = order[cuts]
            b = prints[other[near]]
            return pd.DataFrame({"f0": prints[at, 0], "f1": prints[at, 1], "many": n, "bits": differ[near], "b0": b[:, 0], "b1": b[:, 1]})
        a, b = prints[pairs[:, 0]], prints[pairs[:, 1]]
        return pd.DataFrame({"a0": a[:, 0], "a1": a[:, 1], "b0": b[:, 0], "b1": b[:, 1]})

    made = found.select("f0", "f1", *(["many", *parts] if sketched else [])).mapInArrow(scatter, "bucket long, packed binary")
    return made.groupBy("bucket").applyInPandas(gather, ENDS if ends else LINK)


def candidates(found: DataFrame, count: int, apart: int, wide: int = 126, wider: int = 384) -> DataFrame:
    """Links (a0, a1, b0, b1) between the fingerprints of `_meetings`."""
    return _meetings(found, count, apart, wide, wider, False).distinct()


def neighboured(found: DataFrame, count: int, apart: int, wide: int = 126) -> DataFrame:
    """(f0, f1, many, b0, b1) of the fingerprints (f0, f1) that have candidates; many grows with their number.

    b0, b1: the nearest candidate. A row for each fingerprint, however many candidates it has.
    """
    least = F.min(F.struct("bits", "b0", "b1")).alias("near")
    return _meetings(found, count, apart, wide, 0, True).groupBy("f0", "f1").agg(F.sum("many").alias("many"), least).select("f0", "f1", "many", "near.b0", "near.b1")


def shingle_sets(asked: DataFrame, docs: DataFrame, first: DataFrame, rule: Similar) -> DataFrame:
    """(node, hashes, sketch) of the asked nodes (node): the set of shingles as 64-bit hashes. first: (node, key) of a document of each."""
    wanted = first.join(asked.select("node").distinct(), "node", "left_semi")
    texts = docs.join(wanted, "key").dropDuplicates(["node"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingles(t.as_py() or b"", rule.size)[:, 0]) for t in batch.column(1)]
            wide = [sketch(x).tobytes() if len(x) >= SKETCHED else bytes(8 * SKETCH) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(wide, pa.binary())], names=["node", "hashes", "sketch"])

    return store(texts.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(sets, "node binary, hashes binary, sketch binary"), "shingles")[0]


def further(labelled: DataFrame) -> DataFrame:
    """(f0, f1, many, sketch, component, more): the further words of sketches, made of `hashes`."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_py(), "<u8") for x in batch.column(5)]
            more = [sketch(x, SKETCH, MORE).tobytes() if len(x) >= SKETCHED else bytes(8 * MORE) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(more, pa.binary())], names=["f0", "f1", "many", "sketch", "component", "more"])

    wide = "f0 long, f1 long, many long, sketch binary, component binary, more binary"
    return labelled.select("f0", "f1", "many", "sketch", "component", "hashes").mapInArrow(extend, wide)


def confirmed(pairs: DataFrame, held: DataFrame, rule: Similar) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles are as similar as the rule asks. held: (node, hashes) of all of them."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= rule.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], names=["a", "b"])

    # Of two sets one of which is much larger, no pair is similar enough; the sizes tell before the sets travel.
    held = held.select("node", "hashes")
    size = held.select(F.col("node").alias("n"), F.length("hashes").alias("size"))
    sized = pairs.join(size.withColumnsRenamed({"n": "a", "size": "x"}), "a").join(size.withColumnsRenamed({"n": "b", "size": "y"}), "b")
    close = sized.where(100 * F.least("x", "y") >= rule.percent * F.greatest("x", "y")).select("a", "b")
    joined = close.join(held.withColumnsRenamed({"node": "a", "hashes": "ha"}), "a").join(held.withColumnsRenamed({"node": "b", "hashes": "hb"}), "b")
    return joined.select("a", "b", "ha", "hb").mapInArrow(judge, "a binary, b binary")


def _labelled(docs: DataFrame, rule: Similar) -> tuple[DataFrame, DataFrame]:
    """(key, node, ...) of the documents, and (node, key, component) of the nodes with the smallest key of each."""
    given = docs.select("key", "text")
    marked, _ = store(marks(given, rule.size), "marks")
    nodes, _ = store(marked.groupBy("node", "f0", "f1").agg(F.min("key").alias("key")), "nodes")
    prints, _ = store(nodes.groupBy("f0", "f1").agg(F.min("node").alias("head")), "prints")
    met, _ = store(neighboured(prints, prints.count(), rule.apart).join(prints, ["f0", "f1"]), "neighboured")
    equal = nodes.join(prints, ["f0", "f1"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    asked = met.select(F.col("head").alias("node")).union(equal.select("a")).union(equal.select("b"))
    held = shingle_sets(asked, given, nodes.select("node", "key"), rule)
    a, b = (prints.withColumnsRenamed({"f0": f"{x}0", "f1": f"{x}1", "head": x}) for x in "ab")
    asked, links = met, equal.limit(0)
    for i in range(ROUNDS + 1):
        # The nearest candidates make components; of all others only those between components become pairs in the end.
        near = asked.join(b, ["b0", "b1"]).select(F.least("head", "b").alias("a"), F.greatest("head", "b").alias("b")).distinct()
        pairs, _ = store(near if i else near.union(equal), "pairs")
        links, _ = store(links.union(confirmed(pairs, held, rule)), "links")
        found = components(links)
        named = asked.select("head", "f0", "f1", "many").join(found.withColumnsRenamed({"node": "head"}), "head", "left")
        labelled = named.withColumn("component", F.coalesce("component", "head")).join(held.withColumnsRenamed({"node": "head"}), "head")
        if i == ROUNDS:
            break
        labelled, _ = store(labelled.drop("hashes"), "sketched")
        still = neighboured(labelled, labelled.count(), rule.apart, rule.wide).drop("many")
        asked, _ = store(still.join(labelled.select("head", "f0", "f1", "many"), ["f0", "f1"]), "neighboured")
    sketched, _ = store(further(labelled), "sketched")
    pairs, _ = store(candidates(sketched, sketched.count(), rule.apart, rule.wide, rule.wider).join(a, ["a0", "a1"]).join(b, ["b0", "b1"]).select("a", "b"), "pairs")
    found = components(links.union(confirmed(pairs, held, rule)))
    return marked, nodes.join(found, "node", "left").select("node", "key", F.coalesce("component", "node").alias("component"))


def firsts(docs: DataFrame, rule: Similar = Similar()) -> DataFrame:
    """(key): the smallest key of each group of `similar_groups`. No row is dealt by its group."""
    return _labelled(docs, rule)[1].groupBy("component").agg(F.min("key").alias("key")).select("key")


def similar_groups(docs: DataFrame, rule: Similar = Similar()) -> DataFrame:
    """(key, group): the smallest key that links reach, the row's own included. docs: (key, text), keys orderable.

    Texts (A-Z lower-cased) with the same set of shingles are one node. Nodes are linked if their sets have a Jaccard
    similarity of `percent` or more, confirmed on the sets. First each text with candidates is compared with its nearest, by
    fingerprints and then, in `ROUNDS` rounds, by wider sketches, among the texts of other components. Texts that still
    have candidates in other components get more bits, and `candidates` makes pairs of these only. Nodes with
    equal fingerprints are compared with the first of them. A pair may stay unlinked if no segment of its fingerprints is
    close (measured: 2 of 100 pairs at a similarity between 0.8 and 0.85), unless other texts link it.

    Null and wordless texts have the empty set and form one node; a text of fewer words than a shingle is one shingle.
    Rows with equal keys and texts count as one document. No rows give no rows. Other columns aren't read.
    """
    marked, labels = _labelled(docs, rule)
    least = labels.groupBy("component").agg(F.min("key").alias("group"))
    return marked.join(labels.join(least, "component").select("node", "group"), "node").select("key", "group")
