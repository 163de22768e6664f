"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.llm.common import store
from chronoplane.llm.components import components

#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Variants a task holds at once.
VARIANTS = 1 << 22
#: Fingerprints that a bucket gets on average, before its neighbours' come in.
PER_BUCKET = 64


def _fingerprint(data: bytes, size: int, seed: int) -> int:
    """data: lower-cased UTF-8. A bit is set if it is in over half of the shingles' hashes."""
    parts = data.split()
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    ends = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(ends + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(size, n) - 1 :]
    digest, counts, shingles = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(last)
    for i in range(0, shingles, CHUNK):
        part = [digest(joined[a:b], seed) for a, b in zip(starts[i : min(i + CHUNK, shingles)].tolist(), last[i : i + CHUNK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > shingles, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint long) of each row: 64 majority bits over the XXH64 hashes of its word shingles.

    A-Z are lower-cased; words are runs of anything but ASCII white space; shingles are `size` words joined by a space,
    repeats included. A text of fewer words is one shingle; a null text and one without words have fingerprint 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_fingerprint((t.as_py() or b"").lower(), size, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fingerprint"])

    text = F.col(text_col).cast("string").cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint long")


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of `bits` bits with at most `radius` set, fewest first."""
    return np.array([sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(bits), k)], np.uint64)


def _forest(labels: np.ndarray, owner: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each fingerprint the smallest one that shared groups reach. owner, group: index pairs, sorted by group."""
    cuts = np.flatnonzero(np.diff(group, prepend=group[0] - np.uint64(1) if len(group) else 0))
    sizes = np.diff(np.append(cuts, len(group)))
    root = labels.copy()
    while True:
        least = np.repeat(np.minimum.reduceat(root[owner], cuts), sizes)
        after = root.copy()
        np.minimum.at(after, owner, least)
        if (after == root).all():
            return root
        root = after


def _links(key: int, found: np.ndarray, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of a bucket that share a variant whose low bits are `key`, as a forest.

    Two fingerprints that share a variant differ from it by `half` bits each at most, so by twice that from each other;
    two that differ by so much share the variant halfway between them. So linking all owners of a variant to the
    smallest of them loses and adds nothing; the distance to it is verified all the same.
    """
    found = np.unique(found)
    low = np.uint64((1 << bits) - 1)
    apart = np.bitwise_count((found & low) ^ np.uint64(key)).astype(int)
    high = found >> np.uint64(bits)
    masks = [ball(64 - bits, half - d) for d in range(half + 1)]
    total = sum(int((apart == d).sum()) * len(masks[d]) for d in range(half + 1))
    slices = max(1, math.ceil(total / VARIANTS))
    ends_a, ends_b = [], []
    for s in range(slices):
        values, owners = [], []
        for d in range(half + 1):
            mine = np.flatnonzero(apart == d)
            step = max(1, VARIANTS // len(masks[d]))
            for i in range(0, len(mine), step):
                v = (high[mine[i : i + step], None] ^ masks[d][None, :]).ravel()
                o = np.repeat(mine[i : i + step], len(masks[d]))
                if slices > 1:
                    pick = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(slices) == s
                    v, o = v[pick], o[pick]
                values.append(v)
                owners.append(o)
        v, o = np.concatenate(values), np.concatenate(owners)
        ordered = np.sort(v)
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(shared):
            continue
        at = np.searchsorted(shared, v)
        at[at == len(shared)] = 0
        pick = shared[at] == v
        v, o = v[pick], o[pick]
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
        cuts = np.flatnonzero(np.diff(v, prepend=~v[:1]))
        least = np.repeat(np.minimum.reduceat(found[o], cuts), np.diff(np.append(cuts, len(v))))
        true = np.bitwise_count(found[o] ^ least) <= 2 * half
        v, o = v[true], o[true]
        ids = np.unique(o)
        root = _forest(found[ids], np.searchsorted(ids, o), v)
        linked = root != found[ids]
        ends_a.append(found[ids][linked])
        ends_b.append(root[linked])
    none = np.array([], np.uint64)
    return (np.concatenate(ends_a), np.concatenate(ends_b)) if ends_a else (none, none)


def links(found: DataFrame, count: int, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that differ by `distance` bits or fewer.

    found: one column of distinct fingerprints, `count` of them. Each stands for all its variants within half the
    distance; a bucket is the variants with the same low bits. A fingerprint goes once to each bucket in which it has
    variants, packed with the others of its batch, and the bucket's task makes the variants, groups equal ones and links
    their owners; so a shuffle moves the buckets of a fingerprint (79 for 12 bits), not its 2081 variants. The number of
    low bits grows with the count, so that buckets stay small; many variants in a bucket are worked off in slices.
    """
    if distance % 2:
        raise ValueError("distance must be even: half of it is the radius of a ball")
    half = distance // 2
    bits = min(40, max(8, math.ceil(math.log2(max(1, count) / PER_BUCKET + 1))))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = ball(bits, half)
        low = np.uint64((1 << bits) - 1)
        for batch in batches:
            f = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            step = max(1, VARIANTS // len(masks))
            for i in range(0, len(f), step):
                part = f[i : i + step]
                keys = ((part & low)[:, None] ^ masks[None, :]).ravel()
                order = np.argsort(keys, kind="stable")
                data, keys = np.repeat(part, len(masks))[order], keys[order]
                cuts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
                ends = np.append(cuts[1:], len(keys))
                blobs = [data[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[cuts].view(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "packed"])

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        data = np.frombuffer(b"".join(group["packed"]), np.uint64)
        a, b = _links(int(group["bucket"].iloc[0]), data, bits, half)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    made = found.mapInArrow(scatter, "bucket long, packed binary").groupBy("bucket").applyInPandas(gather, "a long, b long")
    return made.distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint long, component_id) of each row; documents whose fingerprints differ by `distance` bits or fewer are linked.

    component_id is the smallest id that links reach, the row's own included. Equal fingerprints are one node, so a group
    of copies costs one row. Null and wordless texts have fingerprint 0 and are linked like any other. Rows with a null id
    are grouped too; only where no id of a group is known is component_id null. Equal rows stay apart. No rows give no
    rows. Other columns aren't read.
    """
    marked, _ = store(fingerprints(docs, id_col=id_col, text_col=text_col, size=size, seed=seed), "fingerprints")
    nodes, _ = store(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "nodes")
    groups = components(links(nodes.select("fingerprint"), nodes.count(), distance))
    labels = nodes.join(groups, nodes.fingerprint == groups.node, "left").select("fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component"))
    least = labels.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = labels.join(least, "component").select("fingerprint", "component_id")
    return marked.join(labels, "fingerprint").select("doc_id", "fingerprint", "component_id")
