"""Vector bin packing of tokenised examples into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.llm.tokens import encoder

#: Bytes of ids that a task holds before it returns the pieces.
HELD_BYTES = 4 << 20
#: Sequence ids of a task start at its number times this.
TASK_STRIDE = 1 << 33


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most, and how pieces are made to fit.

    tokens: its length, a power of two. segments: pieces. loss: tokens that bear loss. gap: free tokens that are left
    alone; a larger gap is filled by cutting a piece. pool: pieces a task holds to choose from.
    """

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048
    gap: int = 8
    pool: int = 1024

    def __post_init__(self) -> None:
        if self.tokens & (self.tokens - 1) or min(self.tokens, self.segments, self.loss, self.pool) < 1:
            raise ValueError("tokens must be a power of two, the other limits positive")


class _Packer:
    """Packs a stream of examples; memory is bounded by the pool."""

    def __init__(self, limits: Limits, first: int) -> None:
        self.lim, self.next = limits, first
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.need = np.zeros((2 * limits.pool, 3))
        self.items: list[tuple] = []
        self.done: list[tuple] = []
        self.held = 0

    def add(self, doc, ids: bytes, loss_from: int) -> None:
        """An example: whole sequences of it go out at once, the rest waits in the pool."""
        n, at, lim = len(ids) // 4, 0, self.lim
        whole = lim.tokens if lim.loss >= lim.tokens else min(lim.tokens, lim.loss)
        while n - at >= whole:
            self._close([(doc, n, at, ids[at * 4 : (at + whole) * 4], loss_from)])
            at += whole
        if at < n:
            self._wait((doc, n, at, ids[at * 4 :], loss_from))
            if len(self.items) >= self.lim.pool:
                self._drain(self.lim.pool // 2)

    def end(self) -> None:
        self._drain(0)

    def _loss(self, piece: tuple, length: int | None = None) -> int:
        _, _, at, ids, loss_from = piece
        length = len(ids) // 4 if length is None else length
        return max(0, at + length - max(at, loss_from))

    def _wait(self, piece: tuple) -> None:
        if len(self.items) == len(self.need):
            self.need = np.concatenate([self.need, np.zeros_like(self.need)])
        self.need[len(self.items)] = len(piece[3]) // 4, 1, self._loss(piece)
        self.items.append(piece)

    def _take(self, i: int) -> tuple:
        piece, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i] = last
            self.need[i] = self.need[len(self.items)]
        return piece

    def _drain(self, keep: int) -> None:
        """Fills sequences until `keep` pieces wait."""
        while len(self.items) > keep:
            weights = self.need[: len(self.items)].sum(0) / self.caps
            free, held = self.caps.copy(), []
            while self.items:
                need = self.need[: len(self.items)]
                fits = (need <= free).all(1)
                if not fits.any():
                    break
                score = np.where(fits, need @ (weights * free / self.caps**2), -1.0)
                best = int(score.argmax())
                free -= need[best]
                held.append(self._take(best))
            if self.items and free[0] > self.lim.gap and free[1] >= 1 and free[2] >= 1:
                longest = int(self.need[: len(self.items), 0].argmax())
                doc, n, at, ids, loss_from = self._take(longest)
                cut = int(min(free[0], len(ids) // 4 - 1))
                cut = min(cut, max(0, loss_from - at) + int(free[2]))
                if cut:
                    held.append((doc, n, at, ids[: cut * 4], loss_from))
                self._wait((doc, n, at + cut, ids[cut * 4 :], loss_from))
            if not held:  # a piece that bears more loss than a sequence may: cut it to the limit
                doc, n, at, ids, loss_from = self._take(0)
                cut = max(0, loss_from - at) + self.lim.loss
                held = [(doc, n, at, ids[: cut * 4], loss_from)]
                self._wait((doc, n, at + cut, ids[cut * 4 :], loss_from))
            if self.items or sum(len(h[3]) for h in held) // 4 == self.lim.tokens:
                self._close(held)
            else:
                self._tail(held)

    def _tail(self, held: list[tuple]) -> None:
        """The last sequence of a task is split at powers of two, which need no padding."""
        left = sum(len(h[3]) for h in held) // 4
        while left:
            size = 1 << (left.bit_length() - 1)
            now, room = [], size
            while room:
                doc, n, at, ids, loss_from = held.pop(0)
                cut = min(room, len(ids) // 4)
                now.append((doc, n, at, ids[: cut * 4], loss_from))
                if cut * 4 < len(ids):
                    held.insert(0, (doc, n, at + cut, ids[cut * 4 :], loss_from))
                room -= cut
            self._close(now)
            left -= size

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            doc, n, at, ids, _ = piece
            length = len(ids) // 4
            self.done.append((doc, at, length, zlib.crc32(ids), n, self.next, offset, self._loss(piece), ids))
            offset += length
            self.held += len(ids)
        self.next += 1


def pack(docs: DataFrame, vocabulary: str, limits: Limits = Limits(), *, id_col: str = "doc_id", text_col: str = "text", loss_from: str | None = None, end_id: int = 1, keep_ids: bool = False, kept_pieces: int | None = None) -> DataFrame:
    """Packs whole texts into sequences; one row per piece.

    Every task tokenises its own rows and packs them, so nothing is shuffled and no key can be hot. A text that fills
    whole sequences is cut into them; the rest of it waits in a pool of `limits.pool` pieces. A sequence takes, piece by
    piece, the one whose needs (tokens, segments, loss-bearing tokens) have the largest dot product with what is free,
    each dimension weighted by the demand for it; what then still gapes is filled by cutting the longest piece. The last
    sequence of a task is split at powers of two. Sequence ids are unique, not consecutive; they rest on the order of the
    rows in a task, so pack a table that is stored, not the output of a shuffle.

    kept_pieces: bound of what a worker remembers of the vocabulary's words, less for less memory and more time.
    loss_from: column with the first position that bears loss (a prompt before it bears none); absent or null: 0.

    Null and empty texts give one piece, the end id. A null id stays null. Equal rows are packed each for itself. No rows
    give no rows. Other columns aren't read, whatever their names.
    """
    item = docs.schema[id_col].dataType
    cols = [F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")]
    cols.append((F.coalesce(F.col(loss_from), F.lit(0)) if loss_from else F.lit(0)).cast("long").alias("loss"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    schema = f"doc_id {item.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:]) + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary, kept_pieces), np.array([end_id], "<u4").tobytes()
        packer, doc_type = _Packer(limits, TaskContext.get().partitionId() * TASK_STRIDE), pa.int64()

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.done, strict=True))
            arrays = [pa.array(cols[0], doc_type), *(pa.array(c, pa.int64()) for c in cols[1:8])]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(x, "<i4") for x in cols[8]], pa.list_(pa.int32())))
            packer.done, packer.held = [], 0
            return pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * keep_ids)

        for batch in batches:
            doc_type = batch.column(0).type
            for doc, text, loss in zip(*(batch.column(i) for i in range(3)), strict=True):
                packer.add(doc.as_py(), enc.encode(text.as_py()) + end, loss.as_py())
                if packer.held >= HELD_BYTES:
                    yield out()
        packer.end()
        if packer.done:
            yield out()

    return docs.select(*cols).mapInArrow(run, schema)
