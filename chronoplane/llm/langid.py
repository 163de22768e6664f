"""Language identification: each document as a mixture of languages, by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the count tables of one, two and three letters. Letters of large scripts share cells.
BITS = (12, 16, 18)
#: Code points of text that are worked on at once.
BLOCK = 1 << 20
#: Languages that a task counts for at once, before it passes counts on.
HELD = 32
#: Weight of the shorter context where a longer one was seen seldom.
BACKOFF = 5.0
#: What a letter may have as likelihood at least.
FLOOR = 1e-6
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Mixture:
    """rounds, close: EM ends after so many rounds or when no share moves by more. penalty: what another language must add
    to a text's log-likelihood, in units of log(words) / 2; 1 is the Bayesian information criterion, more allows for words
    that aren't independent. prior: words that each language is credited with in the score."""

    rounds: int = 50
    close: float = 1e-4
    penalty: float = 4.0
    prior: float = 0.25


_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def _cells(points: np.ndarray, order: int) -> np.ndarray:
    """The table cell of the `order` code points that end at each place."""
    if order == 1:
        return (points.astype(np.uint64) * MIX >> np.uint64(64 - BITS[0])).astype(np.int64)
    h = points.astype(np.uint64)
    for k in range(1, order):
        before = np.zeros(len(points), np.uint64)
        before[k:] = points[:-k]
        h += before << np.uint64(21 * k)
    return ((h ^ (h >> np.uint64(31))) * MIX >> np.uint64(64 - BITS[order - 1])).astype(np.int64)


class Block:
    """Lower-cased words of several texts in one array, a 0 after each; three letters of context reach over it.

    owner: the text of each word. starts: where words start.
    """

    def __init__(self, texts: list[str | None]) -> None:
        joined = "\x00".join([(t or "").lower() for t in texts])
        raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        letter = _is_letter()[raw]
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        # Kept are letters and the one mark after each word.
        after = np.zeros(len(raw), bool)
        after[1:] = letter[:-1] & ~letter[1:]
        keep = letter | after
        text = np.cumsum(raw == 0)
        self.owner = text[first]
        self.points = np.where(letter, raw, 0)[keep]
        if len(raw) and letter[-1]:
            self.points = np.append(self.points, 0)
        self.starts = np.flatnonzero(self.points[:-1] == 0) + 1 if len(self.points) else np.empty(0, np.int64)
        self.starts = np.append(0, self.starts) if len(self.points) else self.starts


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in runs of some BLOCK code points, with the number of the first; a text stays whole."""
    first, run, total = 0, [], 0
    for i, t in enumerate(texts):
        t = t.as_py()
        if t is not None and "\x00" in t:
            t = t.replace("\x00", " ")
        run.append(t)
        total += len(t or "") + 1
        if total > BLOCK:
            yield first, run
            first, run, total = i + 1, [], 0
    if run:
        yield first, run


@dataclass
class Model:
    """Log-likelihoods by language. tables[k]: counts of n-grams of k + 1 letters, a column for each language."""

    langs: list[str]
    tables: list[np.ndarray]

    def __post_init__(self) -> None:
        total = np.maximum(self.tables[0].sum(0), 1)
        self.single = self.tables[0] / total

    def words(self, block: Block) -> np.ndarray:
        """The log-likelihood of each word in each language, worked out for some letters at a time."""
        step = max(1, 4 * BLOCK // max(4, len(self.langs)))
        first = np.unique(np.searchsorted(block.starts, np.arange(0, len(block.points), step)))
        first = first[first < len(block.starts)]
        cuts = np.append(block.starts[first], len(block.points))
        parts = [self._words(block.points[max(0, a - 2) : b], block.starts[i:j] - max(0, a - 2), a - max(0, a - 2)) for a, b, i, j in zip(cuts, cuts[1:], first, np.append(first[1:], len(block.starts)))]
        return np.concatenate(parts)

    def _words(self, p: np.ndarray, starts: np.ndarray, skip: int) -> np.ndarray:
        """Each letter, and the end of the word, given the two before. skip: points that are context only."""
        one, two, three = (_cells(p, k) for k in (1, 2, 3))
        back = lambda c: np.concatenate([np.zeros(1, np.int64), c[:-1]])
        likely = self.single[one]
        likely = (self.tables[1][two] + BACKOFF * likely) / (self.tables[0][back(one)] + BACKOFF)
        likely = (self.tables[2][three] + BACKOFF * likely) / (self.tables[1][back(two)] + BACKOFF)
        return np.add.reduceat(np.log(np.maximum(likely[skip:], FLOOR)), starts - skip, axis=0)


def learn(docs: DataFrame) -> Model:
    """Counts n-grams of one to three letters by language over all rows of (lang, text) with a language.

    Tasks count in tables of fixed size and pass on the cells they filled; the driver gets a row per language and cell, so
    2^12 + 2^16 + 2^18 a language at most, whatever the corpus. A language without a letter in any text isn't learned.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, tables in held.items():
                for k, t in enumerate(tables):
                    at = np.flatnonzero(t)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(t[at])], names=["lang", "size", "cell", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                if lang not in held and len(held) >= HELD:
                    yield from out()
                tables = held.setdefault(lang, [np.zeros(1 << b, np.int64) for b in BITS])
                for _, texts in _blocks(batch.column(1).filter(pa.array(langs == lang))):
                    p = Block(texts).points
                    for k in (1, 2, 3):
                        tables[k - 1] += np.bincount(_cells(p, k), minlength=1 << BITS[k - 1])
        yield from out()

    counts = docs.where("lang IS NOT NULL").mapInArrow(count, "lang string, size int, cell int, n long")
    found = counts.groupBy("lang", "size", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(found["lang"]))
    tables = [np.zeros((1 << b, len(langs)), np.float32) for b in BITS]
    column = found["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy(np.int64)
    for k, t in enumerate(tables):
        pick = found["size"].to_numpy() == k
        t[found["cell"].to_numpy()[pick], column[pick]] = found["n"].to_numpy()[pick]
    return Model(langs, tables)


def shares(likely: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rule: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """EM over the words of each text: the languages' shares, and the log-likelihood that they give.

    likely: log-likelihood of each word by language. starts: first word of each text. allowed: by text and language.
    """
    sizes = np.diff(np.append(starts, len(likely)))
    owner = np.repeat(np.arange(len(starts)), sizes)
    scaled = np.where(allowed[owner], likely, -np.inf)
    top = scaled.max(1, keepdims=True)
    scaled = np.exp(scaled - top)
    pi = allowed / allowed.sum(1, keepdims=True)
    live = np.arange(len(starts))  # texts whose shares still move
    rows, s, own, at = np.arange(len(likely)), scaled, owner, starts
    for _ in range(rule.rounds):
        r = s * pi[own]
        r /= r.sum(1, keepdims=True)
        new = np.add.reduceat(r, at, axis=0) / sizes[live, None]
        moving = np.abs(new - pi[live]).max(1) > rule.close
        pi[live] = new
        if not moving.any():
            break
        if moving.mean() < 0.7:
            picked = np.repeat(moving, sizes[live])
            live, rows = live[moving], rows[picked]
            s, own = scaled[rows], owner[rows]
            at = np.cumsum(sizes[live]) - sizes[live]
    mixed = np.log(np.maximum((scaled * pi[owner]).sum(1), 1e-300)) + top[:, 0]
    return pi, np.add.reduceat(mixed, starts)


def choose(likely: np.ndarray, starts: np.ndarray, rule: Mixture) -> np.ndarray:
    """The shares of the chosen languages of each text.

    Languages enter in the order of their shares among all languages. A set is kept while the next language raises the
    log-likelihood by more than the penalty; the first is the one that explains the text best alone.
    """
    n, count = len(starts), likely.shape[1]
    sizes = np.diff(np.append(starts, len(likely)))
    alone = np.add.reduceat(likely, starts, axis=0)
    best = alone.argmax(1)
    pi = np.zeros((n, count))
    pi[np.arange(n), best] = 1
    if count == 1:
        return pi
    full, _ = shares(likely, starts, np.ones((n, count), bool), rule)
    full[np.arange(n), best] = np.inf
    order = np.argsort(-full, axis=1, kind="stable")
    value = alone[np.arange(n), best]
    live = np.flatnonzero(sizes > 1)
    for k in range(2, count + 1):
        if not len(live):
            break
        mine = np.concatenate([np.arange(a, a + m) for a, m in zip(starts[live], sizes[live], strict=True)])
        allowed = np.zeros((len(live), count), bool)
        np.put_along_axis(allowed, order[live, :k], True, axis=1)
        got, reached = shares(likely[mine], np.cumsum(sizes[live]) - sizes[live], allowed, rule)
        better = reached - value[live] > rule.penalty * np.log(sizes[live]) / 2
        live = live[better]
        pi[live], value[live] = got[better], reached[better]
    return pi


def identify(docs: DataFrame, model: Model, rule: Mixture = Mixture(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_letter_words, langs) of each row; langs: the chosen languages with their shares, largest first.

    Words are runs of letters; each is drawn from one of the text's languages, with the likelihood of its letters given
    the two before. `choose` finds shares and languages. lang_pred is the language with the largest share (ties: the first
    in code-point order), score its share with `prior` words credited to every language, so a short text scores less. A
    null text, one without a letter, and any text under a model without languages have `und`, score 0 and no languages.
    Whole texts are read, in blocks of whole texts. Null ids and equal rows are kept. No rows give no rows. Other columns
    aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    found_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            pred, score, words, langs = ["und"] * n, np.zeros(n), np.zeros(n, np.int64), [[] for _ in range(n)]
            for first, texts in _blocks(batch.column(1)):
                block = Block(texts)
                if not len(block.starts) or not model.langs:
                    continue
                starts = np.flatnonzero(np.diff(block.owner, prepend=-1))
                texts_at = block.owner[starts] + first
                sizes = np.diff(np.append(starts, len(block.owner)))
                pi = choose(model.words(block), starts, rule)
                for i, m, p in zip(texts_at.tolist(), sizes.tolist(), pi, strict=True):
                    top = int(p.argmax())
                    pred[i] = model.langs[top]
                    score[i] = (m * p[top] + rule.prior) / (m + rule.prior * len(p))
                    words[i] = m
                    langs[i] = [{"lang": model.langs[k], "share": float(p[k])} for k in np.argsort(-p, kind="stable") if p[k] > 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(words), pa.array(langs, found_type)], names=["doc_id", "lang_pred", "score", "n_letter_words", "langs"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_letter_words long, langs array<struct<lang:string,share:double>>")


def language_id(docs: DataFrame, rule: Mixture = Mixture(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """`identify` for all rows, with held_out: whether the crc32 of the row's id as text is divisible by `folds`.

    The model learns from the rows that are not held out and have a language; text is all that a prediction reads. A null
    id is an empty text here, whose crc32 is 0, so such rows are held out.
    """
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
    given = docs.where(~held).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    found = identify(docs, learn(given), rule, id_col=id_col, text_col=text_col)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_letter_words", "langs")
