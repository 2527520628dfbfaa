"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a
word is the sum, over all ways to cut it into pieces, of the product of the pieces' probabilities;
a forward pass over the word's characters computes it, whatever the word's length. A text's words are
independent, and the prediction is the language with the largest posterior.

Training is one expectation step: every segmentation of every word of a language's texts counts,
weighted by its probability under the uniform piece model (forward-backward). The whole labelled
training set and every label in it are used. The model has at most one row per piece and language,
whatever the input's size, and is kept in blocks of ``AT_ONCE`` languages; a text is scored by block
after block with a running best and a running sum. The driver holds the labels and one block's counts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize, slices

#: Languages that are collected, sent and scored together.
AT_ONCE = 32
#: Words times languages that are scored together, and that are remembered.
SCORED, REMEMBERED = 80_000, 800_000
#: Words up to this long are scored side by side, longer ones (of scripts without spaces) by themselves.
WORD = 32
LONGEST_PIECE = 16
#: Characters that begin no piece: the same small probability in every language.
UNKNOWN = 1e-7
SMOOTH = 0.5
#: Expected counts travel as integers of this unit, so that sums don't depend on their order.
UNIT = 4096
MARK = "▁"


def _marks() -> str:
    """Combining marks as ranges of a character class: vowel signs and accents of the letter before."""
    points = [c for c in range(0x300, 0x20000) if unicodedata.category(chr(c)) in ("Mn", "Mc")]
    ends = [k for k, c in enumerate(points) if k + 1 == len(points) or points[k + 1] != c + 1]
    starts = [0, *[k + 1 for k in ends[:-1]]]
    return "".join(f"{chr(points[x])}-{chr(points[y])}" for x, y in zip(starts, ends, strict=True))


_LETTERS = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_marks()}])*")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and the marks on them, lower case."""
    return _LETTERS.findall(text.lower()) if text else []


def read_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters and marks, with or without the word mark, in its own order."""
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=path)
    names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    whole = lambda p: bool(p) and (_LETTERS.fullmatch(p) is not None or all(unicodedata.category(c)[0] in "LM" for c in p))
    keep = (p for p in names if whole(p.removeprefix(MARK)) and len(p) <= LONGEST_PIECE or p == MARK)
    return list(dict.fromkeys(keep))


class Pieces:
    """Vectorised search of all pieces at all places of many words."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        h = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(h)
        self.hashes, self.index = h[order], order.astype(np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[h >> np.uint64(44)] = True
        self.single = np.unique(np.array([ord(p) for p in pieces if len(p) == 1], np.uint32))

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
        return h

    def matches(self, words: list[str]):
        """Characters per word, and (start, length, rows, piece) of every occurrence.

        The word mark stands before each word. ``piece`` n is the unknown character.
        """
        width = max(map(len, words)) + 1
        chars = np.array([MARK + w for w in words], f"<U{width}").view(np.uint32).reshape(len(words), width)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        found = []
        lone = np.isin(chars, self.single)
        for i in range(width):
            rows = np.flatnonzero(~lone[:, i] & (i < size))
            if len(rows):
                found.append((i, 1, rows, np.full(len(rows), self.n)))
        h = np.zeros((len(words), width), np.uint64)
        wide = chars.astype(np.uint64) + np.uint64(1)
        for length in range(1, min(LONGEST_PIECE, width) + 1):
            h = h[:, :width - length + 1] * _BASE + wide[:, length - 1:]
            rows, at = np.nonzero(self.seen[h >> np.uint64(44)])
            key = h[rows, at]
            near = np.minimum(np.searchsorted(self.hashes, key), len(self.hashes) - 1)
            ok = (self.hashes[near] == key) & (at + length <= size[rows])
            rows, at, piece = rows[ok], at[ok], self.index[near[ok]]
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(width + 1))
            for i in range(width):
                part = order[cuts[i]:cuts[i + 1]]
                if len(part):
                    found.append((i, length, rows[part], piece[part]))
        found.sort(key=lambda x: x[0])
        return size, width, found


def log_words(pieces: Pieces, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """log10 probability of each word in each language: the forward pass.

    ``prob`` has a row per piece, the unknown character's last, and a column per language.
    """
    size, width, found = pieces.matches(words)
    alpha = np.zeros((width + 1, len(words), prob.shape[1]))
    alpha[0] = 1
    for i, length, rows, piece in found:
        alpha[i + length][rows] += alpha[i][rows] * prob[piece]
    return np.log10(np.maximum(alpha[size, np.arange(len(words))], 1e-300))


def _steps(pieces: Pieces, word: str) -> list[list[tuple[int, int]]]:
    """For each place of one word: length and piece of every occurrence that begins there."""
    size, _, found = pieces.matches([word])
    out: list[list[tuple[int, int]]] = [[] for _ in range(int(size[0]))]
    for i, length, _, piece in found:
        out[i].append((length, int(piece[0])))
    return out


def log_word(pieces: Pieces, prob: np.ndarray, word: str) -> np.ndarray:
    """:func:`log_words` of one word of any length: the forward values of the next places only,
    scaled as they fall."""
    ahead, scale = np.zeros((LONGEST_PIECE + 1, prob.shape[1])), np.zeros(prob.shape[1])
    ahead[0] = 1
    for i, here in enumerate(_steps(pieces, word)):
        for length, piece in here:
            ahead[length] += ahead[0] * prob[piece]
        ahead[:-1] = ahead[1:]
        ahead[-1] = 0
        if i % 8 == 7:
            top = np.maximum(ahead.max(axis=0), 1e-300)
            ahead /= top
            scale += np.log10(top)
    return np.log10(np.maximum(ahead[0], 1e-300)) + scale


def expected_counts_of(pieces: Pieces, word: str) -> np.ndarray:
    """:func:`expected_counts` of one word of any length, with logarithms."""
    steps, price = _steps(pieces, word), (math.log(1.0 / pieces.n), math.log(UNKNOWN))
    n = len(steps)
    cost = lambda piece: price[piece == pieces.n]
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0.0
    for i, here in enumerate(steps):
        for length, piece in here:
            alpha[i + length] = np.logaddexp(alpha[i + length], alpha[i] + cost(piece))
    for i in range(n - 1, -1, -1):
        for length, piece in steps[i]:
            beta[i] = np.logaddexp(beta[i], beta[i + length] + cost(piece))
    out = np.zeros(pieces.n + 1)
    for i, here in enumerate(steps):
        for length, piece in here:
            out[piece] += math.exp(alpha[i] + cost(piece) + beta[i + length] - alpha[n])
    return out[:-1]


def expected_counts(pieces: Pieces, words: list[str], times: np.ndarray) -> np.ndarray:
    """Expected occurrences of each piece when all pieces are equally likely (forward-backward)."""
    size, width, found = pieces.matches(words)
    n, p = len(words), 1.0 / pieces.n
    alpha, beta = np.zeros((width + 1, n)), np.zeros((width + 1, n))
    alpha[0], beta[size, np.arange(n)] = 1, 1
    price = lambda piece: np.where(piece == pieces.n, UNKNOWN, p)
    for i, length, rows, piece in found:
        alpha[i + length][rows] += alpha[i][rows] * price(piece)
    for i, length, rows, piece in reversed(found):
        beta[i][rows] += beta[i + length][rows] * price(piece)
    scale = times / np.maximum(alpha[size, np.arange(n)], 1e-300)
    out = np.zeros(pieces.n + 1)
    for i, length, rows, piece in found:
        out += np.bincount(piece, alpha[i][rows] * price(piece) * beta[i + length][rows] * scale[rows], pieces.n + 1)
    return out[:-1]


_WORKER: dict = {}


def _pieces(names: list[str]) -> Pieces:
    key = (len(names), names[-1])
    if key not in _WORKER:
        _WORKER[key] = Pieces(names)
    return _WORKER[key]


class Block:
    """Some languages (in code point order), their log priors and their piece counts, without zeros."""

    def __init__(self, languages: list[str], prior: np.ndarray, sums: pa.Table):
        self.languages, self.prior = languages, prior
        lang = sums["lang"].combine_chunks().dictionary_encode()
        place = {x: i for i, x in enumerate(languages)}
        number = np.array([place[x] for x in lang.dictionary.to_pylist()], np.int32)
        self.lang = number[lang.indices.to_numpy()]
        self.piece, self.units = sums["piece"].to_numpy(), sums["units"].to_numpy()

    def prob(self, n: int) -> np.ndarray:
        """A row per piece, the unknown character's last, and a column per language."""
        counts = np.zeros((n, len(self.languages)))
        counts[self.piece, self.lang] = self.units / UNIT
        prob = (counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * n)
        return np.vstack([prob, np.full(prob.shape[1], UNKNOWN)])


class Model:
    """Blocks of languages in code point order, each a broadcast."""

    def __init__(self, blocks: list):
        self.blocks = blocks


def train(labelled: DataFrame, pieces: list[str]) -> Model:
    """Learn from columns ``text`` and ``lang``; rows with a null in either are left out."""
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(pieces)
    schema = "lang string, piece int, units long"
    rows = labelled.select("text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    texts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    at_once = AT_ONCE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, met, total = _pieces(shared.value), {}, {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, c in total.items():
                units = np.rint(c * UNIT).astype(np.int64)
                at = np.flatnonzero(units)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                                  pa.array(units[at])], ["lang", "piece", "units"])
            total.clear()

        def settle() -> Iterator[pa.RecordBatch]:
            for lang, c in met.items():
                if len(total) >= at_once and lang not in total:
                    yield from counted()
                names = list(c)
                for width in (8, 16, WORD):  # words of like length together
                    part = [w for w in names if width // 2 * (width > 8) < len(w) <= width]
                    for k in range(0, len(part), 20_000):
                        some = part[k:k + 20_000]
                        times = np.fromiter(map(c.__getitem__, some), np.float64, len(some))
                        total[lang] = total.get(lang, 0) + expected_counts(own, some, times)
                for w in (w for w in names if len(w) > WORD):
                    total[lang] = total.get(lang, 0) + c[w] * expected_counts_of(own, w)
            met.clear()

        for batch in slices(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                met.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, met.values())) > 200_000:
                yield from settle()
        yield from settle()
        yield from counted()

    bound_batches(spark)
    sums = rows.mapInArrow(count, schema).groupBy("lang", "piece").agg(F.sum("units").alias("units"))
    languages = sorted(texts)
    if len(languages) > at_once:
        sums = materialize(sums.repartitionByRange("lang"), "language-pieces")
    n, blocks = sum(texts.values()), []
    for k in range(0, len(languages), at_once):
        some = languages[k:k + at_once]
        # At most one row per piece and language of the block reaches the driver at a time.
        part = sums.filter(F.col("lang").between(some[0], some[-1])) if len(languages) > at_once else sums
        blocks.append(spark.sparkContext.broadcast(
            Block(some, np.log10(np.array([texts[x] for x in some]) / n), part.toArrow())))
    return Model(blocks)


class Scorer:
    """Word scores of one block remembered in a worker, forgotten when they are too many."""

    def __init__(self, names: list[str], block: Block):
        self.pieces, self.prior = _pieces(names), block.prior
        self.prob = block.prob(len(names))
        self.row: dict[str, int] = {}
        self.score = np.zeros((0, len(block.prior)))

    def totals(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text of words: the best language's place and log10 score, and the sum of all relative to it."""
        width = len(self.prior)
        if len(self.row) > REMEMBERED // width:
            self.row, self.score = {}, self.score[:0]
        met = {w for c in cut for w in c} - self.row.keys()
        # Long words are not remembered.
        long = {w: log_word(self.pieces, self.prob, w) for w in met if len(w) > WORD}
        new = sorted(met - long.keys(), key=len)
        step = min(20_000, max(1, SCORED // width))
        parts = [log_words(self.pieces, self.prob, new[k:k + step]) for k in range(0, len(new), step)]
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
        self.score = np.vstack([self.score, *parts])
        best, top, mass = np.zeros(len(cut), np.int64), np.full(len(cut), -np.inf), np.zeros(len(cut))
        for k, c in enumerate(cut):
            if c:
                short = [w for w in c if w not in long] if long else c
                total = self.score[np.fromiter(map(self.row.__getitem__, short), np.int64, len(short))].sum(axis=0) + self.prior
                for w in c if len(short) < len(c) else ():
                    if w in long:
                        total = total + long[w]
                e = 10.0 ** np.maximum(total - total.max(), -300)
                best[k], top[k], mass[k] = e.argmax(), total.max(), e.sum()
        return best, top, mass


class Reader:
    """Predictions of a worker. A single block stays in memory; of several, one at a time does."""

    def __init__(self, names: list[str], model: Model):
        self.names, self.blocks = names, model.blocks
        self.only = Scorer(names, self.blocks[0].value) if len(self.blocks) == 1 else None

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior per text."""
        cut = [words_of(t) for t in texts]
        name, top, mass = ["und"] * len(cut), np.full(len(cut), -np.inf), np.zeros(len(cut))
        known = np.array([bool(c) for c in cut], bool) & bool(self.blocks)
        for shared in self.blocks:
            block = shared.value
            best, high, more = (self.only or Scorer(self.names, block)).totals(cut)
            if self.only is None:
                vars(shared).pop("_value", None)  # the next use reads it again from the executor's disk
            both = np.where(known, np.maximum(top, high), 0.0)
            mass = mass * 10.0 ** np.maximum(top - both, -300) + more * 10.0 ** np.maximum(high - both, -300)
            for k in np.flatnonzero(known & (high > top)).tolist():
                name[k] = block.languages[best[k]]
            top = np.maximum(top, high)
        return name, np.divide(1.0, mass, out=np.zeros(len(cut)), where=known)


def predict(docs: DataFrame, pieces: list[str], model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the posterior, 0 to 1).

    Only the text is read for the prediction. A text that is null or has no letters, and every
    text if nothing was learned, gets ``und`` and 0. Equal posteriors: the language first by code
    point. Rows are independent; an empty table gives none. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pieces)
    source = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value, model)
        for part in slices(batches):
            name, score = reader.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(name, pa.string()), pa.array(score)],
                                             [*part.schema.names, "lang_pred", "score"])

    bound_batches(spark)
    return source.mapInArrow(run, T.StructType([
        *source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text (null: empty)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)) == fold


def identify(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``; learns from two of three documents."""
    pieces = read_pieces(vocabulary)
    marked = docs.drop("held_out").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    model = train(marked.filter(~F.col("held_out")), pieces)
    return predict(marked, pieces, model)
