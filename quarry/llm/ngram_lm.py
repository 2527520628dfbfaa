"""Language-model scores from sharded Elias-Fano n-gram tries.

The model is an interpolated trigram model with absolute discounting over a smoothed unigram:
P(w | v) = max(c(v, w) - D, 0) / c(v) + D n(v) / c(v) P(w), n(v) the distinct successors of v, and
P(w | u, v) the same over c(u, v, w), c(u, v), n(u, v) and P(w | v).

1. A first pass adds up what each word brings to its shard. The most frequent words, at most
   ``COMMON`` of them, get numbers that all tasks know. A word that brings more than ``HOT_ENTRIES``
   is split into pieces, which are words of their own to the shards: by the word before it for
   trigrams, by the word after it for bigrams. The trigrams of a word and the word before it that
   bring more than that together are split by the word after both, as bigrams of pieces of the two.
2. Map tasks cut documents into chunks and send each shard, for the chunk's words v of that shard,
   the words u before them and the words w after both, with training counts: a tree v, u, w.
3. A shard owns a range of word hashes. It sums the counts and builds its trie: for each word the
   words after it (bigrams) and before it (contexts), for each context the words after it, written
   by their place among the bigrams of v, so that numbers are small. Each level is a list of lists in
   Elias-Fano code with monotone pointers; quantised probabilities and back-off weights lie beside.
   The shard answers each chunk with the entries it asked for, by successor search within the
   pointers' range.
4. Each chunk, which is kept as compact word numbers in buckets, scores its documents where it lies.

Chunks don't send a row to every shard: words go to at most ``FAN`` ranges of hashes at a time. If
there are more shards, relays in between take the rows of a range in batches and cut each batch into
rows for the narrower ranges, and put the answers together on the way back. A chunk's rows don't
grow with the corpus, so all rows together grow like it.

Collected and sent to all tasks are the common and the hot words and pairs only, of the latter at most
one each for ``HOT_ENTRIES`` tokens of the corpus; what the shards gather are the counts of the whole corpus.
"""

from __future__ import annotations

import math
import mmap
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import bound_batches, give_back, materialize, materialize_by, slices
from .elias_fano import Lists

#: Tokens of a chunk and bytes of text behind a shard. Both bound the memory of a task.
CHUNK_TOKENS = 1 << 20
SHARD_BYTES = 6 << 20
#: Trigram entries, over all chunks, of one word or pair (or piece of one) that a shard may have to hold.
HOT_ENTRIES = 1 << 18
#: Words with numbers of their own, and how often a word is there at least to be looked at.
COMMON = 65_000
SEEN = 16
#: Ranges of hashes that a chunk's words, or a relay's batch of rows, go to at a time. Relays write and
#: shuffle all rows once more: up to so many shards (12 GB of text) the chunks do without.
FAN = 2048
#: Rows and trigram entries of a relay's batch, whichever is reached first. Rows: as many as it may send
#: on. Entries: more than a chunk's, so that relays don't multiply rows, and what a relay's task holds.
RELAY_ROWS = FAN
RELAY_ENTRIES = 2 * CHUNK_TOKENS
DISCOUNT = 0.75
#: log10 probabilities are stored in steps of 1 / STEPS, rounded down; code 0 is "not there".
STEPS = 4096
#: Words beside a word are told apart by 40 bits of their hash (common ones by number), words v by 64.
SHORT_BITS = 40
_RARE = 0xFFFF
_BINARY = "abcdefghij"
_ROW = "target long, kind int, chunk long, part long, " + ", ".join(f"{c} binary" for c in _BINARY)
STREAM, ASK, ANSWER = 0, 1, 2


def _codes(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        steps = np.ceil(-np.log10(p) * STEPS - 1e-6)
    return np.where(p > 0, np.minimum(steps, 65_534) + 1, 0).astype(np.uint16)


def _probabilities(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (-(codes.astype(np.float64) - 1) / STEPS), 0.0)


def _back_off(distinct: np.ndarray, total: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return _codes(np.where(total > 0, DISCOUNT * distinct / total, 1.0))


def _in_map(array: np.ndarray) -> np.ndarray:
    """A copy in an anonymous memory map."""
    m = mmap.mmap(-1, max(1, array.nbytes))
    m.write(array.tobytes())
    return np.frombuffer(m, array.dtype, len(array))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two numbers below 2^31 as one that sorts by both."""
    out = a.astype(np.int64)
    out <<= 32
    out |= b
    return out


def _halves(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of some pairs, four bytes each."""
    return (pairs >> 32).astype(np.int32), pairs.astype(np.int32)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's place among them, four bytes each."""
    found, at = np.unique(values, return_inverse=True)
    return found, at.astype(np.int32)


class Trie:
    """One shard's levels.

    ``words`` to ``after`` (bigrams): the numbers of the words after each word, with the codes of
    their discounted probabilities. ``before`` (contexts): the numbers of the words before it, with
    back-off codes. ``third`` (trigrams): for each context the words after both, by their place in the
    word's list of ``after``.
    """

    def __init__(self, n_words: int, v: np.ndarray, u: np.ndarray, w: np.ndarray, count: np.ndarray, whole: np.ndarray):
        """Trigrams (word number, number before, number after; distinct) with training counts.
        ``whole`` is a word's count where it is a piece of one, else -1."""
        pairs, at = _distinct(_pair(v, w))
        times = np.bincount(at, count, len(pairs))
        pv, pw = _halves(pairs)
        del pairs
        self.distinct = np.bincount(pv, minlength=n_words)
        total = np.bincount(pv, times, n_words)
        total = np.where(whole >= 0, whole, total)
        self.after = Lists(self.distinct, pw)
        self.after_code = _in_map(_codes((times - DISCOUNT) / total[pv] if len(pv) else np.zeros(0)))
        del times, pv, pw
        self.back_off = _in_map(_back_off(self.distinct, total))
        contexts, of = _distinct(_pair(v, u))
        cv, cu = _halves(contexts)
        self.before = Lists(np.bincount(cv, minlength=n_words), cu)
        n = len(contexts)
        del contexts, cv, cu
        # The place of w among the bigrams of v is small and tells it apart in the context's list.
        rank = (at - (np.cumsum(self.distinct) - self.distinct)[v]).astype(np.int32)
        del at
        order = np.argsort(_pair(of, rank)).astype(np.int32)
        sizes = np.bincount(of, minlength=n)
        total = np.bincount(of, count, n)
        self.third = Lists(sizes, rank[order])
        self.third_code = _in_map(_codes(((count - DISCOUNT) / total[of])[order] if len(of) else np.zeros(0)))
        self.context_back_off = _in_map(_back_off(sizes, total))

    def contexts(self, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context number (-1: unseen) and back-off code of (word before, word) pairs."""
        at, _ = self.before.find(v, u)
        code = self.context_back_off[np.maximum(at, 0)] if len(self.context_back_off) else np.zeros(len(at), np.uint16)
        return at, np.where(at >= 0, code, _codes(np.ones(1))[0]).astype(np.uint16)

    def codes(self, v: np.ndarray, w: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bigram and trigram codes of words after (context, word) pairs; 0 if unseen."""
        second, third = np.zeros(len(v), np.uint16), np.zeros(len(v), np.uint16)
        at, begin = self.after.find(v, w)
        seen = np.flatnonzero(at >= 0)
        second[seen] = self.after_code[at[seen]]
        seen = seen[context[seen] >= 0]
        place, _ = self.third.find(context[seen], (at - begin)[seen])
        third[seen[place >= 0]] = self.third_code[place[place >= 0]]
        return second, third


_press, _open = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _put(array: np.ndarray | None) -> bytes | None:
    """Compressed. Of longer numbers all first bytes stand before all second ones: these are alike."""
    if array is None:
        return None
    array = np.ascontiguousarray(array).ravel()
    if array.itemsize > 2:
        array = array.view(np.uint8).reshape(-1, array.itemsize).T
    return _press.compress(array.tobytes())


def _get(raw: bytes | None, kind) -> np.ndarray:
    if raw is None:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    if size <= 2:
        return np.frombuffer(_open.decompress(raw), kind)
    return np.ascontiguousarray(np.frombuffer(_open.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _row(target, kind, chunk, part, *parts) -> tuple:
    return (target, kind, chunk, part, *map(_put, parts), *[None] * (len(_BINARY) - len(parts)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * len(_BINARY)]
    names = ["target", "kind", "chunk", "part", *_BINARY]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _put_short(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of common words as 16 bits each; the others' 40 bits beside, in two parts."""
    rare = ids >= _RARE
    rest = ids[rare] - _RARE
    return np.where(rare, _RARE, ids).astype(np.uint16), rest.astype(np.uint32), (rest >> 32).astype(np.uint8)


def _get_short(few: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    ids = few.astype(np.int64)
    ids[few == _RARE] = (low.astype(np.int64) | (high.astype(np.int64) << 32)) + _RARE
    return ids


@dataclass
class Ask:
    """What is asked of a range of words: the tree v, u, w with counts, words in the order of hashes.

    ``pieces``: how many of the words each chunk in it has, in turn."""

    vocab: np.ndarray     # hash of each word v
    seen: np.ndarray      # how often it is a token of training
    whole: np.ndarray     # of a piece: the whole word's count as a context, else -1
    n_before: np.ndarray  # words u before each v
    n_after: np.ndarray   # words w after each (u, v)
    before: np.ndarray    # u of each context
    after: np.ndarray     # w of each trigram
    count: np.ndarray     # in training
    pieces: np.ndarray

    def put(self) -> tuple:
        few, low, high = _put_short(np.concatenate([self.before, self.after]))
        n = len(self.before)
        few[:n] = np.diff(few[:n], prepend=np.uint16(0))
        whole = self.whole if (self.whole >= 0).any() else None
        # Hashes in order are close together: the steps between them are shorter.
        steps = np.diff(self.vocab, prepend=np.uint64(0)) if len(self.pieces) == 1 else self.vocab
        return (steps, self.seen.astype(np.uint32), whole, self.n_before.astype(np.uint32), self.n_after.astype(np.uint32),
                few, low, high, self.count.astype(np.uint32), self.pieces.astype(np.int64))

    @classmethod
    def get(cls, row: dict) -> Ask:
        vocab, n_after, pieces = _get(row["a"], np.uint64), _get(row["e"], np.uint32).astype(np.int64), _get(row["j"], np.int64)
        if len(pieces) == 1:
            vocab = np.cumsum(vocab, dtype=np.uint64)
        few, n_before = _get(row["f"], np.uint16), _get(row["d"], np.uint32).astype(np.int64)
        few = few.copy()
        few[:len(n_after)] = np.cumsum(few[:len(n_after)], dtype=np.uint16)
        short = _get_short(few, _get(row["g"], np.uint32), _get(row["h"], np.uint8))
        whole = _get(row["c"], np.int64) if row["c"] is not None else np.full(len(vocab), -1)
        return cls(vocab, _get(row["b"], np.uint32).astype(np.int64), whole, n_before, n_after,
                   short[:len(n_after)], short[len(n_after):], _get(row["i"], np.uint32).astype(np.int64), pieces)

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's contexts, and each context's trigrams, begin and the last ones end."""
        return _starts(self.n_before), _starts(self.n_after)

    def sizes(self) -> np.ndarray:
        """Words, contexts and trigrams of each piece."""
        c_at, t_at = self.starts()
        edges = _starts(self.pieces)
        return np.stack([np.diff(edges), np.diff(c_at[edges]), np.diff(t_at[c_at[edges]])], axis=1)

    def part(self, x: int, y: int, starts) -> Ask:
        """The words x to y, as one piece."""
        c, t = starts
        a, b = c[x], c[y]
        return Ask(self.vocab[x:y], self.seen[x:y], self.whole[x:y], self.n_before[x:y], self.n_after[a:b], self.before[a:b],
                   self.after[t[a]:t[b]], self.count[t[a]:t[b]], np.array([y - x]))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _joined(asks: list[Ask]) -> Ask:
    return Ask(*[np.concatenate([getattr(a, f.name) for a in asks]) for f in fields(Ask)])


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range, of so many equal ones, that a hash falls to."""
    return (((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def tokenize(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """A partition's documents in chunks: word hashes, tokens, sizes, flags and ids."""
    import xxhash

    hash64 = xxhash.xxh64_intdigest

    def fresh():
        names = defaultdict()
        names.default_factory = names.__len__
        for own in (b" start", b" end"):  # no word holds a space
            names[own]  # noqa: B018
        return names, [], [], []

    def close():
        return (np.fromiter((hash64(w) for w in names), np.uint64, len(names)), np.concatenate(texts).astype(np.int64),
                np.array([len(t) for t in texts], np.int64), np.array(flags, np.uint8), np.array(ids, np.int64))

    names, texts, flags, ids = fresh()
    size = 0
    for batch in slices(batches):
        for doc, held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
            words = tokenize(text)
            texts.append(np.fromiter((*map(names.__getitem__, words), 1), np.uint32, len(words) + 1))
            flags.append(int(held) | 2 * (doc is None))
            ids.append(doc or 0)
            size += len(words) + 1
            if size >= CHUNK_TOKENS:
                yield close()
                names, texts, flags, ids = fresh()
                size = 0
    if texts:
        yield close()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a partition's documents into chunks: ids, flags, sizes, word numbers and words. Frequent
    words get small numbers, so most tokens take two bytes."""
    part = TaskContext.get().partitionId()
    for n, (vocab, tokens, sizes, flag, ids) in enumerate(_cut(batches)):
        chunk = (part << 24) | n
        order = np.argsort(-np.bincount(tokens, minlength=len(vocab))[2:], kind="stable") + 2
        new = np.empty(len(vocab), np.int64)
        new[:2], new[order] = (0, 1), np.arange(2, len(vocab))
        few, low, _ = _put_short(new[tokens])
        yield _batch([_row(chunk, STREAM, chunk, -1, ids, flag, sizes.astype(np.int32), few, low,
                           np.concatenate([vocab[:2], vocab[order]]))])
    give_back()


def _chunk(row: dict) -> tuple:
    """Words, tokens, sizes, flags and ids of a chunk."""
    low = _get(row["e"], np.uint32)
    tokens = _get_short(_get(row["d"], np.uint16), low, np.zeros(len(low), np.uint8))
    return (_get(row["f"], np.uint64), tokens, _get(row["c"], np.int32).astype(np.int64), _get(row["b"], np.uint8),
            _get(row["a"], np.int64))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for row in b.to_pylist():
            yield row["chunk"], _chunk(row)


def _befores(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that (number 0 before a text's start)."""
    first = np.cumsum(sizes) - sizes
    v = np.concatenate([[0], tokens[:-1]])
    v[first] = 0
    u = np.concatenate([[0], v[:-1]])
    u[first] = 0
    return u, v


def _tree(u: np.ndarray, v: np.ndarray, w: np.ndarray):
    """Distinct (v, u) and (v, u, w) in that order: contexts (v, u), trigrams (context, w), and each
    token's context and trigram."""
    contexts, c = _distinct(_pair(v, u))
    trigrams, t = _distinct(_pair(c, w))
    return contexts, trigrams, c, t


_LOAD = "word long, contexts long, times long, seen long, train long"


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk and word: how often it stands before a token (no more trigrams are sent for it), how
    often so in training, and how often it is a token, and a token of training."""
    for _, (vocab, tokens, sizes, flag, _) in _read(batches):
        _, v = _befores(tokens, sizes)
        train = np.repeat(flag & 1 == 0, sizes)
        n = len(vocab)
        cols = [np.bincount(v, minlength=n), np.bincount(v, train, n), np.bincount(tokens, minlength=n), np.bincount(tokens, train, n)]
        yield pa.RecordBatch.from_arrays([pa.array(vocab.view(np.int64)), *[pa.array(c.astype(np.int64)) for c in cols]],
                                         ["word", "contexts", "times", "seen", "train"])
    give_back()


@dataclass
class Known:
    """What all tasks know: hot words by hash, with pieces and training count as a context; the common
    words' hashes in order, and their numbers; tokens and distinct words of training; and as the hot
    words, by the hashes of both, hot pairs of a word before and a word."""

    hot: dict[int, tuple[int, int]]
    common: tuple[np.ndarray, np.ndarray]
    tokens: int
    distinct: int
    pairs: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)


_PAIRS = "before long, word long, contexts long, times long"


def _pair_load(batches: Iterator[pa.RecordBatch], hot: list[int]) -> Iterator[pa.RecordBatch]:
    """Per chunk and pair of hot words: how often they stand before a token, and how often so in
    training. A pair that is hot consists of hot words."""
    hot = np.sort(np.array(hot, np.uint64))
    for _, (vocab, tokens, sizes, flag, _) in _read(batches):
        place = np.minimum(np.searchsorted(hot, vocab), len(hot) - 1)
        number = np.where(hot[place] == vocab, place, -1).astype(np.int32)
        u, v = (number[x] for x in _befores(tokens, sizes))
        both = np.flatnonzero((u >= 0) & (v >= 0))
        pairs, at = _distinct(_pair(u[both], v[both]))
        train = np.repeat(flag & 1 == 0, sizes)[both]
        cols = [*(hot[x].view(np.int64) for x in _halves(pairs)),
                *(np.bincount(at, x, len(pairs)).astype(np.int64) for x in (None, train))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["before", "word", "contexts", "times"])
    give_back()


def special_words(chunks: DataFrame) -> Known:
    sums = [F.sum(c).alias(c) for c in ("contexts", "times", "seen", "train")]
    totals = Observation()
    words = chunks.mapInArrow(_load, _LOAD).groupBy("word").agg(*sums).observe(
        totals, F.sum("train").alias("tokens"), F.count_if(F.col("train") > 0).alias("distinct"))
    words = materialize(words.filter((F.col("seen") >= SEEN) | (F.col("contexts") > HOT_ENTRIES)), "lm-words")
    hot = {r["word"] % (1 << 64): (-(-r["contexts"] // HOT_ENTRIES), r["times"])
           for r in words.filter(F.col("contexts") > HOT_ENTRIES).collect()}
    common = words.orderBy(F.desc("seen"), "word").limit(COMMON).select("word").toArrow().column("word").to_numpy().view(np.uint64)
    spark, order = chunks.sparkSession, np.argsort(common)
    pairs = {}
    if hot:
        names = list(hot)
        both = chunks.mapInArrow(lambda b: _pair_load(b, names), _PAIRS).groupBy("before", "word").agg(
            F.sum("contexts").alias("contexts"), F.sum("times").alias("times")).filter(F.col("contexts") > HOT_ENTRIES)
        pairs = {(r["before"] % (1 << 64), r["word"] % (1 << 64)): (-(-r["contexts"] // HOT_ENTRIES), r["times"]) for r in both.collect()}
        del both
    del words
    spark.sparkContext._jvm.System.gc()  # the counts' shuffle is not needed any more, see materialize
    return Known(hot, (order.astype(np.int64), common[order]), int(totals.get["tokens"] or 0), int(totals.get["distinct"] or 0), pairs)


def _piece_hash(word: int, kind: str, nth: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{word} {kind} {nth}")


def _ask(vocab: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, flag: np.ndarray, known: Known):
    """A chunk's question, and how its tokens find their answers.

    Returns the Ask (words by hash), and per token its place in the answers: word of the token, word
    before (its back-off), context, trigram for the trigram code, and trigram for the bigram code; for
    hot words before a token, which of the chunk's hot words, else -1, with their answers' places; and
    the same for hot pairs, whose trigrams are bigrams of the pair's pieces.
    """
    train = np.repeat(flag & 1 == 0, sizes)
    u, v = _befores(tokens, sizes)
    n = len(vocab)
    hot, (number, common) = known.hot, known.common
    short = (vocab >> np.uint64(64 - SHORT_BITS)).astype(np.int64) + _RARE
    if len(common):
        rank = np.minimum(np.searchsorted(common, vocab), len(common) - 1)
        short = np.where(common[rank] == vocab, number[rank], short)
    mine = np.flatnonzero(np.isin(vocab, np.fromiter(hot, np.uint64, len(hot))))
    pieces, names, whole = np.zeros(n, np.int64), [vocab], [np.full(n, -1)]
    first_u, first_w = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = n
    for i in mine.tolist():
        k, times = hot[int(vocab[i])]
        pieces[i], first_u[i], first_w[i] = k, at, at + k
        names.append(np.array([_piece_hash(int(vocab[i]), kind, j) for kind in "uw" for j in range(k)], np.uint64))
        whole += [np.full(k, -1), np.full(k, times)]
        at += 2 * k
    names, whole = np.concatenate(names), np.concatenate(whole)
    # A hot word's trigrams go by the word before it, its bigrams by the word after it, under words
    # of their own; the latter have one context, number 0, that is none.
    spread = (vocab >> np.uint64(20)) & np.uint64(0x7FFFFFFF)
    split = pieces[v] > 0
    owner = np.where(split, first_u[v] + (spread[u].astype(np.int64) * pieces[v] >> 31), v)
    again = np.flatnonzero(split)
    owner2 = first_w[v[again]] + (spread[tokens[again]].astype(np.int64) * pieces[v[again]] >> 31)
    of_pair, pairs = _hot_pairs(vocab, u, v, again, mine, known)
    if pairs:
        # So do a hot pair's trigrams: by the word after both, under words of the pair's own.
        size = np.array([k for _, _, k, _ in pairs])
        first_p = len(names) + np.cumsum(size) - size
        names = np.concatenate([names, np.array([_piece_hash(b, f"after {a}", j) for a, b, k, _ in pairs for j in range(k)], np.uint64)])
        whole = np.concatenate([whole, np.repeat([times for *_, times in pairs], size)])
        there = np.flatnonzero(of_pair >= 0)
        which = of_pair[there]
        owner[there] = first_p[which] + (spread[tokens[there]].astype(np.int64) * size[which] >> 31)
        u = u.copy()
        u[there] = 0
    contexts, trigrams, c, t = _tree(np.concatenate([u, np.zeros(len(again), np.int64)]), np.concatenate([owner, owner2]),
                                     np.concatenate([tokens, tokens[again]]))
    count = np.bincount(t, np.concatenate([train, train[again]]), len(trigrams)).astype(np.int64)
    # From the order of the chunk's numbers to that of hashes.
    order = np.argsort(names, kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    rank = np.empty(n, np.int64)  # a word's contexts by the numbers sent: the steps between them are small
    rank[np.argsort(short, kind="stable")] = np.arange(n)
    by = np.argsort(_pair(place[contexts >> 32], rank[contexts & 0xFFFFFFFF]))
    c_place = np.empty(len(contexts), np.int64)
    c_place[by] = np.arange(len(contexts))
    t_by = np.argsort(c_place[trigrams >> 32], kind="stable")
    t_place = np.empty(len(trigrams), np.int64)
    t_place[t_by] = np.arange(len(trigrams))
    n_before = np.bincount(place[contexts >> 32], minlength=len(names))
    n_after = np.bincount(c_place[trigrams >> 32], minlength=len(contexts))
    seen = np.zeros(len(names), np.int64)
    seen[:n] = np.bincount(tokens, train, n)
    ask = Ask(names[order], seen[order], whole[order], n_before, n_after, short[(contexts & 0xFFFFFFFF)[by]],
              short[(trigrams & 0xFFFFFFFF)[t_by]], count[t_by], np.array([len(names)]))
    second = t_place[t[:len(tokens)]]
    second[again] = t_place[t[len(tokens):]]
    groups = [(place[first_w[i]:first_w[i] + pieces[i]], hot[int(vocab[i])][1]) for i in mine.tolist()]
    which = np.full(n, -1)
    which[mine] = np.arange(len(mine))
    both = [(place[first_p[i]:first_p[i] + k], times) for i, (_, _, k, times) in enumerate(pairs)]
    return (ask, (place[tokens], place[v], c_place[c[:len(tokens)]], t_place[t[:len(tokens)]], second), (which[v], groups),
            (of_pair, both))


def _hot_pairs(vocab: np.ndarray, u: np.ndarray, v: np.ndarray, split: np.ndarray, hot: np.ndarray, known: Known):
    """Which of the chunk's hot pairs stands before each token, else -1 (``split``: the tokens after hot
    words, ``hot``: these words); and the pairs: hashes, pieces, training count."""
    of_pair = np.full(len(u), -1)
    number = {int(vocab[i]): i for i in hot.tolist()}
    here = sorted((number[b] << 32 | number[a], a, b, *x) for (a, b), x in known.pairs.items() if a in number and b in number)
    if not here:
        return of_pair, []
    codes, asked = np.array([x[0] for x in here]), _pair(v[split], u[split])
    at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
    met = codes[at] == asked
    found, which = _distinct(at[met])
    of_pair[split[met]] = which
    return of_pair, [here[i][1:] for i in found.tolist()]


def _asks(batches: Iterator[pa.RecordBatch], ranges: int, known: Known) -> Iterator[pa.RecordBatch]:
    """A partition's chunks as asks: a row per chunk and range of words."""
    for chunk, (vocab, tokens, sizes, flag, _) in _read(batches):
        ask = _ask(vocab, tokens, sizes, flag, known)[0]
        cut, starts, rows = np.searchsorted(_range_of(ask.vocab, ranges), np.arange(ranges + 1)), ask.starts(), []
        for r in range(ranges):
            if cut[r] < cut[r + 1]:
                rows.append(_row(r, ASK, chunk, r, *ask.part(cut[r], cut[r + 1], starts).put()))
            if len(rows) == 64:
                yield _batch(rows)
                rows = []
        yield _batch(rows)
    give_back()


def _relay(batches: Iterator[pa.RecordBatch], finer: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Asks of one range in batches, each cut for the ``finer`` ranges within it (of ``ranges`` in
    all). Gives the rows onward, and for each batch a row that says where its answers go back to."""
    task, n = TaskContext.get().partitionId(), 0

    def send(heads: list[tuple[int, int]], whole: list[Ask]):
        nonlocal n
        batch, n = (1 << 62) | (task << 32) | n, n + 1
        # A row from another relay holds pieces of several chunks, each in the order of hashes.
        asks = []
        for a in whole:
            edges, at = _starts(a.pieces).tolist(), a.starts()
            asks += [a.part(x, y, at) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        cuts = [_range_of(a.vocab, ranges) for a in asks]
        first = (int(next(c for c in cuts if len(c))[0]) // finer) * finer
        edges = [np.searchsorted(c, np.arange(first, first + finer + 1)) for c in cuts]
        starts = [a.starts() for a in asks]
        rows = [_row(batch, STREAM, batch, -1, np.array(heads),
                     np.array([len(a.pieces) for a in whole]))]
        for k in range(finer):
            parts = [a.part(e[k], e[k + 1], s) for a, e, s in zip(asks, edges, starts, strict=True)]
            if sum(len(p.vocab) for p in parts):
                rows.append(_row(first + k, ASK, batch, first + k, *_joined(parts).put()))
            if len(rows) == 64:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    heads, held, entries, target = [], [], 0, None
    for b in batches:
        for r in b.to_pylist():
            if held and (r["target"] != target or len(held) == RELAY_ROWS or entries >= RELAY_ENTRIES):
                yield from send(heads, held)
                heads, held, entries = [], [], 0
            target = r["target"]
            heads.append((r["chunk"], r["part"]))
            held.append(Ask.get(r))
            entries += len(held[-1].after)
    if held:
        yield from send(heads, held)
    give_back()


def _back(group: pa.Table) -> pa.Table:
    """A relay's batch of answers as answers for the rows that were asked."""
    rows = group.sort_by([("kind", "ascending"), ("part", "ascending")]).to_pylist()
    to = _get(rows[0]["a"], np.int64).reshape(-1, 2)
    answers = [Answer.get(r) for r in rows[1:]]
    cuts = [a.cut() for a in answers]
    out, k = [], 0
    for (chunk, part), n in zip(to.tolist(), _get(rows[0]["b"], np.int64).tolist(), strict=True):
        pieces = [_answers([a.part(i, c) for a, c in zip(answers, cuts, strict=True)]) for i in range(k, k + n)]
        out.append(_row(chunk, ANSWER, chunk, part, *_side_by_side(pieces).put()))
        k += n
    return pa.Table.from_batches([_batch(out)])


@dataclass
class Answer:
    """Answers in the order asked: per word its count, back-off code and, if it is a piece of one,
    distinct successors, per context a back-off code, per trigram the codes of both orders. The sizes
    tell whose they are."""

    seen: np.ndarray
    back: np.ndarray
    distinct: np.ndarray
    context: np.ndarray
    second: np.ndarray
    third: np.ndarray
    pieces: np.ndarray   # words, contexts and trigrams of each piece

    def put(self) -> tuple:
        return (self.seen, self.back, self.distinct, self.context, self.second, self.third, self.pieces)

    @classmethod
    def get(cls, row: dict) -> Answer:
        kinds = (np.int64, np.uint16, np.int64, np.uint16, np.uint16, np.uint16, np.int64)
        got = [_get(row[c], k) for c, k in zip("abcdefg", kinds, strict=True)]
        got[6] = got[6].reshape(-1, 3)
        return cls(*got)

    def cut(self) -> np.ndarray:
        return np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(self.pieces, axis=0)])

    def part(self, i: int, cut: np.ndarray) -> Answer:
        (a, b, c), (x, y, z) = cut[i].tolist(), cut[i + 1].tolist()
        return Answer(self.seen[a:x], self.back[a:x], self.distinct[a:x], self.context[b:y], self.second[c:z], self.third[c:z],
                      self.pieces[i:i + 1])


def _side_by_side(parts: list[Answer]) -> Answer:
    return Answer(*[np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Answer)])


def _answers(parts: list[Answer]) -> Answer:
    """Answers put in a row, as one piece."""
    whole = _side_by_side(parts)
    whole.pieces = whole.pieces.sum(axis=0, keepdims=True)
    return whole


def _answer(group: pa.Table) -> pa.Table:
    """One shard: sum the counts, build its trie, answer every row."""
    heads, asks = [], []
    for r in group.sort_by([("chunk", "ascending")]).to_pylist():
        asks.append(Ask.get(r))
        heads.append((r["chunk"], r["part"], asks[-1].sizes()))
    whole = _joined(asks)
    # A shard's arrays are let go as soon as what is made of them is there.
    del asks, r
    known, number = _distinct(whole.vocab)
    seen = np.bincount(number, whole.seen, len(known)).astype(np.int64)
    of_word = np.full(len(known), -1)
    of_word[number] = np.maximum(of_word[number], whole.whole)
    n = len(whole.before)
    ids = _distinct(np.concatenate([whole.before, whole.after]))[1]
    whole.vocab = whole.before = whole.after = None
    contexts, c = _distinct(_pair(np.repeat(number, whole.n_before), ids[:n]))
    keys, t = _distinct(_pair(np.repeat(c, whole.n_after), ids[n:]))
    del ids
    count = np.bincount(t, whole.count, len(keys))
    whole = None
    cv, cu = _halves(contexts)
    kc, kw = _halves(keys)
    del contexts, keys
    there = count > 0
    tc = kc[there]
    trie = Trie(len(known), cv[tc], cu[tc], kw[there], count[there], of_word)
    del count, there, tc
    place, context_code = trie.contexts(cv, cu)
    second, third = trie.codes(cv[kc], kw, place[kc])
    distinct = np.where(of_word >= 0, trie.distinct, 0)
    answer = Answer(seen[number], trie.back_off[number], distinct[number], context_code[c], second[t], third[t], None)
    del cv, cu, kc, kw, place, trie, number, c, t
    out, w0, c0, t0 = [], 0, 0, 0
    for chunk, part, pieces in heads:
        words, befores, afters = pieces.sum(axis=0).tolist()
        w1, c1, t1 = w0 + words, c0 + befores, t0 + afters
        mine = Answer(answer.seen[w0:w1], answer.back[w0:w1], answer.distinct[w0:w1], answer.context[c0:c1], answer.second[t0:t1],
                      answer.third[t0:t1], pieces)
        out.append(_row(chunk, ANSWER, chunk, part, *mine.put()))
        w0, c0, t0 = w1, c1, t1
    return pa.Table.from_batches([_batch(out)])


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def _score(group: pa.Table, known: Known) -> pa.Table:
    """One chunk with its answers: its documents' scores."""
    rows = group.sort_by([("kind", "ascending"), ("part", "ascending")]).to_pylist()
    stream, total, distinct = rows[0], known.tokens, known.distinct
    vocab, tokens, sizes, flag, ids = _chunk(stream)
    _, (word, before, context, third, second), *hot = _ask(vocab, tokens, sizes, flag, known)
    a = _answers([Answer.get(r) for r in rows[1:]])

    def own(back: np.ndarray, which: np.ndarray, groups: list) -> np.ndarray:
        """Back-off with that of hot words, or pairs, in place: their distinct successors are those of all pieces."""
        if not groups:
            return back
        theirs = np.array([_probabilities(_back_off(np.array([a.distinct[at].sum()]), np.array([times])))[0] for at, times in groups])
        return np.where(which >= 0, theirs[np.maximum(which, 0)], back)

    back = own(_probabilities(a.back)[before], *hot[0])
    seen = a.seen[word]
    single = (seen + 0.1) / (total + 0.1 * (distinct + 1))
    double = _probabilities(a.second[second]) + back * single
    triple = a.third[third]
    if hot[1][1]:
        triple = np.where(hot[1][0] >= 0, a.second[third], triple)
    p = _probabilities(triple) + own(_probabilities(a.context[context]), *hot[1]) * double
    at = np.cumsum(sizes) - sizes
    return pa.table({
        "doc_id": pa.array(ids, mask=(flag & 2) > 0),
        "held_out": pa.array((flag & 1) > 0), "n_tokens": pa.array(sizes),
        "n_known": pa.array(np.add.reduceat((seen > 0).astype(np.int64), at)),
        "train_tokens": pa.array(np.full(len(sizes), total, np.int64)),
        "base_score": pa.array(np.add.reduceat(np.log10(single), at)),
        "score": pa.array(np.add.reduceat(np.log10(p), at))})


def _levels(shards: int, fan: int) -> list[int]:
    """Ranges of hashes at each hop: each at most ``fan`` times as many as before, the last one the shards."""
    hops = max(1, math.ceil(math.log(max(shards, 2), fan) - 1e-9))
    step = math.ceil(shards ** (1 / hops))
    return [step ** (k + 1) for k in range(hops)] if hops > 1 else [shards]


def exchange(asks: DataFrame, levels: list[int]) -> DataFrame:
    """Asks of the first level's ranges -> answers, through relays and shards."""
    if len(levels) == 1:
        return asks.groupBy("target").applyInArrow(_answer, _ROW)
    finer, ranges = levels[1] // levels[0], levels[1]
    # Relays read whole batches again on the way back: they are written once.
    dealt = asks.repartition("target").sortWithinPartitions("target", "chunk")
    sent = materialize(dealt.mapInArrow(lambda b: _relay(b, finer, ranges), _ROW), "lm-relay", "none")
    answers = exchange(sent.filter(F.col("kind") == ASK), levels[1:])
    back = sent.filter(F.col("kind") == STREAM).unionByName(answers)
    return back.groupBy("target").applyInArrow(_back, _ROW)


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, held_out, text), learning from those not held out.

    Tokens are words (A-Z lowered, cut at ASCII white space) and one end per text; a null text
    counts as empty: its end is its only token. ``base_score`` is the unigram model's log10
    probability, ``score`` the model's. Rows that repeat count and are scored each; a null doc_id
    is kept. Without training documents both models are uniform. Empty table: no rows. Other
    columns are not read.
    """
    bound_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    levels = _levels(max(1, math.ceil(size / SHARD_BYTES)), FAN)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    # The texts are read once; all else works on the written chunks, which meet their answers in place.
    chunks, in_place = materialize_by(rows.mapInArrow(_chunks, _ROW), "lm-chunks", "target")
    known = docs.sparkSession.sparkContext.broadcast(special_words(chunks))
    answers = exchange(chunks.mapInArrow(lambda b: _asks(b, levels[0], known.value), _ROW), levels)
    return in_place.groupBy("target").cogroup(answers.groupBy("target")).applyInArrow(
        lambda chunk, found: _score(pa.concat_tables([chunk, found]), known.value), SCORES)
