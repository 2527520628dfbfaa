"""Removal of repeated byte strings by a distributed, anchored suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a smaller doc_id,
or earlier in the same document. Sorting all suffixes would move every text a hundredfold, so
suffixes are anchored: among the grams (``GRAM`` bytes, hashed) of each ``LENGTH``-byte window the
smallest, leftmost of equal ones, is the window's leading token. Equal windows have equal tokens at
equal offsets, so only suffixes with the same token need to meet, and neighbouring windows that
share one token (at its place) travel as one run.

1. Every run becomes (token, BLAKE2b digest of its bytes, doc_id, place). Splitters sampled from
   some documents range-partition these by leading token; buckets are sorted locally. Runs equal to
   an earlier one are repeats; neighbouring buckets are compared at their boundary, so a hot token
   or text may span any number of buckets.
2. Where one token leads runs of different texts, the windows of each text's first run get a longer
   token: they are parted by the offset of the token into two, and the windows of a part share
   ``LONG_GRAM`` bytes around it. Only parts that share these as well go on.
3. Their bytes are fetched and dealt out by the longer token, and each bucket sorts the windows by
   multikey quicksort (a word of eight bytes at a time, only ties going on to the next word).
   Windows equal in all bytes form a group; all but the first are repeats. A longer token that
   more than ``HOT`` runs share (the edge of a passage in very many documents) would make a bucket
   without bound: its windows go through step 1 one by one instead, where equal ones may span
   buckets.

Hashes of tokens only bring candidates together. What is removed was found equal by its bytes
(step 3) or by the 128-bit BLAKE2b digest of all its bytes (step 1), which no known way of writing
texts can make collide.

The texts travel compressed. Texts shorter than ``LENGTH`` bytes have no windows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, give_back, materialize, slices

LENGTH = 100
GRAM = 32
#: Grams of a window, so the most windows that share a token at one place.
RUN = LENGTH - GRAM + 1
#: Windows of a run are parted in two at this offset of the token; then all windows of a part share
#: this many bytes.
PART = (RUN + 1) // 2
LONG_GRAM = LENGTH - PART + 1
#: Runs of one longer token that are sorted in one bucket; first runs of a token that are held back.
HOT = 4096
#: Runs of a bucket, on average, and the most buckets.
BUCKET_RUNS = 500_000
MOST_BUCKETS = 1 << 14
#: Splitters come from this many documents on average, and at most this many of their runs.
SAMPLE_DOCS = 4096
SAMPLE_RUNS = 1 << 18
#: Bytes of text hashed at once (some 60 bytes of arrays for each), and windows sorted at once.
SLICE = 1 << 18
WINDOWS = 1 << 18
#: Parts over which the runs of a token with very many texts are spread.
SPREAD = 256
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                               0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_UPPER = np.uint64(0xFFFFFFFF00000000)


def _words(data: bytes, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from every place on as an integer; ``data`` ends with 8 spare bytes."""
    return np.ndarray((len(data) - 8,), kind, data, strides=(1,))


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _ODD[4]
    h ^= h >> np.uint64(29)
    return h


def _gram_hashes(data: bytes, n: int) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each of the first ``n`` places; ``data`` is padded."""
    w = _words(data)
    half = w[:n + 16] * _ODD[0]
    half ^= half >> np.uint64(31)
    half += w[8:n + 24] * _ODD[1]
    half ^= half >> np.uint64(29)
    half *= _ODD[2]
    half ^= half >> np.uint64(32)
    return _mix(half[:n] * _ODD[3] + half[16:n + 16])


def _anchors(h: np.ndarray, n: int) -> np.ndarray:
    """Place of the leading token of the window from each of ``n`` places on: the gram with the
    smallest upper half of its hash, the leftmost of equal ones."""
    m = (h & _UPPER) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= RUN:
        np.minimum(m[:-span], m[span:], out=m[:-span])
        span *= 2
    rest = RUN - span
    return (np.minimum(m[:n], m[rest:n + rest]) & ~_UPPER).astype(np.int64)


def _runs(token: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of one token over consecutive places, at most ``RUN`` long."""
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (place[1:] != place[:-1] + 1)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(token)))
    if len(size) and size.max() > RUN:
        parts = -(-size // RUN)
        owner = np.repeat(np.arange(len(start)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, size = start[owner] + nth * RUN, np.minimum(size[owner] - nth * RUN, RUN)
    return start, size


def _pack(start: np.ndarray, size: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Start, windows and the text's tag in one long that sorts by start."""
    return (start.astype(np.int64) << 32) | (size.astype(np.int64) << 24) | tag


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 32, (place >> 24) & 0x7F, place & 0xFFFFFF


#: In a packed place: the run's token leads very many texts, or may go on in another bucket.
WIDE = 0x80 << 24


def _digests(data: bytes, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """128 bits of BLAKE2b of some pieces of ``data``, as two longs."""
    blake = hashlib.blake2b
    raw = b"".join([blake(data[x:y], digest_size=16).digest() for x, y in zip(begin.tolist(), end.tolist(), strict=True)])
    both = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return [both[:, 0], both[:, 1]]


def _anchored(texts: list[bytes], docs: np.ndarray, tags: np.ndarray):
    """The runs of some documents: token, digest (two longs), doc, place."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    n = int(end[-1]) if len(end) else 0
    if n < LENGTH:
        return None
    data = b"".join(texts) + bytes(2 * LENGTH)
    h = _gram_hashes(data, n + RUN)
    owner = np.repeat(np.arange(len(texts)), size)
    at = np.flatnonzero(np.arange(n) + LENGTH <= end[owner])
    if not len(at):
        return None
    # Consecutive places of one document only: a document's last places have no window.
    anchor = _anchors(h, n)[at]
    start, count = _runs(anchor, at)
    first = at[start]
    doc = owner[first]
    return (h[anchor[start]].view(np.int64), *_digests(data, first, first + count + LENGTH - 1), docs[doc],
            _pack(first - (end - size)[doc], count, tags[doc]))


def _identity(docs: DataFrame) -> list[Column]:
    """doc (the id, null as the smallest long) and tag (24 bits of the text's checksum): rows that
    share a doc_id but not the text are told apart by it."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
            F.crc32(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit(0xFFFFFF).cast("long")).alias("tag")]


_RUN = "token long, text long, more long, doc long, place long"
_ORDER = ["token", "text", "more", "doc", "place"]


def _anchored_runs(docs: DataFrame, cuts: list[np.ndarray] | None = None) -> DataFrame:
    """The runs of all documents, and the bucket of each if ``cuts`` are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            found = _anchored(texts, part.column("doc").to_numpy(), part.column("tag").to_numpy())
            if found is not None:
                yield _dealt(found, cuts)

    return docs.select(*_identity(docs), "text").mapInArrow(run, _RUN + (", bucket int" if cuts is not None else ""))


def _dealt(runs, cuts: list[np.ndarray] | None) -> pa.RecordBatch:
    cols = [pa.array(np.ascontiguousarray(x)) for x in runs]
    if cuts is None:
        return pa.RecordBatch.from_arrays(cols, _ORDER)
    return pa.RecordBatch.from_arrays([*cols, pa.array(bucket_of(cuts, list(runs)[:len(cuts)]), pa.int32())], [*_ORDER, "bucket"])


def bucket_of(cuts: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """Number of the splitters that aren't above each row. Splitters and rows are columns, compared
    in turn; the splitters are sorted."""
    lo, hi = (np.searchsorted(cuts[0], rows[0], side) for side in ("left", "right"))
    if len(cuts) == 1:
        return hi
    out, tied = lo.copy(), np.flatnonzero(hi > lo)
    for x in np.unique(lo[tied]):
        at = tied[lo[tied] == x]
        y = hi[at[0]]
        out[at] += bucket_of([c[x:y] for c in cuts[1:]], [r[at] for r in rows[1:]])
    return out


def _splitters(runs: DataFrame, share: float) -> list[np.ndarray]:
    """Splitters (token, digest, doc) for even buckets, from the runs of a share of the documents.

    They only balance the buckets: the result is the same for any. The driver gets at most
    ``SAMPLE_RUNS`` runs, those with the smallest hashes.
    """
    some = materialize(runs.select(*_ORDER), "suffix-sample")
    buckets = min(MOST_BUCKETS, max(1, math.ceil(some.count() / share / BUCKET_RUNS)))
    got = some.orderBy(F.xxhash64("doc", "place")).limit(SAMPLE_RUNS).select(*_ORDER[:4]).toArrow()
    cols = [got.column(c).to_numpy() for c in _ORDER[:4]]
    order = np.lexsort(cols[::-1])
    at = order[np.arange(1, buckets) * len(order) // buckets] if len(order) else order
    return [c[at] for c in cols]


def _compared(runs: DataFrame, cuts: list[np.ndarray], name: str) -> DataFrame:
    """Runs with their bucket, sorted within buckets and compared with their neighbours."""
    dealt = runs.repartitionById(len(cuts[0]) + 1, "bucket").sortWithinPartitions(*_ORDER)
    return materialize(dealt.select(*_ORDER).mapInArrow(_compare, f"kind int, {_RUN}, task int"), name, "zstd")


def _repeats(found: DataFrame) -> DataFrame:
    """doc and place of the repeats in the buckets and at their boundaries."""
    return found.filter(F.col("kind") == REPEAT).select("doc", "place").union(_boundary(found).select("doc", "place"))


#: Kinds of rows that a bucket gives: a repeat, a first run among texts of one token, its ends.
REPEAT, FIRST, HEAD, TAIL = range(4)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a sorted bucket: repeats, first runs of tokens with several texts, and its ends.

    A run is a repeat if a run before it has the same token and digest, and another place. Runs are
    looked at with the first run of their text, so any number of equal runs needs no memory. The
    first runs of the current token are held until it ends, or until there are more than ``HOT``;
    then, and for the bucket's first and last token, whose runs may go on in other buckets, they
    are marked ``WIDE``.
    """
    task = TaskContext.get().partitionId()
    last: list | None = None   # the run before this batch
    lead = [0, 0]              # doc and place of the first run of the latest text
    held = [np.zeros(0, np.int64)] * 3  # first runs (token, doc, place) of the latest token
    wide_token: int | None = None       # the latest token, if its runs are marked already
    head: int | None = None             # the bucket's first token

    def rows(kind, token, text, more, doc, place):
        cols = [np.broadcast_to(np.asarray(c, np.int64), np.shape(doc)) for c in (token, text, more, doc, place)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(doc), kind, np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in cols],
             pa.array(np.full(len(doc), task, np.int32))], ["kind", *_ORDER, "task"])

    def firsts(token, doc, place, wide):
        return rows(FIRST, token, 0, 0, doc, np.where(wide, place | WIDE, place))

    for b in batches:
        if not b.num_rows:
            continue
        token, text, more, doc, place = (b.column(c).to_numpy() for c in _ORDER)
        if last is None:
            head = wide_token = token[0]
            yield rows(HEAD, token[:1], text[:1], more[:1], doc[:1], place[:1])
        before = last[:3] if last is not None else [token[0] ^ 1, 0, 0]
        same = np.ones(len(token), bool)
        for c, old in zip((token, text, more), before, strict=True):
            same &= np.concatenate([[c[0] == old], c[1:] == c[:-1]])
        # The first run of each row's text: in this batch (number from 0), or the one held (-1).
        of = np.maximum.accumulate(np.where(same, -1, np.arange(len(token))))
        lead_doc, lead_place = (np.where(of < 0, old, c[np.maximum(of, 0)]) for c, old in ((doc, lead[0]), (place, lead[1])))
        again = same & ((doc != lead_doc) | (place >> 32 != lead_place >> 32))
        if again.any():
            yield rows(REPEAT, 0, 0, 0, doc[again], place[again])
        at = np.flatnonzero(~same)
        if len(at):
            lead = [doc[at[-1]], place[at[-1]]]
            t, d, p = (np.concatenate([h, c[at]]) for h, c in zip(held, (token, doc, place), strict=True))
            new = np.ones(len(t), bool)
            new[1:] = t[1:] != t[:-1]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(t)))
            several, many = np.repeat(size > 1, size), np.repeat(size > HOT, size)
            wide = many | (t == wide_token)
            open_ = (t == t[-1]) & ~wide  # the last token may go on in the next batch
            out = (several | wide) & ~open_
            if out.any():
                yield firsts(t[out], d[out], p[out], wide[out])
            held = [c[open_] for c in (t, d, p)]
            wide_token = t[-1] if wide[-1] else None
        last = [c[-1] for c in (token, text, more, doc, place)]
    if last is not None:
        if len(held[0]):
            yield firsts(*held, True)
        yield rows(TAIL, *[np.array([x]) for x in last])
    give_back()


def _boundary(found: DataFrame) -> DataFrame:
    """Heads that repeat the bucket before: one row per bucket's end meets in one task."""
    ends = found.filter(F.col("kind") >= HEAD)
    w = Window.orderBy("task", "kind")
    before = ends.withColumn("_b", F.lag(F.struct(*_ORDER)).over(w))
    moved = (F.col("doc") != F.col("_b.doc")) | (F.shiftright("place", 32) != F.shiftright("_b.place", 32))
    alike = [F.col(c) == F.col(f"_b.{c}") for c in _ORDER[:3]]
    return before.filter((F.col("kind") == HEAD) & alike[0] & alike[1] & alike[2] & moved)


def _compressed(docs: DataFrame, *columns: str) -> DataFrame:
    """doc, tag and the whole text as compressed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for part in slices(batches, limit=SLICE):
            z = [press.compress((t or "").encode()) for t in part.column("text").to_pylist()]
            rest = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(z, pa.binary())], [*rest, "z"])

    chosen = docs.select(*columns, *_identity(docs), "text")
    schema = T.StructType([*[f for f in chosen.schema.fields if f.name != "text"], T.StructField("z", T.BinaryType())])
    return chosen.mapInArrow(run, schema)


def _with_texts(docs: DataFrame, runs: DataFrame, step, schema: str) -> DataFrame:
    """``step`` over the texts of ``docs`` and their ``runs`` (doc, key, place).

    ``step(data, begin, count, key, doc, start, tag)`` gets the texts of some documents in a row
    and of each of their runs its place in them, windows, key, doc, place in the document and tag.
    The runs of a document are bounded by its length.
    """
    wanted = (runs.groupBy("doc", F.col("place").bitwiseAND(F.lit(0xFFFFFF).cast("long")).alias("tag"))
              .agg(F.collect_list("key").alias("keys"), F.collect_list("place").alias("places")))
    pairs = _compressed(docs).join(wanted, ["doc", "tag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()

        def some(part):
            texts, cols, at = [], [[] for _ in range(6)], 0
            for z, doc, tag, keys, places in part:
                place, first = np.unique(places, return_index=True)
                start, count, _ = _unpack(place)
                texts.append(open_.decompress(z))
                one = np.ones(len(place), np.int64)
                for c, x in zip(cols, (start + at, count, keys[first], one * doc, place, one * tag), strict=True):
                    c.append(x)
                at += len(texts[-1])
            return step(b"".join(texts) + bytes(2 * LENGTH), at, *map(np.concatenate, cols))

        for b in batches:
            part, size = [], 0
            lists = [b.column(c) for c in ("keys", "places")]
            ends = [x.offsets.to_numpy() for x in lists]
            flat = [x.values.to_numpy() for x in lists]
            for i, (z, doc, tag) in enumerate(zip(*(b.column(c).to_pylist() for c in ("z", "doc", "tag")), strict=True)):
                part.append((z, doc, tag, *[f[e[i]:e[i + 1]] for f, e in zip(flat, ends, strict=True)]))
                size += 4 * len(z)
                if size > SLICE:
                    yield some(part)
                    part, size = [], 0
            if part:
                yield some(part)
        give_back()

    return pairs.select("z", "doc", "tag", "keys", "places").mapInArrow(run, schema)


def _long_tokens(data, n, begin, count, key, doc, place, tag) -> pa.RecordBatch:
    """The runs' windows as parts of at most ``PART`` windows, under a longer token each.

    In a window with its token at offset o, the ``LONG_GRAM`` bytes from o (o < PART) or from
    o - PART on are there, and they are the same for all windows of the part.
    """
    h = _gram_hashes(data, n + RUN)
    anchor = _anchors(h, n)[begin]
    high = anchor - begin              # the token's offset in the first window, falling by one
    low = high - count + 1
    parts = []
    for nth, lo, hi in ((1, np.maximum(low, PART), high), (0, low, np.minimum(high, PART - 1))):
        r = np.flatnonzero(lo <= hi)
        at = anchor[r] - PART * nth
        second = _mix(h[at] * _ODD[1] + h[at + GRAM] * _ODD[2] + h[at + LONG_GRAM - GRAM] * _ODD[5] + np.uint64(nth))
        start = (place[r] >> 32) + high[r] - hi[r]
        parts.append((second.view(np.int64), doc[r], _pack(start, (hi - lo)[r] + 1, tag[r]) | (place[r] & WIDE)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["key", "doc", "place"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by key, those whose key another run has, and all marked ``WIDE``."""
    held, like_before = None, False  # the last row met, and whether the one before it has its key
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        key, place = b.column("key").to_numpy(), b.column("place").to_numpy()
        same = key[1:] == key[:-1]
        left = np.concatenate([[like_before], same])
        keep = left | np.append(same, False) | (place & WIDE != 0)
        yield b.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
        held, like_before = b.slice(len(key) - 1), bool(left[-1])
    if held is not None and (like_before or held.column("place")[0].as_py() & WIDE):
        yield held
    give_back()


def _single_windows(cuts: list[np.ndarray] | None):
    """Each window of the runs by itself, under the digest of its bytes."""

    def step(data, n, begin, count, key, doc, place, tag) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(begin)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[owner] + nth
        start = (place[owner] >> 32) + nth
        return _dealt((key[owner], *_digests(data, at, at + LENGTH), doc[owner],
                       _pack(start, np.ones(len(at), np.int64), tag[owner])), cuts)

    return step


def _run_bytes(data, n, begin, count, key, doc, place, tag) -> pa.RecordBatch:
    """The runs with the bytes of their windows."""
    stop = begin + count + LENGTH - 1
    raw = [data[x:y] for x, y in zip(begin.tolist(), stop.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(place), pa.array(raw, pa.binary())],
                                      ["key", "doc", "place", "bytes"])


def multikey_order(words: list, key: np.ndarray) -> np.ndarray:
    """Class of each suffix: equal keys and equal words, eight bytes at a time.

    Suffixes are sorted by key, then by their first word; only those still tied with a neighbour
    are sorted by the next word. ``words[k]`` gives the k-th word of chosen suffixes.
    """
    n = len(key)
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    for word in words:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        value = word(order[at])
        by = np.lexsort((value, group))
        order[at] = order[at][by]
        group, value = group[by], value[by]
        change = np.ones(len(at), bool)
        change[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        new[at] = change
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(new)
    return out


#: Places of a window's words, from both ends to the middle: the middle is where windows that share a
#: longer token are alike.
_WORD_ORDER = sorted({*range(0, LENGTH - 7, 8), LENGTH - 8}, key=lambda x: -abs(2 * x + 8 - LENGTH))


def _sort_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among the windows of a bucket sorted by key (groups of a key are complete)."""

    def repeats(parts):
        key, doc, place, size = (np.concatenate([p[k] for p in parts]) for k in range(4))
        begin = np.cumsum(size) - size
        data = b"".join([x for p in parts for x in p[4]]) + bytes(16)
        start, count, tag = _unpack(place)
        owner = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at, big = begin[owner] + nth, _words(data)
        cls = multikey_order([lambda some, s=s: big[at[some] + s] for s in _WORD_ORDER], key[owner])
        where, whose = start[owner] + nth, doc[owner]
        order = np.lexsort((where, whose, cls))
        first = np.ones(len(order), bool)
        first[1:] = cls[order][1:] != cls[order][:-1]
        # The same place may be listed more than once; it doesn't repeat itself.
        lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        again = np.zeros(len(order), bool)
        again[order] = (whose[order] != whose[lead]) | (where[order] != where[lead])
        hit = np.flatnonzero(again)
        s, n = _runs(owner[hit], hit)
        h = hit[s]
        out = [whose[h], _pack(where[h], n, tag[owner[h]])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["doc", "place"])

    def piece(b, x, y):
        """Rows x to y: key, doc, place, sizes and the bytes."""
        raw = b.column("bytes")
        ends = raw.buffers()[1]
        ends = np.frombuffer(ends, np.int32)[raw.offset:raw.offset + len(raw) + 1]
        whole = raw.buffers()[2]
        return (*(b.column(c).to_numpy()[x:y] for c in ("key", "doc", "place")), np.diff(ends[x:y + 1]).astype(np.int64),
                [whole.slice(int(ends[x]), int(ends[y] - ends[x])).to_pybytes() if y > x else b""])

    kept, windows = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("key").to_numpy()
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        if kept and kept[-1][0][-1] != key[0] and windows > WINDOWS:
            yield repeats(kept)
            kept, windows = [], 0
        begin = 0
        total = np.cumsum(_unpack(b.column("place").to_numpy())[1])
        for c in cut.tolist():
            if windows + total[c - 1] - (total[begin - 1] if begin else 0) > WINDOWS:
                yield repeats([*kept, piece(b, begin, c)])
                kept, windows, begin = [], 0, c
        kept.append(piece(b, begin, len(key)))
        windows += int(total[-1] - (total[begin - 1] if begin else 0))
    if kept:
        yield repeats(kept)
    give_back()


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc, tag and spans (start, end) of all windows of ``docs`` that start earlier as well."""
    bound_batches(docs.sparkSession)
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    some = F.pmod(F.xxhash64(*_identity(docs)), F.lit(1 << 20)) < int(share * (1 << 20))
    cuts = _splitters(_anchored_runs(docs.filter(some)), share)
    found = _compared(_anchored_runs(docs, cuts), cuts, "suffix-runs")
    marks = _repeats(found)
    firsts = found.filter(F.col("kind") == FIRST).select("doc", F.col("token").alias("key"), "place")
    runs = _with_texts(docs, firsts, _long_tokens, "key long, doc long, place long")
    # The texts of a wide token are not compared here but counted below, so they needn't meet.
    spread = F.when(F.col("place").bitwiseAND(F.lit(WIDE).cast("long")) != 0,
                    F.pmod(F.xxhash64("doc", "place"), F.lit(SPREAD))).otherwise(F.lit(0))
    met = runs.repartition("key", spread).sortWithinPartitions("key").mapInArrow(_shared, runs.schema)
    runs = materialize(met, "suffix-shared", "zstd")
    hot = materialize(runs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("key"), "suffix-hot")
    if not hot.isEmpty():
        wide = materialize(runs.join(hot, "key", "left_semi"), "suffix-wide", "zstd")
        sample = wide.filter(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < int(share * (1 << 20)))
        cuts = _splitters(_with_texts(docs, sample, _single_windows(None), _RUN), share)
        single = _with_texts(docs, wide, _single_windows(cuts), _RUN + ", bucket int")
        marks = marks.union(_repeats(_compared(single, cuts, "suffix-windows")))
        runs = runs.join(hot, "key", "left_anti")
    windows = _with_texts(docs, runs, _run_bytes, "key long, doc long, place long, bytes binary")
    more = windows.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_windows, "doc long, place long")
    # Written, so that the windows' bytes are gone before the texts are shuffled for the cut.
    more = materialize(more, "suffix-repeats", "zstd")
    start = F.shiftright("place", 32)
    return (marks.union(more)
            .select("doc", F.col("place").bitwiseAND(F.lit(0xFFFFFF).cast("long")).alias("tag"),
                    start.cast("int").alias("start"),
                    (start + F.shiftright("place", 24).bitwiseAND(F.lit(127).cast("long")) + LENGTH - 1).cast("int").alias("end")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with n_bytes, n_removed, n_spans and ``kept`` (binary).

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a smaller doc_id,
    or earlier in the same document. All strings are those of the input; overlaps count; strings
    never span documents. Null texts count as empty. A null doc_id comes before all others. Rows
    that repeat a doc_id are the same document: a string is no repeat of itself at the same start.
    Empty table: no rows. Columns of these names are replaced.
    """
    bound_batches(docs.sparkSession)
    names = ("n_bytes", "n_removed", "n_spans", "kept", "doc", "tag", "z")
    columns = [c for c in docs.columns if c not in (*names, "text")]
    spans = repeated_spans(docs).groupBy("doc", "tag").agg(
        F.collect_list("start").alias("_starts"), F.collect_list("end").alias("_ends"))
    rows = _compressed(docs, *columns).join(spans, ["doc", "tag"], "left").drop("doc", "tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            at, size = 0, 0
            z = b.column("z").to_pylist()
            for k, x in enumerate(z):
                size += 4 * len(x)
                if size > SLICE or k == len(z) - 1:
                    yield _cut(b.slice(at, k + 1 - at), open_)
                    at, size = k + 1, 0
        give_back()

    def _cut(part, open_):
        texts = [open_.decompress(x) for x in part.column("z").to_pylist()]
        kept, removed, spans_ = [], [], []
        for text, s, e in zip(texts, part.column("_starts").to_pylist(), part.column("_ends").to_pylist(), strict=True):
            if not s:
                kept.append(text), removed.append(0), spans_.append(0)
                continue
            step = np.zeros(len(text) + 1, np.int64)
            np.add.at(step, s, 1)
            np.add.at(step, e, -1)
            gone = np.cumsum(step[:-1]) > 0
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            removed.append(int(gone.sum()))
            spans_.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
        return pa.RecordBatch.from_arrays(
            [*[part.column(c) for c in columns], pa.array([len(t) for t in texts], pa.int64()),
             pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()), pa.array(kept, pa.binary())],
            [*columns, *names[:4]])

    schema = T.StructType([*[docs.schema[c] for c in columns],
                           *[T.StructField(n, T.LongType()) for n in names[:3]], T.StructField("kept", T.BinaryType())])
    return rows.select(*columns, "z", "_starts", "_ends").mapInArrow(run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeats cut out of ``text`` (and ``n_chars``, if there, counted anew).

    A character that lost some of its bytes goes as a whole. Rows and other columns are kept; a
    null text stays null.
    """
    was = docs.withColumn("_q_null", F.col("text").isNull())
    cut = remove_repeats(was)
    shape = T.StructType([T.StructField("text", T.StringType()) if f.name == "kept" else f for f in cut.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [None if no else x.decode("utf-8", "ignore") for x, no in
                    zip(b.column("kept").to_pylist(), b.column("_q_null").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string())], shape.names)

    out = cut.mapInArrow(run, shape)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
