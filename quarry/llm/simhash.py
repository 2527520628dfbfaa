"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: 64 bits, each the majority over the XXH64 hashes of a text's word shingles.

Index: the 64 bits are cut into blocks. Two fingerprints that differ in at most ``bits`` bits agree
on all but ``bits`` blocks, so on the bits of some choice of blocks. The upper nodes of the index
are these masked bit patterns (choice of blocks, value): each holds the fingerprints that share the
pattern, in Gray order, and is a group that Spark shuffles by. Below a pattern, runs of
``LEAF`` neighbours in Gray order form nodes that keep the bits all their members share; the bits
in which a query differs from a node's shared bits are a lower bound for all members, and nodes
beyond the limit are skipped whole. Small patterns are compared within their run directly.

Equal fingerprints are one node from the start, and a pattern with many linked fingerprints gives a
spanning forest, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize, slices
from .components import components

SEED = 42
LEAF = 64
#: Patterns up to this size are compared pair by pair.
SMALL = 24
_SPREAD = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], np.uint64)


def fingerprint(text: str | None, words: int = 4) -> int:
    """The fingerprint of one text; 0 for a text without words.

    A-Z is lowered, words are runs without white space (ASCII), shingles repeat as they occur; a
    text with fewer words than a shingle is one shingle.
    """
    import xxhash

    parts = text.encode().lower().split() if text else []
    if not parts:
        return 0
    whole, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(whole, SEED)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    total = np.zeros(64, np.int64)
    n = len(parts) - words + 1
    for at in range(0, n, 65_280):  # 256 sums of 255
        to = min(n, at + 65_280)
        h = np.array([digest(whole[a:b], SEED) for a, b in
                      zip(starts[at:to].tolist(), ends[at + words - 1:to + words - 1].tolist(), strict=True)], np.uint64)
        lanes = _SPREAD[h.view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = np.array([fingerprint(t, words) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def masks(n: int, bits: int) -> list[int]:
    """Masks one of which any two codes at ``bits`` or fewer differing bits agree on.

    Blocks are added until ``n`` random codes would leave patterns of few members; every choice
    is exact, more masks are copies traded against comparisons.
    """
    for blocks in range(bits + 1, 33):
        kept = blocks - bits
        if n / 2 ** (64 * kept / blocks) <= 1 or math.comb(blocks, bits) > 100:
            break
    edge = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    return [sum(c) for c in combinations(block, kept)]


class GrayNodes:
    """The nodes below one pattern: members in Gray order and the bits each run of them shares."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes))]
        at = np.arange(0, len(codes), LEAF)
        ones, any_ = np.bitwise_and.reduceat(self.codes, at), np.bitwise_or.reduceat(self.codes, at)
        self.pattern, self.shared = ones, ones | ~any_
        up = np.arange(0, len(at), LEAF)
        ones, any_ = np.bitwise_and.reduceat(ones, up), np.bitwise_or.reduceat(any_, up)
        self.upper, self.upper_shared = ones, ones | ~any_
        self.live = np.ones(len(codes), bool)

    def near(self, query: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Live members within ``bits`` of any query, and the place of such a query."""
        least = lambda p, m: (np.bitwise_count((query[:, None] ^ p) & m) <= bits).any(axis=0)
        upper = np.flatnonzero(least(self.upper, self.upper_shared))
        leaves = (upper[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaves = leaves[leaves < len(self.pattern)]
        leaves = leaves[least(self.pattern[leaves], self.shared[leaves])]
        at = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.codes)]
        at = at[self.live[at]]
        hit = np.bitwise_count(query[:, None] ^ self.codes[at]) <= bits
        some = hit.any(axis=0)
        return at[some], hit[:, some].argmax(axis=0)

    def forest(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Edges that connect exactly what links of ``bits`` or fewer differing bits connect."""
        for seed in range(len(self.codes)):
            if not self.live[seed]:
                continue
            self.live[seed] = False
            front = self.codes[seed:seed + 1]
            while len(front):
                query, front = front[:128], front[128:]
                at, by = self.near(query, bits)
                if len(at):
                    self.live[at] = False
                    yield query[by], self.codes[at]
                    front = np.concatenate([front, self.codes[at]])


def _links(group: np.ndarray, codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within groups of equal ``group`` (which are contiguous)."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([start, [len(group)]]))
    left, right = [], []
    big = np.repeat(size > SMALL, size)
    small, own = codes[~big], group[~big]
    for k in range(1, min(SMALL, len(small))):
        ok = (own[k:] == own[:-k]) & (np.bitwise_count(small[k:] ^ small[:-k]) <= bits)
        left.append(small[:-k][ok]), right.append(small[k:][ok])
    for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        for a, b in GrayNodes(codes[s:s + n]).forest(bits):
            left.append(a), right.append(b)
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.uint64)
    return join(left), join(right)


def link_edges(codes: DataFrame, bits: int) -> DataFrame:
    """Edges (u, v) between distinct codes ``fp`` that connect what links of ``bits`` connect."""
    spark = codes.sparkSession
    choice = masks(codes.count(), bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in choice]
    nodes = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("pattern"))
                      for i, m in enumerate(signed)])
    upper = codes.select("fp", F.inline(nodes)).repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []

        def done(parts):
            mask, pattern, fp = (np.concatenate([p[k] for p in parts]) for k in range(3))
            new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])])
            u, v = _links(np.cumsum(new), fp.view(np.uint64), bits)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for b in batches:
            now = tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "pattern", "fp"))
            if not len(now[0]):
                continue
            # Groups that end in this batch are complete; the last one may go on in the next.
            change = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = change[-1] + 1 if len(change) else 0
            if cut == 0 and kept and (kept[-1][0][-1], kept[-1][1][-1]) != (now[0][0], now[1][0]):
                yield done(kept)
                kept = []
            if cut:
                yield done([*kept, tuple(x[:cut] for x in now)])
                kept = []
            kept.append(tuple(x[cut:] for x in now))
        if kept:
            yield done(kept)

    bound_batches(spark)
    return upper.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fp (long), root (the component's smallest fp) and component_id of every row.

    Two documents are linked if their fingerprints differ in at most ``bits`` bits;
    ``component_id`` is the smallest doc_id reachable over links, the document's own included.
    Null and empty texts have fingerprint 0 and link like any other; rows may repeat; a null
    doc_id is linked but never the smallest (null if a component has no other). Empty table: no
    rows. Only doc_id and text are read.
    """
    prints = materialize(fingerprints(docs, words), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    label = components(link_edges(classes.select("fp"), bits))
    rooted = (classes.join(label.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    rooted = materialize(rooted, "fingerprint-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def keep_first(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """``docs`` without near-duplicates: one row of each component, columns unchanged.

    It is a row whose doc_id is the component's smallest; of several, the one with the smallest
    fingerprint. A component without any doc_id keeps one row as well.
    """
    found = near_duplicates(docs, words, bits)
    keep = (found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root")
            .agg(F.min(F.struct("doc_id", "fp")).alias("k"))
            .select(_key(F.col("k.doc_id")).alias("_q_key"), F.col("k.fp").alias("_q_fp")))
    shape = T.StructType([*docs.schema.fields, T.StructField("_q_fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = np.array([fingerprint(t, words) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp.view(np.int64))], [*part.schema.names, "_q_fp"])

    bound_batches(docs.sparkSession)
    marked = docs.mapInArrow(run, shape).withColumn("_q_key", _key(F.col("doc_id").cast("long")))
    return marked.join(keep, ["_q_key", "_q_fp"]).dropDuplicates(["_q_key", "_q_fp"]).select(*docs.columns)


def _key(doc_id: Column) -> Column:
    """A key without nulls, so that null ids meet in an ordinary join."""
    return F.struct(doc_id.isNull().alias("no"), F.coalesce(doc_id, F.lit(0)).alias("id"))
