"""Byte-level BPE encoding and decoding with batched segment trees.

A pre-token starts as its single bytes. A segment tree over the byte positions holds, in each
leaf, the rank of the pair that starts there (none: infinity) and, in each inner node, the
smallest rank below with the leftmost place it occurs at. The root names the next merge; the
merge kills the right neighbour and changes the pairs of two live positions at most, so three
leaves and their paths to the root are written anew. Pre-tokens of one width class are merged side
by side, one merge of each per step, as rows of numpy arrays.

Nodes hold ``rank * width + position`` in one integer: the smaller rank wins, then the smaller
position, so the plain minimum is the leftmost minimum.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches, list_array, slices
from .units import Memory

NONE = np.iinfo(np.int64).max
#: Leaves of all trees that are merged side by side.
LEAVES = 1 << 18
#: Bytes of text that are encoded and decoded together.
PART_BYTES = 1 << 20


class Ranks:
    """A rank file as arrays: the id of each byte, and the rank of each pair that merges."""

    def __init__(self, raw: bytes):
        self.of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.token = {i: t for t, i in self.of.items()}
        self.byte = np.array([self.of[bytes([i])] for i in range(256)], np.int64)
        left, right, rank = [], [], []
        for t, r in self.of.items():
            for cut in range(1, len(t)):
                a, b = self.of.get(t[:cut]), self.of.get(t[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.base = max(self.of.values()) + 1
        keys = np.array(left, np.int64) * self.base + np.array(right, np.int64)
        order = np.argsort(keys)
        self.pairs, self.ranks = keys[order], np.array(rank, np.int64)[order]

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); -1 where they don't merge."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as bytes of int32."""
        out: list = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.of.get(p)
            if whole is not None:
                out[k] = np.int32(whole).tobytes()
            elif not p:
                out[k] = b""
            else:
                classes.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(k)
        for width, which in classes.items():
            some = max(1, LEAVES // width)
            for at in range(0, len(which), some):
                part = which[at:at + some]
                for k, ids in zip(part, self._merge([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        live = np.arange(width) < size[:, None]
        sym = np.zeros((n, width), np.int64)
        sym[live] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        nxt = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()  # width and more: none
        nxt[np.arange(n), size - 1] = width
        prv = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        rank = self.lookup(sym[:, :-1], sym[:, 1:])
        tree[:, width:2 * width - 1] = np.where((rank >= 0) & live[:, 1:], rank * width + np.arange(width - 1), NONE)
        half = width
        while half > 1:
            half //= 2
            tree[:, half:2 * half] = np.minimum(tree[:, 2 * half:4 * half:2], tree[:, 2 * half + 1:4 * half:2])
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            best = tree[rows, 1]
            at = best % width
            gone = nxt[rows, at]
            after = nxt[rows, gone]
            sym[rows, at] = best // width
            live[rows, gone] = False
            nxt[rows, at] = after
            has = after < width
            prv[rows[has], after[has]] = at[has]
            self._set(tree, rows, gone, np.full(len(rows), NONE), width)
            # The pair that starts here, and the one of the live neighbour to the left.
            value = np.full(len(rows), NONE)
            r = self.lookup(sym[rows[has], at[has]], sym[rows[has], after[has]])
            value[has] = np.where(r >= 0, r * width + at[has], NONE)
            self._set(tree, rows, at, value, width)
            before = prv[rows, at]
            has = before >= 0
            some, before = rows[has], before[has]
            r = self.lookup(sym[some, before], sym[some, at[has]])
            self._set(tree, some, before, np.where(r >= 0, r * width + before, NONE), width)
            rows = rows[tree[rows, 1] != NONE]
        ids, count = sym[live].astype(np.int32).tobytes(), 4 * live.sum(axis=1)
        ends = np.cumsum(count).tolist()
        return [ids[e - c:e] for e, c in zip(ends, count.tolist(), strict=True)]

    @staticmethod
    def _set(tree, rows, at, value, width) -> None:
        """Point update: the leaf, then the nodes above it."""
        node = at + width
        tree[rows, node] = value
        while width > 1:
            width //= 2
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


#: White space as the pre-tokenizer's library reads it; the other engine's class holds more.
WHITE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORKER: dict[tuple, tuple] = {}


def _worker(raw: bytes, pattern: str) -> tuple[Ranks, Memory]:
    """The ranks, kept from task to task, and a new memory of units: what a task remembers goes
    with it, so workers that serve other operators next start small."""
    key = (hash(raw), pattern)
    if key not in _WORKER:
        import regex

        spelled = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        _WORKER[key] = Ranks(raw), regex.compile(spelled).findall
    ranks, find = _WORKER[key]
    known: dict[str, bytes] = {}

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) > 100_000:
            known.clear()
        cut = [find(t) for t in texts]
        new = list({p for c in cut for p in c} - known.keys())
        known.update(zip(new, ranks.encode_pieces([p.encode() for p in new]), strict=True))
        return [b"".join([known[p] for p in c]) for c in cut]

    return ranks, Memory(encode)


def read_ranks(path: str) -> bytes:
    """The rank file, read once on the driver: a public vocabulary of fixed size, about 1 MB."""
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, ranks: bytes, pattern: str, column: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``decoded`` (binary, the ids decoded again).

    Matches of ``pattern`` are encoded separately, without special tokens; ``decoded`` is made
    from the ids alone. A null text counts as empty: no ids, no bytes. Rows are independent of
    each other, repeated ones included; an empty table gives none. Columns named ids or decoded
    are replaced, other columns are kept.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    source = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = _worker(shared.value, pattern)
        for part in slices(batches, column, PART_BYTES):
            raw = memory.encode_texts([t or "" for t in part.column(column).to_pylist()])
            flat = np.frombuffer(b"".join(raw), np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])])
            ids = list_array(flat, offsets, pa.int32())
            decoded = [own.decode(np.frombuffer(x, np.int32).tolist()) for x in raw]
            yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(decoded, pa.binary())],
                                             [*part.schema.names, "ids", "decoded"])

    bound_batches(spark)
    schema = T.StructType([*source.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.BinaryType())])
    return source.mapInArrow(run, schema)
