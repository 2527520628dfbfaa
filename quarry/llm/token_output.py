"""Token ids as ORC files with row indexes and Bloom filters on document ids.

``write_tokens`` encodes documents with the ``tokenizers`` library and writes one row per
document (doc_id, ids) in ascending doc_id order: range-partitioned, so file k holds smaller ids
than file k + 1, sorted within. ORC stores the ids run-length encoded (version 2) in stripes;
each stripe carries a row index and a Bloom filter on doc_id, so a reader of few documents skips
stripes and row groups by metadata, and whole-table readers take stripes in parallel.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, list_array, materialize, slices

ORC = {
    "compression": "lz4", "orc.stripe.size": str(8 << 20), "orc.create.index": "true",
    "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}
TOKEN_FILE_SCHEMA = "doc_id long, place long, ids array<int>"

#: Bytes of text encoded at once: the more, the more often its units repeat.
BATCH_BYTES = 10 << 20
#: Units after which a generation of the memory is full (a batch's may come on top).
REMEMBERED = 250_000
#: ASCII units that are one match of the pre-tokenizer. An apostrophe may begin matches of its own.
_ONE = re.compile(rb" ?(?:[A-Za-z]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n").fullmatch
#: Units that are encoded in one call.
TOGETHER = 4000
_ENCODERS: dict = {}


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the others, in
    turn, as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def _white_space() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes that may end white space before a cut, the ones before them if not ASCII, and bytes that
    may begin white space after it. Every white space of Unicode is among them, and some others."""
    ends, second, begins = (np.zeros(256, bool) for _ in range(3))
    for c in map(chr, range(0x3001)):
        if c.isspace():
            raw = c.encode()
            begins[raw[0]] = True
            if len(raw) == 1:
                ends[raw[0]] = True
            else:
                second[raw[-2]] = True
    return ends, second, begins


_ENDS, _SECOND, _BEGINS = _white_space()
_LETTER, _DIGIT, _MARK, _LINE = 1, 2, 3, 4


def _ascii_kinds() -> np.ndarray:
    """Kinds of the bytes that are characters; 0: white space, the apostrophe, and what isn't ASCII."""
    kinds = np.zeros(256, np.uint8)
    for c in map(chr, range(33, 127)):
        if c != "'":
            kinds[ord(c)] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _MARK
    kinds[10] = _LINE
    return kinds


_KINDS = _ascii_kinds()


def _match_starts(data: np.ndarray) -> np.ndarray:
    """Places where the kind of character changes, so that a match begins whatever is around it.

    No match holds letters and digits, or either and marks, but for an apostrophe with letters behind
    it. A line's end between two such characters is a match of its own. Letters are the ASCII ones
    and U+00C0 to U+023F without the signs for times and divided by.
    """
    kind = _KINDS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
    lead = lead[~((data[lead] == 0xC3) & np.isin(data[lead + 1], (0x97, 0xB7)))]
    kind[lead] = kind[lead + 1] = _LETTER
    left, right = kind[:-1], kind[1:]
    change = np.flatnonzero((left != right) & (left > 0) & (right > 0) & (left < _LINE) & (right < _LINE)) + 1
    line = np.flatnonzero(kind[1:-1] == _LINE) + 1
    line = line[np.isin(kind[line - 1], (_LETTER, _DIGIT, _MARK)) & np.isin(kind[line + 1], (_LETTER, _DIGIT, _MARK))]
    return np.concatenate([change, line, line + 1])


def cut_units(data: np.ndarray, bounds: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where the units of some texts begin, and the end of all.

    The pre-tokenizer lets a token begin with a space and never go on over one: a space between two
    characters that aren't white space always begins a match, so what lies between two such spaces
    is encoded by itself. So it is between characters of different kinds. Some places are left out
    (next to rare non-ASCII characters), which only makes longer units. ``data`` holds the texts in a row, text i from bounds[i] to bounds[i + 1];
    texts marked in ``whole`` are one unit. Empty texts have none.
    """
    n = len(data)
    begin = np.zeros(n + 1, bool)
    if n > 2:
        space = np.flatnonzero(data[1:-1] == 32) + 1
        before, after = data[space - 1], data[space + 1]
        far = data[np.maximum(space - 2, 0)]
        solid = ~_ENDS[before] & ~((before >= 128) & _SECOND[far]) & ~_BEGINS[after]
        begin[space[solid]] = True
        # The character after a text's last space is another text's.
        last = bounds[1:-1][bounds[1:-1] > 0] - 1
        begin[last] = False
        begin[_match_starts(data)] = True
    for i in np.flatnonzero(whole):
        begin[bounds[i]:bounds[i + 1]] = False
    begin[bounds] = True
    return np.flatnonzero(begin)


class Encoder:
    """A worker's tokenizer with the units that it has met.

    Units live in two generations: a young one of ``REMEMBERED`` or more becomes the old one, and old units that are met again move back. Frequent units stay, rare ones go, and memory
    doesn't grow with the texts.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.own = Tokenizer.from_file(path)
        # The same model for matches that are cut already, one in a line.
        self.model = Tokenizer(self.own.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.added = [x.content for x in self.own.get_added_tokens_decoder().values()]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.letters = _byte_letters()
        # In a byte-level vocabulary each character of a token's name stands for one byte.
        vocab = self.own.get_vocab()
        self.size = np.ones(max(vocab.values()) + 1, np.int64)
        for name, i in vocab.items():
            self.size[i] = len(name)

    def encode(self, texts: list[bytes], named: bool) -> list[bytes]:
        """Each unit, encoded by the library by itself, as little-endian 32-bit ids. ``named``: whether
        some may name an added token."""
        out: list = [None] * len(texts)
        letters, ones, names, rows, odd = self.letters, [], [], [], []
        space, line = letters[32], letters[10]
        added = [a.encode() for a in self.added]
        for k, raw in enumerate(texts):
            if named and any(a in raw for a in added):
                odd.append(k)
            elif _ONE(raw):
                ones.append(k)
                names.append(raw.decode().replace(" ", space).replace("\n", line))
            else:
                t = raw.decode()
                body = t[1:] if t[:1] == " " else t
                if body.isalpha() and max(body) < "\u0250":
                    ones.append(k)
                    names.append(raw.decode("latin-1").translate(letters))
                elif t[:1] == " " and t[1:2].strip() and t[-1].strip():
                    rows.append(k)
                else:
                    odd.append(k)
        for k, e in zip(odd, self.own.encode_batch([texts[k].decode() for k in odd], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.int32).tobytes()
        # Many units, put in a row, are one text: units with a space before them as they are, and those
        # that are one match line by line. The bytes that each id covers tell where a unit's ids end.
        for which, tokenizer, text in (
                (rows, self.own, lambda x, y: b"".join([texts[k] for k in rows[x:y]]).decode()),
                (ones, self.model, lambda x, y: "\n".join(names[x:y]))):
            for at in range(0, len(which), TOGETHER):
                part = which[at:at + TOGETHER]
                ids = np.array(tokenizer.encode_batch_fast([text(at, at + TOGETHER)], add_special_tokens=False)[0].ids, np.int32)
                ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(texts[k]) for k in part]), "left") + 1
                raw, start = ids.tobytes(), 0
                for k, end in zip(part, (4 * ends).tolist(), strict=True):
                    out[k] = raw[start:end]
                    start = end
        return out

    def units(self, met: list[bytes], times: np.ndarray, named: bool) -> list[bytes]:
        """The ids of distinct units, remembered or encoded now. Units met once are not remembered."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, back = self.young, self.old.get
        out = [*map(young.get, met)]
        new = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            ids = back(met[k])
            if ids is None:
                new.append(k)
            else:
                out[k] = young[met[k]] = ids
        again = (times[new] > 1).tolist()
        for k, ids, often in zip(new, self.encode([met[k] for k in new], named), again, strict=True):
            out[k] = ids
            if often:
                young[met[k]] = ids
        return out

    def texts(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, ``end_id`` after each, in a row; and where each text's begin."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
        bounds = ends - ends[0]
        named = np.zeros(len(column), bool)
        for a in self.added:  # the units of a text that names an added token aren't independent
            named |= pc.match_substring(column, a).to_numpy(zero_copy_only=False)
        begin = cut_units(data, bounds, named)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin), pa.py_buffer(np.ascontiguousarray(data))])
        coded = units.dictionary_encode()
        times = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
        found = [*self.units(coded.dictionary.to_pylist(), times, bool(named.any())), array("i", [end_id]).tobytes()]
        long = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        # The unit after a text's last one is the end.
        which = np.insert(coded.indices.to_numpy(), np.searchsorted(begin[:-1], bounds[1:]), len(found) - 1)
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(long)])), pa.array(flat))
        ids = lists.take(pa.array(which)).flatten().to_numpy()
        total = np.concatenate([[0], np.cumsum(long[which])])
        last = np.searchsorted(begin[:-1], bounds[1:]) + np.arange(1, len(column) + 1)
        return ids, np.concatenate([[0], total[last]])


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_rows(rows: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, place and ids (the text's, then ``end_id``) of ``rows``, in their order.

    Texts are encoded as the library does by itself: names of added tokens, special ones too, are
    these tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for part in slices(batches, limit=BATCH_BYTES):
            ids, offsets = encoder.texts(part.column("text"), end_id)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("place"),
                                              list_array(ids, offsets, pa.int32())], ["doc_id", "place", "ids"])

    bound_batches(rows.sparkSession)
    return rows.select("doc_id", "place", "text").mapInArrow(run, TOKEN_FILE_SCHEMA)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encode every document of ``docs`` and write the token files to the folder ``path``.

    A null or empty text has the end id only. Rows that repeat a doc_id are written one by one,
    in the order they are read, which ``place`` keeps; a null doc_id comes first. An empty table
    writes no rows. Only doc_id and text are read, whatever else the table holds. The texts are ordered before they
    are encoded, so that sampling the range bounds encodes nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.monotonically_increasing_id().alias("place"))
    placed = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    encode_rows(placed, vocabulary, end_id).write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, place and ids from the token files; with ``doc_ids`` only these documents, the filter
    reaching the stripes' statistics and Bloom filters."""
    found = spark.read.schema(TOKEN_FILE_SCHEMA).orc(path)
    return found if doc_ids is None else found.filter(F.col("doc_id").isin([int(i) for i in doc_ids]))


def file_number(name: Column) -> Column:
    """Place of a written file among its folder's: the task's number, then the file's within the task."""
    part = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0))
    return part(r"^part-(\d+)") * F.lit(1_000_000).cast("long") + part(r"-c(\d+)\.")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the files.

    ``start`` counts the ids of all documents before it in the files: a file's total is added to
    those of the files before it (one row per file meets in one task), then a running sum within the
    file, in the order of its rows. Files are ordered by the numbers in their names.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("place"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64()),
                 b.column("file")], ["doc_id", "place", "n_tokens", "ids_crc32", "file"])

    bound_batches(spark)
    rows = read_tokens(spark, path).select("doc_id", "place", "ids", file_number(F.col("_metadata.file_name")).alias("file"))
    rows = materialize(rows.mapInArrow(digest, "doc_id long, place long, n_tokens long, ids_crc32 long, file long"), "token-rows")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    files = (rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
             .select(F.col("file").alias("_f"), F.coalesce(F.sum("_n").over(before(Window.orderBy("file"))), F.lit(0)).alias("_o")))
    inside = F.sum("n_tokens").over(before(Window.partitionBy("file").orderBy("doc_id", "place")))
    return (rows.withColumn("_i", F.coalesce(inside, F.lit(0))).join(files, F.col("file") == F.col("_f"))
            .select("doc_id", (F.col("_o") + F.col("_i")).alias("start"), "n_tokens", "ids_crc32"))
