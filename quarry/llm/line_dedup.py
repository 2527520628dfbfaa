"""Line dedup: lines that many documents hold stay in one of them (DataFrame functions only).

Lines are exploded with their place, normalised and hashed; distinct documents are counted per
hash; the places of the lines to drop go back to their document, which is put together again from
the places that are left. Only hashes and places are shuffled by line: a text moves once, to meet
its own dropped places.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: White space as a line's key strips it.
SPACE = " \t\n\x0b\x0c\r"
#: A key with more than this part of all lines is not met in one task.
HOT_PARTS = 1024


def line_key(line: Column) -> Column:
    """The line stripped at both ends, A-Z lower-cased (other letters stay as they are)."""
    bare = F.btrim(line, F.lit(SPACE))
    # On plain ASCII lower() is the same and works on bytes.
    return (F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare))
            .otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def candidate_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """key (SHA-256), doc_id, row (SHA-256 of the text), pos of every line with a long enough key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select("doc_id", _digest(text).alias("row"), F.posexplode(_lines(text)).alias("pos", "line"))
    long_ = F.char_length(F.btrim("line", F.lit(SPACE))) >= min_chars
    return each.filter(long_).select(_digest(line_key(F.col("line"))).alias("key"), "doc_id", "row", "pos")


def dropped_places(lines: DataFrame, min_docs: int) -> DataFrame:
    """doc_id, row, dropped (places, one array per document) of the lines that go.

    Documents are made distinct per key before they are counted: first by (key, document), so a
    line that a third of all documents hold is spread over all tasks, then as partial counts. Back
    at the lines, keys with more than a ``HOT_PARTS``-th of all lines, of which there are at most
    ``HOT_PARTS``, are sent to every task; the others are met by key, and none of them is large.
    """
    spread = (lines.select("key", "doc_id").distinct()
              .groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder"))
              .filter(F.col("n") >= min_docs))
    spread = materialize(spread, "line-spread")
    large = F.col("n") > lines.count() / HOT_PARTS
    hot = F.broadcast(spread.filter(large).select("key", "holder"))
    cold = spread.filter(~large).select("key", "holder")
    met = lines.join(hot, "key").unionByName(lines.join(hot, "key", "left_anti").join(cold, "key"))
    gone = met.filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    return gone.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("dropped"))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """doc_id, text, n_lines, n_dropped (long): each document without its repeated lines.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines, but
    for those of the largest doc_id that holds one; the others stay as they are, in order.

    Null and empty texts are one empty line, so ``text`` is never null here. Rows that share a
    doc_id are one document when documents are counted and kept, each row's lines being judged
    for themselves; repeated rows come back as often as they are given. A null doc_id is a
    document too, smaller than all others. Empty table: no rows. Other columns are not read.
    """
    lines = materialize(candidate_lines(docs, min_chars), "line-keys")
    places = dropped_places(lines, min_docs).select(
        F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "dropped")
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = whole.withColumn("row", _digest(F.col("text")))
    met = whole.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    split = _lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("dropped"))
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col("split"), i)), "\n"))
    return (met.withColumn("split", split)
            .select("doc_id", kept.alias("text"), F.size("split").cast("long").alias("n_lines"),
                    F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped")))
