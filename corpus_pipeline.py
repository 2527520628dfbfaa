"""Corpus pipeline: language ID, near-dedup, suffix-array dedup, mixing, byte-level BPE.

``STAGES`` lists the stages in order. Each takes ``(spark, docs, sf_dir)`` and returns a DataFrame
that is written as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.llm import bpe, langid, mixing, simhash, suffix_dedup  # noqa: E402
from quarry.llm.common import shrink_heaps  # noqa: E402
from quarry.session import checkpoint_path, ensure_checkpoint_dir, ship_package  # noqa: E402


def _prepare(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    shrink_heaps(spark)  # each stage begins with the memory of the first one


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the others, which have no letters, go. A short text stays, however
    evenly its posterior is spread. Null and empty texts have no language."""
    _prepare(spark)
    found = langid.identify(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.filter(F.col("lang_pred") != "und").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    _prepare(spark)
    return simhash.keep_first(docs, words=4, bits=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings of 100 bytes or more that start earlier."""
    _prepare(spark)
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken (0 to 2 times)."""
    _prepare(spark)
    return mixing.mix(docs, weights=[3, 1, 2], share=1.5, most=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: doc_id, n_tokens, ids, and whether they decode to the text."""
    _prepare(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    done = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Language ID is a trained model and mixing draws by hash: not expressible in SQL. Tested against
#: a brute-force version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    _prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = checkpoint_path(spark, f"pipeline-{i}-{name}", unique=True)
            out.write.parquet(path)
            out = spark.read.parquet(path)
        docs = out
    return docs
