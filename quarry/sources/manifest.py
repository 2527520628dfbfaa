"""A1 manifest scan and A2 content manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..schemas import MANIFEST_COLUMNS, PROVIDER_LISTING_SCHEMAS


def unify_manifest(listing: DataFrame, provider: str) -> DataFrame:
    """Map one provider's tree listing onto the unified manifest schema.

    github    {repo_id, path, type in blob|tree, sha, size}
    gitlab    {repo_id, path, type in blob|tree, id (= sha), mode}       (no size)
    bitbucket {repo_id, path, type in commit_file|commit_directory, size, commit.hash} (no sha)
    ``entry_type`` becomes ``file`` / ``dir``.
    """
    t = F.col("type")
    if provider == "github":
        sha, size, ref = F.col("sha"), F.col("size"), F.lit(None).cast("string")
        kind = F.when(t == "blob", "file").when(t == "tree", "dir")
    elif provider == "gitlab":
        sha, size, ref = F.col("id"), F.lit(None).cast("bigint"), F.lit(None).cast("string")
        kind = F.when(t == "blob", "file").when(t == "tree", "dir")
    elif provider == "bitbucket":
        sha, size, ref = F.lit(None).cast("string"), F.col("size"), F.col("commit.hash")
        kind = F.when(t == "commit_file", "file").when(t == "commit_directory", "dir")
    else:
        raise ValueError(f"unknown provider {provider!r}")
    return listing.select(
        F.col("repo_id").cast("string").alias("repo_id"), F.lit(provider).alias("provider"),
        F.col("path").cast("string").alias("path"), kind.alias("entry_type"),
        sha.cast("string").alias("sha"), size.cast("bigint").alias("size"), ref.cast("string").alias("ref"))


def read_manifest(spark: SparkSession, path: str, provider: str, fmt: str = "json",
                  files_only: bool = True) -> DataFrame:
    """A1: read landed tree listings (declared schema, no inference) into the unified manifest."""
    reader = spark.read.schema(PROVIDER_LISTING_SCHEMAS[provider])
    listing = reader.format(fmt).load(path)
    out = unify_manifest(listing, provider)
    return out.filter(F.col("entry_type") == "file") if files_only else out


def read_checkout(spark: SparkSession, root: str, repo_id: str, glob: str | None = None) -> DataFrame:
    """A1 (landed checkouts): a folder of files as ``blobs`` rows via the binaryFile source.

    ``glob`` becomes ``pathGlobFilter`` so unselected files are never opened.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root)
    prefix = root.rstrip("/") + "/"
    return df.select(F.lit(repo_id).alias("repo_id"),
                     F.regexp_replace(F.regexp_replace("path", "^file:", ""), "^" + prefix.replace(".", r"\."), "").alias("path"),
                     F.lit(None).cast("string").alias("ref"), "content")


def content_manifest(blobs: DataFrame) -> DataFrame:
    """A2: for every landed blob its sha256, byte size, basename, raw extension and the
    composite ``source_id = repo:path:ref`` (ref defaults to ``HEAD``)."""
    ref = F.coalesce(F.col("ref"), F.lit("HEAD"))
    return blobs.select(
        "repo_id", "path", ref.alias("ref"), "content",
        F.sha2(F.col("content"), 256).alias("content_hash"),
        F.octet_length("content").cast("bigint").alias("byte_size"),
        P.basename("path").alias("filename"),
        P.raw_extension("path").alias("raw_extension"),
        F.concat_ws(":", "repo_id", "path", ref).alias("source_id"))


__all__ = ["unify_manifest", "read_manifest", "read_checkout", "content_manifest", "MANIFEST_COLUMNS"]
