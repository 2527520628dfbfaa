"""Path selection and classification (B1-B9) and per-repository file aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.constants import CODE_EXTENSIONS, DOCUMENT_EXTENSIONS, VENDOR_DIRS
from ..functions.globset import glob_set


def file_type(ext_col) -> F.Column:
    """code / document / unknown from a lower-cased extension."""
    return (F.when(ext_col.isin(*CODE_EXTENSIONS), F.lit("code"))
             .when(ext_col.isin(*DOCUMENT_EXTENSIONS), F.lit("document"))
             .otherwise(F.lit("unknown")))


def classify_files(df: DataFrame, path_col: str = "path") -> DataFrame:
    """B1: add ``extension`` (lower-cased splitext of the basename) and ``file_type``.

    The extension sets are literals, so the test compiles to an ``In``/``InSet``
    expression inside whole-stage codegen — no join, no shuffle.
    """
    ext = P.extension(path_col)
    return df.withColumn("extension", ext).withColumn("file_type", file_type(F.col("extension")))


def file_info(df: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """B2: path, basename, case-kept extension, byte size (0 when content is null or empty), type."""
    return df.select(
        "*",
        P.basename(path_col).alias("filename"),
        P.extension_case_kept(path_col).alias("file_extension"),
        F.coalesce(F.octet_length(content_col), F.lit(0)).cast("bigint").alias("byte_size"),
        file_type(P.extension(path_col)).alias("file_type"),
    )


def route_files(df: DataFrame, targets: dict[str, str] | None = None,
                default_target: str = "processor") -> DataFrame:
    """One routing decision per file; ``unknown`` is coerced to ``document``.

    ``targets`` maps a file type to a destination; every type falls back to the single
    default destination, as the surveyed service routes all types to one processor.
    """
    classified = df if "file_type" in df.columns else classify_files(df)
    route_type = F.when(F.col("file_type") == "unknown", F.lit("document")).otherwise(F.col("file_type"))
    tgt = F.lit(default_target)
    for k, v in (targets or {}).items():
        tgt = F.when(route_type == k, F.lit(v)).otherwise(tgt)
    return classified.withColumn("route_type", route_type).withColumn("target", tgt)


def select_paths(manifest: DataFrame, include: list[str] | None = None,
                 exclude: list[str] | None = None, path_col: str = "path") -> DataFrame:
    """B4 (literal globs): keep a path iff an include glob matches and no exclude glob does.

    Pure-prefix globs (``dir/**/*``) become ``startswith`` and reach the parquet scan as
    pushed filters; the rest are anchored ``rlike`` on a constant pattern.
    """
    return manifest.filter(P.glob_select(F.col(path_col), include, exclude))


GLOB_SET = "all boolean, head string, tail string, inner string, other string"


def _glob_sets(col: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([glob_set(globs) for globs in col], columns=["all", "head", "tail", "inner", "other"])


def _patterns_to_sets(patterns_df: DataFrame) -> DataFrame:
    """Per source: the include and the exclude globs, each as a set of tries (see ``glob_set``).

    Runs on the (small) pattern table only, Arrow batches of sources, never per file.
    """
    sets = F.pandas_udf(_glob_sets, GLOB_SET)
    no_globs = lambda c: F.size(F.filter(F.coalesce(F.col(c), F.array()), lambda g: g.isNotNull() & (F.trim(g) != ""))) == 0
    return (patterns_df.withColumn("_any", no_globs("include_patterns"))
            .withColumn("_inc", sets(F.col("include_patterns"))).withColumn("_exc", sets(F.col("exclude_patterns"))))


def _in_set(path: Column, s: Column) -> Column:
    # regexp_instr keeps the last pattern compiled; a regexp_like with a column compiles it per row.
    finds = lambda text, name: F.coalesce(F.regexp_instr(text, s[name]) > 0, F.lit(False))
    return (F.coalesce(s["all"], F.lit(False)) | finds(path, "head") | finds(F.reverse(path), "tail")
            | finds(path, "inner") | finds(path, "other"))


def select_paths_by_source(manifest: DataFrame, patterns: DataFrame, key: str = "repo_id",
                           path_col: str = "path") -> DataFrame:
    """B4 (per-source globs): ``patterns`` has ``key, include_patterns, exclude_patterns``.

    Empty / all-blank include lists mean "everything"; exclude lists default to none
    (the "all-blank exclude becomes exclude-everything" defect is not kept). All globs of a source
    and side are one set of tries, so a path's cost hardly grows with the globs. The pattern
    table is one row per source and is joined on ``key``; Catalyst broadcasts it only
    when its estimated size is under the configured threshold.
    """
    rx = _patterns_to_sets(patterns).select(key, "_any", "_inc", "_exc")
    p = F.col(path_col)
    keep = F.coalesce(F.col("_any"), F.lit(True)) | _in_set(p, F.col("_inc"))
    return manifest.join(rx, key, "left").filter(keep & ~_in_set(p, F.col("_exc"))).drop("_any", "_inc", "_exc")


def scope_to_folder(manifest: DataFrame, folder: str | None, path_col: str = "path") -> DataFrame:
    """B5 (literal folder): ``path = folder`` or under ``folder/`` (pushes down as StartsWith)."""
    if not folder:
        return manifest
    p = F.col(path_col)
    return manifest.filter((p == folder) | p.startswith(folder + "/"))


def scope_to_folders(manifest: DataFrame, folders: DataFrame, key: str = "repo_id",
                     path_col: str = "path") -> DataFrame:
    """B5 (folder per repository): ``folders`` has ``key, folder``; null/'' keeps all."""
    f = folders.select(key, F.col("folder").alias("_folder"))
    return (manifest.join(f, key, "left")
            .filter(P.in_folder(F.col(path_col), F.col("_folder"))).drop("_folder"))


def drop_binary(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Drop paths whose lower-cased text ends with a binary suffix (deletions included)."""
    return df.filter(~P.is_binary(path_col))


def flag_binary(df: DataFrame, path_col: str = "path") -> DataFrame:
    return df.withColumn("is_binary", P.is_binary(path_col))


def prune_vendor_dirs(df: DataFrame, names: tuple[str, ...] = VENDOR_DIRS,
                      path_col: str = "path") -> DataFrame:
    """Drop paths with a *directory* component (not the basename) in ``names``."""
    parts = F.split(F.col(path_col), "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return df.filter(~F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names])))


def decode_text(df: DataFrame, content_col: str = "content", out_col: str = "text") -> DataFrame:
    """Bytes -> UTF-8 text, malformed sequences replaced by U+FFFD."""
    return df.withColumn(out_col, F.make_valid_utf8(F.col(content_col).cast("string")))


def filter_readable(projects: DataFrame) -> DataFrame:
    """Project or group access level >= 10, or public; a GitHub ``pull = false`` hides it."""
    perms = F.col("permissions")
    level_ok = ((F.coalesce(perms["project_access"]["access_level"], F.lit(0)) >= 10) |
                (F.coalesce(perms["group_access"]["access_level"], F.lit(0)) >= 10) |
                (F.col("visibility") == "public"))
    pull_ok = F.coalesce(perms["pull"], F.lit(True))
    return projects.filter(level_ok & pull_ok)


# ------------------------------------------------------------------ aggregates

def categorize_files(files: DataFrame, keys: list[str] | None = None,
                     size_col: str | None = "size") -> DataFrame:
    """per key, counts (and bytes) of code / document / unknown files plus totals.

    Counting is a partial (map-side) aggregation, so one huge repository is reduced in
    every task before the shuffle. The per-file lists of the surveyed result are the
    classified rows themselves (``classify_files``), never collected into one array.
    """
    keys = keys or ["repo_id"]
    c = files if "file_type" in files.columns else classify_files(files)
    size = F.coalesce(F.col(size_col), F.lit(0)) if size_col else F.lit(0)
    aggs = []
    for t in ("code", "document", "unknown"):
        aggs.append(F.count_if(F.col("file_type") == t).alias(f"{t}_files"))
    for t in ("code", "document", "unknown"):
        aggs.append(F.sum(F.when(F.col("file_type") == t, size).otherwise(0)).cast("bigint").alias(f"{t}_bytes"))
    aggs.append(F.count(F.lit(1)).alias("total_files"))
    aggs.append(F.sum(size).cast("bigint").alias("total_bytes"))
    return c.groupBy(*keys).agg(*aggs)


def fetch_totals(selected: DataFrame, keys: list[str] | None = None, size_col: str = "size",
                 downloaded_col: str | None = None) -> DataFrame:
    """number of selected files and their total size (null size counts 0).

    GitHub and Bitbucket fetches total the *selected* files; GitLab totals only the files
    that were downloaded — pass ``downloaded_col`` (boolean) for that rule.
    """
    keys = keys or ["repo_id"]
    size = F.coalesce(F.col(size_col), F.lit(0))
    if downloaded_col:
        size = F.when(F.col(downloaded_col), size).otherwise(0)
    return selected.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.sum(size).cast("bigint").alias("total_size"))


def extension_inventory(files: DataFrame, keys: list[str] | None = None, top: int | None = None,
                        path_col: str = "path") -> DataFrame:
    """per key and extension, file count and rank; ``top`` keeps the k most frequent.

    Two aggregations: (key, extension) counts reduce map-side first, so the ranking
    window only sees one row per distinct extension of a key.
    """
    keys = keys or ["repo_id"]
    counts = (files.withColumn("extension", P.extension(path_col))
              .groupBy(*keys, "extension").agg(F.count(F.lit(1)).alias("files")))
    w = Window.partitionBy(*keys).orderBy(F.desc("files"), F.asc("extension"))
    ranked = (counts.withColumn("ext_rank", F.row_number().over(w))
              .withColumn("distinct_extensions", F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    if top is not None:
        ranked = ranked.filter(F.col("ext_rank") <= top)
    return ranked
