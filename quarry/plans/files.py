"""Registered jobs: manifests, path selection, classification, file aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import VENDOR_DIRS
from ..operators import paths as ops
from ..sources.fixtures import Fixtures
from ..sources.manifest import content_manifest, unify_manifest
from .catalog import register
from .sqlbits import ext, ftype, is_binary, q

INCLUDE = ["src/**/*", "docs/*", "tests/**/*.py", "tests/**/*.PY", "assets/**/*", "node_modules/**/*"]
EXCLUDE = ["*.yaml", "*/de/*", "[!s]*/fr/*"]
# Hand-written regex equivalents of the globs above, for the DuckDB side.
INCLUDE_SQL = ("(starts_with(path, 'src/') OR starts_with(path, 'docs/') "
               "OR regexp_matches(path, '^tests/.*\\.py$') OR regexp_matches(path, '^tests/.*\\.PY$') "
               "OR starts_with(path, 'assets/') OR starts_with(path, 'node_modules/'))")
EXCLUDE_SQL = ("(regexp_matches(path, '\\.yaml$') OR regexp_matches(path, '^.*/de/.*$') "
               "OR regexp_matches(path, '^[^s].*/fr/.*$'))")
VENDOR_SQL = ("list_has_any(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), "
              f"[{q(VENDOR_DIRS)}])")


def _selected(fx: Fixtures):
    files = fx.fx_files
    files = ops.prune_vendor_dirs(files)
    files = ops.select_paths(files, INCLUDE, EXCLUDE)
    return ops.drop_binary(files)


SELECTED_SQL = f"SELECT * FROM fx_files WHERE NOT {VENDOR_SQL} AND {INCLUDE_SQL} AND NOT {EXCLUDE_SQL} AND NOT {is_binary('path')}"


@register("flagship_file_mix", views=["fx_files"], oracle=f"""
WITH sel AS ({SELECTED_SQL}), c AS (SELECT repo_id, size, {ftype(ext('path'))} AS t FROM sel)
SELECT repo_id,
  count(*) FILTER (WHERE t = 'code') AS code_files,
  count(*) FILTER (WHERE t = 'document') AS document_files,
  count(*) FILTER (WHERE t = 'unknown') AS unknown_files,
  CAST(sum(CASE WHEN t = 'code' THEN coalesce(size, 0) ELSE 0 END) AS BIGINT) AS code_bytes,
  CAST(sum(CASE WHEN t = 'document' THEN coalesce(size, 0) ELSE 0 END) AS BIGINT) AS document_bytes,
  CAST(sum(CASE WHEN t = 'unknown' THEN coalesce(size, 0) ELSE 0 END) AS BIGINT) AS unknown_bytes,
  count(*) AS total_files, CAST(sum(coalesce(size, 0)) AS BIGINT) AS total_bytes
FROM c GROUP BY repo_id""")
def flagship_file_mix(spark, sf_dir):
    """Per repository: code / document / unknown files and bytes left after vendor-dir
    pruning, glob selection and binary filtering."""
    return ops.categorize_files(_selected(Fixtures(spark, sf_dir)))


# A GitHub / GitLab / Bitbucket tree listing per file (provider by doc_id % 3), each with
# directory entries for the file's parent folder, unified and reduced to file entries.
@register("a1_manifest_scan", views=["fx_files"], oracle="""
SELECT repo_id, CASE doc_id % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'bitbucket' END AS provider,
       path, 'file' AS entry_type,
       CASE WHEN doc_id % 3 = 2 THEN NULL ELSE sha END AS sha,
       CASE WHEN doc_id % 3 = 1 THEN NULL ELSE size END AS size,
       CASE WHEN doc_id % 3 = 2 THEN 'main' ELSE NULL END AS ref
FROM fx_files""")
def a1_manifest_scan(spark, sf_dir):
    """A1: provider tree listings (GitHub, GitLab, Bitbucket) unified; file entries only."""
    fx = Fixtures(spark, sf_dir)
    f = fx.fx_files
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    gh = f.filter(F.col("doc_id") % 3 == 0)
    gh = gh.select("repo_id", "path", F.lit("blob").alias("type"), "sha", "size").unionByName(
        gh.select("repo_id", parent.alias("path"), F.lit("tree").alias("type"),
                  F.lit(None).cast("string").alias("sha"), F.lit(None).cast("bigint").alias("size")))
    gl = f.filter(F.col("doc_id") % 3 == 1)
    gl = gl.select("repo_id", "path", F.col("sha").alias("id"), F.lit("blob").alias("type"),
                   F.lit("100644").alias("mode")).unionByName(
        gl.select("repo_id", parent.alias("path"), F.lit(None).cast("string").alias("id"),
                  F.lit("tree").alias("type"), F.lit("040000").alias("mode")))
    bb = f.filter(F.col("doc_id") % 3 == 2)
    bb = bb.select("repo_id", "path", F.lit("commit_file").alias("type"), "size",
                   F.struct(F.lit("main").alias("hash")).alias("commit")).unionByName(
        bb.select("repo_id", parent.alias("path"), F.lit("commit_directory").alias("type"),
                  F.lit(None).cast("bigint").alias("size"),
                  F.struct(F.lit("main").alias("hash")).alias("commit")))
    out = (unify_manifest(gh, "github").unionByName(unify_manifest(gl, "gitlab"))
           .unionByName(unify_manifest(bb, "bitbucket")))
    return out.filter(F.col("entry_type") == "file")


@register("a2_content_manifest", views=["fx_files"], oracle="""
SELECT f.repo_id, f.path, 'HEAD' AS ref, sha256(d.text) AS content_hash, CAST(strlen(d.text) AS BIGINT) AS byte_size,
       regexp_extract(f.path, '([^/]*)$', 1) AS filename,
       CASE WHEN strpos(f.path, '.') > 0 THEN regexp_extract(f.path, '\\.([^.]*)$', 1) ELSE '' END AS raw_extension,
       concat(f.repo_id, ':', f.path, ':', 'HEAD') AS source_id
FROM fx_files f JOIN documents d ON d.doc_id = f.doc_id""")
def a2_content_manifest(spark, sf_dir):
    """A2: sha256, byte size, basename, raw extension and composite source id per blob."""
    fx = Fixtures(spark, sf_dir)
    blobs = (fx.fx_files.select("doc_id", "repo_id", "path")
             .join(fx.documents.select("doc_id", F.encode("text", "UTF-8").alias("content")), "doc_id")
             .drop("doc_id").withColumn("ref", F.lit(None).cast("string")))
    return content_manifest(blobs).drop("content")


@register("b1_classify_files", views=["fx_files"], oracle=f"""
SELECT repo_id, path, {ext('path')} AS extension, {ftype(ext('path'))} AS file_type FROM fx_files""")
def b1_classify_files(spark, sf_dir):
    """B1: extension and code / document / unknown class per path."""
    return ops.classify_files(Fixtures(spark, sf_dir).fx_files).select("repo_id", "path", "extension", "file_type")


@register("b2_file_info", views=["fx_files"], oracle=f"""
SELECT f.path, regexp_extract(f.path, '([^/]*)$', 1) AS filename,
       regexp_extract(regexp_extract(f.path, '([^/]*)$', 1), '^\\.*[^.].*(\\.[^.]*)$', 1) AS file_extension,
       CAST(coalesce(strlen(CASE WHEN f.doc_id % 5 = 0 THEN NULL ELSE d.text END), 0) AS BIGINT) AS byte_size,
       {ftype(ext('f.path'))} AS file_type
FROM fx_files f JOIN documents d ON d.doc_id = f.doc_id""")
def b2_file_info(spark, sf_dir):
    """B2: basename, case-kept extension, byte size and type per blob."""
    fx = Fixtures(spark, sf_dir)
    blobs = (fx.fx_files.select("doc_id", "path")
             .join(fx.documents.select("doc_id", "text"), "doc_id")
             .select("path", F.when(F.col("doc_id") % 5 == 0, F.lit(None))
                     .otherwise(F.encode("text", "UTF-8")).alias("content")))
    return ops.file_info(blobs).select("path", "filename", "file_extension", "byte_size", "file_type")


@register("b3_route_files", views=["fx_files"], oracle=f"""
WITH c AS (SELECT path, {ftype(ext('path'))} AS file_type FROM fx_files)
SELECT path, file_type, CASE WHEN file_type = 'unknown' THEN 'document' ELSE file_type END AS route_type,
       CASE WHEN file_type = 'code' THEN 'code-processor' ELSE 'processor' END AS target FROM c""")
def b3_route_files(spark, sf_dir):
    """Routing decision per file (unknown routed as document)."""
    out = ops.route_files(Fixtures(spark, sf_dir).fx_files, targets={"code": "code-processor"})
    return out.select("path", "file_type", "route_type", "target")


@register("b4_select_paths", views=["fx_files"], oracle=f"""
SELECT repo_id, path FROM fx_files WHERE {INCLUDE_SQL} AND NOT {EXCLUDE_SQL}""")
def b4_select_paths(spark, sf_dir):
    """Include / exclude glob selection with literal globs."""
    return ops.select_paths(Fixtures(spark, sf_dir).fx_files, INCLUDE, EXCLUDE).select("repo_id", "path")


def _repo_patterns(fx: Fixtures):
    """Per-repository glob lists, derived from the repository id."""
    n = F.regexp_extract("repo_id", r"(\d+)$", 1).cast("int")
    inc = (F.when(n % 4 == 0, F.array(F.lit("src/**/*")))
            .when(n % 4 == 1, F.array(F.lit("*.md"), F.lit("*.txt"), F.lit("  ")))
            .when(n % 4 == 2, F.array(F.lit("[!n]*/e?/*")))
            .otherwise(F.array().cast("array<string>")))
    exc = (F.when(n % 3 == 0, F.array(F.lit("*.PY"), F.lit("tests/**")))
            .when(n % 3 == 1, F.array(F.lit(" ")))
            .otherwise(F.lit(None).cast("array<string>")))
    return (fx.fx_files.select("repo_id").distinct()
            .select("repo_id", inc.alias("include_patterns"), exc.alias("exclude_patterns")))


@register("b4_select_paths_by_source", views=["fx_files"], oracle="""
WITH k AS (SELECT repo_id, path, CAST(regexp_extract(repo_id, '(\\d+)$', 1) AS INT) AS n FROM fx_files)
SELECT repo_id, path FROM k
WHERE (CASE n % 4 WHEN 0 THEN starts_with(path, 'src/')
               WHEN 1 THEN regexp_matches(path, '\\.md$') OR regexp_matches(path, '\\.txt$')
               WHEN 2 THEN regexp_matches(path, '^[^n].*/e./.*$')
               ELSE TRUE END)
  AND NOT (CASE WHEN n % 3 = 0 THEN regexp_matches(path, '\\.PY$') OR starts_with(path, 'tests/') ELSE FALSE END)""")
def b4_select_paths_by_source(spark, sf_dir):
    """Glob selection with per-repository pattern lists."""
    fx = Fixtures(spark, sf_dir)
    return ops.select_paths_by_source(fx.fx_files, _repo_patterns(fx)).select("repo_id", "path")


@register("b5_scope_to_folder", views=["fx_files"], oracle="""
WITH k AS (SELECT repo_id, path, CAST(regexp_extract(repo_id, '(\\d+)$', 1) AS INT) AS n FROM fx_files),
     f AS (SELECT repo_id, path, CASE n % 3 WHEN 0 THEN 'src' WHEN 1 THEN 'src/lib/en' ELSE NULL END AS folder FROM k)
SELECT repo_id, path FROM f WHERE folder IS NULL OR path = folder OR starts_with(path, folder || '/')""")
def b5_scope_to_folder(spark, sf_dir):
    """Per-repository folder scope."""
    fx = Fixtures(spark, sf_dir)
    n = F.regexp_extract("repo_id", r"(\d+)$", 1).cast("int")
    folders = fx.fx_files.select("repo_id").distinct().select(
        "repo_id", F.when(n % 3 == 0, "src").when(n % 3 == 1, "src/lib/en").alias("folder"))
    return ops.scope_to_folders(fx.fx_files, folders).select("repo_id", "path")


@register("b6_drop_binary", views=["fx_files"], oracle=f"""
SELECT repo_id, path FROM fx_files WHERE NOT {is_binary('path')}""")
def b6_drop_binary(spark, sf_dir):
    """Binary suffixes dropped."""
    return ops.drop_binary(Fixtures(spark, sf_dir).fx_files).select("repo_id", "path")


@register("b7_prune_vendor_dirs", views=["fx_files"], oracle=f"""
SELECT repo_id, path FROM (
  SELECT repo_id, CASE doc_id % 5 WHEN 0 THEN 'build/' || path WHEN 1 THEN path || '/dist' ELSE path END AS path
  FROM fx_files) WHERE NOT {VENDOR_SQL}""")
def b7_prune_vendor_dirs(spark, sf_dir):
    """Paths under vendor / build directories dropped."""
    f = Fixtures(spark, sf_dir).fx_files
    f = f.select("repo_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("build/"), "path"))
                 .when(F.col("doc_id") % 5 == 1, F.concat("path", F.lit("/dist"))).otherwise(F.col("path")).alias("path"))
    return ops.prune_vendor_dirs(f)


@register("b8_decode_text", oracle="""
SELECT doc_id, length(text) + CASE WHEN doc_id % 4 IN (0, 1) THEN 1 ELSE 0 END AS chars,
       length(text) - length(replace(text, '�', '')) + CASE WHEN doc_id % 4 IN (0, 1) THEN 1 ELSE 0 END AS replacements
FROM documents""")
def b8_decode_text(spark, sf_dir):
    """Malformed tails appended to some documents; decoded text length and U+FFFD count."""
    fx = Fixtures(spark, sf_dir)
    d = fx.documents.select("doc_id", F.concat(
        F.encode("text", "UTF-8"),
        F.when(F.col("doc_id") % 4 == 0, F.unhex(F.lit("FF"))).when(F.col("doc_id") % 4 == 1, F.unhex(F.lit("E282")))
        .otherwise(F.unhex(F.lit("")))).alias("content"))
    out = ops.decode_text(d)
    return out.select("doc_id", F.length("text").alias("chars"),
                      (F.length("text") - F.length(F.regexp_replace("text", "�", ""))).alias("replacements"))


@register("b9_filter_readable", oracle="""
SELECT p_name AS project, CASE p_size % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'internal' END AS visibility
FROM part
WHERE (coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 40 END, 0) >= 10
       OR coalesce(CASE WHEN p_size % 7 = 0 THEN p_size END, 0) >= 10
       OR p_size % 3 = 0)
  AND coalesce(CASE WHEN p_size % 11 = 0 THEN FALSE WHEN p_size % 11 = 1 THEN TRUE END, TRUE)""")
def b9_filter_readable(spark, sf_dir):
    """Projects readable by access level, visibility and pull permission."""
    part = Fixtures(spark, sf_dir).part
    s = F.col("p_size")
    projects = part.select(
        F.col("p_name").alias("project"),
        F.when(s % 3 == 0, "public").when(s % 3 == 1, "private").otherwise("internal").alias("visibility"),
        F.struct(
            F.struct(F.when(s % 5 == 0, F.lit(None)).otherwise(s % 40).cast("int").alias("access_level")).alias("project_access"),
            F.struct(F.when(s % 7 == 0, s).cast("int").alias("access_level")).alias("group_access"),
            F.when(s % 11 == 0, F.lit(False)).when(s % 11 == 1, F.lit(True)).alias("pull")).alias("permissions"))
    return ops.filter_readable(projects).select("project", "visibility")


@register("f1_categorize_files", views=["fx_files"], oracle=f"""
WITH c AS (SELECT repo_id, size, {ftype(ext('path'))} AS t FROM fx_files)
SELECT repo_id,
  count(*) FILTER (WHERE t = 'code') AS code_files,
  count(*) FILTER (WHERE t = 'document') AS document_files,
  count(*) FILTER (WHERE t = 'unknown') AS unknown_files,
  CAST(sum(CASE WHEN t = 'code' THEN coalesce(size, 0) ELSE 0 END) AS BIGINT) AS code_bytes,
  CAST(sum(CASE WHEN t = 'document' THEN coalesce(size, 0) ELSE 0 END) AS BIGINT) AS document_bytes,
  CAST(sum(CASE WHEN t = 'unknown' THEN coalesce(size, 0) ELSE 0 END) AS BIGINT) AS unknown_bytes,
  count(*) AS total_files, CAST(sum(coalesce(size, 0)) AS BIGINT) AS total_bytes
FROM c GROUP BY repo_id""")
def f1_categorize_files(spark, sf_dir):
    """code / document / unknown files and bytes per repository."""
    return ops.categorize_files(Fixtures(spark, sf_dir).fx_files)


@register("f2_fetch_totals", views=["fx_files"], oracle=f"""
SELECT repo_id, count(*) AS files, CAST(sum(coalesce(size, 0)) AS BIGINT) AS total_size
FROM ({SELECTED_SQL}) GROUP BY repo_id""")
def f2_fetch_totals(spark, sf_dir):
    """selected file count and total size per repository."""
    return ops.fetch_totals(_selected(Fixtures(spark, sf_dir)))


@register("f11_extension_inventory", views=["fx_files"], oracle=f"""
WITH c AS (SELECT repo_id, {ext('path')} AS extension, count(*) AS files FROM fx_files GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY files DESC, extension) AS ext_rank,
             count(*) OVER (PARTITION BY repo_id) AS distinct_extensions FROM c)
SELECT * FROM r""")
def f11_extension_inventory(spark, sf_dir):
    """all extensions per repository, most frequent first."""
    return ops.extension_inventory(Fixtures(spark, sf_dir).fx_files)


A8_SQL = """
k AS (SELECT *, CAST(regexp_extract(repo_id, '(\\d+)$', 1) AS INT) % 3 AS n FROM fx_files),
rows AS (SELECT repo_id, CASE n WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'bitbucket' END AS provider, path, 'file' AS entry_type,
                CASE WHEN n < 2 THEN sha END AS sha, CASE WHEN n <> 1 THEN size END AS size,
                CASE n WHEN 0 THEN NULL WHEN 1 THEN 'main' ELSE substr(sha, 1, 12) END AS ref FROM k)"""


def _land_pages(fx: Fixtures, base: str, pages_per_file: int = 50) -> None:
    """Landed pages of up to 100 entries as JSON lines: GitHub trees (with directories), GitLab lists
    and Bitbucket values, by repository; a big repository spans several files."""
    f = fx.fx_files
    n = F.regexp_extract("repo_id", r"(\d+)$", 1).cast("int") % 3
    blob = F.struct("path", F.when(n == 2, "commit_file").otherwise("blob").alias("type"), F.when(n == 0, F.col("sha")).alias("sha"),
                    F.when(n == 1, F.col("sha")).alias("id"), F.when(n != 1, F.col("size")).alias("size"),
                    F.when(n == 2, F.struct(F.substring("sha", 1, 12).alias("hash"))).alias("commit"))
    folder = F.struct(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path"), F.when(n == 2, "commit_directory").otherwise("tree").alias("type"))
    entries = (f.select("repo_id", "doc_id", n.alias("n"), F.to_json(blob).alias("e"))
               .unionByName(f.select("repo_id", "doc_id", n.alias("n"), F.to_json(folder).alias("e"))))
    pages = (entries.withColumn("page_no", F.floor(F.col("doc_id") / 50)).groupBy("repo_id", "n", "page_no")
             .agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("e")), ","), F.lit("]")).alias("list")))
    page = (F.when(F.col("n") == 0, F.concat(F.lit('{"tree":'), "list", F.lit("}")))
            .when(F.col("n") == 1, F.col("list")).otherwise(F.concat(F.lit('{"values":'), "list", F.lit("}"))))
    provider = F.element_at(F.array(F.lit("github"), F.lit("gitlab"), F.lit("bitbucket")), F.col("n") + 1)
    ref = F.when(F.col("n") == 1, F.lit(',"ref":"main"')).otherwise(F.lit(""))
    value = F.concat(F.lit('{"repo_id":"'), "repo_id", F.lit('","provider":"'), provider, F.lit('"'), ref, F.lit(',"page":'), page, F.lit("}"))
    pages.select("repo_id", "page_no", value.alias("value")).repartitionByRange("repo_id", "page_no").select("value") \
        .write.mode("overwrite").text(base)


@register("a8_connector_scan", views=["fx_files"], oracle=f"""
WITH {A8_SQL.strip()}
SELECT * FROM rows WHERE (starts_with(path, 'src/') OR starts_with(path, 'docs/')) AND NOT regexp_matches(path, '\\.md$')""")
def a8_connector_scan(spark, sf_dir):
    """Landed pages of three providers read through the Python data source, in byte ranges of 64 kB,
    with include ``src/**/*,docs/**/*`` and exclude ``*.md``."""
    from ..session import checkpoint_path
    from ..sources.connector import RepoDumpSource
    base = checkpoint_path(spark, "a8", unique=True)
    _land_pages(Fixtures(spark, sf_dir), base + "/landed")
    spark.dataSource.register(RepoDumpSource)
    return (spark.read.format("repodump").option("path", base + "/landed").option("split_bytes", 65536)
            .option("include", "src/**/*,docs/**/*").option("exclude", "*.md").load())


@register("a8_connector_stream", views=["fx_files"], oracle=f"""
WITH {A8_SQL.strip()}
SELECT * FROM rows""")
def a8_connector_stream(spark, sf_dir):
    """The same pages landed twice over and read as a stream that stops in between: the first files,
    and after a restart what has come since; every line once."""
    from ..session import checkpoint_path
    from ..sources.connector import RepoDumpSource
    base = checkpoint_path(spark, "a8-stream", unique=True)
    _land_pages(Fixtures(spark, sf_dir), base + "/pages")
    spark.dataSource.register(RepoDumpSource)
    pages = spark.read.text(base + "/pages")
    for k in range(2):
        part = pages.filter(F.pmod(F.xxhash64("value"), F.lit(2)) == k)
        part.repartitionByRange("value").write.text(f"{base}/landed/{k}")
        (spark.readStream.format("repodump").option("path", base + "/landed").option("split_bytes", 65536).load()
         .writeStream.format("parquet").option("path", base + "/out").option("checkpointLocation", base + "/ckpt")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(base + "/out")


@register("a1_manifest_read", views=["fx_files"], oracle="""
SELECT repo_id, 'github' AS provider, path, 'file' AS entry_type, sha, size, CAST(NULL AS VARCHAR) AS ref FROM fx_files""")
def a1_manifest_read(spark, sf_dir):
    """GitHub tree listings landed as JSON lines (files and their parent folders), read back
    with the declared listing schema and reduced to file entries."""
    from ..session import checkpoint_path
    from ..sources.manifest import read_manifest
    f = Fixtures(spark, sf_dir).fx_files
    listing = (f.select("repo_id", "path", F.lit("blob").alias("type"), "sha", "size",
                        F.concat(F.lit("https://api.example/blobs/"), "sha").alias("url"))
               .unionByName(f.select("repo_id", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path"),
                                     F.lit("tree").alias("type"), F.lit(None).cast("string").alias("sha"),
                                     F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("string").alias("url"))
                            .distinct()))
    base = checkpoint_path(spark, "a1", unique=True)
    listing.repartitionByRange("repo_id", "path").write.mode("overwrite").json(base)
    return read_manifest(spark, base, "github", fmt="json")


@register("i2_include_except_exclude", views=["fx_files"], oracle="""
SELECT repo_id, path FROM fx_files WHERE starts_with(path, 'src/') OR starts_with(path, 'docs/')
EXCEPT SELECT repo_id, path FROM fx_files WHERE ends_with(path, '.md') OR ends_with(path, '.png')""")
def i2_include_except_exclude(spark, sf_dir):
    """Paths of the include globs without those of the exclude globs."""
    files = Fixtures(spark, sf_dir).fx_files.select("repo_id", "path")
    return ops.select_paths(files, ["src/**/*", "docs/**/*"], ["*.md", "*.png"]).distinct()
