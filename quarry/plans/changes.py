"""Registered jobs: change detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as ops
from ..sources.fixtures import Fixtures
from .catalog import register

EV_SQL = ("CASE status WHEN 'added' THEN 'created' WHEN 'modified' THEN 'modified' "
          "WHEN 'removed' THEN 'deleted' WHEN 'renamed' THEN 'moved' ELSE 'modified' END")


def _commits(fx: Fixtures):
    """Nested commit records (one row per commit with its files), built from fx_commit_files."""
    cf = fx.fx_commit_files
    f = F.struct(F.col("path").alias("filename"), F.col("status"), F.col("previous_path").alias("previous_filename"),
                 F.sha2(F.concat_ws("@", "path", F.col("commit_seq").cast("string")), 256).alias("sha"))
    return (cf.groupBy("repo_id", "commit_seq", "commit_ts", F.col("commit_sha").alias("sha"), "branch", "author")
            .agg(F.sort_array(F.collect_list(f)).alias("files")))


def _watermarks_expr():
    n = F.regexp_extract("repo_id", r"(\d+)$", 1).cast("int")
    return (F.when(n % 4 == 0, F.lit("1996-06-01 00:00:00").cast("timestamp"))
             .when(n % 4 == 1, F.lit("1998-01-01 00:00:00").cast("timestamp"))
             .when(n % 4 == 3, F.lit("2000-01-01 00:00:00").cast("timestamp")))


WM_SQL = """
wm AS (SELECT DISTINCT repo_id, CASE CAST(regexp_extract(repo_id, '(\\d+)$', 1) AS INT) % 4
          WHEN 0 THEN TIMESTAMP '1996-06-01 00:00:00' WHEN 1 THEN TIMESTAMP '1998-01-01 00:00:00'
          WHEN 3 THEN TIMESTAMP '2000-01-01 00:00:00' END AS last_sync FROM fx_commit_files)"""


@register("d5_commits_since", views=["fx_commit_files"], oracle=f"""
WITH c AS (SELECT DISTINCT repo_id, commit_seq, commit_ts FROM fx_commit_files), {WM_SQL}
SELECT c.repo_id, c.commit_seq, c.commit_ts FROM c LEFT JOIN wm ON wm.repo_id = c.repo_id
WHERE wm.last_sync IS NULL OR c.commit_ts >= wm.last_sync""")
def d5_commits_since(spark, sf_dir):
    """All commits since each repository's watermark."""
    fx = Fixtures(spark, sf_dir)
    commits = fx.fx_commit_files.select("repo_id", "commit_seq", "commit_ts").distinct()
    wm = commits.select("repo_id").distinct().select("repo_id", _watermarks_expr().alias("last_sync"))
    return ops.commits_since(commits, wm).select("repo_id", "commit_seq", "commit_ts")


@register("d5_commits_since_log", views=["fx_commit_files"], oracle=f"""
WITH c AS (SELECT DISTINCT repo_id, commit_seq, commit_ts FROM fx_commit_files), {WM_SQL}
SELECT c.repo_id, c.commit_seq, c.commit_ts FROM c JOIN wm ON wm.repo_id = c.repo_id
WHERE wm.last_sync >= TIMESTAMP '1998-01-01' AND c.commit_ts >= wm.last_sync""")
def d5_commits_since_log(spark, sf_dir):
    """Commits since the watermarks of lately synced repositories, from a log laid out by day."""
    from ..session import checkpoint_path
    path = checkpoint_path(spark, "d5-log", unique=True)
    commits = Fixtures(spark, sf_dir).fx_commit_files.select("repo_id", "commit_seq", "commit_ts").distinct()
    log = {"grain": "month", "buckets": 4}  # the tables' commits are spread thinly over seven years
    ops.land_commits(commits, path, **log)
    wm = commits.select("repo_id").distinct().select("repo_id", _watermarks_expr().alias("last_sync")).filter(
        "last_sync >= TIMESTAMP '1998-01-01'")
    out = ops.commits_since_log(spark, path, wm, **log)
    return out.select("repo_id", "commit_seq", "commit_ts")


@register("e1_poll_changes", views=["fx_commit_files"], oracle=f"""
SELECT repo_id, commit_seq, commit_sha AS sha, author, path, {EV_SQL} AS event_type, previous_path
FROM fx_commit_files""")
def e1_poll_changes(spark, sf_dir):
    """Commits exploded into change events."""
    out = ops.poll_changes(_commits(Fixtures(spark, sf_dir)))
    return out.select("repo_id", "commit_seq", "sha", "author", "path", "event_type", "previous_path")


@register("e1_poll_changes_bitbucket", views=["fx_commit_files"], oracle=f"""
SELECT repo_id, commit_seq, 'change ' || CAST(commit_seq AS VARCHAR) AS message,
       CASE WHEN status = 'removed' THEN coalesce(previous_path, path) ELSE path END AS path, {EV_SQL} AS event_type
FROM fx_commit_files""")
def e1_poll_changes_bitbucket(spark, sf_dir):
    """Bitbucket's rule: the new path, else the old one; the commit message is carried."""
    commits = _commits(Fixtures(spark, sf_dir)).withColumn(
        "message", F.concat(F.lit("change "), F.col("commit_seq").cast("string")))
    # Bitbucket lists a removed file by its old path only.
    files = F.transform("files", lambda f: F.when(f["status"] == "removed", F.struct(
        F.lit(None).cast("string").alias("filename"), f["status"].alias("status"),
        F.coalesce(f["previous_filename"], f["filename"]).alias("previous_filename"), f["sha"].alias("sha"))).otherwise(f))
    out = ops.poll_changes(commits.withColumn("files", files), path_rule="bitbucket")
    return out.select("repo_id", "commit_seq", "message", "path", "event_type")


def _net(policy):
    def build(spark, sf_dir):
        ev = Fixtures(spark, sf_dir).fx_commit_files.withColumn("event_type", F.coalesce(
            F.try_element_at(ops._status_map(), F.col("status")), F.lit("modified")))
        return ops.net_changes(ev, policy=policy)
    return build


_NET_SQL = """
WITH e AS (SELECT repo_id, path, commit_ts, commit_seq, file_seq, {ev} AS event_type FROM fx_commit_files),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY commit_ts {d}, commit_seq {d}, file_seq {d}, event_type {d}) AS rn,
             count(*) OVER (PARTITION BY repo_id, path) AS events FROM e)
SELECT repo_id, path, event_type, events FROM r WHERE rn = 1"""

register("e2_net_changes", views=["fx_commit_files"], oracle=_NET_SQL.format(ev=EV_SQL, d="DESC"))(_net("newest"))
register("e2_net_changes_reference_order", views=["fx_commit_files"],
         oracle=_NET_SQL.format(ev=EV_SQL, d="ASC"))(_net("reference"))


def _diffs(fx: Fixtures):
    cf = fx.fx_commit_files
    prov = F.col("commit_seq") % 3
    st = F.col("status")
    gh_status = (F.when((st == "modified") & (F.col("file_seq") == 2), "changed")
                 .when(F.col("file_seq") == 7, "copied").otherwise(st))
    gh = (cf.filter(prov == 0).groupBy("repo_id", "commit_seq")
          .agg(F.collect_list(F.struct(F.col("path").alias("filename"), gh_status.alias("status"),
                                       F.col("previous_path").alias("previous_filename"))).alias("files")))
    gl = (cf.filter(prov == 1).groupBy("repo_id", "commit_seq")
          .agg(F.collect_list(F.struct(F.coalesce("previous_path", "path").alias("old_path"), F.col("path").alias("new_path"),
                                       (st == "added").alias("new_file"), (st == "removed").alias("deleted_file"),
                                       (st == "renamed").alias("renamed_file"))).alias("diffs")))
    bb = (cf.filter(prov == 2).groupBy("repo_id", "commit_seq")
          .agg(F.collect_list(F.struct(st.alias("status"),
                                       F.struct(F.coalesce("previous_path", "path").alias("path")).alias("old"),
                                       F.struct(F.when(st != "removed", F.col("path")).alias("path")).alias("new"))).alias("vals")))
    return gh, gl, bb


@register("e3_diff_entries", views=["fx_commit_files"], oracle="""
WITH g AS (SELECT repo_id, path, previous_path, status, file_seq, commit_seq % 3 AS p FROM fx_commit_files),
gh AS (SELECT repo_id, path, previous_path, CASE WHEN status = 'modified' AND file_seq = 2 THEN 'changed'
                                               WHEN file_seq = 7 THEN 'copied' ELSE status END AS s FROM g WHERE p = 0)
SELECT repo_id, path, 'added' AS change, 'github' AS provider FROM gh WHERE s = 'added'
UNION ALL SELECT repo_id, path, 'modified', 'github' FROM gh WHERE s IN ('modified', 'changed')
UNION ALL SELECT repo_id, path, 'removed', 'github' FROM gh WHERE s = 'removed'
UNION ALL SELECT repo_id, previous_path, 'removed', 'github' FROM gh WHERE s = 'renamed' AND previous_path IS NOT NULL
UNION ALL SELECT repo_id, path, 'added', 'github' FROM gh WHERE s = 'renamed'
UNION ALL SELECT repo_id, path, 'added', 'gitlab' FROM g WHERE p = 1 AND status = 'added'
UNION ALL SELECT repo_id, coalesce(previous_path, path), 'removed', 'gitlab' FROM g WHERE p = 1 AND status IN ('removed', 'renamed')
UNION ALL SELECT repo_id, path, 'added', 'gitlab' FROM g WHERE p = 1 AND status = 'renamed'
UNION ALL SELECT repo_id, path, 'modified', 'gitlab' FROM g WHERE p = 1 AND status NOT IN ('added', 'removed', 'renamed')
UNION ALL SELECT repo_id, path, 'added', 'bitbucket' FROM g WHERE p = 2 AND status = 'added'
UNION ALL SELECT repo_id, coalesce(previous_path, path), 'removed', 'bitbucket' FROM g WHERE p = 2 AND status IN ('removed', 'renamed')
UNION ALL SELECT repo_id, path, 'added', 'bitbucket' FROM g WHERE p = 2 AND status = 'renamed'
UNION ALL SELECT repo_id, path, 'modified', 'bitbucket' FROM g WHERE p = 2 AND status NOT IN ('added', 'removed', 'renamed')""")
def e3_diff_entries(spark, sf_dir):
    """Provider compare results -> added / modified / removed paths."""
    gh, gl, bb = _diffs(Fixtures(spark, sf_dir))
    return (ops.diff_entries(gh, "github").withColumn("provider", F.lit("github"))
            .unionByName(ops.diff_entries(gl, "gitlab").withColumn("provider", F.lit("gitlab")))
            .unionByName(ops.diff_entries(bb, "bitbucket").withColumn("provider", F.lit("bitbucket"))))


HEADS_SQL = """
heads AS (SELECT repo_id, commit_sha AS head_sha FROM (
  SELECT repo_id, commit_sha, row_number() OVER (PARTITION BY repo_id ORDER BY commit_ts DESC, commit_sha DESC) AS rn
  FROM fx_commit_files) WHERE rn = 1)"""


@register("e4_plan_sync", views=["fx_commit_files"], oracle=f"""
WITH {HEADS_SQL.strip()},
src AS (SELECT h.repo_id AS source_id, CAST(regexp_extract(h.repo_id, '(\\d+)$', 1) AS INT) AS n, h.head_sha FROM heads h),
s2 AS (SELECT source_id, head_sha, CASE n % 3 WHEN 0 THEN head_sha WHEN 2 THEN 'stale' END AS last_commit_hash,
              n % 5 <> 0 AS published FROM src)
SELECT source_id, last_commit_hash, head_sha,
       CASE WHEN last_commit_hash IS NOT NULL AND head_sha IS NOT NULL AND last_commit_hash <> head_sha AND published THEN 'incremental'
            WHEN last_commit_hash = head_sha THEN 'unchanged' ELSE 'full' END AS sync_mode FROM s2""")
def e4_plan_sync(spark, sf_dir):
    """Incremental / unchanged / full sync plan per source."""
    fx = Fixtures(spark, sf_dir)
    heads = ops.latest_commits(fx.fx_commit_files.withColumnRenamed("commit_sha", "sha"), keys=("repo_id",))
    heads = heads.withColumnRenamed("repo_id", "source_id")
    n = F.regexp_extract("source_id", r"(\d+)$", 1).cast("int")
    sources = heads.select("source_id", F.when(n % 3 == 0, F.col("head_sha")).when(n % 3 == 2, F.lit("stale"))
                           .alias("last_commit_hash"))
    published = heads.select("source_id", (n % 5 != 0).alias("published"))
    out = ops.plan_sync(sources, heads, published)
    return out.select("source_id", "last_commit_hash", "head_sha", "sync_mode")


@register("h4_latest_commits", views=["fx_commit_files"], oracle="""
SELECT repo_id, branch, commit_sha AS head_sha, commit_ts AS head_ts FROM (
  SELECT repo_id, branch, commit_sha, commit_ts,
         row_number() OVER (PARTITION BY repo_id, branch ORDER BY commit_ts DESC, commit_sha DESC) AS rn
  FROM fx_commit_files) WHERE rn = 1""")
def h4_latest_commits(spark, sf_dir):
    """H4: head commit per repository and branch."""
    cf = Fixtures(spark, sf_dir).fx_commit_files.withColumnRenamed("commit_sha", "sha")
    return ops.latest_commits(cf, keys=("repo_id", "branch"))


DIFF_SQL = """
j AS (SELECT coalesce(o.repo_id, n.repo_id) AS repo_id, coalesce(o.path, n.path) AS path,
             CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
                  WHEN o.sha IS DISTINCT FROM n.sha OR (o.sha IS NULL AND o.size <> n.size) THEN 'modified' END AS change,
             coalesce(n.sha, o.sha) AS sha
      FROM fx_snap_old o FULL OUTER JOIN fx_snap_new n ON o.repo_id = n.repo_id AND o.path = n.path),
c AS (SELECT * FROM j WHERE change IS NOT NULL),
rem AS (SELECT repo_id, sha, path AS old_path, row_number() OVER (PARTITION BY repo_id, sha ORDER BY path) AS pair FROM c WHERE change = 'removed'),
ad AS (SELECT repo_id, sha, path AS new_path, row_number() OVER (PARTITION BY repo_id, sha ORDER BY path) AS pair FROM c WHERE change = 'added'),
pairs AS (SELECT ad.repo_id, ad.sha, rem.old_path, ad.new_path FROM ad JOIN rem ON ad.repo_id = rem.repo_id AND ad.sha = rem.sha AND ad.pair = rem.pair),
d AS (
  SELECT repo_id, path, change, CAST(NULL AS VARCHAR) AS old_path, sha FROM c
  WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.repo_id = c.repo_id AND (p.old_path = c.path OR p.new_path = c.path))
  UNION ALL SELECT repo_id, new_path, 'renamed', old_path, sha FROM pairs)"""


@register("e5_diff_snapshots", views=["fx_snap_old", "fx_snap_new"], oracle=f"WITH {DIFF_SQL.strip()}\nSELECT * FROM d")
def e5_diff_snapshots(spark, sf_dir):
    """E5: snapshot diff with rename detection."""
    fx = Fixtures(spark, sf_dir)
    return ops.diff_snapshots(fx.fx_snap_old, fx.fx_snap_new)


@register("e9_change_summary", views=["fx_snap_old", "fx_snap_new"], oracle=f"""
WITH {DIFF_SQL.strip()}
SELECT repo_id, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'modified') AS modified,
       count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'renamed') AS renamed,
       count(*) FILTER (WHERE change = 'unknown') AS unknown
FROM d GROUP BY repo_id""")
def e9_change_summary(spark, sf_dir):
    """Added / modified / removed / renamed / unknown counts per repository."""
    fx = Fixtures(spark, sf_dir)
    return ops.change_summary(ops.diff_snapshots(fx.fx_snap_old, fx.fx_snap_new))


@register("e8_advance_watermarks", views=["fx_sources"], oracle="""
WITH res AS (SELECT o_custkey AS source_id, o_orderkey AS "offset", sha256(CAST(o_orderkey AS varchar(20))) AS new_commit,
                    o_orderstatus <> 'P' AS succeeded, o_orderdate AS finished_at FROM orders),
best AS (SELECT source_id, new_commit, finished_at FROM (
           SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY "offset" DESC) AS rn FROM res WHERE succeeded) WHERE rn = 1),
reg AS (SELECT id AS source_id, CASE WHEN id % 2 = 0 THEN 'seed' END AS last_commit_hash, CAST(NULL AS TIMESTAMP) AS last_sync FROM fx_sources)
SELECT r.source_id, coalesce(b.new_commit, r.last_commit_hash) AS last_commit_hash, coalesce(b.finished_at, r.last_sync) AS last_sync,
       b.new_commit IS NOT NULL AS advanced
FROM reg r LEFT JOIN best b ON b.source_id = r.source_id""")
def e8_advance_watermarks(spark, sf_dir):
    """Last commit and sync time advanced for successful syncs."""
    fx = Fixtures(spark, sf_dir)
    o = fx.orders
    results = o.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("offset"),
                       F.sha2(F.col("o_orderkey").cast("string"), 256).alias("new_commit"),
                       (F.col("o_orderstatus") != "P").alias("succeeded"), F.col("o_orderdate").alias("finished_at"))
    reg = fx.fx_sources.select(F.col("id").alias("source_id"),
                               F.when(F.col("id") % 2 == 0, F.lit("seed")).alias("last_commit_hash"),
                               F.lit(None).cast("timestamp_ntz").alias("last_sync"))
    return ops.advance_watermarks(reg, results)


@register("e4_plan_stream_sync", views=["fx_repositories"], oracle="""
SELECT id, provider, last_sync,
       CASE WHEN provider = 'github' AND last_sync IS NOT NULL THEN 'incremental' ELSE 'full' END AS sync_mode
FROM fx_repositories""")
def e4_plan_stream_sync(spark, sf_dir):
    """Streamer variant: GitHub repositories with a previous sync poll, the rest list the tree."""
    r = Fixtures(spark, sf_dir).fx_repositories.select("id", "provider", "last_sync")
    return ops.plan_stream_sync(r)
