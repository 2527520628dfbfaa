"""Change detection and incremental processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import COMMIT_STATUS_TO_EVENT
from ..session import checkpoint_path


def _status_map() -> F.Column:
    return F.create_map(*[F.lit(x) for kv in COMMIT_STATUS_TO_EVENT.items() for x in kv])


def commits_since(commits: DataFrame, watermarks: DataFrame, newest: int | None = None,
                  keys: tuple[str, ...] = ("repo_id",), ts_col: str = "commit_ts",
                  tiebreak: str = "sha") -> DataFrame:
    """All commits at or after each key's ``last_sync`` (null = no bound).

    With ``newest`` only that many per key, newest first, ranked as ``recent_rank``: a report, not
    a sync, as what it leaves out is lost once the watermark moves.
    """
    wm = watermarks.select(*keys, F.col("last_sync"))
    j = commits.join(wm, list(keys), "left")
    j = j.filter(F.col("last_sync").isNull() | (F.col(ts_col) >= F.col("last_sync")))
    if newest is None:
        return j
    w = Window.partitionBy(*keys).orderBy(F.desc(ts_col), F.desc(tiebreak))
    return j.withColumn("recent_rank", F.row_number().over(w)).filter(F.col("recent_rank") <= newest)


#: Folders of a commit log per day, by repository.
LOG_BUCKETS = 16


def _log_bucket(key, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _log_day(ts, grain: str) -> F.Column:
    return F.to_date(F.date_trunc(grain, ts))


def land_commits(commits: DataFrame, path: str, key: str = "repo_id", ts_col: str = "commit_ts",
                 grain: str = "day", buckets: int = LOG_BUCKETS) -> None:
    """Append commits to the log at ``path``: a folder per commit day (or week, month, ...) and bucket
    of repositories, so that a sync reads the days and buckets it needs. A repository's days spread
    over many files, a day's repositories over the buckets. Commits without a time are in the day
    null. ``grain`` and ``buckets`` are the log's: the same for every landing and reading."""
    out = commits.withColumn("log_day", _log_day(ts_col, grain)).withColumn("log_bucket", _log_bucket(key, buckets))
    (out.repartitionByRange("log_day", "log_bucket", key).sortWithinPartitions("log_day", "log_bucket", key)
     .write.mode("append").partitionBy("log_day", "log_bucket").parquet(path))


def commits_since_log(spark, path: str, watermarks: DataFrame, key: str = "repo_id", ts_col: str = "commit_ts",
                      grain: str = "day", buckets: int = LOG_BUCKETS) -> DataFrame:
    """D5 over a partitioned log: as :func:`commits_since`, for the repositories of ``watermarks``.

    The days and buckets that hold commits are listed, those before the oldest watermark of their
    bucket left out, and the rest is joined to the log on its partition columns: a dynamic filter
    that keeps the scan from opening older days. Repositories without a watermark need all days of
    their bucket. The table of folders is broadcast: it has a row per folder of the log, which is a
    listing that the scan's own planning holds as well.
    """
    log = spark.read.parquet(path)
    wm = watermarks.select(F.col(key), "last_sync")
    need = wm.groupBy(_log_bucket(key, buckets).alias("nb")).agg(F.min(F.coalesce(
        _log_day("last_sync", grain), F.lit("0001-01-01").cast("date"))).alias("oldest"))
    # Partition columns only: answered from the folders' names.
    folders = log.select("log_day", "log_bucket").distinct().select(F.col("log_day").alias("nd"), F.col("log_bucket").alias("fb"))
    # A written table with the condition read off it: a plain scan and filter, which the optimizer
    # takes as a reason to prune the log, and whose broadcast the scan's filter uses again.
    listed = checkpoint_path(spark, "log-folders", unique=True)
    (folders.join(need, F.col("fb") == F.col("nb")).select("nd", "nb", F.datediff("nd", "oldest").alias("ahead"))
     .write.parquet(listed))
    some = spark.read.parquet(listed).filter("ahead >= 0").select("nd", "nb")
    recent = log.join(F.broadcast(some), (F.col("log_day") == F.col("nd")) & (F.col("log_bucket") == F.col("nb")))
    undated = log.filter(F.col("log_day").isNull())  # wanted by repositories without a watermark only
    both = recent.select(*[c for c in log.columns if c not in ("log_day", "log_bucket")]).unionByName(undated.drop("log_day", "log_bucket"))
    j = both.join(wm, key)
    return j.filter(F.col("last_sync").isNull() | (F.col(ts_col) >= F.col("last_sync")))


def poll_changes(commits: DataFrame, path_rule: str = "github") -> DataFrame:
    """Explode each commit's ``files`` into change events.

    added->created, modified->modified, removed->deleted, renamed->moved, anything else
    ->modified. ``path_rule='bitbucket'`` takes the new path, else the old one.
    """
    x = commits.select("*", F.posexplode("files").alias("file_seq", "f")).drop("files")
    status = F.col("f.status")
    ev = F.coalesce(F.try_element_at(_status_map(), status), F.lit("modified"))
    if path_rule not in ("github", "bitbucket"):
        raise ValueError(path_rule)
    path = F.col("f.filename") if path_rule == "github" else F.coalesce(F.col("f.filename"), F.col("f.previous_filename"))
    return x.select(
        *[c for c in x.columns if c != "f"],
        path.alias("path"), ev.alias("event_type"),
        F.col("f.previous_filename").alias("previous_path"), F.col("f.sha").alias("file_sha"))


def net_changes(events: DataFrame, policy: str = "newest", keys: tuple[str, ...] = ("repo_id", "path"),
                order: tuple[str, ...] = ("commit_ts", "commit_seq", "file_seq"),
                status_col: str = "event_type", keep_order: bool = False) -> DataFrame:
    """One status per path from many change events.

    ``newest`` (default): the latest event wins under the total order ``order + status``.
    ``reference``: the oldest wins — what a dict overwrite does when commits arrive newest
    first. A ``max``/``min`` over a struct is a partial aggregate: no sort, no per-key
    buffering, so a hot path/repository is reduced map-side.
    """
    key = F.struct(*[F.col(c) for c in order], F.col(status_col).alias("_s"))
    pick = F.max(key) if policy == "newest" else F.min(key)
    if policy not in ("newest", "reference"):
        raise ValueError(policy)
    # ``keep_order`` returns the winner's order columns, so results of parts can be folded again;
    # events already counted in a part are summed.
    counted = F.sum("events") if "events" in events.columns else F.count(F.lit(1))
    kept = [F.col(f"_k.{c}").alias(c) for c in order] if keep_order else []
    return (events.groupBy(*keys).agg(pick.alias("_k"), counted.alias("events"))
            .select(*keys, F.col("_k._s").alias(status_col), "events", *kept))


def diff_entries(diff: DataFrame, provider: str, key: str = "repo_id") -> DataFrame:
    """Provider compare results -> long table ``(key, path, change)``.

    github    files[{filename,status,previous_filename}]: added / modified|changed /
              removed / renamed = removed(previous, when given) + added(new); other statuses dropped.
    gitlab    diffs[{old_path,new_path,new_file,deleted_file,renamed_file}]: flag precedence
              new > deleted > renamed > else modified(new_path).
    bitbucket vals[{status, old.path, new.path}]: added(new) / removed(old) /
              renamed = removed(old)+added(new) / else modified(new).
    """
    def entry(path, change):
        return F.struct(path.cast("string").alias("path"), F.lit(change).alias("change"))

    if provider == "github":
        x = diff.select(key, F.explode("files").alias("d"))
        s = F.col("d.status")
        arr = (F.when(s == "added", F.array(entry(F.col("d.filename"), "added")))
                .when(s.isin("modified", "changed"), F.array(entry(F.col("d.filename"), "modified")))
                .when(s == "removed", F.array(entry(F.col("d.filename"), "removed")))
                .when(s == "renamed", F.array(entry(F.col("d.previous_filename"), "removed"),
                                              entry(F.col("d.filename"), "added"))))
    elif provider == "gitlab":
        x = diff.select(key, F.explode("diffs").alias("d"))
        arr = (F.when(F.coalesce(F.col("d.new_file"), F.lit(False)), F.array(entry(F.col("d.new_path"), "added")))
                .when(F.coalesce(F.col("d.deleted_file"), F.lit(False)), F.array(entry(F.col("d.old_path"), "removed")))
                .when(F.coalesce(F.col("d.renamed_file"), F.lit(False)),
                      F.array(entry(F.col("d.old_path"), "removed"), entry(F.col("d.new_path"), "added")))
                .otherwise(F.array(entry(F.col("d.new_path"), "modified"))))
    elif provider == "bitbucket":
        x = diff.select(key, F.explode("vals").alias("d"))
        s = F.col("d.status")
        arr = (F.when(s == "added", F.array(entry(F.col("d.new.path"), "added")))
                .when(s == "removed", F.array(entry(F.col("d.old.path"), "removed")))
                .when(s == "renamed", F.array(entry(F.col("d.old.path"), "removed"), entry(F.col("d.new.path"), "added")))
                .otherwise(F.array(entry(F.col("d.new.path"), "modified"))))
    else:
        raise ValueError(provider)
    out = x.select(key, F.explode(F.coalesce(arr, F.array().cast("array<struct<path:string,change:string>>"))).alias("e"))
    return out.select(key, "e.path", "e.change").filter(F.col("path").isNotNull())


def diff_snapshots(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("repo_id",),
                   detect_renames: bool = True) -> DataFrame:
    """Two manifests -> ``added / modified / removed / renamed / unknown`` rows.

    A full outer join on (keys, path); each side carries a marker, so a null sha doesn't look like
    an absent file. Files on both sides are modified if their shas differ; if both shas are null
    their sizes are compared, and without sizes the change is ``unknown``. Renames pair the
    removed and added paths of one key with the same sha, 1:1 in path order; a copy (old path
    still present) stays ``added``. Output: keys, path, change, old_path, sha.

    One shuffle on (keys, sha) after the join does ranking and pairing; rows without a part in
    renames travel by their path, so null shas don't meet. Rows of one sha are ranked by a
    streaming window over paths alone: content never enters.
    """
    k = list(keys)

    def side(df, name):
        size = F.col("size") if "size" in df.columns else F.lit(None).cast("long")
        return df.select(*k, "path", F.struct("sha", size.cast("long").alias("size")).alias(name))

    j = side(old, "_o").join(side(new, "_n"), k + ["path"], "full_outer")
    o, n = F.col("_o"), F.col("_n")
    change = (F.when(o.isNull(), "added").when(n.isNull(), "removed")
              .when(~o["sha"].eqNullSafe(n["sha"]), "modified")
              .when(o["sha"].isNull() & (o["size"].isNull() | n["size"].isNull()), "unknown")
              .when(o["sha"].isNull() & (o["size"] != n["size"]), "modified"))
    j = (j.withColumn("change", change).filter(F.col("change").isNotNull())
         .select(*k, "path", "change", F.coalesce(n["sha"], o["sha"]).alias("sha")))
    if not detect_renames:
        return j.select(*k, "path", "change", F.lit(None).cast("string").alias("old_path"), "sha")
    may_move = F.col("change").isin("removed", "added") & F.col("sha").isNotNull()
    meet = [*k, "_sha", "_path"]
    x = (j.withColumn("_sha", F.when(may_move, F.col("sha"))).withColumn("_path", F.when(~may_move, F.col("path")))
         .repartition(*meet))
    x = x.withColumn("_nth", F.row_number().over(Window.partitionBy(*meet, "change").orderBy("path")))
    gone = F.col("change") == "removed"
    pair = x.groupBy(*meet, "_nth").agg(F.max(F.when(gone, F.col("path"))).alias("_old"),
                                        F.max(F.when(~gone, F.struct("path", "change"))).alias("_new"),
                                        F.max("sha").alias("sha"))
    moved = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    return pair.select(*k, F.coalesce("_new.path", "_old").alias("path"),
                       F.when(moved, "renamed").otherwise(F.coalesce("_new.change", F.lit("removed"))).alias("change"),
                       F.when(moved, F.col("_old")).alias("old_path"), "sha")


#: What a file's change may be.
CHANGES = ["added", "modified", "removed", "renamed", "unknown"]


def change_summary(diff: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """Counts of added / modified / removed / renamed / unknown per key.

    ``pivot`` with the value list given up front: one aggregation, no extra distinct job.
    """
    return (diff.groupBy(*keys).pivot("change", CHANGES).count().na.fill(0, CHANGES))


def latest_commits(commits: DataFrame, keys: tuple[str, ...] = ("repo_id", "branch"),
                   ts_col: str = "commit_ts", sha_col: str = "sha") -> DataFrame:
    """H4: head commit per (repo, branch): newest timestamp, sha breaks ties (partial aggregate)."""
    return (commits.groupBy(*keys)
            .agg(F.max(F.struct(F.col(ts_col).alias("ts"), F.col(sha_col).alias("sha"))).alias("_h"))
            .select(*keys, F.col("_h.sha").alias("head_sha"), F.col("_h.ts").alias("head_ts")))


def plan_sync(sources: DataFrame, heads: DataFrame, published: DataFrame | None = None,
              resync_unchanged: bool = False, key: str = "source_id") -> DataFrame:
    """Per source ``incremental`` (previous and head hash present, different, and the
    update event published), ``unchanged`` (equal hashes; ``full`` with
    ``resync_unchanged=True``), else ``full``."""
    j = sources.join(heads.select(key, "head_sha"), key, "left")
    if published is not None:
        j = j.join(published.select(key, "published"), key, "left")
        pub = F.coalesce(F.col("published"), F.lit(False))
    else:
        pub = F.lit(True)
    last, head = F.col("last_commit_hash"), F.col("head_sha")
    differ = last.isNotNull() & (last != "") & head.isNotNull() & (head != "") & (last != head)
    same = last.isNotNull() & (last != "") & head.isNotNull() & (last == head)
    mode = F.when(differ & pub, "incremental")
    if not resync_unchanged:
        mode = mode.when(same, "unchanged")
    return j.withColumn("sync_mode", mode.otherwise("full"))


def plan_stream_sync(repos: DataFrame) -> DataFrame:
    """E4 (streamer variant): GitHub repositories with a previous ``last_sync`` poll
    incrementally; everything else takes a full tree listing."""
    return repos.withColumn("sync_mode", F.when((F.col("provider") == "github") & F.col("last_sync").isNotNull(),
                                                "incremental").otherwise("full"))


def advance_watermarks(registry: DataFrame, results: DataFrame, key: str = "source_id",
                       order_col: str = "offset") -> DataFrame:
    """Move ``last_commit_hash`` (and ``last_sync``) forward only for syncs whose
    events were all written; the newest successful result per key wins."""
    ok = results.filter(F.col("succeeded"))
    latest = (ok.groupBy(key).agg(F.max(F.struct(F.col(order_col), F.col("new_commit"), F.col("finished_at"))).alias("_m"))
              .select(key, F.col("_m.new_commit").alias("_new"), F.col("_m.finished_at").alias("_at")))
    j = registry.join(latest, key, "left")
    return j.select(*[c for c in registry.columns if c not in ("last_commit_hash", "last_sync")],
                    F.coalesce("_new", "last_commit_hash").alias("last_commit_hash"),
                    F.coalesce("_at", "last_sync").alias("last_sync"),
                    F.col("_new").isNotNull().alias("advanced"))
