"""Registry jobs: joins (D2), batch upserts (J1, J2), cascade delete (J3), patches (J4),
insert-if-absent (J5), validation (K1, K2, K5), integrity (K6), listings (H1-H3), dedupe (G2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.constants import (BRANCH_PATTERN, CREDENTIAL_KEYS, GIT_SOURCE_TYPES, MAX_BRANCH_LENGTH,
                                   MAX_CREDENTIAL_LENGTH, MAX_ID_LENGTH, MAX_NAME_LENGTH, MAX_PATH_LENGTH,
                                   MAX_PATTERN_LENGTH, SAFE_ID_PATTERN)


def _now(now) -> Column:
    return F.lit(now).cast("timestamp") if isinstance(now, str) else now


# --------------------------------------------------------------------------- D2

def canonical_key(col, uuid_keys: bool = True) -> Column:
    """Join key for ids stored as text: canonical UUID text; malformed ids -> null
    (``uuid_keys=False``: trimmed text, blank -> null)."""
    c = F.col(col) if isinstance(col, str) else col
    s = K.py_strip(c.cast("string"))
    if not uuid_keys:
        return F.when(s != "", s)
    hexed = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "urn:|uuid:", ""), r"^\{+|\}+$", ""), "-", "")
    return F.when(hexed.rlike("^[0-9a-fA-F]{32}$"), F.lower(F.concat_ws(
        "-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.substring(hexed, 13, 4),
        F.substring(hexed, 17, 4), F.substring(hexed, 21, 12))))


def repositories_with_sources(repos: DataFrame, sources: DataFrame, uuid_keys: bool = True) -> DataFrame:
    """Each repository with its source (left outer); unparseable source ids join nothing."""
    s = sources.select(canonical_key("id", uuid_keys).alias("_sk"),
                       *[F.col(c).alias("source_" + c) for c in sources.columns if c != "id"])
    r = repos.withColumn("_rk", canonical_key("source_id", uuid_keys))
    j = r.join(s, r["_rk"] == s["_sk"], "left")
    return j.withColumn("source_found", F.col("_sk").isNotNull()).drop("_rk", "_sk")


# --------------------------------------------------------------------------- J1

def upsert_sources(requests: DataFrame, sources: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Apply a batch of source-create requests (ordered by ``req_seq``) to the registry.

    uri known, same user -> ``updated`` (name, status ``pending``, updated_at); uri known,
    other user -> ``conflict`` (no change); uri new -> ``inserted`` by its first requester,
    later requests for it update or conflict the same way. Non-Git types still write but
    are flagged ``valid_type = false`` (no sync starts). Requests with ``metadata`` replace the
    source's. All steps are aggregates and
    equi-joins on ``uri`` — no per-uri sort, so a hot uri is reduced map-side.
    Returns (snapshot, outcomes).
    """
    now_c = _now(now)
    more = ["metadata"] if "metadata" in requests.columns else []
    req = requests.select("req_seq", "user_id", "type", "uri", "name")
    first = req.groupBy("uri").agg(F.min(F.struct("req_seq", "user_id", "type", "name")).alias("_first"))
    existing = sources.select("uri", F.col("user_id").alias("_owner_existing"))
    own = (first.join(existing, "uri", "left")
           .select("uri", F.coalesce("_owner_existing", "_first.user_id").alias("_owner"),
                   F.col("_owner_existing").isNull().alias("_new"), F.col("_first.req_seq").alias("_first_seq")))
    o = req.join(own, "uri", "inner")
    outcome = (F.when(F.col("_new") & (F.col("req_seq") == F.col("_first_seq")), "inserted")
                .when(F.col("user_id") == F.col("_owner"), "updated")
                .otherwise("conflict"))
    outcomes = o.select("req_seq", "user_id", "type", "uri", "name", outcome.alias("outcome"),
                        F.col("type").isin(*GIT_SOURCE_TYPES).alias("valid_type"))
    # Final state per uri: the last accepted request wins name/status/updated_at.
    acc = outcomes.filter(F.col("outcome") != "conflict")
    if more:
        acc = acc.join(requests.select("req_seq", "metadata"), "req_seq")
    last = acc.groupBy("uri").agg(F.max(F.struct("req_seq", "name", *more)).alias("_last"),
                                  F.max(F.when(F.col("outcome") == "inserted", F.struct("user_id", "type"))).alias("_ins"))
    snap = sources.join(last, "uri", "full_outer")
    touched = F.col("_last").isNotNull()
    new_id = F.coalesce(F.col("id").cast("string"), K.uuid5_oid(F.col("uri")))
    snapshot = snap.select(
        new_id.alias("id"),
        F.coalesce(F.col("user_id"), F.col("_ins.user_id")).alias("user_id"),
        F.coalesce(F.col("type"), F.col("_ins.type")).alias("type"),
        "uri",
        F.when(touched, F.col("_last.name")).otherwise(F.col("name")).alias("name"),
        F.when(touched, F.lit("pending")).otherwise(F.col("status")).alias("status"),
        F.when(touched, now_c).otherwise(F.col("updated_at") if "updated_at" in sources.columns
                                         else F.lit(None).cast("timestamp")).alias("updated_at"),
        *([F.when(touched, F.col("_last.metadata")).otherwise(
            F.col("metadata") if "metadata" in sources.columns else F.lit(None)).alias("metadata")] if more else []))
    return snapshot, outcomes


def upsert_repositories_of_sources(requests: DataFrame, outcomes: DataFrame, snapshot: DataFrame, repos: DataFrame,
                                   now, default_branch: str = "main") -> DataFrame:
    """J1, repository side: the repository registry after a batch of source-create requests.

    Accepted requests of a Git type write the repository of their uri, the earliest of those that
    share it. Without one, the first such request inserts it (owner, provider, name, branch) and
    later ones rename it and set the branch. With one, the request that inserts the source sets
    status and source id only; every request that updates the source also sets name and updated_at
    and resets the branch to its own or ``default_branch``. ``source_id`` is the id of the source row
    in ``snapshot`` (the sources after the batch), whoever made it. ``repos``: id, user_id, name,
    provider, url, branch, source_id, status, created_at, updated_at.
    """
    now_c = _now(now)
    ok = outcomes.filter((F.col("outcome") != "conflict") & F.col("valid_type")).select("req_seq", "outcome")
    r = requests.join(ok, "req_seq").withColumn("branch", F.coalesce(F.nullif("branch", F.lit("")), F.lit(default_branch)))
    written = F.struct("req_seq", "name", "branch")
    asked = (r.groupBy(F.col("uri").alias("_uri"))
             .agg(F.min(F.struct("req_seq", "user_id", "type")).alias("_f"), F.max(written).alias("_last"),
                  F.max(F.when(F.col("outcome") == "updated", written)).alias("_upd"))
             .join(snapshot.select(F.col("uri").alias("_uri"), F.col("id").cast("string").alias("_sid")), "_uri"))
    base = repos.withColumn("id", F.col("id").cast("string")).withColumn("source_id", F.col("source_id").cast("string"))
    target = base.groupBy(F.col("url").alias("_uri")).agg(F.min(F.struct("created_at", "id")).alias("_t")).select(
        "_uri", F.col("_t.id").alias("_target"))
    asked = asked.join(target, "_uri", "left")
    hits = asked.filter(F.col("_target").isNotNull()).select("_target", "_sid", "_upd")
    hit, upd = F.col("_target").isNotNull(), F.col("_upd").isNotNull()
    kept = base.join(hits, base["id"] == hits["_target"], "left").withColumns({
        "name": F.when(upd, F.col("_upd.name")).otherwise(F.col("name")),
        "branch": F.when(upd, F.col("_upd.branch")).otherwise(F.col("branch")),
        "source_id": F.when(hit, F.col("_sid")).otherwise(F.col("source_id")),
        "status": F.when(hit, F.lit("pending")).otherwise(F.col("status")),
        "updated_at": F.when(upd, now_c).otherwise(F.col("updated_at"))}).select(*base.columns)
    new = asked.filter(F.col("_target").isNull()).select(
        K.uuid5_oid(F.concat(F.lit("repository:"), F.col("_uri"))).alias("id"), F.col("_f.user_id").alias("user_id"),
        F.col("_last.name").alias("name"), F.col("_f.type").alias("provider"), F.col("_uri").alias("url"),
        F.col("_last.branch").alias("branch"), F.col("_sid").alias("source_id"), F.lit("pending").alias("status"),
        now_c.alias("created_at"), now_c.alias("updated_at"))
    return kept.unionByName(new.select(*base.columns))


# --------------------------------------------------------------------------- J2

def upsert_repositories(requests: DataFrame, repos: DataFrame, now, mode: str = "suffix") -> tuple[DataFrame, DataFrame]:
    """Per (user, normalised URL): an existing repository (the earliest one) gets status
    ``validation_in_progress`` and, when the request names one, a new source id; else the
    first request inserts it and later ones update it. Returns (snapshot, outcomes) —
    outcomes carry ``delta`` (+1 per insert) for the repo-count ledger.
    """
    now_c = _now(now)
    per = ["user_id", "_norm"]
    req = requests.withColumn("_norm", K.norm_url("url", mode)).withColumn("source_id", F.col("source_id").cast("string"))
    # One aggregate per side and key, joined once: the first request (it inserts), the latest
    # non-empty source id in request order, and the earliest repository (it is updated).
    named = F.col("source_id").isNotNull() & (F.col("source_id") != "")
    asked = req.filter(F.col("user_id").isNotNull()).groupBy(*per).agg(
        F.min(F.struct("req_seq", "name", "provider", "url", "branch", "source_id")).alias("_first"),
        F.max(F.when(named, F.struct("req_seq", F.col("source_id").alias("sid")))).alias("_s"))
    target = (repos.groupBy("user_id", K.norm_url("url", mode).alias("_norm"))
              .agg(F.min(F.struct("created_at", "id")).alias("_t"))
              .select(*per, F.col("_t.id").cast("string").alias("_target_id")))
    keyed = asked.join(target, per, "left")
    new_id = K.uuid5_oid(F.concat_ws("|", F.col("user_id"), F.col("_norm")))
    inserted = F.col("_target_id").isNull() & (F.col("req_seq") == F.col("_first.req_seq"))
    outcomes = req.select("req_seq", "url", *per).join(keyed.select(*per, "_first", "_target_id"), per).select(
        "req_seq", "user_id", "url", F.coalesce("_target_id", new_id).alias("repository_id"),
        F.when(inserted, "inserted").otherwise("updated").alias("outcome"),
        F.when(inserted, 1).otherwise(0).alias("delta"), F.col("_target_id").isNotNull().alias("existing"))
    ins_rows = keyed.filter(F.col("_target_id").isNull()).select(
        new_id.alias("id"), "user_id", F.col("_first.name").alias("name"), F.col("_first.provider").alias("provider"),
        F.col("_first.url").alias("url"), F.coalesce("_first.branch", F.lit("main")).alias("branch"),
        F.coalesce("_s.sid", "_first.source_id").alias("source_id"),
        F.lit("validation_in_progress").alias("status"), now_c.alias("created_at"), now_c.alias("updated_at"))
    hits = keyed.filter(F.col("_target_id").isNotNull()).select(F.col("_target_id").alias("_hit"), F.col("_s.sid").alias("_sid"))
    base = repos.withColumn("id", F.col("id").cast("string")).withColumn("source_id", F.col("source_id").cast("string"))
    hit = F.col("_hit").isNotNull()
    changed = {"source_id": F.when(hit, F.coalesce("_sid", "source_id")).otherwise(F.col("source_id")),
               "status": F.when(hit, F.lit("validation_in_progress")).otherwise(F.col("status"))}
    if "updated_at" in base.columns:
        changed["updated_at"] = F.when(hit, now_c).otherwise(F.col("updated_at"))
    kept = base.join(hits, base["id"] == hits["_hit"], "left").withColumns(changed)
    cols = [c for c in base.columns if c in ins_rows.columns]
    return kept.select(*cols).unionByName(ins_rows.select(*cols)), outcomes


# --------------------------------------------------------------------------- J3

def cascade_delete(victims: DataFrame, repos: DataFrame, sources: DataFrame, nodes: DataFrame,
                   side_tables: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete repositories named in ``victims`` (column ``id``) and everything hanging off them.

    The source with id = repository.source_id goes (by uri when no source id is set); the
    graph groups {repository id, source id} owned by the repository's user lose their
    nodes (``Repository`` label by node id, all other labels by source id); side tables
    lose rows by source id. One ``groups`` frame drives every delete as a left-anti join
    (broadcast when the victim list is small). Returns (new tables, deleted counts).
    """
    v = repos.join(victims.select("id").distinct(), "id", "left_semi")
    owner = F.coalesce(F.col("user_id").cast("string"), F.lit("system"))
    groups = (v.select(F.col("id").cast("string").alias("group_id"), owner.alias("owner_id"))
              .unionByName(v.filter(F.col("source_id").isNotNull())
                           .select(F.col("source_id").cast("string").alias("group_id"), owner.alias("owner_id")))
              .distinct())
    new: dict[str, DataFrame] = {}
    counts = []
    new["repositories"] = repos.join(v.select("id"), "id", "left_anti")
    counts.append(v.select(F.lit("repositories").alias("table_name")))
    by_id = v.filter(F.col("source_id").isNotNull()).select(F.col("source_id").cast("string").alias("_sid"))
    by_uri = v.filter(F.col("source_id").isNull()).select(F.col("url").alias("_uri"))
    s = sources.withColumn("_sid", F.col("id").cast("string"))
    gone_src = (s.join(by_id, "_sid", "left_semi")
                .unionByName(s.join(by_uri, s["uri"] == by_uri["_uri"], "left_semi")).select("id").distinct())
    new["sources"] = sources.join(gone_src, "id", "left_anti")
    counts.append(gone_src.select(F.lit("sources").alias("table_name")))
    key = F.when(F.col("label") == "Repository", F.col("node_id")).otherwise(F.col("source_id")).cast("string")
    nk = nodes.withColumn("group_id", key).withColumn("_owner", F.col("owner_id").cast("string"))
    g = groups.withColumnRenamed("owner_id", "_owner")
    new["nodes"] = nk.join(g, ["group_id", "_owner"], "left_anti").drop("group_id", "_owner")
    counts.append(nk.join(g, ["group_id", "_owner"], "left_semi")
                  .select(F.concat(F.lit("node:"), F.col("label")).alias("table_name")))
    for name, t in (side_tables or {}).items():
        tk = t.withColumn("group_id", F.col("source_id").cast("string"))
        gid = groups.select("group_id").distinct()
        new[name] = tk.join(gid, "group_id", "left_anti").drop("group_id")
        counts.append(tk.join(gid, "group_id", "left_semi").select(F.lit(name).alias("table_name")))
    allc = counts[0]
    for c in counts[1:]:
        allc = allc.unionByName(c)
    return new, allc.groupBy("table_name").agg(F.count(F.lit(1)).alias("deleted"))


# --------------------------------------------------------------------------- J4 / J5

def patch_rows(cur: DataFrame, patch: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Non-null patch fields win; patches for unknown keys change nothing."""
    p = patch.select(F.col(key).alias("_pk"), *[F.col(c).alias("_p_" + c) for c in cols])
    j = cur.join(p, cur[key] == p["_pk"], "left")
    return j.select(*[F.coalesce(F.col("_p_" + c), F.col(c)).alias(c) if c in cols else F.col(c) for c in cur.columns])


def insert_if_absent(cur: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """MERGE ... ON CREATE — rows of ``new`` whose key is absent are appended once;
    existing rows stay untouched."""
    fresh = new.join(cur.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return cur.unionByName(fresh.select(*cur.columns))


# --------------------------------------------------------------------------- K1 / K2 / K5 / K6

def _errors(*checks: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(msg)) for c, msg in checks]), lambda x: x.isNotNull())


def _cleaned(stripped: str, default_all: bool) -> Column:
    kept = F.filter(F.col(stripped), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, kept).otherwise(
        F.array(F.lit("**/*")) if default_all else F.array().cast("array<string>"))


def _source_id_checks(requests: DataFrame) -> list[tuple[Column, str]]:
    """Source ids (when the requests carry one): required, <= 255 after stripping, safe characters."""
    if "source_id" not in requests.columns:
        return []
    raw = F.col("source_id").cast("string")
    sid = K.py_strip(raw)
    return [(raw.isNull() | (raw == ""), "source_id_required"),
            (F.length(sid) > MAX_ID_LENGTH, "source_id_too_long"),
            (raw.isNotNull() & (raw != "") & ~sid.rlike(SAFE_ID_PATTERN), "source_id_invalid")]


def validate_sources(requests: DataFrame) -> DataFrame:
    """K1: ``errors`` (all failed checks, in order), ``first_error`` and the cleaned
    ``uri``/``branch``/``include_patterns``/``exclude_patterns``.

    name required and <= 255; Git types: URL with http(s) scheme and a host, branch
    <= 255 matching ``[a-zA-Z0-9._/-]+``; other types: non-blank uri; patterns <= 1000
    chars, blanks dropped, include defaults to ``**/*``, exclude to none; credentials:
    known keys must be strings of <= 10000 chars.
    """
    empty = F.array().cast("array<string>")
    creds = F.col("credentials") if "credentials" in requests.columns else F.lit(None).cast("map<string,string>")
    # Used many times below: columns of their own, computed once a row.
    r = requests.withColumns({
        "_uri": K.py_strip("uri"), "_branch": K.py_strip("branch"), "_name": K.py_strip("name"),
        "_git": F.lower(F.col("type")).isin("github", "gitlab", "bitbucket"),
        "_inc": F.transform(F.coalesce(F.col("include_patterns"), empty), K.py_strip),
        "_exc": F.transform(F.coalesce(F.col("exclude_patterns"), empty), K.py_strip)})
    r = r.withColumn("_url", F.when(F.col("_git"), F.struct(
        F.lower(F.regexp_extract("_uri", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).alias("scheme"),
        F.regexp_extract("_uri", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1).alias("netloc"))))
    is_git, uri, branch = F.col("_git"), F.col("_uri"), F.col("_branch")
    scheme, netloc = F.col("_url.scheme"), F.col("_url.netloc")
    too_long = lambda a: F.exists(a, lambda x: F.length(x) > MAX_PATTERN_LENGTH)
    bad_cred = F.exists(F.map_entries(F.coalesce(creds, F.create_map().cast("map<string,string>"))),
                        lambda e: e["key"].isin(*CREDENTIAL_KEYS) & (e["value"].isNull() |
                                                                     (F.length(e["value"]) > MAX_CREDENTIAL_LENGTH)))
    there = F.col("branch").isNotNull()
    errs = _errors(
        (F.col("name").isNull() | (F.col("_name") == ""), "name_required"),
        (F.coalesce(F.length("name") > MAX_NAME_LENGTH, F.lit(False)), "name_too_long"),
        (is_git & (uri.isNull() | (scheme == "") | (netloc == "")), "invalid_url"),
        (is_git & (scheme != "") & (netloc != "") & ~scheme.isin("http", "https"), "url_scheme"),
        (~is_git & (uri.isNull() | (uri == "")), "uri_required"),
        (is_git & there & (F.length(branch) > MAX_BRANCH_LENGTH), "branch_too_long"),
        (is_git & there & ~F.coalesce(branch.rlike(BRANCH_PATTERN), F.lit(False)), "branch_invalid"),
        (too_long(F.col("_inc")), "include_pattern_too_long"),
        (too_long(F.col("_exc")), "exclude_pattern_too_long"),
        (bad_cred, "invalid_credentials"),
        *_source_id_checks(requests),
    )
    out = r.withColumns({"errors": errs, "clean_uri": uri, "clean_branch": F.when(is_git & (branch != ""), branch),
                         "clean_include": _cleaned("_inc", True), "clean_exclude": _cleaned("_exc", False)})
    return out.withColumn("first_error", F.try_element_at("errors", F.lit(1))).select(
        *requests.columns, "errors", "first_error", "clean_uri", "clean_branch", "clean_include", "clean_exclude")


def validate_paths(files: DataFrame, path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """K2: a path must be non-empty, contain no ``..``, not start with ``/`` and be at most
    1000 characters after stripping. Returns (ok, quarantined with ``reason``)."""
    raw = F.col(path_col)
    p = K.py_strip(raw)
    reason = (F.when(raw.isNull() | (raw == ""), "path_required")
               .when(p.contains("..") | p.startswith("/"), "path_traversal")
               .when(F.length(p) > MAX_PATH_LENGTH, "path_too_long"))
    x = files.withColumn("reason", reason)
    return (x.filter(F.col("reason").isNull()).drop("reason").withColumn(path_col, p),
            x.filter(F.col("reason").isNotNull()))


def validate_credentials(df: DataFrame, map_col: str = "credentials") -> DataFrame:
    """K5: keep only the four known keys, values trimmed; ``credential_errors`` lists keys
    whose value is missing or over 10000 characters."""
    m = F.coalesce(F.col(map_col), F.create_map().cast("map<string,string>"))
    known = F.map_filter(m, lambda k, v: k.isin(*CREDENTIAL_KEYS))
    bad = F.filter(F.map_keys(F.map_filter(known, lambda k, v: v.isNull() | (F.length(v) > MAX_CREDENTIAL_LENGTH))),
                   lambda x: x.isNotNull())
    return df.withColumns({"valid_credentials": F.transform_values(known, lambda k, v: K.py_strip(v)),
                           "credential_errors": F.array_sort(bad)})


def registry_integrity(sources: DataFrame, repos: DataFrame) -> DataFrame:
    """K6: ``duplicate_uri`` (uri held by several sources), ``repo_without_source`` (source id
    set but unknown), ``source_without_repo`` (Git source with no repository on its uri)."""
    dup = (sources.groupBy("uri").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
           .select(F.lit("duplicate_uri").alias("kind"), F.col("uri").alias("ref")))
    rs = repos.filter(F.col("source_id").isNotNull()).select("id", F.col("source_id").cast("string").alias("_sid"))
    orphan = (rs.join(sources.select(F.col("id").cast("string").alias("_sid")), "_sid", "left_anti")
              .select(F.lit("repo_without_source").alias("kind"), F.col("id").cast("string").alias("ref")))
    lonely = (sources.filter(F.col("type").isin(*GIT_SOURCE_TYPES))
              .join(repos.select(F.col("url").alias("uri")), "uri", "left_anti")
              .select(F.lit("source_without_repo").alias("kind"), F.col("id").cast("string").alias("ref")))
    return dup.unionByName(orphan).unionByName(lonely)


# --------------------------------------------------------------------------- H1-H3, G2

def _check_page(limit: int, offset: int) -> None:
    if not (1 <= limit <= 1000):
        raise ValueError(f"page size {limit} is not in 1..1000")
    if not (0 <= offset <= 10000):
        raise ValueError(f"page start {offset} is not in 0..10000")


def list_jobs(jobs: DataFrame, source_id=None, status: str | None = None, limit: int = 50, offset: int = 0,
              order: tuple[str, str] = ("created_at", "id")) -> tuple[DataFrame, DataFrame]:
    """H1: filtered page, newest first (id breaks ties), plus the true match count
    (the surveyed listing reported the page length as the total)."""
    _check_page(limit, offset)
    f = jobs
    if source_id is not None:
        f = f.filter(F.col("source_id") == source_id)
    if status is not None:
        f = f.filter(F.col("status") == status)
    page = f.orderBy(F.desc(order[0]), F.asc(order[1])).offset(offset).limit(limit)
    total = f.agg(F.count(F.lit(1)).alias("total_matches"))
    return page, total


def list_sources(sources: DataFrame, user_id: str, type: str | None = None, limit: int = 50, offset: int = 0,
                 order: tuple[str, str] = ("created_at", "id")) -> DataFrame:
    """H2: one user's sources, optional type, deterministic newest-first page."""
    _check_page(limit, offset)
    f = sources.filter(F.col("user_id") == user_id)
    if type is not None:
        f = f.filter(F.col("type") == type)
    return f.orderBy(F.desc(order[0]), F.asc(order[1])).offset(offset).limit(limit)


def top_repositories(repos: DataFrame, sort: str = "updated_at", per_key: list[str] | None = None,
                     n: int = 100, tiebreak: str = "id") -> DataFrame:
    """H3: the ``n`` first repositories by ``sort`` (``name`` ascending, others newest first),
    globally or per key. ``row_number() <= n`` gets a partial WindowGroupLimit."""
    o = [F.asc(sort) if sort == "name" else F.desc(sort), F.asc(tiebreak)]
    if not per_key:
        return repos.orderBy(*o).limit(n)
    w = Window.partitionBy(*per_key).orderBy(*o)
    return repos.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def dedupe_repositories(repos: DataFrame, mode: str = "suffix", order: tuple[str, str] = ("created_at", "id")
                        ) -> tuple[DataFrame, DataFrame]:
    """Per user and normalised URL keep the newest row (id breaks ties); list the
    dropped duplicates with the id that was kept."""
    x = repos.withColumn("norm_url", K.norm_url("url", mode))
    w = Window.partitionBy("user_id", "norm_url").orderBy(F.desc(order[0]), F.asc(order[1]))
    kept = x.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    k = kept.select("user_id", "norm_url", F.col("id").alias("kept_id"))
    dropped = x.join(k, ["user_id", "norm_url"], "inner").filter(F.col("id") != F.col("kept_id"))
    return kept, dropped
