"""Registered jobs: registry joins, upserts, deletes, validation, listings, dedupe
(D2, J1-J5, K1, K2, K5, K6, H1-H3, G2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as ops
from ..sources.fixtures import Fixtures
from .catalog import register

NOW = "2024-01-15 00:00:00"
NORM = "lower(regexp_replace(regexp_replace({u}, '/+$', ''), '\\.git$', ''))"
PYSTRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@register("d2_repositories_with_sources", views=["fx_repositories", "fx_sources"], oracle="""
SELECT r.id, r.source_id, s.type AS source_type, s.uri AS source_uri, s.id IS NOT NULL AS source_found
FROM fx_repositories r LEFT JOIN fx_sources s ON CAST(s.id AS VARCHAR) = CAST(r.source_id AS VARCHAR)""")
def d2_repositories_with_sources(spark, sf_dir):
    """Repositories with their sources (left outer)."""
    fx = Fixtures(spark, sf_dir)
    out = ops.repositories_with_sources(fx.fx_repositories, fx.fx_sources, uuid_keys=False)
    return out.select("id", "source_id", "source_type", "source_uri", "source_found")


UUID_SQL = """substr(md5({x}), 1, 8) || '-' || substr(md5({x}), 9, 4) || '-' || substr(md5({x}), 13, 4) || '-' ||
          substr(md5({x}), 17, 4) || '-' || substr(md5({x}), 21, 12)"""


@register("d2_repositories_with_sources_uuid", views=["fx_repositories", "fx_sources"], oracle=f"""
WITH s AS (SELECT *, {UUID_SQL.format(x="CAST(id AS VARCHAR)")} AS key FROM fx_sources),
r AS (SELECT *, CASE WHEN id % 10 <> 0 THEN {UUID_SQL.format(x="CAST(source_id AS VARCHAR)")} END AS key FROM fx_repositories)
SELECT r.id, s.uri AS source_uri, s.type AS source_type, s.key IS NOT NULL AS source_found
FROM r LEFT JOIN s ON s.key = r.key""")
def d2_repositories_with_sources_uuid(spark, sf_dir):
    """Ids as UUIDs in several spellings (upper case, without dashes, in braces, as a URN); one
    repository in ten has a source id that is no UUID and joins nothing."""
    fx = Fixtures(spark, sf_dir)
    hexed = lambda c: F.md5(F.col(c).cast("string"))
    dashed = lambda h: F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    h, k = hexed("source_id"), F.col("id") % 10
    spelled = (F.when(k == 0, F.concat(F.lit("not-"), h)).when(k < 3, h).when(k < 5, F.upper(dashed(h)))
               .when(k < 7, F.concat(F.lit("{"), dashed(h), F.lit("}"))).when(k < 9, F.concat(F.lit("urn:uuid:"), dashed(h)))
               .otherwise(F.concat(F.lit(" "), dashed(h))))
    out = ops.repositories_with_sources(fx.fx_repositories.withColumn("source_id", spelled),
                                        fx.fx_sources.withColumn("id", dashed(hexed("id"))))
    return out.select("id", "source_uri", "source_type", "source_found")


@register("a7_registry_read", views=["fx_repositories"], oracle="""
SELECT CAST(id AS VARCHAR) AS id, url, provider, status, CAST(source_id AS VARCHAR) AS source_id, last_sync
FROM fx_repositories WHERE provider = 'github'""")
def a7_registry_read(spark, sf_dir):
    """A registry table landed as parquet and read with its declared schema."""
    from ..session import checkpoint_path
    from ..sources.registry import read_registry
    r = Fixtures(spark, sf_dir).fx_repositories
    base = checkpoint_path(spark, "a7", unique=True)
    r.select(F.col("id").cast("string").alias("id"), "user_id", "name", "provider", "url", "branch", "status",
             F.col("source_id").cast("string").alias("source_id"), F.col("last_sync").cast("timestamp").alias("last_sync")) \
        .write.parquet(f"{base}/repositories")
    out = read_registry(spark, base, "repositories").filter(F.col("provider") == "github")
    return out.select("id", "url", "provider", "status", "source_id", F.col("last_sync").cast("timestamp_ntz").alias("last_sync"))


J1_SQL = """
req AS (SELECT req_seq, user_id, type, uri, name FROM fx_source_requests),
first AS (SELECT uri, arg_min(user_id, req_seq) AS first_user, min(req_seq) AS first_seq FROM req GROUP BY uri),
own AS (SELECT f.uri, coalesce(s.user_id, f.first_user) AS owner, s.user_id IS NULL AS is_new, f.first_seq
        FROM first f LEFT JOIN fx_sources s ON s.uri = f.uri),
oc AS (SELECT r.*, CASE WHEN o.is_new AND r.req_seq = o.first_seq THEN 'inserted'
                        WHEN r.user_id = o.owner THEN 'updated' ELSE 'conflict' END AS outcome,
              r.type IN ('github', 'gitlab', 'bitbucket') AS valid_type
       FROM req r JOIN own o ON o.uri = r.uri)"""


@register("j1_upsert_outcomes", views=["fx_source_requests", "fx_sources"], oracle=f"WITH {J1_SQL.strip()}\nSELECT * FROM oc")
def j1_upsert_outcomes(spark, sf_dir):
    """Outcome of every source-create request."""
    fx = Fixtures(spark, sf_dir)
    _, outcomes = ops.upsert_sources(fx.fx_source_requests, fx.fx_sources, NOW)
    return outcomes


@register("j1_upsert_sources", views=["fx_source_requests", "fx_sources"], oracle=f"""
WITH {J1_SQL.strip()},
acc AS (SELECT * FROM oc WHERE outcome <> 'conflict'),
last AS (SELECT uri, arg_max(name, req_seq) AS last_name FROM acc GROUP BY uri),
ins AS (SELECT uri, user_id, type FROM acc WHERE outcome = 'inserted')
SELECT coalesce(s.user_id, i.user_id) AS user_id, coalesce(s.type, i.type) AS type, coalesce(s.uri, l.uri) AS uri,
       CASE WHEN l.uri IS NOT NULL THEN l.last_name ELSE s.name END AS name,
       CASE WHEN l.uri IS NOT NULL THEN 'pending' ELSE s.status END AS status,
       CASE WHEN l.uri IS NOT NULL THEN TIMESTAMP '{NOW}' END AS updated_at,
       s.id IS NULL AS is_new
FROM fx_sources s FULL OUTER JOIN last l ON l.uri = s.uri LEFT JOIN ins i ON i.uri = l.uri""")
def j1_upsert_sources(spark, sf_dir):
    """Source registry after a batch of requests."""
    fx = Fixtures(spark, sf_dir)
    snap, _ = ops.upsert_sources(fx.fx_source_requests, fx.fx_sources, NOW)
    existing = fx.fx_sources.select(F.col("id").cast("string").alias("id"), F.lit(False).alias("is_new"))
    snap = snap.join(existing, "id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(True)))
    return snap.select("user_id", "type", "uri", "name", "status", "updated_at", "is_new")


#: UUIDv5 text of a name whose SHA-1 with the OID name space is ``h``.
UUID5_SQL = """concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3),
                  substr('89ab89ab89ab89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) + 1, 1) || substr(h, 18, 3), substr(h, 21, 12))"""


def _with_metadata(fx: Fixtures):
    """Source requests; one in four names a branch, all carry metadata."""
    return (fx.fx_source_requests.withColumn("branch", F.when(F.col("req_seq") % 4 == 0, F.lit("release")))
            .withColumn("metadata", F.concat(F.lit('{"seq":'), F.col("req_seq").cast("string"), F.lit("}"))))


def _repos_on_sources(fx: Fixtures):
    """Repositories of every third customer on the uri of its source, some of them held twice, all
    on a branch of their own."""
    c, k = fx.customer, F.col("c_custkey")
    rows = c.filter(k % 3 != 1).withColumn("_n", F.explode(F.when(k % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        F.concat_ws("-", F.lit("r"), k, "_n").alias("id"), F.concat(F.lit("owner_"), (k % 3).cast("string")).alias("user_id"),
        F.concat(F.lit("repo-"), k).alias("name"), F.lit("github").alias("provider"),
        F.concat(F.lit("https://host/"), k + F.when(k % 4 == 0, 100000000).otherwise(0)).alias("url"), F.lit("dev").alias("branch"),
        F.lit(None).cast("string").alias("source_id"), F.lit("active").alias("status"),
        F.timestamp_seconds(k % 97 - F.col("_n")).alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))


J1_REPO_SQL = f"""
{J1_SQL.strip()},
repos AS (SELECT 'r-' || c_custkey || '-' || n AS id, 'owner_' || (c_custkey % 3) AS user_id, 'repo-' || c_custkey AS name,
                 'github' AS provider, 'https://host/' || (c_custkey + CASE WHEN c_custkey % 4 = 0 THEN 100000000 ELSE 0 END) AS url,
                 'dev' AS branch, NULL AS source_id, 'active' AS status, c_custkey % 97 - n AS created, NULL AS updated
          FROM customer, (VALUES (0), (1)) t(n) WHERE c_custkey % 3 <> 1 AND (n = 0 OR c_custkey % 5 = 0)),
acc AS (SELECT *, CASE WHEN req_seq % 4 = 0 THEN 'release' ELSE 'main' END AS br FROM oc WHERE outcome <> 'conflict' AND valid_type),
ask AS (SELECT uri, arg_min(user_id, req_seq) AS fu, arg_min(type, req_seq) AS ft, arg_max(name, req_seq) AS ln, arg_max(br, req_seq) AS lb,
               arg_max(name, req_seq) FILTER (WHERE outcome = 'updated') AS un,
               arg_max(br, req_seq) FILTER (WHERE outcome = 'updated') AS ub FROM acc GROUP BY uri),
oid AS (SELECT DISTINCT uri, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(uri)) AS h FROM acc),
srcid AS (SELECT o.uri, coalesce(CAST(s.id AS VARCHAR), {{uuid}}) AS sid FROM oid o LEFT JOIN fx_sources s ON s.uri = o.uri),
tgt AS (SELECT url, arg_min(id, (created, id)) AS target FROM repos GROUP BY url),
kept AS (SELECT r.user_id, coalesce(a.un, r.name) AS name, r.provider, r.url, coalesce(a.ub, r.branch) AS branch,
                i.sid AS source_id, CASE WHEN t.target IS NOT NULL THEN 'pending' ELSE r.status END AS status,
                a.un IS NOT NULL AS stamped, FALSE AS is_new
         FROM repos r LEFT JOIN (SELECT target, url FROM tgt WHERE url IN (SELECT uri FROM ask)) t ON t.target = r.id
         LEFT JOIN ask a ON a.uri = t.url LEFT JOIN srcid i ON i.uri = t.url),
ins AS (SELECT a.fu, a.ln, a.ft, a.uri, a.lb, i.sid, 'pending', TRUE, TRUE FROM ask a JOIN srcid i ON i.uri = a.uri
        WHERE a.uri NOT IN (SELECT url FROM repos))
SELECT * FROM kept UNION ALL SELECT * FROM ins"""


@register("j1_upsert_repositories_side", views=["fx_source_requests", "fx_sources"], oracle="WITH " + J1_REPO_SQL.format(uuid=UUID5_SQL))
def j1_upsert_repositories_side(spark, sf_dir):
    """The repository registry after a batch of source requests: rows inserted, existing ones
    claimed by their source, renamed and put back to a branch."""
    fx = Fixtures(spark, sf_dir)
    req = _with_metadata(fx)
    snapshot, outcomes = ops.upsert_sources(req, fx.fx_sources, NOW)
    out = ops.upsert_repositories_of_sources(req, outcomes, snapshot, _repos_on_sources(fx), NOW)
    return out.select("user_id", "name", "provider", "url", "branch", "source_id", "status",
                      F.col("updated_at").isNotNull().alias("stamped"), (~F.col("id").startswith("r-")).alias("is_new"))


@register("j1_source_metadata", views=["fx_source_requests", "fx_sources"], oracle=f"""
WITH {J1_SQL.strip()}
SELECT uri, '{{"seq":' || CAST(max(req_seq) AS VARCHAR) || '}}' AS metadata FROM oc WHERE outcome <> 'conflict' GROUP BY uri""")
def j1_source_metadata(spark, sf_dir):
    """The metadata that a batch of source requests leaves at the sources it touches."""
    fx = Fixtures(spark, sf_dir)
    snapshot, _ = ops.upsert_sources(_with_metadata(fx), fx.fx_sources, NOW)
    return snapshot.filter("metadata IS NOT NULL").select("uri", "metadata")


@register("j1_registry_versions", views=["fx_source_requests", "fx_sources"], oracle="WITH " + J1_REPO_SQL.format(uuid=UUID5_SQL).replace(
    "\nSELECT * FROM kept UNION ALL SELECT * FROM ins", """,
repos2 AS (SELECT * FROM kept UNION ALL SELECT * FROM ins),
touched AS (SELECT DISTINCT uri FROM oc WHERE outcome <> 'conflict'),
sid2 AS (SELECT DISTINCT uri, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(uri)) AS h FROM touched),
sources2 AS (SELECT CAST(id AS VARCHAR) AS id, uri, uri IN (SELECT uri FROM touched) AS pending FROM fx_sources
             UNION ALL SELECT """ + UUID5_SQL + """, uri, TRUE FROM sid2 WHERE uri NOT IN (SELECT uri FROM fx_sources)),
gone AS (SELECT * FROM repos2 WHERE user_id = 'owner_2'),
sources3 AS (SELECT * FROM sources2 WHERE id NOT IN (SELECT source_id FROM gone WHERE source_id IS NOT NULL)
             AND uri NOT IN (SELECT url FROM gone WHERE source_id IS NULL))
SELECT 1 AS version, 'sources' AS table_name, count(*) AS n, 0::BIGINT AS pending FROM fx_sources
UNION ALL SELECT 1, 'repositories', count(*), 0 FROM repos
UNION ALL SELECT 2, 'sources', count(*), count(*) FILTER (WHERE pending) FROM sources2
UNION ALL SELECT 2, 'repositories', count(*), count(*) FILTER (WHERE status = 'pending') FROM repos2
UNION ALL SELECT 3, 'sources', count(*), count(*) FILTER (WHERE pending) FROM sources3
UNION ALL SELECT 3, 'repositories', count(*), count(*) FILTER (WHERE status = 'pending') FROM repos2 WHERE user_id <> 'owner_2'"""))
def j1_registry_versions(spark, sf_dir):
    """J1 and J3 as versions of a store: sources and repositories change in one commit each, and a
    reader of an earlier version still sees that one."""
    from ..session import checkpoint_path
    from ..sources import versioned as V
    fx = Fixtures(spark, sf_dir)
    path, n = checkpoint_path(spark, "registry", unique=True), {"sources": 4, "repositories": 4}
    keys = {"sources": ["uri"], "repositories": ["id"]}
    none = F.lit(None)
    sources = fx.fx_sources.select(F.col("id").cast("string").alias("id"), "user_id", "type", "uri", "name", "status",
                                   none.cast("timestamp").alias("updated_at"), none.cast("string").alias("metadata"))
    v1 = V.commit(V.snapshot(spark, path), {"sources": V.Change(replace=sources), "repositories": V.Change(
        replace=_repos_on_sources(fx))}, keys, n)
    req = _with_metadata(fx)
    after, outcomes = ops.upsert_sources(req, v1.read("sources"), NOW)
    repos = ops.upsert_repositories_of_sources(req, outcomes, after, v1.read("repositories"), NOW)
    v2 = V.commit(v1, {"sources": V.Change(upserts=after.filter("updated_at IS NOT NULL")),
                       "repositories": V.Change(upserts=repos.filter("status = 'pending'"))}, keys, n)
    victims = v2.read("repositories").filter("user_id = 'owner_2'").select("id")
    nodes = spark.createDataFrame([], "label string, node_id string, source_id string, owner_id string")
    left, _ = ops.cascade_delete(victims, v2.read("repositories"), v2.read("sources"), nodes)
    gone = {t: v2.read(t).join(left[t].select("id"), "id", "left_anti").select(*keys[t]) for t in keys}
    v3 = V.commit(v2, {t: V.Change(deletes=gone[t]) for t in keys}, keys, n)
    counts = [V.snapshot(spark, path, v.version).read(t).agg(
        F.lit(v.version).alias("version"), F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "pending").alias("pending")) for v in (v1, v2, v3) for t in keys]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def _repo_requests(fx: Fixtures):
    o, c = fx.orders, fx.customer
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    k = F.col("o_custkey")
    url = F.concat(F.lit("https://"), F.when(k % 3 == 0, "github.com").when(k % 3 == 1, "gitlab.com").otherwise("bitbucket.org"),
                   F.when(k % 5 == 0, "/Org").otherwise("/org"), (F.col("c_nationkey") % 4).cast("string"), F.lit("/"),
                   F.lower("c_mktsegment"),
                   F.when(F.col("o_orderkey") % 4 == 0, "").when(F.col("o_orderkey") % 4 == 1, ".git")
                   .when(F.col("o_orderkey") % 4 == 2, "/").otherwise(".GIT"))
    return j.select(F.col("o_orderkey").alias("req_seq"), F.concat(F.lit("user_"), (k % 8).cast("string")).alias("user_id"),
                    F.col("o_orderpriority").alias("name"),
                    F.when(k % 3 == 0, "github").when(k % 3 == 1, "gitlab").otherwise("bitbucket").alias("provider"),
                    url.alias("url"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("dev")).alias("branch"),
                    F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("src-"), F.col("o_orderkey").cast("string"))).alias("source_id"))


REPO_REQ_SQL = f"""
rq AS (SELECT o.o_orderkey AS req_seq, 'user_' || CAST(o.o_custkey % 8 AS VARCHAR) AS user_id, o.o_orderpriority AS name,
              CASE o.o_custkey % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'bitbucket' END AS provider,
              concat('https://', CASE o.o_custkey % 3 WHEN 0 THEN 'github.com' WHEN 1 THEN 'gitlab.com' ELSE 'bitbucket.org' END,
                     CASE WHEN o.o_custkey % 5 = 0 THEN '/Org' ELSE '/org' END, CAST(c.c_nationkey % 4 AS VARCHAR), '/',
                     lower(c.c_mktsegment), CASE o.o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.git' WHEN 2 THEN '/' ELSE '.GIT' END) AS url,
              CASE WHEN o.o_orderkey % 2 = 0 THEN 'dev' END AS branch,
              CASE WHEN o.o_orderkey % 3 = 0 THEN 'src-' || CAST(o.o_orderkey AS VARCHAR) END AS source_id
       FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
rqn AS (SELECT *, {NORM.format(u='url')} AS k FROM rq),
cur AS (SELECT *, {NORM.format(u='url')} AS k FROM fx_repositories),
tgt AS (SELECT user_id, k, arg_min(id, (created_at, id)) AS target_id FROM cur GROUP BY user_id, k),
fst AS (SELECT user_id, k, min(req_seq) AS first_seq FROM rqn GROUP BY user_id, k),
rr AS (SELECT rqn.*, t.target_id, f.first_seq FROM rqn LEFT JOIN tgt t ON t.user_id = rqn.user_id AND t.k = rqn.k
       JOIN fst f ON f.user_id = rqn.user_id AND f.k = rqn.k)"""


@register("j2_upsert_outcomes", views=["fx_repositories"], oracle=f"""
WITH {REPO_REQ_SQL.strip()}
SELECT req_seq, user_id, url, target_id IS NULL AND req_seq = first_seq AS inserted,
       CASE WHEN target_id IS NULL AND req_seq = first_seq THEN 'inserted' ELSE 'updated' END AS outcome,
       CASE WHEN target_id IS NULL AND req_seq = first_seq THEN 1 ELSE 0 END AS delta,
       CAST(target_id AS VARCHAR) AS existing_id FROM rr""")
def j2_upsert_outcomes(spark, sf_dir):
    """Outcome of every repository-create request."""
    fx = Fixtures(spark, sf_dir)
    repos = fx.fx_repositories.withColumn("created_at", F.timestamp_seconds("created_at"))
    _, out = ops.upsert_repositories(_repo_requests(fx), repos, NOW)
    return out.select("req_seq", "user_id", "url", (F.col("outcome") == "inserted").alias("inserted"), "outcome", "delta",
                      F.when(F.col("existing"), F.col("repository_id")).alias("existing_id"))


@register("j2_upsert_repositories", views=["fx_repositories"], oracle=f"""
WITH {REPO_REQ_SQL.strip()},
sid AS (SELECT user_id, k, arg_max(source_id, req_seq) AS sid FROM rqn WHERE source_id IS NOT NULL AND source_id <> '' GROUP BY user_id, k),
touched AS (SELECT t.target_id, s.sid FROM tgt t JOIN fst f ON f.user_id = t.user_id AND f.k = t.k
            LEFT JOIN sid s ON s.user_id = t.user_id AND s.k = t.k),
kept AS (SELECT r.user_id, r.url, r.provider, r.branch,
                CASE WHEN t.target_id IS NOT NULL THEN coalesce(t.sid, CAST(r.source_id AS VARCHAR)) ELSE CAST(r.source_id AS VARCHAR) END AS source_id,
                CASE WHEN t.target_id IS NOT NULL THEN 'validation_in_progress' ELSE r.status END AS status, FALSE AS is_new
         FROM fx_repositories r LEFT JOIN touched t ON t.target_id = r.id),
ins AS (SELECT rr.user_id, rr.url, rr.provider, coalesce(rr.branch, 'main') AS branch, coalesce(s.sid, rr.source_id) AS source_id,
               'validation_in_progress' AS status, TRUE AS is_new
        FROM rr LEFT JOIN sid s ON s.user_id = rr.user_id AND s.k = rr.k WHERE rr.target_id IS NULL AND rr.req_seq = rr.first_seq)
SELECT * FROM kept UNION ALL SELECT * FROM ins""")
def j2_upsert_repositories(spark, sf_dir):
    """Repository registry after a batch of requests."""
    fx = Fixtures(spark, sf_dir)
    repos = fx.fx_repositories.select("id", "user_id", "name", "provider", "url", "branch", "status", "source_id",
                                      F.timestamp_seconds("created_at").alias("created_at"),
                                      F.lit(None).cast("timestamp").alias("updated_at"))
    snap, _ = ops.upsert_repositories(_repo_requests(fx), repos, NOW)
    existing = repos.select(F.col("id").cast("string").alias("_eid"))
    snap = snap.join(existing, snap["id"].cast("string") == existing["_eid"], "left")
    return snap.select("user_id", "url", "provider", "branch", "source_id", "status",
                       F.col("_eid").isNull().alias("is_new"))


@register("j3_cascade_delete", views=["fx_repositories", "fx_sources", "fx_nodes", "fx_jobs"], oracle="""
WITH v AS (SELECT * FROM fx_repositories WHERE in_debt),
g AS (SELECT DISTINCT CAST(id AS VARCHAR) AS group_id, user_id AS owner_id FROM v
      UNION SELECT DISTINCT CAST(source_id AS VARCHAR), user_id FROM v WHERE source_id IS NOT NULL),
src AS (SELECT DISTINCT s.id FROM fx_sources s WHERE CAST(s.id AS VARCHAR) IN (SELECT CAST(source_id AS VARCHAR) FROM v WHERE source_id IS NOT NULL)
        OR s.uri IN (SELECT url FROM v WHERE source_id IS NULL)),
nd AS (SELECT n.label FROM fx_nodes n JOIN g ON g.group_id = CAST(CASE WHEN n.label = 'Repository' THEN n.node_id ELSE n.source_id END AS VARCHAR)
       AND g.owner_id = n.owner_id),
jb AS (SELECT 1 FROM fx_jobs j WHERE CAST(j.source_id AS VARCHAR) IN (SELECT group_id FROM g))
SELECT 'repositories' AS table_name, count(*) AS deleted FROM v
UNION ALL SELECT 'sources', count(*) FROM src HAVING count(*) > 0
UNION ALL SELECT 'node:' || label, count(*) FROM nd GROUP BY label
UNION ALL SELECT 'processing_jobs', count(*) FROM jb HAVING count(*) > 0""")
def j3_cascade_delete(spark, sf_dir):
    """Repositories of customers in debt are deleted with everything hanging off them."""
    fx = Fixtures(spark, sf_dir)
    repos = fx.fx_repositories
    victims = repos.filter(F.col("in_debt")).select("id")
    _, counts = ops.cascade_delete(victims, repos, fx.fx_sources, fx.fx_nodes, {"processing_jobs": fx.fx_jobs})
    return counts


LABELS = ("Repository", "File", "Function", "Class", "Vector_Chunk", "Commit", "Branch", "Document", "User")


@register("j3_cascade_delete_all", views=["fx_repositories", "fx_sources", "fx_jobs", "fx_chunks"], oracle=f"""
WITH v AS (SELECT * FROM fx_repositories WHERE in_debt),
nodes AS (SELECT [{", ".join("'" + x + "'" for x in LABELS)}][p_partkey % 9 + 1] AS label, p_partkey AS node_id,
                 p_partkey % 700 AS source_id, CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE 'user_' || CAST(p_partkey % 700 % 8 AS VARCHAR) END AS owner_id
          FROM part),
g AS (SELECT DISTINCT id AS group_id, user_id AS owner_id FROM v UNION SELECT DISTINCT source_id, user_id FROM v WHERE source_id IS NOT NULL),
src AS (SELECT DISTINCT s.id FROM fx_sources s WHERE s.id IN (SELECT source_id FROM v WHERE source_id IS NOT NULL)
        OR s.uri IN (SELECT url FROM v WHERE source_id IS NULL)),
nd AS (SELECT n.label FROM nodes n JOIN g ON g.group_id = CASE WHEN n.label = 'Repository' THEN n.node_id ELSE n.source_id END
       AND g.owner_id = n.owner_id),
t AS (SELECT 'repositories' AS table_name FROM v UNION ALL SELECT 'sources' FROM src UNION ALL SELECT 'node:' || label FROM nd
      UNION ALL SELECT 'processing_jobs' FROM fx_jobs WHERE source_id IN (SELECT group_id FROM g)
      UNION ALL SELECT 'file_metadata' FROM orders WHERE o_custkey IN (SELECT group_id FROM g)
      UNION ALL SELECT 'chunk_snapshot' FROM fx_chunks WHERE chunk_id IN (SELECT group_id FROM g))
SELECT table_name, count(*) AS deleted FROM t GROUP BY table_name""")
def j3_cascade_delete_all(spark, sf_dir):
    """Nine node labels and three side tables."""
    fx = Fixtures(spark, sf_dir)
    p = F.col("p_partkey")
    nodes = fx.part.select(
        F.element_at(F.array(*[F.lit(x) for x in LABELS]), (p % 9 + 1).cast("int")).alias("label"), p.alias("node_id"),
        (p % 700).alias("source_id"), F.when(p % 5 == 0, F.lit("other")).otherwise(
            F.concat(F.lit("user_"), (p % 700 % 8).cast("string"))).alias("owner_id"))
    repos = fx.fx_repositories
    side = {"processing_jobs": fx.fx_jobs, "file_metadata": fx.orders.withColumnRenamed("o_custkey", "source_id"),
            "chunk_snapshot": fx.fx_chunks.withColumnRenamed("chunk_id", "source_id")}
    _, counts = ops.cascade_delete(repos.filter("in_debt").select("id"), repos, fx.fx_sources, nodes, side)
    return counts


@register("j4_patch_rows", views=["fx_repositories"], oracle="""
WITH p AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN c_name END AS name,
                  CASE WHEN c_mktsegment = 'BUILDING' THEN 'paused' END AS status,
                  CASE WHEN c_nationkey = 3 THEN 'release' END AS branch
           FROM customer WHERE c_acctbal > 2000)
SELECT r.id, coalesce(p.name, r.name) AS name, coalesce(p.branch, r.branch) AS branch, coalesce(p.status, r.status) AS status, r.url
FROM fx_repositories r LEFT JOIN p ON p.id = r.id""")
def j4_patch_rows(spark, sf_dir):
    """Patch requests (one per customer with balance over 2000; nulls leave fields alone)."""
    fx = Fixtures(spark, sf_dir)
    c = fx.customer.filter(F.col("c_acctbal") > 2000)
    patch = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 5000, F.col("c_name")).alias("name"),
                     F.when(F.col("c_mktsegment") == "BUILDING", F.lit("paused")).alias("status"),
                     F.when(F.col("c_nationkey") == 3, F.lit("release")).alias("branch"))
    out = ops.patch_rows(fx.fx_repositories, patch, "id", ["name", "branch", "status"])
    return out.select("id", "name", "branch", "status", "url")


@register("j5_insert_if_absent", views=["fx_nodes", "fx_repositories"], oracle="""
WITH new AS (SELECT DISTINCT 'Repository' AS label, id AS node_id, source_id, user_id AS owner_id FROM fx_repositories)
SELECT label, node_id, source_id, owner_id FROM fx_nodes
UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM fx_nodes x WHERE x.label = n.label AND x.node_id = n.node_id)""")
def j5_insert_if_absent(spark, sf_dir):
    """Repository graph nodes inserted only when absent."""
    fx = Fixtures(spark, sf_dir)
    new = fx.fx_repositories.select(F.lit("Repository").alias("label"), F.col("id").alias("node_id"), "source_id",
                                    F.col("user_id").alias("owner_id"))
    return ops.insert_if_absent(fx.fx_nodes, new, ["label", "node_id"])


def _k1_requests(fx: Fixtures):
    o = fx.orders
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(ok % 11 == 0, F.lit("   ")).when(ok % 11 == 1, F.repeat(F.lit("n"), 256)).otherwise(F.col("o_orderpriority"))
    typ = (F.when(ck % 5 == 0, "github").when(ck % 5 == 1, "gitlab").when(ck % 5 == 2, "bitbucket")
            .when(ck % 5 == 3, "url").otherwise("notion"))
    uri = (F.when(ok % 7 == 0, F.lit("ftp://host/x")).when(ok % 7 == 1, F.lit("github.com/o/r"))
            .when(ok % 7 == 2, F.lit("  https://github.com/o/r  ")).when(ok % 7 == 3, F.lit(""))
            .when(ok % 7 == 4, F.lit("HTTPS://GitHub.com/o/r"))
            .otherwise(F.concat(F.lit("https://host/"), ck.cast("string"))))
    branch = (F.when(ok % 9 == 0, F.lit(None)).when(ok % 9 == 1, F.lit("feature/x-1")).when(ok % 9 == 2, F.lit("bad branch"))
               .when(ok % 9 == 3, F.lit(" ")).when(ok % 9 == 4, F.repeat(F.lit("b"), 256)).otherwise(F.lit("main")))
    pats = lambda m: (F.when(m == 0, F.lit(None).cast("array<string>")).when(m == 1, F.array(F.lit("  "), F.lit("")))
                      .when(m == 2, F.array(F.lit("src/**"), F.lit(" docs/* "))).when(m == 3, F.array(F.repeat(F.lit("x"), 1001)))
                      .otherwise(F.array(F.lit("**/*"))))
    creds = (F.when(ok % 4 == 0, F.create_map(F.lit("access_token"), F.lit(" tok "), F.lit("other"), F.lit("x")))
              .when(ok % 4 == 1, F.create_map(F.lit("refresh_token"), F.repeat(F.lit("r"), 10001))))
    return o.select(ok.alias("req_seq"), name.alias("name"), typ.alias("type"), uri.alias("uri"), branch.alias("branch"),
                    pats(ok % 5).alias("include_patterns"), pats(ok % 6).alias("exclude_patterns"), creds.alias("credentials"))


def _pats_sql(m):
    return (f"CASE {m} WHEN 0 THEN NULL WHEN 1 THEN ['  ', ''] WHEN 2 THEN ['src/**', ' docs/* '] "
            f"WHEN 3 THEN [repeat('x', 1001)] ELSE ['**/*'] END")


@register("k1_validate_sources", oracle=f"""
WITH r AS (SELECT o_orderkey AS req_seq,
  CASE WHEN o_orderkey % 11 = 0 THEN '   ' WHEN o_orderkey % 11 = 1 THEN repeat('n', 256) ELSE o_orderpriority END AS name,
  CASE o_custkey % 5 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'bitbucket' WHEN 3 THEN 'url' ELSE 'notion' END AS type,
  CASE o_orderkey % 7 WHEN 0 THEN 'ftp://host/x' WHEN 1 THEN 'github.com/o/r' WHEN 2 THEN '  https://github.com/o/r  '
       WHEN 3 THEN '' WHEN 4 THEN 'HTTPS://GitHub.com/o/r' ELSE 'https://host/' || CAST(o_custkey AS VARCHAR) END AS uri,
  CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'feature/x-1' WHEN 2 THEN 'bad branch' WHEN 3 THEN ' '
       WHEN 4 THEN repeat('b', 256) ELSE 'main' END AS branch,
  {_pats_sql('o_orderkey % 5')} AS include_patterns, {_pats_sql('o_orderkey % 6')} AS exclude_patterns,
  o_orderkey % 4 AS cred_kind FROM orders),
s AS (SELECT *, {PYSTRIP.format(x='uri')} AS su, {PYSTRIP.format(x='branch')} AS sb,
             type IN ('github', 'gitlab', 'bitbucket') AS is_git FROM r),
u AS (SELECT *, lower(regexp_extract(su, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme,
             regexp_extract(su, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) AS netloc FROM s),
e AS (SELECT *, list_filter([
   CASE WHEN name IS NULL OR length({PYSTRIP.format(x='name')}) = 0 THEN 'name_required' END,
   CASE WHEN length(name) > 255 THEN 'name_too_long' END,
   CASE WHEN is_git AND (scheme = '' OR netloc = '') THEN 'invalid_url' END,
   CASE WHEN is_git AND scheme <> '' AND netloc <> '' AND scheme NOT IN ('http', 'https') THEN 'url_scheme' END,
   CASE WHEN NOT is_git AND (su IS NULL OR su = '') THEN 'uri_required' END,
   CASE WHEN is_git AND branch IS NOT NULL AND length(sb) > 255 THEN 'branch_too_long' END,
   CASE WHEN is_git AND branch IS NOT NULL AND NOT coalesce(regexp_matches(sb, '^[a-zA-Z0-9._/-]+$'), FALSE) THEN 'branch_invalid' END,
   CASE WHEN list_bool_or(list_transform(coalesce(include_patterns, []), lambda x: length({PYSTRIP.format(x='x')}) > 1000)) THEN 'include_pattern_too_long' END,
   CASE WHEN list_bool_or(list_transform(coalesce(exclude_patterns, []), lambda x: length({PYSTRIP.format(x='x')}) > 1000)) THEN 'exclude_pattern_too_long' END,
   CASE WHEN cred_kind = 1 THEN 'invalid_credentials' END], lambda x: x IS NOT NULL) AS errors FROM u),
c AS (SELECT *, list_filter(list_transform(coalesce(include_patterns, []), lambda x: {PYSTRIP.format(x='x')}), lambda x: x <> '') AS ci,
                list_filter(list_transform(coalesce(exclude_patterns, []), lambda x: {PYSTRIP.format(x='x')}), lambda x: x <> '') AS ce FROM e)
SELECT req_seq, errors, errors[1] AS first_error, su AS clean_uri, CASE WHEN is_git AND sb <> '' THEN sb END AS clean_branch,
       CASE WHEN len(ci) > 0 THEN ci ELSE ['**/*'] END AS clean_include, ce AS clean_exclude FROM c""")
def k1_validate_sources(spark, sf_dir):
    """K1: validation errors and cleaned fields per source request."""
    out = ops.validate_sources(_k1_requests(Fixtures(spark, sf_dir)))
    return out.select("req_seq", "errors", "first_error", "clean_uri", "clean_branch", "clean_include", "clean_exclude")


_K2_PATHS = """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '../' || path WHEN 1 THEN '/' || path WHEN 2 THEN repeat('a/', 500) || 'x'
                             WHEN 3 THEN repeat('a', 1000) WHEN 4 THEN '' WHEN 5 THEN '  ' || path || ' ' WHEN 6 THEN 'a..b/' || path
                             ELSE path END AS path FROM fx_files"""


@register("k2_validate_paths", views=["fx_files"], oracle=f"""
WITH p AS ({_K2_PATHS.strip()})
SELECT doc_id, CASE WHEN path IS NULL OR path = '' THEN 'path_required'
                    WHEN contains({PYSTRIP.format(x='path')}, '..') OR starts_with({PYSTRIP.format(x='path')}, '/') THEN 'path_traversal'
                    WHEN length({PYSTRIP.format(x='path')}) > 1000 THEN 'path_too_long' END AS reason,
       {PYSTRIP.format(x='path')} AS clean_path FROM p""")
def k2_validate_paths(spark, sf_dir):
    """K2: path validation outcome per file."""
    f = Fixtures(spark, sf_dir).fx_files
    d = F.col("doc_id") % 8
    path = (F.when(d == 0, F.concat(F.lit("../"), "path")).when(d == 1, F.concat(F.lit("/"), "path"))
             .when(d == 2, F.concat(F.repeat(F.lit("a/"), 500), F.lit("x"))).when(d == 3, F.repeat(F.lit("a"), 1000))
             .when(d == 4, F.lit("")).when(d == 5, F.concat(F.lit("  "), "path", F.lit(" ")))
             .when(d == 6, F.concat(F.lit("a..b/"), "path")).otherwise(F.col("path")))
    ok, bad = ops.validate_paths(f.select("doc_id", path.alias("path")))
    from ..functions.keys import py_strip
    return (ok.select("doc_id", F.lit(None).cast("string").alias("reason"), F.col("path").alias("clean_path"))
            .unionByName(bad.select("doc_id", "reason", py_strip("path").alias("clean_path"))))


@register("k5_validate_credentials", oracle="""
WITH c AS (SELECT c_custkey AS id, c_custkey % 5 AS k, c_name AS nm FROM customer)
SELECT id,
  CASE k WHEN 0 THEN MAP {'access_token': nm, 'client_id': 'cid'}
         WHEN 1 THEN MAP {'refresh_token': repeat('r', 10001)}
         WHEN 2 THEN MAP {'access_token': NULL}
         WHEN 3 THEN MAP {} ELSE MAP {'client_secret': 'abc'} END AS valid_credentials,
  CASE k WHEN 1 THEN ['refresh_token'] WHEN 2 THEN ['access_token'] ELSE [] END AS credential_errors
FROM c""")
def k5_validate_credentials(spark, sf_dir):
    """K5: known credential keys kept and checked."""
    c = Fixtures(spark, sf_dir).customer
    k = F.col("c_custkey") % 5
    m = (F.when(k == 0, F.create_map(F.lit("access_token"), F.concat(F.lit("  "), "c_name", F.lit("\t")),
                                      F.lit("client_id"), F.lit("cid"), F.lit("password"), F.lit("p")))
          .when(k == 1, F.create_map(F.lit("refresh_token"), F.repeat(F.lit("r"), 10001)))
          .when(k == 2, F.create_map(F.lit("access_token"), F.lit(None).cast("string")))
          .when(k == 3, F.lit(None).cast("map<string,string>"))
          .otherwise(F.create_map(F.lit("client_secret"), F.lit(" abc "), F.lit("scope"), F.lit("repo"))))
    out = ops.validate_credentials(c.select(F.col("c_custkey").alias("id"), m.alias("credentials")))
    return out.select("id", "valid_credentials", "credential_errors")


@register("k6_registry_integrity", views=["fx_sources", "fx_repositories"], oracle="""
SELECT 'duplicate_uri' AS kind, uri AS ref FROM fx_sources GROUP BY uri HAVING count(*) > 1
UNION ALL SELECT 'repo_without_source', CAST(r.id AS VARCHAR) FROM fx_repositories r
  WHERE r.source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_sources s WHERE s.id = r.source_id)
UNION ALL SELECT 'source_without_repo', CAST(s.id AS VARCHAR) FROM fx_sources s
  WHERE s.type IN ('git', 'github', 'gitlab', 'bitbucket') AND NOT EXISTS (SELECT 1 FROM fx_repositories r WHERE r.url = s.uri)""")
def k6_registry_integrity(spark, sf_dir):
    """K6: duplicate uris and orphaned sources / repositories."""
    fx = Fixtures(spark, sf_dir)
    return ops.registry_integrity(fx.fx_sources, fx.fx_repositories)


@register("h1_list_jobs", views=["fx_jobs"], oracle="""
SELECT id, status, created_at FROM fx_jobs WHERE status = 'completed' ORDER BY created_at DESC, id LIMIT 50 OFFSET 100""")
def h1_list_jobs(spark, sf_dir):
    """H1: page of completed jobs, newest first."""
    page, _ = ops.list_jobs(Fixtures(spark, sf_dir).fx_jobs, status="completed", limit=50, offset=100)
    return page.select("id", "status", "created_at")


@register("h1_list_jobs_total", views=["fx_jobs"], oracle="""
SELECT count(*) AS total_matches FROM fx_jobs WHERE status = 'completed'""")
def h1_list_jobs_total(spark, sf_dir):
    """H1: true number of matching jobs."""
    _, total = ops.list_jobs(Fixtures(spark, sf_dir).fx_jobs, status="completed", limit=50, offset=100)
    return total


@register("h2_list_sources", views=["fx_sources"], oracle="""
SELECT id, type, uri FROM fx_sources WHERE user_id = 'user_4' AND type = 'github' ORDER BY id DESC LIMIT 20 OFFSET 5""")
def h2_list_sources(spark, sf_dir):
    """H2: page of one user's GitHub sources."""
    out = ops.list_sources(Fixtures(spark, sf_dir).fx_sources, "user_4", type="github", limit=20, offset=5,
                           order=("id", "uri"))
    return out.select("id", "type", "uri")


@register("h3_top_repositories", views=["fx_repositories"], oracle="""
SELECT id, user_id, created_at, rank FROM (
  SELECT id, user_id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rank FROM fx_repositories)
WHERE rank <= 5""")
def h3_top_repositories(spark, sf_dir):
    """H3: five newest repositories per user."""
    out = ops.top_repositories(Fixtures(spark, sf_dir).fx_repositories, sort="created_at", per_key=["user_id"], n=5)
    return out.select("id", "user_id", "created_at", "rank")


G2_SQL = f"""
x AS (SELECT *, {NORM.format(u='url')} AS norm_url FROM fx_repositories),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, norm_url ORDER BY created_at DESC, id) AS rn,
             first_value(id) OVER (PARTITION BY user_id, norm_url ORDER BY created_at DESC, id) AS kept_id FROM x)"""


@register("g2_dedupe_kept", views=["fx_repositories"], oracle=f"WITH {G2_SQL.strip()}\nSELECT id, user_id, norm_url FROM r WHERE rn = 1")
def g2_dedupe_kept(spark, sf_dir):
    """Newest repository per user and normalised URL."""
    kept, _ = ops.dedupe_repositories(Fixtures(spark, sf_dir).fx_repositories)
    return kept.select("id", "user_id", "norm_url")


@register("g2_dedupe_dropped", views=["fx_repositories"], oracle=f"WITH {G2_SQL.strip()}\nSELECT id, user_id, url, kept_id FROM r WHERE rn > 1")
def g2_dedupe_dropped(spark, sf_dir):
    """Duplicate repositories with the id that was kept."""
    _, dropped = ops.dedupe_repositories(Fixtures(spark, sf_dir).fx_repositories)
    return dropped.select("id", "user_id", "url", "kept_id")
