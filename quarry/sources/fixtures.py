"""Derived input views over the driver tables.

The service we mirror ships no data, so every job's input is *derived* from the
driver's tables (documents, orders, lineitem, customer, events, ...) by one SQL text
that both Spark and DuckDB run. Each view reads a whole table — no id subsets or
row caps — so its size grows with the scale factor.

``SHA256_HEX(x)`` is the one dialect difference: ``sha2(x, 256)`` in Spark,
``sha256(x)`` in DuckDB. ``@name`` refers to a driver table or another view.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")

VIEWS: dict[str, str] = {}

VIEWS["fx_files"] = """
SELECT doc_id, source AS repo_id,
       concat(CASE doc_id % 6 WHEN 0 THEN 'src' WHEN 1 THEN 'docs' WHEN 2 THEN 'src/lib'
                              WHEN 3 THEN 'node_modules/x' WHEN 4 THEN 'assets' ELSE 'tests' END,
              '/', lang, '/f', CAST(doc_id AS varchar(20)),
              CASE doc_id % 12 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.rs' WHEN 3 THEN '.js'
                   WHEN 4 THEN '.png' WHEN 5 THEN '.PY' WHEN 6 THEN '.tar.gz' WHEN 7 THEN '.pdf'
                   WHEN 8 THEN '' WHEN 9 THEN '.yaml' WHEN 10 THEN '.txt' ELSE '.bin' END) AS path,
       n_chars AS size, SHA256_HEX(text) AS sha
FROM @documents
"""

# Both snapshots hold every file; they differ by path/sha rewrites:
#   doc % 7 = 0  : old copy lives under gone/ with another sha  -> removed + added
#   doc % 11 = 0 : new copy lives under fresh/ with another sha -> removed + added
#   doc % 17 = 0 : new copy lives under moved/, same sha        -> renamed
#   doc % 13 = 0 : same path, new sha                           -> modified
VIEWS["fx_snap_old"] = """
SELECT doc_id, repo_id,
       CASE WHEN doc_id % 7 = 0 THEN concat('gone/', path) ELSE path END AS path,
       CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN concat('o', sha) ELSE sha END AS sha,
       size
FROM @fx_files
"""

VIEWS["fx_snap_new"] = """
SELECT doc_id, repo_id,
       CASE WHEN doc_id % 11 = 0 THEN concat('fresh/', path)
            WHEN doc_id % 17 = 0 THEN concat('moved/', path) ELSE path END AS path,
       CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN concat('n', sha)
            WHEN doc_id % 13 = 0 AND doc_id % 17 <> 0 THEN concat('x', sha) ELSE sha END AS sha,
       CASE WHEN doc_id % 46 = 0 THEN size + 1 ELSE size END AS size
FROM @fx_files
"""

VIEWS["fx_commit_files"] = """
SELECT concat('repo_', CAST(o.o_custkey % 50 AS varchar(20))) AS repo_id, o.o_orderkey AS commit_seq,
       o.o_orderdate AS commit_ts, l.l_linenumber AS file_seq,
       concat('src/p', CAST(l.l_partkey % 200 AS varchar(20)), '.py') AS path,
       CASE WHEN l.l_returnflag = 'A' THEN 'added' WHEN l.l_returnflag = 'R' THEN 'removed'
            WHEN l.l_linestatus = 'O' THEN 'modified' ELSE 'renamed' END AS status,
       CASE WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'F'
            THEN concat('src/old', CAST(l.l_partkey % 200 AS varchar(20)), '.py') END AS previous_path,
       concat('b', CAST(o.o_custkey % 3 AS varchar(20))) AS branch,
       SHA256_HEX(CAST(o.o_orderkey AS varchar(20))) AS commit_sha,
       concat('dev', CAST(o.o_custkey % 17 AS varchar(20))) AS author
FROM @orders o JOIN @lineitem l ON l.l_orderkey = o.o_orderkey
"""

VIEWS["fx_repositories"] = """
SELECT c_custkey AS id, concat('user_', CAST(c_custkey % 8 AS varchar(20))) AS user_id,
       concat('https://', CASE c_custkey % 3 WHEN 0 THEN 'github.com' WHEN 1 THEN 'gitlab.com' ELSE 'bitbucket.org' END,
              CASE WHEN c_custkey % 5 = 0 THEN '/Org' ELSE '/org' END, CAST(c_nationkey % 4 AS varchar(20)), '/',
              lower(c_mktsegment),
              CASE c_custkey % 4 WHEN 0 THEN '.git' WHEN 1 THEN '/' WHEN 2 THEN '' ELSE '.git/' END) AS url,
       CASE c_custkey % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'bitbucket' END AS provider,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 700 END AS source_id,
       c_custkey AS created_seq, concat('repo-', CAST(c_custkey AS varchar(20))) AS name, 'main' AS branch,
       CASE WHEN c_acctbal < 0 THEN 'sync_failed' ELSE 'active' END AS status, c_custkey % 97 AS created_at,
       c_acctbal < 0 AS in_debt,
       CASE WHEN c_acctbal > 5000 THEN TIMESTAMP '2024-01-01 00:00:00' END AS last_sync
FROM @customer
"""

VIEWS["fx_sources"] = """
SELECT c_custkey AS id, concat('user_', CAST(c_custkey % 8 AS varchar(20))) AS user_id,
       CASE c_custkey % 4 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'bitbucket' ELSE 'url' END AS type,
       concat('https://host/', CAST(c_custkey AS varchar(20))) AS uri,
       c_name AS name, 'active' AS status
FROM @customer
"""

# Requests for every order: a third point at a uri no source has (insert), one in six
# comes from another user (conflict when the uri exists), type 'url' is not a Git type.
VIEWS["fx_source_requests"] = """
SELECT o_orderkey AS req_seq,
       concat('user_', CAST((o_custkey + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END) % 8 AS varchar(20))) AS user_id,
       CASE o_custkey % 4 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'bitbucket' ELSE 'url' END AS type,
       concat('https://host/', CAST(o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 100000000 ELSE 0 END AS varchar(20))) AS uri,
       o_orderpriority AS name
FROM @orders
"""

VIEWS["fx_jobs"] = """
SELECT o_orderkey AS id, o_custkey AS source_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
       CASE o_custkey % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'bitbucket' END AS source_type,
       o_orderdate AS created_at, CAST(o_orderkey % 40 AS int) AS processed_files,
       CAST(o_custkey % 40 AS int) AS total_files, o_totalprice AS duration_s
FROM @orders
"""

# One status event per line item of an order: pending, processing, routing, ..., and the
# order's own outcome on its last line.
VIEWS["fx_job_status_events"] = """
SELECT l.l_orderkey AS job_id, l.l_linenumber AS seq, l.l_shipdate AS ts,
       CASE WHEN l.l_linenumber = 1 THEN 'pending'
            WHEN l.l_linenumber = 2 THEN 'processing'
            WHEN l.l_linenumber = 3 THEN 'routing'
            WHEN l.l_returnflag = 'R' THEN 'failed'
            WHEN l.l_returnflag = 'A' THEN 'completed'
            ELSE 'processing' END AS status,
       CAST(floor(l.l_quantity) AS int) AS processed_files
FROM @lineitem l
"""

VIEWS["fx_access_log"] = """
SELECT event_id AS seq, ts, concat('u', CAST(user_id % 3 AS varchar(20))) AS client,
       CASE event_type WHEN 'click' THEN '/api/search' WHEN 'view' THEN '/api/sources'
            WHEN 'purchase' THEN '/api/sources/1/sync' WHEN 'signup' THEN '/api/v1/sync/jobs' ELSE '/health' END AS path,
       CASE event_type WHEN 'click' THEN 'GET' WHEN 'view' THEN 'GET' ELSE 'POST' END AS method,
       CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status, value AS latency_ms,
       CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS varchar(20)) END AS auth_user,
       CASE event_id % 5 WHEN 0 THEN concat(' 10.0.', CAST(user_id % 7 AS varchar(20)), '.1 , 172.16.0.1')
                         WHEN 1 THEN ', 10.9.9.9' WHEN 2 THEN '' END AS forwarded_for,
       CASE WHEN event_id % 3 = 0 THEN concat('192.168.0.', CAST(user_id % 5 AS varchar(20))) END AS real_ip,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('h', CAST(user_id % 9 AS varchar(20))) END AS host
FROM @events
"""

VIEWS["fx_send_log"] = """
SELECT user_id AS sync_id, event_id AS seq,
       CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'skip' ELSE 'ok' END AS outcome
FROM @events
"""

VIEWS["fx_attempts"] = """
SELECT concat(CAST(user_id AS varchar(20)), '-', CAST(CAST(ts AS date) AS varchar(20))) AS request_id,
       ts, event_id AS seq,
       CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 502 WHEN 'view' THEN 404 ELSE 200 END AS status,
       CASE WHEN event_type = 'click' AND event_id % 10 = 0 THEN 'timeout' END AS error_kind
FROM @events
"""

VIEWS["fx_webhooks"] = """
SELECT event_id AS delivery_id, ts AS received_at,
       CASE event_id % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'bitbucket' END AS provider,
       CASE WHEN event_type = 'signup' THEN 'ping' ELSE 'push' END AS event_name,
       concat('src', CAST(user_id % 40 AS varchar(20))) AS source_id,
       CASE event_id % 3
         WHEN 0 THEN concat('{"ref":"refs/heads/b', CAST(user_id % 4 AS varchar(20)), '","before":"',
              substr(SHA256_HEX(CAST(event_id AS varchar(20))), 1, CASE WHEN event_id % 50 = 0 THEN 7 ELSE 40 END),
              '","after":"', substr(SHA256_HEX(CAST(event_id + 1 AS varchar(20))), 1, 40),
              '","repository":{"clone_url":"https://github.com/org/r', CAST(user_id AS varchar(20)), '.git"}}')
         WHEN 1 THEN concat('{"object_kind":', CASE WHEN event_type = 'signup' THEN '"tag_push"' ELSE '"push"' END,
              ',"ref":"refs/heads/main","before":"', substr(SHA256_HEX(CAST(event_id AS varchar(20))), 1, 40),
              '","after":"', substr(SHA256_HEX(CAST(event_id + 1 AS varchar(20))), 1, 40),
              '","project":{"git_http_url":"https://gitlab.com/org/r', CAST(user_id AS varchar(20)), '.git"}}')
         ELSE concat('{"repository":{"links":{"html":{"href":"https://bitbucket.org/org/r', CAST(user_id AS varchar(20)),
              '"}}},"push":{"changes":[{"old":',
              CASE WHEN event_id % 50 = 2 THEN 'null'
                   ELSE concat('{"target":{"hash":"', substr(SHA256_HEX(CAST(event_id AS varchar(20))), 1, 12), '"}}') END,
              ',"new":{"name":"main","target":{"hash":"', substr(SHA256_HEX(CAST(event_id + 1 AS varchar(20))), 1, 12),
              '"}}}]}}') END AS body
FROM @events
"""

# Repositories whose URLs collide with webhook pushes (about 7 registrations per URL,
# several spellings), and their credential index.
VIEWS["fx_hook_repos"] = """
SELECT c_custkey AS id, concat('user_', CAST(c_custkey % 8 AS varchar(20))) AS user_id,
       CASE c_custkey % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'bitbucket' END AS provider,
       concat('https://', CASE c_custkey % 3 WHEN 0 THEN 'github.com' WHEN 1 THEN 'gitlab.com' ELSE 'bitbucket.org' END,
              '/org/r', CAST(c_custkey % 200 AS varchar(20)),
              CASE c_custkey % 4 WHEN 0 THEN '.git' WHEN 1 THEN '/' WHEN 2 THEN '' ELSE '.git/' END) AS url,
       c_custkey % 97 AS created_at
FROM @customer
"""

VIEWS["fx_credentials"] = """
SELECT CASE WHEN c_custkey % 6 = 0 THEN c_custkey + 100000000 ELSE c_custkey END AS repo_id,
       concat('user_', CAST(c_custkey % 8 AS varchar(20))) AS user_id,
       CASE WHEN c_custkey % 10 = 1 THEN 'github' ELSE
            CASE c_custkey % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'bitbucket' END END AS provider,
       CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2023-06-01 00:00:00'
            ELSE TIMESTAMP '2025-01-01 00:00:00' END AS expires_at
FROM @customer
"""

# Per-file processing results of an ingest (one per line item): chunks, time, size, success.
VIEWS["fx_file_results"] = """
SELECT concat('repo_', CAST(o.o_custkey % 50 AS varchar(20))) AS repo_id, o.o_orderkey AS commit_id,
       l.l_linenumber AS file_seq, CAST(floor(l.l_quantity) AS INT) AS chunks,
       CAST(floor(l.l_extendedprice) AS BIGINT) % 5000 AS duration_ms, CAST(floor(l.l_extendedprice * 10) AS BIGINT) AS size_bytes,
       l.l_returnflag <> 'R' AS ok,
       CASE WHEN l.l_discount < 0.03 THEN 'TIMEOUT' WHEN l.l_discount < 0.06 THEN 'PARSE_ERROR' ELSE 'UPSTREAM_5XX' END AS error_code,
       l.l_tax > 0.05 AS fatal, l.l_linenumber AS retry_count
FROM @orders o JOIN @lineitem l ON l.l_orderkey = o.o_orderkey
"""

VIEWS["fx_file_events"] = """
SELECT commit_seq * 100 + file_seq AS off, commit_ts, repo_id, path AS file_path, status = 'removed' AS is_deleted,
       CASE WHEN status = 'removed' THEN '' ELSE concat(path, '@', CAST(commit_seq AS varchar(20))) END AS content
FROM @fx_commit_files
"""

VIEWS["fx_file_chunks"] = """
SELECT conv_id AS file_id, CAST(turn AS int) AS chunk_index,
       CAST(n.total AS int) AS total_chunks, text AS chunk_data
FROM @conversations c JOIN (SELECT conv_id AS of_conv, count(*) AS total FROM @conversations GROUP BY conv_id) n
  ON n.of_conv = c.conv_id
"""

VIEWS["fx_chunks"] = """
SELECT d.doc_id AS chunk_id, d.source AS file_id, d.lang AS chunk_type, d.n_chars AS size,
       e.vec_id IS NOT NULL AS embedded, e.embedding AS embedding
FROM @documents d LEFT JOIN @embeddings e ON e.vec_id = d.doc_id
"""

VIEWS["fx_nodes"] = """
SELECT CASE p_partkey % 4 WHEN 0 THEN 'Repository' WHEN 1 THEN 'File' WHEN 2 THEN 'Function' ELSE 'Vector_Chunk' END AS label,
       p_partkey AS node_id, p_partkey % 700 AS source_id, concat('user_', CAST(p_partkey % 8 AS varchar(20))) AS owner_id
FROM @part
"""


_REF = re.compile(r"@([a-z_]+)")


def dependencies(name: str) -> list[str]:
    """Fixture views a view reads, in dependency order (driver tables excluded)."""
    out: list[str] = []
    for ref in _REF.findall(VIEWS[name]):
        if ref in VIEWS:
            for d in dependencies(ref) + [ref]:
                if d not in out:
                    out.append(d)
    return out


def driver_tables_read(name: str) -> set[str]:
    """Driver tables a view reads, directly or through other views."""
    out: set[str] = set()
    for ref in _REF.findall(VIEWS[name]):
        out |= driver_tables_read(ref) if ref in VIEWS else {ref}
    return out


def _rewrite_sha(sql: str, dialect: str) -> str:
    key = "SHA256_HEX("
    while key in sql:
        start = sql.index(key)
        i, depth = start + len(key), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = sql[start + len(key):i - 1]
        repl = f"sha2({inner}, 256)" if dialect == "spark" else f"sha256({inner})"
        sql = sql[:start] + repl + sql[i:]
    return sql


def render(name: str, dialect: str, resolve=lambda n: n) -> str:
    return _REF.sub(lambda m: resolve(m.group(1)), _rewrite_sha(VIEWS[name], dialect))


def duckdb_with(names: list[str], body: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` and their dependencies (DuckDB text)."""
    order: list[str] = []
    for n in names:
        for d in dependencies(n) + [n]:
            if d not in order:
                order.append(d)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({render(n, 'duckdb')})" for n in order)
    if body[:4].upper() == "WITH" and body[4:5].isspace():
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan of a whole table."""
    return spark.read.parquet(path)


class Fixtures:
    """Spark side: reads the driver tables of one scale-factor folder and builds views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tag = "q" + hashlib.md5(self.sf_dir.encode()).hexdigest()[:8]
        self._registered: set[str] = set()

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.sf_dir}/{name}.parquet")

    def _view_name(self, name: str) -> str:
        if name not in self._registered:
            if name in DRIVER_TABLES:
                self.table(name).createOrReplaceTempView(f"{self._tag}_{name}")
            else:
                self.spark.sql(render(name, "spark", self._view_name)) \
                    .createOrReplaceTempView(f"{self._tag}_{name}")
            self._registered.add(name)
        return f"{self._tag}_{name}"

    def derive(self, name: str, **inputs: DataFrame) -> DataFrame:
        """Build view ``name`` over replacement inputs (e.g. a streaming ``events`` table).

        Driver tables named in ``inputs`` are read from the given DataFrames; every
        other reference resolves as usual. Used to run the same derivation on streams.
        """
        tag = self._tag + "s" + hashlib.md5(repr(sorted(inputs)).encode()).hexdigest()[:6]
        done: dict[str, str] = {}

        def resolve(ref: str) -> str:
            if ref in done:
                return done[ref]
            if ref in inputs:
                inputs[ref].createOrReplaceTempView(f"{tag}_{ref}")
                done[ref] = f"{tag}_{ref}"
            elif ref in VIEWS and driver_tables_read(ref) & set(inputs):
                self.spark.sql(render(ref, "spark", resolve)).createOrReplaceTempView(f"{tag}_{ref}")
                done[ref] = f"{tag}_{ref}"
            else:
                done[ref] = self._view_name(ref)
            return done[ref]

        return self.spark.sql(render(name, "spark", resolve))

    def view(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.table(name)
        return self.spark.table(self._view_name(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("fx_") or name in DRIVER_TABLES:
            return self.view(name)
        raise AttributeError(name)
