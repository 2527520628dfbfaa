"""Registered jobs: webhook push path (B10, D1, D3, D4, E10, L1 batch step)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import contains
from ..operators import webhooks as ops
from ..sources.fixtures import Fixtures
from .catalog import register

NOW = "2024-01-15 00:00:00"


def duck_hmac(key_sql: str, msg_sql: str) -> str:
    """DuckDB text for hex HMAC-SHA256(key, msg): key and msg are VARCHAR expressions."""
    kh = (f"rpad(CASE WHEN octet_length(encode({key_sql})) > 64 THEN sha256(encode({key_sql})) "
          f"ELSE lower(hex(encode({key_sql}))) END, 128, '0')")

    def pad(x):
        return (f"unhex(array_to_string(list_transform(range(64), lambda i: lpad(lower(hex(xor(CAST(('0x' || "
                f"substr({kh}, 2*i+1, 2)) AS INTEGER), {x}))), 2, '0')), ''))")
    return f"sha256({pad(92)} || unhex(sha256({pad(54)} || encode({msg_sql}))))"


SECRET_SQL = """
sec AS (SELECT DISTINCT source_id, CAST(regexp_extract(source_id, '(\\d+)$', 1) AS INT) AS n FROM fx_webhooks),
secrets AS (SELECT source_id, CASE WHEN n % 7 = 0 THEN NULL WHEN n % 5 = 0 THEN repeat('k', 70) || source_id
                                   ELSE 'sec-' || source_id END AS secret FROM sec),
dl AS (SELECT w.*, s.secret, CASE WHEN w.delivery_id % 13 = 0 OR s.secret IS NULL THEN 'wrong' ELSE s.secret END AS signer
       FROM fx_webhooks w LEFT JOIN secrets s ON s.source_id = w.source_id)"""


def _secrets(fx: Fixtures):
    n = F.regexp_extract("source_id", r"(\d+)$", 1).cast("int")
    return fx.fx_webhooks.select("source_id").distinct().select(
        "source_id", F.when(n % 7 == 0, F.lit(None))
        .when(n % 5 == 0, F.concat(F.repeat(F.lit("k"), 70), F.col("source_id")))
        .otherwise(F.concat(F.lit("sec-"), F.col("source_id"))).alias("secret"))


def _deliveries(fx: Fixtures, hooks=None, secrets=None):
    """Deliveries with provider headers; one in 13 (and all without a secret) signed with a wrong key."""
    secrets = _secrets(fx) if secrets is None else secrets
    # Pads are computed once per source (for its secret and for the wrong key), not per delivery.
    si, so = K.hmac_pads(F.encode("secret", "UTF-8"))
    wi, wo = K.hmac_pads(F.encode(F.lit("wrong"), "UTF-8"))
    pads = secrets.select("source_id", "secret", si.alias("_si"), so.alias("_so"), wi.alias("_wi"), wo.alias("_wo"))
    w = (hooks if hooks is not None else fx.fx_webhooks).join(pads, "source_id", "left")
    wrong = (F.col("delivery_id") % 13 == 0) | F.col("secret").isNull()
    signer = F.when(wrong, F.lit("wrong")).otherwise(F.col("secret"))
    body = F.encode("body", "UTF-8")
    mac = K.hmac_sha256_hex(F.when(wrong, F.col("_wi")).otherwise(F.col("_si")),
                            F.when(wrong, F.col("_wo")).otherwise(F.col("_so")), body)
    p = F.col("provider")
    headers = (F.when(p == "github", F.create_map(F.lit("x-github-event"), F.col("event_name"),
                                                  F.lit("x-hub-signature-256"), F.concat(F.lit("sha256="), mac)))
                .when(p == "gitlab", F.create_map(F.lit("x-gitlab-token"), signer))
                .otherwise(F.create_map(F.lit("x-event-key"),
                                        F.when(F.col("event_name") == "push", "repo:push").otherwise("repo:fork"),
                                        F.lit("x-hub-signature"), mac)))
    return w.select(F.col("delivery_id"), "provider", "source_id", headers.alias("headers"), body.alias("body"),
                    "received_at"), secrets


@register("b10_filter_push", views=["fx_webhooks"], oracle="""
SELECT delivery_id, provider,
       CASE WHEN provider IN ('github', 'bitbucket') AND event_name = 'push' THEN 'accepted'
            WHEN provider = 'gitlab' AND json_extract_string(body, '$.object_kind') = 'push' THEN 'accepted'
            ELSE 'ignored' END AS push_status FROM fx_webhooks""")
def b10_filter_push(spark, sf_dir):
    """Push deliveries accepted, everything else ignored."""
    d, _ = _deliveries(Fixtures(spark, sf_dir))
    return ops.filter_push(d).select("delivery_id", "provider", "push_status")


@register("d4_authenticate_webhooks", views=["fx_webhooks"], oracle=f"""
WITH {SECRET_SQL.strip()},
a AS (SELECT delivery_id, provider, secret, signer,
             CASE WHEN secret IS NULL THEN NULL ELSE {duck_hmac('secret', 'body')} END AS expected_signature FROM dl)
SELECT delivery_id, provider, expected_signature,
       CASE WHEN secret IS NULL THEN FALSE ELSE signer = secret END AS authentic,
       CASE WHEN secret IS NULL THEN 'no_secret' WHEN signer <> secret THEN 'bad_signature' ELSE 'ok' END AS auth_reason
FROM a""")
def d4_authenticate_webhooks(spark, sf_dir):
    """Webhook authenticity (HMAC-SHA256 / token) per delivery."""
    fx = Fixtures(spark, sf_dir)
    d, secrets = _deliveries(fx)
    a = ops.authenticate_webhooks(d, secrets)
    ipad, opad = K.hmac_pads(F.encode("secret", "UTF-8"))
    expected = secrets.select("source_id", K.hmac_sha256_hex(ipad, opad, F.lit(None).cast("binary")).alias("_x"),
                              ipad.alias("_i"), opad.alias("_o"))
    a = a.join(expected, "source_id", "left").withColumn(
        "expected_signature", K.hmac_sha256_hex(F.col("_i"), F.col("_o"), F.col("body")))
    return a.select("delivery_id", "provider", "expected_signature", "authentic", "auth_reason")


EXTRACT_SQL = """
x AS (SELECT delivery_id, provider, body,
  CASE provider WHEN 'github' THEN json_extract_string(body, '$.repository.clone_url')
                WHEN 'gitlab' THEN json_extract_string(body, '$.project.git_http_url')
                ELSE json_extract_string(body, '$.repository.links.html.href') END AS repo_url,
  CASE WHEN provider = 'bitbucket' THEN json_extract_string(body, '$.push.changes[0].new.name')
       WHEN starts_with(json_extract_string(body, '$.ref'), 'refs/heads/') THEN replace(json_extract_string(body, '$.ref'), 'refs/heads/', '')
       ELSE json_extract_string(body, '$.ref') END AS branch,
  CASE WHEN provider = 'bitbucket' THEN coalesce(json_extract_string(body, '$.push.changes[0].old.target.hash'), '')
       ELSE json_extract_string(body, '$.before') END AS old_commit,
  CASE WHEN provider = 'bitbucket' THEN coalesce(json_extract_string(body, '$.push.changes[0].new.target.hash'), '')
       ELSE json_extract_string(body, '$.after') END AS new_commit
  FROM fx_webhooks),
xr AS (SELECT *, CASE
  WHEN provider = 'bitbucket' AND coalesce(json_array_length(body, '$.push.changes'), 0) = 0 THEN 'no_changes'
  WHEN provider = 'bitbucket' AND (old_commit = '' OR new_commit = '') THEN 'missing_hash'
  WHEN provider <> 'bitbucket' AND NOT coalesce(length(old_commit) = 40 AND length(new_commit) = 40, FALSE) THEN 'invalid_sha'
  WHEN coalesce(repo_url, '') = '' OR coalesce(branch, '') = '' THEN 'missing_repo_or_branch' END AS reject_reason FROM x)"""


@register("e10_extract_push", views=["fx_webhooks"], oracle=f"""
WITH {EXTRACT_SQL.strip()}
SELECT delivery_id, provider, repo_url, branch, old_commit, new_commit, reject_reason FROM xr""")
def e10_extract_push(spark, sf_dir):
    """Repository URL, branch and commits extracted from push bodies."""
    d, _ = _deliveries(Fixtures(spark, sf_dir))
    return ops.extract_push(d).select("delivery_id", "provider", "repo_url", "branch", "old_commit",
                                      "new_commit", "reject_reason")


MATCH_SQL = """
ex AS (SELECT url, arg_min(id, (created_at, id)) AS best FROM fx_hook_repos GROUP BY url),
nm AS (SELECT lower(regexp_replace(regexp_replace(url, '/+$', ''), '\\.git$', '')) AS k, arg_min(id, (created_at, id)) AS best
       FROM fx_hook_repos GROUP BY 1),
good AS (SELECT * FROM xr WHERE reject_reason IS NULL),
m AS (SELECT g.delivery_id, g.provider, g.branch, g.old_commit, g.new_commit, g.repo_url,
             coalesce(ex.best, nm.best) AS repository_id,
             CASE WHEN ex.best IS NOT NULL THEN 'exact' WHEN nm.best IS NOT NULL THEN 'normalized' END AS "match"
      FROM good g LEFT JOIN ex ON ex.url = g.repo_url
      LEFT JOIN nm ON nm.k = lower(regexp_replace(regexp_replace(g.repo_url, '/+$', ''), '\\.git$', '')))"""


@register("d1_match_repositories", views=["fx_webhooks", "fx_hook_repos"], oracle=f"""
WITH {EXTRACT_SQL.strip()}, {MATCH_SQL.strip()}
SELECT delivery_id, repository_id, "match" FROM m""")
def d1_match_repositories(spark, sf_dir):
    """Push deliveries matched to repositories (exact URL, then normalised key)."""
    fx = Fixtures(spark, sf_dir)
    d, _ = _deliveries(fx)
    good = ops.extract_push(d).filter(F.col("reject_reason").isNull())
    return ops.annotate_matches(good, fx.fx_hook_repos).select("delivery_id", "repository_id", "match")


ODD_URL_SQL = """CASE delivery_id % 9 WHEN 0 THEN repo_url WHEN 1 THEN regexp_replace(repo_url, '[0-9]+', '_')
  WHEN 2 THEN replace(repo_url, '/org/', '%/') WHEN 3 THEN upper(repo_url) WHEN 4 THEN regexp_replace(repo_url, '^https://', '')
  WHEN 5 THEN 'r' || (delivery_id % 300) || '/' WHEN 6 THEN CASE WHEN delivery_id % 2 = 0 THEN '_%' ELSE repeat('_', 70) END
  WHEN 7 THEN 'https://' ELSE repo_url || 'x' END"""


def _odd_urls(pushes):
    """Pushed URLs in shapes that only a contains match finds: shortened, with wildcards, in capitals."""
    k, url = F.col("delivery_id") % 9, F.col("repo_url")
    return pushes.withColumn("repo_url", F.when(k == 0, url).when(k == 1, F.regexp_replace(url, "[0-9]+", "_"))
                             .when(k == 2, F.replace(url, F.lit("/org/"), F.lit("%/"))).when(k == 3, F.upper(url))
                             .when(k == 4, F.regexp_replace(url, "^https://", ""))
                             .when(k == 5, F.concat(F.lit("r"), F.col("delivery_id") % 300, F.lit("/")))
                             .when(k == 6, F.when(F.col("delivery_id") % 2 == 0, F.lit("_%")).otherwise(F.repeat(F.lit("_"), 70)))
                             .when(k == 7, F.lit("https://")).otherwise(F.concat(url, F.lit("x"))))


@register("d1_match_contains", views=["fx_webhooks", "fx_hook_repos"], oracle=f"""
WITH {EXTRACT_SQL.strip()},
g AS (SELECT delivery_id, {ODD_URL_SQL} AS repo_url FROM xr WHERE reject_reason IS NULL),
u AS (SELECT DISTINCT repo_url, lower(regexp_replace(regexp_replace(repo_url, '/+$', ''), '[.git]+$', '')) AS needle FROM g),
ex AS (SELECT url, arg_min(id, (created_at, id)) AS best FROM fx_hook_repos GROUP BY url),
d AS (SELECT url, arg_min(id, (created_at, id)) AS id, min((created_at, id)) AS o FROM fx_hook_repos GROUP BY url),
w AS (SELECT u.repo_url, arg_min(d.id, d.o) AS best FROM u JOIN d ON d.url ILIKE '%' || u.needle || '%' GROUP BY u.repo_url)
SELECT g.delivery_id, coalesce(ex.best, w.best) AS repository_id,
       CASE WHEN ex.best IS NOT NULL THEN 'exact' WHEN w.best IS NOT NULL THEN 'contains' END AS "match"
FROM g LEFT JOIN ex ON ex.url = g.repo_url LEFT JOIN w ON w.repo_url = g.repo_url""")
def d1_match_contains(spark, sf_dir):
    """Pushed URLs matched as they are, else to the earliest repository whose URL contains them."""
    fx = Fixtures(spark, sf_dir)
    d, _ = _deliveries(fx)
    good = _odd_urls(ops.extract_push(d).filter(F.col("reject_reason").isNull()))
    return contains.annotate_contains(good, fx.fx_hook_repos).select("delivery_id", "repository_id", "match")


@register("d3_credential_audit", views=["fx_hook_repos", "fx_credentials"], oracle=f"""
SELECT r.id, r.provider,
  CASE WHEN c.repo_id IS NULL THEN 'missing'
       WHEN c.expires_at IS NOT NULL AND c.expires_at < TIMESTAMP '{NOW}' THEN 'expired'
       WHEN c.provider IS DISTINCT FROM r.provider THEN 'provider_mismatch' ELSE 'ok' END AS credential_status
FROM fx_hook_repos r LEFT JOIN fx_credentials c ON c.repo_id = r.id""")
def d3_credential_audit(spark, sf_dir):
    """D3: credential status per repository."""
    fx = Fixtures(spark, sf_dir)
    out = ops.credential_audit(fx.fx_hook_repos, fx.fx_credentials, NOW)
    return out.select("id", "provider", "credential_status")


L1_SQL = f"""
WITH {SECRET_SQL.strip()}, {EXTRACT_SQL.strip()},
au AS (SELECT dl.delivery_id, dl.provider, dl.received_at,
              CASE WHEN dl.secret IS NULL THEN 'no_secret' WHEN dl.signer <> dl.secret THEN 'bad_signature' END AS auth_bad,
              CASE WHEN dl.provider IN ('github', 'bitbucket') AND dl.event_name = 'push' THEN FALSE
                   WHEN dl.provider = 'gitlab' AND json_extract_string(dl.body, '$.object_kind') = 'push' THEN FALSE
                   ELSE TRUE END AS ignored
       FROM dl),
st AS (SELECT xr.*, au.received_at, coalesce(au.auth_bad, CASE WHEN au.ignored THEN 'ignored' END, xr.reject_reason) AS reason
       FROM xr JOIN au ON au.delivery_id = xr.delivery_id),
xr2 AS (SELECT * FROM st),
{MATCH_SQL.strip().replace("good AS (SELECT * FROM xr WHERE reject_reason IS NULL)", "good AS (SELECT * FROM xr2 WHERE reason IS NULL)")},
cr AS (SELECT m.*, CASE WHEN c.repo_id IS NULL THEN 'missing'
                        WHEN c.expires_at IS NOT NULL AND c.expires_at < TIMESTAMP '{NOW}' THEN 'expired'
                        WHEN c.provider IS DISTINCT FROM m.provider THEN 'provider_mismatch' ELSE 'ok' END AS cs
       FROM m LEFT JOIN fx_credentials c ON c.repo_id = m.repository_id)"""


@register("l1_webhook_updates", views=["fx_webhooks", "fx_hook_repos", "fx_credentials"], oracle=L1_SQL + """
SELECT 'REPO_UPDATED' AS event_type, sha256('event:' || CAST(delivery_id AS VARCHAR)) AS event_id,
       CAST(repository_id AS VARCHAR) AS repo_id, provider, branch, old_commit, new_commit, 'push' AS update_type
FROM cr WHERE repository_id IS NOT NULL AND cs = 'ok'""")
def l1_webhook_updates(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    d, secrets = _deliveries(fx)
    events, _ = ops.webhook_updates(d, secrets, fx.fx_hook_repos, fx.fx_credentials, NOW)
    return events.select("event_type", "event_id", "payload.repo_id", "payload.provider", "payload.branch",
                         "payload.old_commit", "payload.new_commit", "payload.update_type")


@register("l1_webhook_rejects", views=["fx_webhooks", "fx_hook_repos", "fx_credentials"], oracle=L1_SQL + """
SELECT delivery_id, reason FROM xr2 WHERE reason IS NOT NULL
UNION ALL SELECT delivery_id, 'repository_not_found' FROM m WHERE repository_id IS NULL
UNION ALL SELECT delivery_id, 'credential_' || cs FROM cr WHERE repository_id IS NOT NULL AND cs <> 'ok'""")
def l1_webhook_rejects(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    d, secrets = _deliveries(fx)
    _, rejects = ops.webhook_updates(d, secrets, fx.fx_hook_repos, fx.fx_credentials, NOW)
    return rejects
