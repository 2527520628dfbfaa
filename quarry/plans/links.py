"""Registered jobs: link resolution and key normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import EVENT_SOURCE_TYPES, REGISTRY_SOURCE_TYPES
from ..operators import links as ops
from ..sources.fixtures import Fixtures
from .catalog import register
from .sqlbits import q

_URLS_SQL = """
WITH b AS (SELECT id, provider, url, regexp_replace(url, '(\\.git)?/?$', '') AS base FROM fx_repositories),
u AS (SELECT id, provider, CASE id % 7 WHEN 0 THEN base || '/tree/main/src/a?x=1'
                                      WHEN 1 THEN base || '/-/tree/dev/a/b/'
                                      WHEN 2 THEN base || '/src/main/docs'
                                      WHEN 3 THEN base || '/tree/main'
                                      WHEN 4 THEN base || '/blob/v1/x/y.py'
                                      WHEN 5 THEN base || '/issues/3' ELSE url END AS url FROM b)"""


def _urls(fx: Fixtures):
    r = fx.fx_repositories
    base = F.regexp_replace("url", r"(\.git)?/?$", "")
    m = F.col("id") % 7
    url = (F.when(m == 0, F.concat(base, F.lit("/tree/main/src/a?x=1")))
            .when(m == 1, F.concat(base, F.lit("/-/tree/dev/a/b/")))
            .when(m == 2, F.concat(base, F.lit("/src/main/docs")))
            .when(m == 3, F.concat(base, F.lit("/tree/main")))
            .when(m == 4, F.concat(base, F.lit("/blob/v1/x/y.py")))
            .when(m == 5, F.concat(base, F.lit("/issues/3")))
            .otherwise(F.col("url")))
    return r.select("id", "provider", url.alias("url"))


@register("c1_resolve_links", views=["fx_repositories"], oracle=_URLS_SQL + """,
s AS (SELECT *, rtrim(url, '/') AS s,
             CASE provider WHEN 'github' THEN 'github.com/' WHEN 'gitlab' THEN 'gitlab.com/' ELSE 'bitbucket.org/' END AS host FROM u),
p AS (SELECT *, CASE WHEN contains(s, host) THEN string_split(split_part(substr(s, strpos(s, host) + length(host)), '?', 1), '/') END AS a FROM s),
k AS (SELECT *, CASE WHEN provider = 'gitlab' AND list_contains(['tree', 'blob'], a[list_position(a, '-') + 1]) THEN list_position(a, '-') + 1
                     WHEN provider = 'github' AND list_contains(['tree', 'blob'], a[3]) THEN 3
                     WHEN provider = 'bitbucket' AND a[3] = 'src' THEN 3 END AS mark FROM p),
m AS (SELECT *, coalesce(mark < len(a), FALSE) AS marked FROM k),
r AS (SELECT *, coalesce(a[1] <> '' AND (provider = 'gitlab' OR (a[2] <> '' AND (len(a) = 2 OR marked))), FALSE) AS resolved FROM m)
SELECT id, url, provider, resolved,
       regexp_replace(CASE WHEN NOT resolved THEN concat_ws('/', string_split(s, '/')[-2], string_split(s, '/')[-1])
                           WHEN NOT marked THEN list_aggregate(a, 'string_agg', '/')
                           ELSE list_aggregate(a[1:(CASE WHEN provider = 'gitlab' THEN mark - 2 ELSE 2 END)], 'string_agg', '/') END,
                      '\\.git$', '') AS repo_path,
       rtrim(CASE WHEN resolved AND marked THEN coalesce(list_aggregate(a[mark + 2:], 'string_agg', '/'), '') ELSE '' END, '/') AS folder_path
FROM r""")
def c1_resolve_links(spark, sf_dir):
    """Repository URL -> provider, owner/name and folder."""
    out = ops.resolve_links(_urls(Fixtures(spark, sf_dir)), "url", "provider")
    return out.select("id", "url", "provider", "repo_path", "folder_path", "resolved")


@register("c2_normalize_url", views=["fx_repositories"], oracle="""
SELECT id, url, lower(regexp_replace(regexp_replace(url, '/+$', ''), '\\.git$', '')) AS norm_url,
       lower(rtrim(rtrim(url, '/'), '.git')) AS norm_url_charset FROM fx_repositories""")
def c2_normalize_url(spark, sf_dir):
    """URL join keys in suffix and character-set modes."""
    r = Fixtures(spark, sf_dir).fx_repositories.select("id", "url")
    r = ops.normalize_url(r, "url", "suffix", "norm_url")
    return ops.normalize_url(r, "url", "charset", "norm_url_charset")


@register("c3_normalize_source_type", oracle=f"""
WITH t AS (SELECT c_custkey AS id,
  CASE WHEN c_custkey % 2 = 0 THEN upper([{q(REGISTRY_SOURCE_TYPES + ('google_drive', 'web'))}][(c_custkey % 23) + 1])
       ELSE [{q(REGISTRY_SOURCE_TYPES + ('google_drive', 'web'))}][(c_custkey % 23) + 1] END AS type FROM customer)
SELECT id, type, CASE WHEN lower(type) IN ({q(EVENT_SOURCE_TYPES)}) THEN lower(type) ELSE 'unknown' END AS event_source_type,
       lower(type) NOT IN ({q(EVENT_SOURCE_TYPES)}) AS unmapped FROM t""")
def c3_normalize_source_type(spark, sf_dir):
    """Registry source type -> event source type."""
    c = Fixtures(spark, sf_dir).customer
    names = F.array(*[F.lit(x) for x in REGISTRY_SOURCE_TYPES + ("google_drive", "web")])
    t = F.element_at(names, (F.col("c_custkey") % 23 + 1).cast("int"))
    src = c.select(F.col("c_custkey").alias("id"),
                   F.when(F.col("c_custkey") % 2 == 0, F.upper(t)).otherwise(t).alias("type"))
    return ops.normalize_source_type(src, "type").select("id", "type", "event_source_type", "unmapped")


_UID_SQL = """
SELECT id, CASE id % 6 WHEN 0 THEN upper(md5(CAST(id AS varchar(20))))
                       WHEN 1 THEN concat(substr(md5(CAST(id AS varchar(20))), 1, 8), '-', substr(md5(CAST(id AS varchar(20))), 9, 4), '-',
                                          substr(md5(CAST(id AS varchar(20))), 13, 4), '-', substr(md5(CAST(id AS varchar(20))), 17, 4), '-',
                                          substr(md5(CAST(id AS varchar(20))), 21, 12))
                       WHEN 2 THEN concat('{', md5(CAST(id AS varchar(20))), '}')
                       WHEN 3 THEN CASE WHEN id % 4 = 3 THEN '' ELSE '00000000-0000-0000-0000-000000000000' END
                       ELSE user_id END AS user_id FROM fx_repositories"""


@register("c4_canonical_user_id", views=["fx_repositories"], oracle=f"""
WITH u AS ({_UID_SQL}),
h AS (SELECT id, user_id, replace(regexp_replace(regexp_replace(user_id, 'urn:|uuid:', '', 'g'), '^[{{]+|[}}]+$', '', 'g'), '-', '') AS hx,
             sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(user_id)) AS s FROM u)
SELECT id, user_id,
  CASE WHEN user_id IS NULL OR user_id = '' OR user_id = '00000000-0000-0000-0000-000000000000' THEN '00000000-0000-0000-0000-000000000000'
       WHEN regexp_matches(hx, '^[0-9a-fA-F]{{32}}$') THEN lower(concat_ws('-', substr(hx, 1, 8), substr(hx, 9, 4), substr(hx, 13, 4), substr(hx, 17, 4), substr(hx, 21, 12)))
       ELSE concat_ws('-', substr(s, 1, 8), substr(s, 9, 4), '5' || substr(s, 14, 3),
                      substr('89ab89ab89ab89ab', CAST(('0x' || substr(s, 17, 1)) AS INTEGER) + 1, 1) || substr(s, 18, 3), substr(s, 21, 12)) END AS user_uuid
FROM h""")
def c4_canonical_user_id(spark, sf_dir):
    """C4: canonical UUID (UUIDv5 for non-UUID ids) per user id."""
    fx = Fixtures(spark, sf_dir)
    r = fx.fx_repositories
    h = F.md5(F.col("id").cast("string"))
    m = F.col("id") % 6
    uid = (F.when(m == 0, F.upper(h))
            .when(m == 1, F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                                      F.substring(h, 17, 4), F.substring(h, 21, 12)))
            .when(m == 2, F.concat(F.lit("{"), h, F.lit("}")))
            .when(m == 3, F.when(F.col("id") % 4 == 3, F.lit("")).otherwise(F.lit("00000000-0000-0000-0000-000000000000")))
            .otherwise(F.col("user_id")))
    return ops.canonical_user_ids(r.select("id", uid.alias("user_id"))).select("id", "user_id", "user_uuid")
