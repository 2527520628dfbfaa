"""Link resolution and key normalisation as table jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.constants import EVENT_SOURCE_TYPES, PROVIDER_HOSTS, SOURCE_TYPE_ALIASES

def sniff_provider(url) -> F.Column:
    u = F.col(url) if isinstance(url, str) else url
    return (F.when(u.contains("gitlab.com"), "gitlab").when(u.contains("bitbucket.org"), "bitbucket")
             .otherwise("github"))


def _after_host(url, provider) -> F.Column:
    """What follows the provider's host in a URL, up to the query; null if the host is not there."""
    out = F.lit(None).cast("string")
    for name, host in PROVIDER_HOSTS.items():
        at = F.instr(url, host + "/")
        tail = F.substr(url, at + len(host) + 1)
        out = F.when((provider == name) & (at > 0), F.substring_index(tail, "?", 1)).otherwise(out)
    return out


def resolve_links(df: DataFrame, url_col: str = "url", provider_col: str | None = None) -> DataFrame:
    """URL -> ``provider, repo_path, folder_path, resolved``.

    The path after the host is cut into segments. A branch marker (``tree`` or ``blob``, for
    Bitbucket ``src``) is looked for where the provider puts it: as the third segment, or on
    GitLab, whose groups nest, after a ``-`` segment. The segments before it are the repository,
    those after the branch the folder. Without a marker the path must be owner/name (on GitLab any
    path). Other URLs are not resolved: they keep their last two parts and are reported, not
    dropped. A trailing ``.git`` goes.
    """
    provider = F.col(provider_col) if provider_col else sniff_provider(url_col)
    url = F.regexp_replace(F.col(url_col), "/+$", "")
    seg = F.split(_after_host(url, provider), "/", -1)
    n, at = F.size(seg), lambda k: F.get(seg, k)
    dash = F.array_position(seg, "-").cast("int")  # from 1; 0 if there is none
    marked = F.when(provider == "gitlab", (dash > 1) & F.get(seg, dash).isin("tree", "blob") & (n > dash + 1)) \
        .when(provider == "bitbucket", (at(F.lit(2)) == "src") & (n > 3)) \
        .otherwise(at(F.lit(2)).isin("tree", "blob") & (n > 3))
    marked = F.coalesce(marked, F.lit(False))
    named = F.when(marked, F.when(provider == "gitlab", dash - 1).otherwise(2)).otherwise(n)
    branch = F.when(provider == "gitlab", dash + 1).otherwise(3)
    two = (n == 2) | marked
    whole = F.coalesce((n > 0) & (at(F.lit(0)) != "") & ((provider == "gitlab") | (two & (at(F.lit(1)) != ""))), F.lit(False))
    parts = F.split(url, "/", -1)
    repo = F.when(whole, F.array_join(F.slice(seg, F.lit(1), named), "/")).otherwise(
        F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))))
    folder = F.when(whole & marked, F.array_join(F.slice(seg, branch + 2, n), "/")).otherwise(F.lit(""))
    return df.withColumns({"provider": provider, "repo_path": F.regexp_replace(repo, r"\.git$", ""),
                           "folder_path": F.regexp_replace(folder, "/+$", ""), "resolved": whole})


def normalize_url(df: DataFrame, url_col: str = "url", mode: str = "suffix", out_col: str = "norm_url") -> DataFrame:
    """Add the URL join / dedupe key."""
    return df.withColumn(out_col, K.norm_url(url_col, mode))


def normalize_source_type(df: DataFrame, col: str = "type") -> DataFrame:
    """Registry source type -> ingestion-event source type; unmapped ones become
    ``unknown`` and are flagged (e.g. gdrive, upload, local_files)."""
    low = F.lower(F.col(col))
    mapped = (F.when(low.isin(*EVENT_SOURCE_TYPES), low)
               .otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_TYPE_ALIASES.items() for x in kv]), low),
                                     F.lit("unknown"))))
    mapped = F.coalesce(mapped, F.lit("unknown"))
    return df.withColumn("event_source_type", mapped).withColumn(
        "unmapped", (mapped == "unknown") & F.coalesce(low != "unknown", F.lit(True)))


def canonical_user_ids(df: DataFrame, col: str = "user_id", out_col: str = "user_uuid") -> DataFrame:
    """C4: canonical UUID for every user id (UUIDv5 for non-UUID ids)."""
    return df.withColumn(out_col, K.canonical_user_id(col))
