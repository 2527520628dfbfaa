"""Webhook deliveries: push filter (B10), authentication (D4), extraction (E10),
repository matching (D1), credential audit (D3) and REPO_UPDATED events (L1 batch step)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys as K



#: Tasks that rows of one shared key are dealt over, at most.
DEALS = 4096


def _with_row(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_row``, a number made of the row's own values, to deal rows by."""
    plain = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType)]
    return rows.withColumn("_row", F.xxhash64(*plain) if plain else F.lit(0).cast("long"))


def _join_dealt(rows: DataFrame, other: DataFrame, key: str, other_key: str, shared: Column, deals: Column) -> DataFrame:
    """Left join on ``key`` = ``other_key``. Rows with the ``shared`` key are dealt over many tasks by
    ``_row``, not sent to the one task of that key; ``deals``: the numbers that each row of ``other`` is there for."""
    left = rows.withColumn("_deal", F.when(shared, F.pmod("_row", F.lit(DEALS))).otherwise(F.lit(0).cast("long")))
    right = other.withColumn("_other_deal", F.explode(deals))
    on = (left[key] == right[other_key]) & (left["_deal"] == right["_other_deal"])
    return left.join(right, on, "left").drop("_deal", "_other_deal")


def _join_nullable(rows: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Left join where many rows have no key; these match nothing."""
    none = F.array().cast("array<bigint>")
    deals = F.when(F.col(other_key).isNotNull(), F.array(F.lit(0).cast("long"))).otherwise(none)
    return _join_dealt(rows, other, key, other_key, F.col(key).isNull(), deals)


def _header(name: str) -> Column:
    return F.try_element_at(F.col("headers"), F.lit(name))


def _body() -> Column:
    return F.col("body").cast("string")


def filter_push(deliveries: DataFrame) -> DataFrame:
    """``push_status`` accepted | ignored. GitHub: header ``x-github-event = push``;
    GitLab: body ``object_kind = push``; Bitbucket: header ``x-event-key = repo:push``."""
    kind = F.get_json_object(_body(), "$.object_kind")
    p = F.col("provider")
    is_push = (F.when(p == "github", F.coalesce(_header("x-github-event") == "push", F.lit(False)))
                .when(p == "gitlab", F.coalesce(kind == "push", F.lit(False)))
                .when(p == "bitbucket", F.coalesce(_header("x-event-key") == "repo:push", F.lit(False)))
                .otherwise(F.lit(False)))
    return deliveries.withColumn("push_status", F.when(is_push, "accepted").otherwise("ignored"))


def authenticate_webhooks(deliveries: DataFrame, secrets: DataFrame, key: str = "source_id") -> DataFrame:
    """``authentic`` + ``auth_reason`` per delivery.

    ``secrets``: key, secret (string). No secret -> rejected (checked first). GitHub:
    ``x-hub-signature-256`` = ``sha256=`` + hex HMAC-SHA256(secret, body); Bitbucket:
    ``x-hub-signature`` = bare hex HMAC; GitLab: ``x-gitlab-token`` = secret; a known
    secret with an unknown provider is accepted. HMAC pads are computed per secret row
    (one row per source), so only the small side does the byte work.
    """
    ipad, opad = K.hmac_pads(F.encode(F.col("secret"), "UTF-8"))
    s = secrets.select(key, F.col("secret").alias("_secret"), ipad.alias("_ipad"), opad.alias("_opad"))
    j = deliveries.join(s, key, "left")
    mac = K.hmac_sha256_hex(F.col("_ipad"), F.col("_opad"), F.col("body"))
    p = F.col("provider")
    gh_sig = F.coalesce(_header("x-hub-signature-256"), F.lit(""))
    bb_sig = F.coalesce(_header("x-hub-signature"), F.lit(""))
    gl_tok = F.coalesce(_header("x-gitlab-token"), F.lit(""))
    has_secret = F.col("_secret").isNotNull() & (F.col("_secret") != "")
    ok = (F.when(~has_secret, F.lit(False))
           .when(p == "github", gh_sig.startswith("sha256=") & (gh_sig == F.concat(F.lit("sha256="), mac)))
           .when(p == "gitlab", gl_tok == F.col("_secret"))
           .when(p == "bitbucket", bb_sig == mac)
           .otherwise(F.lit(True)))
    reason = (F.when(~has_secret, "no_secret")
               .when(~ok, "bad_signature")
               .when(~p.isin("github", "gitlab", "bitbucket"), "unverified_provider")
               .otherwise("ok"))
    return j.withColumn("authentic", ok).withColumn("auth_reason", reason).drop("_secret", "_ipad", "_opad")


def _strip_heads(ref: Column) -> Column:
    return F.when(ref.startswith("refs/heads/"), F.replace(ref, F.lit("refs/heads/"), F.lit(""))).otherwise(ref)


PUSH_BODY = ("object_kind STRING, ref STRING, before STRING, after STRING, "
             "repository STRUCT<clone_url: STRING, links: STRUCT<html: STRUCT<href: STRING>>>, "
             "project STRUCT<git_http_url: STRING>, "
             "push STRUCT<changes: ARRAY<STRUCT<old: STRUCT<name: STRING, target: STRUCT<hash: STRING>>, "
             "new: STRUCT<name: STRING, target: STRUCT<hash: STRING>>>>>, _corrupt STRING")


def extract_push(deliveries: DataFrame) -> DataFrame:
    """``repo_url, branch, old_commit, new_commit, reject_reason`` per delivery.

    GitHub / GitLab need 40-character shas; Bitbucket reads only ``changes[0]`` and needs
    any non-empty hashes. A branch keeps everything but ``refs/heads/`` occurrences.
    The body is parsed once against the union of the three providers' push shapes.
    """
    p = F.col("provider")
    # Behind a generator, so that what is built on the parsed body doesn't parse it again.
    x = deliveries.select("*", F.inline(F.array(F.struct(
        F.from_json(_body(), PUSH_BODY, {"columnNameOfCorruptRecord": "_corrupt"}).alias("_b")))))
    b = F.col("_b")
    first = F.try_element_at(b["push"]["changes"], F.lit(1))
    url = (F.when(p == "github", b["repository"]["clone_url"]).when(p == "gitlab", b["project"]["git_http_url"])
            .when(p == "bitbucket", b["repository"]["links"]["html"]["href"]))
    branch = (F.when(p.isin("github", "gitlab"), _strip_heads(b["ref"]))
               .when(p == "bitbucket", first["new"]["name"]))
    old = (F.when(p.isin("github", "gitlab"), b["before"])
            .when(p == "bitbucket", F.coalesce(first["old"]["target"]["hash"], F.lit(""))))
    new = (F.when(p.isin("github", "gitlab"), b["after"])
            .when(p == "bitbucket", F.coalesce(first["new"]["target"]["hash"], F.lit(""))))
    x = x.withColumns({"repo_url": url, "branch": branch, "old_commit": old, "new_commit": new})
    o, n = F.col("old_commit"), F.col("new_commit")
    empty = lambda c: c.isNull() | (c == "")
    sha_ok = F.when(p == "bitbucket", ~empty(o) & ~empty(n)).otherwise(
        F.coalesce((F.length(o) == 40) & (F.length(n) == 40), F.lit(False)))
    no_changes = (p == "bitbucket") & F.coalesce(F.size(b["push"]["changes"]) <= 0, F.lit(True))
    reason = (F.when(b.isNull() | b["_corrupt"].isNotNull(), "invalid_json")
               .when(no_changes, "no_changes")
               .when(~sha_ok, F.when(p == "bitbucket", "missing_hash").otherwise("invalid_sha"))
               .when(empty(F.col("repo_url")) | empty(F.col("branch")), "missing_repo_or_branch"))
    return x.withColumn("reject_reason", reason).drop("_b")


def match_repositories(pushes: DataFrame, repos: DataFrame, url_col: str = "repo_url",
                       order: tuple[str, ...] = ("created_at", "id")) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) split of :func:`annotate_matches`."""
    out = annotate_matches(pushes, repos, url_col, order)
    return out.filter(F.col("repository_id").isNotNull()), out.filter(F.col("repository_id").isNull())


def annotate_matches(pushes: DataFrame, repos: DataFrame, url_col: str = "repo_url",
                     order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """Push -> ``repository_id`` and ``match`` (exact | normalized | null).

    An exact URL match wins, else the normalised URL key (suffix mode); ties go to the
    earliest ``order``. Pushes without a URL match no URL and are dealt over all tasks. Each repository side is first reduced to one candidate per key
    (a partial aggregate), so a URL registered by many users never multiplies the pushes.
    """
    cand = F.struct(*[F.col(c) for c in order], F.col("id").alias("_id"))
    exact = (repos.groupBy(F.col("url").alias("_exact_url")).agg(F.min(cand).alias("_exact")))
    normed = (repos.withColumn("_norm", K.norm_url("url")).groupBy("_norm").agg(F.min(cand).alias("_nbest")))
    normed = normed.withColumnRenamed("_norm", "_norm_key")
    rows = pushes if "_row" in pushes.columns else _with_row(pushes)
    j = _join_nullable(rows, exact, url_col, "_exact_url").withColumn("_norm", K.norm_url(url_col))
    # Pushes without a URL share the empty key.
    some = F.when(F.col("_norm_key") == "", F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long")))
    j = _join_dealt(j, normed, "_norm", "_norm_key", F.col("_norm") == "", some.otherwise(F.array(F.lit(0).cast("long"))))
    rid = F.coalesce(F.col("_exact._id"), F.col("_nbest._id"))
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_nbest").isNotNull(), "normalized")
    return j.withColumn("repository_id", rid).withColumn("match", how).drop("_exact_url", "_exact", "_nbest", "_norm", "_norm_key", *(["_row"] if rows is not pushes else []))


def credential_audit(repos: DataFrame, creds: DataFrame, now: Column | str, key: str = "repo_id") -> DataFrame:
    """D3: per repository ``missing`` / ``expired`` / ``provider_mismatch`` / ``ok``."""
    now_c = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    c = creds.select(F.col(key).alias("_k"), F.col("provider").alias("_cprov"), F.col("expires_at").alias("_exp"))
    j = repos.join(c, repos["id"] == c["_k"], "left")
    outcome = (F.when(F.col("_k").isNull(), "missing")
                .when(F.col("_exp").isNotNull() & (F.col("_exp") < now_c), "expired")
                .when(~F.col("_cprov").eqNullSafe(F.col("provider")), "provider_mismatch")
                .otherwise("ok"))
    return j.withColumn("credential_status", outcome).drop("_k", "_cprov", "_exp")


def repo_updated_events(matched: DataFrame, now: Column | str | None = None) -> DataFrame:
    """L1 (emit step): REPO_UPDATED envelope rows keyed by repository id, with
    deterministic event and correlation ids derived from the delivery id."""
    ts = (F.lit(now).cast("timestamp") if isinstance(now, str) else now) if now is not None else F.col("received_at")
    payload = F.struct(F.col("repository_id").cast("string").alias("repo_id"), F.col("repo_url").alias("url"),
                       "branch", "provider", "old_commit", "new_commit",
                       F.sha2(F.concat(F.lit("cred:"), F.col("repository_id").cast("string")), 256).alias("credential_ref"),
                       F.lit("push").alias("update_type"))
    return matched.select(
        F.lit("REPO_UPDATED").alias("event_type"),
        F.sha2(F.concat(F.lit("event:"), F.col("delivery_id").cast("string")), 256).alias("event_id"),
        F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
        F.sha2(F.concat(F.lit("corr:"), F.col("delivery_id").cast("string")), 256).alias("correlation_id"),
        payload.alias("payload"))


def webhook_outcomes(deliveries: DataFrame, secrets: DataFrame, repos: DataFrame, creds: DataFrame,
                     now: Column | str) -> DataFrame:
    """L1 batch step as one linear plan: every delivery with its ``reason`` (null = publish).

    authenticate -> push filter -> extract -> match (only for deliveries still valid;
    others get a null join key) -> credential check.
    """
    a = filter_push(authenticate_webhooks(deliveries, secrets))
    x = extract_push(a)
    early = (F.when(~F.col("authentic"), F.col("auth_reason"))
              .when(F.col("push_status") == "ignored", F.lit("ignored"))
              .when(F.col("reject_reason").isNotNull(), F.col("reject_reason")))
    x = _with_row(x).withColumn("_early", early).withColumn("_match_url", F.when(F.col("_early").isNull(), F.col("repo_url")))
    m = annotate_matches(x, repos, url_col="_match_url")
    c = creds.select(F.col("repo_id").alias("_crid"), F.col("provider").alias("_cprov"), F.col("expires_at").alias("_cexp"))
    # Whoever is rejected before needs no credential.
    m = m.withColumn("_cred_key", F.when(F.col("_early").isNull(), F.col("repository_id")))
    j = _join_nullable(m, c, "_cred_key", "_crid")
    now_c = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    cred = (F.when(F.col("_crid").isNull(), "missing")
             .when(F.col("_cexp").isNotNull() & (F.col("_cexp") < now_c), "expired")
             .when(~F.col("_cprov").eqNullSafe(F.col("provider")), "provider_mismatch")
             .otherwise("ok"))
    reason = (F.when(F.col("_early").isNotNull(), F.col("_early"))
               .when(F.col("repository_id").isNull(), F.lit("repository_not_found"))
               .when(cred != "ok", F.concat(F.lit("credential_"), cred)))
    return j.withColumn("reason", reason).drop("_early", "_match_url", "_crid", "_cprov", "_cexp", "_cred_key", "_row")


def webhook_updates(deliveries: DataFrame, secrets: DataFrame, repos: DataFrame, creds: DataFrame,
                    now: Column | str) -> tuple[DataFrame, DataFrame]:
    """L1 batch step: (REPO_UPDATED events, rejects with ``reason``), both filters of
    :func:`webhook_outcomes`."""
    o = webhook_outcomes(deliveries, secrets, repos, creds, now)
    return (repo_updated_events(o.filter(F.col("reason").isNull())),
            o.filter(F.col("reason").isNotNull()).select("delivery_id", "reason"))
