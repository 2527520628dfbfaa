"""D1 fallback: the earliest repository whose URL contains a pushed URL, by a q-gram index join.

A pattern ``%needle%`` is met through the rarest q-gram of its literal parts: URLs are exploded into
grams, their frequencies counted, every needle picks its rarest one, and an equi-join on that gram
gives the candidates, which are then verified against the whole pattern. No nested loop, and a needle
with a gram that no URL has meets nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K

#: Lengths of grams: a needle uses the longest that fits into one of its literal parts.
GRAMS = (6, 3, 1)
#: Grams held by more than this part of all URLs are common; few can be (see ``common``).
COMMON_PART = 256
#: A common gram's URLs are met in this many parts.
PARTS = 64


def _grams(text: Column, q: int) -> Column:
    """Distinct substrings of ``q`` characters."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(text) - (q - 1), F.lit(1)))
    return F.when(F.char_length(text) >= q, F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(q))))).otherwise(
        F.array().cast("array<string>"))


def needle_key(url: Column | str, mode: str = "charset") -> Column:
    """The pushed URL as the pattern holds it: normalised and lower-cased."""
    return K.norm_url(url, mode)


def _literals(needle: Column) -> Column:
    """Parts of the needle between the wildcards ``_`` and ``%``."""
    return F.filter(F.split(needle, "[_%]"), lambda x: x != "")


def _matches(url: Column, needle: Column) -> Column:
    """``url LIKE '%needle%'``, with ``_`` for one character and ``%`` for any; plain needles are
    looked for as they are. A backslash is a character like any other."""
    plain = ~needle.contains("_") & ~needle.contains("%")
    like = F.concat(F.lit("%"), F.replace(needle, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return F.when(plain, url.contains(needle)).otherwise(F.call_function("like", url, like))


def _index(urls: DataFrame) -> DataFrame:
    """q, gram, url, cand: one row per URL and distinct gram."""
    every = F.array(*[F.struct(F.lit(q).alias("q"), _grams(F.col("url"), q).alias("grams")) for q in GRAMS])
    return (urls.select("url", "cand", F.explode(every).alias("g"))
            .select("url", "cand", "g.q", F.explode("g.grams").alias("gram")))


def contains_candidates(needles: DataFrame, urls: DataFrame) -> DataFrame:
    """needle, url, cand: for each needle (column ``needle``) with a literal part, the URLs (columns
    ``url``, lower-cased, and ``cand``) that share its rarest gram.

    Grams that more than a ``COMMON_PART``-th of the URLs hold are at most ``COMMON_PART`` times as
    many as a URL has grams, so they are sent to all tasks: they stay out of the shuffle unless a
    needle has no rarer one, and are then met in parts.
    """
    index = _index(urls)
    df = index.groupBy("q", "gram").agg(F.count(F.lit(1)).alias("df"))
    n = urls.count()
    common = df.filter(F.col("df") > math.ceil(n / COMMON_PART))
    # The longest gram length that fits into a literal part, and the grams of that length.
    parts = _literals(F.col("needle"))
    longest = F.array_max(F.transform(parts, F.char_length))
    q = F.coalesce(*[F.when(longest >= g, F.lit(g)) for g in GRAMS])
    held = F.flatten(F.transform(parts, lambda p: F.coalesce(*[F.when(F.col("q") == g, _grams(p, g)) for g in GRAMS])))
    asked = needles.select("needle").distinct().withColumn("q", q).filter(F.col("q").isNotNull())
    grams = asked.select("needle", "q", F.explode(F.array_distinct(held)).alias("gram"))
    known = grams.join(df, ["q", "gram"], "left")
    # A gram that no URL holds: the needle is in none.
    rarest = (known.groupBy("needle", "q").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("gram"))).alias("r"))
              .select("needle", "q", "r.gram", "r.df").filter(F.col("df") > 0))
    # Plans of their own: the same frame on both sides of a join would be one.
    few = F.broadcast(common.select(F.col("q").alias("cq"), F.col("gram").alias("cgram")))
    is_common = (F.col("q") == F.col("cq")) & (F.col("gram") == F.col("cgram"))
    # At most as many as there are common grams.
    wanted = F.broadcast(rarest.join(few, is_common, "left_semi").select("q", "gram").distinct())
    rare = rarest.join(few, is_common, "left_anti").join(index.join(few, is_common, "left_anti"), ["q", "gram"])
    hot = rarest.join(wanted, ["q", "gram"], "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    spread = index.join(wanted, ["q", "gram"]).withColumn("part", F.pmod(F.xxhash64("url"), F.lit(PARTS)).cast("int"))
    met = hot.join(spread, ["q", "gram", "part"])
    return rare.select("needle", "url", "cand").unionByName(met.select("needle", "url", "cand"))


def _by_length(needles: DataFrame, urls: DataFrame) -> DataFrame:
    """needle, cand for needles of wildcards only: the earliest URL that is long enough.

    Lengths of URLs are few; a running minimum over them answers every needle.
    """
    bare = (needles.select("needle").distinct().filter(F.size(_literals(F.col("needle"))) == 0)
            .withColumn("least", F.char_length(F.replace("needle", F.lit("%"), F.lit("")))))
    lengths = urls.groupBy(F.char_length("url").alias("len")).agg(F.min("cand").alias("cand"))
    longer = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("len").over(Window.orderBy("len"))
    best = (lengths.withColumns({"cand": F.min("cand").over(longer), "from": F.coalesce(before + 1, F.lit(0))})
            .withColumn("at", F.explode(F.sequence("from", "len"))))
    return bare.join(best, F.col("least") == F.col("at")).select("needle", "cand")


def annotate_contains(pushes: DataFrame, repos: DataFrame, url_col: str = "repo_url", mode: str = "charset",
                      order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """D1 as the surveyed service matches: push -> ``repository_id`` and ``match`` (exact | contains |
    null).

    A repository with the very URL wins; else the earliest (by ``order``) whose URL contains the
    normalised pushed URL, ignoring case, ``_`` and ``%`` in it being wildcards. ``mode`` is that of
    :func:`norm_url`; the service strips trailing characters, not a suffix. A null URL matches none.
    Repositories are reduced to one candidate per URL and pushes to one needle per URL first, so
    only distinct URLs meet.
    """
    cand = F.struct(*[F.col(c) for c in order], F.col("id").alias("_id"))
    exact = repos.groupBy(F.col("url").alias("_exact_url")).agg(F.min(cand).alias("_exact"))
    j = (pushes.join(exact, pushes[url_col] == exact["_exact_url"], "left")
         .withColumn("_needle", F.when(F.col("_exact").isNull() & F.col(url_col).isNotNull(), needle_key(url_col, mode))))
    urls = repos.filter("url IS NOT NULL").groupBy(F.lower("url").alias("url")).agg(F.min(cand).alias("cand"))
    needles = j.filter(F.col("_needle").isNotNull()).select(F.col("_needle").alias("needle")).distinct()
    found = contains_candidates(needles, urls).filter(_matches(F.col("url"), F.col("needle"))).select("needle", "cand")
    best = (found.unionByName(_by_length(needles, urls)).groupBy(F.col("needle").alias("_n")).agg(F.min("cand").alias("_within")))
    out = j.join(best, F.col("_needle") == F.col("_n"), "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_within").isNotNull(), "contains")
    return (out.withColumn("repository_id", F.coalesce(F.col("_exact._id"), F.col("_within._id"))).withColumn("match", how)
            .drop("_exact_url", "_exact", "_needle", "_n", "_within"))


def candidate_report(pushes: DataFrame, repos: DataFrame, url_col: str = "repo_url", mode: str = "charset") -> DataFrame:
    """Per needle: how many URLs its rarest gram makes it look at, and how many of them match."""
    urls = repos.filter("url IS NOT NULL").select(F.lower("url").alias("url")).distinct().withColumn("cand", F.lit(0))
    needles = pushes.filter(F.col(url_col).isNotNull()).select(needle_key(url_col, mode).alias("needle")).distinct()
    seen = contains_candidates(needles, urls)
    return seen.groupBy("needle").agg(F.count(F.lit(1)).alias("candidates"),
                                      F.count_if(_matches(F.col("url"), F.col("needle"))).alias("matches"))
