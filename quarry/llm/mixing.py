"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

A document of a source with expected copies x = target / size is taken floor(x) times and once
more with the fractional probability left. These fractions are rounded in pairs: two documents
exchange word mass, in a random direction whose odds keep both expectations, until one of them is
integral. Every exchange keeps the source's expected words exactly, so a block of documents ends
with at most one fractional document. The residuals of all blocks form the next, smaller level of
a tree; the last one of a source is drawn by itself. Of m rows that are alike, floor(p m) are taken
and one stands in the tree with what is left. The source's words therefore miss the target by less
than one row's.

All draws are hashes of the seed and the documents: running again gives the same mix.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Documents of a block of the tree, on average (hash classes: sizes scatter by its root).
BLOCK = 128
#: Words as the mix counts them.
WORD = r"[^\x20\x09-\x0D]+"
#: Probabilities closer to 0 or 1 than this are integral (they differ by rounding only).
EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(units: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """One row per source: ``sid`` (its place by code point, null last), size, units, target, x.

    Targets share ``share`` times all words by weight. A source whose part would pass ``most``
    times its size gets that; the excess goes to the others by weight. The level that this
    sharing ends at is computed directly: with sources in order of cap / weight, it is that of
    the first source whose part of what the capped ones before it leave stays under its cap.
    The windows span all sources, which are aggregated before: one row each.
    """
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"),
                                      F.count(F.when(F.col("size") > 0, 1)).alias("n_units"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     F.pmod(F.col("sid"), F.lit(len(weights))) + 1)
    per = (per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
           .withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
           .withColumn("ratio", F.col("cap") / F.col("w")))
    by_ratio = Window.orderBy("ratio", "sid")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * float(share)
    per = per.withColumn("level", (total - before) / rest)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(Window.partitionBy())
    per = per.withColumn("target", F.least(F.col("cap"), F.coalesce(first["level"] * F.col("w"), F.col("cap"))))
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("sid", "source", "source_size", "n_units", "target", x.alias("x"))


def _draw(seed: int, *of: Column) -> Column:
    """A hash of ``of`` as a number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)) / float(1 << 52)


def _duel(seed: int, i: Column, j: Column) -> Column:
    """Exchange word mass between ``i`` and ``j`` until one is integral: the changed pair."""
    up = F.least((1 - i["p"]) * i["mass"], j["p"] * j["mass"])
    down = F.least(i["p"] * i["mass"], (1 - j["p"]) * j["mass"])
    u = _draw(seed, i["doc_id"], i["size"], j["doc_id"], j["size"])
    moved = F.when(u * (up + down) < down, up).otherwise(-down)

    def to(unit, mass):
        p = unit["p"] + mass / unit["mass"]
        return unit.withField("p", F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p))

    return F.element_at(F.transform(F.array(moved), lambda d: F.array(to(i, d), to(j, -d))), 1)


def _fold(units: Column, seed: int) -> Column:
    """The block's documents after pairing them in turn; at most one stays fractional.

    The accumulator holds the documents met, the fractional one (if any) last.
    """
    open_ = lambda x: (x["p"] > 0) & (x["p"] < 1)

    def settled(pair):  # the integral one first
        a, b = F.element_at(pair, 1), F.element_at(pair, 2)
        return F.when(open_(a), F.array(b, a)).otherwise(F.array(a, b))

    def step(done, x):
        last = F.element_at(done, -1)
        bound = F.transform(F.array(_duel(seed, last, x)), settled)
        return (F.when(F.size(done) == 0, F.array(x))
                .when(open_(last), F.concat(F.slice(done, 1, F.size(done) - 1), F.element_at(bound, 1)))
                .otherwise(F.concat(done, F.array(x))))

    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), F.slice(units, 1, 1), step)


def mix_decisions(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5,
                  most: float = 2.0, seed: int = 7) -> DataFrame:
    """Copies of each document: source, doc_id, size, m, source_size, target, copies, extra.

    One row per distinct (source, doc_id, size); ``m`` counts the rows it stands for. Each of them
    is taken ``copies`` times, and ``extra`` of them once more. Sizes are word counts, null texts
    have none. A null source is a source (the last one), a null doc_id an id. Documents without
    words take nothing from the target; they get floor(x) or one copy more, by a draw of their own.
    Empty table: no rows.
    """
    units = (docs.select("source", "doc_id", word_count(F.col("text")).alias("size"))
             .groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("m")))
    units = materialize(units, "mix-units")
    sources = materialize(source_targets(units, list(weights), share, most), "mix-sources")
    largest = sources.agg(F.max("n_units")).first()[0] or 0
    whole = F.floor(F.col("x") + EPS)
    part = F.greatest(F.col("x") - whole, F.lit(0.0))
    units = (units.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
             .select("sid", "doc_id", "size", "m", F.col("size").cast("double").alias("mass"),
                     "n_units", whole.cast("int").alias("whole"), (part * F.col("m")).alias("rows")))
    # Of m rows alike this many are taken once more for sure; one takes part with the rest.
    sure = F.floor(F.col("rows") + EPS)
    left = F.col("rows") - F.col("sure")
    units = units.withColumn("sure", sure).withColumn("p", F.when(left < EPS, 0.0).otherwise(left)).drop("rows")
    # Structs sort by their fields in turn: the largest word mass first.
    unit = F.struct((-F.col("mass")).alias("order"), "doc_id", "size", "m", "mass", "whole", "sure", "p")
    fixed = (F.col("size") == 0) | (F.col("p") == 0)
    alone = units.filter(fixed).select("sid", unit.alias("u"))
    level, n, parts = units.filter(~fixed).select("sid", "n_units", unit.alias("u")), largest, []
    for depth in range(64):
        blocks = F.ceil(F.col("n_units") / float(BLOCK) ** (depth + 1))
        key = F.pmod(F.xxhash64(F.lit(seed + depth), "sid", "u.doc_id", "u.size"), blocks)
        in_order = F.sort_array(F.collect_list("u"))
        folded = (level.groupBy("sid", "n_units", key.alias("_block"))
                  .agg(_fold(in_order, seed + depth).alias("_units"))
                  .select("sid", "n_units", F.explode("_units").alias("u")))
        folded = materialize(folded, f"mix-level{depth}")
        is_open = (F.col("u.p") > 0) & (F.col("u.p") < 1)
        parts.append(folded.filter(~is_open).select("sid", "u"))
        level = folded.filter(is_open)
        n = math.ceil(n / BLOCK)
        if n <= 1:
            break
    done = reduce(DataFrame.unionByName, [alone, level.select("sid", "u"), *parts])
    drawn = F.when(_draw(seed + 99, F.col("u.doc_id"), F.col("u.size")) < F.col("u.p"), 1).otherwise(0)
    return (done.join(sources, "sid")
            .select("source", "u.doc_id", "u.size", "u.m", "source_size", "target",
                    F.col("u.whole").cast("long").alias("copies"), (F.col("u.sure") + drawn).cast("long").alias("extra")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, columns unchanged.

    Which of the rows alike in (source, doc_id, size) are taken once more goes by their order in the
    input: they are counted per input partition, the partitions' counts are added up, and each row
    is numbered within its partition, so that a row that makes up the whole table is no one task's.
    """
    plan = mix_decisions(docs, **options).select(
        F.col("source").alias("_q_source"), F.col("doc_id").alias("_q_id"), F.col("size").alias("_q_size"),
        F.col("m").alias("_q_m"), F.col("copies").alias("_q_copies"), F.col("extra").alias("_q_extra"))
    plan = materialize(plan, "mix-plan")
    on = lambda d, size: (d["source"].eqNullSafe(F.col("_q_source")) & d["doc_id"].eqNullSafe(F.col("_q_id"))
                          & (size == F.col("_q_size")))
    met = docs.join(plan.filter("_q_copies + _q_extra > 0"), on(docs, word_count(docs["text"])))
    parted = (F.col("_q_m") > 1) & (F.col("_q_extra") > 0) & (F.col("_q_extra") < F.col("_q_m"))
    alone = met.filter(~parted).withColumn("_q_times", F.col("_q_copies") + F.when(F.col("_q_extra") > 0, 1).otherwise(0))
    some = plan.filter(parted)
    parts = [alone.select(*docs.columns, "_q_times")]
    if not some.isEmpty():
        row = F.monotonically_increasing_id()
        rows = docs.withColumn("_q_row", row)
        rows = rows.join(some, on(rows, word_count(rows["text"])))
        rows = rows.withColumn("_q_part", F.shiftright("_q_row", 33))
        key = ["_q_source", "_q_id", "_q_size"]
        before = Window.partitionBy(*key).orderBy("_q_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (rows.groupBy(*key, "_q_part").agg(F.count(F.lit(1)).alias("_q_n"))
                   .withColumn("_q_before", F.coalesce(F.sum("_q_n").over(before), F.lit(0)))
                   .select(*[F.col(c).alias(f"{c}_") for c in [*key, "_q_part"]], "_q_before"))
        same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in [*key, "_q_part"]]
        inside = F.row_number().over(Window.partitionBy(*key, "_q_part").orderBy("_q_row"))
        numbered = rows.withColumn("_q_inside", inside).join(offsets, same)
        more = F.when(F.col("_q_before") + F.col("_q_inside") <= F.col("_q_extra"), 1).otherwise(0)
        parts.append(numbered.withColumn("_q_times", F.col("_q_copies") + more).select(*docs.columns, "_q_times"))
    taken = reduce(DataFrame.unionByName, parts).filter(F.col("_q_times") > 0)
    return (taken.withColumn("_q_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_q_times"))))
            .select(*docs.columns))
