"""Mixing sources to target weights.

Tokens are summed by source, a repetition rate follows for each source, and a document is emitted floor(rate) times
plus one hash-seeded Bernoulli copy with the rate's fraction as its probability.

Nulls: a null source is a source of its own, ordered last; a null text has no tokens; a null id hashes like an empty
string. Sources without tokens get target 0 and emit nothing. Repeated rows get equal decisions. Empty tables give an
empty result. Other columns are carried along by :func:`emit` and never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import hash_fraction, materialise, only

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
CYCLE = (1, 2, 3)
SEED, SEEDS = "mix-1", 16


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sums: DataFrame, weights: tuple[int, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """Targets by source from (source, source_size): shares by weight of the whole, none above ``most`` times its size.

    Resharing the excess by weight until no source is above its limit ends at target = min(limit, level * weight). In
    the order of limit/weight the limited sources come first, so the level follows from running sums over one row per
    source.
    """
    ordered = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    s = sums.select(
        "source",
        "source_size",
        F.element_at(cycle, ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")).alias("w"),
        (F.col("source_size") * most).alias("limit"),
    )
    everything = Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), "w", "limit", F.asc_nulls_last("source"))
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("limit").over(upto), F.lit(0)).alias("used"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0))).alias("w_left"),
    ).withColumn("level_here", (F.col("total") - F.col("used")).cast("double") / F.col("w_left").cast("double"))
    # The first source whose limit is not below the level fixes it; all before it are limited.
    fits = F.col("limit").cast("double") >= F.col("level_here") * F.col("w")
    s = s.withColumn("level", F.min(F.when(fits, F.struct("used", "level_here"))).over(everything)["level_here"])
    target = F.least(F.col("limit").cast("double"), F.col("level") * F.col("w"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), target / F.col("source_size"))).otherwise(F.lit(0.0))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"), rate.alias("rate"))


def copies_of(rate: Column, key: Column, seed: str, k: Column) -> Column:
    """floor(rate) and one more with the fraction as probability, by candidate seed ``k``."""
    whole = F.floor(rate)
    return (whole + F.when(hash_fraction(key, seed, k) < rate - whole, 1).otherwise(0)).cast("int")


def source_rates(sized: DataFrame, weights: tuple[int, ...] = CYCLE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """source, source_size, target, rate and k of every source.

    Each document's extra copy is a Bernoulli draw by hash. Sources of few or very unequal documents would stray from
    their targets, so the draw is made with ``SEEDS`` candidate seeds, whose totals one aggregation gives, and each
    source takes the seed that comes nearest; of equals the first.
    """
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    targets = materialise(targets, "mix-targets")
    joined = sized.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source"))
    totals = joined.groupBy("d.source").agg(
        F.first("t.target").alias("target"),
        F.array(*[F.sum(F.col("d.size") * copies_of(F.col("t.rate"), F.col("d.doc_id"), seed, F.lit(k))) for k in range(SEEDS)]).alias("n"),
    )
    off = F.transform("n", lambda n, k: F.struct(F.round(F.abs(n - F.col("target"))).alias("off"), k.alias("k")))
    best = totals.select("source", F.array_min(off)["k"].alias("k")).alias("b")
    return targets.alias("t").join(best, F.expr("t.source <=> b.source")).select("t.*", "b.k")


def sizes(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "source", "text").select("doc_id", "source", count_words(F.col("text")).alias("size"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = CYCLE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies for every document, those with no copy included."""
    sized = materialise(sizes(docs), "mix-sizes")
    rates = source_rates(sized, weights, most, seed)
    joined = sized.alias("d").join(rates.alias("t"), F.expr("d.source <=> t.source"))
    copies = copies_of(F.col("t.rate"), F.col("d.doc_id"), seed, F.col("t.k"))
    return joined.select("d.doc_id", "d.source", "d.size", "t.source_size", "t.target", "t.rate", copies.alias("copies"))


def emit(docs: DataFrame, weights: tuple[int, ...] = CYCLE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each repeated as often as the mix takes it."""
    names = docs.columns
    rates = materialise(source_rates(materialise(sizes(docs), "mix-sizes"), weights, most, seed), "mix-rates").select(
        F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate"), F.col("k").alias("__mix_k")
    )
    joined = docs.join(rates, F.col("source").eqNullSafe(F.col("__mix_source")))
    n = copies_of(F.col("__mix_rate"), F.col("doc_id"), seed, F.col("__mix_k"))
    times = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)"))
    return joined.select(*[F.col(f"`{c}`") for c in names], F.explode(times).alias("__mix_copy")).select(*[f"`{c}`" for c in names])
