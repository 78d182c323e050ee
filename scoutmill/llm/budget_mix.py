"""Mixing sources to target weights (operator 11): subset-sum budget fitting.

Each source has a target number of words. Whole passes over the source come
first; what is left of the target is fitted by documents: lengths are counted
exactly, most of the rest is dealt over the lengths in proportion to their
counts, and a bounded knapsack over (length, count) fills the last
``dp_budget`` words, to the word where the lengths allow it. Last, documents
are chosen by a seeded order inside each (source, length) until the length's
count is met.

Only lengths and their counts go to the task that fits a source: different
lengths that sum to a source's size are fewer than the square root of twice
that size. The seeded order runs over range-partitioned slices, so that a
length that a third of all documents share is spread over many tasks. Targets
are found by rounds of sums over the table of sources; nothing but four
numbers a round reaches the driver.

Defined cases: a null or empty text has no words and takes none; a null source
is a source of its own and comes last; a null ``doc_id`` is carried through;
repeated rows count each, and as many of them are taken as their length's count
asks for; a source without words has target 0; an empty table gives an empty
result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutmill.operators.ordering import number_rows
from scoutmill.session import keep

WEIGHTS = (5, 2, 1)
#: A document, and so a source, is repeated at most this often.
MOST = 3
#: Words that the knapsack fits; the rest of a budget is dealt in proportion before it.
DP_BUDGET = 65_536
WIDE = "decimal(38,0)"


def n_words(text: Column) -> Column:
    """Words between blanks, tabs and line ends (long); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, draw, row) of every document; ``row`` only parts rows that are equal in all else."""
    draw = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw.alias("draw"))
    return keep(rows.withColumn("row", F.monotonically_increasing_id()))


def target_sizes(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target``: all words shared by weight, at most ``most`` times a source's size, the excess shared again.

    ``sources`` has (source, source_size). A source stops where its share passes
    its bound; each round shares what the stopped ones leave, which only raises
    the other shares, until no further source stops.
    """
    place = number_rows(sources, [F.col("source").asc_nulls_last()], name="place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = keep(place.withColumn("weight", weight.cast(WIDE)).withColumn("bound", F.col("source_size").cast(WIDE) * most))
    words = int(rows.agg(F.coalesce(F.sum(F.col("source_size").cast(WIDE)), F.lit(0))).first()[0])
    per_weight, stopped = Fraction(0), None
    while True:
        # bound < per_weight * weight, in whole numbers
        over = F.col("bound") * F.lit(per_weight.denominator).cast(WIDE) < F.col("weight") * F.lit(per_weight.numerator).cast(WIDE)
        count, bounds, free = rows.agg(
            F.coalesce(F.count_if(over), F.lit(0)), F.coalesce(F.sum(F.when(over, F.col("bound"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if count == stopped:
            break
        stopped = count
        per_weight = Fraction(words - int(bounds), int(free)) if free else per_weight
    share = F.col("weight").cast("double") * F.lit(float(per_weight))
    return rows.select("source", "source_size", F.when(over, F.col("bound").cast("double")).otherwise(F.least(share, F.col("bound").cast("double"))).alias("target"))


def fit_lengths(sizes: Sequence[int], counts: Sequence[int], budget: int, dp_budget: int = DP_BUDGET) -> list[int]:
    """How many documents of each size to take, so that their words come as near ``budget`` as the knapsack gets them.

    ``sizes`` are distinct and positive. Up to ``dp_budget`` the sum is the
    nearest that any choice gives (the lower of two).
    """
    sizes, counts = [int(s) for s in sizes], [int(c) for c in counts]
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    taken = [0] * len(sizes)
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return counts
    dealt = max(0, budget - dp_budget)
    taken = [c * dealt // total for c in counts]
    left = budget - sum(s * t for s, t in zip(sizes, taken, strict=True))
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    for i in order:  # what the rounding down left beyond the knapsack's budget
        more = min(counts[i] - taken[i], max(0, left - dp_budget) // sizes[i])
        taken[i] += more
        left -= more * sizes[i]
    for i, more in knapsack(sizes, [c - t for c, t in zip(counts, taken, strict=True)], left).items():
        taken[i] += more
    return taken


def knapsack(sizes: Sequence[int], counts: Sequence[int], budget: int) -> dict[int, int]:
    """Index -> how many of it, for the sum nearest ``budget`` (the lower of two); sums up to twice the budget are looked at."""
    width = 2 * budget
    reached = np.zeros(width + 1, dtype=bool)
    reached[0] = True
    via = np.full(width + 1, -1, dtype=np.int32)  # the bundle that first gave this sum
    bundles: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        size, left, step = sizes[i], min(counts[i], width // sizes[i]), 1
        while left > 0 and not reached[budget]:
            many = min(step, left)
            weight = many * size
            new = reached[: width + 1 - weight] & ~reached[weight:]
            reached[weight:] |= new
            via[weight:][new] = len(bundles)
            bundles.append((i, many))
            left, step = left - many, step * 2
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at, taken = int(sums[np.argmin(np.abs(sums - budget))]), {}
    while at:
        i, many = bundles[via[at]]
        taken[i] = taken.get(i, 0) + many
        at -= many * sizes[i]
    return taken


def choose_lengths(lengths: DataFrame, dp_budget: int = DP_BUDGET) -> DataFrame:
    """(source_key, size, chosen) from (source_key, size, docs, budget), one task per source's list of lengths."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        chosen = fit_lengths(frame["size"].tolist(), frame["docs"].tolist(), int(frame["budget"].iloc[0]), dp_budget)
        return pd.DataFrame({"source_key": frame["source_key"], "size": frame["size"], "chosen": chosen})

    return lengths.where("size > 0").groupBy("source_key").applyInPandas(fit, "source_key string, size long, chosen long")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 11, dp_budget: int = DP_BUDGET) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words, repeats counted)."""
    rows = sized(docs, seed)
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # a null source is a key as well
    lengths = keep(rows.groupBy("source", "size").agg(F.count("*").alias("docs")))
    sources = keep(target_sizes(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), weights, most))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    plan = sources.withColumn("passes", passes).withColumn("budget", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")).withColumn("source_key", key)
    wanted = lengths.withColumn("source_key", key).join(plan.select("source_key", "budget"), "source_key")
    chosen = keep(choose_lengths(wanted, dp_budget))
    numbered = number_rows(rows.withColumn("source_key", key), ["draw", "doc_id", "row"], name="rank", keys=["source_key", "size"])
    fitted = numbered.join(plan.select("source_key", "source_size", "target", "passes"), "source_key").join(chosen, ["source_key", "size"], "left")
    extra = F.when(F.col("rank") <= F.coalesce("chosen", F.lit(0)), 1).otherwise(0)
    return fitted.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + extra)).alias("taken"))
