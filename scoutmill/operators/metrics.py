"""Aggregations: corpus, latency, batch, tool, validation and mismatch metrics."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutmill.functions import arrays as A
from scoutmill.functions.text import token_count
from scoutmill.operators.groups import join_on, map_runs, top_rows, with_group_stats, with_totals
from scoutmill.operators.ordering import number_rows, ordered
from scoutmill.session import keep


def _filled(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("")) != ""


def corpus_stats(df: DataFrame, url: str = "url", text: str = "text", title: str | None = "title", created: str | None = None) -> DataFrame:
    """One row about a document table; counting distinct URLs is the only shuffle of size."""
    valid = _filled(url) & _filled(text)
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(valid).alias("n_valid"),
        F.countDistinct(url).alias("n_urls"),
        F.sum(F.when(valid, F.length(text))).alias("total_text_chars"),
        F.avg(F.when(valid, F.length(text))).alias("avg_text_chars"),
    ]
    for name in [url] + ([title] if title else []):
        aggs += [F.min(F.length(name)).alias(f"min_{name}_chars"), F.max(F.length(name)).alias(f"max_{name}_chars"),
                 F.avg(F.length(name)).alias(f"avg_{name}_chars")]
    if created:
        aggs += [F.min(created).alias("first_created"), F.max(created).alias("last_created")]
    return df.agg(*aggs)


def ingest_report(df: DataFrame, url: str, title: str, text: str, embedding: Column, max_chars: int = 1024,
                  malformed: Column | None = None) -> DataFrame:
    """Counters of a load: read, empty, malformed, cut titles and URLs, embedding text lengths, repeated keys."""
    read = F.count(F.lit(1))
    empty = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    return df.agg(
        read.alias("n_read"),
        F.count_if(~empty).alias("n_written"),
        F.count_if(empty).alias("n_empty"),
        (F.count(url) - F.countDistinct(url)).alias("n_duplicate"),
        (F.count_if(malformed) if malformed is not None else F.lit(0).cast("long")).alias("n_malformed"),
        F.count_if(F.length(url) > max_chars).alias("n_cut_url"),
        F.count_if(F.length(title) > max_chars).alias("n_cut_title"),
        F.avg(F.length(embedding)).alias("avg_embedding_chars"),
        F.min(F.length(embedding)).alias("min_embedding_chars"),
        F.max(F.length(embedding)).alias("max_embedding_chars"),
    )


def funnel(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Rows left after each stage and their share of the first stage."""
    parts = [df.agg(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n")) for i, (name, df) in enumerate(stages.items())]
    first = next(iter(stages.values())).agg(F.count(F.lit(1)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rate", F.try_divide(F.col("n"), first.scalar()))


def truthy(df: DataFrame, col: str) -> Column:
    """Correctness stored as boolean, number or text as a boolean; null is false."""
    kind = df.schema[col].dataType.typeName()
    c = F.col(col)
    if kind == "boolean":
        out = c
    elif kind == "string":
        out = F.lower(F.trim(c)).isin("true", "1", "yes")
    else:
        out = c != 0
    return F.coalesce(out, F.lit(False))


def judge_summary(df: DataFrame, status: Column, correct: Column) -> DataFrame:
    """Totals of a judged run; everything not "ok" is skipped, errors among it counted; accuracy null when none is judged."""
    judged = F.coalesce(status == "ok", F.lit(False))
    return df.agg(
        F.count_if(judged).alias("total"),
        F.count_if(judged & correct).alias("correct"),
        F.count_if(judged & ~correct).alias("incorrect"),
        F.count_if(~judged).alias("skipped"),
        F.count_if(status == "error").alias("errors"),
        F.try_divide(F.count_if(judged & correct), F.count_if(judged)).alias("accuracy"),
    )


def method_breakdown(df: DataFrame, method: str, correct: Column, score: str, turns: str | None = None, judged: Column | None = None) -> DataFrame:
    """Counts and accuracy per method; zero turns do not count into their mean."""
    aggs = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(correct).alias("correct"),
        F.count_if(~correct).alias("incorrect"),
        F.count_if(correct.isNull()).alias("unknown"),
        F.try_divide(F.count_if(correct), F.count_if(correct.isNotNull())).alias("accuracy"),
        F.avg(score).alias("mean_score"),
    ]
    if turns:
        aggs.append(F.avg(F.when(F.col(turns) > 0, F.col(turns))).alias("mean_turns"))
    if judged is not None:
        aggs += [F.count_if(judged).alias("judged"), F.count_if(judged & correct).alias("judged_correct")]
    return df.groupBy(method).agg(*aggs)


def token_stats(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """Total, mean and largest token count of each named field and of all fields together."""
    counts = {**fields}
    total = None
    for c in fields.values():
        total = c if total is None else total + c
    counts["total"] = total
    aggs = []
    for name, c in counts.items():
        aggs += [F.sum(c).alias(f"{name}_tokens"), F.avg(c).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max")]
    return df.agg(*aggs)


def tokens_by_role(df: DataFrame, conv: str, role: str, text: str) -> DataFrame:
    return df.groupBy(conv, role).agg(F.sum(token_count(text)).alias("tokens"))


def words_after_prompt(messages: Column, prompt: Column) -> Column:
    """White-space words in the turns that follow a prompt of as many turns; both are arrays, messages with ``content``."""
    later = F.slice(messages, F.size(prompt) + 1, F.greatest(F.size(messages) - F.size(prompt), F.lit(0)))
    words = lambda m: F.size(F.filter(F.split(m["content"], r"\s+"), lambda w: w != ""))
    return F.aggregate(F.transform(later, words), F.lit(0), lambda acc, n: acc + n)


def length_histogram(df: DataFrame, value: Column, edges: Sequence[float]) -> DataFrame:
    """Rows per half-open bin, with percent and running percent of all rows (also those outside the bins)."""
    bin_no = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        bin_no = F.when((value >= edges[i]) & (value < edges[i + 1]), F.lit(i)).otherwise(bin_no)
    counts = df.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    table = all_bins.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    total = df.agg(F.count(F.lit(1))).scalar()
    table = table.withColumn("percent", F.col("n") * 100.0 / total)
    # One row per bin, so the ordered window is over a handful of rows.
    from pyspark.sql import Window

    running = F.sum("n").over(Window.orderBy("bin")) * 100.0 / total
    lows = F.array(*[F.lit(float(e)) for e in edges])
    return table.select("bin", F.get(lows, F.col("bin")).alias("low"), F.get(lows, F.col("bin") + 1).alias("high"), "n", "percent",
                        running.alias("cumulative_percent"))


def ranked_values(df: DataFrame, value: str, positions: Mapping[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """Values at given 1-based ranks of the ascending order, one row per group.

    ``positions`` may use ``n`` (rows in the group). Equal values are counted
    first, so the running count is over distinct values.
    """
    known = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"))
    counts = known.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = ordered(counts, ["_v"], list(groups)).running_sum(F.col("_c"), "_upto").result()
    sized = with_group_stats(upto, groups, n=F.sum("_c")) if groups else with_totals(upto, n=F.sum("_c"))
    picks = [
        F.max(F.when((F.col("_upto") - F.col("_c") < pos) & (F.col("_upto") >= pos), F.col("_v"))).alias(name)
        for name, pos in positions.items()
    ]
    return sized.groupBy(*groups).agg(*picks) if groups else sized.agg(*picks)


def quantiles(df: DataFrame, value: str, shares: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles, exact, out of ranks instead of one task's sorted buffer."""
    at = lambda p: (F.col("n") - 1) * F.lit(p)
    ranks = {}
    for name, p in shares.items():
        ranks[f"_lo_{name}"], ranks[f"_hi_{name}"] = F.floor(at(p)) + 1, F.ceil(at(p)) + 1
    n = df.agg(F.count(value)).scalar()
    row = ranked_values(df, value, ranks).withColumn("n", n)
    part = lambda p: at(p) - F.floor(at(p))
    return row.select(*[(F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * part(p)).alias(k) for k, p in shares.items()])


def latency_summary(df: DataFrame, col: str, groups: Sequence[str] = (), shares: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Count, mean, extremes and the value at index int(n * p), the index kept inside the list."""
    n = F.col("n")
    positions = {f"p{round(p * 100)}": F.least(F.floor(n * F.lit(p)) + 1, n) for p in shares}
    ranks = ranked_values(df, col, positions, groups)
    basic = [F.count(col).alias("n"), F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max")]
    if groups:
        return join_on(df.groupBy(*groups).agg(*basic), ranks, groups)
    row = ranks.select(F.struct(*positions).alias("r")).scalar()
    return df.agg(*basic).withColumn("r", row).select("n", "mean", "min", "max", "r.*")


def length_summary(df: DataFrame, col: str) -> DataFrame:
    """Mean, middle value sorted[n // 2], extremes."""
    ranks = ranked_values(df, col, {"median": F.floor(F.col("n") / 2) + 1})
    basic = df.agg(F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"))
    return basic.withColumn("median", ranks.scalar())


def _spread(name: str, c: Column) -> list[Column]:
    return [F.avg(c).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max"), F.min(c).alias(f"{name}_min")]


def batch_metrics(df: DataFrame, max_response: int, max_prompt: int, score: str = "score", reward: str = "reward",
                  response: str = "response_length", prompt: str = "prompt_length", turns: str = "num_turns",
                  correct: str = "correct", method: str = "method") -> DataFrame:
    """One pass over a batch: score and length statistics, clip and abort ratios, causes of missing answers."""
    length, alive = F.col(response), F.col(response) != 0
    right, wrong = F.col(correct), ~F.col(correct)
    share = lambda c: F.avg(c.cast("double"))
    source = with_totals(df, _turns=F.max(turns))
    lost = wrong & (F.col(method) == "no_extraction")
    turns_out, length_out = F.col(turns) >= F.col("_turns"), length >= max_response
    return source.agg(
        *_spread("score", F.when(alive, F.col(score))),
        *_spread("reward", F.when(alive, F.col(reward))),
        *_spread("response_length", length),
        share(length == max_response).alias("response_clip_ratio"),
        *_spread("response_length_non_aborted", F.when(alive, length)),
        share(F.when(alive, length == max_response)).alias("response_clip_ratio_non_aborted"),
        share(~alive).alias("aborted_ratio"),
        *_spread("prompt_length", F.col(prompt)),
        share(F.col(prompt) == max_prompt).alias("prompt_clip_ratio"),
        *_spread("num_turns", F.col(turns)),
        share(right).alias("correct_ratio"),
        *_spread("correct_length", F.when(right, length)),
        *_spread("incorrect_length", F.when(wrong, length)),
        *_spread("correct_turns", F.when(right, F.col(turns))),
        *_spread("incorrect_turns", F.when(wrong, F.col(turns))),
        share(F.col(method) == "no_extraction").alias("no_extraction_ratio"),
        share(F.when(lost, turns_out)).alias("no_extraction_turns_out"),
        share(F.when(lost, length_out)).alias("no_extraction_length_out"),
        share(F.when(lost, ~turns_out & ~length_out)).alias("no_extraction_other"),
    )


def token_level_metrics(df: DataFrame, columns: Sequence[str], mask: str) -> DataFrame:
    """Mean, max and min of array columns (advantages, returns, values) over response tokens."""
    zipped = F.filter(F.arrays_zip(*columns, mask), lambda t: t[mask] == 1)
    tokens = df.select(F.explode(zipped).alias("t"))
    return tokens.agg(*[m for c in columns for m in _spread(c, F.col(f"t.{c}"))])


def explained_variance(df: DataFrame, values: str, returns: str, mask: str) -> DataFrame:
    """1 - var(returns - values) / (var(returns) + 1e-5) over response tokens."""
    zipped = F.filter(F.arrays_zip(values, returns, mask), lambda t: t[mask] == 1)
    tokens = df.select(F.explode(zipped).alias("t"))
    diff = F.col(f"t.{returns}") - F.col(f"t.{values}")
    return tokens.agg((1 - F.var_samp(diff) / (F.var_samp(f"t.{returns}") + 1e-5)).alias("explained_variance"))


def tool_metrics(df: DataFrame, metrics: str = "metrics", times: str | None = "times") -> DataFrame:
    """Counts, rates and pooled times per tool out of keys ``tool/<name>/<metric>``."""
    flat = df.select(F.explode(metrics).alias("key", "value")).withColumn("part", F.split("key", "/"))
    flat = flat.filter((F.get("part", F.lit(0)) == "tool") & (F.size("part") >= 3)).select(
        F.get("part", F.lit(1)).alias("tool"), F.get("part", F.lit(2)).alias("metric"), "value")
    total = lambda name: F.coalesce(F.sum(F.when(F.col("metric") == name, F.col("value"))), F.lit(0.0))
    fields = ["total_count", "success_count", "failure_count", "cache_count", "crawler_count", "fabricated_url_count", "checked_url_count"]
    table = flat.groupBy("tool").agg(*[total(f).alias(f) for f in fields])
    visit = F.col("tool") == "visit"
    table = (
        table.withColumn("success_rate", F.try_divide("success_count", "total_count"))
        .withColumn("cache_rate", F.when(visit, F.try_divide(F.col("cache_count"), F.col("cache_count") + F.col("crawler_count"))))
        .withColumn("fabricated_url_ratio", F.when(visit, F.try_divide("fabricated_url_count", "total_count")))
    )
    if times is None:
        return table
    pooled = df.select(F.explode(times).alias("key", "values")).withColumn("part", F.split("key", "/"))
    pooled = pooled.filter((F.get("part", F.lit(0)) == "tool") & (F.get("part", F.lit(2)) == "times")).select(
        F.get("part", F.lit(1)).alias("tool"), F.explode("values").alias("t"))
    spent = pooled.groupBy("tool").agg(F.avg("t").alias("time_mean"), F.max("t").alias("time_max"), F.min("t").alias("time_min"))
    return join_on(table, spent, ["tool"])


def slowest_row(df: DataFrame, duration: str, columns: Sequence[str]) -> DataFrame:
    """The row with the longest duration."""
    return df.agg(F.max_by(F.struct(*columns), F.struct(duration, *columns)).alias("r")).select("r.*")


def merge_progress(df: DataFrame, stats: Mapping[str, str] | None = None) -> DataFrame:
    """Worker reports as one: sums, means weighted by completed samples, extremes, throughput over the slowest."""
    c = lambda name: F.col(stats[name] if stats else name)
    weighted = lambda name: (F.sum(c(name) * c("completed")) / F.sum(c("completed")))
    merged = df.agg(
        *[F.sum(c(n)).alias(n) for n in ("total_samples", "completed", "failed", "total_turns", "total_tool_calls")],
        *[weighted(n).alias(n) for n in ("duration_avg", "avg_turns_per_sample", "avg_tools_per_sample")],
        F.min(c("duration_min")).alias("duration_min"), F.max(c("duration_max")).alias("duration_max"),
        F.avg(c("duration_p50")).alias("duration_p50"), F.max(c("duration_p95")).alias("duration_p95"),
        F.max(c("total_duration")).alias("total_duration"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return merged.withColumn("success_rate", zero(F.try_divide("completed", "total_samples"))).withColumn(
        "throughput", zero(F.try_divide("total_samples", "total_duration")))


def group_outcomes(df: DataFrame, uid: str, correct: Column) -> DataFrame:
    """Shares of groups that are all correct, all incorrect, mixed."""
    g = df.groupBy(uid).agg(F.bool_and(correct).alias("a"), F.bool_or(correct).alias("o"))
    share = lambda c: F.avg(c.cast("double"))
    return g.agg(share(F.col("a")).alias("all_correct_ratio"), share(~F.col("o")).alias("all_incorrect_ratio"),
                 share(F.col("o") & ~F.col("a")).alias("mixed_ratio"), F.count(F.lit(1)).alias("n_groups"))


def mean_std_at_n(df: DataFrame, source: str, uid: str, value: str) -> DataFrame:
    """Per source: mean@N and population std@N of each prompt, averaged over prompts."""
    per = df.groupBy(source, uid).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(source).agg(F.avg("m").alias("mean_at_n"), F.avg("s").alias("std_at_n"), F.max("n").alias("n_responses"))


def majority_value(df: DataFrame, uid: Sequence[str], vote: str, value: str, order: str) -> DataFrame:
    """Value at the first response that gives the most frequent prediction (ties: prediction seen first)."""
    votes = df.groupBy(*uid, vote).agg(F.count(F.lit(1)).alias("n_votes"), F.min(order).alias("_at"), F.min_by(value, order).alias("value"))
    return top_rows(votes, list(uid), [F.col("n_votes").desc(), F.col("_at")]).drop("_at")


def subset_sizes(n: int) -> list[int]:
    """2, 4, 8, ... below n, then n."""
    sizes, k = [], 2
    while k < n:
        sizes.append(k)
        k *= 2
    return [*sizes, n]


def _majority(codes: np.ndarray, vals: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Majority value of each (group, round); ties go to the prediction drawn first.

    ``codes`` and ``vals`` are one line per group, codes counted from 0 within it; ``picks`` one line per draw.
    """
    size, many = len(picks), int(codes.max()) + 1
    slots = np.arange(picks.shape[1] * len(vals)).reshape(1, -1, len(vals)) * many + codes.T[picks]
    counts = np.bincount(slots.ravel(), minlength=picks.shape[1] * len(vals) * many)[slots]
    # The earliest of the greatest counts, found as one maximum.
    counts *= size
    counts += np.arange(size - 1, -1, -1)[:, None, None]
    draw = size - 1 - counts.max(axis=0).T % size
    return np.take_along_axis(vals, picks[draw, np.arange(picks.shape[1])], axis=1)


#: Values drawn at a time: 32 MB of positions.
DRAWN_AT_ONCE = 4_000_000
#: Values drawn at a time for small groups of one size together: they stay in the processor's cache.
DRAWN_TOGETHER = 250_000
#: Rows of a group that one task resamples for all rounds; larger groups have their rounds dealt over more tasks.
ROWS_PER_BLOCK = 20_000


#: Draws of a size that a task keeps, half a MB; they are the same for groups of any number of rows.
FEW_UNITS = 1 << 16


def resamples(n: int, size: int, rounds: Sequence[int] = range(1000), seed: int = 42, kept: dict | None = None) -> np.ndarray:
    """Positions of ``size`` draws out of ``n`` with replacement, one line per round.

    A draw is counted, not streamed: it comes from the md5 of (seed, size,
    round, draw), so any task gives any round and SQL repeats it. ``kept``
    holds the draws of small sizes from call to call.
    """
    def unit(r: int, d: int) -> int:
        return int(hashlib.md5(f"{seed}|{size}|{r}|{d}".encode()).hexdigest()[:8], 16)

    name = (size, tuple(rounds), seed)
    draws = kept.get(name) if kept is not None else None
    if draws is None:
        draws = np.fromiter((unit(r, d) for r in rounds for d in range(size)), dtype=np.int64, count=len(rounds) * size)
        if kept is not None and len(draws) <= FEW_UNITS:
            kept[name] = draws
    return (draws * n >> 32).reshape(-1, size) if n < 1 << 31 else (draws.astype(object) * n >> 32).astype(np.int64).reshape(-1, size)


#: Reducers of drawn values (one line per round), and of drawn positions where votes count.
REDUCERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"best": lambda drawn: drawn.max(axis=1), "worst": lambda drawn: drawn.min(axis=1)}


def reduced(vals: np.ndarray, picks: np.ndarray, codes: np.ndarray | None = None, reducers: Mapping[str, Callable] | None = None) -> dict[str, np.ndarray]:
    """A number per (group, round) and reducer, and the majority's value where there are votes.

    ``vals`` and ``codes`` are one line per group, ``picks`` one line per draw.
    """
    drawn = vals.T[picks]
    lines = drawn.reshape(len(picks), -1).T
    wide = lambda numbers: np.ascontiguousarray(np.asarray(numbers, dtype=float).reshape(drawn.shape[1:]).T)
    out = {name: wide(fn(lines)) for name, fn in (REDUCERS if reducers is None else reducers).items()}
    if codes is not None:
        out["maj"] = _majority(codes, vals, picks)
    return out


def _codes(votes: pd.Series, at: np.ndarray) -> np.ndarray:
    """Number of each vote within its group, from 0, for groups that are lines of positions; no vote counts as one."""
    names, _ = pd.factorize(votes, use_na_sentinel=False)
    keys = names[at] + np.arange(len(at))[:, None] * (int(names.max()) + 1)
    codes = np.unique(keys, return_inverse=True)[1].reshape(at.shape)
    return codes - codes.min(axis=1, keepdims=True)


def bootstrap(df: DataFrame, group: Sequence[str], value: str, sizes: Sequence[int] | None = None, vote: str | None = None,
              order: str | None = None, rounds: int = 1000, seed: int = 42, reducers: Mapping[str, Callable] | None = None,
              rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """best/worst/maj@n per group: rows (group, n, reducer, mean, std).

    ``reducers`` (name -> function of the drawn values, one number per line; a
    line is a round of a group) takes the place of best and worst. A group is the
    responses to one prompt, a handful as a rule, and groups of one size are
    drawn together. A group above ``rows_per_block`` rows has its rounds
    dealt over as many blocks as it fills; means and squares of the blocks are
    merged, so no group is too large.
    """
    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in group)
    wanted = [*group, value] + ([vote] if vote else []) + ([order] if order else [])
    sized = with_group_stats(df.select(*dict.fromkeys(wanted)), group, _blocks=F.count(F.lit(1)))
    blocks = F.least(F.ceil(F.col("_blocks") / rows_per_block).cast("int"), F.lit(rounds))
    dealt = sized.withColumn("_blocks", blocks).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    names = [*group, "n", "reducer", "c", "m", "s"]
    kept: dict[tuple, np.ndarray] = {}

    def run(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        vals, blocks, block = rows[value].to_numpy(dtype=float), rows["_blocks"].to_numpy()[starts], rows["_block"].to_numpy()[starts]
        alike = pd.DataFrame({"n": ends - starts, "blocks": blocks, "block": block}).groupby(["n", "blocks", "block"]).indices
        out = []
        for (many, parts, own), which in alike.items():
            for n in sizes or (subset_sizes(many) if many > 1 else []):
                own_rounds = range(own, rounds, parts)
                step = min(len(own_rounds), max(1, DRAWN_AT_ONCE // n))
                together = max(1, DRAWN_TOGETHER // (n * step))
                for first in range(0, len(which), together):
                    chosen = which[first : first + together]
                    at = starts[chosen][:, None] + np.arange(many)
                    codes = _codes(rows[vote], at) if vote else None
                    found: dict[str, list[np.ndarray]] = {}
                    for low in range(0, len(own_rounds), step):
                        picks = np.ascontiguousarray(resamples(many, n, own_rounds[low : low + step], seed, kept).T)
                        for name, numbers in reduced(vals[at], picks, codes, reducers).items():
                            found.setdefault(name, []).append(numbers)
                    for name, pieces in found.items():
                        x = np.concatenate(pieces, axis=1)
                        mean = x.mean(axis=1)
                        out.append((chosen, n, name, x.shape[1], mean, ((x - mean[:, None]) ** 2).sum(axis=1)))
        if not out:
            return pd.DataFrame(columns=names)
        which, n, name, c, m, s = zip(*out, strict=True)
        many, heads = [len(w) for w in which], rows[list(group)].iloc[starts[np.concatenate(which)]].reset_index(drop=True)
        return heads.assign(n=np.repeat(n, many), reducer=np.repeat(np.array(name, dtype=object), many), c=np.repeat(c, many), m=np.concatenate(m), s=np.concatenate(s))[names]

    part = map_runs(dealt, [*group, "_block"], [order] if order else [value], run, f"{keys}, n int, reducer string, c long, m double, s double")
    # Blocks of one group: counts, means and squared distances merge to those of all rounds.
    whole = part.groupBy(*group, "n", "reducer").agg(F.sum("c").alias("c"), (F.sum(F.col("c") * F.col("m")) / F.sum("c")).alias("mean"), F.collect_list(F.struct("c", "m", "s")).alias("parts"))
    squares = F.aggregate("parts", F.lit(0.0), lambda t, p: t + p["s"] + p["c"] * (p["m"] - F.col("mean")) * (p["m"] - F.col("mean")))
    return whole.select(*group, "n", "reducer", "mean", F.sqrt(squares / F.col("c")).alias("std"))


def exact_best_worst(df: DataFrame, group: Sequence[str], value: str, size: int, order: str) -> DataFrame:
    """Expected best and worst of ``size`` draws with replacement, from ranks; works for groups of any size."""
    ranked = number_rows(df, [value, order], "_i", keys=group)
    ranked = with_group_stats(ranked, group, _n=F.max("_i"))
    i, n = F.col("_i"), F.col("_n")
    best = F.pow(i / n, F.lit(size)) - F.pow((i - 1) / n, F.lit(size))
    worst = F.pow((n - i + 1) / n, F.lit(size)) - F.pow((n - i) / n, F.lit(size))
    return ranked.groupBy(*group).agg(F.sum(F.col(value) * best).alias("best_mean"), F.sum(F.col(value) * worst).alias("worst_mean"))


def validation_metrics(df: DataFrame, source: str, uid: str, value: str, vote: str | None = None, order: str | None = None, seed: int = 42) -> DataFrame:
    """mean@N, std@N and bootstrapped best/worst/maj@n per source, averaged over prompts, labelled core or aux."""
    per = df.groupBy(source, uid).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"))
    at = lambda name, n: F.concat(F.lit(f"{name}@"), n.cast("string"))
    plain = per.select(source, F.explode(F.array(
        F.struct(at("mean", F.col("n")).alias("metric"), F.col("mean").alias("v"), F.col("n").cast("int").alias("n")),
        F.struct(at("std", F.col("n")).alias("metric"), F.when(F.col("n") > 1, F.col("std")).alias("v"), F.col("n").cast("int").alias("n")),
    )).alias("x")).select(source, "x.*").filter(F.col("v").isNotNull())
    boot = bootstrap(df, [source, uid], value, vote=vote, order=order, seed=seed)
    drawn = boot.select(source, F.explode(F.array(
        F.struct(F.concat(at("", F.col("n")), F.lit("/mean")).alias("suffix"), F.col("mean").alias("v")),
        F.struct(F.concat(at("", F.col("n")), F.lit("/std")).alias("suffix"), F.col("std").alias("v")),
    )).alias("x"), "reducer", "n").select(source, F.concat("reducer", "x.suffix").alias("metric"), F.col("x.v").alias("v"), "n")
    # Kept, as it is read twice: a row per source and metric.
    merged = keep(plain.unionByName(drawn).groupBy(source, "metric").agg(F.avg("v").alias("value"), F.max("n").alias("n")))
    sized = with_group_stats(merged, [source], _largest=F.max("n"))
    core = (F.col("n") == F.col("_largest")) & F.col("metric").rlike(r"^(mean|maj|best)@")
    return sized.withColumn("section", F.when(core, "core").otherwise("aux")).drop("_largest", "n")


def score_by_source(df: DataFrame, source: str, scores: str) -> DataFrame:
    """Mean per source of the mean of each row's scores."""
    return df.groupBy(source).agg(F.avg(A.array_sum(F.col(scores)) / F.size(scores)).alias("score"))


def reduce_metrics(df: DataFrame, name: str, value: str) -> DataFrame:
    """Reduce each metric by its name: max, else min, else mean (nothing to average gives NaN)."""
    agg = df.groupBy(name).agg(F.max(value).alias("_max"), F.min(value).alias("_min"), F.avg(value).alias("_avg"))
    out = F.when(F.contains(F.col(name), F.lit("max")), F.col("_max")).when(F.contains(F.col(name), F.lit("min")), F.col("_min"))
    return agg.select(name, out.otherwise(F.coalesce("_avg", F.lit(float("nan")))).alias("value"))


def failure_report(df: DataFrame, error: Column, buckets: Sequence[str], width: int = 80) -> DataFrame:
    """Failures by known cause (else the head of the message), with counts and percent."""
    label = F.substring(F.coalesce(error, F.lit("Unknown")), 1, width)
    for b in reversed(buckets):
        label = F.when(F.contains(error, F.lit(b)), F.lit(b)).otherwise(label)
    counts = df.groupBy(label.alias("cause")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("percent", F.col("n") * 100.0 / total)


def group_mean_std(df: DataFrame, key: str, value: str, eps: float = 1e-6) -> DataFrame:
    """Mean, sample std (variance floored at eps) and count; a lone member gives 0 and 1."""
    g = df.groupBy(key).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(F.lit(1)).alias("count"))
    lone = F.col("count") <= 1
    return g.select(key, F.when(lone, F.lit(0.0)).otherwise(F.col("m")).alias("mean"),
                    F.when(lone, F.lit(1.0)).otherwise(F.sqrt(F.greatest(F.col("v"), F.lit(eps)))).alias("std"), "count")


SAFETY_BOUND = 20.0  # fixed value: clamp of log ratios


def importance_weights(df: DataFrame, level: str = "token", mode: str = "truncate", upper: float = 2.0, lower: float | None = None,
                       veto: float | None = 1e-4, old: str = "old_logp", rollout: str = "rollout_logp", mask: str = "mask") -> DataFrame:
    """Add ``raw_weights`` (before limits), ``seq_log_ratio``, ``vetoed`` and the final ``weights`` arrays."""
    lower = 1.0 / upper if lower is None else lower
    clamp = lambda x: F.least(F.greatest(x, F.lit(-SAFETY_BOUND)), F.lit(SAFETY_BOUND))
    s = df.withColumn("log_ratio", F.zip_with(old, rollout, lambda a, b: a.cast("double") - b))
    on = A.masked(F.col("log_ratio"), F.col(mask))
    if level == "token":
        s = s.withColumn("seq_log_ratio", F.lit(None).cast("double"))
        s = s.withColumn("raw_weights", F.transform("log_ratio", lambda x: F.exp(clamp(x))))
    elif level in ("sequence", "geometric"):
        total = A.array_sum(on)
        s = s.withColumn("seq_log_ratio", total if level == "sequence" else total / (A.mask_count(F.col(mask)) + F.lit(1e-8)))
        s = s.withColumn("raw_weights", F.array_repeat(F.exp(clamp(F.col("seq_log_ratio"))), F.size("log_ratio")))
    else:
        raise ValueError(f"unknown level {level!r}")
    n_bad = F.lit(0) if veto is None else F.size(F.filter(F.zip_with("log_ratio", mask, lambda x, m: (x < F.log(F.lit(veto))) & (m == 1)), lambda b: b))
    s = s.withColumn("n_catastrophic", n_bad).withColumn("vetoed", F.col("n_catastrophic") > 0)
    if mode == "truncate":
        limited = F.transform("raw_weights", lambda w: F.least(w, F.lit(upper)))
    elif mode == "mask":
        limited = F.transform("raw_weights", lambda w: F.when((w >= lower) & (w <= upper), w).otherwise(F.lit(0.0)))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    final = F.zip_with(limited, mask, lambda w, m: F.when(m == 1, w).otherwise(F.lit(0.0)))
    return s.withColumn("weights", F.when(F.col("vetoed"), F.array_repeat(F.lit(0.0), F.size(mask))).otherwise(final))


def importance_metrics(df: DataFrame, level: str = "token", mode: str = "truncate", upper: float = 2.0, lower: float | None = None,
                       veto: float | None = 1e-4, mask: str = "mask", **columns: str) -> DataFrame:
    """One row of weight metrics: extremes, fractions, spread, effective sample size, sequence means, quantiles."""
    low = 1.0 / upper if lower is None else lower
    s = importance_weights(df, level, mode, upper, lower, veto, mask=mask, **columns)
    per_token = F.transform(F.filter(F.arrays_zip("raw_weights", mask), lambda t: t[mask] == 1), lambda t: t["raw_weights"])
    rows = s.select(
        "vetoed", "n_catastrophic", "seq_log_ratio", per_token.alias("w"), A.mask_count(F.col(mask)).alias("n_tokens"),
        A.masked_mean(F.col("raw_weights"), F.col(mask)).alias("seq_mean"), F.get("raw_weights", F.lit(0)).alias("first"))
    share = lambda c: F.avg(c.cast("double"))
    out = lambda w: (w < low) | (w > upper)
    seq = rows.agg(
        share(F.col("vetoed")).alias("veto_fraction"),
        (F.sum("n_catastrophic") / F.sum("n_tokens")).alias("catastrophic_token_fraction"),
        F.exp(F.least(F.max("seq_log_ratio"), F.lit(SAFETY_BOUND))).alias("_seq_max_ratio"),
        F.exp(F.min("seq_log_ratio")).alias("_seq_min_ratio"),
        share(F.col("seq_log_ratio") > float(np.log(upper))).alias("_seq_high"),
        share(F.col("seq_log_ratio") < float(np.log(low))).alias("_seq_low"),
        F.avg("seq_mean").alias("seq_mean"), F.coalesce(F.stddev_samp("seq_mean"), F.lit(0.0)).alias("seq_std"),
        F.max("seq_mean").alias("seq_max"), F.min("seq_mean").alias("seq_min"),
        F.max(F.abs(F.col("seq_mean") - 1)).alias("seq_max_deviation"),
        share(F.col("seq_mean") > upper).alias("seq_fraction_high"), share(F.col("seq_mean") < low).alias("seq_fraction_low"),
        share(out(F.col("first")) if level != "token" else F.exists("w", out)).alias("seq_masked_fraction"),
    )
    tokens = rows.select(F.explode("w").alias("w"), "seq_log_ratio")
    fit = F.least(F.greatest(F.col("w"), F.lit(low)), F.lit(upper))
    mean_fit, square_fit = F.avg(fit), F.avg(fit * fit)
    tok = tokens.agg(
        F.max("w").alias("_tok_max"), F.min("w").alias("_tok_min"), F.avg("w").alias("mean"),
        share(F.col("w") > upper).alias("_tok_high"), share(F.col("w") < low).alias("_tok_low"),
        share(F.col("seq_log_ratio") > float(np.log(upper))).alias("_geo_high"),
        share(F.col("seq_log_ratio") < float(np.log(low))).alias("_geo_low"),
        F.when(F.count("w") > 1, F.sqrt(F.greatest(square_fit - mean_fit * mean_fit, F.lit(0.0)))).otherwise(F.lit(0.0)).alias("std"),
        (1 / (square_fit / ((mean_fit + 1e-8) * (mean_fit + 1e-8)))).alias("eff_sample_size"),
        share(out(F.col("w"))).alias("masked_fraction"),
    )
    cuts = quantiles(tokens, "w", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99})
    both = seq.withColumn("t", tok.select(F.struct("*")).scalar()).withColumn("q", cuts.select(F.struct("*")).scalar()).select("*", "t.*", "q.*").drop("t", "q")
    kind = {"token": ("_tok_max", "_tok_min", "_tok_high", "_tok_low"), "sequence": ("_seq_max_ratio", "_seq_min_ratio", "_seq_high", "_seq_low"),
            "geometric": ("_seq_max_ratio", "_seq_min_ratio", "_geo_high", "_geo_low")}[level]
    for name, col in zip(("max", "min", "ratio_fraction_high", "ratio_fraction_low"), kind):
        both = both.withColumn(name, F.col(col))
    hidden = [c for c in both.columns if c.startswith("_")]
    if mode != "mask":
        hidden += ["masked_fraction", "seq_masked_fraction"]
    return both.drop(*hidden)


def mismatch_metrics(df: DataFrame, old: str = "old_logp", rollout: str = "rollout_logp", mask: str = "mask") -> DataFrame:
    """KL estimates over tokens, perplexities and their differences over sequences."""
    m = F.col(mask)
    rows = df.select(
        A.masked_mean(F.col(old), m).alias("t"), A.masked_mean(F.col(rollout), m).alias("r"), A.mask_count(m).alias("n"),
        A.array_sum(A.masked(F.zip_with(rollout, old, lambda a, b: a - b), m)).alias("kl"),
        A.array_sum(A.masked(F.zip_with(old, rollout, lambda a, b: F.exp(a - b) - (a - b) - 1), m)).alias("k3"))
    d = F.col("r") - F.col("t")
    return rows.agg(
        F.avg(F.exp(-F.col("t"))).alias("training_ppl"), F.avg(-F.col("t")).alias("training_log_ppl"),
        (F.sum("kl") / F.sum("n")).alias("kl"), (F.sum("k3") / F.sum("n")).alias("k3_kl"),
        F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"), F.avg(-F.col("r")).alias("rollout_log_ppl"),
        F.avg(d).alias("log_ppl_diff"), F.avg(F.abs(d)).alias("log_ppl_abs_diff"), F.max(d).alias("log_ppl_diff_max"),
        F.min(d).alias("log_ppl_diff_min"), F.avg(F.exp(d)).alias("ppl_ratio"))


def logprob_diff(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Largest, mean and sample std of the probability gap, and the correlation, over token rows."""
    pa, pb = F.exp(a), F.exp(b)
    gap = F.abs(pa - pb)
    return df.agg(F.max(gap).alias("max_diff"), F.avg(gap).alias("mean_diff"), F.stddev_samp(gap).alias("std_diff"), F.corr(pa, pb).alias("pearson"))


def token_diff_count(a: Column, b: Column, mask: Column) -> Column:
    """Positions under the mask where two token arrays differ."""
    differs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b"), mask.alias("m")), lambda t: (t["m"] == 1) & (t["a"] != t["b"]))
    return F.size(differs)


def timing_metrics(df: DataFrame, timings: DataFrame, prompt: str, response: str, devices: int = 1) -> DataFrame:
    """Seconds and milliseconds per token per stage (generation counts response tokens), and throughput per device.

    ``timings`` is (stage, seconds), a handful of rows; the ``step`` stage gives the whole step's time.
    """
    totals = df.agg(F.struct(F.sum(response).alias("r"), F.sum(F.col(prompt) + F.col(response)).alias("a")).alias("t")).scalar()
    step = timings.filter(F.col("stage") == "step").agg(F.max("seconds")).scalar()
    s = timings.withColumn("t", totals).withColumn("tokens", F.when(F.col("stage") == "gen", F.col("t.r")).otherwise(F.col("t.a")))
    return s.select("stage", "seconds", "tokens", (F.col("seconds") * 1000 / F.col("tokens")).alias("ms_per_token"),
                    (F.col("t.a") / (step * F.lit(devices))).alias("tokens_per_second_per_device"))


def imbalance_report(df: DataFrame, part: str, before: str, length: str) -> DataFrame:
    """Token totals per bin before and after balancing: extremes, spread and mean."""
    old = df.groupBy(before).agg(F.sum(length).alias("s")).agg(F.min("s").alias("min"), F.max("s").alias("max"), F.sum("s").alias("all"))
    new = df.groupBy(part).agg(F.sum(length).alias("s")).agg(
        F.struct(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count(F.lit(1)).alias("k")).alias("n"))
    return old.withColumn("n", new.scalar()).select(
        "min", "max", (F.col("max") - F.col("min")).alias("minmax_diff"), F.col("n.lo").alias("balanced_min"),
        F.col("n.hi").alias("balanced_max"), (F.col("all") / F.col("n.k")).alias("mean"))


def aggregate_masked(df: DataFrame, values: str, mask: str, mode: str) -> DataFrame:
    """One loss number out of token arrays."""
    v, m = F.col(values), F.col(mask)
    s = df.select(A.array_sum(A.masked(v, m)).alias("total"), A.mask_count(m).alias("n"), F.size(m).alias("width"))
    out = {
        "token-mean": F.sum("total") / F.sum("n"),
        "seq-mean-token-sum": F.avg("total"),
        "seq-mean-token-mean": F.avg(F.col("total") / F.col("n")),
        "seq-mean-token-sum-norm": F.sum("total") / F.max("width"),
    }
    if mode not in out:
        raise ValueError(f"unknown mode {mode!r}")
    return s.agg(out[mode].alias("value"))


def request_stats(df: DataFrame, success: Column, stages: Mapping[str, Column], ts: str, groups: Sequence[Column] = ()) -> DataFrame:
    """Requests, successes, mean stage latencies and requests per second over the observed span."""
    seconds = (F.max(F.unix_micros(F.col(ts).cast("timestamp"))) - F.min(F.unix_micros(F.col(ts).cast("timestamp")))) / F.lit(1e6)
    aggs = [F.count(F.lit(1)).alias("requests"), F.count_if(success).alias("ok"), F.count_if(~success).alias("failed")]
    aggs += [F.avg(c).alias(f"avg_{name}") for name, c in stages.items()]
    aggs.append(F.try_divide(F.count(F.lit(1)), seconds).alias("rps"))
    return df.groupBy(*groups).agg(*aggs)


def dedup_report(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """How much of a merged result list repeats, and the characters dropping it saves."""
    from scoutmill.operators.dedup import dedup_first

    kept = dedup_first(df, [key], [order]).agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("c")).alias("k")).scalar()
    return df.agg(F.count(F.lit(1)).alias("total"), F.sum(F.length(text)).alias("chars")).withColumn("k", kept).select(
        "total", F.col("k.n").alias("unique"), (1 - F.col("k.n") / F.col("total")).alias("duplicate_ratio"), (F.col("chars") - F.col("k.c")).alias("chars_saved"))


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))


def top_counts(df: DataFrame, col: str, n: int) -> DataFrame:
    """Most common values; ties by value."""
    return value_counts(df, col).orderBy(F.col("count").desc(), F.col(col)).limit(n)


def pairwise_accuracy(df: DataFrame, uid: str, score: str, label: str, pos: str) -> DataFrame:
    """Share of label-ordered pairs whose scores agree, weighted by label gap; 0.5 for groups with one label; mean over groups.

    A pair (earlier, later) is right when "score falls" equals "label falls".
    Labels are 0/1, so only (1, 0) and (0, 1) pairs carry weight, each 1, and
    a pair is right when the 1-row scores higher: for (1, 0) strictly, for
    (0, 1) ties count too. Ranking the group by score turns the pair count
    into a sum of ranks; no pair is ever formed.
    """
    bad = F.raise_error(F.lit("pairwise accuracy takes labels 0 and 1")).cast("int")
    lab = F.when(F.col(label).cast("double").isin(0.0, 1.0), F.col(label).cast("int")).otherwise(bad)
    # For equal scores the pair is right iff the 0-row comes first in position,
    # so equal scores are ordered by position and "0-row before the 1-row" is
    # what the running count sees.
    run = ordered(df.select(uid, score, lab.alias("_y"), pos), [score, pos], [uid]).running_sum(1 - F.col("_y"), "_zeros").result()
    g = run.groupBy(uid).agg(
        F.sum(F.when(F.col("_y") == 1, F.col("_zeros")).otherwise(F.lit(0))).alias("hits"),
        F.sum("_y").alias("ones"), F.sum(1 - F.col("_y")).alias("zeros"))
    acc = F.when((F.col("ones") == 0) | (F.col("zeros") == 0), F.lit(0.5)).otherwise(F.col("hits") / (F.col("ones") * F.col("zeros")))
    return g.agg(F.avg(acc).alias("accuracy"))


def sign_accuracy(df: DataFrame, score: str, label: str) -> DataFrame:
    """Share of rows whose score sign matches the label's."""
    return df.agg(F.avg((F.signum(F.col(score).cast("double")) == F.signum(F.col(label) * 2.0 - 1)).cast("double")).alias("accuracy"))


def weighted_score(df: DataFrame, row: str, metric: str, value: str, weights: Mapping[str, float]) -> DataFrame:
    """Mean over repeats, times the metric's weight, clamped to [-1, 1], summed per row."""
    per = df.groupBy(row, metric).agg(F.avg(value).alias("m"))
    pairs = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
    weighted = F.col("m") * F.element_at(F.create_map(*pairs), F.col(metric))
    return per.groupBy(row).agg(F.sum(F.greatest(F.least(weighted, F.lit(1.0)), F.lit(-1.0))).alias("score"))
