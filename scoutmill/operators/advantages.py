"""Per-group advantages, curricula and resampling over rollout rows.

Outcome estimators take one row per response (uid, score); token estimators
take arrays. Group statistics come from ``with_group_stats`` (aggregate and
join back) and batch statistics from a scalar subquery, so neither a hot uid
nor the whole batch has to fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutmill.functions import arrays as A
from scoutmill.operators.groups import join_on, top_rows, with_group_stats, with_totals, with_totals_of
from scoutmill.operators.ordering import Slices, number_rows, ordered, tree_running_sum, with_row_count
from scoutmill.session import keep

EPS = 1e-6


def _value(score: str) -> Column:
    return F.col(score).cast("double")


def grpo(df: DataFrame, uid: str = "uid", score: str = "score", normalise: bool = True, eps: float = EPS) -> DataFrame:
    """(score - mean) / (sample std + eps) in the group; a lone response has mean 0 and std 1."""
    s = with_group_stats(df, [uid], _n=F.count(F.lit(1)), _m=F.avg(_value(score)), _s=F.stddev_samp(_value(score)))
    centred = _value(score) - F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(F.col("_m"))
    scale = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.col("_s")) + F.lit(eps)
    return s.withColumn("advantage", centred / scale if normalise else centred).drop("_n", "_m", "_s")


def passk(df: DataFrame, uid: str = "uid", score: str = "score", tie: str = "row_id", normalise: bool = False, eps: float = EPS) -> DataFrame:
    """Best response of each group gets its lead over the second best, all others 0; groups of one are an error."""
    best_two = top_rows(df.select(uid, score, tie), [uid], [F.col(score).desc(), F.col(tie)], 2)
    lead = best_two.groupBy(uid).agg(
        F.max(_value(score)).alias("_r1"), F.min(_value(score)).alias("_r2"),
        F.min_by(tie, F.struct(-_value(score), F.col(tie))).alias("_top"))
    s = join_on(df, lead, [uid])
    s = with_group_stats(s, [uid], _n=F.count(F.lit(1)), _s=F.stddev_samp(_value(score)))
    gap = F.col("_r1") - F.col("_r2")
    value = gap / (F.col("_s") + F.lit(eps)) if normalise else gap
    lone = F.raise_error(F.lit("pass@k needs at least two responses per group")).cast("double")
    adv = F.when(F.col("_n") == 1, lone).when(F.col(tie) == F.col("_top"), value).otherwise(F.lit(0.0))
    return s.withColumn("advantage", adv).drop("_r1", "_r2", "_top", "_n", "_s")


def rloo(df: DataFrame, uid: str = "uid", score: str = "score", singleton: str = "raw") -> DataFrame:
    """Score against the mean of the others; a lone response keeps its score ("raw") or gets 0 ("zero")."""
    s = with_group_stats(df, [uid], _n=F.count(F.lit(1)), _t=F.sum(_value(score)))
    n = F.col("_n")
    alone = _value(score) if singleton == "raw" else F.lit(0.0)
    adv = F.when(n > 1, (n * _value(score) - F.col("_t")) / (n - 1)).otherwise(alone)
    return s.withColumn("advantage", adv).drop("_n", "_t")


def opo(df: DataFrame, uid: str = "uid", score: str = "score", length: str = "length") -> DataFrame:
    """Score against the length-weighted group mean; a lone response keeps its score."""
    s = with_group_stats(df, [uid], _n=F.count(F.lit(1)), _w=F.sum(F.col(length) * _value(score)), _l=F.sum(length))
    base = F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(F.col("_w") / F.col("_l"))
    return s.withColumn("advantage", _value(score) - base).drop("_n", "_w", "_l")


def gpg(df: DataFrame, uid: str = "uid", score: str = "score", f_norm: float = 1.0) -> DataFrame:
    """Centred score times batch size over the number of non-zero scores."""
    s = with_group_stats(df, [uid], _n=F.count(F.lit(1)), _m=F.avg(_value(score)))
    s = with_totals_of(s, df, _all=F.count(F.lit(1)), _hit=F.count_if(_value(score) != 0))
    alpha = F.col("_all") / F.greatest(F.col("_hit"), F.lit(1))
    centred = _value(score) - F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(F.col("_m"))
    return s.withColumn("advantage", alpha * centred / F.lit(f_norm)).drop("_n", "_m", "_all", "_hit")


def softmean_baseline(df: DataFrame, score: str = "score", beta: float = 1.0) -> DataFrame:
    """Score minus the soft mean log(mean(exp(beta r))) / beta of the whole batch (plain mean at beta 0)."""
    if beta == 0:
        return with_totals(df, baseline=F.avg(_value(score))).withColumn("advantage", _value(score) - F.col("baseline"))
    peaked = with_totals(df, _peak=F.max(_value(score) * beta))
    s = with_totals(peaked, _mean=F.avg(F.exp(_value(score) * beta - F.col("_peak"))))
    s = s.withColumn("baseline", (F.log("_mean") + F.col("_peak")) / F.lit(beta))
    return s.withColumn("advantage", _value(score) - F.col("baseline")).drop("_peak", "_mean")


def prefer(df: DataFrame, pair: str = "pair_id", score: str = "score", pos: str = "pos") -> DataFrame:
    """Preference mask: the better of two responses is chosen, ties to the first; other group sizes are an error."""
    s = with_group_stats(df, [pair], _n=F.count(F.lit(1)),
                         _best=F.min_by(pos, F.struct(-_value(score), F.col(pos))))
    odd = F.raise_error(F.lit("each preference pair needs two responses")).cast("boolean")
    return s.withColumn("chosen", F.when(F.col("_n") != 2, odd).otherwise(F.col(pos) == F.col("_best"))).drop("_n", "_best")


# ---- token arrays -------------------------------------------------------

def masked_moments(df: DataFrame, values: Column, mask: Column) -> DataFrame:
    """One row: count, mean and Bessel-corrected variance of the values under the mask, over all rows."""
    tokens = df.select(F.explode(A.masked_values(values, mask)).alias("v"))
    return tokens.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))


def masked_whiten(df: DataFrame, values: str, mask: str, out: str, shift_mean: bool = True) -> DataFrame:
    """Whiten an array column by the moments under the mask; masks of total 0 or 1 are an error."""
    m = masked_moments(df, F.col(values), F.col(mask)).select(F.struct("n", "mean", "var").alias("m")).scalar()
    s = df.withColumn("_m", m)
    few = F.raise_error(F.lit("whitening needs at least two values under the mask")).cast("double")
    mean = F.when(F.col("_m.n") < 2, few).otherwise(F.col("_m.mean"))
    scale = 1 / F.sqrt(F.col("_m.var") + F.lit(1e-8))
    base = F.lit(0.0) if shift_mean else mean
    return s.withColumn("_mean", mean).withColumn("_scale", scale).withColumn(
        out, F.transform(values, lambda v: (v - F.col("_mean")) * F.col("_scale") + (F.lit(0.0) if shift_mean else F.col("_mean")))
    ).drop("_m", "_mean", "_scale")


def rfpp_baseline(df: DataFrame, uid: str = "uid", rewards: str = "rewards", mask: str = "mask") -> DataFrame:
    """Group-centred score on every response token, whitened over the batch."""
    s = df.withColumn("_score", A.array_sum(F.col(rewards)))
    s = with_group_stats(s, [uid], _n=F.count(F.lit(1)), _m=F.avg("_score"))
    s = s.withColumn("_c", F.col("_score") - F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(F.col("_m")))
    s = keep(s.withColumn("_v", F.transform(mask, lambda m: F.col("_c") * m)))
    out = masked_whiten(s, "_v", mask, "_w")
    return out.withColumn("advantages", A.masked(F.col("_w"), F.col(mask))).drop("_score", "_n", "_m", "_c", "_v", "_w")


def reinforce_pp(df: DataFrame, gamma: float = 1.0, rewards: str = "rewards", mask: str = "mask") -> DataFrame:
    """Discounted return to the end, restarted after masked tokens, whitened over the batch."""
    s = keep(df.withColumn("returns", A.suffix_sums(F.col(rewards), F.col(mask), F.lit(gamma), F.lit(True))))
    out = masked_whiten(s, "returns", mask, "_w")
    return out.withColumn("advantages", A.masked(F.col("_w"), F.col(mask))).drop("_w")


def remax(df: DataFrame, rewards: str = "rewards", mask: str = "mask", baseline: str = "baseline") -> DataFrame:
    """Return to the end minus the greedy baseline on response tokens."""
    on = A.masked(F.col(rewards), F.col(mask))
    s = df.withColumn("returns", A.suffix_sums(on, F.col(mask), F.lit(1.0), F.lit(False)))
    return s.withColumn("advantages", F.zip_with("returns", mask, lambda r, m: r - F.col(baseline) * m))


def remax_tokens(df: DataFrame, row: str, pos: str, reward: Column, baseline: Column) -> DataFrame:
    """The same over long tables (one row per token): a reverse running sum, minus the baseline."""
    s = ordered(df, [F.col(pos).desc()], [row], small_groups=True).running_sum(reward, "token_return").result()
    return s.withColumn("advantage", F.col("token_return") - baseline)


def gae(df: DataFrame, gamma: float = 1.0, lam: float = 1.0, rewards: str = "rewards", values: str = "values", mask: str = "mask") -> DataFrame:
    """Generalised advantage estimates whitened over the batch, and their returns."""
    s = df.withColumn("_a", A.gae_advantages(F.col(rewards), F.col(values), F.col(mask), F.lit(gamma), F.lit(lam)))
    s = keep(s.withColumn("returns", F.zip_with("_a", values, lambda a, v: a + v)))
    return masked_whiten(s, "_a", mask, "advantages").drop("_a")


def returns_tokens(df: DataFrame, row: str, pos: str, reward: str = "reward", mask: str = "mask", gamma: float = 1.0) -> DataFrame:
    """``reinforce_pp``'s returns over long tables, one row per token and trajectories of any length: adds ``token_return``."""
    s = Slices.of(df, [F.col(pos).desc()], [row]).previous(F.col(mask), "_after")
    factor = F.when(F.coalesce("_after", F.lit(1)) != 1, 0.0).otherwise(gamma)
    return s.affine(factor, _value(reward), "token_return").result().drop("_after")


def gae_tokens(df: DataFrame, row: str, pos: str, gamma: float = 1.0, lam: float = 1.0, reward: str = "reward", value: str = "value", mask: str = "mask") -> DataFrame:
    """Advantage estimates before whitening over long tables, one row per token and trajectories of any length: adds ``token_advantage``."""
    on = F.coalesce(F.col(mask), F.lit(0)) == 1
    ahead = Slices.of(df, [pos], [row]).following(F.when(on, _value(value)), "_ahead").result()
    delta = _value(reward) + gamma * F.coalesce("_ahead", F.lit(0.0)) - _value(value)
    back = Slices.of(ahead, [F.col(pos).desc()], [row])
    return back.affine(F.when(on, gamma * lam).otherwise(1.0), F.when(on, delta).otherwise(0.0), "token_advantage").result().drop("_ahead")


def rloo_multi(df: DataFrame, sources: Mapping[str, float], n_samples: int, uid: str = "uid", mask: str = "mask") -> DataFrame:
    """Leave-one-out per reward source, weighted and summed, then returned to the end and whitened.

    A source is an array column (token rewards) or a number column (the reward of the last token).
    """
    ratio = n_samples / (n_samples - 1)

    def token_part(name: str, base: Column, weight: float) -> Column:
        return F.zip_with(name, mask, lambda v, m: F.when(m == 1, v * ratio - base).otherwise(F.lit(0.0)) * weight)

    def last_part(name: str, base: Column, weight: float) -> Column:
        return F.transform(mask, lambda m, t: F.when(t == F.col("_last"), _value(name) * ratio - base).otherwise(F.lit(0.0)) * weight)

    s = df.withColumn("_last", A.mask_count(F.col(mask)) - 1)
    arrays = [df.schema[name].dataType.typeName() == "array" for name in sources]
    means = [A.array_sum(A.masked(F.col(name), F.col(mask))) / A.mask_count(F.col(mask)) if is_array else _value(name) for name, is_array in zip(sources, arrays, strict=True)]
    s = s.withColumn("_means", F.array(*means))
    # One aggregation for all sources.
    s = with_group_stats(s, [uid], **{f"_base{i}": F.sum(F.col("_means")[i]) / F.lit(n_samples - 1) for i in range(len(arrays))})
    total = None
    for i, ((name, weight), is_array) in enumerate(zip(sources.items(), arrays, strict=True)):
        part = (token_part if is_array else last_part)(name, F.col(f"_base{i}"), weight)
        total = part if total is None else F.zip_with(total, part, lambda a, b: a + b)
    s = keep(s.withColumn("returns", A.suffix_sums(A.masked(total, F.col(mask)), F.col(mask), F.lit(1.0), F.lit(False))))
    return masked_whiten(s, "returns", mask, "advantages").drop("_last", "_means", *[f"_base{i}" for i in range(len(arrays))])


ESTIMATORS: dict[str, Callable[..., DataFrame]] = {
    "grpo": grpo, "passk": passk, "rloo": rloo, "opo": opo, "gpg": gpg, "rfpp_baseline": rfpp_baseline,
    "reinforce_pp": reinforce_pp, "remax": remax, "gae": gae,
}


def register_estimator(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add an advantage estimator; a name can be taken only once."""
    if name in ESTIMATORS and ESTIMATORS[name] is not fn:
        raise ValueError(f"estimator {name!r} is already registered")
    ESTIMATORS[name] = fn


def advantages(df: DataFrame, name: str, **options) -> DataFrame:
    """Apply a registered estimator."""
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}; known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[name](df, **options)


# ---- groups worth training on ------------------------------------------

def filter_groups(df: DataFrame, metric: str, max_prompts: int | None = None, uid: str = "uid") -> DataFrame:
    """Groups whose metric varies (or that have one row); then the first ``max_prompts`` of them in uid order."""
    stats = df.groupBy(uid).agg(F.stddev_pop(_value(metric)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    good = stats.filter((F.col("_s") > 0) | (F.col("_n") == 1)).select(uid)
    if max_prompts is not None:
        good = good.orderBy(uid).limit(max_prompts)
    return df.join(good, uid, "left_semi")


def filter_and_downsample(df: DataFrame, low: float, high: float, max_length: int, oversample: float,
                          uid: str = "uid", score: str = "score", length: str = "length", row: str = "row_id") -> DataFrame:
    """Groups in the accuracy band and not truncated come first; the first 1/oversample of the rows stay."""
    stats = df.groupBy(uid).agg(F.avg(_value(score)).alias("_acc"), F.max(length).alias("_len"))
    passed = (F.col("_acc") <= high) & (F.col("_acc") >= low) & (F.col("_len") < max_length - 1)
    marked = join_on(df, stats.select(uid, passed.alias("passed")), [uid])
    ordered = number_rows(marked, [F.col("passed").desc(), F.col(uid), F.col(row)], "position")
    return with_row_count(ordered, "_all").filter(F.col("position") <= F.floor(F.col("_all") / F.lit(oversample))).drop("_all")


# Length bands of the curriculum, in tokens.
LENGTH_EDGES = [16_000, 32_000, 48_000, 64_000]


def curriculum(df: DataFrame, low: int = 1, high: int = 7, edges: Sequence[int] = LENGTH_EDGES,
               uid: str = "uid", correct: str = "correct", length: str = "length") -> DataFrame:
    """Prompts solved ``low`` to ``high`` times, with the band of their mean response length."""
    solved = df.groupBy(uid).agg(
        F.count_if(F.col(correct)).alias("solved"), F.count(F.lit(1)).alias("tries"), F.avg(length).alias("mean_length"))
    band = F.lit(None)
    for i in range(len(edges) - 1, -1, -1):
        lo = 0 if i == 0 else edges[i - 1]
        band = F.when(F.col("mean_length") < edges[i], F.lit(f"{lo}-{edges[i]}")).otherwise(band)
    return solved.filter(F.col("solved").between(low, high)).withColumn("length_band", band)


def pf_weights(score: Column, how: str, power: float, peak: Column, floor: Column) -> Column:
    if how == "pow":
        return F.pow(F.abs(score), F.lit(power))
    if how == "max_min":
        return F.when((score == peak) | (score == floor), F.lit(1.0)).otherwise(F.lit(0.0))
    if how == "max_random":
        return F.when(score == peak, F.lit(0.4)).otherwise(F.lit(0.1))
    raise ValueError(f"unknown reweight method {how!r}")


def pf_resample(df: DataFrame, how: str = "pow", power: float = 2.0, seed: int = 42, score: str = "score",
                order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Draw as many rows as there are, independently and with replacement, in proportion to their weight.

    Each row owns a stretch of the cumulative weight and each draw is a seeded
    point on it; sorted together, a draw takes the nearest stretch end after
    it. That as-of step replaces a range join and spreads over all tasks.
    """
    s = with_totals(df, _peak=F.max(_value(score)), _floor=F.min(_value(score)))
    weight = F.greatest(pf_weights(_value(score), how, power, F.col("_peak"), F.col("_floor")) + 1e-8, F.lit(1e-8))
    s = s.withColumn("_w", weight).drop("_peak", "_floor")
    run = keep(tree_running_sum(number_rows(s, list(order), "draw"), F.col("_w"), "_at", "draw"))
    # 52 bits of an md5, which any engine repeats.
    point = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    draws = with_totals(run, _all=F.max("_at")).select(
        "draw", (point * F.col("_all")).alias("_at"), F.lit(None).cast("long").alias("_end"), F.lit(None).cast(run.select(F.struct(*df.columns)).schema[0].dataType).alias("_row"))
    ends = run.select(F.lit(None).cast("long").alias("draw"), "_at", F.col("draw").alias("_end"), F.struct(*df.columns).alias("_row"))
    both = draws.unionByName(ends)
    # A weight too small to move the sum leaves two ends at one point: the first of them is met.
    taken = ordered(both, ["_at", F.col("draw").asc_nulls_last(), "_end"]).following(F.col("_row"), "_hit").result()
    return taken.filter(F.col("draw").isNotNull()).select("draw", "_hit.*")
