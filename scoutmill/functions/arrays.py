"""Per-row arrays of token values: masks, penalties, reverse recurrences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutmill.functions.text import let


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))


def masked(values: Column, mask: Column) -> Column:
    """Values where the mask is set, 0 elsewhere."""
    return F.zip_with(values, mask, lambda v, m: F.when(m == 1, v.cast("double")).otherwise(F.lit(0.0)))


def masked_values(values: Column, mask: Column) -> Column:
    """Only the values under the mask, in order."""
    picked = F.filter(F.zip_with(values, mask, lambda v, m: F.struct(v.cast("double").alias("v"), m.alias("m"))), lambda p: p["m"] == 1)
    return F.transform(picked, lambda p: p["v"])


def mask_count(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda s, m: s + m.cast("int"))


def masked_mean(values: Column, mask: Column) -> Column:
    """Sum under the mask over (count + 1e-8)."""
    return array_sum(masked(values, mask)) / (mask_count(mask) + F.lit(1e-8))


def truncate_ids(ids: Column, n: int, how: str) -> Column:
    """Cut a token array to ``n``: keep the tail (left), the head (right), both ends (middle), or fail."""
    left, right = n // 2, n - n // 2
    cut = {
        "left": F.slice(ids, -n, n),
        "right": F.slice(ids, 1, n),
        "middle": F.concat(F.slice(ids, 1, left), F.slice(ids, -right, right)),
    }.get(how)
    if how == "error":
        failure = F.raise_error(F.concat(F.lit("prompt length "), F.size(ids).cast("string"), F.lit(f" is above {n}")))
        return F.when(F.size(ids) <= n, ids).otherwise(failure.cast("array<bigint>"))
    if cut is None:
        raise ValueError(f"unknown truncation {how!r}")
    return F.when(F.size(ids) <= n, ids).otherwise(cut)


def response_mask(ids: Column, *eos: int) -> Column:
    """1 up to and including the first end-of-sequence id, 0 after it."""
    seen = [F.nullif(F.array_position(ids, F.lit(e)), F.lit(0)) for e in eos]
    first = F.coalesce(F.least(*seen) if len(seen) > 1 else seen[0], F.lit(0))
    return let(first, lambda at: F.transform(ids, lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0)))


def response_part(attention: Column, responses: Column) -> Column:
    """The attention mask of the response: the mask's last entries, one for each response token."""
    n = F.size(responses)
    return F.when(n == 0, F.slice(attention, 1, 0)).otherwise(F.slice(attention, F.greatest(F.size(attention) - n + 1, F.lit(1)), n))


def kl_penalty(logp: Column, ref: Column, kind: str) -> Column:
    """Per-token KL estimate: k1 difference, abs, k2 half square, k3 low variance with clamps."""

    def k3(x: Column, y: Column) -> Column:
        d = F.least(F.greatest(y - x, F.lit(-20.0)), F.lit(20.0))
        return F.least(F.greatest(F.exp(d) - d - 1, F.lit(-10.0)), F.lit(10.0))

    kinds = {
        "k1": lambda x, y: x - y,
        "kl": lambda x, y: x - y,
        "abs": lambda x, y: F.abs(x - y),
        "k2": lambda x, y: F.lit(0.5) * (x - y) * (x - y),
        "mse": lambda x, y: F.lit(0.5) * (x - y) * (x - y),
        "k3": k3,
        "low_var_kl": k3,
    }
    if kind not in kinds:
        raise ValueError(f"unknown penalty {kind!r}")
    return F.zip_with(logp, ref, kinds[kind])


def penalised_rewards(scores: Column, logp: Column, ref: Column, mask: Column, kind: str, beta: float) -> Column:
    """Token scores minus beta times the masked KL estimate."""
    penalty = masked(kl_penalty(logp, ref, kind), mask)
    return F.zip_with(scores, penalty, lambda s, p: s - F.lit(beta) * p)


def overlong_penalty(length: Column, longest: int, buffer: int, factor: float) -> Column:
    """Non-positive reward that falls linearly inside the buffer before the limit."""
    exceed = length - F.lit(longest - buffer)
    return F.least(-exceed / F.lit(float(buffer)) * F.lit(factor), F.lit(0.0))


# ---- recurrences ----------------------------------------------------------
# x[t] = b[t] + a[t] * x[t + 1] is a chain of maps, and maps compose: a pass with
# shifts of 1, 2, 4, ... leaves at each place the map from the array's end.

def affine_prefix(a: Column, b: Column) -> Column:
    """{a, b} at each place: the maps up to and with this one as a single map (the first is applied first)."""
    shifts = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(a))

    def step(maps: Column, d: Column) -> Column:
        earlier = lambda name, i, none: F.coalesce(F.when(i >= d, F.get(maps[name], i - d)), F.lit(none))
        return F.struct(
            F.transform(maps["a"], lambda x, i: x * earlier("a", i, 1.0)).alias("a"),
            F.transform(maps["b"], lambda y, i: y + F.get(maps["a"], i) * earlier("b", i, 0.0)).alias("b"))

    doubles = F.struct(F.transform(a, lambda x: x.cast("double")).alias("a"), F.transform(b, lambda x: x.cast("double")).alias("b"))
    return F.aggregate(shifts, doubles, step)


def affine_suffix(a: Column, b: Column) -> Column:
    """x[t] = b[t] + a[t] * x[t + 1] for every t, 0 standing behind the last; null for a null array."""
    return F.when(a.isNotNull() & b.isNotNull(), F.reverse(affine_prefix(F.reverse(a), F.reverse(b))["b"]))


def suffix_sums(values: Column, mask: Column, gamma: Column, reset: Column) -> Column:
    """Discounted sum from each position to the end; ``reset`` starts anew before a position outside the mask."""
    factors = F.transform(values, lambda _, t: F.when(reset & (F.coalesce(F.get(mask, t + 1), F.lit(1)) != 1), F.lit(0.0)).otherwise(gamma))
    return affine_suffix(factors, values)


def gae_advantages(rewards: Column, values: Column, mask: Column, gamma: Column, lam: Column) -> Column:
    """Reverse recurrence over one response; positions outside the mask change nothing."""
    on = lambda t: F.coalesce(F.get(mask, t), F.lit(0)) == 1
    nearest = affine_suffix(F.transform(values, lambda v, t: F.when(on(t), 0.0).otherwise(1.0)), F.transform(values, lambda v, t: F.when(on(t), v).otherwise(0.0)))

    def with_next(s: Column) -> Column:
        delta = lambda r, t: r + gamma * F.coalesce(F.get(s["nearest"], t + 1), F.lit(0.0)) - F.get(s["values"], t)
        return affine_suffix(
            F.transform(s["rewards"], lambda r, t: F.when(on(t), gamma * lam).otherwise(1.0)),
            F.transform(s["rewards"], lambda r, t: F.when(on(t), delta(r, t)).otherwise(0.0)))

    return let(F.struct(rewards.alias("rewards"), values.alias("values"), nearest.alias("nearest")), with_next)


def _by_sixteen(values: np.ndarray) -> np.ndarray:
    return np.pad(values, (0, -len(values) % 16)).reshape(-1, 16)


def _tree_levels(values) -> list[np.ndarray]:
    """Values, their sums by sixteen, and the sums of those; each sum is taken from the left."""
    levels = [np.asarray(values, dtype=np.float64)]
    for _ in range(2):
        levels.append(_by_sixteen(levels[-1]).cumsum(axis=1)[:, -1])
    return levels


@F.pandas_udf(T.DoubleType())
def tree_sum(values: pd.Series) -> pd.Series:
    """Sum of up to 4096 values by sixteens."""
    return values.map(lambda v: float(_by_sixteen(_tree_levels(v)[-1]).cumsum(axis=1)[0, -1]))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def tree_prefix(values: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """Running sums of up to 4096 values from ``start``: whole nodes of sixteen first; ``end`` is where the last of 4096 arrives."""

    def one(v, first, last):
        begins, ends = np.array([first]), np.array([last])
        for level in reversed(_tree_levels(v)):
            run = np.concatenate([begins[:, None], _by_sixteen(level)], axis=1).cumsum(axis=1)
            run[:, -1] = ends
            begins, ends = run[:, :-1].ravel()[: len(level)], run[:, 1:].ravel()[: len(level)]
        return ends

    return pd.Series([one(*args) for args in zip(values, start, end)])
