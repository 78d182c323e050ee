"""Group statistics next to each row, without a window over the group.

A window brings every row of a key into one task. Here the statistics are
aggregated first (partial sums are built before the shuffle, so a hot key
costs one row per task) and joined back; AQE may broadcast the statistics or
split a hot key over many join tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutmill.session import task_count


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys where null equals null; the right copies of the keys are dropped."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__{key}")
    condition = F.lit(True)
    for i, key in enumerate(keys):
        same = F.col(key).eqNullSafe(F.col(f"__{key}"))
        condition = same if i == 0 else condition & same
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__{key}" for key in keys])


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Add one column per named aggregate over the rows that share ``keys``."""
    table = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in stats.items()])
    return join_on(df, table, keys)


def with_totals(df: DataFrame, **stats: Column) -> DataFrame:
    """Add whole-table aggregates as constants: a scalar subquery, no join."""
    return with_totals_of(df, df, **stats)


def with_totals_of(df: DataFrame, source: DataFrame, **stats: Column) -> DataFrame:
    """Add whole-table aggregates of ``source`` to ``df`` as constants."""
    row = source.agg(F.struct(*[expr.alias(name) for name, expr in stats.items()]).alias("t"))
    return df.withColumn("__t", row.scalar()).select("*", *[F.col(f"__t.{n}").alias(n) for n in stats]).drop("__t")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows of each group in the given total order.

    ``row_number() <= n`` lets Spark cut every group to ``n`` rows inside each
    task before the shuffle, so a hot key sends at most n rows per task.
    """
    from pyspark.sql import Window

    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= n).drop("__rn")


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[tuple, pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """Rows ``fn(key, rows)`` gives for each group, many groups per Arrow batch.

    For small groups in great number: ``applyInPandas`` pays milliseconds per
    group. Rows come sorted by (keys, order), so a group is a run of rows and
    only the last run of a batch waits for the next. A caller whose groups may
    be large splits them into blocks of its own first. The number of tasks is
    fixed, since AQE would merge small but slow ones.
    """
    names, key_names = [part.strip().split(" ")[0] for part in schema.split(",")], list(keys)

    def each(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        out = []
        heads = rows[key_names].iloc[starts].itertuples(index=False, name=None)
        for key, a, b in zip(heads, starts, ends):
            out.extend(fn(key, rows.iloc[a:b]))
        return pd.DataFrame(out, columns=names)

    return map_runs(df, keys, order, each, schema)


def map_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """As ``map_groups``, but ``fn(rows, starts, ends)`` gets all groups of a batch at once: the i-th is rows[starts[i]:ends[i]]."""
    placed = df.repartition(task_count(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    key_names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for batch in batches:
            rows = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            if not len(rows):
                continue
            starts = _run_starts(rows, key_names)
            if len(starts) > 1:
                yield fn(rows, starts[:-1], starts[1:])
            tail = rows.iloc[starts[-1]:]
        if tail is not None:
            yield fn(tail.reset_index(drop=True), np.array([0]), np.array([len(tail)]))

    return placed.mapInPandas(run, schema)


def _run_starts(rows: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Positions where a new run of equal keys begins (null equals null)."""
    new = np.zeros(len(rows), dtype=bool)
    new[0] = True
    for k in keys:
        # Neighbours are compared as they are: a shifted column would turn whole numbers above 2**53 into equal doubles.
        here, before = rows[k].iloc[1:].reset_index(drop=True), rows[k].iloc[:-1].reset_index(drop=True)
        new[1:] |= (here.ne(before) & ~(here.isna() & before.isna())).to_numpy()
    return np.flatnonzero(new)
