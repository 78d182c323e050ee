"""Concatenate, repeat, pad, chunk, fold, unpivot, reorder."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutmill.operators.groups import top_rows
from scoutmill.operators.ordering import number_rows, with_row_count


def concat(dfs: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables, columns matched by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def concat_batches(dfs: Sequence[DataFrame], metas: Sequence[DataFrame], metric_key: str = "metrics") -> tuple[DataFrame, DataFrame]:
    """Worker batches as one, and their metadata (key, value): metrics appended, all other keys must agree."""
    meta = concat(metas)
    metrics = meta.filter(F.col("key") == metric_key)
    one = F.when(F.count_distinct("value") == 1, F.min("value")).otherwise(
        F.raise_error(F.concat(F.lit("workers disagree on "), F.first("key"))).cast("string"))
    agreed = meta.filter(F.col("key") != metric_key).groupBy("key").agg(one.alias("value"))
    return concat(dfs), agreed.unionByName(metrics.select("key", "value"))


def except_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def intersect_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_semi")


def unpivot_pairs(df: DataFrame, ids: Sequence[str], chosen: str, rejected: str, rewards: tuple[float, float] = (1.0, 0.0)) -> DataFrame:
    """One row per response of a preference pair, with its reward."""
    out = df.unpivot(list(ids), [chosen, rejected], "kind", "response")
    return out.withColumn("reward", F.when(F.col("kind") == chosen, F.lit(rewards[0])).otherwise(F.lit(rewards[1])))


def repeat(df: DataFrame, n: int, order: Sequence[str], interleave: bool = True) -> DataFrame:
    """Each row n times; ``position`` says where each copy stands (0-based)."""
    numbered = number_rows(df, order, "_i")
    copies = numbered.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if interleave:
        return copies.withColumn("position", (F.col("_i") - 1) * n + F.col("copy")).drop("_i")
    return with_row_count(copies, "_n").withColumn(
        "position", F.col("copy") * F.expr(f"_n div {n}") + F.col("_i") - 1).drop("_i", "_n")


def repeat_by(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as ``times`` says; zero drops it."""
    return df.withColumn("_t", times.cast("int")).filter(F.col("_t") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("_t") - 1))).drop("_t")


def pad_to_multiple(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """Row count up to a multiple of k by recycling from the head; copies carry ``is_pad``."""
    numbered = with_row_count(number_rows(df, order, "_i"), "_n")
    pad = F.pmod(-F.col("_n"), F.lit(k))
    extra = F.when(F.col("_i") <= pad, F.floor((pad - F.col("_i")) / F.col("_n")) + 1).otherwise(F.lit(0)).cast("int")
    copies = numbered.withColumn("_c", F.explode(F.sequence(F.lit(0), extra)))
    return copies.withColumn("position", F.col("_c") * F.col("_n") + F.col("_i")).withColumn("is_pad", F.col("_c") > 0).drop("_i", "_n", "_c")


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_pad")).drop("is_pad", "position")


def chunk(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """k parts of equal size; a row count that k does not divide is an error."""
    numbered = with_row_count(number_rows(df, order, "_i"), "_n")
    uneven = F.raise_error(F.lit(f"row count is not divisible by {k}")).cast("bigint")
    part = F.when(F.col("_n") % k == 0, F.floor((F.col("_i") - 1) / (F.col("_n") / k))).otherwise(uneven)
    return numbered.withColumn("chunk", part).drop("_i", "_n")


def split_size(df: DataFrame, size: int, order: Sequence[str]) -> DataFrame:
    """Parts of ``size`` rows in order; the last may be shorter."""
    return number_rows(df, order, "_i").withColumn("chunk", F.floor((F.col("_i") - 1) / size)).drop("_i")


def worker_split(df: DataFrame, splits: int, order: Sequence[str], i: int | None = None) -> DataFrame:
    """Contiguous shares of ceil(n / splits) rows; share ``i`` (0-based) or all with their number."""
    numbered = with_row_count(number_rows(df, order, "_i"), "_n")
    out = numbered.withColumn("split", F.floor((F.col("_i") - 1) / F.ceil(F.col("_n") / splits))).drop("_i", "_n")
    return out if i is None else out.filter(F.col("split") == i)


def fold(df: DataFrame, n: int, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """n consecutive rows as one row of arrays of length n."""
    numbered = number_rows(df, order, "_i").withColumn("fold_id", F.floor((F.col("_i") - 1) / n))
    packed = numbered.groupBy("fold_id").agg(F.sort_array(F.collect_list(F.struct("_i", *columns))).alias("_rows"))
    return packed.select("fold_id", *[F.col(f"_rows.{c}").alias(c) for c in columns])


def unfold(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inverse of fold: one row per array position."""
    rest = [c for c in df.columns if c not in columns]
    rows = df.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias("pos", "_z"))
    return rows.select(*rest, "pos", *[F.col(f"_z.{c}").alias(c) for c in columns])


def unfold_columns(df: DataFrame, column: str, n: int) -> DataFrame:
    """Cut an array column into n equal rows, repeating the other columns."""
    width = F.expr(f"size({column}) div {n}")
    rows = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn(column, F.slice(column, F.col("part") * width + 1, width))


def slice_rows(df: DataFrame, order: Sequence[str], start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Python slice over the ordered rows; negative bounds count from the end."""
    numbered = with_row_count(number_rows(df, order, "_i"), "_n")
    i = F.col("_i") - 1
    bound = lambda b: F.greatest(F.col("_n") + b, F.lit(0)) if b < 0 else F.lit(b)
    keep = (i >= bound(start)) & ((i - bound(start)) % step == 0)
    if stop is not None:
        keep = keep & (i < bound(stop))
    return numbered.filter(keep).drop("_i", "_n")


def select_idxs(df: DataFrame, idx: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows at the 0-based positions listed in ``idx`` (column ``idx``)."""
    numbered = number_rows(df, order, "_i").withColumn("idx", F.col("_i") - 1)
    return numbered.join(idx.select(F.col("idx").cast("long")), "idx", "left_semi").drop("_i", "idx")


def reorder(df: DataFrame, perm: DataFrame, order: Sequence[str]) -> DataFrame:
    """Row at old position ``old`` moves to ``new`` (0-based, from the permutation table)."""
    numbered = number_rows(df, order, "_i").withColumn("old", F.col("_i") - 1)
    return numbered.join(perm.select("old", "new"), "old").withColumnRenamed("new", "position").drop("_i", "old")


def inverse_permutation(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("new").alias("old"), F.col("old").alias("new"))


def head_and_last(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First n - 1 rows of each group plus its last; all rows of groups no longer than n.

    Both ends are cut inside the tasks, so a long group sends n rows per task.
    """
    heads = top_rows(df, keys, [F.col(o) for o in order], n - 1)
    last = top_rows(df, keys, [F.col(o).desc() for o in order], 1)
    return heads.unionByName(last.join(heads.select(*keys, *order), [*keys, *order], "left_anti").select(*df.columns))


def unwrap(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Arrays of one element become that element; longer ones are an error."""
    out = df
    for c in columns:
        kind = df.schema[c].dataType
        if kind.typeName() == "array":
            many = F.raise_error(F.lit(f"{c} holds more than one element")).cast(kind.elementType)
            out = out.withColumn(c, F.when(F.size(c) > 1, many).otherwise(F.get(c, F.lit(0))))
    return out


def explode_pairs(df: DataFrame, col: str = "qa_pairs") -> DataFrame:
    """One row per QA pair that has both fields."""
    rest = [c for c in df.columns if c != col]
    rows = df.select(*rest, F.posexplode(col).alias("pair_no", "_p")).select(*rest, "pair_no", "_p.question", "_p.answer")
    return rows.filter(F.col("question").isNotNull() & F.col("answer").isNotNull())


def explode_records(df: DataFrame, col: str) -> DataFrame:
    """One row per struct of an array column, fields as columns."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(col).alias(f"{col}_no", "_r")).select(*rest, f"{col}_no", "_r.*")


def message_blocks(messages: DataFrame, key: str, pos: str, role: str, text: str) -> DataFrame:
    """Runs of consecutive tool messages as one block; system only in first place; unknown roles are an error."""
    from scoutmill.operators.ordering import ordered

    r = F.col(role)
    unknown = F.raise_error(F.concat(F.lit("unknown role "), r)).cast("string")
    late = F.raise_error(F.lit("system message after the first")).cast("string")
    known = F.when(~r.isin("system", "user", "assistant", "tool"), unknown).otherwise(r)
    s = ordered(messages, [pos], [key], small_groups=True).previous(r, "_before")
    checked = F.when((r == "system") & F.col("_before").isNotNull(), late).otherwise(known)
    starts = F.when((checked == "tool") & (F.col("_before") == "tool"), 0).otherwise(1)
    blocks = s.running_sum(starts, "block").result()
    return blocks.groupBy(key, "block").agg(
        F.min_by(role, pos).alias("role"), F.count(F.lit(1)).alias("n_messages"), F.sum(F.length(text)).alias("n_chars"), F.min(pos).alias("first"))
