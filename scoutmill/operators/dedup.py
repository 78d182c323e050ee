"""Keep-first, keep-last and conflict-aware deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutmill.operators.groups import join_on, top_rows, with_group_stats
from scoutmill.operators.ordering import number_rows


def _asc(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row of each key in ``order``."""
    return top_rows(df, keys, _asc(order))


def dedup_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key in ``order`` (names, ascending)."""
    return top_rows(df, keys, [F.col(o).desc() for o in order])


def dedup_questions(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per question with its first answer; ``another_answer`` is the first different one."""
    first = dedup_first(df, ["question"], order)
    chosen = first.select("question", F.col("answer").alias("_first"))
    others = join_on(df.select("question", "answer", *order), chosen, ["question"], "inner")
    second = dedup_first(others.filter(~F.col("answer").eqNullSafe(F.col("_first"))), ["question"], order)
    return join_on(first, second.select("question", F.col("answer").alias("another_answer")), ["question"])


def final_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", score: str = "score", tie: str | None = None) -> DataFrame:
    """Highest turn of each conversation, then highest score."""
    order = [F.col(turn).desc(), F.col(score).desc()] + ([F.col(tie)] if tie else [])
    return top_rows(df, [key], order)


def middle_row(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Row at index n // 2 (0-based) of each group."""
    numbered = number_rows(df, order, "_i", keys=[key])
    sized = with_group_stats(numbered, [key], _n=F.max("_i"))
    return sized.filter(F.col("_i") - 1 == F.floor(F.col("_n") / 2)).drop("_i", "_n")


def dedup_across_queries(
    df: DataFrame, call: str = "call_id", query: str = "query_pos", rank: str = "rank", link: str = "link",
    masked_url: Column | None = None,
) -> DataFrame:
    """Within a call keep a link at its first appearance; empty and masked links go."""
    kept = df.filter(F.coalesce(F.col(link), F.lit("")) != "")
    if masked_url is not None:
        hidden = (masked_url != "") & F.contains(F.col(link), masked_url)
        kept = kept.filter(~F.coalesce(hidden, F.lit(False)))
    return top_rows(kept, [call, link], [F.col(query), F.col(rank)])


def dedup_counts(before: DataFrame, after: DataFrame, call: str = "call_id") -> DataFrame:
    """Results per call before and after deduplication."""
    b = before.groupBy(call).agg(F.count(F.lit(1)).alias("original_total"))
    a = after.groupBy(call).agg(F.count(F.lit(1)).alias("deduped_total"))
    return join_on(b, a, [call]).select(call, "original_total", F.coalesce("deduped_total", F.lit(0)).alias("deduped_total"))


def upsert_by_key(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str], stamp: Column | None = None,
                  key_chars: int = 1024, text: str = "text") -> DataFrame:
    """Table after an upsert: the last incoming row of a key replaces the stored one.

    Keys are cut to ``key_chars``; rows without key or text are ignored; a
    replaced row keeps its ``created_at`` and gets ``stamp`` as ``updated_at``.
    """
    fresh = incoming.withColumn(key, F.substring(key, 1, key_chars)).filter(
        (F.coalesce(F.col(key), F.lit("")) != "") & (F.coalesce(F.col(text), F.lit("")) != "")
    )
    fresh = dedup_last(fresh, [key], order)
    if stamp is not None:
        known = existing.select(key, F.col("created_at").alias("_since"))
        fresh = join_on(fresh, known, [key])
        fresh = fresh.withColumn("created_at", F.coalesce("_since", stamp)).withColumn("updated_at", stamp).drop("_since")
    untouched = existing.join(fresh.select(key), key, "left_anti")
    return untouched.unionByName(fresh.select(*[c for c in existing.columns]), allowMissingColumns=True)
