"""QA rows: filters, labels, generation hooks, scorer dispatch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Answer length limit and the source name of filtered pairs.
SHORT_ANSWER_CHARS = 20
QA_SOURCE = "direct_information_seeking_datagen"


def short_answers(df: DataFrame, most: int = SHORT_ANSWER_CHARS, answer: str = "answer") -> DataFrame:
    return df.filter(F.length(answer) <= most)


def classify_items(df: DataFrame, leaked: Column, fetched: Column, revision: str = "revision_url") -> DataFrame:
    """Result and reason of each QA item; items without question or answer are skipped, failures stay positive."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    rows = df.filter(~blank("question") & ~blank("answer"))
    reason = (
        F.when(F.col(revision).isNull(), "no_revision_url")
        .when(~F.coalesce(fetched, F.lit(False)), "fetch_failed")
        .when(leaked, "answer_found")
        .otherwise("answer_not_found")
    )
    return rows.withColumn("reason", reason).withColumn("result", F.when(F.col("reason") == "answer_found", "negative").otherwise("positive"))


def format_qa(df: DataFrame, source: str = QA_SOURCE) -> DataFrame:
    """Output columns of a filtered pair."""
    another = F.col("another_answer") if "another_answer" in df.columns else F.lit(None).cast("string")
    return df.select(F.lit(source).alias("source"), F.coalesce("url", F.lit("")).alias("url"), "question", "answer", another.alias("another_answer"))


def generate(df: DataFrame, prompt: str, fn: Callable[[list[str]], list[str]], out: str = "reply") -> DataFrame:
    """Call a text generator once per Arrow batch of prompts; the other columns pass through."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        for batch in batches:
            yield batch.assign(**{out: pd.Series(fn(batch[prompt].tolist()), index=batch.index, dtype=object)})

    return df.mapInPandas(run, schema)


class ScorerRegistry:
    """Scorers by data source; each maps (output, truth) columns to a score column."""

    def __init__(self):
        self._scorers: dict[str, Callable[[Column, Column], Column]] = {}

    def register(self, source: str, fn: Callable[[Column, Column], Column]) -> None:
        self._scorers[source] = fn

    def score(self, df: DataFrame, source: str = "data_source", output: str = "output", truth: str = "ground_truth", out: str = "score") -> DataFrame:
        """Score every row by its source; a source nobody registered is an error."""
        unknown = F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(F.col(source), F.lit("null")))).cast("double")
        expr = F
        for name, fn in self._scorers.items():
            expr = expr.when(F.col(source) == name, fn(F.col(output), F.col(truth)).cast("double"))
        return df.withColumn(out, expr.otherwise(unknown) if self._scorers else unknown)


def batch_score(df: DataFrame, fn: Callable[..., list[float]], source: str = "data_source", output: str = "output",
                truth: str = "ground_truth", extra: str | None = None, out: str = "score") -> DataFrame:
    """Score Arrow batches with a caller's ``fn(sources, outputs, truths, extras)``."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        for b in batches:
            extras = b[extra].tolist() if extra else [None] * len(b)
            yield b.assign(**{out: [float(x) for x in fn(b[source].tolist(), b[output].tolist(), b[truth].tolist(), extras)]})

    return df.mapInPandas(run, schema)


def extend_rows(df: DataFrame, hook: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Row generator hook: the table plus the rows a caller derives from it."""
    return df.unionByName(hook(df), allowMissingColumns=True)
