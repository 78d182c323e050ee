"""Files out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutmill.operators.sampling import even_sample
from scoutmill.operators.groups import top_rows

MODES = {"append": "append", "overwrite": "overwrite", "create": "errorifexists"}


def save(df: DataFrame, path: str, mode: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet with one of append, overwrite, create."""
    df.write.mode(MODES[mode]).partitionBy(*partition_by).parquet(path)


def write_labelled(df: DataFrame, path: str, label: Column, mode: str = "append") -> None:
    """JSON lines in one folder per label."""
    df.withColumn("label", label).write.mode(mode).partitionBy("label").json(path)


def write_parts(df: DataFrame, path: str, max_rows: int, mode: str = "append") -> None:
    """JSON files of at most ``max_rows`` rows."""
    df.write.mode(mode).option("maxRecordsPerFile", max_rows).json(path)


def write_with_sample(df: DataFrame, path: str, sample_path: str, n: int, order: Sequence[str], how: str = "even", source: str | None = None) -> None:
    """Parquet plus a JSON sample: evenly spaced, first n, or first of each source."""
    df.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    if how == "even":
        sample = even_sample(stored, n, order)
    elif how == "first":
        sample = stored.orderBy(*order).limit(n)
    elif how == "per_source":
        sample = top_rows(stored, [source], [F.col(o) for o in order])
    else:
        raise ValueError(f"unknown sample {how!r}")
    sample.coalesce(1).write.mode("overwrite").json(sample_path)


def json_line(df: DataFrame, columns: Sequence[str]) -> Column:
    """One JSON object per row in which null is '' whatever the type."""
    value = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    pairs = [F.concat(F.lit(f'"{c}":'), F.when(F.col(c).isNull(), F.lit('""')).otherwise(value(c))) for c in columns]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def write_rollouts(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON line per sample, one folder per step."""
    df.select("step", json_line(df, df.columns).alias("value")).write.mode(mode).partitionBy("step").text(path)


def swap_table(df: DataFrame, path: str, staging: str) -> None:
    """Replace a table that ``df`` itself reads: write beside it, then rename over it."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(staging)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staging)
    fs = old.getFileSystem(conf)
    kept = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".old")
    fs.delete(kept, True)
    if fs.exists(old):
        fs.rename(old, kept)
    fs.rename(new, old)
    fs.delete(kept, True)
