"""Registry of the queries over the driver tables, each next to its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutmill.session import configure, kept_path, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Driver tables by attribute: ``t.orders`` reads orders.parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return spread(self.spark.read.parquet(f"{self.folder}/documents.parquet"))

    @property
    def pages(self) -> DataFrame:
        return spread(self.spark.read.parquet(f"{self.folder}/pages.parquet"))

    def stored(self, df: DataFrame, kind: str = "parquet") -> str:
        """Path of ``df`` written to the shared folder in a source's format, for queries that run a reader."""
        path = kept_path(self.spark)
        df.write.format(kind).save(path)
        return path

    @property
    def rollouts(self) -> DataFrame:
        """Events as rollout rows; scores are whole cents, so sums are exact in any order."""
        return self.events.select(
            F.col("event_id").alias("row_id"), F.col("user_id").alias("uid"), F.round(F.col("value") * 100).alias("score"),
            (F.col("event_type") != "error").alias("correct"), F.col("event_type").alias("method"),
            F.get_json_object("props", "$.k").cast("long").alias("k"))

    @property
    def turns(self) -> DataFrame:
        return self.conversations


ROLLOUTS = """rollouts AS (SELECT event_id AS row_id, user_id AS uid, round(value * 100) AS score, event_type <> 'error' AS correct,
 event_type AS method, CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS BIGINT) AS k FROM events)"""

# Every column of lineitem: (orderkey, linenumber) repeats, so a token's place is its rank in this order.
TOKEN_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
TOKEN_ORDER_SQL = ", ".join(TOKEN_ORDER)


def query(name: str, sql: str | None = None, longs: tuple[str, ...] = (), ints: tuple[str, ...] = ()):
    """Register a query; ``sql`` is the equivalent DuckDB statement, ``longs`` and ``ints`` give its columns Spark's width."""
    casts = [f"CAST({c} AS BIGINT) AS {c}" for c in longs] + [f"CAST({c} AS INTEGER) AS {c}" for c in ints]
    if sql is not None and casts:
        sql = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})"

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add
