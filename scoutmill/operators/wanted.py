"""Filters of fixed size over the keys a request asks for, applied where a large table is scanned.

A join with a page store shuffles whole pages if the request is too large to be
shipped. The request's keys are set as bits of a table of fixed size first (two
bits a key); the scan then drops the pages that no key asks for, whatever join
follows. A page may pass by chance and is left to the join; none that is asked
for is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 128 KB; one page in twenty passes by chance at 120,000 keys.
BITS = 1 << 20


def _places(key: Column, bits: int) -> list[Column]:
    hashed = F.xxhash64(key)
    return [c.bitwiseAND(F.lit(bits - 1)) for c in (hashed, F.shiftrightunsigned(hashed, 32))]


def key_bits(keys: DataFrame, key: str, bits: int = BITS) -> Column:
    """The bit table of a key column as a scalar: ``bits / 64`` longs, built by OR in the tasks first."""
    spark = keys.sparkSession
    at = keys.select(F.explode(F.array(*_places(F.col(key), bits))).alias("p"))
    words = at.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    dense = spark.range(bits // 64).withColumnRenamed("id", "w").join(words, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    rows = F.sort_array(F.collect_list(F.struct("w", "b")))
    return dense.agg(F.transform(rows, lambda r: r["b"]).alias("bits")).scalar()


def only_wanted(table: DataFrame, keys: DataFrame, key: str, of: Column | None = None, bits: int = BITS) -> DataFrame:
    """Rows of ``table`` whose key may be among ``keys`` (column ``key`` of both, or expression ``of`` over ``table``).

    Streams pass through: their keys are not known before they run.
    """
    if table.isStreaming or keys.isStreaming:
        return table
    table_bits = key_bits(keys, key, bits)
    for place in _places(F.col(key) if of is None else of, bits):
        word, bit = F.get(table_bits, F.shiftrightunsigned(place, 6).cast("int")), place.bitwiseAND(F.lit(63))
        table = table.filter(F.call_function("bit_get", word, bit) == 1)
    return table
