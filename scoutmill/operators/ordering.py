"""Row numbers, running sums and neighbours over tables of any size.

``Window.orderBy`` without a partition pulls the whole table into one task, and
a partitioned window pulls each key into one. There are two forms with equal
results, and the caller says which one a table needs; nothing is counted first:

* slices, for any table: it is range-partitioned by (keys, order), numbered
  inside each task, and kept. What crosses a slice edge is carried in a table of
  at most one row per slice, so a hot key is spread over as many tasks as it fills;
* plain windows, where a group is small by its nature (the tokens of a response,
  the turns of a conversation): one shuffle and no extra job.

The order must be total (end it with a unique id); ties would otherwise be
numbered differently by each run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutmill.functions.arrays import affine_prefix, tree_prefix, tree_sum
from scoutmill.operators.groups import join_on
from scoutmill.session import keep

ROW_BITS = (1 << 33) - 1  # the low bits of monotonically_increasing_id: row number inside the task


def _as_column(item: str | Column) -> Column:
    return F.col(item) if isinstance(item, str) else item


class Slices:
    """A table sorted by (keys, order) over many tasks; methods add columns."""

    def __init__(self, frame: DataFrame, keys: Sequence[str], columns: Sequence[str]):
        self.frame, self.keys, self.columns = frame, list(keys), list(columns)

    @classmethod
    def of(cls, df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = ()) -> Slices:
        sort = [F.col(k) for k in keys] + [_as_column(o) for o in order]
        numbered = (
            df.repartitionByRange(*sort)
            .sortWithinPartitions(*sort)
            .select(
                "*",
                F.spark_partition_id().alias("_slice"),
                F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)).alias("_pos"),
            )
        )
        return cls(keep(numbered), keys, df.columns)

    def _with(self, frame: DataFrame, name: str) -> Slices:
        return Slices(frame, self.keys, [*[c for c in self.columns if c != name], name])

    # Windows inside a slice share one shuffle by (slice, key), so chained
    # methods cost one; windows across slices run over one row per slice and key.

    def _inside(self, backwards: bool = False) -> Window:
        pos = F.col("_pos").desc() if backwards else F.col("_pos")
        return Window.partitionBy("_slice", *self.keys).orderBy(pos)

    def _across(self, backwards: bool = False) -> Window:
        pos = F.col("_slice").desc() if backwards else F.col("_slice")
        return Window.partitionBy(*self.keys).orderBy(pos)

    def _combine(self, name: str, per_slice: Column, carried: Column, result) -> Slices:
        """Add ``result(carry)``, the carry coming from other slices of the key.

        Slices are contiguous, so only the first (or last) key of a slice has
        a carry: the table shipped has at most one row per slice.
        """
        edges = self.frame.groupBy("_slice", *self.keys).agg(per_slice.alias("_edge"))
        carry = edges.select("_slice", *self.keys, carried.alias("_carry")).filter(F.col("_carry").isNotNull())
        joined = join_on(self.frame, F.broadcast(carry), ["_slice", *self.keys])
        return self._with(joined.withColumn("_new", result(F.col("_carry"))).drop("_carry", *([name] if name in self.frame.columns else [])).withColumnRenamed("_new", name), name)

    def row_number(self, name: str) -> Slices:
        """1..n inside each key (over the whole table when there are no keys)."""
        before = F.sum("_edge").over(self._across().rowsBetween(Window.unboundedPreceding, -1))
        local = F.row_number().over(self._inside()) if self.keys else F.col("_pos") + 1
        return self._combine(name, F.count(F.lit(1)), before, lambda c: (F.coalesce(c, F.lit(0)) + local).cast("long"))

    def running_sum(self, value: Column, name: str) -> Slices:
        """Sum of ``value`` from the first row of the key up to this row."""
        before = F.sum("_edge").over(self._across().rowsBetween(Window.unboundedPreceding, -1))
        local = F.sum(value).over(self._inside().rowsBetween(Window.unboundedPreceding, 0))
        return self._combine(name, F.sum(value), before, lambda c: F.coalesce(c + F.coalesce(local, F.lit(0)), local))

    def previous(self, value: Column, name: str) -> Slices:
        """Value in the row just before this one in the key; null in the first row."""
        v = F.struct(value.alias("v"))
        local = F.lag(v).over(self._inside())
        return self._combine(name, F.max_by(v, "_pos"), F.lag("_edge").over(self._across()), lambda c: F.coalesce(local, c)["v"])

    def next(self, value: Column, name: str) -> Slices:
        """Value in the row just after this one in the key; null in the last row."""
        v = F.struct(value.alias("v"))
        local = F.lag(v).over(self._inside(backwards=True))
        return self._combine(name, F.min_by(v, "_pos"), F.lag("_edge").over(self._across(backwards=True)), lambda c: F.coalesce(local, c)["v"])

    def following(self, value: Column, name: str) -> Slices:
        """Nearest later non-null value in the key (an as-of join onto what follows).

        Runs backwards with a growing frame; a frame that shrinks towards the
        end would be rebuilt for every row.
        """
        back = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        local = F.last(value, ignorenulls=True).over(back(self._inside(backwards=True)))
        edge = F.min_by(value, F.when(value.isNotNull(), F.col("_pos")))
        carried = F.last("_edge", ignorenulls=True).over(back(self._across(backwards=True)))
        return self._combine(name, edge, carried, lambda c: F.coalesce(local, c))

    def affine(self, factor: Column, term: Column, name: str) -> Slices:
        """x = term + factor * (x of the row before), 0 before the first row of the key.

        Each slice is composed to one map, and only these maps cross slice
        edges, so a key may be as long as it likes.
        """
        rows = self.frame.select("_slice", *self.keys, F.struct("_pos", factor.cast("double").alias("a"), term.cast("double").alias("b")).alias("m"))
        lists = rows.groupBy("_slice", *self.keys).agg(F.sort_array(F.collect_list("m")).alias("m"))
        scanned = lists.select("_slice", *self.keys, F.col("m._pos").alias("pos"), affine_prefix(F.col("m.a"), F.col("m.b")).alias("x"))
        kept = keep(scanned)
        edges = kept.groupBy(*self.keys).agg(F.sort_array(F.collect_list(F.struct("_slice", F.element_at("x.a", -1).alias("a"), F.element_at("x.b", -1).alias("b")))).alias("e"))
        upto = edges.select(*self.keys, F.col("e._slice").alias("slices"), affine_prefix(F.col("e.a"), F.col("e.b"))["b"].alias("ends"))
        carry = upto.select(*self.keys, F.explode(F.transform("slices", lambda s, i: F.struct(s.alias("_slice"), F.coalesce(F.when(i > 0, F.get("ends", i - 1)), F.lit(0.0)).alias("before")))).alias("c"))
        placed = join_on(kept, carry.select(*self.keys, "c._slice", "c.before"), ["_slice", *self.keys])
        each = F.transform("pos", lambda p, i: F.struct(p.alias("_pos"), (F.get("x.b", i) + F.get("x.a", i) * F.col("before")).alias("_new")))
        values = placed.select("_slice", F.explode(each).alias("v")).select("_slice", "v._pos", "v._new")
        joined = self.frame.drop(*([name] if name in self.frame.columns else [])).join(values, ["_slice", "_pos"])
        return self._with(joined.withColumnRenamed("_new", name), name)

    def result(self) -> DataFrame:
        return self.frame.select(*self.columns)


class Groups:
    """The same columns by plain windows, for groups that each fit a task."""

    def __init__(self, frame: DataFrame, keys: Sequence[str], columns: Sequence[str]):
        self.frame, self.keys, self.columns = frame, list(keys), list(columns)

    @classmethod
    def of(cls, df: DataFrame, order: Sequence[str | Column], keys: Sequence[str]) -> Groups:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[_as_column(o) for o in order]))
        return cls(df.withColumn("_pos", place), keys, df.columns)

    def _add(self, name: str, value: Column) -> Groups:
        return Groups(self.frame.withColumn(name, value), self.keys, [*[c for c in self.columns if c != name], name])

    def _window(self, backwards: bool = False) -> Window:
        return Window.partitionBy(*self.keys).orderBy(F.col("_pos").desc() if backwards else F.col("_pos"))

    def row_number(self, name: str) -> Groups:
        return self._add(name, F.col("_pos").cast("long"))

    def running_sum(self, value: Column, name: str) -> Groups:
        return self._add(name, F.sum(value).over(self._window().rowsBetween(Window.unboundedPreceding, 0)))

    def previous(self, value: Column, name: str) -> Groups:
        return self._add(name, F.lag(value).over(self._window()))

    def next(self, value: Column, name: str) -> Groups:
        return self._add(name, F.lead(value).over(self._window()))

    def following(self, value: Column, name: str) -> Groups:
        back = self._window(backwards=True).rowsBetween(Window.unboundedPreceding, -1)
        return self._add(name, F.last(value, ignorenulls=True).over(back))

    def result(self) -> DataFrame:
        return self.frame.select(*self.columns)


def ordered(df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), small_groups: bool = False) -> Slices | Groups:
    """Rows in order inside each key: slices, or windows where the caller knows ``small_groups``."""
    return Groups.of(df, order, keys) if keys and small_groups else Slices.of(df, order, keys)


def number_rows(
    df: DataFrame, order: Sequence[str | Column], name: str = "row_number", keys: Sequence[str] = (), small_groups: bool = False
) -> DataFrame:
    """Add 1..n in ``order``, over the table or inside each key."""
    return ordered(df, order, keys, small_groups).row_number(name).result()


def with_row_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    """Add the table's row count as a constant."""
    return df.withColumn(name, df.agg(F.count(F.lit(1))).scalar())


#: Rows that one task sums at a time: three levels of sixteen.
TREE_BLOCK = 4096


def tree_running_sum(df: DataFrame, value: Column, name: str, number: str = "row_number") -> DataFrame:
    """Running sum of a double over rows numbered 1..n, the same to the last bit wherever the rows lie.

    A chain of additions rounds by where slices begin. Here sixteen neighbours
    make a node, sixteen nodes one above it; a prefix adds its whole nodes from
    the largest down, as DuckDB's window sums do. Blocks of 4096 rows are
    summed in place, and three levels of blocks hold 4096 ** 3 rows.
    """
    levels, rows = [], df.select((F.col(number) - 1).alias("_i"), value.cast("double").alias("_v"))
    for _ in range(3):
        placed = rows.select(F.floor(F.col("_i") / TREE_BLOCK).alias("_b"), "_i", "_v")
        lists = placed.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_l"))
        levels.append(keep(lists.select("_b", F.col("_l._v").alias("_v"))))
        rows = levels[-1].select(F.col("_b").alias("_i"), tree_sum("_v").alias("_v"))
    top = rows.select(F.col("_i").alias("_b"), F.lit(0.0).alias("_from"), F.col("_v").alias("_to"))
    for blocks in reversed(levels):
        ends = blocks.join(top, "_b").select("_b", tree_prefix("_v", "_from", "_to").alias("_e"), "_from")
        spans = F.transform("_e", lambda to, i: F.struct((F.col("_b") * TREE_BLOCK + i).alias("_b"), F.when(i > 0, F.get("_e", i - 1)).otherwise(F.col("_from")).alias("_from"), to.alias("_to")))
        top = ends.select(F.explode(spans).alias("_s")).select("_s.*")
    return df.join(top.select((F.col("_b") + 1).alias(number), F.col("_to").alias(name)), number)
