"""Slices and windows agree, also with a hot key over many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from scoutmill.operators import ordering as O
from scoutmill.operators import reshape as R
from scoutmill.operators import sampling as B
from scoutmill.operators.groups import map_groups, top_rows, with_group_stats


@pytest.fixture
def hot(spark):
    # A third of the rows and more on key 0; the order column is unique.
    return spark.range(3000).select(
        F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 40).alias("k"), F.xxhash64("id").alias("o"),
        (F.col("id") % 7).alias("v"), F.when(F.col("id") % 11 == 0, F.col("id")).alias("mark"))


def everything(s):
    return (s.row_number("n").running_sum(F.col("v"), "run").previous(F.col("v"), "before").next(F.col("v"), "after")
            .following(F.col("mark"), "coming").result())


def test_slices_equal_windows(spark, hot, many_tasks):
    slices = O.Slices.of(hot, ["o"], ["k"])
    assert slices.frame.select("_slice").distinct().count() > 1
    hot_tasks = slices.frame.filter("k = 0").select("_slice").distinct().count()
    assert hot_tasks > 1
    a, b = everything(slices), everything(O.Groups.of(hot, ["o"], ["k"]))
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_running_sum_carries_past_nulls(spark, many_tasks):
    df = spark.range(400).select(F.lit("a").alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 3 == 2, F.col("id")).alias("v"))
    a, b = (form.of(df, ["o"], ["k"]).running_sum(F.col("v"), "run").result() for form in (O.Slices, O.Groups))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()), key=lambda r: r[1])


def test_keys_above_the_exact_doubles(spark):
    df = spark.range(40).select((F.col("id") + (1 << 60)).alias("k"), F.col("id").alias("row"), (F.col("id") + 1).alias("n"))
    got = map_groups(df, ["k"], ["row"], lambda key, rows: [(key[0], len(rows))], "k long, n long").collect()
    assert sorted(map(tuple, got)) == [((1 << 60) + i, 1) for i in range(40)]
    assert B.greedy_bins(df, "k", "row", "n", 2).count() == 40


def test_caller_picks_the_form(hot):
    assert isinstance(O.ordered(hot, ["o"], ["k"], small_groups=True), O.Groups)
    assert isinstance(O.ordered(hot, ["o"], ["k"]), O.Slices)
    assert isinstance(O.ordered(hot, ["o"]), O.Slices)


def test_global_number(hot, many_tasks):
    rows = O.number_rows(hot, ["o"], "i").orderBy("o").collect()
    assert [r.i for r in rows] == list(range(1, 3001))


def test_null_keys_and_nulls(spark, many_tasks):
    df = spark.createDataFrame([(None, 1, None), (None, 2, 5), ("a", 3, None), ("a", 4, 7)], "k string, o int, v int")
    got = {r.o: (r.n, r.before) for r in O.Slices.of(df, ["o"], ["k"]).row_number("n").previous(F.col("v"), "before").result().collect()}
    assert got == {1: (1, None), 2: (2, None), 3: (1, None), 4: (2, None)}


def test_top_rows_cuts_before_the_shuffle(spark, hot):
    plan = top_rows(hot, ["k"], [F.col("o")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_group_stats_null_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), ("a", 5)], "k string, v int")
    got = sorted((str(r.k), r.v, r.s) for r in with_group_stats(df, ["k"], s=F.sum("v")).collect())
    assert got == [("None", 1, 4), ("None", 3, 4), ("a", 5, 5)]


def test_map_groups_over_batches(spark, hot):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = map_groups(hot, ["k"], ["o"], lambda key, rows: [(key[0], len(rows), int(rows["v"].sum()))], "k long, n long, s long")
        want = hot.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("k", "n", "s").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pad_and_unpad(spark):
    df = spark.range(5).withColumnRenamed("id", "x")
    padded = R.pad_to_multiple(df, 12, ["x"])
    assert [r.x for r in padded.orderBy("position").collect()] == [0, 1, 2, 3, 4, 0, 1, 2, 3, 4, 0, 1]
    assert sorted(r.x for r in R.unpad(padded).collect()) == [0, 1, 2, 3, 4]


def test_fold_unfold_identity(spark):
    df = spark.range(12).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y"))
    back = R.unfold(R.fold(df, 4, ["x"], ["x", "y"]), ["x", "y"]).select("x", "y")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_uneven_chunk_fails(spark):
    with pytest.raises(Exception, match="not divisible"):
        R.chunk(spark.range(10), 3, ["id"]).collect()


def test_reorder_and_back(spark):
    df = spark.range(6)
    perm = spark.createDataFrame([(0, 3), (1, 0), (2, 5), (3, 1), (4, 2), (5, 4)], "old long, new long")
    moved = R.reorder(df, perm, ["id"])
    assert [r.id for r in moved.orderBy("position").collect()] == [1, 3, 4, 0, 5, 2]
    back = R.reorder(moved.withColumnRenamed("position", "p"), R.inverse_permutation(perm), ["p"])
    assert [r.id for r in back.orderBy("position").collect()] == [0, 1, 2, 3, 4, 5]


def test_metadata_conflict_fails(spark):
    meta = lambda v: spark.createDataFrame([("metrics", v), ("t", v)], "key string, value string")
    _, out = R.concat_batches([spark.range(1), spark.range(1)], [meta("a"), meta("b")])
    with pytest.raises(Exception, match="workers disagree"):
        out.collect()


def test_messages_rules(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "tool", "a"), (1, 2, "tool", "b"), (1, 3, "assistant", "c"), (1, 4, "tool", "d")], "c int, p int, role string, t string")
    got = [(r.role, r.n_messages) for r in R.message_blocks(df, "c", "p", "role", "t").orderBy("block").collect()]
    assert got == [("system", 1), ("tool", 2), ("assistant", 1), ("tool", 1)]
    late = spark.createDataFrame([(1, 0, "user", "s"), (1, 1, "system", "a")], "c int, p int, role string, t string")
    with pytest.raises(Exception, match="system message"):
        R.message_blocks(late, "c", "p", "role", "t").collect()
    odd = spark.createDataFrame([(1, 0, "robot", "s")], "c int, p int, role string, t string")
    with pytest.raises(Exception, match="unknown role"):
        R.message_blocks(odd, "c", "p", "role", "t").collect()


def test_packing(spark):
    import random

    rng = random.Random(1)
    lengths = [rng.randint(1, 500) for _ in range(64)]
    for k in (2, 4, 8):
        bins = B.differencing(lengths, k, equal=True)
        assert all(bins.count(b) == 64 // k for b in range(k))
        totals = [sum(x for x, y in zip(lengths, bins) if y == b) for b in range(k)]
        assert max(totals) - min(totals) <= max(lengths)
    df = spark.createDataFrame([(i // 32, i, n) for i, n in enumerate(lengths)], "b int, r int, n int")
    packed = B.pack_batches(df, "b", "r", "n", 2000).collect()
    assert sorted((p.b, p.r, p.n) for p in packed) == [(i // 32, i, n) for i, n in enumerate(lengths)]
    for b in (0, 1):
        rows = [p for p in packed if p.b == b]
        k = -(-sum(p.n for p in rows) // 2000)
        assert {p.bin for p in rows} == set(range(k))
        work = [sum(p.n ** 2 for p in rows if p.bin == i) for i in range(k)]
        assert work == sorted(work, reverse=True)
    listed = spark.createDataFrame([(0, i, n) for i, n in enumerate([5, 4, 3, 3])], "b int, r int, n int")
    assert [r.bin for r in B.greedy_bins(listed, "b", "r", "n", 2).orderBy("r").collect()] == [0, 1, 1, 0]


def test_batches_beyond_a_chunk(spark, many_tasks):
    rng = random.Random(2)
    rows = [(b, i, rng.choice([1, 2, 3, 50, 400])) for b, n in ((0, 960), (1, 40), (None, 80)) for i in range(n)]
    df = spark.createDataFrame(rows, "b int, r int, n int")
    for equal in (True, False):
        got = B.balance_batches(df, "b", "r", "n", 8, equal, chunk_rows=100).collect()
        assert sorted((str(r.b), r.r, r.n) for r in got) == sorted((str(b), r, n) for b, r, n in rows)
        for batch in (0, 1, None):
            own = [r for r in got if r.b == batch]
            sums = [sum(r.n for r in own if r.bin == i) for i in range(8)]
            assert max(sums) - min(sums) <= 400
            assert not equal or {sum(r.bin == i for r in own) for i in range(8)} == {len(own) // 8}
    with pytest.raises(Exception, match="do not fill 7 equal bins"):
        B.balance_batches(df, "b", "r", "n", 7).collect()
    packed = B.pack_batches(df, "b", "r", "n", 2000, chunk_rows=100).collect()
    for batch in (0, 1, None):
        own = [r for r in packed if r.b == batch]
        bins = {r.bin for r in own}
        assert bins == set(range(max(1, -(-sum(r.n for r in own) // 2000)))) and max(sum(r.n for r in own if r.bin == i) for i in bins) <= 2 * 2000
    with pytest.raises(Exception, match="above the budget"):
        B.pack_batches(df, "b", "r", "n", 399).collect()


def test_matched_chunks_stay_as_even_as_the_worst():
    rng = random.Random(3)
    totals = [[rng.randint(0, 100) for _ in range(6)] for _ in range(50)]
    final = B.match_bins(totals, 6)
    assert all(sorted(f) == list(range(6)) for f in final)
    sums = [sum(t[f.index(b)] for t, f in zip(totals, final)) for b in range(6)]
    assert max(sums) - min(sums) <= max(max(t) - min(t) for t in totals)


def test_samples(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("s"))
    once, again = B.sample_rows(df, 10, ["id"], 1), B.sample_rows(df.repartition(5), 10, ["id"], 1)
    assert sorted(r.id for r in once.collect()) == sorted(r.id for r in again.collect())
    assert {r.s: r.n for r in B.cap_per_source(df, 7, "s", ["id"]).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()} == {"0": 7, "1": 7, "2": 7}
    assert [r.id for r in B.even_sample(df, 4, ["id"]).orderBy("id").collect()] == [0, 250, 500, 999]


def test_affine_recurrences_across_slices(spark, many_tasks):
    """One trajectory as long as the table, and short ones, against a plain loop."""
    rng = random.Random(8)
    rows = [(k, t, rng.choice([0.0, 0.5, 0.9, 1.0]), rng.randint(-3, 3)) for k, n in (("long", 5000), ("b", 1), (None, 40)) for t in range(n)]
    df = spark.createDataFrame(rows, "k string, t int, a double, b int").repartition(7)
    got = {(r.k, r.t): r.x for r in O.Slices.of(df, ["t"], ["k"]).affine(F.col("a"), F.col("b"), "x").result().collect()}
    last = {}
    for k, t, a, b in rows:
        last[k] = b + a * last.get(k, 0.0)
        assert got[k, t] == pytest.approx(last[k], abs=1e-9)
    assert len(got) == len(rows)


def test_token_tables_equal_arrays(spark, many_tasks):
    from scoutmill.operators import advantages as V

    rng = random.Random(9)
    rows = [(i, [rng.random() for _ in range(n)], [rng.random() for _ in range(n)], [rng.choice([0, 1, 1]) for _ in range(n)]) for i, n in enumerate((1, 2, 3, 17, 300))]
    arrays = spark.createDataFrame(rows, "i int, rewards array<double>, values array<double>, mask array<int>")
    long = spark.createDataFrame([(i, t, *x) for i, *lists in rows for t, x in enumerate(zip(*lists))], "i int, t int, reward double, value double, mask int")
    for i, reward, value, mask in rows:
        last = ahead = ret = 0.0
        estimates, returns, after = [], [], 1
        for t in reversed(range(len(reward))):
            if mask[t] == 1:
                last, ahead = reward[t] + 0.9 * ahead - value[t] + 0.9 * 0.8 * last, value[t]
            estimates.append(last)
            ret = reward[t] + 0.9 * (ret if after == 1 else 0.0)
            returns.append(ret)
            after = mask[t]
        own = arrays.filter(F.col("i") == i)
        gae = own.select(V.A.gae_advantages(F.col("rewards"), F.col("values"), F.col("mask"), F.lit(0.9), F.lit(0.8))).first()[0]
        sums = own.select(V.A.suffix_sums(F.col("rewards"), F.col("mask"), F.lit(0.9), F.lit(True))).first()[0]
        assert gae == pytest.approx(estimates[::-1]) and sums == pytest.approx(returns[::-1])
        mine = long.filter(F.col("i") == i)
        assert [r.token_advantage for r in V.gae_tokens(mine, "i", "t", 0.9, 0.8).orderBy("t").collect()] == pytest.approx(gae)
        assert [r.token_return for r in V.returns_tokens(mine, "i", "t", gamma=0.9).orderBy("t").collect()] == pytest.approx(sums)
    none = spark.range(1).select(F.lit(None).cast("array<double>").alias("v"), F.array().cast("array<double>").alias("e"))
    assert tuple(none.select(V.A.affine_suffix(F.col("v"), F.col("v")), V.A.affine_suffix(F.col("e"), F.col("e"))).first()) == (None, [])


def test_batches_move_once_as_lists(spark, monkeypatch):
    """Same bins whether a batch is cut as one list or numbered row by row, and no join back to the rows."""
    rng = random.Random(4)
    rows = [(b, i, rng.choice([1, 2, 3, 50, 400])) for b, n in ((0, 960), (1, 40), (None, 80)) for i in range(n)]
    df = spark.createDataFrame(rows, "b int, r int, n int")
    runs = [lambda: B.balance_batches(df, "b", "r", "n", 8, chunk_rows=100), lambda: B.pack_batches(df, "b", "r", "n", 2000, chunk_rows=100)]
    listed = [run() for run in runs]
    assert all("Join" not in x._jdf.queryExecution().executedPlan().toString().replace("BroadcastHashJoin", "") for x in listed)
    wide = B.balance_batches(df.withColumn("more", F.lit("x")), "b", "r", "n", 8, chunk_rows=100)
    monkeypatch.setattr(B, "LIST_ROWS", 60, raising=False)
    key = lambda x: sorted((str(r.b), r.r, r.n, r.bin) for r in x.collect())
    assert [key(run()) for run in runs] == [key(x) for x in listed] and key(wide) == key(listed[0])
