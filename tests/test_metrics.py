"""Advantages, metrics and search against direct computation on small data."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutmill.operators import advantages as V
from scoutmill.operators import dedup as D
from scoutmill.operators import joins as J
from scoutmill.operators import metrics as M
from scoutmill.operators import qa as Q
from scoutmill.operators import retrieval as R


@pytest.fixture
def groups(spark):
    rng = random.Random(5)
    rows = [(i, i // 4 if i < 40 else 10, round(rng.random(), 3)) for i in range(41)]
    return spark.createDataFrame(rows, "row_id long, uid long, score double"), rows


def by_uid(rows):
    out = {}
    for i, u, s in rows:
        out.setdefault(u, []).append((i, s))
    return out


def got(df):
    return {r.row_id: r.advantage for r in df.collect()}


def test_grpo(groups):
    df, rows = groups
    want = {}
    for members in by_uid(rows).values():
        s = [x for _, x in members]
        mean, std = (0.0, 1.0) if len(s) == 1 else (np.mean(s), np.std(s, ddof=1))
        want.update({i: (x - mean) / (std + 1e-6) for i, x in members})
    assert got(V.grpo(df)) == pytest.approx(want)


def test_rloo_forms(groups):
    df, rows = groups
    raw, zero = got(V.rloo(df)), got(V.rloo(df, singleton="zero"))
    for members in by_uid(rows).values():
        total, n = sum(x for _, x in members), len(members)
        for i, x in members:
            want = x - (total - x) / (n - 1) if n > 1 else x
            assert raw[i] == pytest.approx(want)
            assert zero[i] == pytest.approx(want if n > 1 else 0.0)


def test_passk_needs_two(groups):
    df, _ = groups
    assert sorted(v for v in got(V.passk(df.filter("uid = 0"))).values())[:3] == [0.0, 0.0, 0.0]
    with pytest.raises(Exception, match="at least two"):
        V.passk(df).collect()


def test_group_table(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "k string, v double")
    rows = {r.k: (r.mean, r.std, r["count"]) for r in M.group_mean_std(df, "k", "v").collect()}
    assert rows["a"] == (2.0, pytest.approx(math.sqrt(2)), 2) and rows["b"] == (0.0, 1.0, 1)


def whiten(x, m):
    v = x[m == 1]
    return (x - v.mean()) / np.sqrt(v.var(ddof=1) + 1e-8)


@pytest.fixture
def tokens(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(6):
        mask = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
        rows.append((i, i // 3, rng.random(11).tolist(), rng.random(11).tolist(), mask))
    return spark.createDataFrame(rows, "row_id long, uid long, rewards array<double>, values array<double>, mask array<int>"), rows


def test_gae(spark, tokens):
    df, rows = tokens
    raw = {}
    for i, _, r, v, m in rows:
        nxt = last = 0.0
        out = [0.0] * 11
        for t in range(10, -1, -1):
            d = r[t] + 0.9 * nxt - v[t] + 0.9 * 0.8 * last
            nxt, last = (v[t], d) if m[t] else (nxt, last)
            out[t] = last
        raw[i] = out
    flat, mask = np.array([raw[i] for i in range(6)]), np.array([r[4] for r in rows])
    want = whiten(flat, mask)
    for r in V.gae(df, 0.9, 0.8).collect():
        assert r.advantages == pytest.approx(want[r.row_id])
        assert r.returns == pytest.approx((flat[r.row_id] + np.array(rows[r.row_id][3])))
    moved = df.withColumn("values", F.zip_with("values", "mask", lambda v, m: F.when(m == 1, v).otherwise(v + 9)))
    a, b = V.gae(df, 0.9, 0.8), V.gae(moved, 0.9, 0.8)
    for x, y in zip(a.orderBy("row_id").collect(), b.orderBy("row_id").collect()):
        assert x.advantages == pytest.approx(y.advantages)


def test_reinforce_pp(tokens):
    df, rows = tokens
    ret = np.zeros((6, 11))
    for i, _, r, _, m in rows:
        run = 0.0
        for t in range(10, -1, -1):
            run = r[t] + 0.7 * run
            ret[i, t] = run
            run *= m[t]
    mask = np.array([r[4] for r in rows])
    for r in V.reinforce_pp(df, 0.7).collect():
        assert r.returns == pytest.approx(ret[r.row_id])
        assert r.advantages == pytest.approx((whiten(ret, mask) * mask)[r.row_id])


def test_whitening_needs_tokens(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0, 1])], "v array<double>, m array<int>")
    with pytest.raises(Exception, match="at least two values"):
        V.masked_whiten(df, "v", "m", "w").collect()


def test_importance_levels(spark):
    rng = np.random.default_rng(4)
    old, roll = -rng.random((8, 6)), -rng.random((8, 6))
    mask = (rng.random((8, 6)) > 0.3).astype(int)
    mask[:, 0] = 1
    df = spark.createDataFrame([(o.tolist(), r.tolist(), m.tolist()) for o, r, m in zip(old, roll, mask)], "old_logp array<double>, rollout_logp array<double>, mask array<int>")
    lr, on = old - roll, mask == 1
    n = mask.sum(1)
    level = {"token": lr, "sequence": np.repeat((lr * mask).sum(1)[:, None], 6, 1), "geometric": np.repeat(((lr * mask).sum(1) / n)[:, None], 6, 1)}
    for name, log in level.items():
        w = np.exp(log)
        g = M.importance_metrics(df, name, "mask", 1.3, 0.8).first()
        assert g["mean"] == pytest.approx(w[on].mean(), rel=1e-6)
        assert g["max"] == pytest.approx(w[on].max(), rel=1e-6) and g["min"] == pytest.approx(w[on].min(), rel=1e-6)
        assert g["masked_fraction"] == pytest.approx(((w < 0.8) | (w > 1.3))[on].mean(), rel=1e-6)
        assert [g[p] for p in ("p25", "p50", "p95")] == pytest.approx(np.quantile(w[on], [0.25, 0.5, 0.95]), rel=1e-6)
        f = np.clip(w, 0.8, 1.3)[on]
        assert g["std"] == pytest.approx(f.std(), rel=1e-5)
        seq = (w * mask).sum(1) / n
        assert g["seq_std"] == pytest.approx(seq.std(ddof=1), rel=1e-5)
        high = {"token": (w > 1.3)[on].mean(), "sequence": (log[:, 0] > math.log(1.3)).mean(), "geometric": (log > math.log(1.3))[on].mean()}[name]
        assert g["ratio_fraction_high"] == pytest.approx(high)


def test_majority(spark):
    df = spark.createDataFrame([(1, "A", 0.9, 0), (1, "B", 0.8, 1), (1, "A", 0.7, 2), (2, "B", 0.8, 0), (2, "A", 0.9, 1), (2, "A", 0.1, 2), (2, "B", 0.2, 3)], "u int, p string, v double, o int")
    assert {r.u: r.value for r in M.majority_value(df, ["u"], "p", "v", "o").collect()} == {1: 0.9, 2: 0.8}


def by_hand(vals, votes, n, rounds=1000, seed=42):
    """best, worst and majority of each round, from the draws as the docstring of ``resamples`` states them."""
    best, worst, maj = [], [], []
    for r in range(rounds):
        at = [int(hashlib.md5(f"{seed}|{n}|{r}|{d}".encode()).hexdigest()[:8], 16) * len(vals) >> 32 for d in range(n)]
        drawn, cast = [vals[i] for i in at], [votes[i] for i in at]
        top = max(cast.count(v) for v in cast)
        best.append(max(drawn))
        worst.append(min(drawn))
        maj.append(next(x for x, v in zip(drawn, cast) if cast.count(v) == top))
    return {"best": best, "worst": worst, "maj": maj}


@pytest.mark.parametrize("block", [20_000, 2])
def test_bootstrap(spark, block):
    vals, votes = [1.0, 2.0, 3.0, 4.0, 5.0], [0, 1, 0, 1, 0]
    df = spark.createDataFrame([(7, v, i, votes[i]) for i, v in enumerate(vals)] + [(None, 2.0, 9, 1)], "u int, v double, o int, p int")
    rows = {r.reducer: (r["mean"], r["std"]) for r in M.bootstrap(df, ["u"], "v", [3], vote="p", order="o", rows_per_block=block).collect() if r.u == 7}
    want = by_hand(vals, votes, 3)
    assert rows.keys() == want.keys()
    for name, numbers in want.items():
        assert rows[name] == pytest.approx((np.mean(numbers), np.std(numbers)))
    exact = M.exact_best_worst(df, ["u"], "v", 3, "o").filter("u = 7").first()
    assert exact.best_mean == pytest.approx(rows["best"][0], abs=0.1) and 3.5 < exact.best_mean < 5


def test_bootstrap_with_own_reducers(spark):
    df = spark.createDataFrame([(1, float(i), i) for i in range(6)], "u int, v double, o int")
    got = {r.reducer: r["mean"] for r in M.bootstrap(df, ["u"], "v", [4], order="o", reducers={"median": lambda x: np.median(x, axis=1)}).collect()}
    picks = M.resamples(6, 4)
    assert got == {"median": pytest.approx(np.median(np.arange(6.0)[picks], axis=1).mean())}
    assert picks.min() == 0 and picks.max() == 5 and abs(picks.mean() - 2.5) < 0.1


def test_validation_sections(spark):
    df = spark.createDataFrame([("s", u, float(u + i % 2), i, i % 2) for u in range(3) for i in range(4)], "src string, u int, v double, o int, p int")
    rows = {r.metric: (r.value, r.section) for r in M.validation_metrics(df, "src", "u", "v", "p", "o").collect()}
    assert rows["mean@4"] == (pytest.approx(1.5), "core") and rows["std@4"] == (pytest.approx(0.5), "aux")
    assert rows["best@2/mean"][1] == "aux" and rows["best@4/mean"][1] == "core" and rows["worst@4/mean"][1] == "aux"


def test_reduce_empty_is_nan(spark):
    df = spark.createDataFrame([("a/mean", None), ("a/max", 2.0), ("a/max", 3.0)], "n string, v double")
    rows = {r.n: r.value for r in M.reduce_metrics(df, "n", "v").collect()}
    assert math.isnan(rows["a/mean"]) and rows["a/max"] == 3.0


def test_pairwise_equals_pairs(spark):
    rng = random.Random(9)
    rows = [(i % 5, rng.choice([1, 2, 3]), rng.randint(0, 1), i) for i in range(60)]
    df = spark.createDataFrame(rows, "u int, s int, y int, p int")
    accs = []
    for u in range(5):
        g = [r for r in rows if r[0] == u]
        pairs = [((a[1] > b[1]) == (a[2] - b[2] > 0), abs(a[2] - b[2])) for i, a in enumerate(g) for b in g[i + 1:]]
        weight = sum(w for _, w in pairs)
        accs.append(sum(w for ok, w in pairs if ok) / weight if weight else 0.5)
    assert M.pairwise_accuracy(df, "u", "s", "y", "p").first()[0] == pytest.approx(np.mean(accs))


def test_resample(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(2000)], "row_id long, score double")
    drawn = V.pf_resample(df, "pow", 2.0)
    n = {r.score: r.n for r in drawn.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(n.values()) == 2000 and n.get(0.0, 0) == 0
    # Weights 1, 4, 9 of 14.
    assert n[1.0] == pytest.approx(2000 / 14, abs=60) and n[3.0] == pytest.approx(2000 * 9 / 14, abs=120)
    assert drawn.select("row_id").distinct().count() > 500
    extremes = V.pf_resample(df, "max_min").select("score").distinct().collect()
    assert {r.score for r in extremes} == {0.0, 3.0}


def test_upsert_and_conflicts(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "url string, text string")
    new = spark.createDataFrame([("b", "x", 1), ("b", "y", 2), ("c", "z", 3), ("", "n", 4), ("d", "", 5)], "url string, text string, o int")
    assert {(r.url, r.text) for r in D.upsert_by_key(old, new, "url", ["o"]).collect()} == {("a", "1"), ("b", "y"), ("c", "z")}
    qa = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "b", 3), ("q", "c", 4), ("r", "z", 5)], "question string, answer string, o int")
    assert {(r.question, r.answer, r.another_answer) for r in D.dedup_questions(qa, ["o"]).collect()} == {("q", "a", "b"), ("r", "z", None)}


def test_union_columns_conflict(spark):
    a = spark.createDataFrame([(1, "x")], "i int, v string")
    with pytest.raises(Exception, match="differs"):
        J.union_columns(a, spark.createDataFrame([(1, "y")], "i int, v string"), "i").collect()


def test_unknown_scorer(spark):
    reg = Q.ScorerRegistry()
    reg.register("a", lambda o, t: F.lit(1.0))
    df = spark.createDataFrame([("b", "x", "y")], "data_source string, output string, ground_truth string")
    with pytest.raises(Exception, match="no scorer for b"):
        reg.score(df).collect()


def dense(spark, n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>"), x


def test_dense_forms(spark):
    docs, d = dense(spark, 300, 8, 1)
    queries, q = dense(spark, 20, 8, 2)
    docs, queries = docs.withColumnRenamed("id", "doc_id"), queries.withColumnRenamed("id", "query_id")
    want = {(i, int(j)) for i, row in enumerate(q @ d.T) for j in np.argsort(-row, kind="stable")[:5]}
    pairs = lambda df: {(r.query_id, r.doc_id) for r in df.collect()}
    assert pairs(R.dense_topk(queries, docs, 5)) == want
    assert pairs(R.dense_topk(queries, docs, 5, batch=3)) == want
    placed, centres = R.build_cells(docs, 6)
    assert pairs(R.ann_topk(queries, placed, centres, 5, 6)) == want
    assert len(pairs(R.ann_topk(queries, placed, centres, 5, 3)) & want) / len(want) > 0.5
    none = docs.select(F.col("doc_id"), F.lit("t").alias("term"), F.lit(1.0).alias("weight"))
    empty = queries.filter("false").select("query_id", F.lit("t").alias("term"), F.lit(1.0).alias("weight"))
    assert pairs(R.hybrid_search(queries, docs, empty, none, 5)) == want


def test_ties_at_the_edge():
    ids, scores = np.array([9, 3, 7, 1]), np.array([0.5, 0.5, 0.9, 0.5])
    assert ids[R._best(ids, scores, 2)].tolist() == [7, 1]


def test_adjacent_and_following(spark):
    df = spark.createDataFrame([(1, 0, "call", "a"), (1, 1, "call", "b"), (1, 2, "response", "r"), (1, 3, "call", "c")], "k int, pos int, kind string, body string")
    assert {(r.pos, r.response) for r in J.pair_calls_with_responses(df, "k", "pos").collect()} == {(0, "r"), (1, "r"), (3, None)}
    near = J.pair_adjacent(df, "k", "pos", F.col("kind") == "call", F.col("kind") == "response", "body")
    assert {(r.pos, r.response) for r in near.collect()} == {(0, None), (1, "r"), (3, None)}


def test_browse_error_turns_over_many_lines(spark):
    from scoutmill.operators import visits as V

    rng = random.Random(4)
    lines = [rng.choice(["assistant", "text", "visit x", "a timeout", "<answer>b", "more"]) for _ in range(1500)]
    got = {r.line: (r.turn, r.error) for r in V.browse_error_rows(spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "i int, output string"), context=3).collect()}
    marks = [x.startswith("assistant") or "<answer>" in x for x in lines]
    want = {i + 1: (sum(marks[:i]), "Timeout") for i, x in enumerate(lines) if "visit" in x and any("timeout" in y for y in lines[i : i + 3])}
    assert got == want and len(want) > 50


def test_resampling_sums_in_tree_order_and_meets_the_first_of_equal_ends(spark, many_tasks):
    import duckdb

    from scoutmill.operators.ordering import tree_running_sum

    n = 70_001
    rows = spark.range(n, numPartitions=7).select((F.col("id") * 3).alias("row_id"), (F.col("id") + 1).alias("row_number"), (0.1 + 0.3 * (F.col("id") % 7 == 0).cast("int") + 1e-8).alias("w"))
    got = [r[0] for r in tree_running_sum(rows, F.col("w"), "s").orderBy("row_number").select("s").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE w AS SELECT i * 3 AS row_id, 0.1::DOUBLE + 0.3::DOUBLE * CAST(i % 7 = 0 AS INT) + 1e-8::DOUBLE AS w FROM range({n}) t(i)")
    assert got == [r[0] for r in con.execute("SELECT sum(w) OVER (ORDER BY row_id) FROM w ORDER BY row_id").fetchall()]

    # Every second weight is lost in the sum, so its row is never met.
    big = spark.range(400, numPartitions=4).select(F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, 1e6).otherwise(0.0).alias("score"))
    assert {r["row_id"] % 2 for r in V.pf_resample(big).collect()} == {0}


def test_bootstrap_draws_groups_of_one_size_together(spark, monkeypatch):
    """Neighbours in a batch, with names and no votes among theirs, each as if alone; draws are hashed once a size."""
    rng = random.Random(3)
    rows = [(u, float(rng.randint(0, 5)), i, rng.choice(["x", "y", None])) for u in range(40) for i in range(2 + u % 3)]
    df = spark.createDataFrame(rows, "u int, v double, o int, p string")
    got = {(r.u, r.n, r.reducer): (r["mean"], r["std"]) for r in M.bootstrap(df, ["u"], "v", vote="p", order="o").collect()}
    assert len(got) == sum(len(M.subset_sizes(2 + u % 3)) for u in range(40)) * 3
    for u in range(0, 40, 7):
        own = [r for r in rows if r[0] == u]
        for n in M.subset_sizes(len(own)):
            for name, numbers in by_hand([r[1] for r in own], [r[3] for r in own], n).items():
                assert got[u, n, name] == pytest.approx((np.mean(numbers), np.std(numbers)))
    hashed = []
    plain = hashlib.md5
    kept = {}
    monkeypatch.setattr(M.hashlib, "md5", lambda text: hashed.append(text) or plain(text))
    assert [len(M.resamples(n, 2, kept=kept)) for n in (5, 6, 7)] == [1000] * 3 and len(hashed) == 2000
