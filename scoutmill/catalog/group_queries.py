"""Rollout groups: advantages, curricula, metrics, deduplication over events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutmill.catalog.base import ROLLOUTS, TOKEN_ORDER, TOKEN_ORDER_SQL, query
from scoutmill.functions import arrays as A
from scoutmill.functions.tags import classify_response
from scoutmill.operators import advantages as V
from scoutmill.operators import dedup as D
from scoutmill.operators import metrics as M
from scoutmill.operators import visits as P
from scoutmill.operators.ordering import number_rows
from scoutmill.session import spread
from scoutmill.streaming.streams import finished_samples, windowed_stats

W = f"WITH {ROLLOUTS}"


@query("dedup_last", """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(t):
    return D.dedup_last(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("dedup_questions", f"""{W}, q AS (SELECT row_id, k % 50 * 1000 + uid % 20 AS question, method AS answer FROM rollouts),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY row_id) AS rn FROM q) WHERE rn = 1),
 o AS (SELECT * FROM (SELECT q.*, row_number() OVER (PARTITION BY q.question ORDER BY q.row_id) AS rn FROM q JOIN f ON q.question = f.question AND q.answer <> f.answer) WHERE rn = 1)
SELECT f.question, f.answer, f.row_id, o.answer AS another_answer FROM f LEFT JOIN o ON f.question = o.question""")
def _(t):
    q = t.rollouts.select("row_id", (F.col("k") % 50 * 1000 + F.col("uid") % 20).alias("question"), F.col("method").alias("answer"))
    return D.dedup_questions(q, ["row_id"])


@query("final_turns", """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, length(text) DESC) AS rn FROM conversations) WHERE rn = 1""")
def _(t):
    return D.final_turns(t.turns.withColumn("score", F.length("text"))).select("conv_id", "turn", "role")


@query("middle_row", """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE rn - 1 = floor(n / 2)""")
def _(t):
    return D.middle_row(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("dedup_across_queries", f"""{W}, r AS (SELECT uid AS call_id, k % 10 AS query_pos, row_id AS rank, CASE WHEN k % 7 = 0 THEN '' ELSE 'https://' || method || '.example/' || CAST(k AS VARCHAR) END AS link FROM rollouts)
SELECT call_id, query_pos, rank, link FROM (SELECT *, row_number() OVER (PARTITION BY call_id, link ORDER BY query_pos, rank) AS rn FROM r WHERE link <> '' AND NOT contains(link, 'signup')) WHERE rn = 1""")
def _(t):
    r = t.rollouts.select(F.col("uid").alias("call_id"), (F.col("k") % 10).alias("query_pos"), F.col("row_id").alias("rank"),
                          F.when(F.col("k") % 7 == 0, "").otherwise(F.concat(F.lit("https://"), "method", F.lit(".example/"), F.col("k").cast("string"))).alias("link"))
    return D.dedup_across_queries(r, masked_url=F.lit("signup"))


@query("dedup_counts", f"""{W}, r AS (SELECT uid AS call_id, method || CAST(k AS VARCHAR) AS link FROM rollouts) SELECT call_id, count(*) AS original_total, count(DISTINCT link) AS deduped_total FROM r GROUP BY call_id""")
def _(t):
    r = t.rollouts.select(F.col("uid").alias("call_id"), F.lit(0).alias("query_pos"), F.col("row_id").alias("rank"), F.concat("method", F.col("k").cast("string")).alias("link"))
    return D.dedup_counts(r, D.dedup_across_queries(r))


@query("grpo", f"""{W} SELECT row_id, uid, round((score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END) / (CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(score) OVER w END + 1e-6), 8) AS advantage FROM rollouts WINDOW w AS (PARTITION BY uid)""")
def _(t):
    return V.grpo(t.rollouts).select("row_id", "uid", F.round("advantage", 8).alias("advantage"))


@query("grpo_without_std", f"""{W} SELECT row_id, uid, score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END AS advantage FROM rollouts WINDOW w AS (PARTITION BY uid)""")
def _(t):
    return V.grpo(t.rollouts, normalise=False).select("row_id", "uid", "advantage")


@query("passk", f"""{W}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, row_id) AS rn, lead(score) OVER (PARTITION BY uid ORDER BY score DESC, row_id) AS nxt FROM rollouts)
SELECT row_id, uid, CASE WHEN rn = 1 THEN score - nxt ELSE 0.0 END AS advantage FROM r""")
def _(t):
    return V.passk(t.rollouts).select("row_id", "uid", "advantage")


@query("rloo", f"""{W} SELECT row_id, uid, CASE WHEN count(*) OVER w > 1 THEN (count(*) OVER w * score - sum(score) OVER w) / (count(*) OVER w - 1) ELSE score END AS advantage FROM rollouts WINDOW w AS (PARTITION BY uid)""")
def _(t):
    return V.rloo(t.rollouts).select("row_id", "uid", "advantage")


@query("opo", f"""{W} SELECT row_id, uid, score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE sum(k * score) OVER w / sum(k) OVER w END AS advantage FROM rollouts WINDOW w AS (PARTITION BY uid)""")
def _(t):
    return V.opo(t.rollouts, length="k").select("row_id", "uid", "advantage")


@query("gpg", f"""{W} SELECT row_id, uid, (SELECT count(*)::DOUBLE / greatest(count(CASE WHEN score <> 0 THEN 1 END), 1) FROM rollouts) * (score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END) / 1.0::DOUBLE AS advantage FROM rollouts WINDOW w AS (PARTITION BY uid)""")
def _(t):
    return V.gpg(t.rollouts).select("row_id", "uid", "advantage")


@query("softmean_baseline", """WITH l AS (SELECT l_quantity AS r FROM lineitem), m AS (SELECT round(ln(avg(exp(r - (SELECT max(r) FROM l)))) + (SELECT max(r) FROM l), 8) AS b FROM l)
SELECT r AS l_quantity, round(r - (SELECT b FROM m), 7) AS advantage, count(*) AS n FROM l GROUP BY 1, 2""")
def _(t):
    s = V.softmean_baseline(t.lineitem.select("l_quantity"), "l_quantity")
    return s.groupBy("l_quantity", F.round(F.col("l_quantity") - F.round("baseline", 8), 7).alias("advantage")).agg(F.count(F.lit(1)).alias("n"))


@query("prefer", """WITH n AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), p AS (SELECT o_orderkey, i // 2 AS pair_id, i % 2 AS pos, o_totalprice FROM n)
SELECT o_orderkey, pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY o_totalprice DESC, pos) = 1 AS chosen FROM p""")
def _(t):
    i = number_rows(t.orders.select("o_orderkey", F.col("o_totalprice").alias("score")), ["o_orderkey"], "_n").withColumn("_i", F.col("_n") - 1)
    p = i.select("o_orderkey", F.expr("_i div 2").alias("pair_id"), (F.col("_i") % 2).alias("pos"), "score")
    return V.prefer(p).select("o_orderkey", "pair_id", "chosen")


@query("remax_tokens", f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {TOKEN_ORDER_SQL}) AS pos FROM lineitem)
SELECT l_orderkey, pos, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 10.0::DOUBLE AS advantage FROM s""")
def _(t):
    tokens = number_rows(t.lineitem.select("l_orderkey", *TOKEN_ORDER), TOKEN_ORDER, "pos", keys=["l_orderkey"], small_groups=True).select("l_orderkey", "pos", "l_quantity")
    return V.remax_tokens(tokens, "l_orderkey", "pos", F.col("l_quantity"), F.lit(10.0)).select("l_orderkey", "pos", "advantage")


@query("filter_groups", f"""{W}, g AS (SELECT uid FROM rollouts GROUP BY uid HAVING stddev_pop(CAST(correct AS INT)) > 0 OR count(*) = 1 ORDER BY uid LIMIT 40) SELECT row_id, uid FROM rollouts WHERE uid IN (SELECT uid FROM g)""")
def _(t):
    return V.filter_groups(t.rollouts.withColumn("acc", F.col("correct").cast("int")), "acc", 40).select("row_id", "uid")


@query("filter_and_downsample", f"""{W}, g AS (SELECT uid, avg(CAST(correct AS INT)) BETWEEN 0.75 AND 0.85 AND max(k) < 1000 - 1 AS passed FROM rollouts GROUP BY uid),
 o AS (SELECT row_id, r.uid, passed, row_number() OVER (ORDER BY passed DESC, r.uid, row_id) AS position, count(*) OVER () AS n FROM rollouts r JOIN g ON r.uid = g.uid)
SELECT row_id, uid, passed, position FROM o WHERE position <= floor(n / 4.0)""")
def _(t):
    r = t.rollouts.withColumn("acc", F.col("correct").cast("int"))
    return V.filter_and_downsample(r, 0.75, 0.85, 1000, 4.0, score="acc", length="k").select("row_id", "uid", "passed", "position")


@query("curriculum", f"""{W}, g AS (SELECT uid * 10 + k % 10 AS uid, count(CASE WHEN correct THEN 1 END) AS solved, count(*) AS tries, avg(k * 700) AS mean_length FROM rollouts GROUP BY 1)
SELECT uid, solved, tries, mean_length, CASE WHEN mean_length < 16000 THEN '0-16000' WHEN mean_length < 32000 THEN '16000-32000' WHEN mean_length < 48000 THEN '32000-48000' WHEN mean_length < 64000 THEN '48000-64000' END AS length_band FROM g WHERE solved BETWEEN 1 AND 7""")
def _(t):
    r = t.rollouts.select((F.col("uid") * 10 + F.col("k") % 10).alias("uid"), "correct", (F.col("k") * 700).alias("length"))
    return V.curriculum(r)


RESAMPLE = """c AS (SELECT *, sum(w) OVER (ORDER BY row_id) AS upto, row_number() OVER (ORDER BY row_id) AS draw FROM w), d AS (SELECT draw, CAST('0x' || substr(md5('42:' || draw), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * (SELECT max(upto) FROM c) AS point FROM c)
SELECT d.draw, c.row_id, c.uid, c.score FROM d ASOF JOIN c ON d.point <= c.upto"""


@query("pf_resample", f"""{W}, w AS (SELECT row_id, uid, score, greatest(pow(abs(score), 2) + 1e-8, 1e-8) AS w FROM rollouts), {RESAMPLE}""")
def _(t):
    return V.pf_resample(t.rollouts.select("row_id", "uid", "score")).select("draw", "row_id", "uid", "score")


@query("pf_resample_max_random", f"""{W}, w AS (SELECT row_id, uid, score, CASE WHEN score = (SELECT max(score) FROM rollouts) THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END + 1e-8 AS w FROM rollouts), {RESAMPLE}""")
def _(t):
    return V.pf_resample(t.rollouts.select("row_id", "uid", "score"), how="max_random").select("draw", "row_id", "uid", "score")


def token_rows(t):
    """Embeddings as responses: one row per vector, its 64 numbers as token values."""
    e, r = F.col("embedding"), F.reverse("embedding")
    return spread(t.embeddings).select(
        F.col("vec_id").alias("row_id"), F.expr("vec_id div 4").alias("uid"), F.col("label").cast("double").alias("baseline"),
        F.transform(e, lambda x: F.round(x.cast("double") * 1000)).alias("rewards"), F.transform(r, lambda x: F.round(x.cast("double") * 100)).alias("values"),
        F.transform(e, lambda x: -F.abs(x.cast("double"))).alias("old_logp"), F.transform(r, lambda x: -F.abs(x.cast("double"))).alias("rollout_logp"),
        F.transform(e, lambda x: F.when(x > -0.1, 1).otherwise(0)).alias("mask"))


TOKENS = """e AS (SELECT vec_id AS row_id, vec_id // 4 AS uid, label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x, unnest(list_reverse(embedding)) AS y FROM embeddings),
 tok AS (SELECT row_id, uid, label::DOUBLE AS baseline, pos, round(x::DOUBLE * 1000) AS reward, round(y::DOUBLE * 100) AS val, -abs(x::DOUBLE) AS o, -abs(y::DOUBLE) AS r, CASE WHEN x > -0.1 THEN 1 ELSE 0 END AS m FROM e)"""


def long_rows(df, *columns, digits=6):
    """Arrays as rows, rounded."""
    rows = df.select("row_id", F.posexplode(F.arrays_zip(*columns)).alias("pos", "z"))
    return rows.select("row_id", (F.col("pos") + 1).cast("long").alias("pos"), *[F.round(F.col(f"z.{c}"), digits).alias(c) for c in columns])


@query("kl_penalised_rewards", f"""WITH {TOKENS} SELECT row_id, pos, round(reward - CASE WHEN m = 1 THEN 0.01::DOUBLE * least(greatest(exp(least(greatest(r - o, -20), 20)) - least(greatest(r - o, -20), 20) - 1, -10), 10) ELSE 0 END, 6) AS r FROM tok""")
def _(t):
    return long_rows(token_rows(t).select("row_id", A.penalised_rewards(F.col("rewards"), F.col("old_logp"), F.col("rollout_logp"), F.col("mask"), "k3", 0.01).alias("r")), "r")


@query("reinforce_pp", f"""WITH {TOKENS}, s AS (SELECT *, sum(1 - m) OVER (PARTITION BY row_id ORDER BY pos) AS seg FROM tok), g AS (SELECT *, sum(reward) OVER (PARTITION BY row_id, seg ORDER BY pos DESC) AS ret FROM s),
 w AS (SELECT avg(ret) AS mean, var_samp(ret) AS var FROM g WHERE m = 1)
SELECT row_id, pos, round(CASE WHEN m = 1 THEN (ret - mean) / sqrt(var + 1e-8) ELSE 0 END, 6) AS advantages, round(ret, 6) AS returns FROM g, w""")
def _(t):
    return long_rows(V.reinforce_pp(token_rows(t), 1.0), "advantages", "returns")


# Factors are binary fractions: with decimal ones, sums of few terms lie on the edge between two rounded numbers.
GAE = """o AS (SELECT *, count(*) OVER (PARTITION BY row_id) AS n FROM tok), x AS (
  SELECT row_id, pos, m, val, CASE WHEN m = 1 THEN reward - val ELSE 0 END AS last, CASE WHEN m = 1 THEN val ELSE 0 END AS ahead FROM o WHERE pos = n
  UNION ALL SELECT o.row_id, o.pos, o.m, o.val, CASE WHEN o.m = 1 THEN o.reward + 0.984375::DOUBLE * x.ahead - o.val + 0.984375::DOUBLE * 0.9375::DOUBLE * x.last ELSE x.last END, CASE WHEN o.m = 1 THEN o.val ELSE x.ahead END
  FROM x JOIN o ON o.row_id = x.row_id AND o.pos = x.pos - 1)"""


@query("gae", f"""WITH RECURSIVE {TOKENS}, {GAE}, w AS (SELECT avg(last) AS mean, var_samp(last) AS var FROM x WHERE m = 1)
SELECT row_id, pos, round((last - mean) / sqrt(var + 1e-8), 6) AS advantages, round(last + val, 6) AS returns FROM x, w""")
def _(t):
    return long_rows(V.gae(token_rows(t), 0.984375, 0.9375), "advantages", "returns")


@query("gae_tokens", f"""WITH RECURSIVE {TOKENS}, {GAE} SELECT row_id, pos, round(last, 6) AS token_advantage FROM x""")
def _(t):
    """The same recurrence over one row per token, carried across slices."""
    tokens = token_rows(t).select("row_id", F.posexplode(F.arrays_zip("rewards", "values", "mask")).alias("pos", "x")).select(
        "row_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("x.rewards").alias("reward"), F.col("x.values").alias("value"), F.col("x.mask").alias("mask"))
    return V.gae_tokens(tokens, "row_id", "pos", 0.984375, 0.9375).select("row_id", "pos", F.round("token_advantage", 6).alias("token_advantage"))


@query("remax", f"""WITH {TOKENS}, g AS (SELECT *, sum(reward * m) OVER (PARTITION BY row_id ORDER BY pos DESC) AS ret FROM tok) SELECT row_id, pos, round(ret - baseline * m, 6) AS advantages, round(ret, 6) AS returns FROM g""")
def _(t):
    return long_rows(V.remax(token_rows(t)), "advantages", "returns")


@query("rfpp_baseline", f"""WITH {TOKENS}, s AS (SELECT row_id, uid, sum(reward) AS score FROM tok GROUP BY 1, 2), c AS (SELECT row_id, score - CASE WHEN count(*) OVER (PARTITION BY uid) = 1 THEN 0 ELSE avg(score) OVER (PARTITION BY uid) END AS c FROM s),
 v AS (SELECT tok.row_id, pos, m, c * m AS v FROM tok JOIN c ON tok.row_id = c.row_id), w AS (SELECT avg(v) AS mean, var_samp(v) AS var FROM v WHERE m = 1)
SELECT row_id, pos, round(CASE WHEN m = 1 THEN (v - mean) / sqrt(var + 1e-8) ELSE 0 END, 6) AS advantages FROM v, w""")
def _(t):
    return long_rows(V.rfpp_baseline(token_rows(t)), "advantages")


@query("rloo_multi", f"""WITH {TOKENS}, n AS (SELECT row_id, uid, sum(val * m) / sum(m) AS mean, CAST(row_id % 3 = 0 AS INT) AS acc, sum(m) AS len FROM tok GROUP BY 1, 2), b AS (SELECT *, sum(mean) OVER (PARTITION BY uid) / 3.0::DOUBLE AS b1, sum(acc) OVER (PARTITION BY uid) / 3.0::DOUBLE AS b2 FROM n),
 p AS (SELECT tok.row_id, pos, m, CASE WHEN m = 1 THEN 0.5::DOUBLE * (val * (4 / 3.0::DOUBLE) - b1) + CASE WHEN pos = len THEN acc * (4 / 3.0::DOUBLE) - b2 ELSE 0 END ELSE 0 END AS v FROM tok JOIN b ON tok.row_id = b.row_id),
 g AS (SELECT *, sum(v) OVER (PARTITION BY row_id ORDER BY pos DESC) AS ret FROM p), w AS (SELECT avg(ret) AS mean, var_samp(ret) AS var FROM g WHERE m = 1)
SELECT row_id, pos, round((ret - mean) / sqrt(var + 1e-8), 6) AS advantages, round(ret, 6) AS returns FROM g, w""")
def _(t):
    rows = token_rows(t).withColumn("acc", (F.col("row_id") % 3 == 0).cast("double"))
    return long_rows(V.rloo_multi(rows, {"values": 0.5, "acc": 1.0}, 4), "advantages", "returns")


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) for c in df.columns])


@query("importance_token", f"""WITH {TOKENS}, lr AS (SELECT row_id, m, o - r AS l, exp(least(greatest(o - r, -20), 20)) AS w FROM tok), wt AS (SELECT * FROM lr WHERE m = 1), f AS (SELECT *, least(greatest(w, 1 / 1.2::DOUBLE), 1.2) AS f FROM wt),
 s AS (SELECT row_id, sum(w) / (count(*) + 1e-8) AS sm, bool_or(l < ln(1e-4)) AS veto, count(CASE WHEN l < ln(1e-4) THEN 1 END) AS bad, count(*) AS n FROM wt GROUP BY row_id),
 a AS (SELECT avg(CAST(veto AS INT)) AS veto_fraction, sum(bad) / sum(n) AS catastrophic_token_fraction, avg(sm) AS seq_mean, stddev_samp(sm) AS seq_std, max(sm) AS seq_max, min(sm) AS seq_min, max(abs(sm - 1)) AS seq_max_deviation, avg(CAST(sm > 1.2 AS INT)) AS seq_fraction_high, avg(CAST(sm < 1 / 1.2::DOUBLE AS INT)) AS seq_fraction_low FROM s),
 b AS (SELECT max(w) AS max, min(w) AS min, avg(w) AS mean, avg(CAST(w > 1.2 AS INT)) AS ratio_fraction_high, avg(CAST(w < 1 / 1.2::DOUBLE AS INT)) AS ratio_fraction_low, sqrt(greatest(avg(f * f) - avg(f) * avg(f), 0)) AS std, 1 / (avg(f * f) / ((avg(f) + 1e-8) * (avg(f) + 1e-8))) AS eff_sample_size, quantile_cont(w, [0.25, 0.5, 0.75, 0.95, 0.99]) AS q FROM f)
SELECT round(veto_fraction, 6) AS veto_fraction, round(catastrophic_token_fraction, 6) AS catastrophic_token_fraction, round(seq_mean, 6) AS seq_mean, round(seq_std, 6) AS seq_std, round(seq_max, 6) AS seq_max, round(seq_min, 6) AS seq_min, round(seq_max_deviation, 6) AS seq_max_deviation,
 round(seq_fraction_high, 6) AS seq_fraction_high, round(seq_fraction_low, 6) AS seq_fraction_low, round(max, 6) AS max, round(min, 6) AS min, round(mean, 6) AS mean, round(ratio_fraction_high, 6) AS ratio_fraction_high, round(ratio_fraction_low, 6) AS ratio_fraction_low, round(std, 6) AS std, round(eff_sample_size, 6) AS eff_sample_size,
 round(q[1], 6) AS p25, round(q[2], 6) AS p50, round(q[3], 6) AS p75, round(q[4], 6) AS p95, round(q[5], 6) AS p99 FROM a, b""")
def _(t):
    return rounded(M.importance_metrics(token_rows(t), "token", "truncate", 1.2))


@query("importance_sequence")
def _(t):
    return rounded(M.importance_metrics(token_rows(t), "sequence", "mask", 1.2, 0.8))


@query("importance_geometric")
def _(t):
    return rounded(M.importance_metrics(token_rows(t), "geometric", "mask", 1.1))


@query("importance_weights", f"""WITH {TOKENS}, g AS (SELECT row_id, least(greatest(sum((o - r) * m), -20), 20) AS l FROM tok GROUP BY row_id), v AS (SELECT row_id, bool_or(m = 1 AND o - r < ln(0.5::DOUBLE)) AS veto FROM tok GROUP BY row_id)
SELECT tok.row_id, pos, round(CASE WHEN m = 1 AND NOT veto THEN least(exp(l), 2.0) ELSE 0 END, 6) AS weights FROM tok JOIN g ON tok.row_id = g.row_id JOIN v ON tok.row_id = v.row_id""")
def _(t):
    return long_rows(M.importance_weights(token_rows(t), "sequence", "truncate", 2.0, veto=0.5), "weights")


@query("mismatch_metrics", f"""WITH {TOKENS}, s AS (SELECT row_id, sum(o) / (count(*) + 1e-8) AS t, sum(r) / (count(*) + 1e-8) AS r, count(*) AS n, sum(r - o) AS kl, sum(exp(o - r) - (o - r) - 1) AS k3 FROM tok WHERE m = 1 GROUP BY row_id)
SELECT round(avg(exp(-t)), 9) AS training_ppl, round(avg(-t), 9) AS training_log_ppl, round(sum(kl) / sum(n), 9) AS kl, round(sum(k3) / sum(n), 9) AS k3_kl, round(avg(exp(-r)), 9) AS rollout_ppl, round(avg(-r), 9) AS rollout_log_ppl,
 round(avg(r - t), 9) AS log_ppl_diff, round(avg(abs(r - t)), 9) AS log_ppl_abs_diff, round(max(r - t), 9) AS log_ppl_diff_max, round(min(r - t), 9) AS log_ppl_diff_min, round(avg(exp(r - t)), 9) AS ppl_ratio FROM s""")
def _(t):
    return rounded(M.mismatch_metrics(token_rows(t)), 9)


@query("whiten_tokens", f"""WITH {TOKENS}, w AS (SELECT avg(val) AS mean, var_samp(val) AS var FROM tok WHERE m = 1) SELECT row_id, pos, round((val - mean) / sqrt(var + 1e-8) + mean, 6) AS w FROM tok, w""")
def _(t):
    return long_rows(V.masked_whiten(token_rows(t), "values", "mask", "w", shift_mean=False), "w")


@query("aggregate_masked", f"""WITH {TOKENS}, s AS (SELECT row_id, sum(reward) AS total, count(*) AS n FROM tok WHERE m = 1 GROUP BY row_id)
SELECT 'token-mean' AS mode, round(sum(total) / sum(n), 9) AS value FROM s UNION ALL SELECT 'seq-mean-token-sum', round(avg(total), 9) FROM s UNION ALL SELECT 'seq-mean-token-mean', round(avg(total / n), 9) FROM s UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(total) / 64, 9) FROM s""")
def _(t):
    rows = token_rows(t).select("rewards", "mask")
    out = None
    for mode in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"):
        part = M.aggregate_masked(rows, "rewards", "mask", mode).select(F.lit(mode).alias("mode"), F.round("value", 9).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("token_level_metrics", f"""WITH {TOKENS} SELECT avg(reward) AS rewards_mean, max(reward) AS rewards_max, min(reward) AS rewards_min, avg(val) AS values_mean, max(val) AS values_max, min(val) AS values_min FROM tok WHERE m = 1""")
def _(t):
    return M.token_level_metrics(token_rows(t), ["rewards", "values"], "mask")


@query("explained_variance", f"""WITH {TOKENS} SELECT round(1 - var_samp(reward - val) / (var_samp(reward) + 1e-5), 9) AS explained_variance FROM tok WHERE m = 1""")
def _(t):
    return rounded(M.explained_variance(token_rows(t), "values", "rewards", "mask"), 9)


@query("token_diff_count", f"""WITH {TOKENS} SELECT row_id, count(CASE WHEN m = 1 AND reward <> val THEN 1 END) AS n FROM tok GROUP BY row_id""")
def _(t):
    return token_rows(t).select("row_id", M.token_diff_count(F.col("rewards"), F.col("values"), F.col("mask")).cast("long").alias("n"))


@query("truncate_ids", """SELECT vec_id, list_slice(embedding, 55, 64)[1]::DOUBLE AS l, list_slice(embedding, 1, 10)[10]::DOUBLE AS r, (list_slice(embedding, 1, 5) || list_slice(embedding, 60, 64))[6]::DOUBLE AS m FROM embeddings""")
def _(t):
    cut = {h[0]: F.element_at(A.truncate_ids(F.col("embedding"), 10, h), {"left": 1, "right": 10, "middle": 6}[h]).cast("double").alias(h[0]) for h in ("left", "right", "middle")}
    return t.embeddings.select("vec_id", *cut.values())


@query("response_mask", f"""WITH {TOKENS}, f AS (SELECT row_id, min(pos) FILTER (floor(reward / 10) IN (-5, 7)) AS eos FROM tok GROUP BY row_id) SELECT row_id, coalesce(eos, 64) AS n FROM f""")
def _(t):
    ids = F.transform("rewards", lambda x: F.floor(x / 10))
    return token_rows(t).select("row_id", A.mask_count(A.response_mask(ids, -5, 7)).cast("long").alias("n"))


@query("logprob_diff", """WITH p AS (SELECT exp(-l_discount) AS a, exp(-l_tax) AS b FROM lineitem) SELECT round(max(abs(a - b)), 9) AS max_diff, round(avg(abs(a - b)), 9) AS mean_diff, round(stddev_samp(abs(a - b)), 9) AS std_diff, round(corr(a, b), 9) AS pearson FROM p""")
def _(t):
    d = M.logprob_diff(t.lineitem, -F.col("l_discount"), -F.col("l_tax"))
    return d.select(*[F.round(c, 9).alias(c) for c in d.columns])


@query("timing_metrics", """WITH s(stage, seconds) AS (SELECT l_returnflag, CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY 1 UNION ALL SELECT 'gen', 120.0 UNION ALL SELECT 'step', 300.0),
 l AS (SELECT CAST(sum(l_linenumber) AS BIGINT) AS r, CAST(sum(l_linenumber + CAST(l_quantity AS BIGINT)) AS BIGINT) AS a FROM lineitem)
SELECT stage, seconds, CASE WHEN stage = 'gen' THEN r ELSE a END AS tokens, seconds * 1000 / CASE WHEN stage = 'gen' THEN r ELSE a END AS ms_per_token, a / (300.0::DOUBLE * 8) AS tokens_per_second_per_device FROM s, l""")
def _(t):
    rows = t.lineitem.select(F.col("l_quantity").cast("long").alias("p"), F.col("l_linenumber").cast("long").alias("r"), "l_returnflag")
    stages = rows.groupBy(F.col("l_returnflag").alias("stage")).agg(F.count(F.lit(1)).cast("double").alias("seconds"))
    fixed = rows.agg(F.explode(F.array(F.struct(F.lit("gen").alias("s"), F.lit(120.0).alias("x")), F.struct(F.lit("step").alias("s"), F.lit(300.0).alias("x")))).alias("f")).select("f.s", "f.x")
    return M.timing_metrics(rows, stages.union(fixed), "p", "r", 8)


@query("imbalance_report", """WITH a AS (SELECT l_suppkey % 16 AS b, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY 1), c AS (SELECT l_partkey % 16 AS b, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY 1)
SELECT min(s) AS min, max(s) AS max, max(s) - min(s) AS minmax_diff, (SELECT min(s) FROM c) AS balanced_min, (SELECT max(s) FROM c) AS balanced_max, CAST(sum(s) AS BIGINT) / (SELECT count(*) FROM c)::DOUBLE AS mean FROM a""")
def _(t):
    rows = t.lineitem.select((F.col("l_suppkey") % 16).alias("old"), (F.col("l_partkey") % 16).alias("new"), F.col("l_quantity").cast("long").alias("n"))
    return M.imbalance_report(rows, "new", "old", "n")


@query("merge_progress", """WITH w AS (SELECT l_suppkey AS worker, count(*) AS total_samples, count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS completed, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS failed, CAST(sum(l_linenumber) AS BIGINT) AS total_turns,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_tool_calls, max(l_quantity) AS duration_max, min(l_quantity) AS duration_min FROM lineitem GROUP BY 1)
SELECT CAST(sum(total_samples) AS BIGINT) AS total_samples, CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(total_turns) AS BIGINT) AS total_turns, CAST(sum(total_tool_calls) AS BIGINT) AS total_tool_calls,
 sum(duration_max * completed) / sum(completed) AS duration_avg, sum(total_turns * completed)::DOUBLE / sum(completed) AS avg_turns_per_sample, sum(total_tool_calls * completed)::DOUBLE / sum(completed) AS avg_tools_per_sample,
 min(duration_min) AS duration_min, max(duration_max) AS duration_max, avg(duration_min) AS duration_p50, max(duration_max) AS duration_p95, CAST(max(total_tool_calls) AS BIGINT) AS total_duration,
 sum(completed)::DOUBLE / sum(total_samples) AS success_rate, sum(total_samples)::DOUBLE / max(total_tool_calls) AS throughput FROM w""")
def _(t):
    w = t.lineitem.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("total_samples"), F.count_if(F.col("l_returnflag") != "R").alias("completed"), F.count_if(F.col("l_returnflag") == "R").alias("failed"),
        F.sum("l_linenumber").alias("total_turns"), F.sum(F.col("l_quantity").cast("long")).alias("total_tool_calls"), F.max("l_quantity").alias("duration_max"), F.min("l_quantity").alias("duration_min"))
    names = ("total_samples", "completed", "failed", "total_turns", "total_tool_calls", "duration_min", "duration_max")
    return M.merge_progress(w, {**{n: n for n in names}, "duration_avg": "duration_max", "avg_turns_per_sample": "total_turns", "avg_tools_per_sample": "total_tool_calls",
                                "duration_p50": "duration_min", "duration_p95": "duration_max", "total_duration": "total_tool_calls"})


@query("judge_summary", """SELECT count(CASE WHEN toxic = 0 THEN 1 END) AS total, count(CASE WHEN toxic = 0 AND quality = 1 THEN 1 END) AS correct, count(CASE WHEN toxic = 0 AND quality = 0 THEN 1 END) AS incorrect, count(CASE WHEN toxic = 1 THEN 1 END) AS skipped,
 count(CASE WHEN toxic = 1 AND quality = 0 THEN 1 END) AS errors, count(CASE WHEN toxic = 0 AND quality = 1 THEN 1 END) / nullif(count(CASE WHEN toxic = 0 THEN 1 END), 0)::DOUBLE AS accuracy FROM labels""")
def _(t):
    status = F.when(F.col("toxic") == 0, "ok").when(F.col("quality") == 0, "error").otherwise("skipped")
    return M.judge_summary(t.labels, status, M.truthy(t.labels, "quality"))


@query("method_breakdown", f"""{W} SELECT method, count(*) AS total, count(CASE WHEN k % 3 = 0 THEN 1 END) AS correct, count(CASE WHEN k % 3 = 1 THEN 1 END) AS incorrect, count(CASE WHEN k % 3 = 2 THEN 1 END) AS unknown,
 count(CASE WHEN k % 3 = 0 THEN 1 END) / count(CASE WHEN k % 3 <> 2 THEN 1 END)::DOUBLE AS accuracy, avg(score) AS mean_score, avg(CASE WHEN k > 0 THEN k END) AS mean_turns, count(CASE WHEN k > 50 THEN 1 END) AS judged, count(CASE WHEN k > 50 AND k % 3 = 0 THEN 1 END) AS judged_correct FROM rollouts GROUP BY method""")
def _(t):
    c = F.when(F.col("k") % 3 == 0, True).when(F.col("k") % 3 == 1, False)
    return M.method_breakdown(t.rollouts, "method", c, "score", "k", F.col("k") > 50)


def output_text():
    """Agent output built from an event: one call, mostly a response."""
    return F.concat(
        F.lit('<tool_call>{"name": "'), F.when(F.col("event_type").isin("click", "view"), "search").otherwise("visit"), F.lit('", "arguments": {"'),
        F.when(F.col("event_type") == "click", F.concat(F.lit('query": ["a'), F.col("user_id").cast("string"), F.lit('", "b"]')))
        .when(F.col("event_type") == "view", F.lit('query": "one"'))
        .when(F.col("event_type") == "error", F.lit('url": ["https://a.example/1", "https://b.example/2", "https://c.example/3"]'))
    .otherwise(F.lit('url": "https://d.example/4"')), F.lit("}}</tool_call>"),
        F.when(F.col("event_type") == "error", F.lit("<tool_response>Browse error: timed out</tool_response>"))
        .when(F.col("event_type") == "signup", F.lit("<tool_response>The page could not be accessed</tool_response>"))
        .when(F.col("event_type") == "purchase", F.lit("")).otherwise(F.lit("<tool_response>fine</tool_response>")))


@query("tool_call_counts", """SELECT user_id, count(CASE WHEN event_type IN ('click', 'view') THEN 1 END) AS search_calls, CAST(sum(CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) AS BIGINT) AS search_queries,
 count(CASE WHEN event_type NOT IN ('click', 'view') THEN 1 END) AS visit_calls, CAST(sum(CASE WHEN event_type = 'error' THEN 3 WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END) AS BIGINT) AS visit_urls, 0 AS bad_json FROM events GROUP BY user_id""", longs=("bad_json",))
def _(t):
    return P.tool_call_counts(t.events.select("user_id", output_text().alias("output")), ["user_id"])


@query("visit_url_stats", """WITH v AS (SELECT user_id % 20 AS step, event_type, unnest(range(CASE WHEN event_type = 'error' THEN 3 ELSE 1 END)) FROM events WHERE event_type IN ('error', 'signup', 'purchase'))
SELECT step, count(*) AS total_urls, count(CASE WHEN event_type = 'error' THEN 1 END) AS connect_fail, 0 AS browse_success, count(CASE WHEN event_type = 'signup' THEN 1 END) AS browse_fail, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS no_response,
 count(CASE WHEN event_type = 'signup' THEN 1 END) AS valid_urls FROM v GROUP BY ROLLUP (step)""", longs=("browse_success",))
def _(t):
    return P.visit_url_stats(P.visit_rows(t.events.select((F.col("user_id") % 20).alias("step"), output_text().alias("output"))))


@query("visit_outcomes", f"""{W} SELECT CASE method WHEN 'error' THEN 'connect_fail' WHEN 'signup' THEN 'browse_fail' WHEN 'view' THEN 'no_response' ELSE 'browse_success' END AS reason, count(*) AS n, count(CASE WHEN k % 2 = 0 THEN 1 END) AS n_correct, count(CASE WHEN k % 2 = 1 THEN 1 END) AS n_incorrect,
 count(*) / (SELECT count(*) FROM rollouts)::DOUBLE AS share, reason = 'browse_success' AS is_success FROM rollouts GROUP BY 1""")
def _(t):
    text = F.when(F.col("method") == "error", "Browse error: Max retries").when(F.col("method") == "signup", "it could not be processed").when(F.col("method") != "view", "Summary: ok")
    return P.visit_outcomes(t.rollouts, classify_response(text), F.col("k") % 2 == 0, "browse_success")


@query("latency_summary", f"""{W}, r AS (SELECT method, score, row_number() OVER (PARTITION BY method ORDER BY score) AS rn, count(*) OVER (PARTITION BY method) AS n FROM rollouts)
SELECT method, count(*) AS n, avg(score) AS mean, min(score) AS min, max(score) AS max, max(CASE WHEN rn = least(floor(n * 0.5) + 1, n) THEN score END) AS p50, max(CASE WHEN rn = least(floor(n * 0.95::DOUBLE) + 1, n) THEN score END) AS p95, max(CASE WHEN rn = least(floor(n * 0.99::DOUBLE) + 1, n) THEN score END) AS p99 FROM r GROUP BY method""")
def _(t):
    return M.latency_summary(t.rollouts, "score", ["method"])


@query("latency_overall", f"""{W}, r AS (SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM rollouts)
SELECT count(*) AS n, avg(score) AS mean, min(score) AS min, max(score) AS max, max(CASE WHEN rn = least(floor(n * 0.5) + 1, n) THEN score END) AS p50, max(CASE WHEN rn = least(floor(n * 0.95::DOUBLE) + 1, n) THEN score END) AS p95, max(CASE WHEN rn = least(floor(n * 0.99::DOUBLE) + 1, n) THEN score END) AS p99 FROM r""")
def _(t):
    return M.latency_summary(t.rollouts, "score")


def batch_rows(t):
    r = t.rollouts
    return r.select("row_id", "uid", "score", (F.col("score") * 2).alias("reward"), F.when(F.col("k") % 11 == 0, 0).otherwise(F.least(F.col("k") * 100, F.lit(8000))).alias("response_length"),
                    F.least(F.col("uid") * 10, F.lit(1000)).alias("prompt_length"), (F.col("k") % 9).alias("num_turns"), "correct",
                    F.when(F.col("k") % 5 == 0, "no_extraction").otherwise("llm_judge").alias("method"))


@query("batch_metrics", f"""{W}, b AS (SELECT score, score * 2 AS reward, CASE WHEN k % 11 = 0 THEN 0 ELSE least(k * 100, 8000) END AS l, least(uid * 10, 1000) AS p, k % 9 AS t, correct AS c, k % 5 = 0 AS x FROM rollouts)
SELECT avg(score) FILTER (l <> 0) AS score_mean, max(score) FILTER (l <> 0) AS score_max, min(score) FILTER (l <> 0) AS score_min, avg(reward) FILTER (l <> 0) AS reward_mean, max(reward) FILTER (l <> 0) AS reward_max, min(reward) FILTER (l <> 0) AS reward_min,
 avg(l) AS response_length_mean, max(l) AS response_length_max, min(l) AS response_length_min, avg(CAST(l = 8000 AS INT)) AS response_clip_ratio, avg(l) FILTER (l <> 0) AS response_length_non_aborted_mean, max(l) FILTER (l <> 0) AS response_length_non_aborted_max, min(l) FILTER (l <> 0) AS response_length_non_aborted_min,
 avg(CAST(l = 8000 AS INT)) FILTER (l <> 0) AS response_clip_ratio_non_aborted, avg(CAST(l = 0 AS INT)) AS aborted_ratio, avg(p) AS prompt_length_mean, max(p) AS prompt_length_max, min(p) AS prompt_length_min, avg(CAST(p = 1000 AS INT)) AS prompt_clip_ratio,
 avg(t) AS num_turns_mean, max(t) AS num_turns_max, min(t) AS num_turns_min, avg(CAST(c AS INT)) AS correct_ratio, avg(l) FILTER (c) AS correct_length_mean, max(l) FILTER (c) AS correct_length_max, min(l) FILTER (c) AS correct_length_min,
 avg(l) FILTER (NOT c) AS incorrect_length_mean, max(l) FILTER (NOT c) AS incorrect_length_max, min(l) FILTER (NOT c) AS incorrect_length_min, avg(t) FILTER (c) AS correct_turns_mean, max(t) FILTER (c) AS correct_turns_max, min(t) FILTER (c) AS correct_turns_min,
 avg(t) FILTER (NOT c) AS incorrect_turns_mean, max(t) FILTER (NOT c) AS incorrect_turns_max, min(t) FILTER (NOT c) AS incorrect_turns_min, avg(CAST(x AS INT)) AS no_extraction_ratio,
 avg(CAST(t >= (SELECT max(t) FROM b) AS INT)) FILTER (NOT c AND x) AS no_extraction_turns_out, avg(CAST(l >= 8000 AS INT)) FILTER (NOT c AND x) AS no_extraction_length_out, avg(CAST(t < (SELECT max(t) FROM b) AND l < 8000 AS INT)) FILTER (NOT c AND x) AS no_extraction_other FROM b""")
def _(t):
    return M.batch_metrics(batch_rows(t), 8000, 1000)


@query("tool_metrics", f"""{W}, m AS (SELECT CASE WHEN method IN ('click', 'view') THEN 'search' ELSE 'visit' END AS tool, CASE method WHEN 'click' THEN 'total_count' WHEN 'view' THEN 'success_count' WHEN 'signup' THEN 'total_count' WHEN 'purchase' THEN 'cache_count' ELSE 'crawler_count' END AS metric, CAST(k AS DOUBLE) AS v, score FROM rollouts),
 a AS (SELECT tool, coalesce(sum(v) FILTER (metric = 'total_count'), 0) AS total_count, coalesce(sum(v) FILTER (metric = 'success_count'), 0) AS success_count, 0.0::DOUBLE AS failure_count, coalesce(sum(v) FILTER (metric = 'cache_count'), 0) AS cache_count, coalesce(sum(v) FILTER (metric = 'crawler_count'), 0) AS crawler_count,
 avg(score) AS time_mean, max(score) AS time_max, min(score) AS time_min FROM m GROUP BY tool)
SELECT tool, total_count, success_count, failure_count, cache_count, crawler_count, 0.0::DOUBLE AS fabricated_url_count, 0.0::DOUBLE AS checked_url_count, success_count / total_count AS success_rate, CASE WHEN tool = 'visit' THEN cache_count / (cache_count + crawler_count) END AS cache_rate, CASE WHEN tool = 'visit' THEN 0.0 / total_count END AS fabricated_url_ratio, time_mean, time_max, time_min FROM a""")
def _(t):
    tool = F.when(F.col("method").isin("click", "view"), "search").otherwise("visit")
    metric = F.when(F.col("method").isin("click", "signup"), "total_count").when(F.col("method") == "view", "success_count").when(F.col("method") == "purchase", "cache_count").otherwise("crawler_count")
    rows = t.rollouts.select(F.create_map(F.concat(F.lit("tool/"), tool, F.lit("/"), metric), F.col("k").cast("double")).alias("metrics"),
                             F.create_map(F.concat(F.lit("tool/"), tool, F.lit("/times")), F.array("score")).alias("times"))
    return M.tool_metrics(rows)


@query("slowest_row", """SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id DESC LIMIT 1""")
def _(t):
    return M.slowest_row(t.events, "value", ["event_id", "user_id", "value"])


@query("group_outcomes", f"""{W}, g AS (SELECT uid * 100 + k AS uid, bool_and(correct) AS a, bool_or(correct) AS o FROM rollouts GROUP BY 1) SELECT avg(CAST(a AS INT)) AS all_correct_ratio, avg(CAST(NOT o AS INT)) AS all_incorrect_ratio, avg(CAST(o AND NOT a AS INT)) AS mixed_ratio, count(*) AS n_groups FROM g""")
def _(t):
    return M.group_outcomes(t.rollouts.withColumn("uid", F.col("uid") * 100 + F.col("k")), "uid", F.col("correct"))


@query("mean_std_at_n", f"""{W}, p AS (SELECT method, uid, avg(score) AS m, stddev_pop(score) AS s, count(*) AS n FROM rollouts GROUP BY 1, 2) SELECT method, round(avg(m), 6) AS mean_at_n, round(avg(s), 6) AS std_at_n, max(n) AS n_responses FROM p GROUP BY method""")
def _(t):
    m = M.mean_std_at_n(t.rollouts, "method", "uid", "score")
    return m.select("method", F.round("mean_at_n", 6).alias("mean_at_n"), F.round("std_at_n", 6).alias("std_at_n"), "n_responses")


@query("majority_value", f"""{W}, v AS (SELECT uid, k % 10 AS vote, count(*) AS n_votes, min(row_id) AS first, arg_min(score, row_id) AS value FROM rollouts GROUP BY 1, 2)
SELECT uid, vote, n_votes, value FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n_votes DESC, first) AS rn FROM v) WHERE rn = 1""")
def _(t):
    return M.majority_value(t.rollouts.withColumn("vote", F.col("k") % 10), ["uid"], "vote", "score", "row_id")


# Draws are md5 of (seed, size, round, draw), scaled to a position in the group.
DRAWS = """x AS (SELECT g.grp, d.size, d.r, d.i, g.score, g.vote FROM (SELECT DISTINCT grp, n, size FROM g, sizes WHERE fits(size, n)) q JOIN d ON d.size = q.size JOIN g ON g.grp = q.grp AND g.pos = (d.u * q.n) >> 32),
 bw AS (SELECT grp, size, r, max(score) AS best, min(score) AS worst FROM x GROUP BY ALL), v AS (SELECT grp, size, r, vote, count(*) AS c, min(i) AS first, arg_min(score, i) AS val FROM x GROUP BY ALL),
 mj AS (SELECT grp, size, r, val FROM v QUALIFY row_number() OVER (PARTITION BY grp, size, r ORDER BY c DESC, first) = 1),
 b AS (SELECT grp, size AS n, 'best' AS reducer, avg(best) AS mean, stddev_pop(best) AS std FROM bw GROUP BY ALL UNION ALL SELECT grp, size, 'worst', avg(worst), stddev_pop(worst) FROM bw GROUP BY ALL UNION ALL SELECT grp, size, 'maj', avg(val), stddev_pop(val) FROM mj GROUP BY ALL)"""
UNITS = """d AS (SELECT size, r, i, CAST('0x' || substr(md5('42|' || size || '|' || r || '|' || i), 1, 8) AS BIGINT) AS u FROM sizes, (SELECT unnest(range(1000)) AS r), (SELECT unnest(range(64)) AS i) WHERE i < size)"""


@query("bootstrap", f"""{W}, sizes AS (SELECT unnest([4, 8]) AS size), {UNITS}, g AS (SELECT uid AS grp, score, k % 10 AS vote, row_number() OVER (PARTITION BY uid ORDER BY row_id) - 1 AS pos, count(*) OVER (PARTITION BY uid) AS n FROM rollouts), {DRAWS.replace("fits(size, n)", "true")}
SELECT grp AS uid, n, reducer, round(mean, 6) AS mean, round(std, 6) AS std FROM b""", ints=("n",))
def _(t):
    b = M.bootstrap(t.rollouts.withColumn("vote", F.col("k") % 10), ["uid"], "score", [4, 8], vote="vote", order="row_id")
    return b.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("best_worst_at_n", f"""{W}, r AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY score, row_id) AS i, count(*) OVER (PARTITION BY uid) AS n FROM rollouts)
SELECT uid, round(sum(score * (pow(i / n::DOUBLE, 4) - pow((i - 1) / n::DOUBLE, 4))), 6) AS best_mean, round(sum(score * (pow((n - i + 1) / n::DOUBLE, 4) - pow((n - i) / n::DOUBLE, 4))), 6) AS worst_mean FROM r GROUP BY uid""")
def _(t):
    return M.exact_best_worst(t.rollouts, ["uid"], "score", 4, "row_id").select("uid", F.round("best_mean", 6).alias("best_mean"), F.round("worst_mean", 6).alias("worst_mean"))


@query("validation_metrics", f"""{W}, g AS (SELECT (method, uid) AS grp, k::DOUBLE AS score, k % 10 AS vote, row_number() OVER (PARTITION BY method, uid ORDER BY row_id) - 1 AS pos, count(*) OVER (PARTITION BY method, uid) AS n FROM rollouts),
 sizes AS (SELECT DISTINCT n AS size FROM g UNION SELECT unnest([2, 4, 8, 16, 32])), {UNITS}, {DRAWS.replace("fits(size, n)", "n > 1 AND (size = n OR size < n AND size IN (2, 4, 8, 16, 32))")},
 p AS (SELECT method, uid, avg(k) AS m, stddev_pop(k) AS s, count(*) AS n FROM rollouts GROUP BY 1, 2), a AS (
 SELECT method, 'mean@' || n AS metric, m AS v, n FROM p UNION ALL SELECT method, 'std@' || n, s, n FROM p WHERE n > 1 UNION ALL SELECT struct_extract(grp, 1), reducer || '@' || n || '/mean', mean, n FROM b UNION ALL SELECT struct_extract(grp, 1), reducer || '@' || n || '/std', std, n FROM b),
 z AS (SELECT method, metric, avg(v) AS value, max(n) AS n FROM a GROUP BY 1, 2), y AS (SELECT *, max(n) OVER (PARTITION BY method) AS top FROM z)
SELECT method, metric, round(value, 9) AS value, CASE WHEN n = top AND regexp_matches(metric, '^(mean|maj|best)@') THEN 'core' ELSE 'aux' END AS section FROM y""")
def _(t):
    # Small whole scores: nine digits then hold every mean of 1000 rounds exactly, so none lies between two rounded numbers.
    rows = t.rollouts.select("method", "uid", F.col("k").cast("double").alias("score"), (F.col("k") % 10).alias("vote"), "row_id")
    return M.validation_metrics(rows, "method", "uid", "score", "vote", "row_id").withColumn("value", F.round("value", 9))


@query("score_by_source", """WITH r AS (SELECT event_type, (round(value * 100) + user_id) / 2.0::DOUBLE AS m FROM events) SELECT event_type, round(avg(m), 6) AS score FROM r GROUP BY event_type""")
def _(t):
    rows = t.events.select("event_type", F.array(F.round(F.col("value") * 100), F.col("user_id").cast("double")).alias("scores"))
    return M.score_by_source(rows, "event_type", "scores").select("event_type", F.round("score", 6).alias("score"))


@query("reduce_metrics", f"""{W}, m AS (SELECT CASE method WHEN 'click' THEN 'len/max' WHEN 'view' THEN 'len/min' WHEN 'error' THEN 'maximin' ELSE 'len/mean' END AS name, score FROM rollouts)
SELECT name, CASE WHEN contains(name, 'max') THEN max(score) WHEN contains(name, 'min') THEN min(score) ELSE avg(score) END AS value FROM m GROUP BY name""")
def _(t):
    name = F.when(F.col("method") == "click", "len/max").when(F.col("method") == "view", "len/min").when(F.col("method") == "error", "maximin").otherwise("len/mean")
    return M.reduce_metrics(t.rollouts.select(name.alias("name"), "score"), "name", "score")


@query("failure_report", f"""{W}, e AS (SELECT CASE method WHEN 'error' THEN 'x Failed to fetch HTML y' WHEN 'view' THEN 'Markdown too short: 12' ELSE 'other ' || method END AS error FROM rollouts),
 c AS (SELECT CASE WHEN contains(error, 'Failed to fetch HTML') THEN 'Failed to fetch HTML' WHEN contains(error, 'Markdown too short') THEN 'Markdown too short' ELSE substring(error, 1, 80) END AS cause FROM e)
SELECT cause, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM c) AS percent FROM c GROUP BY cause""")
def _(t):
    error = F.when(F.col("method") == "error", "x Failed to fetch HTML y").when(F.col("method") == "view", "Markdown too short: 12").otherwise(F.concat(F.lit("other "), "method"))
    return M.failure_report(t.rollouts, error, ["Failed to fetch HTML", "Markdown too short", "LLM failed"])


@query("group_mean_std", f"""{W} SELECT uid, CASE WHEN count(*) <= 1 THEN 0 ELSE avg(score) END AS mean, round(CASE WHEN count(*) <= 1 THEN 1 ELSE sqrt(greatest(var_samp(score), 1e-6)) END, 6) AS std, count(*) AS count FROM rollouts GROUP BY uid""")
def _(t):
    return M.group_mean_std(t.rollouts, "uid", "score").withColumn("std", F.round("std", 6))


@query("request_stats", """SELECT event_type, count(*) AS requests, count(CASE WHEN user_id % 7 <> 0 THEN 1 END) AS ok, count(CASE WHEN user_id % 7 = 0 THEN 1 END) AS failed, avg(round(value * 100)) AS avg_total, count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS rps FROM events GROUP BY event_type""")
def _(t):
    return M.request_stats(t.events, F.col("user_id") % 7 != 0, {"total": F.round(F.col("value") * 100)}, "ts", [F.col("event_type")])


@query("windowed_stats", """SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_start, count(*) AS requests, count(CASE WHEN event_type <> 'error' THEN 1 END) AS ok, avg(round(value * 100)) AS avg_total FROM events GROUP BY 1""")
def _(t):
    w = windowed_stats(t.events, F.col("event_type") != "error", {"total": F.round(F.col("value") * 100)}, "1 hour")
    return w.select(F.unix_micros("window_start").alias("window_start"), "requests", "ok", "avg_total")


@query("finished_samples", """SELECT user_id AS sample_id, count(CASE WHEN event_type IN ('click', 'view') THEN 1 END) AS turns, count(CASE WHEN event_type = 'signup' THEN 1 END) AS tool_calls, count(CASE WHEN event_type = 'error' THEN 1 END) AS failures,
 epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS seconds, CASE WHEN bool_or(event_type = 'purchase') THEN 'done' ELSE 'stalled' END AS state FROM events GROUP BY user_id""")
def _(t):
    kind = F.when(F.col("event_type").isin("click", "view"), "turn").when(F.col("event_type") == "signup", "tool").when(F.col("event_type") == "error", "failure").otherwise("done")
    return finished_samples(t.events.select(F.col("user_id").alias("sample_id"), "ts", kind.alias("kind")))


@query("top_counts", """SELECT user_id, count(*) AS count FROM events GROUP BY user_id ORDER BY count DESC, user_id LIMIT 20""")
def _(t):
    return M.top_counts(t.events, "user_id", 20)


@query("slowest", """SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50""")
def _(t):
    from scoutmill.operators.sampling import slowest

    return slowest(t.events, 50, "value", "event_id").select("event_id", "value")


@query("pairwise_accuracy", f"""{W}, g AS (SELECT a.uid, a.score > b.score AS s, CAST(a.correct AS INT) - CAST(b.correct AS INT) AS d FROM rollouts a JOIN rollouts b ON a.uid = b.uid AND a.row_id < b.row_id),
 u AS (SELECT uid, CASE WHEN sum(abs(d)) = 0 THEN 0.5 ELSE sum(CASE WHEN s = (d > 0) THEN abs(d) ELSE 0 END)::DOUBLE / sum(abs(d)) END AS acc FROM g GROUP BY uid) SELECT round(avg(acc), 9) AS accuracy FROM u""")
def _(t):
    return M.pairwise_accuracy(t.rollouts, "uid", "score", "correct", "row_id").select(F.round("accuracy", 9).alias("accuracy"))


@query("sign_accuracy", f"""{W} SELECT avg(CAST(sign(score - 2000) = sign(CAST(correct AS INT) * 2.0 - 1) AS INT)) AS accuracy FROM rollouts""")
def _(t):
    r = t.rollouts.select((F.col("score") - 2000).alias("s"), F.col("correct").cast("int").alias("y"))
    return M.sign_accuracy(r, "s", "y")


@query("weighted_score", f"""{W}, m AS (SELECT uid, method, avg(score) AS m FROM rollouts GROUP BY 1, 2), w AS (SELECT *, CASE method WHEN 'click' THEN 0.0001 WHEN 'view' THEN -0.0002 ELSE 0.001 END::DOUBLE AS w FROM m)
SELECT uid, round(sum(greatest(least(m * w, 1), -1)), 9) AS score FROM w GROUP BY uid""")
def _(t):
    weights = {"click": 0.0001, "view": -0.0002, "signup": 0.001, "purchase": 0.001, "error": 0.001}
    return M.weighted_score(t.rollouts, "uid", "method", "score", weights).select("uid", F.round("score", 9).alias("score"))


@query("filter_funnel", """SELECT 0 AS step, 'loaded' AS stage, count(*) AS n, 1.0::DOUBLE AS rate FROM conversations UNION ALL SELECT 1, 'deduped', count(DISTINCT text), count(DISTINCT text) / (SELECT count(*) FROM conversations)::DOUBLE FROM conversations
 UNION ALL SELECT 2, 'short', count(DISTINCT text), count(DISTINCT text) / (SELECT count(*) FROM conversations)::DOUBLE FROM conversations WHERE length(text) <= 200""")
def _(t):
    first = D.dedup_first(t.turns, ["text"], ["conv_id", "turn"])
    return M.funnel({"loaded": t.turns, "deduped": first, "short": first.filter(F.length("text") <= 200)})
