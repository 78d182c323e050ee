"""Table verbs, splits, batching, and search over orders, nation, customer, lineitem, embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutmill.catalog.base import TOKEN_ORDER, TOKEN_ORDER_SQL, query
from scoutmill.functions.arrays import inner_product
from scoutmill.operators import indexes as I
from scoutmill.operators import joins as J
from scoutmill.operators import reshape as R
from scoutmill.operators import retrieval as S
from scoutmill.operators import sampling as B
from scoutmill.operators.ordering import number_rows
from scoutmill.session import keep, kept_path


@query("attach_revision", """WITH i AS (SELECT o_custkey AS question, arg_max('https://w.example/' || CAST(o_orderkey AS VARCHAR), o_orderkey) AS revision_url FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1)
SELECT o_orderkey, revision_url, CASE WHEN revision_url IS NULL THEN 'no_revision_url' END AS reason FROM orders LEFT JOIN i ON o_custkey = question""")
def _(t):
    qa = t.orders.select("o_orderkey", F.col("o_custkey").alias("question"))
    index = t.orders.filter("o_custkey % 5 <> 0").select("o_orderkey", F.col("o_custkey").alias("question"), F.concat(F.lit("https://w.example/"), F.col("o_orderkey").cast("string")).alias("revision_url"))
    return J.attach_revision(qa, index, ["o_orderkey"]).select("o_orderkey", "revision_url", "reason")


@query("resume", """SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F')""")
def _(t):
    done = t.orders.filter("o_orderpriority = '1-URGENT'")
    return J.resume(t.orders, done, ["o_custkey"], F.col("o_orderstatus") == "F").select("o_orderkey")


@query("priority_files", """SELECT o_orderkey AS file FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O') AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')""")
def _(t):
    f = t.orders.withColumnRenamed("o_orderkey", "file")
    return J.priority_files(f.filter("o_custkey % 2 = 0").select("file"), f.filter("o_orderstatus <> 'O'"), f.filter("o_orderpriority = '5-LOW'"))


@query("union_columns", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders""")
def _(t):
    return J.union_columns(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


@query("fan_out", """WITH f AS (SELECT c_custkey, r AS rollout_idx FROM customer, (SELECT unnest([1, 2, 3, 4]) AS r) WHERE NOT (c_custkey % 3 = 0 AND r = 2)) SELECT c_custkey, rollout_idx, CAST((row_number() OVER (ORDER BY c_custkey, rollout_idx) - 1) % 7 AS INTEGER) AS slot FROM f""")
def _(t):
    done = t.customer.filter("c_custkey % 3 = 0").select("c_custkey", F.lit(2).alias("rollout_idx"))
    return J.fan_out(t.customer.select("c_custkey"), 4, 7, "c_custkey", done).select("c_custkey", "rollout_idx", "slot")


@query("value_predicates", """SELECT o_orderkey FROM orders WHERE o_orderpriority <> '' AND o_orderstatus = 'F' AND o_orderdate >= '1996-01-01' AND o_orderdate < '1998-06-01'""")
def _(t):
    return t.orders.filter((F.col("o_orderpriority") != "") & (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
                           & (F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("select_rename_drop", """SELECT n_nationkey AS id, n_name AS name FROM nation""")
def _(t):
    return t.nation.withColumnsRenamed({"n_nationkey": "id", "n_name": "name"}).select("id", "name")


@query("slice_rows", """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i >= 10 AND i < n - 5 AND (i - 10) % 3 = 0""")
def _(t):
    return R.slice_rows(t.orders, ["o_totalprice", "o_orderkey"], 10, -5, 3).select("o_orderkey")


@query("select_idxs", """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i FROM orders) WHERE i IN (SELECT c_custkey FROM customer)""")
def _(t):
    return R.select_idxs(t.orders, t.customer.select(F.col("c_custkey").alias("idx")), ["o_totalprice", "o_orderkey"]).select("o_orderkey")


@query("concat_tables", """SELECT n_nationkey AS k, n_name AS name, NULL AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region""")
def _(t):
    return R.concat([t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit("region").alias("extra"))])


@query("concat_batches", """SELECT 'metrics' AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT 'temperature', '0.6'""")
def _(t):
    parts = [t.nation.filter(f"n_nationkey % 2 = {i}") for i in (0, 1)]
    metas = [p.select(F.lit("metrics").alias("key"), F.col("n_nationkey").cast("string").alias("value")).unionByName(p.agg(F.lit("temperature").alias("key"), F.lit("0.6").alias("value"))) for p in parts]
    return R.concat_batches(parts, metas)[1]


@query("except_keys", """SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def _(t):
    return R.except_keys(t.orders, t.orders.filter("o_orderstatus = 'P'"), ["o_custkey"]).select("o_orderkey")


@query("intersect_keys", """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def _(t):
    return R.intersect_keys(t.orders, t.orders.filter("o_orderstatus = 'P'"), ["o_custkey"]).select("o_orderkey")


@query("unpivot_pairs", """SELECT o_orderkey, 'o_orderstatus' AS kind, o_orderstatus AS response, 1.0::DOUBLE AS reward FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority, 0.0 FROM orders""")
def _(t):
    return R.unpivot_pairs(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"], "o_orderstatus", "o_orderpriority")


@query("repeat_interleaved", """SELECT n_nationkey, c AS copy, (row_number() OVER (PARTITION BY c ORDER BY n_nationkey) - 1) * 3 + c AS position FROM nation, (SELECT unnest([0, 1, 2]) AS c)""", longs=("copy",))
def _(t):
    return R.repeat(t.nation.select("n_nationkey"), 3, ["n_nationkey"]).withColumn("copy", F.col("copy").cast("long"))


@query("repeat_tiled", """SELECT n_nationkey, c AS copy, row_number() OVER (PARTITION BY c ORDER BY n_nationkey) - 1 + c * (SELECT count(*) FROM nation) AS position FROM nation, (SELECT unnest([0, 1, 2]) AS c)""", longs=("copy",))
def _(t):
    return R.repeat(t.nation.select("n_nationkey"), 3, ["n_nationkey"], interleave=False).withColumn("copy", F.col("copy").cast("long"))


@query("repeat_by", """SELECT n_nationkey, unnest(range(n_regionkey)) AS copy FROM nation""")
def _(t):
    return R.repeat_by(t.nation, F.col("n_regionkey")).select("n_nationkey", F.col("copy").cast("long").alias("copy"))


@query("pad_to_multiple", """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, i AS position, false AS is_pad FROM o UNION ALL SELECT o_orderkey, n + i, true FROM o WHERE i <= (1024 - n % 1024) % 1024""")
def _(t):
    return R.pad_to_multiple(t.orders.select("o_orderkey"), 1024, ["o_orderkey"])


@query("chunk", """SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / ((SELECT count(*) FROM orders) / 5)) AS BIGINT) AS chunk FROM orders""")
def _(t):
    return R.chunk(t.orders, 5, ["o_orderkey"]).select("o_orderkey", "chunk")


@query("split_size", """SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1024) AS BIGINT) AS chunk FROM orders""")
def _(t):
    return R.split_size(t.orders, 1024, ["o_orderkey"]).select("o_orderkey", "chunk")


@query("worker_split", """SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / ceil((SELECT count(*) FROM orders) / 7)) AS BIGINT) AS split FROM orders""")
def _(t):
    return R.worker_split(t.orders, 7, ["o_orderkey"]).select("o_orderkey", "split")


@query("fold", """SELECT CAST(floor((rn - 1) / 4) AS BIGINT) AS fold_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rn) AS ids FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings) GROUP BY 1""")
def _(t):
    return R.fold(t.embeddings, 4, ["vec_id"], ["vec_id"]).select("fold_id", F.array_join(F.transform("vec_id", lambda v: v.cast("string")), ",").alias("ids"))


@query("unfold", """SELECT vec_id, label FROM embeddings""")
def _(t):
    return R.unfold(R.fold(t.embeddings, 4, ["vec_id"], ["vec_id", "label"]), ["vec_id", "label"]).select("vec_id", "label")


@query("unfold_columns", """SELECT vec_id, label, p AS part, embedding[p * 16 + 1]::DOUBLE AS first, 16 AS n FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS p)""", longs=("part", "n"))
def _(t):
    r = R.unfold_columns(t.embeddings, "embedding", 4)
    return r.select("vec_id", "label", F.col("part").cast("long").alias("part"), F.get("embedding", F.lit(0)).cast("double").alias("first"), F.size("embedding").cast("long").alias("n"))


@query("reorder", """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, n - 1 - i AS position FROM o""")
def _(t):
    from scoutmill.operators.ordering import with_row_count

    perm = with_row_count(number_rows(t.orders.select("o_orderkey"), ["o_orderkey"], "_i"), "_n").select((F.col("_i") - 1).alias("old"), (F.col("_n") - F.col("_i")).alias("new"))
    return R.reorder(t.orders.select("o_orderkey"), R.inverse_permutation(R.inverse_permutation(perm)), ["o_orderkey"])


@query("unwrap", """SELECT o_orderkey, o_orderstatus AS prompt FROM orders""")
def _(t):
    return R.unwrap(t.orders.select("o_orderkey", F.array("o_orderstatus").alias("prompt")), ["prompt"])


@query("even_sample", """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE (i % floor(n / 40) = 0 AND i < floor(n / 40) * 39) OR i = n - 1""")
def _(t):
    return B.even_sample(t.orders, 40, ["o_orderkey"]).select("o_orderkey")


@query("slice_split", """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= floor((SELECT count(*) FROM orders) * 0.75::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM orders""")
def _(t):
    return B.slice_split(t.orders, ["o_orderkey"]).select("o_orderkey", "split")


@query("sort_by_score", """SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END, o_custkey, 0) DESC, o_orderkey) AS place FROM orders""")
def _(t):
    score = F.coalesce(F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")), F.col("o_custkey"), F.lit(0))
    return number_rows(t.orders.withColumn("s", score), [F.col("s").desc(), F.col("o_orderkey")], "place").select("o_orderkey", "place")


@query("sample_titles", """SELECT p_name AS title, 'https://en.wikipedia.org/w/index.php?title=' || replace(p_name, ' ', '_') || '&action=history&offset=&limit=2000' AS history_url FROM part ORDER BY md5(concat_ws(':', '42', p_name)), p_name LIMIT 25""")
def _(t):
    return B.sample_titles(t.part.select(F.col("p_name").alias("title")), 25)


@query("cap_per_source", """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws(':', '42', doc_id)), doc_id) AS r FROM documents) WHERE r <= 5""")
def _(t):
    return B.cap_per_source(t.documents.select("doc_id", "source"), 5, "source", ["doc_id"]).select("doc_id", "source")


@query("shuffle", """SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws(':', '42', o_orderkey)), o_orderkey) AS position FROM orders""")
def _(t):
    return B.shuffle(t.orders.select("o_orderkey"), ["o_orderkey"])


@query("train_test_split", """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', '42', o_orderkey)), o_orderkey) <= (SELECT floor(count(*) * 0.9::DOUBLE) FROM orders) THEN 'train' ELSE 'test' END AS split FROM orders""")
def _(t):
    return B.split(t.orders.select("o_orderkey"), 0.9, ["o_orderkey"]).select("o_orderkey", "split")


@query("choose_rows", """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY left(md5(concat_ws(':', '42', o_orderkey)), 13) DESC, o_orderkey LIMIT 30""")
def _(t):
    picked = B.choose_rows(t.orders, lambda df: df.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("weight")), "o_orderkey", 30)
    return picked.select("o_orderkey", "o_orderstatus")


def batches(t):
    """lineitem rows as samples of training batches: 1,024 consecutive samples each, lengths from the quantity."""
    rows = number_rows(t.lineitem.select("l_orderkey", *TOKEN_ORDER), ["l_orderkey", *TOKEN_ORDER], "row_id")
    return rows.select(F.expr("(row_id - 1) div 1024").alias("batch_id"), "row_id", F.col("l_quantity").cast("long").alias("length"))


@query("balance_batches", f"""WITH r AS (SELECT (row_number() OVER (ORDER BY l_orderkey, {TOKEN_ORDER_SQL}) - 1) // 1024 AS batch_id, CAST(l_quantity AS BIGINT) AS length FROM lineitem)
SELECT batch_id, count(*) AS n, CAST(sum(length) AS BIGINT) AS tokens, 8 AS bins, count(*) // 8 AS smallest, count(*) // 8 AS largest, true AS balanced FROM r GROUP BY batch_id""", longs=("bins",))
def _(t):
    b = B.balance_batches(batches(t), "batch_id", "row_id", "length", 8)
    per = b.groupBy("batch_id", "bin").agg(F.count(F.lit(1)).alias("c"), F.sum("length").alias("s"), F.max("length").alias("m"))
    # Totals of the bins lie within one row's length of each other.
    return per.groupBy("batch_id").agg(
        F.sum("c").alias("n"), F.sum("s").alias("tokens"), F.count(F.lit(1)).alias("bins"), F.min("c").alias("smallest"), F.max("c").alias("largest"),
        (F.max("s") - F.min("s") <= F.max("m")).alias("balanced"))


BATCHES = f"""r AS (SELECT (row_number() OVER (ORDER BY l_orderkey, {TOKEN_ORDER_SQL}) - 1) // 1024 AS batch_id, row_number() OVER (ORDER BY l_orderkey, {TOKEN_ORDER_SQL}) AS row_id, CAST(l_quantity AS BIGINT) AS length FROM lineitem)"""


@query("pack_batches", f"""WITH {BATCHES} SELECT batch_id, count(*) AS n, CAST(sum(length) AS BIGINT) AS tokens, least(count(*), greatest(1, CAST(ceil(sum(length) / 4096.0::DOUBLE) AS BIGINT))) AS bins, true AS even, true AS heaviest_first FROM r GROUP BY batch_id""", longs=("bins",))
def _(t):
    p = B.pack_batches(batches(t), "batch_id", "row_id", "length", 4096)
    per = p.groupBy("batch_id", "bin").agg(F.count(F.lit(1)).alias("c"), F.sum("length").alias("s"), F.max("length").alias("m"), F.sum(F.col("length") * F.col("length")).alias("w"))
    works = F.transform(F.sort_array(F.collect_list(F.struct("bin", "w"))), lambda b: b["w"])  # few bins a batch
    return per.groupBy("batch_id").agg(
        F.sum("c").alias("n"), F.sum("s").alias("tokens"), F.count(F.lit(1)).alias("bins"), (F.max("s") - F.min("s") <= F.max("m")).alias("even"),
        (works == F.reverse(F.array_sort(works))).alias("heaviest_first"))


@query("pack_batches_chunked", f"""WITH {BATCHES} SELECT batch_id, count(*) AS n, CAST(sum(length) AS BIGINT) AS tokens, least(count(*), greatest(1, CAST(ceil(sum(length) / 1024.0::DOUBLE) AS BIGINT))) AS bins, true AS near_budget FROM r GROUP BY batch_id""", longs=("bins",))
def _(t):
    """Batches above the size of a chunk: as many micro-batches in all, each within a chunk's rounding of the budget."""
    p = B.pack_batches(batches(t), "batch_id", "row_id", "length", 1024, chunk_rows=300)
    per = p.groupBy("batch_id", "bin").agg(F.count(F.lit(1)).alias("c"), F.sum("length").alias("s"), F.max("length").alias("m"))
    return per.groupBy("batch_id").agg(F.sum("c").alias("n"), F.sum("s").alias("tokens"), F.count(F.lit(1)).alias("bins"), (F.max("s") <= 1.25 * 1024).alias("near_budget"))


@query("greedy_bins", f"""WITH RECURSIVE {BATCHES}, p AS (SELECT batch_id, length, row_number() OVER (PARTITION BY batch_id ORDER BY row_id) AS i FROM r),
 s AS (SELECT DISTINCT batch_id, 0::BIGINT AS i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS sums, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS ns FROM p
  UNION ALL SELECT s.batch_id, p.i, list_transform(s.sums, lambda x, j: x + CASE WHEN j = list_position(s.sums, list_min(s.sums)) THEN p.length ELSE 0 END),
   list_transform(s.ns, lambda x, j: x + CASE WHEN j = list_position(s.sums, list_min(s.sums)) THEN 1 ELSE 0 END) FROM s JOIN p ON p.batch_id = s.batch_id AND p.i = s.i + 1),
 f AS (SELECT batch_id, sums, ns FROM s QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY i DESC) = 1)
SELECT batch_id, unnest(range(8)) AS bin, unnest(ns) AS n, unnest(sums) AS tokens FROM f""", ints=("bin",))
def _(t):
    return B.greedy_bins(batches(t), "batch_id", "row_id", "length", 8).groupBy("batch_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"))


# ---- search -------------------------------------------------------------

def dense_queries(t):
    """One query per label: the mean vector of its rows (the number of labels is small and fixed)."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # 64 numbers per label.
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", F.round("x", 9).alias("x")))).alias("v")).select(
        F.col("label").cast("long").alias("query_id"), F.transform("v", lambda s: s["x"]).alias("vector"))


def dense_docs(t):
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


DENSE = """p AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, pos, round(avg(x), 9) AS x FROM p GROUP BY 1, 2), q AS (SELECT label AS query_id, list(x ORDER BY pos) AS v FROM c GROUP BY 1),
 ds AS (SELECT query_id, vec_id AS doc_id, round(list_inner_product(v, embedding::DOUBLE[]), 9) AS score FROM q, embeddings), dk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM ds) WHERE rn <= 10)"""


@query("dense_topk", f"""WITH {DENSE} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score, 6) AS score FROM dk""")
def _(t):
    return S.dense_topk(dense_queries(t), dense_docs(t), 10).withColumn("score", F.round("score", 6))


@query("dense_topk_blocks", f"""WITH {DENSE} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score, 6) AS score FROM dk""")
def _(t):
    return S.dense_topk(dense_queries(t), dense_docs(t), 10, batch=7).withColumn("score", F.round("score", 6))


@query("inner_product", """SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS s FROM embeddings""")
def _(t):
    return t.embeddings.select("vec_id", F.round(inner_product(F.col("embedding"), F.reverse("embedding")), 6).alias("s"))


SPARSE = r"""wd AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM wd GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 ti AS (SELECT doc_id, tf.term, tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)::DOUBLE) AS w FROM tf JOIN df ON tf.term = df.term), nn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM ti GROUP BY 1), dw AS (SELECT ti.doc_id, term, CASE WHEN n > 0 THEN w / n ELSE 0 END AS w FROM ti JOIN nn ON ti.doc_id = nn.doc_id),
 wq AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark), qf AS (SELECT query_id, term, count(*)::DOUBLE AS tf FROM wq GROUP BY 1, 2), qn AS (SELECT query_id, sqrt(sum(tf * tf)) AS n FROM qf GROUP BY 1), qw AS (SELECT qf.query_id, term, tf / n AS w FROM qf JOIN qn ON qf.query_id = qn.query_id),
 ss AS (SELECT query_id, doc_id, round(sum(qw.w * dw.w), 9) AS score FROM qw JOIN dw ON qw.term = dw.term GROUP BY 1, 2), sk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM ss WHERE score > 0) WHERE rn <= 10)"""


def sparse_queries(t):
    return S.term_weights(t.benchmark, "item_id", F.col("text"), "query_id", idf=False)


def sparse_docs(t, only=None):
    return S.term_weights(t.documents, "doc_id", F.col("text"), only=only)


@query("sparse_topk", f"""WITH {SPARSE} SELECT query_id, doc_id, round(score, 6) AS score FROM sk""")
def _(t):
    asked = keep(sparse_queries(t))
    return S.sparse_topk(asked, sparse_docs(t, asked), 10).withColumn("score", F.round("score", 6))


def sparse_index(t, **options):
    """The documents' postings written as an index and opened again."""
    path = kept_path(t.spark)
    I.write_text_index(t.documents, path, "doc_id", F.col("text"), **options)
    return I.open_sparse_index(t.spark, path)


def cell_index(t, **options):
    path = kept_path(t.spark)
    I.write_cell_index(dense_docs(t), path, **options)
    return I.open_cell_index(t.spark, path)


@query("sparse_topk_salted", f"""WITH {SPARSE} SELECT query_id, doc_id, round(score, 6) AS score FROM sk""")
def _(t):
    """Ranges of 64 documents, and queries dealt over several groups of each range."""
    return I.sparse_index_topk(sparse_queries(t), sparse_index(t, range_docs=64), 10, queries_per_part=7).withColumn("score", F.round("score", 6))


@query("sparse_index_topk", f"""WITH {SPARSE} SELECT query_id, doc_id, round(score, 6) AS score FROM sk""")
def _(t):
    return I.sparse_index_topk(sparse_queries(t), sparse_index(t), 10).withColumn("score", F.round("score", 6))


ITEM_DENSE = """iq AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
 ds AS (SELECT query_id, vec_id AS doc_id, round(list_inner_product(v, embedding::DOUBLE[]), 9) AS score FROM iq, embeddings), dk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM ds) WHERE rn <= 10)"""


def item_queries(t):
    """Benchmark items as dense queries: the vector that goes by the item's id."""
    return t.benchmark.join(t.embeddings, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("hybrid_index_search", f"""WITH {SPARSE}, {ITEM_DENSE}, f AS (SELECT coalesce(sk.query_id, dk.query_id) AS query_id, coalesce(sk.doc_id, dk.doc_id) AS doc_id, round(0.7::DOUBLE * coalesce(sk.score, 0) + 1.0 * coalesce(dk.score, 0), 9) AS score FROM sk FULL OUTER JOIN dk ON sk.query_id = dk.query_id AND sk.doc_id = dk.doc_id)
SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM f) WHERE rn <= 10""")
def _(t):
    """Both legs from stored indexes, over the same queries and document ids; every cell is probed, so the answer is exact."""
    index = cell_index(t, cells=8)
    both = J.fuse(I.sparse_index_topk(sparse_queries(t), sparse_index(t), 10), I.cell_index_topk(item_queries(t), index, 10, nprobe=8), 10)
    return both.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("hybrid_search", f"""WITH {SPARSE}, {DENSE}, f AS (SELECT coalesce(sk.query_id, dk.query_id) AS query_id, coalesce(sk.doc_id, dk.doc_id) AS doc_id, round(0.7::DOUBLE * coalesce(sk.score, 0) + 1.0 * coalesce(dk.score, 0), 9) AS score FROM sk FULL OUTER JOIN dk ON sk.query_id = dk.query_id AND sk.doc_id = dk.doc_id)
SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM f) WHERE rn <= 10""")
def _(t):
    asked = keep(sparse_queries(t))
    hits = S.hybrid_search(dense_queries(t), dense_docs(t), asked, sparse_docs(t, asked), 10)
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("fulltext_search", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents), q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark),
 n AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1), h AS (SELECT q.query_id, w.doc_id, count(DISTINCT w.term) AS c, count(*) AS rank FROM w JOIN q ON w.term = q.term GROUP BY 1, 2)
SELECT query_id, doc_id, rank FROM (SELECT h.query_id, doc_id, rank, row_number() OVER (PARTITION BY h.query_id ORDER BY rank DESC, doc_id) AS rn FROM h JOIN n ON h.query_id = n.query_id AND c = need) WHERE rn <= 10""")
def _(t):
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return S.fulltext_search(t.documents, queries, 10).select("query_id", "doc_id", "rank")


@query("fuse", f"""WITH {DENSE}, a AS (SELECT query_id, doc_id, score FROM dk WHERE doc_id % 2 = 0), b AS (SELECT query_id, doc_id, score FROM dk WHERE doc_id % 3 = 0), f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, round(0.7::DOUBLE * coalesce(a.score, 0) + coalesce(b.score, 0), 9) AS score FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id)
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM f) WHERE rn <= 5""")
def _(t):
    hits = S.dense_topk(dense_queries(t), dense_docs(t), 10)
    return J.fuse(hits.filter("doc_id % 2 = 0"), hits.filter("doc_id % 3 = 0"), 5).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("ann_topk")
def _(t):
    """Every vector whose id is divisible by 50 as a query, over a stored index at its default recall."""
    queries = dense_docs(t).filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    return I.cell_index_topk(queries, cell_index(t, cells=16), 10)


@query("ann_topk_all_cells", f"""WITH {DENSE} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score, 6) AS score FROM dk""")
def _(t):
    placed, centres = S.build_cells(dense_docs(t), 8)
    return S.ann_topk(dense_queries(t), placed, centres, 10, 8).withColumn("score", F.round("score", 6))


@query("hashing_embedder")
def _(t):
    return S.hashing_embedder(t.documents, "doc_id", "text")


@query("embed", """SELECT doc_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS chars, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) AS DOUBLE) AS blanks FROM documents""")
def _(t):
    vectors = S.embed(t.documents, "doc_id", "text", lambda texts: [[len(x), x.count(" ")] for x in texts], 2)
    return vectors.select("doc_id", F.col("vector")[0].cast("double").alias("chars"), F.col("vector")[1].cast("double").alias("blanks"))
