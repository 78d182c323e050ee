"""Stored indexes against brute force, and what they leave unread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutmill.operators import indexes as I
from scoutmill.operators import retrieval as R
from scoutmill.session import kept_path


def sparse_rows(n, seed, vocabulary=300, least=-0.2):
    draw = np.random.default_rng(seed)
    rows = {}
    for i in range(n):
        for t in np.unique(draw.zipf(1.4, size=12) % vocabulary):
            rows[(i, f"t{t}")] = float(np.round(draw.uniform(least, 1), 3))
    return [(i, t, w) for (i, t), w in rows.items()]


def files_read(df):
    return df.select(F.input_file_name().alias("f")).distinct().count()


def brute(queries, docs, k):
    by_term, out = {}, {}
    for d, t, w in docs:
        by_term.setdefault(t, []).append((d, w))
    for q, t, w in queries:
        for d, dw in by_term.get(t, []):
            out[(q, d)] = out.get((q, d), 0.0) + w * dw
    hits = {}
    for (q, d), s in out.items():
        if round(s, 9) > 0:
            hits.setdefault(q, []).append((-round(s, 9), d))
    return {(q, d, -s) for q, rows in hits.items() for s, d in sorted(rows)[:k]}


@pytest.fixture(scope="module")
def sparse(spark):
    docs, queries = sparse_rows(3000, 1), sparse_rows(40, 2)
    path = kept_path(spark)
    I.write_sparse_index(spark.createDataFrame(docs, "doc_id long, term string, weight double"), path, range_docs=100, buckets=16)
    return path, docs, queries


@pytest.mark.parametrize("first, parts", [(1, 4096), (3, 6)])
def test_sparse_index_equals_brute_force(spark, sparse, many_tasks, first, parts):
    path, docs, queries = sparse
    index = I.open_sparse_index(spark, path)  # as another job would
    got = I.sparse_index_topk(spark.createDataFrame(queries, "query_id long, term string, weight double"), index, 5, first=first, queries_per_part=parts)
    assert {(r.query_id, r.doc_id, r.score) for r in got.collect()} == brute(queries, docs, 5)


def test_blocks_are_bounded_and_bounds_hold(spark, sparse):
    path, docs, queries = sparse
    index = I.open_sparse_index(spark, path)
    worst = index.blocks.select(F.max(F.size("ids")), F.count_if(F.col("low") != F.array_min("weights")), F.count_if(F.col("top") != F.array_max("weights"))).first()
    assert tuple(worst) == (100, 0, 0) or (worst[0] <= 100 and worst[1] == worst[2] == 0)
    bounds = {(r["query_id"], r["range"]): r["bound"] for r in I.range_bounds(spark.createDataFrame(queries, "query_id long, term string, weight double"), index).collect()}
    assert all(s <= bounds[(q, d // 100)] + 1e-9 for q, d, s in brute(queries, docs, 10**6))


def test_a_selective_query_reads_few_ranges_and_folders(spark):
    """Only one range holds good documents, so no other range is scored."""
    docs = [(i, "a", 1.0 if i < 50 else 0.01) for i in range(2000)] + [(i, f"x{i}", 1.0) for i in range(2000)]
    path = kept_path(spark)
    I.write_sparse_index(spark.createDataFrame(docs, "doc_id long, term string, weight double"), path, range_docs=50, buckets=32)
    index, seen = I.open_sparse_index(spark, path), []
    queries = spark.createDataFrame([(1, "a", 1.0)], "query_id long, term string, weight double")
    plan = index.of_terms(queries)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and files_read(index.of_terms(queries)) <= I.SPREAD < files_read(index.blocks)
    score = I.score_ranges
    I.score_ranges = lambda pairs, *rest: seen.append(pairs.count()) or score(pairs, *rest)
    try:
        got = I.sparse_index_topk(queries, index, 10, first=1).collect()
    finally:
        I.score_ranges = score
    assert sorted(r.doc_id for r in got) == list(range(10)) and seen == [1, 0]


def test_sparse_index_of_nothing(spark):
    path = kept_path(spark)
    empty = spark.createDataFrame([], "doc_id long, term string, weight double")
    I.write_sparse_index(empty, path)
    index = I.open_sparse_index(spark, path)
    asked = spark.createDataFrame([(1, "a", 1.0), (2, None, None)], "query_id long, term string, weight double")
    assert I.sparse_index_topk(asked, index, 3).collect() == []
    assert I.sparse_index_topk(asked.filter("false"), index, 3).collect() == []


def vectors(spark, n, dim, seed, name):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vector array<double>"), x


def test_cell_index_recall_and_files(spark):
    docs, d = vectors(spark, 4000, 16, 1, "doc_id")
    queries, q = vectors(spark, 60, 16, 2, "query_id")
    path = kept_path(spark)
    I.write_cell_index(docs, path, cells=12)
    index = I.open_cell_index(spark, path)
    exact = np.argsort(-(q @ d.T), axis=1, kind="stable")[:, :10]
    found = lambda **how: {(r.query_id, r.doc_id) for r in I.cell_index_topk(queries, index, 10, **how).collect()}
    want = {(i, int(j)) for i, row in enumerate(exact) for j in row}
    assert found(nprobe=12) == want and index.vectors.count() == 4000
    assert len(found() & want) / len(want) >= 0.9 and index.nprobe(0.95) < 12
    assert (np.diff(index.recall) >= 0).all() and index.recall[-1] == 1
    files = [files_read(index.of_cells(range(n))) for n in (1, 4, 12)]
    assert files[0] < files[1] < files[2] == files_read(index.vectors)
    assert "PartitionFilters: [cell" in index.of_cells([3])._jdf.queryExecution().executedPlan().toString().replace("isnotnull(cell#", "cell#")


def test_hits_over_blocks_keep_ties_by_id(monkeypatch):
    monkeypatch.setattr(R, "BLOCK_DOCS", 3)
    ids = np.array([9, 3, 7, 1, 4, 8, 2, 6])
    docs = np.array([[1.0], [1.0], [2.0], [1.0], [1.0], [0.0], [1.0], [2.0]])
    got = R._hits(np.array([5, 6]), ids, np.array([[1.0], [-1.0]]), docs, 4)
    pick = lambda q: sorted(got[got["query_id"] == q]["doc_id"])
    assert pick(5) == [1, 2, 6, 7] and pick(6) == [1, 2, 3, 8]


def test_scoring_moves_no_weights_per_range(spark, tmp_path):
    """Small ranges and many queries: what is shuffled grows with postings and pairs, not with their product with terms."""
    docs = spark.range(4000, numPartitions=4).select(F.col("id").alias("doc_id"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("t"), F.pmod(F.col("id") * 7 + i, F.lit(40)).cast("string")))).alias("term"), (F.pmod("id", F.lit(13)) + 1.0).alias("weight"))
    queries = spark.range(60).select(F.col("id").alias("query_id"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("t"), F.pmod(F.col("id") + i, F.lit(40)).cast("string")))).alias("term"), F.lit(1.0).alias("weight"))
    I.write_sparse_index(docs, str(tmp_path / "i"), range_docs=16, buckets=4)
    index = I.open_sparse_index(spark, str(tmp_path / "i"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = sorted(map(tuple, I.sparse_index_topk(queries, index, 5, queries_per_part=7).collect()))
    assert written() - before < 2_000_000
    assert got == sorted(map(tuple, R.sparse_topk(queries, docs, 5).collect()))


def test_fulltext_search_takes_more_tasks_for_more_text(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_CHARS", 100, raising=False)
    docs = spark.range(200, numPartitions=2).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "red fox red fox").otherwise("red hen hen hen").alias("text"))
    queries = spark.createDataFrame([(1, "fox red"), (2, "hen")], "query_id long, query string")
    found = R.fulltext_search(docs, queries, 2)
    assert sorted(map(tuple, found.select("query_id", "doc_id", "rank").collect())) == [(1, 0, 4), (1, 2, 4), (2, 1, 3), (2, 3, 3)]
    assert "hashpartitioning(doc_id#" in found._jdf.queryExecution().toString() and ", 30), REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()


def test_weights_of_some_terms_are_those_of_whole_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(1, 30) if i % j == 0) + f" own{i} own{i}") for i in range(200)] + [(200, None)], "doc_id long, text string")
    key = lambda x: sorted((r.doc_id, r.term, round(r.weight, 12)) for r in x.collect())
    whole = key(R.term_weights(docs, "doc_id", F.col("text")))
    some = spark.createDataFrame([("w2",), ("own7",), ("none",), ("w2",)], "term string")
    wanted = [r for r in whole if r[1] in ("w2", "own7")]
    assert len(wanted) == 101 and key(R.term_weights(docs, "doc_id", F.col("text"), only=some)) == wanted
    monkeypatch.setattr(R, "SHIPPED_TERMS", 20)  # most terms are too rare to be shipped
    assert key(R.term_weights(docs, "doc_id", F.col("text"))) == whole
    assert key(R.term_weights(docs, "doc_id", F.col("text"), only=some)) == wanted
    path = kept_path(spark)
    I.write_sparse_index(R.term_weights(docs, "doc_id", F.col("text")), path, range_docs=16, buckets=4, ids=docs)
    queries = R.term_weights(docs.filter("doc_id % 50 = 0"), "doc_id", F.col("text"), "query_id", idf=False)
    exact = R.sparse_topk(queries, R.term_weights(docs, "doc_id", F.col("text"), only=queries), 5)
    # A document's score is added up where its postings are.
    plan = exact._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(query_id#" in line and "doc_id#" in line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines())
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, I.sparse_index_topk(queries, I.open_sparse_index(spark, path), 5).collect()))


def test_an_index_of_texts_is_that_of_their_weights(spark, monkeypatch):
    """Texts without words or id, two texts of one id, words in every text, in two and in one."""
    rows = [(i, " ".join(f"w{j}" for j in range(1, 30) if i % j == 0) + f" own{i} Own{i} pair{i // 2}") for i in range(0, 400, 2)]
    docs = spark.createDataFrame([*rows, (401, None), (403, " - "), (405, "w1 w1 left"), (405, "w2 right"), (None, "w1 w2 nobody")], "doc_id long, text string")
    flat = lambda path: sorted((r.range, r.doc_id, r.term, round(r.weight, 12)) for r in I.open_sparse_index(spark, path).blocks.select("range", "term", F.explode(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("weights").alias("weight"))).alias("p")).select("range", "term", "p.*").collect())
    path = kept_path(spark)
    I.write_sparse_index(R.term_weights(docs, "doc_id", F.col("text")), path, range_docs=16, buckets=4, ids=docs)
    want = flat(path)
    assert {r[1] for r in want} == {i for i, _ in rows} | {405} and max(r[0] for r in want) == 12
    for shipped in (R.SHIPPED_TERMS, 20, 0):  # at 0 no term is shipped
        monkeypatch.setattr(R, "SHIPPED_TERMS", shipped)
        path = kept_path(spark)
        I.write_text_index(docs, path, "doc_id", F.col("text"), range_docs=16, buckets=4)
        assert flat(path) == want
    path = kept_path(spark)
    I.write_text_index(docs.filter("false"), path, "doc_id", F.col("text"))
    assert flat(path) == []


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_an_index_of_texts_moves_texts_not_postings(spark):
    """A text of short words is a third of its postings' size or less, and nothing else may move with it."""
    from scoutmill.catalog.table_queries import sparse_index

    word = lambda i: F.pmod(F.xxhash64("id", i), F.lit(3000)).cast("string")
    docs = spark.range(4000, numPartitions=8).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), word), " ").alias("text"))
    tables = type("T", (), {"spark": spark, "documents": spark.read.schema(docs.schema).parquet(_written(docs, kept_path(spark)))})()
    before = shuffled(spark)
    index = sparse_index(tables, range_docs=64)
    assert shuffled(spark) - before < 3_500_000
    assert index.blocks.agg(F.sum(F.size("ids"))).first()[0] == tables.documents.select(F.size(F.array_distinct(F.split("text", " "))).alias("n")).agg(F.sum("n")).first()[0]


def _written(df, path):
    df.write.parquet(path)
    return path


def test_shuffle_files_of_a_kept_table_are_removed(spark):
    import gc
    import time

    from scoutmill.session import keep

    files = lambda: sum("shuffle_" in f for f in str(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()).split(","))
    gc.collect()
    before = files()
    assert len(keep(spark.range(1000).repartition(5, "id")).collect()) == 1000
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
