"""Whole jobs on small frames, and plans that must keep their shape."""

import json

from pyspark.sql import functions as F

from scoutmill.operators import advantages as V
from scoutmill.operators import metrics as M
from scoutmill.operators import retrieval as R
from scoutmill.plans import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_qa_synthesis(spark):
    body = "<p>" + "The blue whale swims in the sea. " * 10 + "</p>"
    store = spark.createDataFrame([("https://a/x", body), ("y", body), ("https://c/z", "<p>short</p>")], "key string, html string")
    urls = spark.createDataFrame([("https://a/x",), ("https://b/y",), ("https://c/z",), ("https://d/none",)], "url string")
    pages = spark.createDataFrame([("https://a/x", "blue whale"), ("https://b/y", "nothing")], "url string, markdown string")
    asked = []

    def generator(prompts):
        asked.extend(prompts)
        return [json.dumps({"qa_pairs": [{"question": f"q {p[-6:]}", "answer": "blue whale"}, {"question": "long", "answer": "x" * 50}]}) for p in prompts]

    write = lambda text: F.concat(F.lit("Ask about: "), F.substring(text, 1, 20), F.substring(F.md5(F.col("url")), 1, 6))
    rows = {(r.url, r.result) for r in jobs.qa_synthesis(urls, store, write, generator, pages).collect()}
    assert rows == {("https://a/x", "negative"), ("https://b/y", "positive")}


def test_corpus_build(spark):
    rows = spark.createDataFrame([("u", "t", "old\x00", 1), ("u", "t", "new text", 2), ("v", None, "other", 3)], "url string, title string, text string, o int")
    out = {r.url: (r.text, r.doc, list(r.vector)) for r in jobs.corpus_build(rows, lambda texts: [[len(x), 1.0] for x in texts], 2, ["o"]).collect()}
    assert out["u"][:2] == ("new text", "new text") and out["u"][2][0] == len("Title: t\n\nContent: new text")
    assert set(out) == {"u", "v"}


def test_statistics_read_two_columns(spark, tmp_path):
    spark.range(100).select((F.col("id") % 5).alias("uid"), F.col("id").cast("double").alias("score"), F.lit("x").alias("wide")).write.parquet(str(tmp_path / "r"))
    df = spark.read.parquet(str(tmp_path / "r"))
    text = plan(V.grpo(df).select("uid", "advantage"))
    assert "wide" not in text and "Window" not in text
    assert "PushedFilters: [IsNotNull(uid), EqualTo(uid,3)]" in plan(M.group_mean_std(df.filter("uid = 3"), "uid", "score"))


def test_postings_stay_in_place(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} common text {i}") for i in range(50)], "doc_id long, text string")
    weights = R.term_weights(docs, "doc_id", F.col("text"))
    queries = R.term_weights(docs.limit(3).withColumnRenamed("doc_id", "q"), "q", F.col("text"), "query_id", idf=False)
    text = plan(R.sparse_topk(queries, weights, 5))
    assert "hashpartitioning(query_id" in text and text.count("hashpartitioning(query_id#") <= 2
    assert "hashpartitioning(query_id#" in text and ", doc_id#" not in text.split("Exchange hashpartitioning(query_id#", 1)[1].split(")")[0]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_search_keeps_queries_without_results(spark):
    queries = spark.createDataFrame([(1, 7, 0, "whale", [1.0, 0.0]), (2, 7, 1, "only masked", [0.0, 1.0]), (3, 8, 0, "none", [0.0, 0.0])], "query_id long, call_id long, query_pos int, query string, vector array<double>")
    docs = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0])], "doc_id long, vector array<double>")
    pages = spark.createDataFrame([(10, "Whales", "https://a/10", "the whale"), (11, "Masked", "https://m/11", "hidden")], "doc_id long, title string, link string, text string")
    masks = spark.createDataFrame([(2, "https://m/"), (2, "https://a/")], "query_id long, mask_url string")
    none = spark.createDataFrame([], "query_id long, term string, weight double")
    blocks = jobs.search(queries, docs, none, none.withColumnRenamed("query_id", "doc_id"), pages, masks, 1)
    calls = {r.call_id: r.text for r in jobs.search_calls(blocks).collect()}
    first, second = calls[7].split("\n\n=======\n\n")
    assert first == "A Google search for 'whale' found 1 results:\n\n## Web Results\n1. [Whales](https://a/10)\nthe whale"
    assert second == "A Google search for 'only masked' found 0 results:\n\n## Web Results"
    assert set(calls) == {7, 8}


def test_search_moves_no_page_without_a_hit(spark, tmp_path):
    """Ids of pages may be of another width than those of hits."""
    spark.range(2000).select(F.col("id").cast("int").alias("doc_id"), F.lit("T").alias("title"), F.concat(F.lit("https://a/"), F.col("id").cast("string")).alias("link"), F.repeat(F.lit("a long text "), 50).alias("text")).write.parquet(str(tmp_path / "pages"))
    queries = spark.createDataFrame([(1, 7, 0, "q", [1.0, 0.0])], "query_id long, call_id long, query_pos int, query string, vector array<double>")
    docs = spark.createDataFrame([(1003, [1.0, 0.0]), (5, [-1.0, 0.0])], "doc_id long, vector array<double>")
    none = spark.createDataFrame([], "query_id long, term string, weight double")
    masks = spark.createDataFrame([], "query_id long, mask_url string")
    blocks = jobs.search(queries, docs, none, none.withColumnRenamed("query_id", "doc_id"), spark.read.parquet(str(tmp_path / "pages")), masks, 1)
    assert "https://a/1003" in blocks.first()["block"]
    scans = [line for line in plan(blocks).splitlines() if "text#" in line and "Exchange" in line]
    assert "bit_get" in plan(blocks) and not scans


def test_masked_blocks(spark):
    from scoutmill.functions import tags as T

    block = "A Google search for 'q' found 2 results:\n\n## Web Results\n1. [One](https://a.example/x)\nfirst\n\n2. [Two](https://b.example/y)\nsecond"
    rows = spark.createDataFrame([(i, block, m) for i, m in enumerate(["a.example", "b.example/y", "c.example", "", None, "example"])], "i int, block string, mask string")
    got = [r[0] for r in rows.orderBy("i").select(T.mask_block(F.lit("q"), F.col("block"), F.col("mask"))).collect()]
    head = "A Google search for 'q' found {} results:\n\n## Web Results"
    assert got[0] == head.format(1) + "\n1. [Two](https://b.example/y)\nsecond" and got[1] == head.format(1) + "\n1. [One](https://a.example/x)\nfirst"
    assert got[2] == got[3] == got[4] == block and got[5] == head.format(0)
    assert spark.range(1).select(T.render_call(F.array().cast("array<string>"))).first()[0] == "No results found."
