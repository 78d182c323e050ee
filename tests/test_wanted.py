"""Page look-ups: results, and what never leaves the scan."""

import pytest
from pyspark.sql import functions as F

from scoutmill.functions.urls import legacy_key
from scoutmill.operators import joins as J
from scoutmill.operators.wanted import only_wanted


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_wanted_keeps_all_that_are_asked_for(spark):
    table = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "id")
    keys = table.filter("id % 400 = 7").select("key").unionByName(spark.createDataFrame([(None,), ("absent",)], "key string"))
    kept = {r["id"] for r in only_wanted(table, keys, "key", bits=1 << 14).collect()}
    assert {i for i in range(20_000) if i % 400 == 7} <= kept and len(kept) < 100
    assert only_wanted(table, keys.filter("false"), "key", bits=1 << 14).count() == 0


def store_of(spark, tmp_path):
    long = F.concat(F.lit("<p>page "), F.col("id").cast("string"), F.lit("</p>"))
    pages = spark.range(3000).select(F.concat(F.lit("https://a.example/wiki/P"), F.col("id").cast("string")).alias("key"), long.alias("html"))
    old = spark.range(3000, 3100).select(legacy_key(F.concat(F.lit("https://a.example/wiki/P"), F.col("id").cast("string"))).alias("key"), long.alias("html"))
    pages.unionByName(old).write.parquet(str(tmp_path / "store"))
    return spark.read.parquet(str(tmp_path / "store"))


def test_look_up_by_both_keys_in_one_scan(spark, tmp_path):
    store = store_of(spark, tmp_path)
    urls = spark.createDataFrame([(f"https://a.example/wiki/P{i}",) for i in (5, 5, 3001, 9999)] + [(None,)], "url string")
    found = J.lookup_pages(urls, store)
    assert sorted((r["url"] or "", r["html"], r["matched_by"]) for r in found.collect()) == [
        ("", None, None), ("https://a.example/wiki/P3001", "<p>page 3001</p>", "legacy"), ("https://a.example/wiki/P5", "<p>page 5</p>", "url"),
        ("https://a.example/wiki/P5", "<p>page 5</p>", "url"), ("https://a.example/wiki/P9999", None, None)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(J.lookup_pages(urls, store))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("FileScan parquet [key") == 1
    assert "bit_get(Subquery" in text.split("SortMergeJoin", 2)[-1] and "bit_get(Subquery" in text.rsplit("FileScan parquet [key", 1)[0]


def test_a_direct_page_wins_over_a_legacy_one(spark):
    url = "https://a.example/wiki/Both"
    store = spark.createDataFrame([(url, "new")], "key string, html string").unionByName(spark.range(1).select(legacy_key(F.lit(url)).alias("key"), F.lit("old").alias("html")))
    urls = spark.createDataFrame([(url, 1)], "url string, n int")
    row = J.lookup_pages(urls, store).first()
    assert (row["html"], row["matched_by"], row["n"]) == ("new", "url", 1)


@pytest.mark.parametrize("call", ["exists", "fulltext", "leaks"])
def test_pages_nobody_asks_for_are_not_shuffled(spark, tmp_path, call):
    spark.range(5000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit("the answer is blue").alias("markdown")).write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    urls = spark.createDataFrame([("u3", "what", "blue"), ("nowhere", "what", "red")], "url string, question string, answer string")
    out = {"exists": lambda: J.url_exists(urls, pages), "fulltext": lambda: J.fulltext_by_url(urls, pages), "leaks": lambda: J.answer_leaks(urls, pages)}[call]()
    rows = {r["url"]: r for r in out.collect()}
    if call == "exists":
        assert rows["u3"]["exists"] and not rows["nowhere"]["exists"]
    elif call == "fulltext":
        assert set(rows) == {"u3"}
    else:
        assert (rows["u3"]["reason"], rows["nowhere"]["reason"]) == ("answer_found", "no_page")
    assert "bit_get" in plan(out)


def test_a_url_with_several_pages_gives_each_item_one_label(spark):
    qa = spark.createDataFrame([(1, "u", "what is it", "blue whale"), (2, "u", "what is it", "red fox"), (3, "u", "what is it", "blue whale"), (4, None, "q", "blue whale")],
                               "id int, url string, question string, answer string")
    pages = spark.createDataFrame([("u", "A blue whale swam."), ("u", "Nothing here."), ("u", "Nothing here."), ("u", None)], "url string, markdown string")
    got = sorted((r["id"], r["result"], r["reason"]) for r in J.answer_leaks(qa, pages).collect())
    assert got == [(1, "negative", "answer_found"), (2, "positive", "answer_not_found"), (3, "negative", "answer_found"), (4, "positive", "no_revision_url")]


def test_the_shortest_titles_and_pages_without_a_url_are_labelled_as_by_sql(spark, tmp_path):
    """Odd pages: titles of up to three characters, of marks or blanks, none at all; no URL; no text."""
    from compare import compare, duck

    from scoutmill.catalog import QUERIES, SQL

    titles = ["to.", " ", "*", "a-b", "4", "12", "", "Long title", "\u00e9", "&amp;"]
    rows = [(n, None if n % 3 == 0 else f"u{n % 14}", f"<html><title>{t}</title><p>text {n}</p>") for n, t in enumerate(titles * 4)]
    rows += [(100, "u1", None), (101, None, None), (102, "u2", "<p>no title</p>"), (103, "u2", ""), (None, "u3", "<title>x</title>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages"))
    (tmp_path / "pages.parquet").write_bytes(next((tmp_path / "pages").glob("*.parquet")).read_bytes())
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    assert compare(con, spark, QUERIES["answer_leaks"], SQL["answer_leaks"], str(tmp_path)) is None


def test_an_answer_of_few_letters_leaks_only_where_asked_for(spark):
    qa = spark.createDataFrame([(1, "u", "what", "to."), (2, "u", "what", "zz")], "id int, url string, question string, answer string")
    pages = spark.createDataFrame([("u", "Up to. Here.")], "url string, markdown string")
    label = lambda **how: sorted((r["id"], r["result"]) for r in J.answer_leaks(qa, pages, **how).collect())
    assert label() == [(1, "positive"), (2, "positive")] and label(verbatim=True) == [(1, "negative"), (2, "positive")]
