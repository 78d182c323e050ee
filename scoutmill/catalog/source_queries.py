"""Readers, sinks and streams over the driver tables: what is written in a source's form is read back through the reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutmill.catalog.base import query
from scoutmill.sources import readers, sinks
from scoutmill.session import kept_path
from scoutmill.streaming import streams as S


def lines(t, rows, folder=""):
    """Path of one JSON line per row, below ``folder`` of a new path."""
    path = kept_path(t.spark)
    rows.write.json(path + folder)
    return path


@query("read_qa_files", """SELECT item_id, 'https://q.example/' || item_id AS url, p AS pair_no, CASE p WHEN 0 THEN 'What is ' || item_id || '?' ELSE 'And then?' END AS question, CASE p WHEN 0 THEN text ELSE 'a' END AS answer FROM benchmark, (SELECT unnest([0, 1]) AS p)""", ints=("pair_no",))
def _(t):
    """One file per item with two whole pairs and one without an answer."""
    pair = lambda q, a: F.struct(q.alias("question"), a.alias("answer"))
    number = F.col("item_id").cast("string")
    pairs = F.array(pair(F.concat(F.lit("What is "), number, F.lit("?")), F.col("text")), pair(F.lit("And then?"), F.lit("a")), pair(F.lit("No answer"), F.lit(None).cast("string")))
    rows = t.benchmark.select(F.concat(F.lit("https://q.example/"), number).alias("url"), pairs.alias("qa_pairs"), "item_id")
    path = kept_path(t.spark)
    rows.withColumn("part", F.col("item_id")).drop("item_id").repartition("part").write.partitionBy("part").option("maxRecordsPerFile", 1).json(path)
    return readers.read_qa_files(t.spark, path).select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("item_id"), "url", "pair_no", "question", "answer")


@query("read_news", """SELECT '# ' || source || chr(10) || chr(10) || 'Published: 2020-01-01' || repeat(chr(10), 4) || coalesce(text, '') AS markdown, true AS numbered FROM documents""")
def _(t):
    """News rows without description and link: empty parts stay, and the URL is made of the row's number."""
    news = t.documents.select(F.col("source").alias("title"), F.lit("2020-01-01").alias("published_date"), F.lit(None).cast("string").alias("description"),
                              F.col("text").alias("content"), F.lit(None).cast("string").alias("link"), F.col("n_chars").alias("other"))
    rows = readers.read_news(t.spark, t.stored(news))
    return rows.select("markdown", (F.col("url") == F.concat(F.lit("bbc:"), F.col("index").cast("string"))).alias("numbered"))


@query("read_prompt_tables", """SELECT item_id, text AS prompt, 'left' AS data_source, NULL::INTEGER AS extra FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, text, 'right', 7 FROM benchmark WHERE item_id % 2 = 1""")
def _(t):
    """Two tables of different columns and one that is missing."""
    base = kept_path(t.spark)
    rows = t.benchmark.select("item_id", F.col("text").alias("prompt"), F.lit("old").alias("data_source"))
    rows.filter("item_id % 2 = 0").write.parquet(f"{base}/left.parquet")
    rows.filter("item_id % 2 = 1").withColumn("extra", F.lit(7)).write.parquet(f"{base}/right.parquet")
    return readers.read_prompt_tables(t.spark, [f"{base}/left.parquet", f"{base}/none.parquet", f"{base}/right.parquet"]).select("item_id", "prompt", "data_source", "extra")


@query("rollouts_round_trip", """SELECT conv_id, turn, coalesce(text, '') AS output, CAST(turn AS INTEGER) AS step FROM conversations""", ints=("step",))
def _(t):
    """Samples dumped one line each by step, read back as JSON lines."""
    rows = t.turns.select(F.col("turn").cast("int").alias("step"), F.struct("conv_id", "turn").alias("extra_info"), F.col("text").alias("output"))
    path = kept_path(t.spark)
    sinks.write_rollouts(rows, path)
    back = t.spark.read.schema("extra_info struct<conv_id:long,turn:long>, output string, step int").json(path)
    return back.select("extra_info.conv_id", "extra_info.turn", F.coalesce("output", F.lit("")).alias("output"), "step")


@query("read_url_list_json", """SELECT url FROM pages WHERE page_id % 4 < 3""")
def _(t):
    """A list of objects, an object with strings, an object with objects, and entries without a URL."""
    urls = t.pages.select("page_id", "url")
    of = lambda k, name: urls.filter(f"page_id % 4 = {k}").select(F.struct(F.col("url").alias(name)).alias("o"), "url")
    plain = of(0, "url").agg(F.to_json(F.collect_list("o")).alias("value"))  # a list of one source file
    strings = of(1, "url").agg(F.to_json(F.struct(F.collect_list("url").alias("links"))).alias("value"))
    objects = of(2, "link").agg(F.to_json(F.struct(F.collect_list("o").alias("results"))).alias("value"))
    empty = urls.filter("page_id % 4 = 3").agg(F.to_json(F.collect_list(F.struct(F.lit("").alias("url")))).alias("value"))
    out = None
    for rows in (plain, strings, objects, empty):
        found = readers.read_url_list(t.spark, t.stored(rows.coalesce(1), "text"))
        out = found if out is None else out.unionByName(found)
    return out


@query("read_questions_lines", r"""SELECT question, answer FROM (SELECT CASE WHEN item_id % 2 = 0 THEN 'Q ' || item_id ELSE 'M ' || item_id END AS question, CAST(item_id AS VARCHAR) AS answer FROM benchmark)""")
def _(t):
    """Question files as lines: half with a question, half with it in the first user message."""
    number = F.col("item_id").cast("string")
    message = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("System: be brief\nUser: M "), number).alias("content")))
    even = F.col("item_id") % 2 == 0
    path = lines(t, t.benchmark.select(F.when(even, F.concat(F.lit("Q "), number)).alias("question"), number.alias("answer"), message.alias("messages")), "/questions.jsonl")
    return readers.read_questions(t.spark, path + "/questions.jsonl")


@query("write_labelled", """SELECT doc_id, CASE WHEN lang = 'en' THEN 'positive' ELSE 'negative' END AS label FROM documents""")
def _(t):
    path = kept_path(t.spark)
    sinks.write_labelled(t.documents.select("doc_id", "lang"), path, F.when(F.col("lang") == "en", "positive").otherwise("negative"))
    return t.spark.read.schema("doc_id long, label string").json(path)


@query("write_parts", """SELECT count(*) AS n, true AS capped FROM documents""")
def _(t):
    """Rows in all part files, and whether each file keeps the bound."""
    path = kept_path(t.spark)
    sinks.write_parts(t.documents.select("doc_id", "lang"), path, 40)
    per = t.spark.read.schema("doc_id long").json(path).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n"), (F.max("n") <= 40).alias("capped"))


@query("write_with_sample", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT doc_id, source FROM n WHERE r = 1""")
def _(t):
    """The JSON sample beside a table: the first row of each source."""
    path = kept_path(t.spark)
    sinks.write_with_sample(t.documents.select("doc_id", "source"), f"{path}/table", f"{path}/sample", 0, ["doc_id"], "per_source", "source")
    return t.spark.read.schema("doc_id long, source string").json(f"{path}/sample")


@query("save_modes", """SELECT doc_id FROM documents WHERE doc_id % 3 > 0""")
def _(t):
    """Created, replaced, then appended to."""
    path, ids = kept_path(t.spark), t.documents.select("doc_id")
    sinks.save(ids.filter("doc_id % 3 = 0"), path, "create")
    sinks.save(ids.filter("doc_id % 3 = 1"), path, "overwrite")
    sinks.save(ids.filter("doc_id % 3 = 2"), path, "append")
    return t.spark.read.schema("doc_id long").parquet(path)


@query("upsert_log", """WITH l AS (SELECT doc_id % 50 AS k, doc_id, text FROM documents WHERE text <> ''), b AS (SELECT k, doc_id % 4 AS batch, max(text) AS text FROM l GROUP BY 1, 2) SELECT 'u' || k AS url, arg_max(text, batch) AS text FROM b GROUP BY k""")
def _(t):
    """Micro-batches of upserts, merged by levels in between: the latest batch of a key wins, in it the greatest text."""
    path, schema = kept_path(t.spark), "url string, title string, text string"
    rows = t.documents.filter("text <> ''").select(F.concat(F.lit("u"), (F.col("doc_id") % 50).cast("string")).alias("url"), F.lit("").alias("title"), "text", (F.col("doc_id") % 4).alias("b"))
    for i in range(4):
        S.append_upserts(rows.filter(F.col("b") == i).drop("b"), i, path)
        S.compact(t.spark, path, schema, fanout=2)
    return S.current_table(t.spark, path, schema).select("url", "text")


@query("cache_misses", """SELECT DISTINCT url FROM pages WHERE page_id % 3 = 0""")
def _(t):
    return S.cache_misses(t.pages.select("url"), t.pages.filter("page_id % 3 > 0").select("url"))


@query("progress_windows", """SELECT count(*) AS samples, avg(CAST(event_type <> 'error' AS INT)) AS success_share FROM events""")
def _(t):
    """Windows of an hour, merged again into one row; the quantiles are sketches and tested against exact ones."""
    rows = t.events.select("ts", F.col("value").alias("seconds"), F.when(F.col("event_type") != "error", "done").otherwise("stalled").alias("state"), F.lit(1).alias("tool_calls"))
    return S.merge_progress(S.progress_stats(rows, "1 hour")).select("samples", F.round("success_share", 9).alias("success_share"))
