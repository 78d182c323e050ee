"""The end-to-end jobs and page-history operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutmill.catalog.base import query
from scoutmill.catalog.group_queries import batch_rows
from scoutmill.catalog.table_queries import cell_index, item_queries, sparse_index, sparse_queries
from scoutmill.functions import tags as T
from scoutmill.functions.html import html_basic_text
from scoutmill.functions.text import render_prompt
from scoutmill.operators import qa as Q
from scoutmill.operators import revisions as R
from scoutmill.operators.advantages import advantages
from scoutmill.operators.corpus import length_band
from scoutmill.plans import jobs


def history_pages(t):
    """Pages as revision histories: three items, the last one repeating an oldid."""
    n = F.col("page_id").cast("string")
    item = lambda old, time: F.concat(F.lit('<li><a class="mw-changeslist-date" href="/w/index.php?title=P'), n, F.lit("&amp;oldid="), old,
                                      F.lit(f'">{time}</a><a class="mw-userlink">Ann</a><span class="comment">(edit)</span></li>'))
    one = item(n, "04:17, 27 July 2005")
    return t.pages.select("page_id", "url", F.concat(F.lit('<ul id="pagehistory">'), one, item(F.concat(n, F.lit("7")), "05:00, 28 July 2005"), one, F.lit("</ul>"), "html").alias("html"))


@query("extract_revisions", """SELECT url AS source_history_url, p AS position, 'https://en.wikipedia.org/w/index.php?title=P' || CAST(page_id AS VARCHAR) || '&oldid=' || CAST(page_id AS VARCHAR) || CASE p WHEN 0 THEN '' ELSE '7' END AS revision_url,
 CASE p WHEN 0 THEN '04:17, 27 July 2005' ELSE '05:00, 28 July 2005' END AS timestamp_text, 'Ann' AS editor FROM pages, (SELECT unnest([0, 1]) AS p)""", longs=("position",))
def _(t):
    rows = R.extract_revisions(history_pages(t), key="page_id")
    return rows.select("source_history_url", F.col("position").cast("long").alias("position"), "revision_url", "timestamp_text", "editor")


@query("middle_revisions", """SELECT url AS source_history_url, CAST(page_id AS VARCHAR) || '7' AS oldid FROM pages""")
def _(t):
    return R.middle_revisions(R.extract_revisions(history_pages(t), key="page_id"), "page_id").select("source_history_url", "oldid")


@query("revision_summary", """SELECT count(DISTINCT url) AS pages, count(DISTINCT url) AS pages_with_revisions, 2 * count(DISTINCT url) AS revisions, 2.0::DOUBLE AS mean_revisions FROM pages""")
def _(t):
    pages = history_pages(t)
    return R.revision_summary(R.extract_revisions(pages, key="page_id"), pages, key="page_id")


@query("extend_rows", """SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, 'copy' FROM documents""")
def _(t):
    return Q.extend_rows(t.documents.select("doc_id", "lang"), lambda df: df.withColumn("lang", F.lit("copy")))


@query("advantage_by_name", """SELECT event_id AS row_id, round(value * 100) - avg(round(value * 100)) OVER (PARTITION BY user_id) AS advantage FROM events""")
def _(t):
    return advantages(t.rollouts, "grpo", normalise=False).select("row_id", "advantage")


def item_calls(t):
    """Benchmark items as queries, four to a call, with the vector that goes by the item's id."""
    text = t.benchmark.select(F.col("item_id").alias("query_id"), F.expr("item_id div 4").alias("call_id"), (F.col("item_id") % 4).alias("query_pos"), F.col("text").alias("query"))
    return text.join(item_queries(t), "query_id")


def searched(t):
    pages = t.documents.select("doc_id", F.col("source").alias("title"), F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("link"), "text")
    masks = t.benchmark.select(F.col("item_id").alias("query_id"), F.lit("src1.").alias("mask_url"))
    return jobs.search(item_calls(t), cell_index(t, cells=8), sparse_queries(t), sparse_index(t), pages, masks, 10)


@query("search_blocks")
def _(t):
    """Hybrid search of all benchmark items over stored indexes, masked, deduplicated and rendered."""
    return searched(t)


@query("search_call_queries", """SELECT item_id // 4 AS call_id, count(*) AS blocks, 0 AS masked FROM benchmark JOIN embeddings ON vec_id = item_id GROUP BY 1""", longs=("call_id", "blocks", "masked"))
def _(t):
    """Each call's answer holds a block per query, with or without results, and no masked link."""
    text = F.col("text")
    return jobs.search_calls(searched(t)).select("call_id", F.size(F.split(text, "\n\n=======\n\n")).cast("long").alias("blocks"), F.regexp_count(text, F.lit(r"\(https://src1\.")).cast("long").alias("masked"))


@query("mask_block", """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS n, 'A Google search for ''q'' found ' || CASE WHEN role = 'user' THEN '1' ELSE '2' END || ' results:' AS head FROM conversations""", longs=("n",))
def _(t):
    """Rendered blocks of two results, the second one's link masked in user turns."""
    results = F.array(F.struct(F.lit("a").alias("title"), F.lit("https://x.example/1").alias("link"), F.lit("s").alias("snippet")),
                      F.struct(F.col("role").alias("title"), F.lit("https://y.example/2").alias("link"), F.regexp_replace("text", r"[\[\]]", "").alias("snippet")))
    masked = T.mask_block(F.lit("q"), T.render_results(F.lit("q"), results), F.when(F.col("role") == "user", "y.example"))
    return t.turns.select("conv_id", "turn", F.size(T.parse_search_block(masked)).cast("long").alias("n"), F.split(masked, "\n")[0].alias("head"))


@query("corpus_build")
def _(t):
    rows = t.documents.select("doc_id", F.concat(F.lit("https://"), "source", F.lit("/"), F.md5("text")).alias("url"), F.col("source").alias("title"), "text")
    return jobs.corpus_build(rows, lambda texts: [[float(len(x)), float(x.count(" "))] for x in texts], 2, ["doc_id"])


@query("qa_synthesis", r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<\s*script[^>]*>.*?<\s*/\s*script\s*>', ' ', 'g'), '(?is)<\s*style[^>]*>.*?<\s*/\s*style\s*>', ' ', 'g'), '(?is)<\s*noscript[^>]*>.*?<\s*/\s*noscript\s*>', ' ', 'g'), '(?is)<\s*iframe[^>]*>.*?<\s*/\s*iframe\s*>', ' ', 'g') AS x FROM pages),
 b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g'), '<[^>]+>', ' ', 'g') AS x FROM a),
 c AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS x FROM b),
 d AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t\r\f\x0B]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS x FROM c)
SELECT url, 'How long is ' || url || '?' AS question, 'qqzz' AS answer, 'positive' AS result FROM d WHERE length(x) >= 100""")
def _(t):
    """Pages to labelled QA rows with a deterministic generator in the model's place."""

    def reply(prompts):
        return ['{"qa_pairs": [{"question": "How long is ' + p.split("\n", 1)[0] + '?", "answer": "qqzz"}]}' for p in prompts]

    store = t.pages.select(F.col("url").alias("key"), F.concat("url", F.lit("\n"), html_basic_text(F.col("html"))).alias("html"))
    texts = length_band(t.pages.select("url", html_basic_text(F.col("html")).alias("markdown")), "markdown")
    prompts = texts.select("url", render_prompt("{url}\n{text}", url=F.col("url"), text=F.col("markdown")).alias("prompt"))
    rows = jobs.qa_rows(prompts, reply, store.select(F.col("key").alias("url"), F.col("html").alias("markdown")))
    # A question is labelled once; each page of its URL has it.
    return texts.select("url").join(rows.select("url", "question", "answer", "result"), "url")


@query("rollout_step", """SELECT event_id AS row_id, round(value * 100) - avg(round(value * 100)) OVER (PARTITION BY user_id) AS advantage FROM events""")
def _(t):
    """Advantages of a step's rollouts; its metrics are the ``batch_metrics`` query."""
    rows, _ = jobs.rollout_step(batch_rows(t), F.col("score"), "grpo", {"normalise": False}, max_response=8000, max_prompt=1000)
    return rows.select("row_id", "advantage")
