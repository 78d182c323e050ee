"""The four end-to-end jobs over Spark frames; numbering and kept tables run jobs while a plan is built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutmill.functions.html import html_basic_text
from scoutmill.functions.tags import parse_qa_json, render_call, render_results
from scoutmill.functions.text import clean_text, snippet
from scoutmill.functions.urls import url_hash
from scoutmill.operators import advantages, metrics
from scoutmill.operators.corpus import length_band, prepare_documents
from scoutmill.operators.dedup import dedup_across_queries, dedup_first, dedup_last, dedup_questions
from scoutmill.operators.joins import answer_leaks, lookup_pages, mask_results, url_exists
from scoutmill.operators.qa import generate, short_answers
from scoutmill.operators.reshape import explode_pairs
from scoutmill.operators.retrieval import embed, hybrid_search
from scoutmill.operators.wanted import only_wanted
from scoutmill.session import keep


def corpus_build(rows: DataFrame, embedder: Callable, dim: int, order: list[str]) -> DataFrame:
    """Corpus rows to load-ready documents with vectors: clean, prepare, last row per URL, embed."""
    clean = rows.withColumns({c: clean_text(c) for c in ("url", "title", "text")})
    documents = prepare_documents(dedup_last(clean, ["url"], order))
    vectors = embed(documents, "url", "embedding_text", embedder, dim)
    return documents.join(vectors, "url")


def page_text_rows(urls: DataFrame, store: DataFrame, corpus: DataFrame, least: int = 100, most: int = 30_000, unescape=None) -> DataFrame:
    """Requested pages as text: look up, strip tags, band by length, drop copies, flag those already in the corpus."""
    found = lookup_pages(urls, store).filter(F.col("html").isNotNull())
    text = html_basic_text(F.col("html"), unescape) if unescape else html_basic_text(F.col("html"))
    banded = length_band(found.select("url", clean_text(text).alias("text")), "text", least, most)
    first = dedup_first(banded.withColumn("url_hash", url_hash(F.col("url"))), ["text"], ["url"])
    return url_exists(first, corpus)


def search(queries: DataFrame, docs, query_weights: DataFrame, doc_weights, pages: DataFrame, masks: DataFrame, k: int) -> DataFrame:
    """Hybrid top-k, masked, repeats dropped across the queries of a call, rendered per query: (call_id, query_pos, query_id, block).

    ``queries`` is (query_id, call_id, query_pos, query, vector); ``pages`` is (doc_id, title, link, text); ``docs`` and
    ``doc_weights`` are tables or stored indexes. A query whose results are all gone keeps a block of 0 results.
    """
    hits = keep(hybrid_search(queries, docs, query_weights, doc_weights, k))
    asked = queries.select("query_id", "call_id", "query_pos", "query")
    # Pages without a hit stay in their scan, and of the others' texts only the snippets leave it.
    found = only_wanted(pages, hits, "doc_id", of=F.col("doc_id").cast("long")).select("doc_id", "title", "link", snippet("text").alias("snippet"))
    ranked = hits.join(asked, "query_id").join(found, "doc_id")
    visible = mask_results(ranked, masks)
    # Hits per query are at most k, so rank and lists per query are small.
    kept = dedup_across_queries(visible.withColumn("rank", -F.col("score")), "call_id", "query_pos", "rank", "link")
    row = F.struct((-F.col("score")).alias("rank"), F.col("doc_id"), "title", "link", "snippet")
    results = kept.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("results"))
    blocks = asked.join(results, "query_id", "left").withColumn("results", F.coalesce("results", F.array().cast(results.schema["results"].dataType)))
    return blocks.select("call_id", "query_pos", "query_id", render_results(F.col("query"), F.col("results")).alias("block"))


def search_calls(blocks: DataFrame) -> DataFrame:
    """(call_id, text): the blocks of each call's queries in order, as one answer. A call holds few queries."""
    ordered = F.sort_array(F.collect_list(F.struct("query_pos", "block")))
    return blocks.groupBy("call_id").agg(render_call(F.transform(ordered, lambda b: b["block"])).alias("text"))


def qa_synthesis(urls: DataFrame, store: DataFrame, write_prompt: Callable, generator: Callable, pages: DataFrame) -> DataFrame:
    """Pages to labelled QA pairs: look up, text, prompt, generate, then ``qa_rows``."""
    found = lookup_pages(urls, store).filter(F.col("html").isNotNull())
    texts = length_band(found.select("url", html_basic_text(F.col("html")).alias("markdown")), "markdown")
    return qa_rows(texts.select("url", write_prompt(F.col("markdown")).alias("prompt")), generator, pages)


def qa_rows(prompts: DataFrame, generator: Callable, pages: DataFrame) -> DataFrame:
    """Prompts (url, prompt) to labelled QA pairs: generate, parse, one row per question, short answers, leak check."""
    replies = generate(prompts, "prompt", generator)
    # Kept, so that each prompt reaches the generator once however often the pairs are read.
    pairs = keep(explode_pairs(replies.select("url", parse_qa_json(F.col("reply")).alias("qa_pairs"))))
    unique = dedup_questions(pairs, ["url", "pair_no"])
    return answer_leaks(short_answers(unique), pages)


def rollout_step(rollouts: DataFrame, score: Column, estimator: str, options: dict | None = None, **batch) -> tuple[DataFrame, DataFrame]:
    """Rollouts of a step with score and advantage, and the step's metrics."""
    scored = rollouts.withColumn("score", score)
    return advantages.advantages(scored, estimator, **(options or {})), metrics.batch_metrics(scored, **batch)
