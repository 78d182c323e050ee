"""Lookups, resume joins, masks and fan-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutmill.functions.numbers import answer_in_text
from scoutmill.functions.urls import legacy_key, revision_to_current, store_key
from scoutmill.operators.dedup import dedup_last
from scoutmill.operators.groups import join_on, top_rows
from scoutmill.operators.ordering import ordered
from scoutmill.operators.wanted import only_wanted


def lookup_pages(urls: DataFrame, store: DataFrame, url: str = "url", key: str = "key") -> DataFrame:
    """Stored page of each URL by its full key, else by the legacy last-segment key.

    One scan of the store and one join: both keys of a URL are asked for, pages
    that no key may ask for stay in the scan, and the better key wins.
    """
    forms = F.array(F.struct(F.lit(1).alias("rank"), store_key(F.col(url)).alias("_k")), F.struct(F.lit(2).alias("rank"), store_key(legacy_key(F.col(url))).alias("_k")))
    asked = urls.withColumn("_f", F.explode(forms)).select(*urls.columns, F.col("_f.rank").alias("_rank"), F.col("_f._k").alias("_k"))
    pages = only_wanted(store.withColumnRenamed(key, "stored_key"), asked, "_k", of=store_key(F.col("stored_key"))).withColumn("_k", store_key(F.col("stored_key")))
    joined = asked.join(pages, "_k", "left")
    hit = F.col("stored_key").isNotNull()
    first = F.rank().over(Window.partitionBy(url).orderBy(F.when(hit, F.col("_rank")).otherwise(F.col("_rank") + 2)))
    best = joined.withColumn("_first", first).filter("_first = 1")
    matched = F.when(hit, F.when(F.col("_rank") == 1, "url").otherwise("legacy"))
    return best.select(*urls.columns, *[c for c in pages.columns if c != "_k"], matched.alias("matched_by"))


def attach_revision(qa: DataFrame, index: DataFrame, order: Sequence[str]) -> DataFrame:
    """Revision URL of each question; later index rows overwrite earlier ones; a reason where none is found."""
    latest = dedup_last(index, ["question"], order).select("question", "revision_url")
    joined = join_on(qa, latest, ["question"])
    return joined.withColumn("reason", F.when(F.col("revision_url").isNull(), "no_revision_url"))


def url_exists(urls: DataFrame, corpus: DataFrame, url: str = "url") -> DataFrame:
    """Requested URLs with a flag: is it in the corpus?"""
    known = only_wanted(corpus.select(url), urls, url).distinct().withColumn("_hit", F.lit(True))
    return urls.join(known, url, "left").withColumn("exists", F.coalesce("_hit", F.lit(False))).drop("_hit")


def fulltext_by_url(urls: DataFrame, docs: DataFrame, url: str = "url", limit: int | None = None) -> DataFrame:
    """Documents of the requested URLs, hits only; the single form passes limit 1."""
    hits = only_wanted(docs, urls, url).join(urls.select(url).distinct(), url, "left_semi")
    return hits if limit is None else hits.limit(limit)


def fabricated_urls(visits: DataFrame, corpus: DataFrame, url: str = "url", outcome: str = "category") -> DataFrame:
    """Visits with ``real`` or ``fabricated`` where the visit reached a backend."""
    flagged = url_exists(visits, corpus, url)
    reached = ~F.col(outcome).isin("connect_fail", "no_response")
    label = F.when(reached & F.col("exists"), "real").when(reached, "fabricated")
    return flagged.withColumn("origin", label).drop("exists")


def resume(df: DataFrame, done: DataFrame, keys: Sequence[str], failed: Column | None = None) -> DataFrame:
    """Work not done yet; done rows with an error count as open."""
    finished = done if failed is None else done.filter(~F.coalesce(failed, F.lit(False)))
    return df.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def priority_files(listing: DataFrame, embedded: DataFrame, stored: DataFrame, key: str = "file") -> DataFrame:
    """Listed files that are embedded but not stored."""
    return listing.join(embedded.select(key), key, "left_semi").join(stored.select(key), key, "left_anti")


def mask_results(results: DataFrame, masks: DataFrame, key: str = "query_id", link: str = "link", mask: str = "mask_url") -> DataFrame:
    """Drop results whose link contains a masked URL of their query."""
    hit = F.contains(results[link], masks[mask]) & (masks[mask] != "")
    return results.join(masks, results[key].eqNullSafe(masks[key]) & hit, "left_anti")


def exclude_patterns(df: DataFrame, col: str, patterns: Sequence[str]) -> DataFrame:
    """Drop rows whose column matches any of the regular expressions."""
    return df.filter(~F.coalesce(F.col(col).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)))


def answer_leaks(qa: DataFrame, pages: DataFrame, url: str = "url", text: str = "markdown", verbatim: bool = False) -> DataFrame:
    """QA rows with ``result``: negative when the current page gives the answer away, else positive with a reason.

    Each row comes back once, however many pages its URL has: it is negative
    when any of them gives the answer away. Each different item meets each
    different text of its URL once, so copies of pages or items cost nothing.
    ``verbatim``: an answer that a page holds letter by letter is given away
    however short it is; ``answer_in_text`` alone passes over the shortest.
    """
    keys = [url, "question", "answer"]
    texts = only_wanted(pages.select(url, F.col(text).alias("_text")), qa, url).filter(F.col("_text").isNotNull()).distinct()
    leak = answer_in_text(F.col("answer"), F.col("_text"), F.col("question"))
    leak = F.contains(F.col("_text"), F.col("answer")) | leak if verbatim else leak
    checked = qa.select(*keys).distinct().join(texts, url).groupBy(*keys).agg(F.bool_or(leak).alias("_leaked"))
    joined = join_on(qa, checked, keys)
    reason = (
        F.when((F.coalesce("question", F.lit("")) == "") | (F.coalesce("answer", F.lit("")) == ""), "empty")
        .when(F.col(url).isNull(), "no_revision_url")
        .when(F.col("_leaked").isNull(), "no_page")
        .when(F.col("_leaked"), "answer_found")
        .otherwise("answer_not_found")
    )
    labelled = joined.withColumn("reason", reason).filter(F.col("reason") != "empty")
    return labelled.withColumn("result", F.when(F.col("reason") == "answer_found", "negative").otherwise("positive")).drop("_leaked")


def current_page_leaks(qa: DataFrame, index: DataFrame, pages: DataFrame, order: Sequence[str]) -> DataFrame:
    """Leak check against the current page of the article each question was built from."""
    located = attach_revision(qa, index, order).drop("reason")
    return answer_leaks(located.withColumn("url", revision_to_current(F.col("revision_url"))), pages)


def pair_calls_with_responses(events: DataFrame, key: str, pos: str, kind: str = "kind", body: str = "body") -> DataFrame:
    """Calls with the first response after them; one response may serve several calls."""
    response = F.when(F.col(kind) == "response", F.struct(F.col(pos).alias("pos"), F.col(body).alias("body")))
    paired = ordered(events, [pos], [key], small_groups=True).following(response, "_r").result()
    return paired.filter(F.col(kind) == "call").withColumn("response", F.col("_r.body")).withColumn(
        "response_pos", F.col("_r.pos")).drop("_r")


def pair_adjacent(messages: DataFrame, key: str, pos: str, is_call: Column, is_response: Column, body: str) -> DataFrame:
    """Calls whose very next message is the response; null where it is not."""
    near = F.struct(is_response.alias("ok"), F.col(body).alias("body"))
    paired = ordered(messages, [pos], [key], small_groups=True).next(near, "_r").result()
    return paired.filter(is_call).withColumn("response", F.when(F.col("_r.ok"), F.col("_r.body"))).drop("_r")


def union_columns(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    """Columns of two tables over the same rows; shared columns must agree."""
    shared = [c for c in b.columns if c in a.columns and c != row_id]
    right = b
    for c in shared:
        right = right.withColumnRenamed(c, f"_b_{c}")
    joined = a.join(right, row_id)
    for c in shared:
        check = F.when(F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.col(c)).otherwise(
            F.raise_error(F.lit(f"column {c} differs between the two tables")).cast(a.schema[c].dataType))
        joined = joined.withColumn(c, check).drop(f"_b_{c}")
    return joined


def fan_out(questions: DataFrame, k: int, slots: int, key: str, done: DataFrame | None = None, failed: Column | None = None) -> DataFrame:
    """Each question k times, minus finished pairs, with a round-robin worker slot."""
    tasks = questions.withColumn("rollout_idx", F.explode(F.sequence(F.lit(1), F.lit(k))))
    if done is not None:
        tasks = resume(tasks, done, [key, "rollout_idx"], failed)
    numbered = ordered(tasks, [key, "rollout_idx"]).row_number("_i").result()
    return numbered.withColumn("slot", F.pmod(F.col("_i") - 1, F.lit(slots)).cast("int")).drop("_i")


def fuse(sparse_hits: DataFrame, dense_hits: DataFrame, k: int, sparse_weight: float = 0.7, dense_weight: float = 1.0) -> DataFrame:
    """Weighted sum of two hit lists (query_id, doc_id, score); a missing leg counts 0; top k per query."""
    s = sparse_hits.select("query_id", "doc_id", F.col("score").alias("sparse_score"))
    d = dense_hits.select("query_id", "doc_id", F.col("score").alias("dense_score"))
    both = s.join(d, ["query_id", "doc_id"], "full_outer")
    total = sparse_weight * F.coalesce("sparse_score", F.lit(0.0)) + dense_weight * F.coalesce("dense_score", F.lit(0.0))
    return top_rows(both.withColumn("score", F.round(total, 9)), ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)
