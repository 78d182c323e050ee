"""Corpus rows from raw records to load-ready documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutmill.functions import text as X
from scoutmill.operators.groups import top_rows


def normalize_search_results(df: DataFrame, text_field: str = "content", fallback_snippet: bool = True, dedup: bool = False,
                             min_chars: int = 1, order: str = "line_no") -> DataFrame:
    """Flat search results to corpus rows (id, url, title, text); short texts go, repeats too if asked.

    The repeat key is the URL, or the first 200 characters of the text where there is none.
    """
    text = F.coalesce(F.col(text_field), F.lit(""))
    if fallback_snippet:
        text = F.when(X.strip(text) == "", F.coalesce("snippet", F.lit(""))).otherwise(text)
    link = F.coalesce(F.nullif("link", F.lit("")), F.nullif("url", F.lit("")), F.lit("")) if "url" in df.columns else F.coalesce("link", F.lit(""))
    rows = df.select(order, link.alias("url"), F.coalesce("title", F.lit("")).alias("title"), text.alias("text"))
    rows = rows.filter(F.length(X.strip("text")) >= min_chars)
    if dedup:
        keyed = rows.withColumn("_key", F.when(F.col("url") != "", F.col("url")).otherwise(F.substring("text", 1, 200)))
        rows = top_rows(keyed, ["_key"], [F.col(order)]).drop("_key")
    doc_id = F.when(F.col("url") != "", F.col("url")).otherwise(F.concat(F.lit("doc_"), F.col(order).cast("string")))
    return rows.select(order, doc_id.alias("id"), "url", "title", "text")


def length_band(df: DataFrame, col: str, least: int = 100, most: int = 30_000, marker: str = "\n\n[content truncated]") -> DataFrame:
    """Drop rows shorter than ``least``; cut longer ones to ``most`` and mark the cut."""
    return df.filter(F.length(col) >= least).withColumn(col, X.cut_with_marker(col, most, marker))


def prepare_documents(df: DataFrame, url: str = "url", title: str = "title", text: str = "text", by_tokens: bool = True) -> DataFrame:
    """Add capped url and title, the stored head of the text, and the text to embed."""
    short_title = X.safe_truncate(title, X.TITLE_MAX_CHARS)
    full = F.concat(F.lit("Title: "), short_title, F.lit("\n\nContent: "), F.coalesce(F.col(text), F.lit("")))
    cut = F.when(X.token_count(full) > X.EMBEDDING_MAX_TOKENS, X.truncate_tokens(full, X.EMBEDDING_CUT_TOKENS)).otherwise(full)
    head = X.truncate_tokens(text, X.STORED_DOC_TOKENS) if by_tokens else F.substring(text, 1, X.STORED_DOC_CHARS)
    return (
        df.withColumn("embedding_text", cut)
        .withColumn("doc", head)
        .withColumn("title_cut", F.length(title) > X.TITLE_MAX_CHARS)
        .withColumn("url_cut", F.length(url) > X.URL_MAX_CHARS)
        .withColumn(title, short_title)
        .withColumn(url, X.safe_truncate(url, X.URL_MAX_CHARS))
    )


def enforce_caps(df: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Hard cut of each column at its cap."""
    return df.withColumns({c: F.substring(c, 1, n) for c, n in caps.items()})


def cap_violations(df: DataFrame, caps: dict[str, int]) -> DataFrame:
    """How many values are above each cap."""
    return df.agg(*[F.count_if(F.length(c) > n).alias(f"{c}_over") for c, n in caps.items()])


def filter_overlong(df: DataFrame, col: str, most: int, counter=X.token_count) -> DataFrame:
    """Keep rows of at most ``most`` tokens."""
    return df.filter(counter(F.col(col)) <= most)


def mask_strings(df: DataFrame, pattern: str, mask: str = "***") -> DataFrame:
    """Mask a pattern in string columns and show every other column as JSON."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        kind = field.dataType.typeName()
        if kind == "string":
            out.append(F.regexp_replace(c, pattern, mask).alias(field.name))
        elif kind in ("struct", "array", "map"):
            out.append(F.to_json(c).alias(field.name))
        else:
            out.append(c.cast("string").alias(field.name))
    return df.select(*out)


def temporal_context(stamp: Column) -> Column:
    """Date of a page version plus one day, as ``28 July 2005``; null when the text is no date."""
    text = X.strip(stamp)
    # The time of day does not matter; the date part is parsed alone.
    date = F.regexp_replace(text, r"^[0-9]{1,2}:[0-9]{2}, ", "")
    return F.date_format(F.date_add(F.try_to_timestamp(date, F.lit("d MMMM yyyy")).cast("date"), 1), "dd MMMM yyyy")
