"""Registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutmill.llm.labelled import fold_of
from scoutmill.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its function's name."""
    QUERIES[fn.__name__] = fn
    return fn


def with_fold(scored: DataFrame, folds: int, held: int) -> DataFrame:
    """Held-out mark and prediction beside a score."""
    return scored.select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), *[c for c in scored.columns if c not in ("doc_id", "score")])


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoutmill.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 5) != 0)
    return with_fold(toxicity.score(docs, model, ["doc_id"]), 5, 0)


@query
def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoutmill.llm import compression_quality

    docs = table(spark, sf_dir, "documents")
    model = compression_quality.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 3) != 1)
    return with_fold(compression_quality.score(docs, model, ["doc_id"]), 3, 1)


@query
def op3_edit_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoutmill.llm.edit_decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoutmill.llm.chosen_path import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


@query
def op5_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoutmill.llm.pii_sanitise import KINDS, sanitise, written

    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    rows = sanitise(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *[count(k) for k in range(4)], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from scoutmill.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoutmill.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


@query
def op8_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoutmill.llm.html_density import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoutmill.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoutmill.llm.quality_rules import judge_documents

    judged = judge_documents(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.drop("clean_text")


@query
def op11_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoutmill.llm.budget_mix import mix

    return mix(table(spark, sf_dir, "documents"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoutmill.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoutmill.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


SQL["op12_collocations"] = r"""
WITH texts AS (
 SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM texts),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (
 SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
 FROM places CROSS JOIN (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS p, unnest(range(1, k)) AS c FROM grams WHERE k > 1),
scored AS (
 SELECT c.lang, c.phrase, c.k, c.c, c.a, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
 FROM cuts c JOIN totals t ON t.lang = c.lang
 JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.p[1:c.c], ' ')
 JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.p[c.c + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
shown AS (
 SELECT * FROM lowest s WHERE NOT EXISTS (
  SELECT 1 FROM grams x WHERE x.lang = s.lang AND x.k > s.k AND 100 * x.f >= 100 * s.a AND contains(' ' || x.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM shown QUALIFY rank <= 2000
"""
