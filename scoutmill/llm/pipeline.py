"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the documents it keeps, or packed pieces at the end.

Defined cases, for every stage: a null text counts as empty (line dedup leaves
it null); a null ``doc_id`` is an id like any other and is kept or dropped by
its own text; a document is its id and its text, so an id that stands with two
texts is two documents; rows that repeat both are copies, of which the near
duplicate stage keeps one; of rows equal in both but in no other column, which
one stays is not fixed; ties go to the least id, then to the least hash of the
text; an empty table gives an empty result; further columns are carried through
to the last stage, which returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutmill.llm import chosen_path, compression_quality, edit_decontaminate, line_dedup, packing
from scoutmill.llm.labelled import fold_of
from scoutmill.llm.queries import table
from scoutmill.session import configure, keep


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores 0.5 or more; scored beside the text, so nothing is shuffled."""
    model = compression_quality.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 3) != 1)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    scored = compression_quality.score(docs.select(others.alias("row"), "text"), model, ["row", "text"])
    return scored.where("score >= 0.5").select(*[F.col(c if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line repeats; ``n_chars`` follows the text."""
    cleaned = line_dedup.dedup_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies: the one with the least id, and of its repeats one row.

    Documents that line dedup left without any text are copies of each other.
    Only ids and hashes of texts say who goes; documents that stand once and
    stay are not shuffled for it.
    """
    rows = keep(chosen_path.text_classes(docs))
    named = rows.groupBy("root", "doc_id", "id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("first")
    leaders = named.groupBy("root").agg(first).select("root", F.col("first.doc_id").alias("leader"), F.col("first.id").alias("leader_text"))
    leads = F.col("doc_id").eqNullSafe(F.col("leader")) & (F.col("id") == F.col("leader_text"))
    marked = keep(named.join(leaders, "root").select("doc_id", "id", leads.alias("leads"), "n").where(~F.col("leads") | (F.col("n") > 1)))
    texts = docs.withColumn("_text", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    same = lambda m: F.col("d.doc_id").eqNullSafe(F.col(f"{m}.doc_id")) & (F.col("d._text") == F.col(f"{m}.id"))
    single = texts.alias("d").join(marked.alias("m"), same("m"), "left_anti")
    repeated = texts.alias("d").join(marked.where("leads").alias("r"), same("r"), "left_semi").dropDuplicates(["doc_id", "_text"])
    return single.unionByName(repeated).drop("_text")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return edit_decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is kept as a table and read back."""
    docs = table(configure(spark), sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = keep(docs)
    return docs
