"""Prompt tables for training and evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutmill.operators.ordering import number_rows


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def tools_kwargs(url: Column) -> Column:
    """The masked URL in the place where each tool looks for it."""
    create = F.struct(F.struct(url.alias("url")).alias("create_kwargs"))
    return F.struct(create.alias("search"), create.alias("browse"))


def build_prompt_rows(df: DataFrame, question: str, answer: Column, order: Sequence[str], data_source: str, ability: str,
                      split: str, system_prompt: str | None = None, prefix: str = "", need_tools: bool = False, style: str = "rule") -> DataFrame:
    """Rows (question, data_source, prompt, ability, reward_model, extra_info), numbered from 0 in ``order``."""
    numbered = number_rows(df, order, "_i")
    messages = [message("system", F.lit(system_prompt))] if system_prompt else []
    messages.append(message("user", F.concat(F.lit(prefix), F.col(question))))
    return numbered.select(
        F.col(question).alias("question"),
        F.lit(data_source).alias("data_source"),
        F.array(*messages).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.struct(answer.alias("target")).alias("ground_truth"), F.lit(style).alias("style")).alias("reward_model"),
        F.struct((F.col("_i") - 1).cast("string").alias("index"), F.lit(split).alias("split"), F.lit(need_tools).alias("need_tools_kwargs"),
                 F.col(question).alias("question")).alias("extra_info"),
    )


def normalize_ground_truth(truth: Column) -> Column:
    """Plain text, a JSON object with ``target`` (list or string), or anything else, as {target: [..]}."""
    listed = F.from_json(truth, "target array<string>")["target"]
    single = F.from_json(truth, "target string")["target"]
    is_object = truth.rlike(r"^\s*\{") & single.isNotNull()
    return F.struct(F.when(is_object & listed.isNotNull(), listed).when(is_object, F.array(single)).otherwise(F.array(F.coalesce(truth, F.lit("")))).alias("target"))


def attach_tool_kwargs(df: DataFrame, system_prompt: str) -> DataFrame:
    """Rows with the tool arguments, a system message, and a user message that starts with `` Question:``.

    Reads question, prompt array<struct<role,content>>, ground_truth string and
    extra_info struct<index,mask_url,url,split>.
    """
    e = "extra_info"
    url = F.coalesce(F.nullif(F.col(f"{e}.mask_url"), F.lit("")), F.nullif(F.col(f"{e}.url"), F.lit("")), F.lit(""))
    asked = message("user", F.concat(F.lit(" Question: "), F.coalesce("question", F.lit(""))))
    has_system = F.exists("prompt", lambda m: m["role"] == "system")
    second = F.get("prompt", F.lit(1))["content"]
    patched = F.transform("prompt", lambda m, i: F.when((i == 1) & ~F.coalesce(second, F.lit("")).startswith(" Question:"), asked).otherwise(
        F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    fresh = F.array(message("system", F.lit(system_prompt)), asked)
    return df.select(
        "question",
        "data_source",
        F.when(has_system, patched).otherwise(fresh).alias("prompt"),
        "ability",
        F.struct(normalize_ground_truth(F.col("ground_truth")).alias("ground_truth"), F.lit("llm").alias("style")).alias("reward_model"),
        F.struct(
            F.coalesce(F.col(f"{e}.index").cast("string"), F.lit("0")).alias("index"), url.alias("mask_url"),
            F.coalesce("question", F.lit("")).alias("question"), F.coalesce(F.col(f"{e}.split"), F.lit("train")).alias("split"),
            F.lit(True).alias("need_tools_kwargs"), tools_kwargs(url).alias("tools_kwargs"),
        ).alias(e),
    )


def with_nested(df: DataFrame, extra: str, additions: dict[str, Column]) -> DataFrame:
    """Add fields to a nested struct column; fields already there stay."""
    present = set(df.schema[extra].dataType.fieldNames())
    out = F.col(extra)
    for name, value in additions.items():
        if name not in present:
            out = out.withField(name, value)
    return df.withColumn(extra, out)


def first_truth(*fields: Column) -> Column:
    """First non-empty of several ground-truth fields, else ''."""
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in fields], F.lit(""))


def append_completion(df: DataFrame, system_prompt: str, prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """System message in front, the completion as the assistant's last message."""
    return df.withColumn(prompt, F.concat(F.array(message("system", F.lit(system_prompt))), F.col(prompt), F.array(message("assistant", F.col(completion)))))


def label_messages(messages: Column) -> Column:
    """1 for messages to train on: the given loss_mask, else the assistant's."""
    return F.transform(messages, lambda m: F.coalesce(m["loss_mask"], F.when(m["role"] == "assistant", 1).otherwise(0)))


def validate_prompt_table(df: DataFrame) -> DataFrame:
    """Rows failing each check, over the whole table; absent columns are errors at plan time."""
    needed = ["question", "data_source", "prompt", "ability", "reward_model", "extra_info"]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    p = F.col("prompt")
    nested = {"ground_truth": "reward_model.ground_truth", "index": "extra_info.index", "split": "extra_info.split"}
    checks = {
        "bad_prompt": (F.size(p) != 2) | (F.get(p, F.lit(0))["role"] != "system") | (F.get(p, F.lit(1))["role"] != "user"),
        **{f"no_{k}": F.col(path).isNull() for k, path in nested.items()},
        **{f"null_{c}": F.col(c).isNull() for c in needed},
    }
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in checks.items()])


LETTERS = "ABCD"


def multi_choice_prompt(df: DataFrame, question: str, gold: str, others: Sequence[str], seed: int = 42) -> DataFrame:
    """Options in a seeded order per row, the letter of the right one, and the question with its options."""
    options = F.array(*[F.struct(F.md5(F.concat(F.lit(f"{seed}:{i}:"), F.coalesce(F.col(question), F.lit("")))).alias("k"), F.lit(i).alias("i"), F.col(c).alias("v"))
                        for i, c in enumerate([gold, *others])])
    shuffled = df.withColumn("_o", F.sort_array(options))
    at = F.array_position(F.transform("_o", lambda o: o["i"]), F.lit(0))
    lines = F.transform("_o", lambda o, i: F.concat(F.substr(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(") "), o["v"]))
    return shuffled.withColumn("gold_letter", F.substr(F.lit(LETTERS), at.cast("int"), F.lit(1))).withColumn(
        "query", F.concat(F.col(question), F.lit("\n\n"), F.array_join(lines, "\n"))).drop("_o")
