"""Tool calls and page visits of rollouts as rows, and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutmill.functions.tags import CALL, browse_error, classify_response, tag_events, tool_calls
from scoutmill.functions.text import let
from scoutmill.functions.urls import host


def call_rows(df: DataFrame, output: str = "output", pattern: str = CALL) -> DataFrame:
    """One row per tool call, with its position and its queries or URLs."""
    return df.select(
        *[c for c in df.columns if c != output], F.posexplode(tool_calls(F.col(output), pattern)).alias("call_pos", "c")
    ).select("*", "c.name", "c.values", "c.bad_json").drop("c")


def tool_call_counts(df: DataFrame, by: list[str], output: str = "output") -> DataFrame:
    """Calls, queries and URLs per group; unreadable payloads are counted apart."""
    n = lambda name: F.col("name") == name
    calls = call_rows(df, output)
    return calls.groupBy(*by).agg(
        F.count_if(n("search")).alias("search_calls"),
        F.sum(F.when(n("search"), F.size("values")).otherwise(0)).alias("search_queries"),
        F.count_if(n("visit")).alias("visit_calls"),
        F.sum(F.when(n("visit"), F.size("values")).otherwise(0)).alias("visit_urls"),
        F.count_if("bad_json").alias("bad_json"),
    )


def visit_rows(df: DataFrame, output: str = "output") -> DataFrame:
    """Visited URLs with the class of the first response that follows their call.

    Calls and responses of one output are one array; the response of a call is
    the first later response in it, found inside the row.
    """
    events = df.withColumn("_e", tag_events(F.col(output)))
    responses = F.filter("_e", lambda e: e["kind"] == "response")
    calls = events.select(*[c for c in df.columns if c != output], responses.alias("_r"),
                          F.explode(F.filter("_e", lambda e: e["kind"] == "call")).alias("_c"))
    later = F.filter("_r", lambda r: r["pos"] > F.col("_c.pos"))
    parsed = tool_calls(F.concat(F.lit("<tool_call>"), F.col("_c.body"), F.lit("</tool_call>")))
    urls = F.flatten(F.transform(parsed, lambda p: F.when(p["name"] == "visit", p["values"]).otherwise(F.array().cast("array<string>"))))
    visits = calls.select("*", F.get(later, F.lit(0))["body"].alias("response"), F.explode(urls).alias("url"))
    return visits.withColumn("category", classify_response(F.col("response"))).drop("_r", "_c")


def visit_url_stats(visits: DataFrame, step: str = "step", category: str = "category", origin: str | None = None) -> DataFrame:
    """URL classes per step with a grand total (null step)."""
    c = F.col(category)
    valid = ~c.isin("connect_fail", "no_response")
    aggs = [F.count(F.lit(1)).alias("total_urls")]
    aggs += [F.count_if(c == k).alias(k) for k in ("connect_fail", "browse_success", "browse_fail", "no_response")]
    aggs.append(F.count_if(valid).alias("valid_urls"))
    if origin:
        o = F.col(origin)
        for kind in ("real", "fabricated"):
            aggs.append(F.count_if(o == kind).alias(kind))
            for end in ("success", "fail"):
                aggs.append(F.count_if((o == kind) & (c == f"browse_{end}")).alias(f"{kind}_{end}"))
        aggs.append(F.try_divide(F.count_if(o == "fabricated"), F.count_if(valid)).alias("fabricated_ratio"))
    return visits.rollup(step).agg(*aggs)


def visit_outcomes(df: DataFrame, reason: Column, correct: Column, success: str) -> DataFrame:
    """Outcomes by reason, split by correctness, with each reason's share."""
    table = df.groupBy(reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("n_correct"), F.count_if(~correct).alias("n_incorrect"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return table.withColumn("share", F.col("n") / total).withColumn("is_success", F.col("reason") == success)


MARK_BLOCK = 256


def browse_error_rows(df: DataFrame, output: str = "output", context: int = 50) -> DataFrame:
    """Lines that mention a visit, with the first error keyword of the next lines and the turn they are in.

    Turn marks are counted once per block of lines and summed over the blocks,
    so a hit adds up the rest of its own block only.
    """
    lines = F.split(output, "\n")
    marks = F.transform(lines, lambda x: F.when(F.ltrim(x).startswith("assistant") | F.contains(x, F.lit("<answer>")), 1).otherwise(0))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def located(s: Column) -> Column:
        return let(F.struct(s["lines"].alias("lines"), s["marks"].alias("marks"), F.transform(
            F.sequence(F.lit(0), F.floor((F.size(s["lines"]) - 1) / MARK_BLOCK).cast("int")), lambda b: total(F.slice(s["marks"], b * MARK_BLOCK + 1, F.lit(MARK_BLOCK)))).alias("blocks")), before)

    def before(s: Column) -> Column:
        sums = F.transform(s["blocks"], lambda x, b: total(F.slice(s["blocks"], F.lit(1), b)))
        return let(F.struct(s["lines"].alias("lines"), s["marks"].alias("marks"), sums.alias("before")), hits)

    def hits(s: Column) -> Column:
        picked = F.filter(F.sequence(F.lit(1), F.size(s["lines"])), lambda i: F.contains(F.element_at(s["lines"], i), F.lit("visit")))
        block = lambda i: F.floor((i - 1) / MARK_BLOCK).cast("int")
        return F.transform(picked, lambda i: F.struct(
            i.alias("line"), browse_error(F.array_join(F.slice(s["lines"], i, F.lit(context)), "\n")).alias("error"),
            (F.get(s["before"], block(i)) + total(F.slice(s["marks"], block(i) * MARK_BLOCK + 1, i - 1 - block(i) * MARK_BLOCK))).alias("turn")))

    rows = let(F.struct(lines.alias("lines"), marks.alias("marks")), located)
    out = df.select(*[c for c in df.columns if c != output], F.explode(rows).alias("r")).select("*", "r.*").drop("r")
    return out.filter(F.col("error").isNotNull())


def trajectory_stats(steps: DataFrame, key: str) -> DataFrame:
    """Searches, visits, distinct domains, think turns and characters per trajectory.

    ``steps`` is long: one row per step with ``type``, ``think`` and
    ``tool_calls`` (array of {name, urls}).
    """
    calls = steps.select(key, F.explode("tool_calls").alias("c"))
    per_call = calls.groupBy(key).agg(F.count_if(F.col("c.name") == "search").alias("searches"), F.count_if(F.col("c.name") == "visit").alias("visits"))
    hosts = calls.filter(F.col("c.name") == "visit").select(key, F.explode("c.urls").alias("u")).groupBy(key).agg(
        F.countDistinct(host(F.col("u"))).alias("domains"))
    thought = F.length(F.coalesce("think", F.lit("")))
    base = steps.groupBy(key).agg(F.count_if(thought > 0).alias("think_turns"), F.sum(thought).alias("think_chars"))
    out = base.join(per_call, key, "left").join(hosts, key, "left")
    return out.fillna(0, ["searches", "visits", "domains"])
