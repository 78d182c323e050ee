"""Tags, scores, prompts and message structure over conversations; tables in wrapped form where text holds no tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutmill.catalog.base import query
from scoutmill.functions import scoring as S
from scoutmill.functions import tags as T
from scoutmill.functions.text import lower_first, token_count
from scoutmill.operators import corpus as C
from scoutmill.operators import joins as J
from scoutmill.operators import metrics as M
from scoutmill.operators import prompts as P
from scoutmill.operators import qa as Q
from scoutmill.operators import reshape as R
from scoutmill.operators import visits as V
from scoutmill.operators.ordering import number_rows
from scoutmill.sources.readers import question_of

WS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
STRIP = rf"^[{WS}]+|[{WS}]+$"
TOK = r"[\p{L}\p{N}_]+|[^\s\x0B\x1C-\x1F\x85\p{Z}\p{L}\p{N}_]"
PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"

def norm_sql(x: str) -> str:
    """Answer normalisation; articles go in two passes because RE2 has no look-around."""
    article = r"regexp_replace({}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)($|[^\p{{L}}\p{{N}}_])', '\1 \3', 'g')"
    bare = f"translate(lower({x}), '{PUNCT}', '')"
    return f"trim(regexp_replace({article.format(article.format(bare))}, '[{WS}]+', ' ', 'g'), ' ')"


@query("extract_answer", rf"""SELECT conv_id, turn, regexp_replace(text, '{STRIP}', '', 'g') AS answer FROM conversations""")
def _(t):
    out = F.concat(F.lit("<answer>first</answer> then <answer> "), "text", F.lit("\n</answer> end"))
    return t.turns.select("conv_id", "turn", T.extract_tag(out, "answer").alias("answer"))


@query("prediction", r"""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text ELSE 'No answer found.' END AS p FROM conversations""")
def _(t):
    out = F.when(F.col("role") == "assistant", F.concat(F.lit("x <answer>"), "text", F.lit("</answer>"))).otherwise(F.col("text"))
    return t.turns.select("conv_id", "turn", T.prediction(out).alias("p"))


@query("parse_tool_calls", """SELECT conv_id, turn, 0 AS call_pos, CASE WHEN role = 'user' THEN 'search' ELSE 'visit' END AS name, CASE WHEN role = 'user' THEN 2 ELSE 1 END AS n_values, false AS bad_json FROM conversations
 UNION ALL SELECT conv_id, turn, 1, NULL, 0, true FROM conversations""", longs=("call_pos", "n_values"))
def _(t):
    text = F.regexp_replace(F.regexp_replace("text", r"[\\\"{}]", ""), r"[\x00-\x1f]", " ")
    call = F.when(F.col("role") == "user", F.concat(F.lit('<tool_call>\n{"name": "search", "arguments": {"query": ["'), text, F.lit('", "b"]}}\n</tool_call>'))).otherwise(
        F.concat(F.lit('<tool_call>{"name": "visit", "arguments": {"url": "'), text, F.lit('"}}</tool_call>')))
    rows = V.call_rows(t.turns.select("conv_id", "turn", F.concat(call, F.lit("<tool_call>{oops}</tool_call>")).alias("output")))
    return rows.select("conv_id", "turn", F.col("call_pos").cast("long").alias("call_pos"), "name", F.size("values").cast("long").alias("n_values"), "bad_json")


@query("pair_calls_with_responses", """SELECT conv_id, turn AS pos, (SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.role = 'assistant') AS response_pos FROM conversations a WHERE role <> 'assistant'""")
def _(t):
    events = t.turns.select("conv_id", F.col("turn").alias("pos"), F.when(F.col("role") == "assistant", "response").otherwise("call").alias("kind"), F.col("text").alias("body"))
    return J.pair_calls_with_responses(events, "conv_id", "pos").select("conv_id", "pos", "response_pos")


@query("pair_adjacent", """SELECT conv_id, turn, CASE WHEN nr = 'assistant' THEN nt END AS response FROM (SELECT conv_id, turn, role, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""")
def _(t):
    r = J.pair_adjacent(t.turns, "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant", "text")
    return r.select("conv_id", "turn", "response")


@query("renumber", """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations""")
def _(t):
    return number_rows(t.turns, ["turn"], "n", keys=["conv_id"], small_groups=True).select("conv_id", "turn", "n")


@query("message_blocks", """WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn > 1 THEN 'tool' WHEN role = 'system' AND turn > 0 THEN 'user' WHEN turn % 4 = 3 THEN 'tool' ELSE role END AS role, text FROM conversations),
 c AS (SELECT *, CASE WHEN role = 'tool' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'tool' THEN 0 ELSE 1 END AS s FROM m), b AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM c)
SELECT conv_id, CAST(block AS BIGINT) AS block, arg_min(role, turn) AS role, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars, min(turn) AS first FROM b GROUP BY conv_id, block""")
def _(t):
    role = F.when((F.col("role") == "user") & (F.col("turn") > 1), "tool").when((F.col("role") == "system") & (F.col("turn") > 0), "user").when(F.col("turn") % 4 == 3, "tool").otherwise(F.col("role"))
    return R.message_blocks(t.turns.withColumn("role", role), "conv_id", "turn", "role", "text")


@query("label_messages", """SELECT conv_id, turn, CASE WHEN turn = 0 THEN 1 WHEN role = 'assistant' THEN 1 ELSE 0 END AS label FROM conversations""", longs=("label",))
def _(t):
    messages = F.array(F.struct("role", F.col("text").alias("content"), F.when(F.col("turn") == 0, 1).alias("loss_mask")))
    return t.turns.select("conv_id", "turn", F.get(P.label_messages(messages), F.lit(0)).cast("long").alias("label"))


@query("sample_status", rf"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'no_answer' WHEN role = 'assistant' THEN 'normal' WHEN regexp_replace(text, '{STRIP}', '', 'g') = '' THEN 'normal' ELSE 'truncated' END AS status FROM conversations""")
def _(t):
    out = F.when(F.col("role") == "user", F.col("text")).when(F.col("role") == "assistant", F.concat("text", F.lit("<answer>a</answer>\n"))).otherwise(F.concat(F.lit("<answer>a</answer>"), "text"))
    return t.turns.select("conv_id", "turn", T.sample_status(out).alias("status"))


@query("short_answers", """SELECT conv_id, turn, text AS answer FROM conversations WHERE length(text) <= 120""")
def _(t):
    return Q.short_answers(t.turns.select("conv_id", "turn", F.col("text").alias("answer")), 120)


@query("format_qa", """SELECT 'direct_information_seeking_datagen' AS source, CAST(conv_id AS VARCHAR) AS url, text AS question, role AS answer, CASE WHEN turn > 2 THEN role END AS another_answer FROM conversations""")
def _(t):
    return Q.format_qa(t.turns.select(F.col("conv_id").cast("string").alias("url"), F.col("text").alias("question"), F.col("role").alias("answer"), F.when(F.col("turn") > 2, F.col("role")).alias("another_answer")))


@query("classify_items", """SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'no_revision_url' WHEN turn % 5 = 1 THEN 'fetch_failed' WHEN length(text) % 2 = 0 THEN 'answer_found' ELSE 'answer_not_found' END AS reason,
 CASE WHEN turn > 0 AND turn % 5 <> 1 AND length(text) % 2 = 0 THEN 'negative' ELSE 'positive' END AS result FROM conversations WHERE trim(text) <> '' AND role <> 'system'""")
def _(t):
    items = t.turns.select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("role") != "system", F.col("role")).alias("answer"), F.when(F.col("turn") > 0, "u").alias("revision_url"), F.length("text").alias("n"))
    return Q.classify_items(items, F.col("n") % 2 == 0, F.col("turn") % 5 != 1).select("conv_id", "turn", "reason", "result")


@query("normalize_answer", f"""SELECT conv_id, turn, {norm_sql('text')} AS answer FROM conversations""")
def _(t):
    return t.turns.select("conv_id", "turn", S.normalize_answer(F.col("text")).alias("answer"))


@query("exact_match", r"""SELECT conv_id, turn, role <> 'user' AS em, true AS sub FROM conversations""")
def _(t):
    said = F.concat(F.lit("The "), F.upper("role"), F.lit("!"))
    targets = F.array(F.lit("nobody"), F.when(F.col("role") == "user", F.lit("user ... and more")).otherwise(F.col("role")))
    return t.turns.select("conv_id", "turn", S.exact_match(said, targets).alias("em"), S.sub_exact_match(F.concat(said, F.lit(" and more")), targets).alias("sub"))


@query("score_em", r"""SELECT conv_id, turn, CASE WHEN turn = 0 THEN 0.0 WHEN role = 'assistant' AND turn > 4 THEN 0.25 WHEN role = 'assistant' THEN 1.0 ELSE 0.1 END::DOUBLE AS score FROM conversations""")
def _(t):
    out = F.when(F.col("turn") == 0, F.col("text")).otherwise(F.concat("text", F.repeat(F.lit("<answer>x</answer>"), F.when(F.col("turn") > 4, 11).otherwise(1)), F.lit("<answer>An "), "role", F.lit("</answer>")))
    return t.turns.select("conv_id", "turn", S.score_em(out, F.array(F.lit("assistant")), 0.1).alias("score"))


@query("score_number", r"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 1.0 WHEN turn % 3 = 1 THEN 0.1 ELSE 0.0 END::DOUBLE AS strict, '1234' AS flexible FROM conversations""")
def _(t):
    out = F.concat("text", F.when(F.col("turn") % 3 == 0, F.lit(" #### 1,234")).when(F.col("turn") % 3 == 1, F.lit(" #### 99")).otherwise(F.lit(" none")))
    flexible = S.final_number(F.concat("text", F.lit(" it is 1234 . ")), "flexible")
    return t.turns.select("conv_id", "turn", S.score_number(out, F.lit("1234"), "strict", 0.1).alias("strict"), flexible.alias("flexible"))


@query("score_boxed", r"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS latex, CASE WHEN turn % 4 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS equal FROM conversations""")
def _(t):
    body = F.when(F.col("turn") % 4 == 0, F.lit("\\frac{1}{2}")).when(F.col("turn") % 4 == 2, F.lit("1/2")).otherwise(F.lit("3"))
    out = F.concat("text", F.lit(" \\boxed{9} so \\boxed{"), body, F.lit("}."))
    return t.turns.select("conv_id", "turn", S.score_boxed(out, F.lit("\\frac{1}{2}")).alias("latex"), S.score_boxed_equal(out, F.lit("\\frac{1}{2}")).alias("equal"))


@query("score_final_answer", r"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS score, CASE WHEN turn % 2 = 0 THEN '1200' ELSE '[INVALID]' END AS pred FROM conversations""")
def _(t):
    out = F.concat(F.regexp_replace("text", "(?i)answer", ""), F.when(F.col("turn") % 2 == 0, F.lit("\nAnswer: x = 1,200 dollars")).otherwise(F.lit("")))
    s = S.score_final_answer(out, F.lit("1200"))
    return t.turns.select("conv_id", "turn", s["score"].alias("score"), s["pred"].alias("pred"))


@query("score_choice", r"""SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM conversations""")
def _(t):
    out = F.concat(F.regexp_replace("text", "(?i)answer", ""), F.lit("\nanswer: "), F.substr(F.lit("ABCD"), (F.col("turn") % 4 + 1).cast("int"), F.lit(1)))
    return t.turns.select("conv_id", "turn", S.score_choice(out, F.lit("C")).alias("score"))


@query("format_reward", r"""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END::DOUBLE AS format, CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.9 END::DOUBLE AS mixed FROM conversations""")
def _(t):
    out = F.concat(F.when(F.col("role") == "assistant", F.lit("<think>")).otherwise(F.lit("")), "text", F.lit("</think> \\boxed{7} ok"))
    return t.turns.select("conv_id", "turn", S.format_reward(out).alias("format"), F.round(S.mixed_reward(out, F.lit("7")), 6).alias("mixed"))


@query("judge_route", r"""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'no_output' WHEN 1 THEN 'no_label' WHEN 2 THEN 'no_extraction' WHEN 3 THEN 'llm_judge' ELSE 'em_fallback' END AS method, turn % 5 >= 3 AND (turn % 5 = 4 OR role = 'assistant') AS correct FROM conversations""")
def _(t):
    k = F.col("turn") % 5
    out = F.when(k == 0, "").when(k == 2, F.col("text")).otherwise(F.concat("text", F.lit("<answer>Yes.</answer>")))
    targets = F.when(k != 1, F.array(F.lit("yes")))
    r = S.judge_route(out, targets, F.when(k == 3, F.col("role") == "assistant"))
    return t.turns.select("conv_id", "turn", r["method"].alias("method"), r["correct"].alias("correct"))


@query("parse_verdict", r"""SELECT conv_id, turn, turn % 3 <> 1 AS v, CASE WHEN role = 'assistant' THEN 'Correct' ELSE 'Incorrect' END AS j, role = 'assistant' AS w FROM conversations""")
def _(t):
    k = F.col("turn") % 3
    bare = F.regexp_replace("text", "(?i)true|false", "")
    text = F.when(k == 0, F.concat(bare, F.lit("\\boxed{True} false"))).when(k == 1, F.concat(F.lit("true\n"), bare, F.lit("\nIt is false"))).otherwise(F.concat(F.lit("false\n"), F.lit("so TRUE\n"), bare))
    word = F.when(F.col("role") == "assistant", "Correct").otherwise("Incorrect")
    return t.turns.select("conv_id", "turn", T.parse_verdict(text).alias("v"), T.parse_judgment(F.concat(F.lit('```json\n{"reasoning": "r", "judgment": "'), word, F.lit('"}\n```'))).alias("j"),
                          T.verdict_words(F.concat(F.lit("verdict: "), word)).alias("w"))


@query("lower_first", r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '^[A-Z]') THEN lower(substring(text, 1, 1)) || substring(text, 2) ELSE text END AS q FROM conversations""")
def _(t):
    return t.turns.select("conv_id", "turn", lower_first("text").alias("q"))


@query("strip_evidence", r"""SELECT conv_id, turn, 'Goal' || chr(10) || chr(10) || 'Summary: done' AS s FROM conversations""")
def _(t):
    text = F.concat(F.lit("Goal\nEvidence in page: \n"), F.regexp_replace("text", r"\n{2,}", "\n"), F.lit("\n\nSummary: done"))
    return t.turns.select("conv_id", "turn", T.strip_evidence(text).alias("s"))


@query("parse_messages", rf"""SELECT conv_id, turn, pos, CASE pos WHEN 0 THEN 'system' WHEN 1 THEN 'user' WHEN 2 THEN 'assistant' ELSE 'tool' END AS role FROM conversations, (SELECT unnest([0, 1, 2, 3]) AS pos)""", longs=("pos",))
def _(t):
    body = F.regexp_replace("text", r"(?m)^(system|user|assistant)\n", "x\n")
    script = F.concat(F.lit("system\nrules\nuser\n"), body, F.lit("\nassistant\n<tool_call>{}</tool_call>user\n<tool_response>ok</tool_response>"))
    rows = t.turns.select("conv_id", "turn", F.posexplode(T.parse_messages(script)).alias("pos", "m"))
    return rows.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "m.role")


@query("split_turns", rf"""SELECT conv_id, turn, 2 AS n, regexp_replace(text, '{STRIP}', '', 'g') AS answer FROM conversations""", longs=("n",))
def _(t):
    body = F.regexp_replace("text", "assistant\n", "")
    turns = T.split_turns(F.concat(F.lit("<think>plan</think>\nassistant\n<answer>"), body, F.lit("</answer>")))
    return t.turns.select("conv_id", "turn", F.size(turns).cast("long").alias("n"), F.get(turns, F.lit(1))["answer"].alias("answer"))


@query("search_block_round_trip", rf"""SELECT conv_id, turn, 2 AS n, regexp_replace(regexp_replace(text, '[\[\]]', '', 'g'), '{STRIP}', '', 'g') AS snippet, role AS title FROM conversations""", longs=("n",))
def _(t):
    text = F.regexp_replace("text", r"[\[\]]", "")
    results = F.array(F.struct(F.lit("a").alias("title"), F.lit("https://x.example/1").alias("link"), F.lit("s").alias("snippet")),
                      F.struct(F.col("role").alias("title"), F.lit("https://x.example/2").alias("link"), text.alias("snippet")))
    parsed = T.parse_search_block(T.render_results(F.lit("q"), results))
    second = F.get(parsed, F.lit(1))
    return t.turns.select("conv_id", "turn", F.size(parsed).cast("long").alias("n"), second["snippet"].alias("snippet"), second["title"].alias("title"))


@query("parse_qa_json")
def _(t):
    text = F.regexp_replace(F.regexp_replace("text", r'[\\"{}\[\]`]', ""), r"[\x00-\x1f]", " ")
    reply = F.concat(F.lit('Sure:\n```json\n{"qa_pairs": [{"question": "'), text, F.lit('", "answer": "a"}], "total_pairs": 1}\n```'))
    rows = t.turns.select("conv_id", "turn", T.parse_qa_json(reply).alias("qa_pairs"))
    return R.explode_pairs(rows)


@query("parse_tagged_sft")
def _(t):
    text = F.concat(F.lit("look <code>```python\nprint(1)\n```</code><interpreter>1</interpreter><answer>"), "text", F.lit("</answer>"))
    return t.turns.select("conv_id", "turn", F.posexplode(T.parse_tagged_sft(text)).alias("pos", "m")).select("conv_id", "turn", "pos", "m.*")


@query("read_questions", rf"""SELECT conv_id, turn, CASE WHEN regexp_replace(text, '{STRIP}', '', 'g') = '' THEN NULL ELSE regexp_replace(text, '{STRIP}', '', 'g') END AS question FROM conversations""")
def _(t):
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit("x").alias("content")), F.struct(F.lit("user").alias("role"), F.concat(F.lit("System: y User: "), "text").alias("content")))
    return t.turns.select("conv_id", "turn", question_of(F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(""), messages).alias("question"))


@query("build_prompt_rows", """SELECT text AS question, 'conv' AS data_source, 2 AS n_messages, ' Question: ' || text AS content, CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS VARCHAR) AS index, role AS target, 'train' AS split FROM conversations""", longs=("n_messages",))
def _(t):
    rows = P.build_prompt_rows(t.turns, "text", F.array("role"), ["conv_id", "turn"], "conv", "search", "train", "Be brief.", " Question: ", True)
    return rows.select("question", "data_source", F.size("prompt").cast("long").alias("n_messages"), F.get("prompt", F.lit(1))["content"].alias("content"),
                       F.col("extra_info.index").alias("index"), F.get("reward_model.ground_truth.target", F.lit(0)).alias("target"), F.col("extra_info.split").alias("split"))


def prompt_source(t):
    """Conversations as raw prompt rows, with and without a system message."""
    user = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    system = F.struct(F.lit("system").alias("role"), F.lit("old rules").alias("content"))
    info = F.struct(F.col("turn").alias("index"), F.when(F.col("turn") % 2 == 0, F.lit("https://m.example")).otherwise("").alias("mask_url"), F.lit("https://u.example").alias("url"), F.lit(None).cast("string").alias("split"))
    return t.turns.select("conv_id", F.col("text").alias("question"), F.lit("conv").alias("data_source"), F.when(F.col("turn") % 2 == 0, F.array(user)).otherwise(F.array(system, user)).alias("prompt"),
                          F.lit("search").alias("ability"), F.when(F.col("role") == "user", F.lit('{"target": ["x", "y"]}')).otherwise(F.col("role")).alias("ground_truth"), info.alias("extra_info"))


@query("attach_tool_kwargs", """SELECT text AS question, CASE WHEN turn % 2 = 0 THEN 'https://m.example' ELSE 'https://u.example' END AS url, CAST(turn AS VARCHAR) AS index, 'train' AS split, CASE WHEN turn % 2 = 0 THEN 'New rules.' ELSE 'old rules' END AS system,
 CASE WHEN turn % 2 = 1 AND starts_with(text, ' Question:') THEN text ELSE ' Question: ' || text END AS content, CASE WHEN role = 'user' THEN 'x|y' ELSE role END AS target FROM conversations""")
def _(t):
    r = P.attach_tool_kwargs(prompt_source(t), "New rules.")
    return r.select("question", F.col("extra_info.tools_kwargs.search.create_kwargs.url").alias("url"), F.col("extra_info.index").alias("index"), F.col("extra_info.split").alias("split"),
                    F.get("prompt", F.lit(0))["content"].alias("system"), F.get("prompt", F.lit(1))["content"].alias("content"), F.array_join("reward_model.ground_truth.target", "|").alias("target"))


@query("validate_prompt_table", """SELECT count(*) AS n_rows, 0 AS bad_prompt, 0 AS no_ground_truth, 0 AS no_index, 0 AS no_split, 0 AS null_question, 0 AS null_data_source, 0 AS null_prompt, 0 AS null_ability, 0 AS null_reward_model, 0 AS null_extra_info FROM conversations""", longs=("bad_prompt", "no_ground_truth", "no_index", "no_split", "null_question", "null_data_source", "null_prompt", "null_ability", "null_reward_model", "null_extra_info"))
def _(t):
    return P.validate_prompt_table(P.attach_tool_kwargs(prompt_source(t), "New rules."))


@query("with_nested", """SELECT conv_id, turn, 'kept' AS split, 'https://m.example/' || CAST(conv_id AS VARCHAR) AS url, CASE WHEN turn % 3 = 0 THEN role ELSE text END AS truth, 3 AS n_messages, role AS completion FROM conversations""", longs=("n_messages",))
def _(t):
    rows = t.turns.select("conv_id", "turn", "role", "text", F.struct(F.lit("kept").alias("split")).alias("extra_info"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("prompt"), F.col("role").alias("completion"))
    url = F.concat(F.lit("https://m.example/"), F.col("conv_id").cast("string"))
    rows = P.with_nested(rows, "extra_info", {"split": F.lit("other"), "tools_kwargs": P.tools_kwargs(url)})
    rows = P.append_completion(rows, "Be brief.")
    truth = P.first_truth(F.when(F.col("turn") % 3 == 0, F.col("role")).otherwise(""), F.lit(None).cast("string"), F.col("text"))
    return rows.select("conv_id", "turn", "extra_info.split", F.col("extra_info.tools_kwargs.browse.create_kwargs.url").alias("url"), truth.alias("truth"), F.size("prompt").cast("long").alias("n_messages"),
                       F.element_at("prompt", -1)["content"].alias("completion"))


@query("multi_choice_prompt", """WITH o AS (SELECT conv_id, turn, text, i, ['right', 'w1', 'w2', 'w3'][i + 1] AS v, row_number() OVER (PARTITION BY conv_id, turn ORDER BY md5('42:' || i || ':' || text)) AS r FROM conversations, (SELECT unnest(range(4)) AS i))
SELECT conv_id, turn, max(CASE WHEN i = 0 THEN 'ABCD'[r] END) AS gold_letter, text || chr(10) || chr(10) || string_agg('ABCD'[r] || ') ' || v, chr(10) ORDER BY r) AS query FROM o GROUP BY conv_id, turn, text""")
def _(t):
    rows = t.turns.select("conv_id", "turn", F.col("text").alias("question"), F.lit("right").alias("gold"), F.lit("w1").alias("a"), F.lit("w2").alias("b"), F.lit("w3").alias("c"))
    return P.multi_choice_prompt(rows, "question", "gold", ["a", "b", "c"]).select("conv_id", "turn", "gold_letter", "query")


@query("tokens_by_role", rf"""SELECT conv_id, role, CAST(sum(len(regexp_extract_all(text, '{TOK}'))) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id, role""")
def _(t):
    return M.tokens_by_role(t.turns, "conv_id", "role", "text")


@query("trajectory_stats", """SELECT conv_id, count(CASE WHEN role = 'user' THEN 1 END) AS searches, count(CASE WHEN role = 'assistant' THEN 1 END) AS visits, count(DISTINCT CASE WHEN role = 'assistant' THEN turn % 3 END) AS domains,
 count(CASE WHEN role = 'assistant' AND length(text) > 0 THEN 1 END) AS think_turns, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS think_chars FROM conversations GROUP BY conv_id""")
def _(t):
    call = F.when(F.col("role") == "user", F.array(F.struct(F.lit("search").alias("name"), F.array().cast("array<string>").alias("urls")))).when(
        F.col("role") == "assistant", F.array(F.struct(F.lit("visit").alias("name"), F.array(F.concat(F.lit("https://www.h"), (F.col("turn") % 3).cast("string"), F.lit(".example/p"), F.col("turn").cast("string"))).alias("urls"))))
    steps = t.turns.select("conv_id", F.lit("assistant").alias("type"), F.when(F.col("role") == "assistant", F.col("text")).alias("think"), call.alias("tool_calls"))
    return V.trajectory_stats(steps, "conv_id")


@query("browse_errors", """SELECT conv_id, turn, 1 AS line, CASE WHEN role = 'user' THEN 'Timeout' ELSE 'Not Found' END AS error, 0 AS turn_no FROM conversations""", longs=("line", "turn_no"))
def _(t):
    text = F.regexp_replace(F.regexp_replace(F.lower("text"), r"[a-z0-9]", "o"), "\n", " ")
    out = F.concat(F.lit('{"name": "visit"} '), text, F.when(F.col("role") == "user", F.lit("\nTIMEOUT 404\n")).otherwise(F.lit("\nHTTP 404 error\n")), F.lit("assistant x"))
    rows = V.browse_error_rows(t.turns.select("conv_id", F.col("turn").alias("t"), out.alias("output")))
    return rows.select("conv_id", F.col("t").alias("turn"), F.col("line").cast("long").alias("line"), "error", F.col("turn").cast("long").alias("turn_no"))


@query("visit_failure_reasons", """SELECT role, CASE role WHEN 'user' THEN 'Connection Error: ConnectionResetError' WHEN 'assistant' THEN '后端失败: URL 无法访问 (Cache miss/Summary失败)' ELSE NULL END AS reason, CASE role WHEN 'user' THEN '正常响应' WHEN 'assistant' THEN '网页无法访问' ELSE '正常响应' END AS outcome, count(*) AS n FROM conversations GROUP BY role""")
def _(t):
    r = F.when(F.col("role") == "user", F.lit("Browse error: ConnectionResetError(104)")).when(F.col("role") == "assistant", F.lit("Evidence in page:\nThe page could not be accessed\n\nSummary: none")).otherwise(F.lit("Evidence in page:\nfacts\n\nSummary: good"))
    return t.turns.groupBy("role", T.visit_failure_reason(r).alias("reason"), T.summary_outcome(r).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("head_and_last", """SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE rn < 4 OR rn = n""")
def _(t):
    return R.head_and_last(t.turns, 4, ["conv_id"], ["turn"]).select("conv_id", "turn")


@query("explode_messages", """SELECT conv_id, turn, m AS messages_no, CASE m WHEN 0 THEN 'user' ELSE role END AS role FROM conversations, (SELECT unnest([0, 1]) AS m)""", longs=("messages_no",))
def _(t):
    rows = t.turns.select("conv_id", "turn", F.array(F.struct(F.lit("user").alias("role")), F.struct("role")).alias("messages"))
    return R.explode_records(rows, "messages").withColumn("messages_no", F.col("messages_no").cast("long"))


@query("temporal_context", r"""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 DAY, '%d %B %Y') AS d FROM orders""")
def _(t):
    stamp = F.concat(F.lit(" 04:17, "), F.date_format(F.col("o_orderdate").cast("timestamp"), "d MMMM yyyy"))
    return t.orders.select("o_orderkey", C.temporal_context(stamp).alias("d"))


@query("score_by_registry", """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM conversations""")
def _(t):
    registry = Q.ScorerRegistry()
    registry.register("qa", lambda out, truth: S.score_em(out, F.array(truth)))
    registry.register("math", lambda out, truth: S.score_boxed_equal(out, truth))
    rows = t.turns.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "qa").otherwise("math").alias("data_source"),
                          F.concat("text", F.lit("<answer>"), "role", F.lit("</answer> \\boxed{"), "role", F.lit("}")).alias("output"), F.lit("assistant").alias("ground_truth"))
    return registry.score(rows).select("conv_id", "turn", "score")


@query("batch_score", """SELECT conv_id, turn, CAST(length(text) AS DOUBLE) AS score FROM conversations""")
def _(t):
    rows = t.turns.select("conv_id", "turn", F.col("role").alias("data_source"), F.col("text").alias("output"), F.lit("x").alias("ground_truth"))
    return Q.batch_score(rows, lambda sources, outputs, truths, extras: [len(o) for o in outputs]).select("conv_id", "turn", "score")


@query("generate", """SELECT conv_id, turn, 'echo: ' || text AS reply FROM conversations""")
def _(t):
    return Q.generate(t.turns.select("conv_id", "turn", F.col("text").alias("prompt")), "prompt", lambda prompts: [f"echo: {p}" for p in prompts]).select("conv_id", "turn", "reply")


@query("clean_model_json", """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE role END AS name FROM conversations""")
def _(t):
    k = F.col("turn") % 3
    payload = F.when(k == 0, F.concat(F.lit('{"name": "'), "role", F.lit('"}'))).when(k == 1, F.concat(F.lit("{name: '"), "role", F.lit("'}"))).otherwise(F.lit("not json"))
    return t.turns.select("conv_id", "turn", T.json_object(payload, "name string")["name"].alias("name"))
