"""Column functions on hand-made cases; our own values."""

import html
import re

import pytest
from pyspark.sql import functions as F

from scoutmill.functions import arrays as A
from scoutmill.functions import html as H
from scoutmill.functions import numbers as N
from scoutmill.functions import scoring as S
from scoutmill.functions import tags as T
from scoutmill.functions import text as X
from scoutmill.functions import urls as U
from scoutmill.operators.corpus import temporal_context
from scoutmill.operators.prompts import normalize_ground_truth


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_cleaning(spark):
    assert values(spark, ["a\x00b\x1f\tc\n", None, "\x7fz"], X.clean_text) == ["ab\tc\n", "", "z"]
    report = values(spark, ["a\x00\x00\x01é"], X.char_report)[0]
    assert tuple(report) == (2, 3, 2, 1)
    assert values(spark, ["abcdef", "abc", None], lambda c: X.safe_truncate(c, 5)) == ["ab...", "abc", ""]
    assert values(spark, ["abcdef"], lambda c: X.safe_truncate(c, 2)) == ["ab"]


def test_tokens(spark):
    assert values(spark, ["Hello,  wörld 42!", "", None], X.token_count) == [5, 0, 0]
    assert values(spark, [" Hello,  wörld 42!", "a b"], lambda c: X.truncate_tokens(c, 3)) == [" Hello,  wörld", "a b"]


@pytest.mark.parametrize("title,text,want", [
    ("", "", ""), ("", "a b c d e f g h i", "a b c d e f"), ("t", "", "t"), ("one two", "a b c d e", "one two: a b"),
    ("a b c d e f g", "x", "a b c d e f"), ("a b c d", "x y", "a b c d"), (None, None, ""),
])
def test_title_and_text(spark, title, text, want):
    df = spark.createDataFrame([(title, text)], "a string, b string")
    assert df.select(X.combine_title_text("a", "b", 6)).first()[0] == want


def test_normalize_text(spark):
    assert values(spark, ["It`s  A_B-C (d.5) “q” ’x’"], X.normalize_text) == ["it's a b c d.5 q x"]


def test_snippet(spark):
    words = [f"w{i}" for i in range(60)]
    short, plain = " ".join(words[:20]), " ".join(words)
    ended = " ".join(w + "." for w in words)
    a, b, c, d = values(spark, [short + "\n", plain, ended, "  "], X.snippet)
    assert a == short and d == ""
    assert b.endswith("...") and 20 <= len(b.split()) <= 30 and plain.startswith(b[:-3])
    assert c.endswith(".") and not c.endswith("...") and 20 <= len(c.split()) <= 30
    assert values(spark, ["caf\\u00e9 \\U0001F600 \\n"], X.snippet) == ["café 😀 \\n"]


def test_short_forms(spark):
    assert values(spark, ["  one   two, three", "ab"], lambda c: X.shorten(c, 9)) == ["one two…", "ab"]
    assert values(spark, ["a\n\n\n\nb  c"], lambda c: X.md_truncate(c, 50)) == ["a\n\nb c"]
    assert values(spark, ["first line\nsecond line"], lambda c: X.md_truncate(c, 15)) == ["first line…"]
    assert values(spark, ["hi\n\na longer paragraph here\n\nlast", "tiny"], X.first_para) == ["a longer paragraph here", "tiny"]
    assert values(spark, [" x [title] y [step] z  w "], X.hellaswag_clean) == ["x. y z w"]
    assert values(spark, ["What?", "éa", "iOS", ""], X.lower_first) == ["what?", "éa", "iOS", ""]


def test_numbers(spark):
    assert values(spark, ["$1,234.50 and 10 000 or 7"], N.extract_numbers) == [[1234.5, 10000.0, 7.0]]
    assert values(spark, ["3.5万人 2百 1千"], N.chinese_numbers) == [[35000.0, 1000.0, 200.0]]
    forms = spark.range(1).select(N.number_to_words(F.lit(2)), N.number_to_words(F.lit(40))).first()
    assert "两人" in forms[0] and "TWO" in forms[0] and "two people" in forms[0] and forms[1] == []


# Slow statement of the rule, per pair, against which the expression is checked.
def found(answer, text, question=""):
    def nums(s):
        out = [float(re.sub(r"[$€£¥\s,]", "", m)) for m in re.findall(r"[\$€£¥]?\s*\d+(?:[,\s]\d{3})*(?:\.\d+)?", s)]
        for unit, times in (("万", 1e4), ("千", 1e3), ("百", 1e2)):
            out += [float(m) * times for m in re.findall(rf"(\d+(?:\.\d+)?)\s*{unit}", s)]
        return set(out)

    def norm(s):
        s = re.sub(r"[^\w\s'.]", " ", s.lower().replace("`", "'").replace("_", " ").replace("-", " "))
        return re.sub(r"\s+", " ", s).strip()

    mine = nums(answer)
    check = {n for n in mine if not (n < 10 and n == int(n))} - nums(question)
    words = lambda n: N.word_forms(int(n)) if 0 <= int(n) <= 20 else []
    if check and check <= nums(text) and (any(n <= 31 and any(w in text for w in words(n)) for n in check) or all(n > 31 for n in check)):
        return True
    a, t = norm(answer), norm(text)
    if len(a) > 3 and a in t:
        return True
    if any(n <= 31 and any(len(w) > 1 and w in text for w in words(n)) for n in mine):
        return True
    bare = norm(re.sub(r"[$€¥£~]", "", re.sub(r"\d+(?:,\d{3})*(?:\.\d+)?", "", answer)))
    parts = [w for w in bare.split() if len(w) > 2]
    return bool(len(bare) > 3 and parts and sum(w in t for w in parts) >= max(1, int(0.7 * len(parts))))


def test_answer_in_text(spark):
    answers = ["1,234", "42", "12", "3 people", "The Red House", "red-house", "5", "2百", "Paris in 1998", "blue whale swims far", "$15", "1998", "zzz qqq", "ok", ""]
    texts = ["It cost 1234 in total", "there were twelve of 12", "three people", "a red house stood", "一共有两百人 200", "Paris was fine in 1998", "the whale swims", "fifteen and 15", "nothing here", "5 five", "12 only", ""]
    questions = ["", "What happened in 1998?", "How many, 12?"]
    cases = [(a, t, q) for a in answers for t in texts for q in questions]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, t string, q string")
    got = {r.i: r.x for r in df.select("i", N.answer_in_text(F.col("a"), F.col("t"), F.col("q")).alias("x")).collect()}
    wrong = [(c, got[i]) for i, c in enumerate(cases) if got[i] != found(*c)]
    assert not wrong


def test_urls(spark):
    wiki = "https://en.wikipedia.org/w/index.php?title=Red_House&diff=prev&oldid=77"
    assert values(spark, [wiki, "https://a.example/x"], U.revision_to_current) == ["https://en.wikipedia.org/wiki/Red_House", None]
    assert values(spark, ["/w/index.php?title=A_B&oldid=5", "/w/index.php?oldid=6", "/w/index.php?title=C"], U.clean_revision_url) == [
        "https://en.wikipedia.org/w/index.php?title=A_B&oldid=5", "https://en.wikipedia.org/w/index.php?oldid=6", None]
    assert values(spark, [wiki, "https://x"], lambda c: U.fix_revision_url(c, F.lit("77"))) == ["https://en.wikipedia.org/w/index.php?title=Red_House&oldid=77", "https://x"]
    assert values(spark, ["C++ (a/b) é~*"], U.history_url) == ["https://en.wikipedia.org/w/index.php?title=C%2B%2B_%28a/b%29_%C3%A9~%2A&action=history&offset=&limit=2000"]
    assert values(spark, ["https://www.a.example/x?y", "nope"], U.host) == ["a.example", "nope"]
    assert values(spark, ["https://news.qq.com/x", "http://a.cn:80/", "https://qq.com.example"], U.is_chinese_url) == [True, True, False]
    assert values(spark, ["record:1", "ftp://x", None], U.valid_url) == [True, False, False]
    assert values(spark, ["http://a.example/b/c/", "x"], U.legacy_key) == ["c", "x"]


def test_markdown(spark):
    page = ("<html><head><title>t</title></head><body><h2>Big <b>News</b></h2><script>var x='<p>'</script><p>Some <em>fine</em>  text<br>next</p>"
            "<ul><li>one</li> stray <li><a href='/u'>two</a></li></ul><div>a &amp; b</div></body></html>")
    got = values(spark, [page, "", None], H.html_to_markdown)
    assert got[0] == "## Big **News**\n\nSome *fine*text \nnext\n\n- one\n- [two](/u)\n\na & b"
    assert got[1:] == ["", ""]


def test_basic_text(spark):
    page = "<p>a &lt;b&gt; &eacute;</p><style>x</style>c<br/>d"
    got = values(spark, [page], H.html_basic_text)[0]
    assert got == re.sub(r"[ \t\r\f\v]+", " ", html.unescape(" a &lt;b&gt; &eacute;\n\n c\nd")).strip()


def test_revision_lists_in_their_order_and_loose_items(spark):
    item = lambda n, more="": f'<li{more}><a class="mw-changeslist-date" href="/w/index.php?title=T&oldid={n}">day {n}</a></li>'
    page = f'<ul class="special">{item(1)}</ul><ul id="pagehistory">{item(2)}</ul><ul class="mw-contributions-list">{item(3)}</ul><ul>{item(4)}</ul>'
    loose = f'<div>{item(5, " class=mw-tag-x")}<ol>{item(6, " class=mw-contribution")}</ol>{item(7)}</div>'
    rows = values(spark, [page, loose, f'<ul id="pagehistory"></ul>{loose}', ""], H.revision_items)
    assert [[r["timestamp_text"] for r in own] for own in rows] == [["day 3", "day 2", "day 1"], ["day 5", "day 6"], [], []]


def test_revision_list(spark):
    page = """<ul id="pagehistory"><li><a class="mw-changeslist-date" href="/w/index.php?title=T&amp;oldid=9">04:17, 27 July 2005</a>
      <a class="mw-userlink"><bdi>Ann</bdi></a> <span class="history-size">(10 bytes)</span><span class="mw-plusminus-pos">+5</span>
      <span class="comment">(fix)</span><a class="mw-tag-markers">Undo</a></li><li>no link</li>
      <li><a href="/w/index.php?oldid=8">old</a><bdi>Bob</bdi></li></ul><ul class="other"><li><a href="?oldid=1">x</a></li></ul>"""
    rows = values(spark, [page], H.revision_items)[0]
    assert [(r.href, r.timestamp_text, r.editor, r.comment, r.size, r.byte_change, r.tags) for r in rows] == [
        ("/w/index.php?title=T&oldid=9", "04:17, 27 July 2005", "Ann", "(fix)", "(10 bytes)", "+5", ["Undo"]),
        ("/w/index.php?oldid=8", "old", "Bob", None, None, None, None)]


def test_dates(spark):
    assert values(spark, ["04:17, 27 July 2005", " 31 December 1999 ", "soon"], temporal_context) == ["28 July 2005", "01 January 2000", None]


def test_tool_calls(spark):
    out = ('<tool_call>{"name": "search", "arguments": {"query": ["a", "b"]}}</tool_call>x<tool_call>\n{"name": "visit", "arguments": {"url": "https://u"}}\n</tool_call>'
           "<tool_call>{bad}</tool_call>")
    calls = values(spark, [out], T.tool_calls)[0]
    assert [(c["name"], c["values"], c["bad_json"]) for c in calls] == [("search", ["a", "b"], False), ("visit", ["https://u"], False), (None, [], True)]


def test_tags(spark):
    assert values(spark, ["<answer>a</answer><answer> b\n</answer>", "<answer>open"], lambda c: T.extract_tag(c, "answer")) == ["b", None]
    assert values(spark, ["x<answer>a</answer>", "<answer> open ", "none"], T.prediction) == ["a", "open", "No answer found."]
    turns = values(spark, ["system\nrules\nuser\nhi\nassistant\n<tool_call>1</tool_call>user\n<tool_response>r</tool_response>assistant\nbye", "plain"], T.parse_messages)
    assert [(m.role, m.content) for m in turns[0]] == [("system", "rules"), ("user", "hi"), ("assistant", "<tool_call>1</tool_call>"), ("tool", "<tool_response>r</tool_response>"), ("assistant", "bye")]
    assert [(m.role, m.content) for m in turns[1]] == [("text", "plain")]
    assert values(spark, [None, "Max retries; could not be accessed", "no information is available", "fine"], T.classify_response) == ["no_response", "connect_fail", "browse_fail", "browse_success"]


def test_search_blocks(spark):
    block = "A Google search for 'q' found 2 results:\n\n## Web Results\n1. [One](https://a)\nfirst\nline\n\n2. [Two](https://b)\nsecond"
    rows = values(spark, [block], T.parse_search_block)[0]
    assert [tuple(r) for r in rows] == [("One", "https://a", "first\nline"), ("Two", "https://b", "second")]
    again = values(spark, [block], lambda c: T.render_results(F.lit("q"), T.parse_search_block(c)))[0]
    assert again == block


def test_qa_json(spark):
    pairs = values(spark, ['```json\n{"qa_pairs": [{"question": "q", "answer": "a"}]}\n```', 'x {"qa_pairs": [], "n": 0} y', '{"qa_pairs": [{"question": "z", "answer": "w"}]}', "no"], T.parse_qa_json)
    assert [None if p is None else [tuple(x) for x in p] for p in pairs] == [[("q", "a")], [], [("z", "w")], None]


def test_tagged_sft(spark):
    text = "try <code>```python\nx = 1\n```</code><interpreter>\n1\n</interpreter>so <answer>one</answer>"
    got = values(spark, [text], T.parse_tagged_sft)[0]
    assert [tuple(m) for m in got] == [("assistant", "try", "x = 1"), ("tool", "1", None), ("assistant", "so one", None)]


def test_model_json(spark):
    got = values(spark, ['{"name": "a"}', "{name: 'b'}", "nope"], lambda c: T.json_object(c, "name string")["name"])
    assert got == ["a", "b", None]


def test_verdicts(spark):
    assert values(spark, ["\\boxed{False} true", "it is\nTrue, not\nend", "x", None], T.parse_verdict) == [False, True, False, False]
    assert values(spark, ["Correct.", "incorrect"], T.verdict_words) == [True, False]
    assert values(spark, ["结论：正确", "正确 结论：错误", "正确", "正确错误"], lambda c: T.verdict_words(c, True)) == [True, False, True, False]
    assert values(spark, ['```json\n{"reasoning": "r", "judgment": "Correct"}\n```', "junk"], T.parse_judgment) == ["Correct", None]


def test_boxed(spark):
    texts = ["\\boxed{1} then \\boxed{\\frac{1}{2}}", "\\boxed 7$ x", "\\boxed{open", "none", "\\fbox{3}"]
    assert values(spark, texts, S.last_boxed) == ["\\frac{1}{2}", "7", None, None, None]
    latex = ["\\dfrac12", "x=5", "3/4", "0.5", "\\sqrt3", ".5\\%", "10\\text{ cm}", "\\frac1{72}", "a/b"]
    assert values(spark, latex, S.normalize_latex) == ["\\frac{1}{2}", "5", "\\frac{3}{4}", "\\frac{1}{2}", "\\sqrt{3}", "\\frac{1}{2}", "10", "\\frac{1}{72}", "a/b"]
    assert values(spark, ["so \\boxed{1/2}", "so \\boxed{2}"], lambda c: S.score_boxed(c, F.lit("\\frac{1}{2}"))) == [1.0, 0.0]


def test_final_answers(spark):
    cases = ["work\nAnswer: x = 1,200 dollars", "Answer: $\\text{7}$", "answer:\n9", "nothing"]
    got = values(spark, cases, lambda c: S.score_final_answer(c, F.lit("1200")))
    assert [(g["score"], g["pred"]) for g in got] == [(1.0, "1200"), (-1.0, "7"), (-1.0, "9"), (-1.0, "[INVALID]")]
    strict = values(spark, ["x" * 400 + "\\boxed{7}", "\\boxed{7}" + "x" * 200], lambda c: S.score_final_answer(c, F.lit("7"), strict_box=True))
    assert [s["score"] for s in strict] == [1.0, -1.0]
    boxes = values(spark, ["so \\boxed {7} hence \\boxed{5}", "\\boxed{a{b}c} \\boxed{", "\\boxed{a{b}c} \\fbox{d}", "none"], S.last_strict_box)
    assert boxes == ["5", None, "a{b}c", None]
    assert values(spark, ["#### 1,200", "12 and 13.", "x . ."], lambda c: S.final_number(c, "flexible")) == ["1,200", "13.", "."]
    assert values(spark, ["#### 1,200 ok", "1200"], lambda c: S.score_number(c, F.lit("1200"))) == [1.0, 0.0]
    assert values(spark, ["Answer: $b$ Answer: C", "answer : C"], lambda c: S.score_choice(c, F.lit("C"))) == [0.0, 1.0]


def test_em(spark):
    out = ["<answer>The Cat!</answer>", "<answer>dog</answer>", "none", "<answer>a cat</answer>" * 11]
    assert values(spark, out, lambda c: S.score_em(c, F.array(F.lit("cat")), 0.1)) == [1.0, 0.1, 0.0, 0.25]
    assert values(spark, ["<answer>big cat here</answer>"], lambda c: S.score_em(c, F.array(F.lit("cat")), sub=True)) == [1.0]


def test_routes(spark):
    rows = spark.createDataFrame([(0, "", ["x"], None), (1, "<answer>x</answer>", None, None), (2, "y", ["x"], True), (3, "<answer>z</answer>", ["x"], True), (4, "<answer>x</answer>", ["x"], None)],
                                 "i int, o string, t array<string>, v boolean")
    got = rows.select("i", S.judge_route(F.col("o"), F.col("t"), F.col("v")).alias("r")).orderBy("i").collect()
    assert [(g.r.method, g.r.correct) for g in got] == [("no_output", False), ("no_label", False), ("no_extraction", False), ("llm_judge", True), ("em_fallback", True)]


def test_ground_truth(spark):
    got = values(spark, ["Paris", '{"target": ["a", "b"]}', '{"target": "c"}', None], normalize_ground_truth)
    assert [g.target for g in got] == [["Paris"], ["a", "b"], ["c"], [""]]


def test_token_arrays(spark):
    df = spark.createDataFrame([([20, 10, 34, 1, 0, 0],), ([78, 0, 76, 2, 1, 0],), ([5, 6, 7, 8, 9, 3],)], "ids array<int>")
    assert [r[0] for r in df.select(A.response_mask(F.col("ids"), 1, 2)).collect()] == [[1, 1, 1, 1, 0, 0], [1, 1, 1, 1, 0, 0], [1] * 6]
    assert df.select(A.truncate_ids(F.col("ids"), 3, "middle")).first()[0] == [20, 0, 0]
    with pytest.raises(Exception, match="prompt length"):
        df.select(A.truncate_ids(F.col("ids"), 3, "error")).collect()
    p = spark.createDataFrame([([0.0, 100.0], [0.5, -100.0])], "a array<double>, b array<double>")
    k3 = p.select(A.kl_penalty(F.col("a"), F.col("b"), "k3")).first()[0]
    assert k3[0] == pytest.approx(2.718281828 ** 0.5 - 1.5) and k3[1] == 10.0


def test_unreadable_latex_is_compared_as_it_is(spark):
    forms = ["\\frac12", "\\frac1\\frac23", "\\frac", "a\\sqrt", "3\\text{ cm}", "3\\text{ cm}\\text{ x}", "\\sqrt2"]
    assert values(spark, forms, S.latex_form) == ["\\frac{1}{2}", "\\frac1\\frac23", None, None, "3", None, "\\sqrt{2}"]
    boxed = lambda c: S.score_boxed(F.concat(F.lit("\\boxed{"), c, F.lit("}")), c)
    assert values(spark, forms, boxed) == [1.0] * len(forms)
    assert values(spark, ["3\\text{ cm}\\text{ x}"], lambda c: S.score_boxed(F.lit("\\boxed{3}"), c)) == [0.0]


def test_dated_results(spark):
    block = "Found 2\n\n## Web Results\n1. [One](https://a.example/1)\nDate published: May 3, 2024\n\nfirst\nline\n\n2. [Two](https://a.example/2)\n\nsecond\n"
    assert [tuple(r) for r in values(spark, [block], T.parse_dated_results)[0]] == [
        (1, "One", "https://a.example/1", "May 3, 2024", "first\nline"), (2, "Two", "https://a.example/2", None, "second")]


def test_response_part_and_words_after_prompt(spark):
    from scoutmill.operators.metrics import words_after_prompt

    df = spark.createDataFrame([([1, 1, 0, 1], [5, 6]), ([1, 0], [])], "m array<int>, r array<int>")
    assert [r[0] for r in df.select(A.response_part(F.col("m"), F.col("r"))).collect()] == [[0, 1], []]
    turns = spark.createDataFrame([(["a"], [("x y",), ("one two",), (" three ",)]), (["a", "b"], [("x",)])], "p array<string>, m array<struct<content:string>>")
    assert [r[0] for r in turns.select(words_after_prompt(F.col("m"), F.col("p"))).collect()] == [3, 0]


def test_batches_for_python_are_cut_by_bytes(spark):
    pages = spark.range(400, numPartitions=1).select(F.repeat(F.lit("<p>x</p>"), 12_500).alias("html"))
    sizes = [r[0] for r in pages.mapInPandas(lambda batches: ((b[["html"]].head(1).assign(n=len(b)))[["n"]] for b in batches), "n long").collect()]
    assert sum(sizes) == 400 and max(sizes) <= 50
