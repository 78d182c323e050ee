"""Scores of an output against its truth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoutmill.functions.tags import extract_tag
from scoutmill.functions.text import squeeze, strip

# ASCII punctuation, clip lengths, maths normalisation tables.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLIP = 300
STRICT_BOX_CLIP = 100
SUBSTITUTIONS = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"),
    (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue",
    "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals",
    "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}",
    "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;",
    ",\\!", "{,}", '"', "\\dots",
]
# Patterns of a final answer, in the order they are applied.
ANSWER_PATTERNS = [
    (r"(.*?)\$(.*?)\$(.*)", r"\$$2\$"),
    (r"\\text\{(.*?)\}", "$1"),
    (r"\\textbf\{(.*?)\}", "$1"),
    (r"\\overline\{(.*?)\}", "$1"),
    (r"\\boxed\{(.*)\}", "$1"),
    (r"frac([^{])(.)", r"frac{$1}{$2}"),
    (r"sqrt([^{])", r"sqrt{$1}"),
]
# Replacements of LaTeX spellings before and after units are cut.
LATEX_SPELLINGS = [
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""),
    ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
]
LATEX_NUMBERS = [("\\%", ""), (" .", " 0."), ("{.", "{0.")]


def _clip(col: Column, n: int = CLIP) -> Column:
    """Last n characters."""
    return F.when(F.length(col) > n, F.substr(col, F.length(col) - n + 1)).otherwise(col)


def normalize_answer(col: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks, in that order."""
    bare = F.translate(F.lower(col), PUNCTUATION, "")
    return squeeze(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def exact_match(answer: Column, targets: Column) -> Column:
    normal = normalize_answer(answer)
    return F.exists(targets, lambda t: normalize_answer(t) == normal)


def sub_exact_match(answer: Column, targets: Column) -> Column:
    """A normalised target occurs inside the normalised answer."""
    normal = normalize_answer(answer)
    return F.exists(targets, lambda t: F.contains(normal, normalize_answer(t)))


def score_em(output: Column, targets: Column, format_score: float = 0.0, full: float = 1.0, sub: bool = False) -> Column:
    """0 without an answer tag; full marks on a match (a quarter when tags are spammed); else the format score."""
    answer = extract_tag(output, "answer")
    many = (F.regexp_count(output, F.lit("<answer>")) > 10) | (F.regexp_count(output, F.lit("</answer>")) > 10)
    hit = sub_exact_match(answer, targets) if sub else exact_match(answer, targets)
    reward = F.lit(full) if sub else F.when(many, F.lit(full / 4)).otherwise(F.lit(full))
    return F.when(answer.isNull(), F.lit(0.0)).when(hit, reward).otherwise(F.lit(format_score))


def final_number(output: Column, method: str = "strict") -> Column:
    """Last ``#### n`` of the last 300 characters, or (flexible) the last number there."""
    tail = _clip(output)
    if method == "strict":
        found = F.regexp_extract_all(tail, F.lit(r"#### (-?[0-9.,]+)"), F.lit(1))
        return F.translate(F.try_element_at(found, F.lit(-1)), ",$", "")
    if method != "flexible":
        raise ValueError(f"unknown method {method!r}")
    numbers = F.regexp_extract_all(tail, F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    good = F.filter(numbers, lambda n: n != ".")
    # With nothing but dots the scan ends on the first of them.
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.try_element_at(numbers, F.lit(1)))


def score_number(output: Column, truth: Column, method: str = "strict", format_score: float = 0.0, full: float = 1.0) -> Column:
    number = final_number(output, method)
    return F.when(number.isNull(), F.lit(0.0)).when(number == truth, F.lit(full)).otherwise(F.lit(format_score))


def last_boxed(text: Column) -> Column:
    r"""Body of the last ``\boxed{...}`` (braces balanced) or ``\boxed x``; ``\fbox`` as a fallback; else null."""
    spaced = F.substring_index(F.substring_index(text, "\\boxed ", -1), "$", 1)
    command = F.when(F.contains(text, F.lit("\\boxed")), F.lit("\\boxed")).when(F.contains(text, F.lit("\\fbox")), F.lit("\\fbox"))
    rest = F.when(F.contains(text, F.lit("\\boxed")), F.substring_index(text, "\\boxed", -1)).otherwise(F.substring_index(text, "\\fbox", -1))
    # Depth after each brace; the body ends where it first comes back to zero.
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, ch: Column) -> Column:
        depth = s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        at = s["at"] + 1
        closes = (s["end"] == 0) & (ch == "}") & (depth == 0)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(closes, at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(rest, ""), state, step, lambda s: s["end"])
    body = F.substr(rest, F.lit(2), end - 2)
    framed = F.when((end > 0) & rest.startswith("{") & (command == "\\boxed"), body)
    return F.when(F.contains(text, F.lit("\\boxed ")), spaced).otherwise(framed)


def last_strict_box(text: Column) -> Column:
    r"""Body of the last ``\boxed{...}`` with balanced braces; null without one, or if the last one never closes."""
    rest = F.substring_index(text, "\\boxed{", -1)
    state = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, ch: Column) -> Column:
        depth = s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        at = s["at"] + 1
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((s["end"] == 0) & (depth == 0), at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(rest, ""), state, step, lambda s: s["end"])
    return F.when(F.contains(text, F.lit("\\boxed{")) & (end > 0), F.substr(rest, F.lit(1), end - 1))


def _replace_all(col: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def normalize_latex(col: Column) -> Column:
    """Spacing, units, fractions and roots of a LaTeX answer in one spelling; one that can't be read stays as it is."""
    return F.coalesce(latex_form(col), col)


def latex_form(col: Column) -> Column:
    """The one spelling, or null for a text that can't be read: two units, or a root or fraction with nothing after it."""
    units = F.regexp_count(col, F.lit(r"\\text\{ "))
    s = _replace_all(col, LATEX_SPELLINGS)
    s = F.when(units == 1, F.substring_index(s, "\\text{ ", 1)).otherwise(s)
    s = _replace_all(s, LATEX_NUMBERS)
    s = F.when(s.startswith("."), F.concat(F.lit("0"), s)).otherwise(s)
    s = F.regexp_replace(s, r"^[^=]{0,2}=([^=]*)$", "$1")
    s = F.regexp_replace(s, r"(?s)\\sqrt([^{])", r"\\sqrt{$1}")
    s = F.replace(s, F.lit(" "), F.lit(""))
    # What follows each fraction: nothing (unreadable), one character (all fractions stay as they are), or enough.
    after = F.array_join(F.transform(F.slice(F.split(s, r"\\frac", -1), 2, 1 << 30), lambda p: F.when(p == "", "e").when((F.length(p) == 1) & (p != "{"), "s").otherwise("-")), "")
    first_odd = F.regexp_extract(after, "[es]", 0)
    unreadable = (units > 1) | F.rlike(s, F.lit(r"\\sqrt(?:\\sqrt|$)")) | (first_odd == "e")
    braced = F.regexp_replace(F.regexp_replace(s, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])\{", r"\\frac{$1}{")
    s = F.when(unreadable, F.lit(None)).when(first_odd == "s", s).otherwise(braced)
    s = F.when(s == "0.5", F.lit("\\frac{1}{2}")).otherwise(s)
    return F.regexp_replace(s, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}")


def score_boxed(output: Column, truth: Column) -> Column:
    """1 when the last boxed body equals the truth after LaTeX normalisation."""
    body = last_boxed(output)
    left, right = latex_form(body), latex_form(truth)
    same = F.when(left.isNull() | right.isNull(), body == truth).otherwise(left == right)
    return F.coalesce(F.when(same, F.lit(1.0)), F.lit(0.0))


def score_boxed_equal(output: Column, truth: Column) -> Column:
    """1 when the last boxed body equals the truth exactly."""
    return F.coalesce(F.when(last_boxed(output) == truth, F.lit(1.0)), F.lit(0.0))


def normalize_final_answer(col: Column) -> Column:
    """Right-hand side with words, units and TeX decoration removed."""
    s = _replace_all(F.substring_index(col, "=", -1), [*SUBSTITUTIONS, *[(word, "") for word in REMOVED]])
    for pattern, kept in ANSWER_PATTERNS:
        s = F.regexp_replace(s, pattern, kept)
    s = F.replace(s, F.lit("$"), F.lit(""))
    return strip(F.when(s.rlike(r"^[0-9,]*[0-9][0-9,]*$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(s))


def score_final_answer(output: Column, truth: Column, strict_box: bool = False) -> Column:
    """{score +1/-1, acc, pred}: last ``Answer:`` line of the tail, or the boxed body of a shorter tail."""
    tail = _clip(output)
    if strict_box:
        pred = last_strict_box(_clip(tail, STRICT_BOX_CLIP))
        right = F.coalesce(pred == truth, F.lit(False))
    else:
        lines = F.regexp_extract_all(tail, F.lit(rf"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
        pred = normalize_final_answer(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("[INVALID]")))
        right = pred == normalize_final_answer(truth)
    return F.struct(F.when(right, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("score"), right.alias("acc"), pred.alias("pred"))


def format_reward(output: Column) -> Column:
    """1 when the whole output is a think span followed by a boxed answer."""
    return F.when(output.rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z"), F.lit(1.0)).otherwise(F.lit(0.0))


def mixed_reward(output: Column, truth: Column, format_weight: float = 0.1) -> Column:
    """Boxed accuracy and format in fixed shares."""
    return (1 - format_weight) * score_boxed(output, truth) + format_weight * format_reward(output)


def score_choice(output: Column, gold: Column, full: float = 1.0) -> Column:
    """First ``Answer: X`` with X in A-D, whatever the case, equals the gold letter."""
    letter = F.regexp_extract(output, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1)
    return F.when((letter != "") & (letter == gold), F.lit(full)).otherwise(F.lit(0.0))


def judge_route(output: Column, targets: Column, verdict: Column) -> Column:
    """Route of each sample and its score: no_output, no_label, no_extraction, llm_judge, em_fallback."""
    answer = extract_tag(output, "answer")
    empty = lambda c: c.isNull() | (c == "")
    route = (
        F.when(empty(output), "no_output")
        .when(targets.isNull() | (F.size(targets) == 0), "no_label")
        .when(empty(answer), "no_extraction")
        .when(verdict.isNotNull(), "llm_judge")
        .otherwise("em_fallback")
    )
    right = F.when(route == "llm_judge", verdict).when(route == "em_fallback", exact_match(answer, targets)).otherwise(F.lit(False))
    return F.struct(
        route.alias("method"),
        right.alias("correct"),
        F.when(right, F.lit(1.0)).otherwise(F.lit(0.0)).alias("score"),
        F.when(route.isin("llm_judge", "em_fallback"), answer).otherwise("").alias("pred_ans"),
    )
