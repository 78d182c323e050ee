"""Numbers in text and the answer-in-text rule used by the leak filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoutmill.functions.text import SPACE, let, matches, normalize_text

# Number pattern, Chinese magnitudes, and the word forms of 0-20.
NUMBER = rf"[$€£¥]?[{SPACE}]*[0-9]+(?:[,{SPACE}][0-9]{{3}})*(?:\.[0-9]+)?"
CHINESE_MAGNITUDES = {"万": 10000, "千": 1000, "百": 100}
CHINESE_WORDS = {
    0: ["零"], 1: ["一"], 2: ["两", "二"], 3: ["三"], 4: ["四"], 5: ["五"], 6: ["六"], 7: ["七"],
    8: ["八"], 9: ["九"], 10: ["十"], 11: ["十一"], 12: ["十二"], 13: ["十三"], 14: ["十四"],
    15: ["十五"], 16: ["十六"], 17: ["十七"], 18: ["十八"], 19: ["十九"], 20: ["二十", "二〇", "廿"],
}
CHINESE_SUFFIXES = ["人", "名", "个", "位", "条", "项"]
ENGLISH_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
    "nineteen", "twenty",
]
ENGLISH_SUFFIXES = [" people", " person", " items", " workers"]


def word_forms(n: int) -> list[str]:
    """Chinese and English spellings of a small number, with the usual suffixes."""
    out = [w + s for w in CHINESE_WORDS[n] for s in ["", *CHINESE_SUFFIXES]]
    word = ENGLISH_WORDS[n]
    return [*out, word, word.capitalize(), word.upper(), *[word + s for s in ENGLISH_SUFFIXES]]


def extract_numbers(col: Column) -> Column:
    """Numbers with optional currency, thousands separators and decimals, as doubles."""
    return F.transform(
        matches(col, NUMBER), lambda m: F.regexp_replace(m, rf"[$€£¥,{SPACE}]", "").cast("double")
    )


def chinese_numbers(col: Column) -> Column:
    """``3.5万`` and the like as plain numbers, largest magnitude first."""

    def scaled(unit: str, times: int) -> Column:
        found = F.regexp_extract_all(col, F.lit(rf"([0-9]+(?:\.[0-9]+)?)[{SPACE}]*{unit}"), F.lit(1))
        return F.transform(found, lambda m: m.cast("double") * F.lit(float(times)))

    return F.concat(*[scaled(unit, times) for unit, times in CHINESE_MAGNITUDES.items()])


def all_numbers(col: Column) -> Column:
    return F.array_distinct(F.concat(extract_numbers(col), chinese_numbers(col)))


def number_to_words(n: Column) -> Column:
    """Array of spellings of a whole number in 0-20; empty outside that range."""
    pairs = [item for k in CHINESE_WORDS for item in (F.lit(k), F.array(*[F.lit(w) for w in word_forms(k)]))]
    return F.coalesce(F.element_at(F.create_map(*pairs), n.cast("int")), F.array().cast("array<string>"))


def answer_in_text(answer: Column, text: Column, question: Column | None = None) -> Column:
    """Whether an answer can be read off a text.

    Numbers of the answer that the question does not give away must all occur
    (small ones also in words); failing that the normalised answer, a spelled
    small number, or 70 % of the answer's longer words must occur.
    """
    answer = F.coalesce(answer, F.lit(""))
    text = F.coalesce(text, F.lit(""))
    asked = all_numbers(F.coalesce(question, F.lit(""))) if question is not None else F.array().cast("array<double>")

    def spelled(n: Column, shortest: int) -> Column:
        return F.exists(number_to_words(n), lambda w: (F.length(w) >= shortest) & F.contains(text, w))

    def numeric(to_check: Column) -> Column:
        all_there = (F.size(to_check) > 0) & (F.size(F.array_except(to_check, all_numbers(text))) == 0)
        small = F.exists(to_check, lambda n: (n <= 31) & spelled(n, 1))
        return all_there & (small | F.forall(to_check, lambda n: n > 31))

    def by_numbers(numbers: Column) -> Column:
        # Single-digit whole numbers are too common to count; 1.0 written with a point is kept.
        decimals = F.transform(
            F.filter(matches(answer, NUMBER), lambda m: F.instr(m, ".") > 0),
            lambda m: F.regexp_replace(m, rf"[$€£¥,{SPACE}]", "").cast("double"),
        )
        significant = F.filter(numbers, lambda n: (n >= 10) | (n != F.floor(n)) | F.array_contains(decimals, n))
        in_words = F.exists(numbers, lambda n: (n <= 31) & spelled(n, 2))
        return let(F.array_except(significant, asked), numeric) | in_words

    def by_text(normal_text: Column) -> Column:
        normal_answer = normalize_text(answer)
        direct = (F.length(normal_answer) > 3) & F.contains(normal_text, normal_answer)
        bare = F.regexp_replace(F.regexp_replace(answer, r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?", ""), r"[$€¥£~]", "")
        return direct | let(normalize_text(bare), lambda normal_bare: by_words(normal_bare, normal_text))

    def by_words(normal_bare: Column, normal_text: Column) -> Column:
        words = F.filter(F.split(normal_bare, " "), lambda w: F.length(w) > 2)
        found = F.size(F.filter(words, lambda w: F.contains(normal_text, w)))
        needed = F.greatest(F.lit(1), F.floor(F.size(words) * 0.7).cast("int"))
        return (F.length(normal_bare) > 3) & (F.size(words) > 0) & (found >= needed)

    return let(all_numbers(answer), by_numbers) | let(normalize_text(text), by_text)
