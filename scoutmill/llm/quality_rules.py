"""Quality rules (operator 10): line-first cleaning with column functions only.

Every line of a document is held against punctuation, navigation, shouting,
symbol and boilerplate rules; failing lines are removed, and a document that
loses too much of its text is rejected. Everything is computed inside the row,
so nothing is shuffled and a hot source or a very long text is just one row.

Defined cases: a null text counts as empty; an empty text has zero counts, is
base-failed and rejected; rows with equal ids are judged one by one; an empty
table gives an empty result; the input's own columns are kept out of the way
because the operator only reads ``text`` and the named keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that parts words, and the counted symbols.
SPACES = " \t\n\u000b\f\r"
SYMBOLS = r"[#*$%&|<>]"
# What a finished line may end in, with closing quotes or brackets after it.
FINISHED = r"[.!?…:;。！？।][\"'”’»)\]]*[ \t\u000b\f\r]*$"
# Parts between the items of a menu or a breadcrumb, and what a text with any of them holds.
MENU = r"(?:[|»›•·→]|::|(?<= )[<>/](?= ))"
CAPITALS = r"\p{Lu}{2}"
MARKED = r"[#*$%&|<>»›•·→]|::| / |\p{Lu}\p{Lu}"
# Phrases of page furniture.
FURNITURE = (
    r"(?i)\b(?:cookies? (?:policy|settings|notice)|accept (?:all )?cookies|privacy policy|terms (?:of (?:use|service)|and conditions)"
    r"|all rights reserved|sign (?:in|up)\b.{0,40}\b(?:account|newsletter|email)|log ?in to your account|subscribe to (?:our|the) newsletter"
    r"|share (?:this|on) (?:facebook|twitter|x|linkedin)|click here to|read more|back to top|skip to (?:main )?content|enable javascript"
    r"|lorem ipsum|powered by wordpress|page not found|add to (?:cart|basket)|no comments yet|leave a (?:reply|comment))\b"
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def word_array(text: Column) -> Column:
    """Words between white space, in order; an empty array for a text without words.

    Rare kinds of white space become blanks first, so that the split is by one
    plain character, which is several times faster than by a pattern.
    """
    plain = text
    for space in SPACES[1:]:
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def line_marks(line: Column, plain: bool = False) -> Column:
    """What the rules ask of a line, each counted once; a ``plain`` one is known to hold no symbol, separator or capitals."""
    blanks = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    count = lambda pattern: F.lit(0) if plain else F.regexp_count(line, F.lit(pattern))
    return F.struct(
        line.alias("line"), blanks.alias("blanks"), (F.length(line) - blanks).alias("visible"),
        count(MENU).alias("separators"), count(CAPITALS).alias("capitals"), count(SYMBOLS).alias("symbols"),
        F.rlike(F.right(F.rtrim(line), F.lit(8)), F.lit(FINISHED)).alias("finished"), (F.trim(line, F.lit(SPACES)) == "").alias("blank"))


def line_fails(
    mark: Column, unfinished_words: int = 4, menu_parts: int = 3, symbol_share: float = 0.08, shout_pairs: float = 0.25, furniture_chars: int = 400,
) -> Column:
    """True for a line (as marks) that a rule removes; blank lines never fail.

    Rules: more than ``unfinished_words`` words without an end mark, at least
    ``menu_parts`` menu separators with few words between them, symbols above
    ``symbol_share`` of the visible characters, pairs of capitals above
    ``shout_pairs`` of them, or a phrase of page furniture on a line of at most
    ``furniture_chars``.
    """
    unfinished = (mark["blanks"] >= unfinished_words) & ~mark["finished"]
    menu = (mark["separators"] >= menu_parts) & (mark["separators"] * 4 >= mark["blanks"] - mark["separators"])
    shouting = (mark["visible"] >= 12) & (mark["capitals"] > mark["visible"] * shout_pairs)
    noisy = (mark["visible"] >= 8) & (mark["symbols"] > mark["visible"] * symbol_share)
    furniture = (mark["visible"] <= furniture_chars) & F.rlike(mark["line"], F.lit(FURNITURE))
    return ~mark["blank"] & (unfinished | menu | shouting | noisy | furniture)


def repeated_words(sorted_grams: Column) -> Column:
    """Words inside 3-word windows found at least twice, each word counted once.

    ``sorted_grams`` holds (gram, place) in order, so equal windows are
    neighbours; the places found are put in order and each covers up to three
    words, less when the next one starts inside it.
    """
    places = F.sort_array(F.transform(
        F.filter(sorted_grams, lambda g, i: (F.get(sorted_grams, i - 1)["gram"] == g["gram"]) | (F.get(sorted_grams, i + 1)["gram"] == g["gram"])),
        lambda g: g["place"]))
    return F.aggregate(
        places, F.struct(F.lit(0).alias("covered"), F.lit(-3).alias("before")),
        lambda acc, p: F.struct((acc["covered"] + F.least(F.lit(3), p - acc["before"])).alias("covered"), p.alias("before")),
        lambda acc: acc["covered"])


def judge_documents(docs: DataFrame, keys: list[str], max_lost: float = 0.5) -> DataFrame:
    """One row per input row: ``keys``, base counts, cleaned text and the verdict ``kept``.

    ``kept`` is false for base-failed rows (under 50 words, or more than half of
    the words in repeated 3-word windows) and for rows whose removed lines hold
    more than ``max_lost`` of the visible characters.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    marks = F.when(F.rlike(text, F.lit(MARKED)), F.transform(lines, lambda line: line_marks(line))).otherwise(F.transform(lines, lambda line: line_marks(line, plain=True)))
    arrays = docs.select(*keys, F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"), word_array(text).alias("words"), marks.alias("marks"))
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    gram = lambda i: (F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    hashes = F.transform(starts, lambda i: F.xxhash64(*gram(i)))
    worded = F.transform(F.filter("marks", lambda m: ~m["blank"]), lambda m: m["line"])
    good = F.filter("marks", lambda m: ~line_fails(m))
    hashed = arrays.select(
        *keys, n.alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"), "n_symbols",
        "words", hashes.alias("hashes"), worded.alias("worded"), good.alias("good"))
    # Windows are compared as words, and only in the texts where two hashes agree.
    grams = F.when((n >= 3) & (F.size(F.array_distinct("hashes")) < F.size("hashes")), F.transform(starts, lambda i: F.concat_ws(" ", *gram(i))))
    staged = hashed.select(*keys, "n_words", "word_chars", "n_symbols", grams.alias("grams"), "worded", "good")
    sorted_grams = F.when(
        F.col("grams").isNotNull(), F.sort_array(F.arrays_zip(F.col("grams").alias("gram"), F.sequence(F.lit(0), F.size("grams") - 1).alias("place"))))
    visible = lambda marks: F.aggregate(marks, F.lit(0), lambda acc, m: acc + m["visible"])
    result = staged.withColumn("sorted_grams", sorted_grams).select(
        *keys, F.col("n_words").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated_words(F.col("sorted_grams")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array_join(F.transform("good", lambda m: m["line"]), "\n").alias("clean_text"), visible("good").cast("long").alias("clean_chars"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = 1 - F.col("clean_chars") / F.greatest(F.col("word_chars"), F.lit(1))
    return result.withColumn("base_failed", failed).withColumn("lost_share", lost).withColumn("kept", ~failed & (lost <= max_lost))
