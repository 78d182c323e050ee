"""String columns: cleaning, length limits, tokens, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that mean the same in Java, RE2 and Python.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
NON_ASCII = r"[^\x00-\x7F]"
TOKEN = rf"[{WORD}]+|[^{SPACE}{WORD}]"
CHINESE = r"[\x{4E00}-\x{9FFF}]"

# Limits of the document preparation job.
TITLE_MAX_CHARS = 1024
URL_MAX_CHARS = 1024
EMBEDDING_MAX_TOKENS = 500
EMBEDDING_CUT_TOKENS = 700
STORED_DOC_TOKENS = 50
STORED_DOC_CHARS = 200


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(col: Column, pattern: str) -> Column:
    """All whole matches of a pattern as an array."""
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def strip(col: str | Column) -> Column:
    """Drop leading and trailing white space of any kind (``trim`` drops blanks only)."""
    return F.regexp_replace(_c(col), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(col: Column) -> Column:
    """Collapse white space to single blanks and strip."""
    return F.trim(F.regexp_replace(col, rf"[{SPACE}]+", " "))


def clean_text(col: str | Column) -> Column:
    """Remove NUL and control characters (tab, LF and CR stay); null becomes ''."""
    return F.regexp_replace(F.coalesce(_c(col), F.lit("")), CONTROL, "")


def char_report(col: str | Column) -> Column:
    """Counts of NUL, control, distinct control and non-ASCII characters."""
    text = F.coalesce(_c(col), F.lit(""))
    return F.struct(
        F.regexp_count(text, F.lit(r"\x00")).alias("n_nul"),
        F.regexp_count(text, F.lit(CONTROL)).alias("n_control"),
        F.size(F.array_distinct(matches(text, CONTROL))).alias("n_distinct_control"),
        F.regexp_count(text, F.lit(NON_ASCII)).alias("n_non_ascii"),
    )


def contains_chinese(col: str | Column) -> Column:
    return _c(col).rlike(CHINESE)


def cut_with_marker(col: str | Column, longest: int, marker: str) -> Column:
    """Cut to ``longest`` characters and say so."""
    c = _c(col)
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit(marker))).otherwise(c)


def safe_truncate(col: str | Column, n: int) -> Column:
    """At most ``n`` characters, the last three being dots when something was cut."""
    c = F.coalesce(_c(col), F.lit(""))
    short = F.substring(c, 1, n) if n <= 3 else F.concat(F.substring(c, 1, n - 3), F.lit("..."))
    return F.when(F.length(c) > n, short).otherwise(c)


def token_count(col: str | Column) -> Column:
    """Words and single symbols; a caller with a BPE vocabulary passes a pandas UDF instead."""
    return F.regexp_count(F.coalesce(_c(col), F.lit("")), F.lit(TOKEN))


def truncate_tokens(col: str | Column, n: int | Column) -> Column:
    """Text up to and including its n-th token, white space between tokens kept."""
    c = F.coalesce(_c(col), F.lit(""))
    limit = F.lit(n) if isinstance(n, int) else n

    def cut(pieces: Column) -> Column:
        return F.when(F.size(pieces) <= limit, c).otherwise(F.array_join(F.slice(pieces, 1, F.greatest(limit, F.lit(0))), ""))

    return let(matches(c, rf"[{SPACE}]*(?:{TOKEN})"), cut)


def combine_title_text(title: str | Column, text: str | Column, budget: int) -> Column:
    """``title: text`` within a token budget; two tokens are reserved for the separator."""

    def with_title(t: Column) -> Column:
        return let(strip(F.coalesce(_c(text), F.lit(""))), lambda x: let(token_count(t), lambda n: combined(t, x, n)))

    def combined(t: Column, x: Column, n: Column) -> Column:
        room = F.lit(budget) - n - 2
        return (
            F.when(t == "", truncate_tokens(x, budget))
            .when((x == "") | (n >= budget), truncate_tokens(t, budget))
            .when(room <= 0, t)
            .otherwise(let(truncate_tokens(x, room), lambda body: F.when(body == "", t).otherwise(
                truncate_tokens(F.concat(t, F.lit(": "), body), budget))))
        )

    return let(strip(F.coalesce(_c(title), F.lit(""))), with_title)


def normalize_text(col: str | Column) -> Column:
    """Lower case; backtick to apostrophe; _ and - to blanks; other symbols dropped."""
    lowered = F.translate(F.lower(_c(col)), "`_-", "'  ")
    return squeeze(F.regexp_replace(lowered, rf"[^{WORD}{SPACE}'.]", " "))


def lower_first(col: str | Column) -> Column:
    """Lower-case an ASCII capital in first place."""
    c = _c(col)
    return F.when(c.rlike("^[A-Z]"), F.concat(F.lower(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))).otherwise(c)


def shorten(col: str | Column, n: int) -> Column:
    """One line of at most ``n`` characters; trailing punctuation gives way to an ellipsis."""

    def cut(flat: Column) -> Column:
        head = F.regexp_replace(F.substring(flat, 1, n - 1), r"[ ,.，。、]+$", "")
        return F.when(F.length(flat) <= n, flat).otherwise(F.concat(head, F.lit("…")))

    return let(squeeze(F.coalesce(_c(col), F.lit(""))), cut)


def md_truncate(col: str | Column, n: int) -> Column:
    """Cut markdown at a line end when one lies in the last 200 characters."""
    base = strip(F.coalesce(_c(col), F.lit("")))
    base = F.regexp_replace(F.regexp_replace(base, r"\n{3,}", "\n\n"), r"[ \t]+", " ")

    def cut(whole: Column) -> Column:
        head = F.substring(whole, 1, n)
        last_break = F.length(head) - F.instr(F.reverse(head), "\n")  # 0-based
        usable = (F.instr(head, "\n") > 0) & (last_break > n - 200)
        at_line = F.when(usable, F.substr(head, F.lit(1), last_break)).otherwise(head)
        return F.when(F.length(whole) <= n, whole).otherwise(F.concat(F.regexp_replace(at_line, r"[ ,.，。、\n]+$", ""), F.lit("…")))

    return let(base, cut)


def first_para(col: str | Column) -> Column:
    """First paragraph of more than 15 characters, else the whole text."""

    def pick(base: Column) -> Column:
        paragraphs = F.transform(F.split(base, r"\n\n+"), strip)
        return F.coalesce(F.get(F.filter(paragraphs, lambda p: F.length(p) > 15), F.lit(0)), base)

    return let(strip(F.coalesce(_c(col), F.lit(""))), pick)


def hellaswag_clean(col: str | Column) -> Column:
    """``[title]`` markers to sentence ends, other bracket spans out, double blanks halved."""
    base = F.replace(strip(_c(col)), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(base, r"\[[^\n]*?\]", ""), F.lit("  "), F.lit(" "))


def decode_unicode_escapes(col: Column) -> Column:
    r"""``\uXXXX`` and ``\UXXXXXXXX`` spelled out in the text become characters."""
    parts = matches(col, r"\\U[0-9A-Fa-f]{8}|\\u[0-9A-Fa-f]{4}|[^\\]+|\\")

    def decode(p: Column) -> Column:
        return (
            F.when(p.rlike(r"^\\u[0-9A-Fa-f]{4}$"), F.decode(F.unhex(F.substring(p, 3, 4)), "UTF-16BE"))
            .when(p.rlike(r"^\\U[0-9A-Fa-f]{8}$"), F.decode(F.unhex(F.substring(p, 3, 8)), "UTF-32"))
            .otherwise(p)
        )

    return F.when(F.instr(col, "\\") > 0, F.array_join(F.transform(parts, decode), "")).otherwise(col)


def snippet(col: str | Column, least: int = 20, most: int = 30) -> Column:
    """Result snippet of 20 to 30 words, ended at a sentence end where one is near.

    Length and the taste for commas come from a hash of the text instead of
    unseeded random numbers, so the same text always gives the same snippet.
    """

    def from_text(text: Column) -> Column:
        target = (F.lit(least) + F.pmod(F.xxhash64(text), F.lit(most - least + 1))).cast("int")
        return let(F.struct(F.split(text, " ").alias("words"), target.alias("target"), text.alias("text")), from_words)

    def from_words(s: Column) -> Column:
        whole = F.size(s["words"]) <= F.greatest(s["target"], F.lit(least))
        return F.when(whole, s["text"]).otherwise(let(F.slice(s["words"], 1, s["target"]), lambda cut: shortened(cut, s["target"])))

    def shortened(cut: Column, target: Column) -> Column:
        joined = F.array_join(cut, " ")

        def stops(i: Column) -> Column:
            word = F.element_at(cut, i)
            comma = word.endswith(",") & (F.pmod(F.xxhash64(word, i), F.lit(10)) < 4)
            return word.rlike(r"[.?!]$") | comma

        last = F.element_at(cut, -1)
        ends = last.rlike(r"[.?!]$") | (last.endswith(",") & (F.pmod(F.xxhash64(joined), F.lit(10)) < 3))
        stop = F.get(F.filter(F.sequence(target, F.greatest(F.lit(1), target - 8) + 1, F.lit(-1)), stops), F.lit(0))
        at_stop = F.array_join(F.slice(cut, 1, stop), " ")
        return F.when(ends, joined).otherwise(F.coalesce(at_stop, F.concat(F.regexp_replace(joined, r"[,.?!]+$", ""), F.lit("..."))))

    return let(squeeze(decode_unicode_escapes(F.coalesce(_c(col), F.lit("")))), from_text)


def render_prompt(template: str, **columns: Column) -> Column:
    """Fill ``{name}`` places of a literal template with columns, in one pass."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    pieces = [F.lit(p) if i % 2 == 0 else F.coalesce(columns[p].cast("string"), F.lit("")) for i, p in enumerate(parts)]
    return F.concat(*pieces)
