"""Line dedup (operator 7): deletion-neighbourhood join with column functions only.

A line is removed if an earlier one (by doc_id, then text hash, then line
number) is within one word of it: equal, or one word inserted, deleted or
replaced. Lines under ``min_words`` words are only removed if equal, blank
lines never. White space inside a line counts as one blank.

Variants with one word deleted are emitted as hashed keys. Two lines of n words
that agree on the variant at the same place differ by one replaced word; a line
that equals a variant of another differs by one inserted word. The key of a
variant comes from sums over the line's words less those at the place, so it
costs no pass over the line. Lines whose keys meet are verified on a strong hash
of the variants themselves, and the earliest is found by aggregation: no pair of
lines is ever formed, however many lines share a variant.

Only lines that can have a neighbour emit variants: of two lines within one
word of each other, one half is equal, so lines are first grouped by the hashes
of their halves. That loses nothing, and leaves few lines to expand.

Defined cases: null texts are empty; a text without lines to keep becomes
empty and stays as a row; equal rows (same id, same text) are judged alike and
keep what either keeps; null ids come first; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutmill.llm.quality_rules import SPACES
from scoutmill.session import keep

PLACE = ["doc_id", "text_hash", "line_no"]
LINE = ["h1", "h2"]


def one_blank(line: Column) -> Column:
    """The line's words with one blank between them."""
    for space in SPACES[1:]:
        line = F.replace(line, F.lit(space), F.lit(" "))
    line = F.trim(line)
    return F.when(F.contains(line, F.lit("  ")), F.regexp_replace(line, " {2,}", " ")).otherwise(line)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"), *more)


def half_keys(line: Column, n: Column) -> Column:
    """Hashes of the line without its second or its first half, as a line of n words and as one of n - 1 words cuts it."""
    keys = []
    for base in (n, n - 1):
        cut = F.floor(base / 2).cast("int")
        keys.append(F.xxhash64(F.lit("head"), base, F.call_function("substring_index", line, F.lit(" "), cut)))
        keys.append(F.xxhash64(F.lit("tail"), base, F.call_function("substring_index", line, F.lit(" "), -(base - cut))))
    return F.array(*keys)


def mark_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per line that is not blank: its place, two hashes, and the keys of its halves if it is long enough; kept."""
    raw = keyed(docs).select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    lines = raw.where(F.trim("raw", F.lit(SPACES)) != "").select(*PLACE, one_blank(F.col("raw")).alias("line"))
    # Columns used many times are given a step of their own, so that they are computed once.
    lines = lines.select(*PLACE, "line", (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("n"))
    return keep(lines.select(
        *PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"),
        F.when(F.col("n") >= min_words, half_keys(F.col("line"), F.col("n"))).alias("halves")))


def neighbour_lines(docs: DataFrame, marks: DataFrame, classes: DataFrame) -> DataFrame:
    """(h1, h2, first, words) of the distinct lines that share a half with another line; kept."""
    halves = marks.select(F.explode("halves").alias("half"), *LINE)
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("half")
    wanted = keep(halves.join(shared, "half").select(*LINE).distinct().join(classes, LINE).select(*[f"first.{c}" for c in PLACE], *LINE))
    by_text = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line_no", *LINE)).alias("wanted")).alias("w")
    texts = keyed(docs).alias("d")
    found = texts.join(by_text, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash")))
    lines = found.select("d.doc_id", "d.text_hash", F.split("text", "\n", -1).alias("lines"), "wanted")
    picked = lines.select("doc_id", "text_hash", F.explode(F.transform("wanted", lambda w: F.struct(
        w["line_no"].alias("line_no"), w["h1"].alias("h1"), w["h2"].alias("h2"), F.get("lines", w["line_no"]).alias("line")))).alias("p"))
    out = picked.select(*[F.col(f"p.{c}").alias(c) for c in LINE], F.struct("doc_id", "text_hash", F.col("p.line_no").alias("line_no")).alias("first"),
                        F.split(one_blank(F.col("p.line")), " ").alias("words"))
    return keep(out.dropDuplicates(LINE))


def small_hash(*columns: Column) -> Column:
    """40 bits of a hash: sums of up to 2**23 of them fit a long."""
    return F.shiftright(F.xxhash64(*columns), 24)


def variant_keys(lines: DataFrame) -> DataFrame:
    """(h1, h2, role, at, key): for every word of a line its deletion in both families, and the whole line in one.

    ``same``: the sum of hashes of (place, word), less the deleted word's: equal
    for lines that differ at that place alone. ``less``: the sum of hashes of
    neighbouring words, with the two around the deleted word closed up; ``whole``
    is that sum of the line itself.
    """
    n = F.size("words")
    link = lambda a, b: small_hash(F.lit("link"), a, b)
    at_place = F.transform("words", lambda w, i: small_hash(F.lit("place"), i, w))
    padded = F.concat(F.array(F.lit("")), F.col("words"), F.array(F.lit("")))
    hashed = lines.select(*LINE, n.alias("n"), padded.alias("padded"), at_place.alias("at_place"))
    links = F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: link(F.get("padded", i), F.get("padded", i + 1)))
    hashed = hashed.select(*LINE, "n", "padded", "at_place", links.alias("links"))
    total = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda acc, x: acc + x)
    summed = hashed.select(*LINE, "n", "padded", "at_place", "links", total("at_place").alias("places"), total("links").alias("all_links"))
    same = lambda i: F.xxhash64(F.lit("same"), F.col("n"), i, F.col("places") - F.get("at_place", i))
    closed = lambda i: F.col("all_links") - F.get("links", i) - F.get("links", i + 1) + link(F.get("padded", i), F.get("padded", i + 2))
    less = lambda i: F.xxhash64(F.lit("less"), F.col("n") - 1, closed(i))
    key = lambda role, at, k: F.struct(F.lit(role).alias("role"), at.alias("at"), k.alias("key"))
    places = F.sequence(F.lit(0), F.col("n") - 1)
    keys = F.concat(
        F.transform(places, lambda i: key("same", i, same(i))), F.transform(places, lambda i: key("less", i, less(i))),
        F.array(key("whole", F.lit(-1), F.xxhash64(F.lit("less"), F.col("n"), F.col("all_links")))))
    return summed.select(*LINE, F.inline(keys))


def nearest_earlier(lines: DataFrame) -> DataFrame:
    """(h1, h2, near): the earliest other line within one word, for the lines that have one."""
    keys = variant_keys(lines)
    met = keys.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key")
    # The variants themselves, of the few rows whose keys meet.
    rows = keys.join(met, "key").join(lines, LINE)
    rest = F.concat(F.slice("words", F.lit(1), F.greatest(F.col("at"), F.lit(0))), F.slice("words", F.col("at") + 2, F.size("words")))
    content = F.when(F.col("role") == "whole", F.array_join("words", " ")).otherwise(F.array_join(rest, " "))
    group = F.sha2(F.concat_ws("\n", F.when(F.col("role") == "same", F.concat(F.lit("same"), F.col("at").cast("string"))).otherwise(F.lit("less")), content), 256)
    members = keep(rows.select(*LINE, "role", "first", group.alias("group")))
    earliest = members.groupBy("group").agg(*[F.min(F.when(F.col("role") == r, F.col("first"))).alias(r) for r in ("same", "less", "whole")])
    # A replaced word is found in the same role, an inserted one between a variant and a whole line.
    other = F.when(F.col("role") == "same", F.col("same")).when(F.col("role") == "less", F.col("whole")).otherwise(F.col("less"))
    return members.join(earliest, "group").select(*LINE, other.alias("near")).groupBy(*LINE).agg(F.min("near").alias("near"))


def removed_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """(doc_id, text_hash, removed): numbers of the lines to remove, for the texts that lose any."""
    marks = mark_lines(docs, min_words)
    classes = keep(marks.groupBy(*LINE).agg(F.min(F.struct(*PLACE)).alias("first")))
    near = nearest_earlier(neighbour_lines(docs, marks, classes))
    # Kept, so that the join below has two plain shuffles and Spark can split the class of a very common line.
    verdict = keep(classes.join(near, LINE, "left").select(*LINE, F.least("first", F.coalesce("near", "first")).alias("earliest")))
    gone = marks.select(*PLACE, *LINE).join(verdict, LINE).where(~F.struct(*PLACE).eqNullSafe(F.col("earliest")))
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def same_text(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.text_hash") == F.col(f"{right}.text_hash"))


def dedup_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """The input's rows and columns with removed lines taken out of ``text``."""
    gone = removed_lines(docs, min_words).alias("g")
    text = F.coalesce(F.col("d.text"), F.lit(""))
    # The input's columns travel in one, out of the way of the names used here.
    whole = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.struct(
        *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")).alias("d")
    rows = whole.join(gone, same_text("d", "g"), "left")
    lines = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    kept = F.when(F.col("removed").isNull(), F.col("d.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return rows.select(*[kept.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def line_report(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed and the removed line numbers."""
    gone = removed_lines(docs, min_words).alias("g")
    rows = keyed(docs).select("doc_id", "text_hash", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines")).alias("d")
    removed = F.coalesce(F.col("removed"), F.array().cast("array<int>"))
    return rows.join(gone, same_text("d", "g"), "left").select(
        F.col("d.doc_id").alias("doc_id"), "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"))
