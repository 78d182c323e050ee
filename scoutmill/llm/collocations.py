"""Phrase collocation mining (operator 12) over count streams in prefix and suffix order.

Phrases of one to five words are counted exactly per language. A part of a
phrase stands wherever the phrase does, so a phrase can reach ``least`` only
where all its parts do: words are counted first, then pairs of such words, then
longer runs of such pairs. What a level passes on is a bit filter of at most
``FILTER_BITS`` bits; it may let a phrase through that is counted in vain, never
hold one back, and the counts that follow are exact whatever it let through.
Each task counts its texts in chunks before anything is shuffled, so a word or
passage that fills a third of the corpus arrives as one row per task.

The counts of frequent phrases then form streams. In prefix order (sorted by
the words before a cut) a merge join gives the left count; sorted again in suffix order
(by the words after it), a second one the right count; and the
stream of phrases less their last or first word gives, in one more lockstep
pass, the most frequent one-word extension. Joins are sort-merge joins; no side
is hashed into memory, and Spark splits a prefix that many phrases share.

A longer phrase that hides a candidate hides it through a one-word extension as
well: what lies between them is at least as frequent as the longer one.

Defined cases: a null text is empty and an empty text has no words; a null
language is ``und``; repeated rows count each; ties of the score go by count,
then by phrase; phrases never cross a piece's end; an empty table gives an
empty result; extra columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoutmill.session import keep

LONGEST = 5
#: Upper bound of a level's filter: 16 MB.
FILTER_BITS = 1 << 27
#: Words that a task holds before it counts them.
CHUNK_WORDS = 1 << 19
WIDE = "decimal(38,0)"

# A-Z in small letters, the marks and line ends that part pieces as \n, tabs as blanks.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
BREAK = b""  # stands between pieces in a list of words


def words_of(text: bytes) -> list[bytes]:
    """Words of all pieces, with a BREAK after each piece."""
    words: list[bytes] = []
    for piece in text.translate(FOLD).split(b"\n"):
        if found := piece.split():
            words += found
            words.append(BREAK)
    return words


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_WORDS) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words of several texts) with about ``most`` words over all languages held at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of(text.as_py())
            size += len(words)
            held.setdefault(lang, []).extend(words)
            if size >= most:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


class Filter:
    """Two bits per phrase in a table of ``bits`` (a power of two); the table is shipped once to each worker."""

    def __init__(self, frequent: DataFrame):
        """Of the rows (lang, phrase) of ``frequent``: sixteen bits for each, up to FILTER_BITS."""
        self.bits = 64
        count = frequent.count()
        while self.bits < min(16 * count, FILTER_BITS):
            self.bits *= 2
        hashed = F.xxhash64(F.concat("lang", F.lit("\n"), "phrase"))
        low = lambda c: c.bitwiseAND(F.lit(self.bits - 1))
        places = F.array(low(hashed), low(F.shiftrightunsigned(hashed, 32)))
        at = frequent.select(F.explode(places).alias("p")).select(F.shiftrightunsigned("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
        rows = at.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # at most bits / 64 rows
        table = np.zeros(self.bits // 64, dtype=np.uint64)
        table[rows.column("word").to_numpy()] = rows.column("bit").to_numpy().view(np.uint64)
        self.table = frequent.sparkSession.sparkContext.broadcast(table)

    def has(self, lang: str, phrases: list[bytes]) -> np.ndarray:
        """Which of ``phrases`` may be frequent."""
        import xxhash

        lead, table = lang.encode() + b"\n", self.table.value
        hashed = np.fromiter((xxhash.xxh64_intdigest(lead + p, 42) for p in phrases), dtype=np.uint64, count=len(phrases))  # as Spark's xxhash64
        found = np.ones(len(phrases), dtype=bool)
        for h in (hashed, hashed >> np.uint64(32)):
            at = h & np.uint64(self.bits - 1)
            found &= (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def count_words(lang: str, words: list[bytes]) -> tuple[list, list[int]]:
    """Words and their counts; None stands for all words together."""
    found = Counter(words)
    breaks = found.pop(BREAK, 0)
    return [None, *found], [len(words) - breaks, *found.values()]


def coded(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words, and the number of each word among them."""
    names = list(dict.fromkeys(words))
    numbers = dict(zip(names, range(len(names)), strict=True))
    return names, np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))


def pairs_of(names: list[bytes], numbers: np.ndarray, usable: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of neighbouring usable words: phrases, counts, and where they stand with the number of the pair there."""
    at = np.flatnonzero(usable[numbers[:-1]] & usable[numbers[1:]])
    keys, inverse, counts = np.unique(numbers[at] * len(names) + numbers[at + 1], return_inverse=True, return_counts=True)
    phrases = [names[k // len(names)] + b" " + names[k % len(names)] for k in keys.tolist()]
    return phrases, counts, at, inverse


def count_pairs(usable: Filter) -> Callable:
    def count(lang: str, words: list[bytes]) -> tuple[list[bytes], list[int]]:
        names, numbers = coded(words)
        allowed = usable.has(lang, names) & np.array([n != BREAK for n in names])
        phrases, counts, _, _ = pairs_of(names, numbers, allowed)
        return phrases, counts.tolist()

    return count


def count_longer(usable: Filter, linked: Filter, longest: int) -> Callable:
    def count(lang: str, words: list[bytes]) -> tuple[list[bytes], list[int]]:
        names, numbers = coded(words)
        allowed = usable.has(lang, names) & np.array([n != BREAK for n in names])
        phrases, _, at, inverse = pairs_of(names, numbers, allowed)
        run = np.full(len(numbers), -1, dtype=np.int64)  # number of the phrase that starts here, -1 for none
        run[at] = np.where(linked.has(lang, phrases)[inverse], inverse, -1)
        found, found_counts = [], []
        for length in range(3, longest + 1):
            at = np.flatnonzero((run[:-1] >= 0) & (run[1:] >= 0))
            if not len(at):
                break
            _, first, inverse, counts = np.unique(run[at] * len(names) + numbers[at + length - 1], return_index=True, return_inverse=True, return_counts=True)
            found += [b" ".join(words[i : i + length]) for i in at[first].tolist()]
            found_counts += counts.tolist()
            run = np.full(len(numbers), -1, dtype=np.int64)
            run[at] = inverse
        return found, found_counts

    return count


def counted(texts: DataFrame, count: Callable, least: int) -> DataFrame:
    """Kept table (lang, phrase, f) of what ``count`` finds in chunks of ``texts``, from ``least`` on; a null phrase always stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in chunks(batches):
            phrases, counts = count(lang, words) if words else ([], [])
            for low in range(0, len(phrases), 50_000):
                part = phrases[low : low + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary()), pa.array(counts[low : low + 50_000], pa.int64())], names=["lang", "phrase", "f"])

    rows = texts.mapInArrow(run, "lang string, phrase binary, f long").select("lang", F.col("phrase").cast("string").alias("phrase"), "f")
    return keep(rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("phrase").isNull()))


def frequent_phrases(docs: DataFrame, least: int, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases up to ``longest`` words with f >= least, and (lang, n) with all words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    singles = counted(texts, count_words, least)
    words = singles.where("phrase is not null")
    usable = Filter(words)
    pairs = counted(texts, count_pairs(usable), least)
    grams = words.unionByName(pairs)
    if longest > 2:
        grams = grams.unionByName(counted(texts, count_longer(usable, Filter(pairs), longest), least))
    return grams.withColumn("words", F.size(F.split("phrase", " "))), singles.where("phrase is null").select("lang", F.col("f").alias("n"))


def merge_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Both sides sorted by (lang, part) and read in lockstep."""
    return left.join(right.hint("merge"), ["lang", "part"], how)


def cut_counts(grams: DataFrame) -> DataFrame:
    """(lang, phrase, a, k, l, r) for every cut of a phrase after its first k words."""
    words = F.split("phrase", " ")
    piece = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = grams.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("part"), piece(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    count = lambda name: grams.select("lang", F.col("phrase").alias("part"), F.col("f").alias(name))
    prefix_order = merge_join(cuts, count("l")).drop("part").withColumnRenamed("rest", "part")
    return merge_join(prefix_order, count("r")).drop("part")


def extension_counts(grams: DataFrame) -> DataFrame:
    """(lang, part, longer): the count of the most frequent phrase of one word more, before or behind."""
    words = F.split("phrase", " ")
    less_one = F.array(F.array_join(F.slice(words, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("words") - 1), " "))
    return grams.where("words > 2").select("lang", "f", F.explode(less_one).alias("part")).groupBy("lang", "part").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, least: int = 100, longest: int = LONGEST, hidden_percent: int = 100, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score (all counts long)."""
    grams, totals = frequent_phrases(docs, least, longest)
    wide = lambda c: F.col(c).cast(WIDE)
    cuts = cut_counts(grams).join(totals, "lang")
    scored = cuts.withColumn("product", F.lit(1000).cast(WIDE) * wide("a") * wide("n")).withColumn("score", F.expr(f"product div (cast(l as {WIDE}) * r)"))
    lowest = scored.groupBy("lang", F.col("phrase").alias("part")).agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    open_ = merge_join(lowest, extension_counts(grams), "left").where(F.col("longer").isNull() | (100 * wide("longer") < hidden_percent * wide("cut.a")))
    rows = open_.select("lang", F.col("part").alias("phrase"), "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
