"""Benchmark decontamination (operator 3): CGK random walks, bit-sampling LSH, exact edit verification.

The CGK embedding walks over a window of words and, at every step, writes the
word it stands on and moves on by a random bit that depends on step and word.
A walk stays in its window, so windows without an edit have equal walks. Of an
item of n words with k edits, n - k words at least stay, in k + 1 runs at most:
one run holds ceil((n - k) / (k + 1)) words or more. Windows of that length at
every word of item and document therefore meet whatever the edits are, and the
search misses no item within the distance. A hash of the sampled steps of all
walks finds the windows that agree, their words are compared, and each
agreement is verified by the exact word edit distance between the item and the
best stretch of the document around it.

Items are read in blocks of bounded size, each shipped to one pass over the
documents; documents are never shuffled or cut.

Defined cases: null or empty texts and items match nothing; items under four
words must match exactly in all words that the distance allows (one edit in five
words); repeated rows are judged each, a document is reported once per item with
its best place; ties go to the earliest; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutmill.llm.shingles import mix

# Marks around words that do not count.
MARKS = "\"'“”‘’«»„()[]{}<>.,;:!?…*_#-–—|/\\`~"
#: Longest window; items whose runs without an edit are longer have several in each.
LONGEST = 16
SAMPLED = 5
#: Items of one pass: their words together stay below this.
BLOCK_WORDS = 1_000_000
CHUNK_WORDS = 400_000
STORE_WORDS = 600_000


def plain_words(text: str | None) -> list[str]:
    """Small-letter words without the marks around them."""
    return [w for w in (t.strip(MARKS) for t in (text or "").lower().split()) if w]


def largest_distance(n: int, share: float) -> int:
    return int(n * share + 1e-9)


def sure_window(n: int, share: float) -> int:
    """Words of the longest run that every allowed edit of an item of ``n`` words leaves as it is, up to ``LONGEST``."""
    edits = largest_distance(n, share)
    return max(1, min(LONGEST, -(-(n - edits) // (edits + 1))))


def edit_in(item: list[int], text: list[int]) -> tuple[int, int]:
    """(distance, end) of the best stretch of ``text`` for ``item``, by bit-parallel dynamic programming; the earliest end wins ties."""
    places: dict[int, int] = {}
    for i, word in enumerate(item):
        places[word] = places.get(word, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << len(item) - 1
    plus, minus, score = full, 0, len(item)
    best = (score, 0)
    for j, word in enumerate(text, 1):
        eq = places.get(word, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full  # a stretch may start anywhere
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, j)
    return best


def sampled_steps(window: int, seed: int) -> list[int]:
    """One step from each part of the walk: neighbouring steps often stand on one word and would tell little."""
    parts = min(SAMPLED, window)
    rng = np.random.default_rng(seed * 31 + window)
    return [int(rng.integers(window * k // parts, window * (k + 1) // parts)) for k in range(parts)]


def turns_of(words: np.ndarray, seed: int) -> np.ndarray:
    """A walk's bits: bit ``step`` of a word's number here is whether the walk moves on from it at that step."""
    with np.errstate(over="ignore"):
        return mix(words + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64))


def walk(words: np.ndarray, turns: np.ndarray, starts: np.ndarray, steps: int) -> Iterator[np.ndarray]:
    """Words under the walk at each step, from every start; a step moves by at most one word, so a walk stays in its window."""
    at = starts.copy()
    for step in range(steps):
        yield words[at]
        at += (turns[at] >> np.uint64(step) & np.uint64(1)).astype(at.dtype)


def walk_keys(words: np.ndarray, turns: np.ndarray, starts: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Hash of the sampled steps of the walk from every start."""
    sampled = sampled_steps(window, seed)
    key = np.full(len(starts), seed + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for step, here in enumerate(walk(words, turns, starts, sampled[-1] + 1)):
            if step in sampled:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + here)
    return key


@dataclass
class ItemBlock:
    """Items of one pass: their words as numbers, and for each window size the sorted keys with item and place."""

    ids: list
    vocabulary: dict[str, int]
    items: list[list[int]]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    starts: np.ndarray
    flat: np.ndarray
    walks: int


def word_number(at: int) -> int:
    """Numbers spread over 64 bits, so that products with them have even top bits; 0 is any other word."""
    return int(mix(np.array([at + 1], dtype=np.uint64))[0]) | 1


def joined_keys(words: np.ndarray, starts: np.ndarray, window: int, walks: int) -> np.ndarray:
    """Hash of the sampled steps of all walks from every start."""
    key = np.zeros(len(starts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for seed in range(walks):
            key = mix(key + walk_keys(words, turns_of(words, seed), starts, window, seed))
    return key


def build_block(rows: list[tuple], share: float, walks: int) -> ItemBlock:
    vocabulary: dict[str, int] = {}
    ids, items = [], []
    for name, words in rows:
        ids.append(name)
        items.append([vocabulary.setdefault(w, word_number(len(vocabulary))) for w in words])
    flat = np.array([w for words in items for w in words], dtype=np.uint64)
    first = np.cumsum([0, *map(len, items)])
    windows = [sure_window(len(words), share) for words in items]
    tables = {}
    for window in sorted(set(windows)):
        own = [(i, len(words) - window + 1) for i, words in enumerate(items) if windows[i] == window]
        item = np.array([i for i, n in own for _ in range(n)], dtype=np.int64)
        place = np.array([k for _, n in own for k in range(n)], dtype=np.int64)
        keys = joined_keys(flat, first[item] + place, window, walks)
        order = np.argsort(keys, kind="stable")
        tables[window] = (keys[order], item[order], place[order])
    return ItemBlock(ids, vocabulary, items, tables, first, flat, walks)


def distinct_rows(*columns: np.ndarray) -> Iterator[tuple[int, ...]]:
    """Distinct rows of integer columns, in order; kept apart as columns, so no product of their ranges can wrap."""
    order = np.lexsort(columns[::-1])
    sorted_ = [c[order] for c in columns]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_])
    return zip(*(c[new].tolist() for c in sorted_), strict=True)


class Numbers(dict):
    """Number of a written form: of its plain word in the items, 0 for all others, None for marks alone."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, form: str) -> int:
        word = form.strip(MARKS)
        self[form] = number = self.vocabulary.get(word, 0) if word else -1
        return number


def find_in(texts: list[str], block: ItemBlock, numbers: Numbers, share: float) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, start, end) of the best verified stretch for every text and item that meet; places count words."""
    parts, owners, bases, base = [], [], [], 0
    for i, text in enumerate(texts):
        own = np.array([n for n in map(numbers.__getitem__, text.lower().split()) if n >= 0], dtype=np.uint64)
        bases.append(base)
        base += len(own)
        parts.append(own)
        owners.append(len(own))
    words = np.concatenate([*parts, np.zeros(LONGEST, dtype=np.uint64)])
    owner = np.repeat(np.arange(len(texts)), owners)
    met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    known, reach = np.arange(base, dtype=np.int64), 0
    for window, (keys, item, place) in block.tables.items():
        for step in range(reach, window):  # windows grow, and all their words must be of items
            known = known[words[known + step] != 0]
        reach = window
        found = joined_keys(words, known, window, block.walks)
        low = np.searchsorted(keys, found, "left")
        hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == found)
        high = np.searchsorted(keys, found[hit], "right")
        counts = high - low[hit]
        which = np.repeat(low[hit], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(known[hit], counts)
        # Walks need not stand on every word of their window: the words themselves decide.
        theirs = block.starts[item[which]] + place[which]
        same = np.logical_and.reduce([words[at + step] == block.flat[theirs + step] for step in range(window)])
        at, which = at[same], which[same]
        met.append((owner[at], item[which], (at - place[which]) // 8))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for t, i, slot in distinct_rows(*map(np.concatenate, zip(*met, strict=True))) if met else ():
        target = block.items[i]
        limit = largest_distance(len(target), share)
        low, high = max(0, slot * 8 - bases[t] - limit), min(owners[t], slot * 8 - bases[t] + 8 + len(target) + limit)
        stretch = parts[t][low:high].tolist()
        if high - low < len(target) - limit or len(set(target) & set(stretch)) < len(set(target)) - limit:
            continue
        distance, end = edit_in(target, stretch)
        if distance > limit:
            continue
        _, length = edit_in(target[::-1], stretch[:end][::-1])
        found_ = (distance, low + end - length, low + end)
        if (t, i) not in best or found_ < best[t, i]:
            best[t, i] = found_
    return [(t, i, *rest) for (t, i), rest in best.items()]


def item_blocks(items: DataFrame, key: str) -> Iterator[list[tuple]]:
    """Items as (key, words), in blocks of bounded size."""
    rows, size = [], 0
    for name, text in items.select(key, "text").orderBy(key).toLocalIterator():
        words = plain_words(text)
        if not words:
            continue
        rows.append((name, words))
        size += len(words)
        if size >= BLOCK_WORDS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def leaks_of_block(docs: DataFrame, rows: list[tuple], share: float, walks: int, item_type: str) -> DataFrame:
    block = build_block(rows, share, walks)
    arrow_item = pa.array(block.ids).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(block.vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and size < CHUNK_WORDS * 6:
                    size += len(texts[high])
                    high += 1
                if len(numbers) > STORE_WORDS:
                    numbers.clear()
                found = find_in(texts[low:high], block, numbers, share)
                if found:
                    t, i, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([low + x for x in t])), pa.array([block.ids[x] for x in i], arrow_item), *(pa.array(r, pa.int64()) for r in rest)],
                        names=["doc_id", "item_id", "distance", "start_word", "end_word"])
                low = high

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id {item_type}, distance long, start_word long, end_word long")


def find_leaks(docs: DataFrame, items: DataFrame, share: float = 0.2, walks: int = 4) -> DataFrame:
    """(doc_id, item_id, distance, start_word, end_word): items that a document holds within ``share`` of their words edited.

    ``items`` has ``item_id`` and ``text``. All such items are found; more
    ``walks`` from every word only make chance agreements of windows rarer.
    """
    item_type = items.schema["item_id"].dataType.simpleString()
    out = None
    for rows in item_blocks(items, "item_id"):
        found = leaks_of_block(docs, rows, share, walks, item_type)
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {item_type}, distance long, start_word long, end_word long")
    return out


def without_leaks(docs: DataFrame, items: DataFrame, share: float = 0.2, walks: int = 4) -> DataFrame:
    """The documents that hold no item; a document is its id and its text, so others of its id stay."""
    text = F.md5(F.coalesce("text", F.lit("")))
    keyed = docs.select(F.struct("doc_id", text.alias("text_hash")).alias("doc_id"), "text")
    leaks = find_leaks(keyed, items, share, walks).select("doc_id.doc_id", "doc_id.text_hash").distinct().alias("l")
    same = F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d._text_hash") == F.col("l.text_hash"))
    return docs.withColumn("_text_hash", text).alias("d").join(leaks, same, "left_anti").drop("_text_hash")
