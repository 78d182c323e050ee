"""Toxicity (operator 1): noisy-channel deobfuscation, then a score of the restored text.

A written form is taken as a word sent through a channel that swaps letters for
look-alikes, puts marks or blanks between letters and repeats letters. Each
form spans a lattice of possible letters; the Viterbi path under a character
trigram model and the channel's costs is the restored wording. Scores come from
restored words: whole words and their beginnings carry evidence, the log ratio
of how many toxic and clean training texts hold them, and a logistic model over
a document's strongest evidence gives the probability. A long text is not
judged by its length: one insult among thousands of words stands out as such.

The trigram counts are summed over all documents (a bounded alphabet, so at
most 64**3 rows reach the driver). Evidence is learned from a sample of at most
``2 * per_class`` labelled rows and keeps at most ``max_terms`` terms; three
quarters of the sample give counts, the rest calibrate. Nothing is shuffled but
those counts, and scoring is per row in Arrow batches.

Defined cases: null and empty texts hold no words and get the score of no
evidence; without labels of both classes scores are constant; repeated rows
are scored each; extra columns are left out.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutmill.llm.labelled import Logistic, class_counts, fit_logistic, labelled_sample

# The model's letters (place 0 is the edge of a word, the last one any other letter).
LETTERS = " abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"
OTHER = 63
SIZE = 64
# What look-alikes can stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c", "×": "x", "%": "x", "#": "h", "¢": "c", "§": "s", "µ": "u",
}
SWAPPED, AS_MARK, DROPPED, PARTED, SQUEEZED, DOUBLED = 1.0, 6.0, 1.0, 1.5, 1.5, 2.5  # costs of the channel

# Words of small letters only, without a letter three times in a row, are what they seem.
PLAIN = re.compile(r"[^\W\d_]+\Z")
RUN = re.compile(r"(.)\1\1")
LETTER = re.compile(r"[^\W\d_]")
# Single signs with one mark or blank between them, at least four.
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")
LEAD, TAIL = "\"'([{<*#-_.,;:?%&~/\\`«“„", "\"')]}>*#-_.,;:!?%&~/\\|`»”"
MIN_PREFIX, MAX_PREFIX = 3, 7
TOP = 3
STORE_WORDS = 600_000


def letter_codes() -> np.ndarray:
    """Code of every character up to U+024F: edge, a letter of the model, or any other letter."""
    codes = np.zeros(0x250, dtype=np.int64)
    for point in range(0x250):
        small = chr(point).lower()
        codes[point] = LETTERS.index(small) if small in LETTERS else OTHER if small.isalpha() else 0
    return codes


CODES = letter_codes()
CODE_OF = {c: i for i, c in enumerate(LETTERS)}


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all documents; each task adds its own up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                points = np.frombuffer(f"  {text or ''} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
                codes = np.where(points < 0x250, CODES[np.minimum(points, 0x24F)], OTHER)
                total += np.bincount((codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:], minlength=SIZE**3) if len(codes) > SIZE**2 else 0
                if len(codes) <= SIZE**2:
                    np.add.at(total, (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE**3)
    for gram, n in rows:
        counts[gram] = n
    return counts


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """-log of the probability of a letter after two others, smoothed by bigrams and single letters."""
    grams = counts.reshape(SIZE, SIZE, SIZE)
    pairs, single = grams.sum(0), grams.sum((0, 1))
    p1 = (single + 1) / (single.sum() + SIZE)
    p2 = (pairs + 20 * p1) / (pairs.sum(1, keepdims=True) + 20)
    p3 = (grams + 10 * p2[None]) / (grams.sum(2, keepdims=True) + 10)
    return -np.log(p3)


def restore(form: str, costs: np.ndarray) -> str:
    """The cheapest wording behind a written form (small letters in the result, blanks between words)."""
    # State: the last two codes; value: cost and wording so far.
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for run in re.finditer(r"(.)\1*", form.lower(), re.S):
        sign, times = run[1], len(run[0])
        options: list[tuple[float, str]] = []
        if LETTER.match(sign):
            letters, price = sign, 0.0
        else:
            letters, price = LOOK_ALIKES.get(sign, ""), SWAPPED
            options += [(AS_MARK if letters else PARTED, " ")]
            if not letters:
                options += [(DROPPED, "")]
        for letter in letters:
            if times == 1:
                options.append((price, letter))
            else:
                options += [(price + SQUEEZED if times == 2 else price, letter), (price + DOUBLED if times > 2 else price, letter * 2)]
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, wording) in states.items():
            for extra, letters_ in options:
                p, q, total = a, b, cost + extra
                for letter in letters_:
                    c = CODE_OF.get(letter, OTHER)
                    if c == 0 and q == 0:
                        continue
                    total += costs[p, q, c]
                    p, q = q, c
                if (p, q) not in after or total < after[p, q][0]:
                    after[p, q] = (total, wording + letters_)
        states = after
    ends = [(cost + costs[a, b, 0], wording) for (a, b), (cost, wording) in states.items()]
    return min(ends)[1].strip()


def suspicious(word: str) -> bool:
    """A form with letters that is not plainly a word."""
    return bool(LETTER.search(word)) and (not PLAIN.match(word) or bool(RUN.search(word)))


def restored_words(word: str, costs: np.ndarray) -> list[str]:
    """Words behind one white-space delimited form."""
    core = word.lower().lstrip(LEAD).rstrip(TAIL)
    if core.endswith("$$$"):
        core = core.rstrip("$" + TAIL)
    if not suspicious(core):
        return [core] if core and PLAIN.match(core) else []
    return restore(core, costs).split()


def terms_of(word: str) -> list[str]:
    """What carries evidence: the word, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in range(MIN_PREFIX, min(MAX_PREFIX, len(word)) + 1))]


def text_words(text: str, costs: np.ndarray) -> set[str]:
    """Restored words of a text, with those of spaced-out stretches."""
    words = {r for w in set(text.split()) for r in restored_words(w, costs)}
    for stretch in SPACED.findall(text):
        words.update(restore(stretch, costs).split())
    return words


@dataclass
class ToxicityModel:
    """Costs of the letter model, evidence of terms, and the calibration."""

    costs: np.ndarray
    evidence: dict[str, float]
    calibration: Logistic


def term_counts(sample: DataFrame, costs: np.ndarray, wanted: set[str] | None) -> DataFrame:
    """(term, n): texts that hold each term, among ``wanted`` ones if given; added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                terms = {t for w in text_words(text or "", costs) for t in terms_of(w)}
                total.update(terms if wanted is None else terms & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    return sample.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Judge:
    """Strongest evidence of texts; remembers the evidence of words it has met."""

    def __init__(self, costs: np.ndarray, evidence: dict[str, float]):
        self.costs, self.evidence, self.words = costs, evidence, {}

    def of_word(self, word: str) -> float:
        return max((self.evidence.get(t, 0.0) for r in restored_words(word, self.costs) for t in terms_of(r)), default=0.0)

    def features(self, text: str) -> list[float]:
        """The strongest evidence of different words, and how many words there are."""
        if len(self.words) > STORE_WORDS:
            self.words.clear()
        known, words = self.words, set(text.split())
        for word in words:
            if word not in known:
                known[word] = self.of_word(word)
        found = [known[w] for w in words if known[w] > 0.0]
        for stretch in SPACED.findall(text):
            found.append(max((self.evidence.get(t, 0.0) for r in restore(stretch, self.costs).split() for t in terms_of(r)), default=0.0))
        top = heapq.nlargest(TOP, found) + [0.0] * TOP
        return [*top[:TOP], math.log1p(len(words)), math.log1p(sum(e > 3.5 for e in found))]


N_FEATURES = TOP + 2


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 10_000, min_texts: int = 4, max_terms: int = 20_000,
) -> ToxicityModel:
    """Letter model over all documents, evidence and calibration from labels for which ``usable`` (over ``doc_id``) holds."""
    costs = trigram_costs(count_trigrams(docs))
    sample = labelled_sample(docs, labels, "toxic", usable, per_class)
    counted, held = sample.where("part < 75"), sample.where("part >= 75")
    sizes = {r[0]: r[1] for r in counted.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    evidence: dict[str, float] = {}
    if toxic and clean:
        common = term_counts(counted.where("label = 1"), costs, None).where(F.col("n") >= min_texts)
        seen = {r[0]: r[1] for r in common.orderBy(F.desc("n"), "term").limit(10 * max_terms).collect()}
        other = {r[0]: r[1] for r in term_counts(counted.where("label = 0"), costs, set(seen)).collect()}
        ratio = {t: math.log((n + 0.5) / (toxic + 1)) - math.log((other.get(t, 0) + 0.5) / (clean + 1)) for t, n in seen.items()}
        best = heapq.nlargest(max_terms, ((r, t) for t, r in ratio.items() if r > 1.0))
        evidence = {t: r for r, t in best}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = worker_judge(costs, evidence)
        for batch in batches:
            values = [judge.features(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "label", "features"])

    rows = held.select("doc_id", "label", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, features array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["features"]))
    x, y = np.array([r["features"] for r in rows]).reshape(-1, N_FEATURES), np.array([r["label"] for r in rows])
    totals = class_counts(labels, "toxic", usable)
    weight = np.where(y == 1, totals.get(1, 0) / max(1, (y == 1).sum()), totals.get(0, 0) / max(1, (y == 0).sum()))
    return ToxicityModel(costs, evidence, fit_logistic(x, y, weight))


JUDGES: list[tuple[int, Judge]] = []


def worker_judge(costs: np.ndarray, evidence: dict[str, float]) -> Judge:
    """The worker's judge for a model; kept, so that its store of words serves all its tasks."""
    mark = hash((float(costs.sum()), len(evidence), round(sum(evidence.values()), 9)))
    if not JUDGES or JUDGES[0][0] != mark:
        JUDGES[:] = [(mark, Judge(costs, evidence))]
    return JUDGES[0][1]


def score(docs: DataFrame, model: ToxicityModel, keys: list[str]) -> DataFrame:
    """``keys``, ``score`` (0 to 1, higher is more likely toxic) and the strongest single ``evidence``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = worker_judge(model.costs, model.evidence)
        for batch in batches:
            x = np.array([judge.features(t or "") for t in batch.column(len(keys)).to_pylist()]).reshape(-1, N_FEATURES)
            columns = [*batch.columns[: len(keys)], pa.array(model.calibration.score(x), pa.float64()), pa.array(x[:, 0], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "score", "evidence"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}, score double, evidence double")
