"""Budget fitting, collocations and whitening against brute force, and on rows that are out of the ordinary."""

import itertools
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutmill.llm.budget_mix import fit_lengths, mix, target_sizes
from scoutmill.llm.collocations import collocations
from scoutmill.llm.whitening import whiten

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["size", "key", "row", "rank", "draw", "x", "f", "part", "phrase", "component", "index", "target", "place", "words"]


def docs_of(spark, rows):
    """Rows (doc_id, text, lang, source), with further columns of clashing names."""
    docs = spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], SCHEMA).repartition(3)
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("x"))
    return docs


# Budget fitting
def shares(sizes, weights=(5, 2, 1), most=3):
    """Round after round in fractions: the excess above a bound goes to the sources that are below theirs."""
    total, stopped = sum(sizes), set()
    while True:
        free = sum(weights[i % 3] for i in range(len(sizes)) if i not in stopped)
        left = total - sum(most * sizes[i] for i in stopped)
        now = [Fraction(most * s) if i in stopped else Fraction(left * weights[i % 3], free) for i, s in enumerate(sizes)]
        over = {i for i, t in enumerate(now) if t > most * sizes[i]} - stopped
        if not over:
            return [float(t) for t in now]
        stopped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_shared_again_above_the_bound(spark, seed):
    draw = random.Random(seed)
    sizes = [draw.choice([0, 1, 3, 10, 10_000, 250_000]) + draw.randrange(5) for _ in range(11)]
    names = [f"s{i:02d}" for i in range(10)] + [None]
    rows = target_sizes(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()
    got = {r["source"]: r["target"] for r in rows}
    assert [got[n] for n in names] == pytest.approx(shares(sizes), rel=1e-12)


@pytest.mark.parametrize("seed", range(30))
def test_knapsack_is_as_near_as_any_choice(seed):
    draw = random.Random(seed)
    sizes = draw.sample(range(1, 40), draw.randrange(1, 5))
    counts = [draw.randrange(1, 5) for _ in sizes]
    budget = draw.randrange(0, sum(s * c for s, c in zip(sizes, counts, strict=True)) + 5)
    taken = fit_lengths(sizes, counts, budget)
    assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
    sums = [sum(s * t for s, t in zip(sizes, some, strict=True)) for some in itertools.product(*[range(c + 1) for c in counts])]
    assert abs(sum(s * t for s, t in zip(sizes, taken, strict=True)) - budget) == min(abs(s - budget) for s in sums)


@pytest.mark.parametrize("budget", [70_001, 1_234_567, 9_000_001])
def test_large_budgets_are_met_to_the_word(budget):
    sizes, counts = list(range(1, 400)), [200] * 399
    taken = fit_lengths(sizes, counts, budget, dp_budget=1000)
    assert sum(s * t for s, t in zip(sizes, taken, strict=True)) == budget
    assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
    share = sum(taken) / sum(counts)  # most lengths are dealt in proportion
    assert np.mean([abs(t / c - share) < 0.05 for t, c in zip(taken, counts, strict=True)]) > 0.8


def mix_rows(seed=1):
    draw = random.Random(seed)
    rows = [(i, " ".join(["w"] * draw.randrange(0, 60)), "en", draw.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)]
    copies = [(900, "same text of five words", "en", "a")] * 150
    return rows + copies + [(None, "no id", "en", "b"), (901, None, None, "a"), (902, "", "en", "empty only"), (903, " \n\t ", "en", None)]


def test_mix_meets_its_targets_and_repeats(spark, many_tasks):
    rows = mix_rows()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += words(text)
    names = sorted((s for s in sizes if s is not None)) + [None]
    targets = dict(zip(names, shares([sizes[n] for n in names]), strict=True))
    by_id = {}
    for i, _, _, source in rows:
        by_id.setdefault(i, source)
    taken = Counter()
    for row in got:
        assert row["source_size"] == sizes[by_id[row["doc_id"]]] and row["target"] == pytest.approx(targets[by_id[row["doc_id"]]])
        assert row["taken"] % row["size"] == 0 and row["taken"] <= 3 * row["size"] if row["size"] else row["taken"] == 0
        taken[by_id[row["doc_id"]]] += row["taken"]
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 1, source
    again = mix(docs_of(spark, random.Random(3).sample(rows, len(rows))).repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_of_nothing(spark):
    assert mix(docs_of(spark, [])).collect() == []
    assert [tuple(r) for r in mix(docs_of(spark, [(1, None, None, None)])).collect()] == [(1, 0, 0, 0.0, 0)]


# Collocations
def brute_phrases(rows, least, top, longest=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p for p, c in counts.items() if c >= least}
        inside = {}
        for longer in frequent:
            for k in range(1, len(longer)):
                for i in range(len(longer) - k + 1):
                    part = longer[i : i + k]
                    inside[part] = max(inside.get(part, 0), counts[longer])
        found = []
        for p in frequent:
            if len(p) < 2 or inside.get(p, 0) >= counts[p]:
                continue
            score, k = min((1000 * counts[p] * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -counts[p], " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, phrase.decode(), -a, le, r, n[lang], -score) for i, (score, a, phrase, le, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def phrase_rows():
    draw = random.Random(5)
    vocabulary = ["New", "york", "of", "the", "a", "Éa", "\x00z", "\x01", "x\x0cy", "b", "c", "d"]
    text = lambda: "".join(draw.choice(vocabulary) + draw.choice([" "] * 8 + ["  ", "\t", ". ", "!\n", "\r", "\x0b"]) for _ in range(draw.randrange(40)))
    rows = [(i, text(), draw.choice(["en", "de", None, "und"]), "s") for i in range(150)]
    rows += [(1, "one two three four five six one two three four five six", "en", "s")] * 9
    return rows + [(None, "of the of the of the of the", "fr", None), (2, None, "fr", "s"), (3, "", None, "s"), (4, "of " * 5000, "en", "s"), (5, ".,;:!?", "xx", "s")]


def test_collocations_equal_brute_force(spark, many_tasks):
    rows = phrase_rows()
    for least, top in ((2, 10_000), (4, 7)):
        got = sorted(tuple(r) for r in collocations(docs_of(spark, rows), least=least, top=top).collect())
        assert got == brute_phrases(rows, least, top)
    assert any(len(r[2].split(" ")) == 5 for r in brute_phrases(rows, 2, 10_000))


def test_products_beyond_64_bits_stay_exact(spark):
    from scoutmill.llm import collocations as module

    grams = [("en", "a", 3 * 10**12 + 1, 1), ("en", "b", 2 * 10**12 + 7, 1), ("en", "a b", 10**12 + 3, 2)]
    counts = module.cut_counts(spark.createDataFrame(grams, "lang string, phrase string, f long, words int"))
    frequent, module.frequent_phrases = module.frequent_phrases, lambda docs, least, longest: (spark.createDataFrame(grams, "lang string, phrase string, f long, words int"), spark.createDataFrame([("en", 9 * 10**12)], "lang string, n long"))
    try:
        row = module.collocations(None).first()
    finally:
        module.frequent_phrases = frequent
    assert counts.count() == 1 and row["score"] == 1000 * (10**12 + 3) * 9 * 10**12 // ((3 * 10**12 + 1) * (2 * 10**12 + 7))


def test_collocations_of_nothing(spark):
    assert collocations(docs_of(spark, [])).collect() == []
    assert collocations(docs_of(spark, [(1, None, None, None), (2, " . ", "en", "s")]), least=1).collect() == []


# Whitening
def vectors_of(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for name in CLASHES:
        table = table.withColumn(name, F.lit("x"))
    return table


def whole(vector):
    return tuple(math.floor(256 * c) for c in np.asarray(vector, dtype=np.float32).astype(float).tolist())


def test_whitening_equals_a_local_computation(spark, many_tasks):
    draw = np.random.default_rng(3)
    spread = draw.normal(size=(6, 6))
    rows = [(i, v) for i, v in enumerate((draw.normal(size=(300, 6)) @ spread).astype(np.float32).tolist())]
    rows += [rows[0]] * 120 + [(None, rows[1][1]), (7000, None), (7001, [float("nan")] * 6), (7002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (7003, [float("-inf")] + [0.0] * 5)]
    usable = [(i, v) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    got = whiten(vectors_of(spark, rows)).collect()
    assert len(got) == 4 * len(usable)
    x = np.array(sorted({whole(v) for _, v in usable}), dtype=np.int64)
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    of_id = {i: np.array(whole(v)) for i, v in usable}
    signs = {}
    for row in got:
        c, at = row["component"], of_id[row["vec_id"]]
        assert row["n"] == n and row["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(at, sums, strict=True))
        assert row["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9) and row["identity_error"] < 1e-9
        expected = (at - sums / n) @ axes[:, c - 1] / np.sqrt(values[c - 1])
        sign = signs.setdefault(c, np.sign(expected * row["whitened"]) if abs(expected) > 1e-3 else None) or signs.pop(c, 1) or 1
        assert row["whitened"] == pytest.approx(sign * expected, abs=1e-6)


def test_whitening_in_many_blocks_is_the_same(spark, monkeypatch):
    from scoutmill.llm import whitening

    draw = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(draw.normal(size=(500, 5)).tolist())]
    one = {(r["vec_id"], r["component"]): r for r in whiten(vectors_of(spark, rows)).collect()}
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 5 * 17)
    many = {(r["vec_id"], r["component"]): r for r in whiten(vectors_of(spark, rows)).collect()}
    assert one.keys() == many.keys() and len(one) == 2000
    for key, row in one.items():
        assert many[key]["deviation"] == row["deviation"] and many[key]["whitened"] == pytest.approx(row["whitened"], abs=1e-8)


@pytest.mark.parametrize("rows, expected", [
    ([], 0), ([(1, None)], 0), ([(1, [])], 0), ([(1, [0.5, 0.25])], 2), ([(1, [0.5]), (1, [0.5])], 2), ([(1, [0.5, 1.0, 2.0]), (2, [0.5])], 6),
    ([(1, [1e30, 0.0]), (2, [-1e30, 1.0])], 4)])
def test_whitening_of_odd_tables(spark, rows, expected):
    got = whiten(vectors_of(spark, rows)).collect()
    assert len(got) == expected
    if expected == 2:  # no variance at all
        assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(0, None, None, 0.0)}
