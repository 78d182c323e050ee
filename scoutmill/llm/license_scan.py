"""Licence scan (operator 9): ordered signature rules over normalised words.

A text is brought to lower-case words with one space between them, so that a
rule meets the same wording whatever its punctuation and line breaks. Rules are
gated by keywords: a rule's pattern runs only on texts that hold its keyword.
Detections are then resolved by priority: one that lies inside the interval of
a detection of the same or a higher rank is suppressed.

Work is per row in Arrow batches without any shuffle; the only state is the
table of rules. Defined cases: a null text is empty; an empty text has no
words, null places, empty labels and score 0; ties of equal intervals go to
the earlier rule; extra input columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Bytes of UTF-8: digits and small letters stay, capitals become small, all
# other ASCII parts words, everything above ASCII belongs to a word.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

# The phrases of the base scan and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Licence families as (label, keyword of the prefilter, name pattern, versions). A keyword is a
# word or part of one that every match of the pattern holds.
FAMILIES = [
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", "1|2|3"),
    ("lgpl", "esser", r"(?:gnu )?lesser general public licen[sc]e", "2 1|3"),
    ("lgpl", "ibrary", r"(?:gnu )?library general public licen[sc]e", "2"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", "1|3"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e", "1 1|1 2|1 3"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e", "1 0|1 1|2 0|2"),
    ("mit", "mit", r"mit(?: x11)? licen[sc]e", ""),
    ("mit", "expat", r"expat licen[sc]e", ""),
    ("mit-0", "attribution", r"mit no attribution(?: licen[sc]e)?", ""),
    ("x11", "x11", r"x11 licen[sc]e", ""),
    ("isc", "isc", r"isc licen[sc]e", ""),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?", ""),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?", ""),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?", ""),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e", ""),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", "1 0|1 1|2 0"),
    ("epl", "eclipse", r"eclipse public licen[sc]e", "1 0|2 0"),
    ("edl", "eclipse", r"eclipse distribution licen[sc]e", "1 0"),
    ("cpl", "common public", r"common public licen[sc]e", "1 0"),
    ("cddl", "common development", r"common development and distribution licen[sc]e", "1 0|1 1"),
    ("eupl", "european", r"european union public licen[sc]e", "1 0|1 1|1 2"),
    ("cecill", "cecill", r"cecill(?: b| c)?(?: licen[sc]e)?", "1|2|2 1"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[sc]e", "1 0|2 0"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", ""),
    ("libpng", "libpng", r"libpng licen[sc]e", "2 0"),
    ("boost", "boost", r"boost software licen[sc]e", "1 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ""),
    ("wtfpl", "wtfpl", r"wtfpl", "1|2"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", ""),
    ("public-domain", "public domain", r"(?:released|dedicated|placed) (?:in)?to the public domain", ""),
    ("python", "python", r"python(?: software foundation)? licen[sc]e", "2|2 0"),
    ("php", "php", r"php licen[sc]e", "3 0|3 01"),
    ("ruby", "ruby", r"ruby licen[sc]e", ""),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", ""),
    ("openssl", "openssl", r"openssl licen[sc]e", ""),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", ""),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", ""),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", "1 0|1 1"),
    ("odbl", "open database", r"open database licen[sc]e", "1 0"),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e", "1 0"),
    ("pddl", "open data commons", r"open data commons public domain dedication(?: and licen[sc]e)?", "1 0"),
    ("ogl-uk", "open government", r"open government licen[sc]e", "1 0|2 0|3 0"),
    ("afl", "academic free", r"academic free licen[sc]e", "2 1|3 0"),
    ("osl", "open software", r"open software licen[sc]e", "2 1|3 0"),
    ("apsl", "apple", r"apple public source licen[sc]e", "1 0|1 2|2 0"),
    ("sspl", "server side", r"server side public licen[sc]e", "1|1 0"),
    ("bsl-1.1", "business source", r"business source licen[sc]e", "1 1"),
    ("elastic", "elastic", r"elastic licen[sc]e", "1 0|2 0"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict) licen[sc]e", "1 0 0"),
    ("openrail", "rail", r"(?:open ?rail|responsible ai)(?: m)? licen[sc]e", ""),
    ("llama", "llama", r"llama [0-9] (?:[0-9] )?community licen[sc]e", ""),
    ("ncsa", "illinois", r"(?:university of )?illinois(?: ncsa)? open source licen[sc]e", ""),
    ("intel", "intel", r"intel open source licen[sc]e", ""),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[sc]e", ""),
    ("vim", "vim", r"vim licen[sc]e", ""),
    ("upl", "universal permissive", r"universal permissive licen[sc]e", "1 0"),
    ("blueoak", "blue oak", r"blue oak model licen[sc]e", "1 0 0"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[sc]e)", "1|2"),
]
# Short names and SPDX ids as (label, keyword, name, versions, whether the name alone is a licence). Names that
# are not need a version, an SPDX tag or words like "licensed under" before them.
SHORT = [
    ("gpl", "gpl", r"(?:gnu )?gpl", "[123](?: 0)?", True), ("lgpl", "lgpl", r"(?:gnu )?lgpl", "2(?: [01])?|3(?: 0)?", True),
    ("agpl", "agpl", r"(?:gnu )?agpl", "[13](?: 0)?", True), ("gfdl", "fdl", r"(?:gnu fdl|gfdl)", "1 [123]", True),
    ("apache", "apache", "apache", "1 [01]|2(?: 0)?", False), ("mit-0", "mit 0", "mit 0", "", False), ("mit", "mit", "mit", "", False),
    ("mit", "expat", "expat", "", False), ("x11", "x11", "x11", "", False), ("isc", "isc", "isc", "", False), ("0bsd", "0bsd", "0bsd", "", True),
    ("bsd-2-clause", "bsd", "bsd ?2(?: clause)?", "", True), ("bsd-3-clause", "bsd", "bsd ?3(?: clause)?", "", True),
    ("bsd-4-clause", "bsd", "bsd ?4(?: clause)?", "", True), ("bsd", "bsd", "bsd", "", False),
    ("mpl", "mpl", "mpl", "1 [01]|2(?: 0)?", False), ("epl", "epl", "epl", "[12](?: 0)?", False), ("edl", "edl", "edl", "1 0", False),
    ("cpl", "cpl", "cpl", "1 0", False), ("cddl", "cddl", "cddl", "1 [01]", True), ("eupl", "eupl", "eupl", "1 [012]", True),
    ("cecill", "cecill", "cecill(?: [bc])?", "[12](?: [01])?", True), ("artistic", "artistic", "artistic", "[12] 0", False),
    ("zlib", "zlib", "zlib", "", False), ("libpng", "libpng", "libpng", "2 0", False), ("boost", "bsl", "bsl", "1 0", False),
    ("unlicense", "unlicense", "unlicense", "", True), ("wtfpl", "wtfpl", "wtfpl", "", True), ("cc0", "cc0", "cc0", "1 0", True),
    ("python", "psf", "psf", "2(?: 0)?", False), ("python", "python", "python", "2 0(?: 1)?", False), ("php", "php", "php", "3 01?", False),
    ("ruby", "ruby", "ruby", "", False), ("postgresql", "postgresql", "postgresql", "", False), ("openssl", "openssl", "openssl", "", False),
    ("ms-pl", "ms pl", "ms pl", "", True), ("ms-rl", "ms rl", "ms rl", "", True), ("ofl", "ofl", "(?:sil )?ofl", "1 [01]", True),
    ("odbl", "odbl", "odbl", "1 0", True), ("odc-by", "odc by", "odc by", "1 0", True), ("pddl", "pddl", "pddl", "1 0", True),
    ("ogl-uk", "ogl", "ogl(?: uk)?", "[123] 0", False), ("afl", "afl", "afl", "[123] [012]", False), ("osl", "osl", "osl", "[123] [01]", False),
    ("apsl", "apsl", "apsl", "[12] [012]", True), ("sspl", "sspl", "sspl", "1(?: 0)?", True), ("bsl-1.1", "busl", "busl", "1 1", True),
    ("bsl-1.1", "bsl", "bsl", "1 1", False), ("elastic", "elastic", "elastic", "[12] 0", False),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict)", "1 0 0", True), ("openrail", "rail", "open ?rail(?: [ms]| pp)?", "", True),
    ("ncsa", "ncsa", "ncsa", "", False), ("intel", "intel", "intel", "", False), ("w3c", "w3c", "w3c", "", False), ("vim", "vim", "vim", "", False),
    ("upl", "upl", "upl", "1 0", False), ("blueoak", "blueoak", "blueoak", "1 0 0", True), ("mulan", "mulanpsl", "mulanpsl", "[12](?: 0)?", True),
    ("llama", "llama", "llama ?[0-9](?: [0-9])?", "", False), ("public-domain", "public domain", "public domain", "", False),
    *((f"cc-{part}", "cc by", "cc " + part.replace("-", " "), "[1234] [05]", False) for part in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")),
]
# Creative Commons parts, short and long form.
CC_PARTS = [
    ("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nd", "attribution noderivatives"), ("by-nc", "attribution noncommercial"),
    ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives"),
]
# Sentences that stand in a licence's own text, as (label, keyword, pattern).
CLAUSES = [
    ("mit", "obtaining a copy", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "binary forms", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache", "compliance with the licen", r"you may not use this file except in compliance with the licen[sc]e"),
    ("gpl", "redistribute it and or", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the f", r"do what the f\w* you want to public licen[sc]e"),
    ("boost", "boost", r"distributed under the boost software licen[sc]e"),
    ("proprietary", "rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("no-warranty", "warrant", r"without warranty of any kind|without any warranty"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"),
]
# What leads up to a licence's name, with the rank and score of the detection.
FORMS = [
    (5, 1.0, r"(?:licen[sc]ed|released|distributed|published|available|provided|issued) under (?:the )?(?:terms of )?(?:the )?{}"),
    (4, 0.95, r"spdx licen[sc]e identifier {}"),
    (3, 0.9, r"(?:subject to|governed by|in accordance with|terms of) (?:the )?{}"),
    (2, 0.8, r"(?:see|read|copy of|licen[sc]e) (?:the )?{}"),
    (1, 0.7, r"{}"),
]


@dataclass(frozen=True)
class Rule:
    """One signature: a label, the keyword that gates it, its rank, its score and the pattern."""

    label: str
    keyword: bytes
    rank: int
    score: float
    pattern: re.Pattern[bytes]


def build_rules() -> list[Rule]:
    """All rules in order of falling rank: every family in every form, with and without a version."""
    rules = []

    def add(label: str, keyword: str, rank: int, score: float, pattern: str) -> None:
        rules.append(Rule(label, keyword.encode(), rank, score, re.compile(f" (?:{pattern})(?= )".encode())))

    for label, keyword, name, versions in FAMILIES:
        for rank, score, form in FORMS:
            if versions:
                add(label, keyword, rank * 2 + 1, score, form.format(rf"{name}(?: v| version| ver)? ?(?:{versions})(?: or (?:any )?later(?: version)?)?"))
            add(label, keyword, rank * 2, score, form.format(name))
    for short, full in CC_PARTS:
        words = short.replace("-", " ")
        for rank, score, form in FORMS:
            add(f"cc-{short}", "cc by", rank * 2, score, form.format(rf"cc {words}(?: (?:1|2|3|4) [05])?"))
            add(f"cc-{short}", "creative commons", rank * 2, score, form.format(rf"creative commons {full}(?: (?:1|2|3|4) [05])?(?: international| unported)?(?: licen[sc]e)?"))
    for label, keyword, name, versions, alone in SHORT:
        later = r"(?: only| or (?:any )?later(?: version)?)?"
        version = rf" ?(?:v|version|ver)? ?(?:{versions}){later}"
        any_form = rf"{name}(?:{version})?" if versions else name
        add(label, keyword, 8, 0.95, rf"spdx licen[sc]e identifier {any_form}")
        add(label, keyword, 6, 0.9, rf"(?:licen[sc]ed|released|distributed|published|available|provided|issued) under (?:the )?(?:terms of )?(?:the )?{any_form}")
        # Later parts of an SPDX expression, in texts that hold a tag.
        rules.append(Rule(label, b"spdx licen", 4, 0.9, re.compile(f" (?:or|and) {any_form}(?= )".encode())))
        if versions:
            add(label, keyword, 3, 0.7, name + version)
        if alone:
            add(label, keyword, 2, 0.7, name)
    for label, keyword, pattern in CLAUSES:
        add(label, keyword, 4, 0.9, pattern)
    return sorted(rules, key=lambda r: -r.rank)


RULES = build_rules()
KEYWORDS = sorted({r.keyword for r in RULES})
#: Every keyword's rules also need one of these words nearby in the text; most texts hold none and leave at once.
GATES = (b"licen", b"copyright", b" cc", b"public domain", b"wtfpl", b"rights reserved", b"proprietary", b"warrant", b"permi", b"redistribut", b"creative commons",
         b"bsd", b"attribution", b"cecill", b"mulan", b"misrepresented", b"advertising materials", b"endorse", b"what the f", b" under ", *sorted({k.encode() for _, k, _, versions, alone in SHORT if versions or alone}))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of a text as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def resolve(found: list[tuple[int, int, int, float, str]]) -> list[tuple[int, int, int, float, str]]:
    """Drop detections that lie inside one of the same or a higher rank; (start, end, rank, score, label).

    Detections are taken by falling rank, then by length, then by place, so of
    equal ones the first rule's stays. Kept intervals hold no other, so sorted
    by start they are sorted by end too and one look to the left decides.
    """
    from bisect import bisect_right, insort

    kept: list[tuple[int, int, int, float, str]] = []
    starts: list[int] = []
    furthest: list[int] = []  # greatest end among the kept intervals up to this start
    for hit in sorted(found, key=lambda h: (-h[2], h[0] - h[1], h[0])):
        at = bisect_right(starts, hit[0])
        if at and furthest[at - 1] >= hit[1]:
            continue
        kept.append(hit)
        insort(starts, hit[0])
        furthest.insert(at, max(hit[1], furthest[at - 1] if at else 0))
        for i in range(at + 1, len(furthest)):
            if furthest[i] >= hit[1]:
                break
            furthest[i] = hit[1]
    return sorted(kept)


def detect(joined: bytes) -> list[tuple[int, int, int, float, str]]:
    """Resolved detections in ``joined``, which holds one space before and after every word; places are bytes."""
    if not any(gate in joined for gate in GATES):
        return []
    present = {k for k in KEYWORDS if k in joined}
    found = [(m.start(), m.end(), r.rank, r.score, r.label) for r in RULES if r.keyword in present for m in r.pattern.finditer(joined)]
    return resolve(found)


def scan_text(text: str | None) -> dict:
    """Word count, base places, labels, detections in word places, and score of one text."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base_places, base_labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        needle, at = f" {phrase} ".encode(), -1
        while (at := joined.find(needle, at + 1)) >= 0:
            base_places.append(at)
            base_labels.add(label)
    hits = detect(joined)
    word_at = lambda at: joined.count(b" ", 0, at)
    spans = [f"{label}:{word_at(start)}:{word_at(end)}" for start, end, _, _, label in hits]
    return {
        "n_words": len(words), "n_base": len(base_places),
        "first_word": word_at(min(base_places)) if base_places else None, "last_word": word_at(max(base_places)) if base_places else None,
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | {h[4] for h in hits})),
        "score": max([h[3] for h in hits] + [0.7] * bool(base_places), default=0.0), "detections": ",".join(spans),
    }


SCANNED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"


def scan_licenses(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per input row: ``key``, base counts, labels, score and the kept detections as label:start:end words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t) for t in batch.column(1).to_pylist()]
            columns = {name: [r[name] for r in rows] for name in TYPES}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(columns[name], kind) for name, kind in TYPES.items())], names=[key, *TYPES])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(scan, f"`{key}` {kind}, {SCANNED}")


TYPES = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "detections": pa.string(),
}
