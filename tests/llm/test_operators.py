"""The ten operators against brute force, round trips and held-out labels, and on rows that are out of the ordinary."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from scoutmill.llm import chosen_path, compression_quality, edit_decontaminate, html_density, license_scan, line_dedup, packing, pii_sanitise, pipeline, quality_rules, toxicity
from scoutmill.llm.components import components
from scoutmill.llm.labelled import fold_of
from scoutmill.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000)) + "."
ODD = [
    (1, "The first line has eight words and an end.\nA second line of text with enough words here."), (1, "The first line has eight words and an end.\nA second line of text with enough words here."),
    (2, "The first line has eight words and an end.\nA second line of text with enough words here."), (3, None), (4, ""), (5, " \n\t\n "), (None, "no id, mail me at some.one@example.org or +1 (212) 555-0100 now"),
    (6, LONG), (7, "single"), (8, "Licensed under the Apache License, Version 2.0. Ring 4111 1111 1111 1111 or 10.0.0.256 10.0.0.255"), (9, "é ß 中文 \U0001f600 <|endoftext|>"),
]
CLASHES = ["score", "spans", "label", "id", "bucket", "words", "text_hash", "removed", "features", "row", "n", "base", "gone"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark, rows=ODD):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def documents(spark, folder=SMALL):
    return spark.read.parquet(f"{folder}/documents.parquet")


# Every operator over odd rows and over no rows at all.
def applied(spark, docs):
    few = labels(spark, [(1, 1, 0), (6, 0, 1), (7, 1, 0), (8, None, None), (None, 1, 1)])
    items = spark.createDataFrame([(0, "The first line has eight words and an end."), (1, None), (2, "single"), (3, "")], "item_id long, text string")
    usable = F.lit(True)
    return {
        "toxicity": toxicity.score(docs, toxicity.fit(docs, few, usable), ["doc_id"]),
        "compression": compression_quality.score(docs, compression_quality.fit(docs, few, usable), ["doc_id"]),
        "leaks": edit_decontaminate.find_leaks(docs, items), "classes": chosen_path.jaccard_classes(docs), "pii": pii_sanitise.sanitise(docs),
        "masked": pii_sanitise.masked(docs, pii_sanitise.sanitise(docs)), "packing": packing.pack_documents(docs, tokenizer_path()),
        "lines": line_dedup.dedup_lines(docs), "report": line_dedup.line_report(docs), "licenses": license_scan.scan_licenses(docs),
        "rules": quality_rules.judge_documents(docs, ["doc_id"]),
    }


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_odd_rows_have_defined_results(spark):
    docs = odd_docs(spark)
    found = {name: df.collect() for name, df in applied(spark, docs).items()}
    for name in ("toxicity", "compression", "classes", "pii", "lines", "report", "licenses", "rules"):
        assert len(found[name]) == len(ODD), name
    assert all(0 <= r["score"] <= 1 for r in found["toxicity"] + found["compression"])
    classes = {r["doc_id"]: r for r in found["classes"]}
    assert classes[2]["class_id"] == 1 and classes[1]["n_copies"] == 3 and classes[4]["class_id"] == 3 and classes[6]["n_links"] == 0
    kept = {r["doc_id"]: r["text"] for r in found["lines"]}
    assert kept[2] == "" and kept[1].count("\n") == 1 and kept[6] == LONG and kept[3] is None
    assert found["lines"][0].asDict().keys() == set(docs.columns)
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in found["leaks"]} == {(1, 0, 0), (2, 0, 0), (7, 2, 0)}
    packed = collections.Counter(r["doc_id"] for r in found["packing"])
    assert set(packed) == {i for i, _ in ODD} and packed[3] == 1
    judged = {r["doc_id"]: r for r in found["rules"]}
    assert judged[3]["n_words"] == 0 and not judged[4]["kept"] and judged[6]["n_words"] == 30_000
    scanned = {r["doc_id"]: r for r in found["licenses"]}
    assert scanned[8]["base_labels"] == "apache" and scanned[8]["first_word"] == 3 and scanned[3]["first_word"] is None and scanned[4]["score"] == 0
    masks = {r["doc_id"]: r["text"] for r in found["masked"]}
    assert masks[None] == "no id, mail me at [EMAIL] or [PHONE] now" and masks[8].endswith("Ring [CARD] or 10.0.0.256 [IP]")


def test_empty_tables(spark):
    for name, df in applied(spark, odd_docs(spark, [])).items():
        assert df.count() == 0, name


def test_restores_obfuscated_words(spark):
    costs = toxicity.trigram_costs(toxicity.count_trigrams(documents(spark)))
    for form, word in {"stup1d": "stupid", "$tupid": "stupid", "s.t.u.p.i.d": "stupid", "stuuupid": "stupid", "s t u p i d": "stupid", "m0r0n": "moron", "1d10t": "idiot", "tr@sh": "trash"}.items():
        assert toxicity.restore(form.lstrip(), costs) == word
    assert toxicity.restored_words("plain,", costs) == ["plain"] and toxicity.restored_words("12", costs) == []


@pytest.mark.parametrize("name, label, folds, held, least", [("op1_toxicity", "toxic", 5, 0, 0.97), ("op2_compression_quality", "quality", 3, 1, 0.93)])
def test_held_out_accuracy(spark, name, label, folds, held, least):
    rows = QUERIES[name](spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in rows)
    held_rows = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r[label] for r in held_rows) >= least * len(held_rows)
    assert documents(spark).where(fold_of(F.col("doc_id"), folds) == held).count() > 0


def test_leaks_with_edits_are_found(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 12, 25, 40])))) for i in range(60)]
    docs, truth = [], set()
    for i, text in items:
        words = text.split()
        for _ in range(len(words) // 10):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["new"], [words[at], "new"]])
        around = rng.choices(vocabulary, k=60)
        docs.append((i, " ".join(around[:30] + words + around[30:])))
        truth.add((i, i))
    docs += [(1000 + i, " ".join(rng.choices(vocabulary, k=80))) for i in range(100)]
    found = edit_decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(truth & got) >= 0.97 * len(truth)
    for r in found:  # every reported stretch really is that close
        a, b = items[r["item_id"]][1].split(), dict(docs)[r["doc_id"]].split()[r["start_word"] : r["end_word"]]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert row[-1] == r["distance"] <= 0.2 * len(a)


def edited(rng, words, edits):
    """``words`` after ``edits`` substitutions, insertions and deletions, all spread evenly or all drawn."""
    words = list(words)
    places = [round((k + 0.5) * len(words) / edits) for k in range(edits)] if rng.random() < 0.5 else rng.sample(range(len(words)), edits)
    for at in sorted(places, reverse=True):
        words[at : at + 1] = rng.choice([["new"], [], [*words[at : at + 1], "new"]])
    return words


def test_every_leak_within_the_bound_is_found(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(100 * n + k, rng.sample(vocabulary, n)) for n in range(4, 61) for k in range(6)]
    docs = [(i, " ".join([*rng.sample(vocabulary, 20), *edited(rng, words, len(words) // 5), *rng.sample(vocabulary, 20)])) for i, words in items]
    found = edit_decontaminate.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    assert {i for i, _ in items} <= {r["doc_id"] for r in found if r["doc_id"] == r["item_id"]}


def test_leaks_among_many_items_and_short_texts():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = [(i, rng.sample(vocabulary, 12)) for i in range(3000)]
    texts = [" ".join(words) for _, words in rows]  # 9 million pairs of text and item in one chunk
    block = edit_decontaminate.build_block(rows, 0.2, 4)
    found = edit_decontaminate.find_in(texts, block, edit_decontaminate.Numbers(block.vocabulary), 0.2)
    assert {(t, i) for t, i, distance, _, _ in found if not distance} == {(i, i) for i in range(3000)}


def near_texts(rng, groups=30):
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([6, 60, 200]))
        for _ in range(rng.choice([1, 2, 4])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = "changed"
            rows.append(" ".join(words))
    base = rng.choices(vocabulary, k=120)
    for k in range(150):  # one class above every bucket size
        rows.append(" ".join([*base, f"end{k}"]))
    return list(enumerate(rows))


def test_jaccard_classes_against_all_pairs(spark):
    rows = near_texts(random.Random(3))
    sets = {}
    for i, text in rows:
        words = text.split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    first = {}
    for i, text in rows:
        first.setdefault(text, i)
    ids = sorted(first.values())
    links, roots = collections.Counter(), {i: i for i in ids}

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                low, high = sorted((root(a), root(b)))
                roots[high] = low
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in chosen_path.jaccard_classes(docs, small=16, block=32).collect()}
    assert {i: got[i]["n_links"] for i, _ in rows} == {i: links[first[t]] for i, t in rows}
    assert {i: got[i]["class_id"] for i, _ in rows} == {i: root(first[t]) for i, t in rows}


def test_runs_reach_the_recall_for_contained_sets():
    # Both members choose a shared shingle with a mean of 1 a level: three levels are survived with a chance of 0.374.
    assert chosen_path.runs_for(0.999, 0.8, 0.8, 3) == 15


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def luhn(value):
    total = 0
    for i, c in enumerate(reversed([c for c in value if c.isdigit()])):
        total += int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)]
    return total % 10 == 0


def base_spans(text):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= sum(c.isdigit() for c in m) <= 19 and luhn(m)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= sum(c.isdigit() for c in m) <= 15),
    ]
    found = [(m.start(), k, m.end(), name) for k, (name, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, text) if good(m[0])]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))


TRICKY = ["a@b.cc%x@y.z.", "@@a@b.c", "a@b", "\U0001f600 x@y.zz 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "4111-1111 1111 1111 4111 1111 1111 1111 5", "4111  1111 1111 1111 1111",
          "+12 (345) 678-90 12+1 212 555 0100", "1.2.3.4@a.b", "5 4111111111111111", "-4111111111111111-", "+" * 50 + "1" * 40]


def test_base_spans_against_plain_patterns(spark):
    rows = [*enumerate(TRICKY), *((r["doc_id"] + 1000, r["text"]) for r in documents(spark).collect())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["base"] for r in pii_sanitise.sanitise(docs).select("doc_id", pii_sanitise.written(F.col("base")).alias("base")).collect()}
    assert got == {i: base_spans(t) for i, t in rows}


def test_terms_that_disclose_become_spans(spark):
    rows = [(i, f"note {i}: write to anna@example.org at Kestrelhouse, said clerk{i}") for i in range(3)] + [(10 + i, f"other text {i} said nothing") for i in range(60)]
    got = {r["doc_id"]: r["terms"] for r in pii_sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc_id", F.expr("transform(filter(spans, s -> s.kind = 4), s -> s.value)").alias("terms")).collect()}
    assert "kestrelhouse" in got[0] and not any("said" in t for t in got.values()) and not got[10]


def test_disclosing_terms_are_marked_wherever_they_stand(spark):
    rows = [(0, "Kestrelhouse opens.\n" + "other text said nothing " * 40 + "\nmail anna@example.org, Kestrelhouse"), (1, "go to KESTRELHOUSE, then _kestrelhouse again")]
    rows += [(2, "ask anna@example.org at Kestrelhouse"), *((10 + i, f"other text said nothing {i}") for i in range(200))]
    got = {r["doc_id"]: r["spans"] for r in pii_sanitise.sanitise(spark.createDataFrame([*rows, rows[1]], "doc_id long, text string")).collect()}
    for i, text in rows[:3]:
        assert [(s["start"], s["end"]) for s in got[i] if s["kind"] == 4 and s["value"] == "kestrelhouse"] == [m.span() for m in re.finditer("kestrelhouse", text.lower())]
    assert not any(s["value"] in ("other", "text", "said", "nothing") for spans in got.values() for s in spans) and not got[10]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer, rows = Tokenizer.from_file(tokenizer_path()), [(r["doc_id"], r["text"]) for r in documents(spark).limit(120).collect()]
    rows += [(-1, "İSTANBUL ΑΣ ß <|endoftext|> <|ENDOFTEXT|> don't 1²x\x1cy z á _x_ ,., ...end"), (-2, LONG)]
    pieces = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizer_path()).collect():
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += len(part)
        assert at == len(ids)
    padding = 0
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 3 * 2048 + 0.005 * sum(r["length"] for rows in pieces.values() for r in rows)  # half a percent, and a last sequence per worker


def test_cuts_are_reciprocals_of_the_capacity():
    reciprocals = {2048 // i for i in range(1, 2049)}
    cuts = {n: packing.cut_lengths(n, 2048) for n in [*range(1, 2049), 5000, 10**6]}
    assert all(sum(cut) == n and set(cut) <= reciprocals for n, cut in cuts.items())
    assert sum(len(cuts[n]) for n in range(1, 2048)) / 2047 < 3.2
    bins = packing.ClassBins(2048, 0)
    rows = [row for i in range(11) for row in bins.add((i, 0, 409, 0, 0))]
    assert [(r[0], r[5], r[6]) for r in rows] == [(i, i // 5, 409 * (i % 5)) for i in range(10)]  # five pieces of a fifth each
    assert [(r[0], r[5]) for r in bins.finish()] == [(10, 2)]


def test_line_dedup_against_variants(spark):
    rng = random.Random(9)
    lines = [" ".join(rng.choices("abcdefghij", k=rng.choice([3, 8, 9, 12]))) for _ in range(25)]
    docs = []
    for i in range(60):
        own = []
        for line in rng.choices(lines, k=4):
            words = line.split()
            kind = rng.randrange(4)
            at = rng.randrange(len(words))
            words[at : at + 1] = [[words[at]], ["z"], [], [words[at], "y"]][kind]
            own.append("  ".join(words) if rng.random() < 0.2 else " ".join(words))
        docs.append((i, "\n".join(own)))
    places = [((i, k), tuple(line.split())) for i, text in docs for k, line in enumerate(text.split("\n")) if line.split()]

    def close(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    removed = collections.defaultdict(list)
    for p, words in places:
        if any(q < p and close(words, other) for q, other in places):
            removed[p[0]].append(p[1])
    got = line_dedup.line_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in got} == {i: ",".join(map(str, removed[i])) for i, _ in docs}
    assert sum(map(len, removed.values())) > 50


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="top">Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy &amp; save</div><article><h1>Head &amp; line</h1><p><b>First <i>para</i>graph is
 long enough to count<br><p>Second one &lt;here&gt; goes on for some words more</p><ul><li>one item</li><li>another item</li></ul></article>
<aside>Related</aside><div id="comments"><p>I disagree with every word of this, said a reader at great length and with passion.</p></div><form>Mail<input></form><footer>&copy; x</footer>"""


def test_main_text_of_pages(spark):
    expected = "Head & line\nFirst paragraph is long enough to count\nSecond one <here> goes on for some words more\none item\nanother item"
    assert html_density.main_text(PAGE) == expected
    assert html_density.main_text(PAGE[: PAGE.index("<aside>")]) == expected
    deep = "<div>" * 5000 + "<p>deep text</p>" + "</div>" * 5000
    assert html_density.main_text(deep) == "deep text" and html_density.main_text(None) == html_density.main_text("<p") == ""
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (None, None, "<p>a"), (1, "u", PAGE)], "page_id long, url string, html string")
    rows = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_density.extract_pages(pages.withColumn("text", F.lit("x"))).collect())
    assert rows == [(0, "a", 1), (1, expected, len(expected)), (1, expected, len(expected)), (2, "", 0)]


def test_loose_text_and_short_siblings_of_the_article_stay():
    body = "<div><p>First paragraph with some words in it, long enough.</p><p>Second paragraph with some more words in it.</p></div>"
    main = "First paragraph with some words in it, long enough.\nSecond paragraph with some more words in it."
    for tag in ("article", "main"):
        page = f"<nav>Home</nav><{tag}>Intro text{body}<h2>Short</h2><ul><li>a</li><li>b</li></ul>Closing <b>text</b></{tag}><footer>x</footer>"
        assert html_density.main_text(page) == f"Intro text\n{main}\nShort\na\nb\nClosing text"
    assert html_density.main_text(f"<body><div>Outer<div>Inner{body}</div>End</div></body>") == f"Outer\nInner\n{main}\nEnd"
    assert html_density.main_text(f"<body><div>Loose text <i>goes</i> before{body}and after</div></body>") == f"Loose text goes before\n{main}\nand after"


def test_names_of_wrappers_do_not_cost_the_article():
    text = "First paragraph with some words in it, long enough.\nSecond paragraph with some more words in it.\nA third one ends the article here."
    body = "".join(f"<p>{line}</p>" for line in text.split("\n"))
    rest = '<div class="sidebar">Most read <a href="/a">this</a></div><div class="cookie-notice">We use cookies on this site.</div><ul class="post-tags"><li><a href="/t">tag</a></li></ul>'
    for start in ('<div class="wrapper has-sidebar">', '<div id="content" class="no-sidebar">', '<div class="post side-by-side">', '<div class="tags-explained">', '<div class="notice-period">', "<form>"):
        end = "</form>" if start == "<form>" else "</div>"
        assert html_density.main_text(f"<body>{start}{body}{end}{rest}</body>") == text, start
        assert html_density.main_text(f"<body>{start}<div>{body}</div>{rest}{end}</body>") == text, start
    section = '<section class="discussion"><p>What the results mean is said in this part of the article.</p></section>'
    assert html_density.main_text(f"<body><article>{body}{section}</article></body>").endswith("of the article.")
    readers = '<div class="comments">' + "<p>A reader writes a long answer to the article above.</p>" * 20 + "</div>"
    assert html_density.main_text(f"<body><div>{body}</div>{readers}</body>") == text == html_density.main_text(f"<body><div class=post>{body}{readers}</div></body>")
    half = '<div class="side {}"><p>{} half of a text that two sides share between them.</p></div>'
    assert html_density.main_text(f"<body>{half.format('left', 'One')}{half.format('right', 'Other')}</body>").count("half of a text") == 2


def test_deep_nesting_takes_time_in_proportion():
    took = []
    for depth in (4000, 16_000):
        page = "<div><span>" * depth + "<p>deep text</p></x>" * 10 + "</i>" * depth
        start = time.process_time()
        html_density.parse(page)
        took.append(time.process_time() - start)
    assert took[1] < 12 * took[0] + 0.2


def density_by_hand(node, body_ratio):
    """(chars, tags, link chars, link tags, density) by recursion over the definition."""
    chars = tags = link_chars = link_tags = 0
    for child in node.children:
        if isinstance(child, str):
            chars += len("".join(child.split()))
        else:
            c, t, lc, lt, _ = density_by_hand(child, body_ratio)
            chars, tags, link_chars, link_tags = chars + c, tags + t + 1, link_chars + lc, link_tags + lt + (child.tag == "a")
    if node.tag == "a":
        link_chars = chars
    if not chars:
        return 0, tags, link_chars, link_tags, 0.0
    base = math.log(chars * link_chars / max(chars - link_chars, 1) + body_ratio * chars + math.e)
    weight = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
    adjust = math.log(weight) / math.log(max(base, 1 + 1e-9)) if base > 1 else math.log(weight + 1)
    return chars, tags, link_chars, link_tags, chars / max(tags, 1) * max(adjust, 0.0)


def test_densities_against_recursion():
    for page in (PAGE, "<div><p>One <a href=x>link</a> and text</p><ul><li><a>a</a><li><a>b</a></ul>tail</div>", "<p>only", "<div><a>all link</a></div>"):
        root = html_density.without_furniture(html_density.parse(page))
        nodes = html_density.measure(root)
        ratio = root.link_chars / max(root.chars, 1)
        for node in nodes:
            assert (node.chars, node.tags, node.link_chars, node.link_tags) == density_by_hand(node, ratio)[:4]
            assert node.density == pytest.approx(density_by_hand(node, ratio)[4])
            assert node.total == pytest.approx(sum(density_by_hand(c, ratio)[4] for c in node.children if not isinstance(c, str)))


def test_license_rules():
    assert len(license_scan.RULES) > 300
    scan = license_scan.scan_text
    found = scan("Licensed under the GNU General Public License, version 3 or later. See the MIT license.")
    assert found["base_labels"] == "gpl,mit" and found["labels"] == "gpl,mit" and found["n_base"] == 2 and found["score"] == 1.0
    assert scan("Creative Commons Attribution-ShareAlike 4.0 International")["labels"] == "cc-by-sa"
    assert scan("GNU Lesser General Public License v2.1")["labels"] == "lgpl" and scan("a lesser general")["labels"] == ""
    assert license_scan.resolve([(0, 10, 2, 0.5, "a"), (2, 8, 2, 0.5, "b"), (2, 12, 1, 0.5, "c"), (0, 10, 2, 0.5, "d")]) == [(0, 10, 2, 0.5, "a"), (2, 12, 1, 0.5, "c")]


def test_license_ids_and_short_forms():
    labels = lambda text: license_scan.scan_text(text)["labels"]
    for name, label in {"MIT": "mit", "Apache-2.0": "apache", "GPL-3.0-only": "gpl", "GPL-2.0+": "gpl", "LGPL-2.1-or-later": "lgpl", "AGPL-3.0-only": "agpl", "MPL-2.0": "mpl",
                        "ISC": "isc", "Zlib": "zlib", "0BSD": "0bsd", "BSD-3-Clause": "bsd-3-clause", "MIT-0": "mit-0", "BSL-1.0": "boost", "EPL-2.0": "epl"}.items():
        assert labels(f"// SPDX-License-Identifier: {name}") == label, name
    assert labels("SPDX-License-Identifier: MIT OR Apache-2.0") == "apache,mit"
    for text, label in {"GPLv3": "gpl", "Apache 2.0": "apache", "code is LGPL v2.1": "lgpl", "under AGPLv3+": "agpl", "MPLv2": "mpl", "released under MIT": "mit", "GNU GPL": "gpl"}.items():
        assert labels(text) == label, text
    assert labels("an apache rode with the MIT people, a zlib stream, python 3") == ""


def test_license_words_against_plain_search(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(documents(spark)).collect()}
    for i, text in rows:
        words = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        places = [k for phrase in license_scan.BASE_PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))


def test_quality_counts_against_plain_code(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()] + [(-1, "a b c a b c a b"), (-2, "x\n\nx\n \nx | y > z q")]
    got = {r["doc_id"]: r for r in quality_rules.judge_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), ["doc_id"]).collect()}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        counts = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {p for k in range(len(words) - 2) if counts[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r["base_failed"] and r["kept"])


def test_query_columns(spark):
    expected = {
        "op5_pii_sanitise": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op6_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op8_html_density": ["page_id", "url", "text", "n_chars"],
    }
    for name, columns in expected.items():
        assert QUERIES[name](spark, "/root/testdata/sf0.001").columns[: len(columns)] == columns
    row = next(r for r in QUERIES["op5_pii_sanitise"](spark, "/root/testdata/sf0.001").collect() if not r["spans"])
    assert row["base_sha256"] == hashlib.sha256(b"").hexdigest()


A_TEXT = "The committee met on a cold morning in the old hall to talk about the river and the bridges that cross it near the mill."
B_TEXT = "Seven sailors carried lamps along the harbour wall while the evening boats came in one after another with their nets full."


def test_near_duplicate_stage_removes_rows_not_ids(spark):
    rows = [(1, A_TEXT), (None, A_TEXT), (None, B_TEXT), (5, "short text"), (5, "short text"), (7, A_TEXT + " end"), (7, "another text under the same id"), (8, None), (9, ""), (3, None)]
    got = pipeline.near_duplicate_stage(spark, odd_docs(spark, rows), SMALL).collect()
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in got) == sorted([(1, A_TEXT), (0, B_TEXT), (5, "short text"), (7, "another text under the same id"), (3, "")])
    assert got[0].asDict().keys() == set(odd_docs(spark).columns)


def test_decontamination_stage_removes_rows_not_ids(spark):
    items = spark.createDataFrame([(0, A_TEXT)], "item_id long, text string")
    rows = [(None, f"before it {A_TEXT} after it"), (None, B_TEXT), (4, A_TEXT), (4, B_TEXT), (4, B_TEXT), (6, None)]
    got = edit_decontaminate.without_leaks(odd_docs(spark, rows), items).collect()
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in got) == sorted([(0, B_TEXT), (4, B_TEXT), (4, B_TEXT), (6, "")])


def test_stages_on_odd_and_empty_tables(spark):
    for rows in (ODD, []):
        docs = odd_docs(spark, rows)
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert name == "packing" or set(out.columns) == set(docs.columns), name
            assert len(out.collect()) >= 1 if rows else out.collect() == [], name


def test_pipeline_keeps_columns_and_packs_everything(spark):
    import corpus_pipeline

    docs = documents(spark)
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SMALL)
        if at + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == before.columns
            docs = docs.sparkSession.createDataFrame(docs.collect(), before.schema)
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()
