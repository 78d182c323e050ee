"""PII (operator 5): information-theoretic sanitisation with column functions only.

Protected entities (e-mail addresses, IP addresses, card and phone numbers) are
found by pattern in every whole text. The corpus then tells which other terms
give an entity away: for a term t in a text that holds an entity e, the pointwise
mutual information log2(N n(e,t) / (n(e) n(t))) over documents is what reading t
tells about e, out of log2(N / n(e)) that there is to know. Terms that tell more
than ``disclosure`` of it become spans at all their places, in texts with and
without the entity: digits in them are generalised, other terms removed.

A term needs ``min_contexts`` places of the entity in texts that hold both. Of an
entity with a single place, every rare word of its text would tell everything,
so all of them would go, and nothing in the corpus says which of them belong to
it: with 2, such an entity gets no terms; 1 takes all those words out.
Places in copies of a text count once.

Entity patterns run once per text, and their findings are kept as a small table;
terms and entities are counted by aggregations that add up before they shuffle.
The most frequent terms that tell nothing leave before terms are dealt out.

Defined cases: a null text is empty; a text without findings has zero counts, an
empty span string and the hash of the empty string; null ids are kept; rows with
equal id and text get equal spans; an empty table gives an empty result; the
input's other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutmill.session import keep

# Kinds of entities in their order, what replaces them, and their patterns. A lookbehind or possessive
# part only spares the engine starts that lead nowhere: the matches are the leftmost non-overlapping ones of the plain pattern.
KINDS = ["email", "ip", "card", "phone", "term"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
IP_PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
# Whole runs of digits with single blanks or hyphens between them, of 14 to 19 digits.
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}][\p{L}\p{N}_'-]{2,}"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Most frequent terms that are shipped to all tasks, so that those of them that disclose nothing are not shuffled.
COMMON = 20_000


def matches(text: Column, pattern: str, kind: int, gate: Column) -> Column:
    """Spans (start, kind, end, value) of a pattern's matches, from their lengths and those of the gaps between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), found, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    start = lambda acc, x: acc["at"] + x["gap"]
    placed = F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda acc, x: F.struct(
            (start(acc, x) + F.length(x["value"])).alias("at"),
            F.array_append(acc["spans"], F.struct(
                start(acc, x).alias("start"), F.lit(kind).alias("kind"), (start(acc, x) + F.length(x["value"])).alias("end"), x["value"].alias("value"))).alias("spans")),
        lambda acc: acc["spans"])
    return F.when(gate, placed).otherwise(F.array().cast(SPAN))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(value: Column) -> Column:
    """Checksum of card numbers: every second digit from the right counts double."""
    digits = digits_of(value)
    digit = lambda i: F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, F.lit(9)).otherwise(F.lit(0))))
    return total % 10 == 0


def entity_spans(text: Column) -> Column:
    """All protected entities of a text, by start, then kind."""
    email = matches(text, EMAIL, 0, F.contains(text, F.lit("@")))
    ip = F.filter(matches(text, IP, 1, F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]"))), lambda s: F.rlike(s["value"], F.lit(IP_PART)))
    card = F.filter(matches(text, CARD, 2, F.rlike(text, F.lit(CARD))), lambda s: passes_luhn(s["value"]))
    phone = F.filter(matches(text, PHONE, 3, F.contains(text, F.lit("+"))), lambda s: F.length(digits_of(s["value"])).between(10, 15))
    return F.sort_array(F.concat(email, ip, card, phone))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def distinct_terms(text: Column) -> Column:
    """Different terms of a text in small letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def term_spans(text: Column, terms: Column) -> Column:
    """Spans of all places of ``terms``, by one pass over the text's terms."""
    found, gaps = F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.split(text, TERM, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), found, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    start = lambda acc, x: acc["at"] + x["gap"]
    end = lambda acc, x: start(acc, x) + F.length(x["value"])
    return F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda acc, x: F.struct(
            end(acc, x).alias("at"),
            F.when(F.array_contains(terms, F.lower(x["value"])), F.array_append(acc["spans"], F.struct(
                start(acc, x).alias("start"), F.lit(4).alias("kind"), end(acc, x).alias("end"), F.lower(x["value"]).alias("value")))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def find_entities(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans, terms): base spans, and the different terms of texts that have any; kept as a table."""
    found = keyed(docs).withColumn("spans", entity_spans(F.col("text")))
    return keep(found.select("doc_id", "text_hash", "spans", F.when(F.size("spans") > 0, distinct_terms(F.col("text"))).alias("terms")))


def disclosing_terms(found: DataFrame, vocabulary: DataFrame, disclosure: float, min_contexts: int) -> DataFrame:
    """Terms that tell more than ``disclosure`` of some entity's information; counts are of rows."""
    names = F.transform("spans", lambda s: F.concat_ws(":", s["kind"].cast("string"), F.lower(s["value"])))
    places = lambda e: F.struct(e.alias("entity"), F.size(F.filter("names", lambda x: x == e)).alias("places"))
    holding = found.where(F.size("spans") > 0).select("text_hash", "terms", names.alias("names")).select(
        "text_hash", "terms", F.inline(F.transform(F.array_distinct("names"), places)))
    entities = holding.groupBy("entity").agg(F.count("*").alias("n_entity"))
    # Rows of a text are added up first, so that copies bring their places once and their rows all.
    once = holding.groupBy("text_hash", "entity").agg(F.count("*").alias("n_rows"), F.first("places").alias("places"), F.first("terms").alias("terms"))
    together = once.select("entity", "n_rows", "places", F.explode("terms").alias("term")).groupBy("entity", "term").agg(
        F.sum("n_rows").alias("n_both"), F.sum("places").alias("contexts")).where(F.col("contexts") >= min_contexts)
    scored = together.join(entities, "entity").join(vocabulary, "term")
    n = F.lit(float(max(found.count(), 1)))
    told, known = F.log2(n * F.col("n_both") / (F.col("n_entity") * F.col("n_term"))), F.log2(n / F.col("n_entity"))
    return keep(scored.where((known > 0) & (told > disclosure * known)).select("term").distinct())


def sanitise(docs: DataFrame, disclosure: float = 0.8, min_contexts: int = 2) -> DataFrame:
    """One row per input row: doc_id, text_hash, ``base`` spans and ``spans`` with the disclosing terms added."""
    found = find_entities(docs)
    texts = keyed(docs)
    # Each text's own terms count once; tasks add theirs up before the shuffle.
    vocabulary = keep(texts.select(F.explode(distinct_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")))
    giving = disclosing_terms(found, vocabulary, disclosure, min_contexts)
    common = vocabulary.orderBy(F.desc("n_term"), "term").limit(COMMON).select("term").join(giving, "term", "left_anti")
    rare = texts.select("doc_id", "text_hash", F.explode(distinct_terms(F.col("text"))).alias("term")).join(F.broadcast(common), "term", "left_anti")
    held = rare.join(giving, "term").groupBy("doc_id", "text_hash").agg(F.collect_set("term").alias("terms")).alias("h")
    marked = texts.alias("t").join(held, F.col("t.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("t.text_hash") == F.col("h.text_hash")))
    more = marked.select("t.doc_id", "t.text_hash", term_spans(F.col("t.text"), F.col("h.terms")).alias("more")).dropDuplicates(["doc_id", "text_hash"])
    base = found.select("doc_id", "text_hash", F.col("spans").alias("base")).alias("b")
    rows = base.join(more.alias("m"), F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("b.text_hash") == F.col("m.text_hash")), "left")
    # A term inside an entity is covered already.
    free = F.filter("more", lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    spans = F.sort_array(F.concat("base", F.coalesce(free, F.array().cast(SPAN))))
    return rows.select("b.doc_id", "b.text_hash", "base", spans.alias("spans"))


def masked(docs: DataFrame, sanitised: DataFrame) -> DataFrame:
    """(doc_id, text) with entities replaced by their kind, numbers among the terms generalised and other terms removed."""
    names = F.array(*[F.lit(k.upper()) for k in KINDS])
    rows = keyed(docs).alias("d").join(sanitised.dropDuplicates(["doc_id", "text_hash"]).alias("s"),
                                  F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash")))
    instead = lambda s: F.when(s["kind"] < 4, F.concat(F.lit("["), F.get(names, s["kind"]), F.lit("]"))).otherwise(
        F.when(F.rlike(s["value"], F.lit("[0-9]")), F.regexp_replace(s["value"], "[0-9]", "0")).otherwise(F.lit("")))
    done = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("d.text"), acc["at"] + 1, s["start"] - acc["at"]), instead(s)).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col("d.text"), acc["at"] + 1, F.length("d.text"))))
    return rows.select("d.doc_id", done.alias("text"))
