"""N-gram Jaccard join (operator 4): a chosen-path join over sets of word shingles.

Each run hashes the shingles of a set and chooses about ``1 / overlap`` of them;
texts that chose the same shingle share a bucket. A bucket above ``small`` is
split again on further shingles its members choose under that path, down to
``depth`` levels; small buckets are compared by brute force. A pair at the
threshold meets in one run with a known chance, and ``runs`` repeats the whole
until the target recall is reached. A bucket that another split would not make
smaller, because most of its members are alike, is not split: eight bits of
their minhashes, counted with its size, show it. Such a bucket, like what is
still large after the last split, is compared by pairs of blocks, so nothing is
capped.

Exact copies are one text throughout. Buckets first compare one byte in each of
64 slots of a minhash; texts that found a likely partner are then compared on
their exact sets. A pair that shares several buckets is counted in the least of
them only, which both members know from their lists of buckets: so pairs are
neither written out nor shuffled, and buckets emit one row per text with its
number of links and one edge towards its local group. Components over those
edges give the classes.

Defined cases: null and empty texts are alike (they are copies of each other
and link to no other text); texts under five words have one shingle; repeated
rows are copies; a null doc_id belongs to its text's class and never names it
while another id can; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutmill.llm.components import components
from scoutmill.llm.shingles import grouped, mix, shingle_set
from scoutmill.session import keep

SLOTS = 64
#: Share of equal slots from which a pair is compared exactly; six deviations below a Jaccard of 0.8.
LIKELY = 0.5
#: Bits of a sketch that are counted by bucket, and their mean squared lean (0 for unlike members, 1 for equal ones) from which no split helps.
SIGNS = 8
FLAT = 0.55


def runs_for(recall: float, similarity: float, overlap: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall`` even if every bucket splits ``depth`` times.

    A shared shingle is chosen by both with 1 / (overlap * size of the larger set).
    Fewest are shared, for that size, when one set holds the other: those that both
    choose branch with a mean of ``s / overlap`` a level (Poisson), so the chance to survive a
    level follows from the chance to survive the ones below.
    """
    mean, meet = similarity / overlap, 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-mean * meet)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def choose(shingles: np.ndarray, paths: np.ndarray, overlap: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of the path, child path) for every shingle that a path chooses; the chance is 1 / (overlap * size)."""
    limit = np.uint64(min(1.0, 1 / (overlap * len(shingles))) * (2**64 - 2**12))
    with np.errstate(over="ignore"):
        picks = shingles[None, :] ^ paths[:, None]
        picks *= np.uint64(0xD6E8FEB86659FD93)  # both sides are hashes already, so one product spreads them into the high bits
        rows, columns = np.nonzero(picks <= limit)
        return rows, mix(picks[rows, columns] + shingles[columns])


def sketch(shingles: np.ndarray) -> bytes:
    """One byte per slot: of the least hash in it, 0 for an empty slot."""
    hashes = mix(shingles + np.uint64(0x51ED270B))
    slots = (hashes >> np.uint64(58)).astype(np.int64)
    order = np.lexsort((hashes, slots))
    slots, hashes = slots[order], hashes[order]
    first = np.r_[True, slots[1:] != slots[:-1]]
    out = np.zeros(SLOTS, dtype=np.uint8)
    out[slots[first]] = (mix(hashes[first]) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out.tobytes()


def text_id(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.unhex(F.md5(text)).alias("id"), text.alias("text"))


def signatures(docs: DataFrame, width: int, overlap: float, depth: int, runs: int) -> DataFrame:
    """(id, sketch, signs, nodes) of every distinct text that has words; a node is (level, parent, path), and no path comes twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            ids, sketches, seen = [], [], set()
            levels, parents, found, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shingles = shingle_set(text, width)
                if not len(shingles) or name in seen:
                    continue
                seen.add(name)
                paths, before = seeds, len(found)
                for level in range(1, depth + 1):
                    if not len(paths):
                        break
                    rows, children = choose(shingles, paths, overlap)
                    children, first = np.unique(children, return_index=True)
                    rows = rows[first]
                    levels.append(np.full(len(rows), level, np.int32))
                    parents.append(paths[rows].view(np.int64))
                    found.append(children.view(np.int64))
                    paths = children
                ids.append(name)
                sketches.append(sketch(shingles))
                sizes.append(sum(map(len, found[before:])))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in (levels, parents, found)], names=["level", "parent", "path"])
            nodes = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat)
            signs = pa.array([sum((one[k] & 1) << k for k in range(SIGNS)) for one in sketches], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(sketches, pa.binary()), signs, nodes], names=["id", "sketch", "signs", "nodes"])

    rows = text_id(docs).select("id", "text").mapInArrow(run, "id binary, sketch binary, signs int, nodes array<struct<level:int,parent:long,path:long>>")
    return keep(rows.dropDuplicates(["id"]))


def bucket_sizes(rows: DataFrame) -> DataFrame:
    """(bucket, size, flat) of the buckets of two or more rows (bucket, id, signs)."""
    bit = lambda k: F.sum(F.shiftright("signs", k).bitwiseAND(F.lit(1))).alias(f"ones{k}")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), *[bit(k) for k in range(SIGNS)]).where("size > 1")
    lean = sum(F.pow(2 * F.col(f"ones{k}") / F.col("size") - 1, 2) for k in range(SIGNS)) / SIGNS
    return sizes.select("bucket", "size", (lean >= FLAT).alias("flat"))


def leaf_buckets(signed: DataFrame, small: int, depth: int) -> DataFrame:
    """(bucket, id, size) of all buckets of two or more that are compared: small and flat ones, and those of the last level."""
    leaves, open_ = [], None
    for level in range(1, depth + 1):
        nodes = F.explode(F.filter("nodes", lambda n: n["level"] == level)).alias("n")
        rows = signed.select("id", "signs", nodes).select("id", "signs", "n.parent", F.col("n.path").alias("bucket"))
        if open_ is not None:
            rows = keep(rows.join(open_.withColumnRenamed("bucket", "parent"), "parent").select("bucket", "id", "signs"))
        sizes = keep(bucket_sizes(rows))
        whole = (F.col("size") <= small) | F.col("flat") | F.lit(level == depth)
        leaves.append(rows.select("bucket", "id").join(sizes.where(whole).select("bucket", "size"), "bucket"))
        open_ = sizes.where(~whole).select("bucket")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def into_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Adds (left, right, side): a bucket above ``block`` is compared as pairs of blocks, each row going to the pairs of its block."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("left"), F.greatest("own", o).alias("right")))
    return rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("p", F.explode(pairs)).select(
        "bucket", "p.left", "p.right", (F.col("own") == F.col("p.left")).alias("side"), *[c for c in rows.columns if c != "bucket"])


def first_met(bucket: int, lists: list[list[int]]) -> np.ndarray:
    """Matrix of pairs of members that share no bucket below this one."""
    lower = [[b for b in own if b < bucket] for own in lists]
    names = {b: i for i, b in enumerate(dict.fromkeys(b for own in lower for b in own))}
    if not names:
        return np.ones((len(lists), len(lists)), dtype=bool)
    has = np.zeros((len(lists), len(names)), dtype=np.float32)
    for i, own in enumerate(lower):
        has[i, [names[b] for b in own]] = 1
    return has @ has.T == 0


def wanted_pairs(table: pa.Table) -> np.ndarray:
    """Pairs of a block pair that are this bucket's to compare: across its two blocks (or within its one), first met here."""
    side = np.array(table.column("side").to_pylist(), dtype=bool)
    left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
    across = ~np.eye(len(side), dtype=bool) if left == right else side[:, None] != side[None, :]
    return across & first_met(table.column("bucket")[0].as_py(), table.column("buckets").to_pylist())


def likely_members(rows: DataFrame) -> DataFrame:
    """Rows (bucket, left, right, side, id, buckets) that have a likely partner to be compared with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            if table.num_rows < 2:
                continue
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SLOTS)
            equal = np.zeros((len(sketches), len(sketches)), dtype=np.int16)
            used = np.zeros_like(equal)
            for slot in range(SLOTS):
                one = sketches[:, slot]
                filled = one > 0
                either = filled[:, None] | filled[None, :]
                used += either
                equal += (one[:, None] == one[None, :]) & either
            likely = (equal >= LIKELY * used) & wanted_pairs(table)
            hit = np.flatnonzero(likely.any(1))
            if len(hit):
                yield from table.take(pa.array(hit)).drop_columns(["sketch"]).to_batches()

    columns = "bucket long, left int, right int, side boolean, id binary, buckets array<long>"
    order = ["bucket", "left", "right"]
    placed = rows.select(*order, "side", "id", "buckets", "sketch").repartition(*order).sortWithinPartitions(*order)
    return placed.mapInArrow(run, columns)


def shared_counts(sets: list[np.ndarray], chunk: int = 16_384) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of incidence matrices over parts of the values."""
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, len(values), chunk):
        a, b = np.searchsorted(at, (low, low + chunk))
        has = np.zeros((len(sets), min(chunk, len(values) - low)), dtype=np.float32)
        has[owner[a:b], at[a:b] - low] = 1
        total += has @ has.T
    return total


def exact_links(rows: DataFrame, similarity: float, width: int) -> DataFrame:
    """(id, n_links, towards): links of a text that are counted in a bucket, and the least text of its group there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            if table.num_rows < 2:
                continue
            ids = table.column("id").to_pylist()
            sets = [shingle_set(t, width) for t in table.column("text").to_pylist()]
            shared, sizes = shared_counts(sets), np.array([len(s) for s in sets], dtype=np.float64)
            linked = (shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-6) & wanted_pairs(table)
            order = sorted(range(len(ids)), key=ids.__getitem__)
            root = {}
            for start in order:  # groups of this bucket, from their least member
                if start in root or not linked[start].any():
                    continue
                stack = [start]
                root[start] = start
                while stack:
                    for other in np.flatnonzero(linked[stack.pop()]).tolist():
                        if other not in root:
                            root[other] = start
                            stack.append(other)
            if root:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in root], pa.binary()), pa.array(linked[list(root)].sum(1).astype(np.int64)), pa.array([ids[r] for r in root.values()], pa.binary())],
                    names=["id", "n_links", "towards"])

    order = ["bucket", "left", "right"]
    placed = rows.select(*order, "side", "id", "buckets", "text").repartition(*order).sortWithinPartitions(*order)
    return placed.mapInArrow(run, "id binary, n_links long, towards binary")


def text_links(docs: DataFrame, similarity: float, width: int, recall: float, overlap: float, depth: int, small: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(id, n_links) of the texts with a link, and (id, root) of their classes; ``id`` is a text's hash."""
    signed = signatures(docs, width, overlap, depth, runs_for(recall, similarity, overlap, depth))
    leaves = keep(leaf_buckets(signed, small, depth))
    lists = leaves.groupBy("id").agg(F.array_sort(F.collect_list("bucket")).alias("buckets"))
    rows = leaves.join(lists.join(signed.select("id", "sketch"), "id"), "id")
    likely = keep(likely_members(into_blocks(rows, block)))
    texts = text_id(docs).select("id", "text").join(likely.select("id").distinct(), "id").dropDuplicates(["id"])
    links = keep(exact_links(likely.join(texts, "id"), similarity, width))
    counts = links.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    roots = components(links.select(F.col("id").alias("a"), F.col("towards").alias("b"))).withColumnRenamed("node", "id")
    return counts, roots


def text_classes(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.999, overlap: float = 0.8, depth: int = 3, small: int = 48, block: int = 128,
) -> DataFrame:
    """(doc_id, id, root) of every row: its text's hash, and the hash that stands for the text's class."""
    _, roots = text_links(docs, similarity, width, recall, overlap, depth, small, block)
    return text_id(docs).select("doc_id", "id").join(roots, "id", "left").select("doc_id", "id", F.coalesce("root", "id").alias("root"))


def jaccard_classes(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.999, overlap: float = 0.8, depth: int = 3, small: int = 48, block: int = 128,
) -> DataFrame:
    """One row per input row: doc_id, class_id (least id of its class), n_links (other texts at or above ``similarity``), n_copies."""
    counts, roots = text_links(docs, similarity, width, recall, overlap, depth, small, block)
    named = keep(text_id(docs).select("doc_id", "id"))
    texts_of = named.groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    placed = texts_of.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    classes = placed.groupBy("root").agg(F.min("least").alias("class_id"))
    linked = placed.join(classes, "root").join(counts, "id", "left")
    # One row per text, kept: the join with all documents then has two plain shuffles, and Spark can split a text of very many copies.
    found = keep(linked.select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies"))
    return named.join(found, "id").select("doc_id", "class_id", "n_links", "n_copies")
