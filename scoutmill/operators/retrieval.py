"""Dense, sparse, hybrid and full-text top-k over batches of queries.

Documents stay where they are: dense queries are shipped to every task in
batches of fixed size, each task keeps its own best k per query, and only those
rows are shuffled. Any number of queries is answered, one pass per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutmill.functions.text import WORD, matches
from scoutmill.operators.groups import top_rows
from scoutmill.session import keep, task_count

# Queries of one pass over the documents; 4096 vectors of dimension 1024 are 32 MB.
QUERY_BATCH = 4096
# Scores are compared at this many digits: sums taken in another order must not
# rank copies of a document differently from run to run.
SCORE_DIGITS = 9

# Characters of text whose words one task counts.
TASK_CHARS = 4_000_000
# Most terms whose frequencies are shipped to every task: about 50 MB.
SHIPPED_TERMS = 500_000


def _check_k(k: int) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")


def _batches(queries: DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """Queries (query_id, vector) in frames of at most ``size``; the driver holds one at a time."""
    held = []
    for row in queries.select("query_id", "vector").toLocalIterator():
        held.append(tuple(row))
        if len(held) == size:
            yield pd.DataFrame(held, columns=["query_id", "vector"])
            held = []
    if held:
        yield pd.DataFrame(held, columns=["query_id", "vector"])


def _all_batches(queries: DataFrame, size: int, search) -> DataFrame:
    """``search(batch)`` for every batch, together."""
    out = None
    for head in _batches(queries, size):
        found = search(head)
        out = found if out is None else out.unionByName(found)
    return queries.sparkSession.createDataFrame([], HIT) if out is None else out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by the smaller id."""
    if len(ids) > k:
        # Everything at or above the k-th score stays, so ties at the edge are decided by id.
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


# Documents scored at a time: a block of scores is QUERY_BATCH x this.
BLOCK_DOCS = 512


def _hits(query_ids, doc_ids, queries: np.ndarray, docs: np.ndarray, k) -> pd.DataFrame:
    """Best k documents per query, over blocks of documents; ties by the smaller id."""
    order = np.argsort(doc_ids, kind="stable")
    best_ids, best = np.empty((len(queries), 0), dtype=doc_ids.dtype), np.empty((len(queries), 0))
    for low in range(0, len(order), BLOCK_DOCS):
        at = order[low : low + BLOCK_DOCS]
        scores = np.round(queries @ docs[at].T, SCORE_DIGITS)
        ids = np.concatenate([best_ids, np.broadcast_to(doc_ids[at], scores.shape)], axis=1)
        scores = np.concatenate([best, scores], axis=1)
        if scores.shape[1] > k:
            # Rows whose k-th score is tied are cut by score and id, all others by score alone.
            edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            tied = (scores >= edge).sum(1) > k
            pick = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            if tied.any():
                pick[tied] = np.stack([_best(i, one, k) for i, one in zip(ids[tied], scores[tied], strict=True)])
            ids, scores = np.take_along_axis(ids, pick, 1), np.take_along_axis(scores, pick, 1)
        best_ids, best = ids, scores
    return pd.DataFrame({"query_id": np.repeat(query_ids, best.shape[1]), "doc_id": best_ids.ravel(), "score": best.ravel()})


def _merge(left: pd.DataFrame | None, right: pd.DataFrame, k: int) -> pd.DataFrame:
    both = right if left is None else pd.concat([left, right], ignore_index=True)
    both = both.sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True], kind="stable")
    return both.groupby("query_id", sort=False).head(k)


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


HIT = "query_id long, doc_id long, score double"


def dense_topk(queries: DataFrame, docs: DataFrame, k: int, batch: int = QUERY_BATCH) -> DataFrame:
    """Exact inner-product top-k of (query_id, vector) against (doc_id, vector), ``batch`` queries a pass."""
    _check_k(k)
    local = _all_batches(queries, batch, lambda head: _dense_shipped(head, docs, k))
    return top_rows(local, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)


def _dense_shipped(head: pd.DataFrame, docs: DataFrame, k: int) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast((head["query_id"].to_numpy(), _matrix(head["vector"])))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shipped.value
        best = None
        for batch in batches:
            if len(batch):
                hits = _hits(ids, batch["doc_id"].to_numpy(), q, _matrix(batch["vector"]), k)
                best = _merge(best, hits, k)
        if best is not None:
            yield best

    return docs.select("doc_id", "vector").mapInPandas(score, HIT)


def term_weights(df: DataFrame, id_col: str, text: Column, out_id: str = "doc_id", idf: bool = True, only: DataFrame | None = None) -> DataFrame:
    """Postings (id, term, weight): tf-idf, each text L2-normalised. Offline stand-in for a learned sparse model.

    The texts are placed by id and split once; their counts are kept, as both
    the document frequencies and the weights are made from them. Frequencies go
    to the counts (``_weighed``) and only numbers go on to the norms, so no
    posting moves for a common term. ``only`` (term) leaves out the postings of
    other terms; norms and frequencies are those of the whole texts all the same.
    """
    n, chars = df.agg(F.count(F.lit(1)), F.sum(F.length(text))).first()
    texts = df.select(F.col(id_col).alias(out_id), text.alias("_text"))
    texts = texts.repartition(max(task_count(df.sparkSession), -(-(chars or 0) // TASK_CHARS)), out_id)
    terms = texts.select(out_id, F.explode(words(F.col("_text"))).alias("term"))
    tf = terms.groupBy(out_id, "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("_norm")
    if not idf:
        # The terms of one text come from one row, so they fit one again.
        vectors = tf.groupBy(out_id).agg(F.collect_list(F.struct("term", "tf")).alias("_v"), norm)
        flat = vectors.select(out_id, "_norm", F.explode("_v").alias("_t")).select(out_id, "_norm", "_t.*")
        flat = flat if only is None else flat.join(only.select("term").distinct(), "term", "left_semi")
    else:
        tf = keep(tf)
        freq = keep(tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df")))
        weighed = _weighed(tf, freq, n)
        # Kept tables tell Spark their size: small ones are shipped to the counts.
        norms = keep(weighed.groupBy(out_id).agg(norm))
        if only is not None:
            weighed = _times_idf(tf.join(keep(freq.join(only.select("term").distinct(), "term", "left_semi")), "term"), n)
        flat = weighed.join(norms, out_id)
    weight = F.when(F.col("_norm") > 0, F.col("tf") / F.col("_norm")).otherwise(F.lit(0.0))
    return flat.select(out_id, "term", weight.alias("weight"))


def _times_idf(counts: DataFrame, n: int) -> DataFrame:
    return counts.withColumn("tf", F.col("tf") * F.log((F.lit(n) + 1) / (F.col("_df") + 1))).drop("_df")


def _weighed(tf: DataFrame, freq: DataFrame, n: int) -> DataFrame:
    """Counts times idf. The most frequent terms are shipped, the counts of the others are joined."""
    cut = shipped_from(freq)
    seen = tf.join(F.broadcast(freq.filter(F.col("_df") >= cut)), "term", "left")
    rare = seen.filter(F.col("_df").isNull()).drop("_df").join(freq.filter(F.col("_df") < cut).hint("shuffle_hash"), "term")
    return _times_idf(seen.filter(F.col("_df").isNotNull()).unionByName(rare), n)


def shipped_from(freq: DataFrame) -> int:
    """Least frequency that at most SHIPPED_TERMS of (term, _df) reach; the driver sees one row per frequency from there on."""
    held, cut = 0, None
    for row in freq.groupBy("_df").count().orderBy(F.col("_df").desc()).toLocalIterator():
        held += row["count"]
        if held > SHIPPED_TERMS:
            return row["_df"] + 1
        cut = row["_df"]
    return cut or 1


def words(text: Column) -> Column:
    """Lower-case words of a text, symbols left out."""
    return matches(F.lower(F.coalesce(text, F.lit(""))), rf"[{WORD}]+")


def sparse_topk(query_weights: DataFrame, doc_weights: DataFrame, k: int) -> DataFrame:
    """Inner-product top-k over postings (query_id, term, weight) and (doc_id, term, weight).

    Postings of terms that no query has are left out, the others are placed by
    document and met there by the queries, which Spark ships if they are small:
    a document's score is then added up in place, and only the best hits move.
    """
    _check_k(k)
    q = keep(query_weights.select("query_id", "term", F.col("weight").alias("qw")))
    d = doc_weights.select("doc_id", "term", F.col("weight").alias("dw")).join(q.select("term").distinct(), "term", "left_semi")
    pairs = d.repartition(task_count(d.sparkSession), "doc_id").join(q, "term")
    scored = pairs.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qw") * F.col("dw")), SCORE_DIGITS).alias("score"))
    return top_rows(scored.filter(F.col("score") > 0), ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)


def hybrid_search(queries: DataFrame, docs, query_weights: DataFrame, doc_weights, k: int,
                  sparse_weight: float = 0.7, dense_weight: float = 1.0) -> DataFrame:
    """Both legs cut at k, fused by weight, cut at k again; queries without terms are dense only.

    ``docs`` is (doc_id, vector) or a CellIndex, ``doc_weights`` postings or a SparseIndex.
    """
    from scoutmill.operators.indexes import CellIndex, SparseIndex, cell_index_topk, sparse_index_topk
    from scoutmill.operators.joins import fuse

    sparse = (sparse_index_topk if isinstance(doc_weights, SparseIndex) else sparse_topk)(query_weights, doc_weights, k)
    dense = (cell_index_topk if isinstance(docs, CellIndex) else dense_topk)(queries, docs, k)
    return fuse(sparse, dense, k, sparse_weight, dense_weight)


def fulltext_search(docs: DataFrame, queries: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents holding every word of a query, ranked by how often the words occur; best ``n`` per query.

    ``queries`` is (query_id, query). The query words are joined to per-document
    counts; the word table of a batch is small and AQE ships it. Texts are
    placed by id first: a task then counts its own few documents, not all words
    of a large split, and nothing but the best hits moves afterwards.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("term"))
    need = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("_need"))
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    tasks = max(task_count(docs.sparkSession), -(-chars // TASK_CHARS))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).repartition(tasks, "doc_id")
    counts = texts.select("doc_id", F.explode(words(F.col("_text"))).alias("term"))
    tf = counts.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    hits = tf.join(wanted, "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("tf").alias("rank"))
    full = hits.join(need, "query_id").filter(F.col("_n") == F.col("_need")).drop("_n", "_need")
    return top_rows(full, ["query_id"], [F.col("rank").desc(), F.col("doc_id")], n)


def build_cells(docs: DataFrame, cells: int, seed: int = 42, sample: float = 1.0):
    """Coarse k-means cells: (documents with their cell, centres as a numpy array)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = docs.select("doc_id", "vector", array_to_vector(F.col("vector")).alias("features"))
    train = rows if sample >= 1.0 else rows.sample(sample, seed)
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(train)
    placed = model.transform(rows).select("doc_id", "vector", F.col("prediction").alias("cell"))
    return placed, np.stack(model.clusterCenters())


def ann_topk(queries: DataFrame, placed: DataFrame, centres: np.ndarray, k: int, nprobe: int, batch: int = QUERY_BATCH) -> DataFrame:
    """Top-k inside the ``nprobe`` cells whose centres are nearest to the query, ``batch`` queries a pass.

    A document is compared only with the queries that probe its cell; a stored
    index (operators/indexes.py) also leaves the other cells' files unread.
    """
    _check_k(k)

    def search(head: pd.DataFrame) -> DataFrame:
        return score_cells(head, placed, probe_cells(_matrix(head["vector"]), centres, nprobe), k)

    local = _all_batches(queries, batch, search)
    return top_rows(local, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)


def cell_order(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cells of each query from the nearest centre on."""
    return np.argsort((centres**2).sum(axis=1) - 2 * (queries @ centres.T), axis=1, kind="stable")


def probe_cells(queries: np.ndarray, centres: np.ndarray, nprobe: int) -> dict[int, np.ndarray]:
    """Cell -> the queries that probe it: those that have it among their ``nprobe`` nearest."""
    probed = cell_order(queries, centres)[:, :nprobe]
    return {c: np.flatnonzero((probed == c).any(axis=1)) for c in range(len(centres))}


def score_cells(head: pd.DataFrame, placed: DataFrame, asks: dict[int, np.ndarray], k: int) -> DataFrame:
    """Best hits of each task among (doc_id, vector, cell) rows, each compared with the queries that ask for its cell."""
    shipped = placed.sparkSession.sparkContext.broadcast((head["query_id"].to_numpy(), _matrix(head["vector"]), asks))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, asks = shipped.value
        best = None
        for batch in batches:
            for cell, part in batch.groupby("cell"):
                who = asks[cell]
                if len(who):
                    best = _merge(best, _hits(ids[who], part["doc_id"].to_numpy(), q[who], _matrix(part["vector"]), k), k)
        if best is not None:
            yield best

    return placed.select("doc_id", "vector", "cell").mapInPandas(score, HIT)


def embed(df: DataFrame, id_col: str, text: str, fn, dim: int) -> DataFrame:
    """Vectors from a caller's ``fn(list of texts) -> matrix``, one Arrow batch at a time."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches):
        for batch in batches:
            vectors = np.asarray(fn(batch[text].fillna("").tolist()), dtype=np.float32).reshape(len(batch), dim)
            yield pd.DataFrame({id_col: batch[id_col], "vector": list(vectors)})

    return df.select(id_col, text).mapInPandas(run, schema)


def hashing_embedder(df: DataFrame, id_col: str, text: str, dim: int = 64) -> DataFrame:
    """Offline embedder: hashed tf-idf, L2-normalised, so that search can be tested without a model."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    tokens = df.select(id_col, words(F.col(text)).alias("_t"))
    tf = HashingTF(numFeatures=dim, inputCol="_t", outputCol="_tf").transform(tokens)
    weighted = IDF(inputCol="_tf", outputCol="_w").fit(tf).transform(tf)
    unit = Normalizer(inputCol="_w", outputCol="_u").transform(weighted)
    return unit.select(id_col, vector_to_array("_u", "float32").alias("vector"))
