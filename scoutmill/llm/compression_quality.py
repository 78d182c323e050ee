"""Quality classifier (operator 2): how much better good than bad text helps to compress a document.

Two zstandard dictionaries are trained, on blocks of good and of bad labelled
texts. Every document is cut into blocks and each block is compressed with
both; the normalised size differences (over the document, and of its most and
least good-like block) and the compressed share of its bytes are turned into a
probability by a logistic model fitted on labelled texts that no dictionary saw.

Fitting uses a sample of at most ``2 * per_class`` labelled rows and at most
``blocks_per_text`` blocks of each for the dictionaries; scoring reads every
whole text in Arrow batches without a shuffle. The model that ships to workers
is two dictionaries of ``dictionary_bytes`` and a dozen weights.

Defined cases: null and empty texts are scored as one empty block; without
labels of both classes every score is 0.5 (or near the one class present);
repeated rows are scored each; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutmill.llm.labelled import Logistic, class_counts, fit_logistic, labelled_sample

BLOCK = 4096
LEVEL = 3
N_FEATURES = 12


@dataclass
class CompressionModel:
    """Dictionaries of both classes and the calibration; empty dictionaries mean that a class had no text."""

    good: bytes
    bad: bytes
    calibration: Logistic


def blocks_of(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)] or [b""]


def train_dictionary(blocks: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, blocks, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:]


class Sizer:
    """Compressed sizes under a dictionary; one per worker and dictionary."""

    def __init__(self, dictionary: bytes):
        import zstandard

        trained = zstandard.ZstdCompressionDict(dictionary)
        trained.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False, write_dict_id=False)

    def __call__(self, block: bytes) -> int:
        return len(self.compressor.compress(block))


SIZERS: dict[bytes, Sizer] = {}


def sizer(dictionary: bytes) -> Sizer:
    if dictionary not in SIZERS:
        if len(SIZERS) >= 8:
            SIZERS.clear()
        SIZERS[dictionary] = Sizer(dictionary)
    return SIZERS[dictionary]


def text_features(text: str, good: Sizer, bad: Sizer) -> list[float]:
    """Normalised size differences and compressed shares of one text; small sizes are drawn towards zero."""
    sizes = np.array([(good(b), bad(b), len(b)) for b in blocks_of(text)], dtype=float)
    g, b, n = sizes.T
    by_block = (b - g) / (b + g + 20)
    over_all = (b - g).sum() / ((b + g).sum() + 20)
    steady = (b - g).sum() / ((b + g).sum() + 150)
    shares = np.log((g + 20) / (n + 20))
    share = np.log((g.sum() + 20) / (n.sum() + 20))
    length = np.log(n.sum() + 20)
    return [over_all, steady, by_block.min(), by_block.max(), share, shares.min(), shares.max(), share * share, over_all * over_all, over_all * share, length, over_all * length]


def featurise(docs: DataFrame, good: bytes, bad: bytes, keys: list[str]) -> DataFrame:
    """``keys`` and the features of every text, as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sizer(good), sizer(bad)
        for batch in batches:
            values = [text_features(t or "", a, b) for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(values, pa.list_(pa.float64()))], names=[*keys, "features"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 3000, blocks_per_text: int = 3, dictionary_bytes: int = 65536) -> CompressionModel:
    """Train on labels for which ``usable`` (over ``doc_id``) holds: half of the sample for dictionaries, half to calibrate."""
    sample = labelled_sample(docs, labels, "quality", usable, per_class)
    length = F.length("text")
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(blocks_per_text - 1)),  # evenly spaced over the text
        lambda i: F.substring(F.col("text"), (F.floor(i * F.greatest(length - BLOCK, F.lit(0)) / max(1, blocks_per_text - 1)) + 1).cast("int"), F.lit(BLOCK)))
    rows = sample.where("part < 50").select("label", "doc_id", F.array_distinct(pieces).alias("pieces")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["pieces"]))
    texts = {c: [p.encode("utf-8", "surrogatepass")[:BLOCK] for r in rows if r["label"] == c for p in r["pieces"] if p] for c in (0, 1)}
    if not texts[0] or not texts[1]:
        return CompressionModel(b"", b"", fit_logistic(np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0)))
    good, bad = (train_dictionary(texts[c], dictionary_bytes) for c in (1, 0))
    rest = featurise(sample.where("part >= 50"), good, bad, ["doc_id", "label"]).collect()
    if not rest:
        return CompressionModel(b"", b"", fit_logistic(np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0)))
    rest.sort(key=lambda r: (r["doc_id"], r["features"]))
    x, y = np.array([r["features"] for r in rest]), np.array([r["label"] for r in rest])
    totals = class_counts(labels, "quality", usable)
    weight = np.where(y == 1, totals.get(1, 0) / max(1, (y == 1).sum()), totals.get(0, 0) / max(1, (y == 0).sum()))
    return CompressionModel(good, bad, fit_logistic(x, y, weight))


def score(docs: DataFrame, model: CompressionModel, keys: list[str]) -> DataFrame:
    """``keys`` (with ``text`` or without), ``score`` (0 to 1, higher is better text) and the normalised ``size_difference``."""
    columns = keys if "text" in keys else [*keys, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = (sizer(model.good), sizer(model.bad)) if model.good else None
        for batch in batches:
            texts = batch.column(columns.index("text")).to_pylist()
            x = np.array([text_features(t or "", *tools) for t in texts]).reshape(-1, N_FEATURES) if tools else np.zeros((len(texts), N_FEATURES))
            found = [pa.array(model.calibration.score(x), pa.float64()), pa.array(x[:, 0], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *found], names=[*keys, "score", "size_difference"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*columns).mapInArrow(run, f"{kinds}, score double, size_difference double")
