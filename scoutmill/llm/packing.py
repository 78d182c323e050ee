"""Packing (operator 6): harmonic packing of tokenised documents into sequences.

A piece of length in (C/(i+1), C/i] belongs to class i, and a bin of class i
takes exactly i pieces, so bins are filled by counting alone, with no search
and no word between workers. Documents may be cut, so they are cut where
classes are full: whole sequences first, then from the rest the longest
floor(C/i) that fits, again and again. That is two or three pieces for most
rests, and a full bin of class i leaves fewer than i ids of padding. When a
worker's rows end, what is open is closed by length counts: each sequence takes
the longest pieces that still fit.

Rows are packed where they lie, without a shuffle, and each worker holds at
most one open bin per class (there are fewer than 2 * sqrt(C) lengths). A
sequence's id joins the partition's number and a counter; a lost partition read
again gives the same rows.

Defined cases: a null text is empty, an empty text is its end id alone; a null
``doc_id`` is carried through; repeated rows are packed each; an empty table
gives no sequence; extra columns are left out.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 2048
END_ID = 1
#: Words kept per worker with their ids; beyond it the store starts anew.
STORE_WORDS = 1_000_000

# Beyond U+024F one character's small form can depend on its neighbours or on the
# library, and "<|" can open a special token; texts with those keep their capitals here.
BEYOND_LATIN = re.compile("[^\u0000-ɏ]")
# Small Latin letters, then marks: two pieces for the tokenizer, whatever stands around them.
PLAIN_WORD = re.compile(r"([a-zß-öø-ɏ]+)([!-/:-@\[-`{-~]*)\Z")

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def split_words(text: str) -> list[str]:
    """Words between blanks and line ends, in small letters where that is safe."""
    if "<|" not in text and (text.isascii() or not BEYOND_LATIN.search(text)):
        text = text.lower()
    return text.replace("\n", " ").split(" ")


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space and never joins words across it.

    Equal words give equal ids, so each distinct word is tokenised once and its
    ids are kept as bytes. Letter runs are one unit of the tokenizer, ending in
    a token that closes a word; many are tokenised in one call and parted there.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.np, self.tokenizer = np, Tokenizer.from_file(path)
        # Runs of a-z between blanks need neither the normaliser nor the splitting pattern.
        self.ascii = Tokenizer.from_file(path)
        self.ascii.normalizer, self.ascii.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, at in self.tokenizer.get_vocab().items():
            self.closes[at] = token.endswith("</w>")
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def encode(self, texts: list[str], ascii_runs: bool = False) -> list[bytes]:
        tokenizer = self.ascii if ascii_runs else self.tokenizer
        return [self.np.asarray(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_runs(self, runs: list[str]) -> None:
        joined = " ".join(runs)
        ids = self.np.frombuffer(self.encode([joined], joined.isascii())[0], dtype="<u4")
        ends = self.np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(runs):
            raw, start = ids.tobytes(), 0
            for run, end in zip(runs, ends.tolist(), strict=True):
                self.runs[run] = raw[4 * start : 4 * end]
                start = end
        else:  # a letter that this tokenizer doesn't count as one
            self.runs.update(zip(runs, self.encode(runs), strict=True))

    def learn(self, words: list[str]) -> None:
        if len(self.words) > STORE_WORDS:
            self.words.clear()
            self.runs.clear()
        plain, other = [], []
        for word in words:
            found = PLAIN_WORD.match(word)
            if found:
                plain.append((word, *found.groups()))
            else:
                other.append(word)
        new = list({run for _, run, _ in plain if run not in self.runs})
        marks = list({m for _, _, m in plain if m and m not in self.runs})
        for kind in ([r for r in new if r.isascii()], [r for r in new if not r.isascii()]):
            if kind:
                self.learn_runs(kind)
        if marks:
            self.runs.update(zip(marks, self.encode(marks), strict=True))
        for word, run, mark in plain:
            self.words[word] = self.runs[run] + self.runs[mark] if mark else self.runs[run]
        if other:
            self.words.update(zip(other, self.encode(other), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [split_words(t) for t in texts]
        found = [list(map(self.words.get, words)) for words in split]
        new = [i for i, parts in enumerate(found) if None in parts]
        missing = set()
        for i in new:
            missing.update(w for w, part in zip(split[i], found[i], strict=True) if part is None)
        if missing:
            self.learn(list(missing))
        for i in new:
            found[i] = [part if part is not None else self.words[w] for w, part in zip(split[i], found[i], strict=True)]
        return [b"".join(parts) for parts in found]


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of ``n`` ids: whole sequences, then from the rest the longest floor(capacity / i) each time."""
    lengths, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        lengths.append(capacity // (capacity // (rest + 1) + 1))
        rest -= lengths[-1]
    return lengths


class ClassBins:
    """Bins of one worker: class i (pieces of floor(capacity / i) ids) closes a bin at i pieces."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list[tuple]] = {}

    def close(self, pieces: list[tuple]) -> list[tuple]:
        """Rows of one sequence; a piece's third entry is its length."""
        rows, offset = [], 0
        for piece in pieces:
            rows.append((*piece, self.next, offset))
            offset += piece[2]
        self.next += 1
        return rows

    def add(self, piece: tuple) -> list[tuple]:
        """Rows that are settled by this piece: none, or a full bin's."""
        length = piece[2]
        bin_ = self.open.setdefault(length, [])
        bin_.append(piece)
        if len(bin_) < self.capacity // length:
            return []
        self.open[length] = []
        return self.close(bin_)

    def finish(self) -> list[tuple]:
        """Rows of the open bins: each sequence takes the longest pieces that still fit, until none is left."""
        left = {length: pieces for length, pieces in sorted(self.open.items(), reverse=True) if pieces}
        rows, self.open = [], {}
        while left:
            taken, room = [], self.capacity
            for length in list(left):
                count = min(len(left[length]), room // length)
                if count:
                    taken += left[length][-count:]
                    del left[length][-count:]
                    room -= count * length
                if not left[length]:
                    del left[length]
            rows += self.close(taken)
        return rows


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id") -> DataFrame:
    """One row per piece: ``key``, its place in the document, checksum of its ids, its sequence and its place there.

    ``tokenizer_path`` is a file that every worker has (a public tokenizer's).
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    kind = docs.schema[key].dataType
    end = end_id.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(tokenizer_path)
        bins = ClassBins(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for low in range(0, len(texts), 64):
                rows = []
                for name, ids in zip(names[low : low + 64], tokenizer.ids(texts[low : low + 64]), strict=True):
                    ids += end
                    start, total = 0, len(ids) // 4
                    for length in cut_lengths(total, capacity):
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        rows += bins.add((name, start, length, crc, total))
                        start += length
                if rows:
                    yield as_batch(rows, batch.schema.field(0).type, key)
        if rows := bins.finish():
            yield as_batch(rows, arrow_type, key)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(kind)
    return docs.select(key, "text").mapInArrow(pack, f"`{key}` {kind.simpleString()}, {PIECES}")


def as_batch(rows: list[tuple], kind: pa.DataType, key: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    names = [key, *(part.split()[0] for part in PIECES.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)


TOKENIZERS: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer; loaded once, so that its word store serves all its tasks."""
    if path not in TOKENIZERS:
        TOKENIZERS[path] = WordTokenizer(path)
    return TOKENIZERS[path]
