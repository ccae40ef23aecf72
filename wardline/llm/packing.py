"""Harmonic packing of tokenized documents into fixed-length sequences.

Documents are cut into pieces whose lengths form reciprocal-capacity classes:
whole sequences, then powers of two from half a sequence down to ``smallest``,
then one class for each shorter length. A class of length L has bins of exactly
``capacity // L`` pieces, so a bin is described by arithmetic alone and every
worker fills the bins of its classes on its own, without a shuffle. A power of
two fills its bins without a gap; a tail class leaves fewer tokens than its own
length.

What a worker cannot complete (less than a bin for each class) is numbered
through all workers by prefix sums of counts and completed from there. What even
the whole corpus cannot complete is less than one bin for each class, a constant
(at most ``capacity`` tokens times the number of classes), and is packed by best fit.

Nulls and odd input: a null or empty text is the end token alone; a null id is
kept; repeated rows are packed as often as they occur; an empty table gives no
pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import common

CAPACITY = 4096
SMALLEST = 128
END_ID = 2
#: First numbers of sequences completed from several workers, and of those of the rest;
#: below them, each worker has a billion of its own. All fit a double exactly.
COMPLETED, REST = 1 << 51, 3 << 50
#: Words whose ids a Python worker remembers; beyond that it starts anew. They stay with the
#: worker, which later steps use as well: about 200 bytes each. Words of more bytes than
#: the second number are tokenized each time.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 64

PIECES = (
    "part int, bin long, nth int, offset int, doc_id long, start long, length int, "
    "doc_tokens long, ids binary"
)

#: Letters that the tokenizer's normalizer and splitter leave alone or lower one by one.
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_words: dict[str, Words] = {}


class Words(dict):
    """Token ids of white-space separated words, remembered by word.

    The tokenizer drops white space and never merges across it, so the ids of a
    text are those of its words one after another. Ids are little-endian 32-bit
    integers; a word is tokenized when it is first asked for.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.marks = {m: self._encoded(m) for m in (b".", b",")}
        # The printable stand-in of each byte in a byte-level vocabulary.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in shown]
        self.stand_in = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        # ASCII letters are lowered by the tokenizer anyway; special tokens are matched before.
        text = text if b"<|" in text else text.lower()
        return text.replace(b"\n", b" ").split(b" ")

    def __missing__(self, word: bytes) -> bytes:
        mark = word[-1:]
        if mark in self.marks and self._is_letters(word[:-1]):
            # After letters, a mark at the end of the word is a token of its own.
            ids = self[word[:-1]] + self.marks[mark]
        elif self._is_letters(word):
            ids = self._letters(word)
        else:
            ids = self._encoded(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    @staticmethod
    def _is_letters(word: bytes) -> bool:
        return word.isalpha() or bool(_LATIN.fullmatch(word.decode()))

    def _letters(self, word: bytes) -> bytes:
        """Ids of a word of plain letters, without the tokenizer's other steps."""
        if word.isalpha():
            text = word.lower().decode()
        else:
            lower = word.decode().lower().encode()
            text = lower.decode("latin-1").translate(self.stand_in)
        ids = [token.id for token in self.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encoded(self, word: bytes) -> bytes:
        (found,) = self.tokenizer.encode_batch_fast([word.decode()], add_special_tokens=False)
        return struct.pack(f"<{len(found.ids)}I", *found.ids)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        for text in texts:
            yield b"".join(map(self.__getitem__, self.split(text)))


def words(path: str) -> Words:
    """One per Python worker, kept from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def cuts(tokens: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Lengths that a document of so many tokens is cut into, largest first."""
    found = [capacity] * (tokens // capacity)
    rest, size = tokens % capacity, capacity // 2
    while size >= smallest:
        if rest >= size:
            found.append(size)
            rest -= size
        size //= 2
    return found + [rest] * (rest > 0)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY,
    smallest: int = SMALLEST,
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their places in sequences.

    Columns: doc_id, start, length, doc_tokens, sequence_id, offset and ``ids``
    (the piece's token ids, little-endian unsigned 32-bit). ``smallest`` must be a
    power of two and ``capacity`` a multiple of it by a power of two.
    """
    if capacity & (capacity - 1) or smallest & (smallest - 1):
        raise ValueError("capacity and smallest must be powers of two")

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        waiting: dict[int, list[tuple]] = {}
        ready: list[tuple] = []
        bins = held = 0
        for batch in common.slices(batches, 64):
            ids = batch.column(0).to_pylist()
            coded = words(tokenizer).encode(common.raw_texts(batch.column(1)))
            for doc_id, code in zip(ids, coded):
                code += end
                tokens, start = len(code) // 4, 0
                for length in cuts(tokens, capacity, smallest):
                    piece = (doc_id, start, length, tokens, code[4 * start : 4 * (start + length)])
                    start += length
                    held += length
                    line = waiting.setdefault(length, [])
                    line.append(piece)
                    if len(line) == capacity // length:
                        ready += [(part, bins, n, n * length, *p) for n, p in enumerate(line)]
                        bins += 1
                        line.clear()
                if held > 2_000_000:
                    yield _pieces(ready)
                    ready, held = [], 0
        for line in waiting.values():
            ready += [(part, -1, n, -1, *p) for n, p in enumerate(line)]
        yield _pieces(ready)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    made = common.stored(rows.mapInArrow(fill, PIECES), "pieces")
    whole = made.where("bin >= 0").select(
        "doc_id", "start", "length", "doc_tokens",
        (F.col("part").cast("long") * (1 << 30) + F.col("bin")).alias("sequence_id"),
        "offset", "ids",
    )
    return whole.unionByName(_complete(made.where("bin < 0"), capacity))


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(),
             pa.int64(), pa.binary()]
    names = [c.split()[0] for c in PIECES.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _complete(left: DataFrame, capacity: int) -> DataFrame:
    """Bins made of what single workers had left."""
    counts = left.groupBy("part", "length").agg(F.max("nth").alias("last"))
    counts = common.cut_lineage(counts)
    totals = {
        r["length"]: r["n"]  # at most one row for each class
        for r in counts.groupBy("length").agg(F.sum(F.col("last") + 1).alias("n")).collect()
    }
    if not totals:
        return left.select(
            "doc_id", "start", "length", "doc_tokens", F.col("bin").alias("sequence_id"),
            "offset", "ids",
        )
    # Workers are numbered in groups, so that no task orders all of them.
    grouped = counts.withColumn("block", F.expr("part div 1024"))
    blocks = grouped.groupBy("length", "block").agg(F.sum(F.col("last") + 1).alias("n"))
    before = F.expr(
        "coalesce(sum(n) over (partition by length order by block "
        "rows between unbounded preceding and 1 preceding), 0)"
    )
    inside = F.expr(
        "coalesce(sum(last + 1) over (partition by length, block order by part "
        "rows between unbounded preceding and 1 preceding), 0)"
    )
    places = (
        grouped.withColumn("inside", inside)
        .join(blocks.select("length", "block", before.alias("before")), ["length", "block"])
        .select("part", "length", (F.col("inside") + F.col("before")).alias("first"))
    )
    base, start_of = 0, {}
    for length in sorted(totals):
        start_of[length] = base
        base += totals[length] // (capacity // length)
    lookup = F.create_map(*[F.lit(x) for pair in start_of.items() for x in pair])
    total = F.create_map(*[F.lit(x) for pair in totals.items() for x in pair])
    per_bin = F.expr(f"{capacity} div length")
    at = F.col("first") + F.col("nth")
    placed = left.join(places, ["part", "length"]).select(
        "part", "nth", "doc_id", "start", "length", "doc_tokens", "ids",
        F.floor(at / per_bin).alias("number"), (at % per_bin).alias("pos"),
        (total[F.col("length")] - total[F.col("length")] % per_bin).alias("full"),
        at.alias("at"),
    )
    done = placed.where("at < full").select(
        "doc_id", "start", "length", "doc_tokens",
        (F.lit(COMPLETED) + lookup[F.col("length")] + F.col("number")).alias("sequence_id"),
        (F.col("pos") * F.col("length")).cast("int").alias("offset"), "ids",
    )
    # Less than one bin for each class: bounded, whatever the corpus.
    last = placed.where("at >= full")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "part", "nth"], ascending=[False, True, True])
        free: list[tuple[int, int]] = []
        bins, offsets, made = [], [], 0
        for length in rows["length"].tolist():
            at = bisect.bisect_left(free, (length, -1))
            if at == len(free):
                room, which = capacity, made
                made += 1
            else:
                room, which = free.pop(at)
            bins.append(REST + which)
            offsets.append(capacity - room)
            if room > length:
                bisect.insort(free, (room - length, which))
        return rows[["part", "nth", "length"]].assign(sequence_id=bins, offset=offsets)

    fitted = (
        last.select("part", "nth", "length").groupBy()
        .applyInPandas(fit, "part int, nth int, length int, sequence_id long, offset int")
    )
    rest = last.join(fitted, ["part", "nth", "length"]).select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"
    )
    return done.unionByName(rest)
