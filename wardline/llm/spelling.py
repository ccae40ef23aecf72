"""Spelling variants: words one edit apart, grouped under their commonest near form.

Words are joined by asymmetric q-chunks. The shorter word of a pair (either, where they
are equally long) is cut into two disjoint chunks, its halves; the other word gives its
grams of those lengths at the places where a chunk can be, its own place shifted by no
more than the difference in length. One edit spoils at most one chunk, so the other is
among the grams. The rest, which holds the edit, is cut once more in the same way: a key
holds three quarters of a word, which keeps the words that meet under a key few. What
meets is verified by the edit distance itself.

Every word gives 4 rows as the cut side and 8 as the other, whatever the corpus; words
are counted inside the tasks before anything is shuffled, so a frequent word is one row
of each task.

Nulls and odd input: a null text has no words; a null id counts as an empty one in the
hash that decides about a deletion; repeated rows each count; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import common

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form is so many times as frequent as its variant.
TIMES = 10
#: One run in so many loses a letter.
DAMAGED = 31
#: Different words a task counts before it hands them on.
HELD = 200_000


def occurrences(docs: DataFrame, least: int = LEAST_LETTERS, damaged: int = DAMAGED) -> DataFrame:
    """(word, n): counts of one task each, of words of at least ``least`` letters.

    ``damaged`` 0 leaves every run as it is.
    """
    # Deletion only shortens, so shorter runs can never be words.
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def words(doc_id: int | None, text: bytes) -> Iterator[tuple[str, int]]:
        head = f"{'' if doc_id is None else doc_id}:"
        for run, n in Counter(runs.findall(text.lower().decode())).items():
            mark = zlib.crc32((head + run).encode()) if damaged else 1
            if damaged and mark % damaged == 0:
                at = mark % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                yield run, n

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
            ["word", "n"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), common.raw_texts(batch.column(1))):
                for word, n in words(doc_id, text):
                    counts[word] += n
                if len(counts) > HELD:
                    yield batch_of(counts)
                    counts.clear()
        yield batch_of(counts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, **options: int) -> DataFrame:
    """(word, n): the distinct words that occur at least twice."""
    counted = occurrences(docs, **options).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _key(which: int, length: Column, *parts: Column) -> Column:
    """One place of two chunks in words of a length, as a number; collisions are verified away."""
    return F.xxhash64(F.lit(which), length, *parts)


def _half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def _keys(word: Column, more: int) -> list[Column]:
    """Keys under which a word meets words shorter by ``more`` letters (0 or 1).

    With 0 they are its own chunks: the half that is whole, and the quarter that is whole
    of the other half, each counted from the side on which nothing has been shifted.
    """
    size = F.char_length(word)
    length = size - more  # of the word that is cut
    first = _half(length)
    second = length - first

    def part(start: Column, count: Column) -> Column:
        return F.substring(word, start + 1, count)

    none = F.lit(0)
    # The first half is whole; the edit is in what follows it.
    head, k = part(none, first), _half(second)
    # The second half is whole, at the end; the edit is before it.
    tail, j = part(size - second, second), _half(first)
    return [
        _key(0, length, head, part(first, k)),
        _key(1, length, head, part(size - (second - k), second - k)),
        _key(2, length, tail, part(none, j)),
        _key(3, length, tail, part(size - second - (first - j), first - j)),
    ]


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): every pair of distinct ``word`` values one edit apart, once."""
    word = F.col("word")
    cut = words.select(F.col("word").alias("a"), F.explode(F.array(*_keys(word, 0))).alias("key"))
    grams = words.select(
        F.col("word").alias("b"),
        F.explode(F.array(*_keys(word, 0), *_keys(word, 1))).alias("key"),
    )
    same = F.char_length("a") == F.char_length("b")
    met = cut.join(
        grams,
        (cut["key"] == grams["key"])
        & (~same | (F.col("a") < F.col("b")))
        & (F.levenshtein("a", "b", 1) == 1),
    )
    return met.select("a", "b").distinct()


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus."""
    words = common.stored(vocabulary(docs), "words")
    pairs = common.cut_lineage(near_pairs(words.select("word")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    # Of the words near one the most frequent, and of those the first.
    best = F.min(F.struct((-F.col("b_n")).alias("less"), "b"))
    near = both.join(named, "b").groupBy("a").agg(F.count("*").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.less")
    found = words.join(near.withColumnRenamed("a", "word"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[
            F.when(form_n >= TIMES * F.col("n"), value).alias(name)
            for name, value in (("form", F.col("best.b")), ("form_n", form_n))
        ],
    )
    found = common.stored(found, "forms")
    ends = last_forms(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where following ``form`` from word to word ends.

    Every step multiplies the count by ten or more, so paths are short and have no
    circles; each round doubles how far a word looks.
    """
    at = common.cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = common.cut_lineage(at.join(further, "root", "left"))
        at = moved.select("word", F.coalesce("beyond", "root").alias("root"))
        if moved.where("beyond is not null").isEmpty():
            return at
