"""Benchmark decontamination with a BM25 index of test items and block-max pruning.

The test items are indexed by term; every passage of every document is a query.
BM25 scores are divided by the item's score against itself, so one threshold serves
all items. Items are kept in blocks of ``BLOCK``, with the largest impact of each
term in each block. As in WAND, a block is scored only if its bound reaches the
threshold: the sum of block maxima of the passage's terms, where the most frequent
terms (those that no item can have over half the threshold from) count with the most
that any item of the block has from all of them. The bound is worked out for a whole
batch of passages at once. No item above the threshold is lost.

Passages are windows of twice the longest item, each starting half a window after
the last, so that any item lies whole within one. Retrieved pairs are verified: the
passage must hold at least ``OVERLAP`` of the word shingles of the item's question
and of its answer (its last sentence; the last quarter of an item of one sentence).

The items go to the tasks in groups of at most ``GROUP`` with statistics of all
items, so what is broadcast is bounded; more groups are more passes.

Nulls and odd input: null or empty texts hold nothing and are held by nothing;
items of fewer words than a shingle identify no text and are left out; equal items
are each reported; ids may be null; repeated rows are each reported; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import common

THRESHOLD = 0.5
OVERLAP = 0.5
SHINGLE = 5
BLOCK = 2
GROUP = 20_000
#: Bounds (of a passage and a block of items) that are worked out at once.
CELLS = 2_000_000
K1, B = 1.2, 0.75

FOUND = (
    "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, "
    "passages int"
)

_word = re.compile(rb"[0-9a-z\x80-\xff]+")
_breaks = re.compile(rb"(?<=[.?!])\s+|\n+")
#: Bytes of a text that are cut into words at once.
_PART = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    return _word.findall(text.lower())


class Index:
    """Impacts of terms on items, and their maxima by block."""

    def __init__(self, items: list[tuple], frequency: dict[bytes, int], total: int, mean: float):
        self.ids = [item for item, _ in items]
        parts = [_parts(text) for _, text in items]
        self.terms: dict[bytes, int] = {}
        rows = []
        for question, answer in parts:
            rows.append([self.terms.setdefault(w, len(self.terms)) for w in question + answer])
        self.words = [np.array(r, np.int32) for r in rows]
        self.split = [len(question) for question, _ in parts]
        self.longest = max(map(len, rows))
        spread = {self.terms[w]: n for w, n in frequency.items() if w in self.terms}
        term, item, impact = [], [], []
        for at, row in enumerate(rows):
            counts = Counter(row)
            weights = {}
            for t, n in counts.items():
                rarity = np.log(1 + (total - spread[t] + 0.5) / (spread[t] + 0.5))
                weights[t] = rarity * n * (K1 + 1) / (n + K1 * (1 - B + B * len(row) / mean))
            own = sum(weights.values())
            for t, w in weights.items():
                term.append(t)
                item.append(at)
                impact.append(w / own)
        order = np.lexsort((item, term))
        self.item = np.array(item)[order]
        self.impact = np.array(impact)[order]
        sizes = np.bincount(term, minlength=len(self.terms))
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self._bounds(np.array(term)[order], sizes)

    def _bounds(self, term: np.ndarray, sizes: np.ndarray) -> None:
        # The most frequent terms, as long as no item has over half the threshold from them.
        rank = np.empty(len(sizes), np.int64)
        rank[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes))
        low, high = 0, len(sizes)
        while low < high:
            middle = (low + high + 1) // 2
            from_common = np.bincount(
                self.item, self.impact * (rank[term] < middle), len(self.ids)
            )
            low, high = (middle, high) if from_common.max() <= THRESHOLD / 2 else (low, middle - 1)
        common_terms = rank < low
        self.blocks = -(-len(self.ids) // BLOCK)
        from_common = np.bincount(self.item, self.impact * common_terms[term], len(self.ids))
        self.floor = np.zeros(self.blocks)
        np.maximum.at(self.floor, np.arange(len(self.ids)) // BLOCK, from_common)
        rare = ~common_terms[term]
        key = term[rare] * self.blocks + self.item[rare] // BLOCK
        keys, where = np.unique(key, return_inverse=True)
        top = np.zeros(len(keys))
        np.maximum.at(top, where, self.impact[rare])
        self.block, self.block_top = keys % self.blocks, top
        counts = np.bincount(keys // self.blocks, minlength=len(sizes))
        self.block_start = np.concatenate([[0], np.cumsum(counts)])

    def coded(self, text: bytes) -> np.ndarray:
        """Term numbers of a text's words, -1 for words of no item."""
        get, found, start = self.terms.get, [], 0
        while start < len(text):
            end = start + _PART
            while end < len(text) and text[end] > 32:
                end += 1
            found.append(np.array([get(w, -1) for w in words_of(text[start:end])], np.int32))
            start = end
        return np.concatenate(found) if found else np.zeros(0, np.int32)


def _parts(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Words of an item's question and of its answer."""
    sentences = [w for w in map(words_of, _breaks.split(text)) if w]
    answer = sentences[-1] if sentences else []
    question = [w for s in sentences[:-1] for w in s]
    if not question:
        cut = len(answer) - max(1, len(answer) // 4)
        question, answer = answer[:cut], answer[cut:]
    return question, answer


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers starts[i] to ends[i] for each i in a row, and their i."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which], which


def search(index: Index, documents: list[np.ndarray]) -> list[tuple[int, int, float, int, int]]:
    """(document, item, score, first word, last word) of all passages above the threshold."""
    half = max(index.longest, 2 * SHINGLE)
    segments = [max(1, -(-len(d) // half)) for d in documents]
    first = np.concatenate([[0], np.cumsum(segments)])
    words = np.concatenate(documents)
    segment = np.concatenate(
        [first[n] + np.arange(len(d)) // half for n, d in enumerate(documents)]
    ).astype(np.int64)
    known = words >= 0
    words, segment = words[known], segment[known]
    if not len(words):
        return []
    # A passage is a segment and the next one of the document.
    total, step = int(first[-1]), max(1, CELLS // index.blocks)
    follows = np.ones(total, bool)
    follows[first[1:] - 1] = False
    found = []
    for low in range(0, total, step):
        high = min(low + step + 1, total)
        part = slice(*np.searchsorted(segment, [low, high]))
        at, which = _spans(index.block_start[words[part]], index.block_start[words[part] + 1])
        cell = (segment[part][which] - low) * index.blocks + index.block[at]
        sums = np.bincount(cell, index.block_top[at], (high - low) * index.blocks)
        sums = sums.reshape(-1, index.blocks)
        bound = sums[: min(step, total - low)] + index.floor
        more = np.flatnonzero(follows[low : low + len(bound)])
        bound[more] += sums[more + 1]
        found.append(np.flatnonzero(bound.ravel() >= THRESHOLD - 1e-9) + low * index.blocks)
    found = np.concatenate(found)
    results = []
    for key in found.tolist():
        number, block = divmod(key, index.blocks)
        doc = int(np.searchsorted(first, number, "right")) - 1
        begin = (number - first[doc]) * half
        terms = np.unique(documents[doc][begin : begin + 2 * half])
        terms = terms[terms >= 0]
        at, _ = _spans(index.start[terms], index.start[terms + 1])
        items = index.item[at]
        mine = items // BLOCK == block
        scores = np.bincount(items[mine] - block * BLOCK, index.impact[at[mine]], BLOCK)
        for n in np.flatnonzero(scores >= THRESHOLD).tolist():
            results.append((doc, block * BLOCK + n, float(scores[n]), begin, begin + 2 * half))
    return results


def overlaps(index: Index, item: int, passage: np.ndarray) -> tuple[float, float]:
    """Shares of the question's and of the answer's shingles that a passage holds."""
    words, split = index.words[item], index.split[item]
    passage = passage.tolist()
    shares = []
    for part in (words[:split].tolist(), words[split:].tolist()):
        size = min(SHINGLE, len(part))
        wanted = {tuple(part[n : n + size]) for n in range(len(part) - size + 1)}
        held = {tuple(passage[n : n + size]) for n in range(len(passage) - size + 1)}
        shares.append(len(wanted & held) / len(wanted))
    return shares[0], shares[1]


def contaminated(docs: DataFrame, benchmark: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, passages) of verified pairs.

    ``score`` is the best of the passages, ``passages`` how many hold the item.
    """
    found = docs.sparkSession.createDataFrame([], FOUND)
    for shared in indexes(benchmark, group):
        found = found.unionByName(_scan(docs, shared))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, group: int = GROUP) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    at = docs.columns.index("text")

    def without(shared):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches, 64):
                held = {d for d, _ in verified(shared.value, common.raw_texts(batch.column(at)))}
                yield batch.filter(pa.array([n not in held for n in range(batch.num_rows)]))

        return run

    rows = common.numbered(docs)
    for shared in indexes(benchmark, group):
        rows = rows.mapInArrow(without(shared), rows.schema)
    return common.renamed(rows, docs)


def indexes(benchmark: DataFrame, group: int = GROUP) -> Iterator:
    """Broadcast indexes of about ``group`` items each, with statistics of all items."""
    spark = benchmark.sparkSession
    items = common.cut_lineage(_statistics(benchmark))
    facts = items.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    groups = -(-facts["n"] // group)
    for part in range(groups):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == part)
        rows = [(r["item_id"], bytes(r["text"])) for r in mine.select("item_id", "text").collect()]
        if not rows:
            continue
        counts = (
            items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count()
        )
        if groups > 1:
            counts = counts.join(mine.select(F.explode("words").alias("word")).distinct(), "word")
        frequency = {bytes(r["word"]): r["count"] for r in counts.collect()}
        rows.sort(key=lambda r: (r[1], str(r[0])))
        yield spark.sparkContext.broadcast(Index(rows, frequency, facts["n"], facts["mean"]))


def verified(index: Index, texts: list[bytes]) -> dict[tuple[int, int], list]:
    """[score, question overlap, answer overlap, passages] of each (text, item) that holds."""
    documents = [index.coded(t) for t in texts]
    best: dict[tuple[int, int], list] = {}
    for doc, item, score, begin, end in search(index, documents):
        question, answer = overlaps(index, item, documents[doc][begin:end])
        if min(question, answer) >= OVERLAP:
            row = best.setdefault((doc, item), [0.0, 0.0, 0.0, 0])
            row[:3] = max(row[:3], [score, question, answer])
            row[3] += 1
    return best


def _statistics(benchmark: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.raw_texts(batch.column(1))
            words = [words_of(t) for t in texts]
            keep = pa.array([len(w) >= SHINGLE for w in words])
            table = pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(texts, pa.binary()),
                    pa.array(words, pa.list_(pa.binary())),
                    pa.array(list(map(len, words)), pa.int32()),
                ],
                ["item_id", "text", "words", "length"],
            )
            yield table.filter(keep)

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(
        run, "item_id long, text binary, words array<binary>, length int"
    )


def _scan(docs: DataFrame, shared) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        names = [c.split()[0] for c in FOUND.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
        for batch in common.slices(batches, 64):
            ids = batch.column(0).to_pylist()
            best = verified(index, common.raw_texts(batch.column(1)))
            rows = [(ids[d], index.ids[i], *row) for (d, i), row in sorted(best.items())]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)
