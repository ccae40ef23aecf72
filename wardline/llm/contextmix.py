"""Scoring text with online logistic context mixing.

A text is a row of tokens: its words (ASCII letters lowered) and one end. Tokens are
coded as bits: a word of the dictionary has a prefix code from its frequency; any
other word is an escape, its bytes, and a line feed, in a prefix code of bytes. Each
bit is predicted in three hashed contexts: for words the node of the code alone, with
the word before, and with two words before; for bytes with one, two and four bytes
before. Bit counts of all training texts are gathered in one table for each context,
made by every task and summed by block of the table.

The three predictions, in the logistic domain, are mixed by weights that a gate
chooses (how sure the second and third are, and what kind of symbol it is). Weights
start from what all training texts taught them, go on learning through each text, and a
correction indexed by the mixed prediction is refined the same way. For teaching, texts
are halved by a hash of the text, and each half is predicted from the tables of the
other: every task counts its bits by class of the three predictions, and the starting
weights are fitted on the summed counts. Scores are from tables of all training texts.
A text always starts from the same state, so scores do not depend on partitions. The sum
of the bits' log10 probabilities is the text's score; ``bits_per_byte`` is that over its
length.

Words are looked up in the dictionary once: the numbers of a text's words and the words
without a number are stored, and tables, teaching and scores read those.

Counts of words cover all training texts. Those of dictionary words are sent to every
task (the dictionary has at most ``DICTIONARY`` words); counts of all others are
joined by word. A long text is scored in parts that carry the state on.

Nulls and odd input: a null text is an empty one, i.e. the end alone; null ids count
as empty text for the split; repeated rows each come back; without training texts
all counts are zero; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import common

DICTIONARY = 1 << 19
SLOT_BITS = 20
CONTEXTS = 3
#: Share of the texts, by hash, in the second of the halves that teach the weights.
SHARE = 0.5
#: Symbols of a text before the first update of its weights; then half as many as there
#: were, up to the second number.
STEP, LONG_STEP = 256, 2048
#: Texts that are scored side by side.
LANES = 256
#: Bytes of texts whose scores a task remembers for copies.
REMEMBERED_BYTES = 8_000_000
RATE, REFINE = 0.004, 0.02
GATES, LEVELS = 18, 24
#: Upper ends of the classes of a prediction's size, for teaching; zero is a class of its own.
#: The gates' own limit of 2 is among them.
CLASS_ENDS = np.array([0.25, 0.5, 1, 1.5, 2, 2.5, 3, 4, 5, 6.5, 8.5], np.float32)
CLASS_MIDDLES = np.array([0.125, 0.375, 0.75, 1.25, 1.75, 2.25, 2.75, 3.5, 4.5, 5.75, 7.5, 9.5])
CLASSES = 2 * len(CLASS_MIDDLES) + 1
CELLS = 4 * CLASSES**CONTEXTS
#: Symbols that are made bits of at once to count them, and to score them. A table is read
#: and written all over, and is quickest to reach while no other is: slots are looked up or
#: counted many at a time (``GATHERED_SLOTS``), and mixed by ``BLOCK`` bits.
CHUNK, WIDE = 1 << 14, 1 << 16
GATHERED_SLOTS, BLOCK = 1 << 20, 1 << 15
#: Bytes of texts that are cut into words at once, and of numbers of words scored at once:
#: many texts, so that those side by side are of like length.
SLAB, GROUP = 1 << 23, 1 << 21
#: Rows of word counts that a task gathers before it adds them up.
GATHERED = 800_000
END = b"\n"
_SLOTS = 1 << SLOT_BITS
_BLOCK = 1 << 16
_PART = 1 << 20

_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def parts_of(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, those of about a megabyte at a time; at least one part."""
    start = 0
    while True:
        end = start + _PART
        while end < len(text) and text[end] > 32:
            end += 1
        yield text[start:end].lower().split()
        start = end
        if start >= len(text):
            return


def slabs(batch: pa.RecordBatch, by: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows whose cells of column ``by`` are of ``most`` bytes together; a longer one alone."""
    column = batch.column(by)
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(column):
        done = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def is_long(texts: pa.Array) -> bool:
    """Whether a slab is one text that is better read in parts."""
    return len(texts) == 1 and (pc.binary_length(texts)[0].as_py() or 0) > SLAB


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of texts, the place there of each word, and where each text's words end.

    Words as ``parts_of`` has them, a null text without any.
    """
    kind = pa.large_string() if pa.types.is_large_string(texts.type) else pa.string()
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, pa.scalar("", kind))))
    coded = split.flatten().dictionary_encode()
    place, ends = coded.indices.to_numpy(), split.offsets.to_numpy()
    # White space at either end of a text leaves an empty word there.
    empty = pc.index(coded.dictionary, pa.scalar("", kind)).as_py()
    if empty >= 0:
        kept = place != empty
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        place = place[kept]
    return coded.dictionary.cast(pa.binary()), place, ends[1:]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c) of all tokens, the end of a text written as a line feed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for [texts] in slabs(batch, 0, SLAB):
                if is_long(texts):
                    [text] = common.raw_texts(texts)
                    more = (_counted(*zip(*Counter(p).items())) for p in parts_of(text) if p)
                else:
                    words, place, _ = words_of(texts)
                    more = [_counted(words, np.bincount(place, minlength=len(words)))]
                for counts in chain(more, [_counted([END], [len(texts)])]):
                    held.append(counts)
                    rows += len(counts)
                    if rows > GATHERED:
                        held = [_added(held)]
                        rows = len(held[0])
                    if rows > GATHERED // 2 and len(held) == 1:
                        yield from held[0].to_batches(20_000)
                        held, rows = [], 0
        if held:
            yield from _added(held).to_batches(20_000)

    each = docs.select("text").mapInArrow(run, "word binary, n long")
    return each.groupBy("word").agg(F.sum("n").alias("c"))


def _counted(words, numbers) -> pa.Table:
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
    counts = pa.table({"word": words.cast(pa.binary()), "n": pa.array(numbers, pa.int64())})
    return counts.filter(pc.field("n") > 0)


def _added(counts: list[pa.Table]) -> pa.Table:
    """Counts of each word, added up."""
    grouped = pa.concat_tables(counts).group_by("word", use_threads=False)
    return grouped.aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words seen twice or more, down to a frequency that at most ``most`` words have.

    The frequency is found on a scale of eighths of a power of two, so that no more
    than a few hundred numbers are compared.
    """
    scale = F.floor(F.log2("c") * 8)
    words = counts.where((F.col("c") > 1) & (F.col("word") != F.lit(bytearray(END))))
    sizes = sorted(
        ((r["s"], r["count"]) for r in words.groupBy(scale.alias("s")).count().collect()),
        reverse=True,
    )
    total, least = 0, None
    for level, size in sizes:
        if total + size > most:
            break
        total, least = total + size, level
    if least is None:
        return []
    rows = words.where(scale >= least).select("word", "c").toArrow()
    return sorted(zip(rows["word"].to_pylist(), rows["c"].to_pylist()))


class Counts:
    """Counts of slots in 16 bits each, which halves what is reached into all over.

    Half of a count near its end is noted apart.
    """

    def __init__(self, slots: int):
        self.low = np.zeros(slots, np.uint16)
        self.high: list[np.ndarray] = []
        self.room = 0xFFFF
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, slots: np.ndarray) -> None:
        self.held.append(slots)
        self.size += len(slots)
        if self.size >= GATHERED_SLOTS:
            self._count()

    def _count(self) -> None:
        for slots in self.held:
            at = 0
            while at < len(slots):
                if not self.room:
                    if (top := int(self.low.max())) >> 15:
                        full = np.flatnonzero(self.low >= np.uint16(1 << 15))
                        self.low[full] -= np.uint16(1 << 15)
                        self.high.append(full)
                        top = int(self.low.max())
                    self.room = 0xFFFF - top
                # Not even if all of these were one slot would it run over.
                part = slots[at : at + self.room]
                np.add.at(self.low, part, np.uint16(1))
                at += len(part)
                self.room -= len(part)
        self.held, self.size = [], 0

    def total(self) -> np.ndarray:
        """All counts, as uint32."""
        self._count()
        total = self.low.astype(np.uint32)
        for full in self.high:
            total[full] += np.uint32(1 << 15)
        return total


class Coder:
    """Prefix codes of dictionary words, the escape, the end, and the bytes of other words."""

    def __init__(self, words: list[tuple[bytes, int]], ends: int, escapes: int):
        self.size = len(words)
        self.ids = {w: n for n, (w, _) in enumerate(words)}
        self.counts = np.array([c for _, c in words] + [0, ends], np.int64)
        weights = [c for _, c in words] + [max(1, escapes), max(1, ends)]
        spelled = Counter(b for w, _ in words for b in w)
        spelled[10] = len(words)
        letters = [spelled[b] + 1 for b in range(256)]
        codes, lengths = zip(_prefix_code(weights), _prefix_code(letters))
        self.codes = np.concatenate(codes).astype(np.uint32)
        self.lengths = np.concatenate(lengths).astype(np.int32)

    def symbols(self, words: list[bytes], before: tuple[int, int], last: bool):
        """Symbols of a part of a text with their contexts, and what the next part needs.

        Returns (symbols, three contexts, the last two words, ids of words, other words).
        """
        ids, others = self.numbers(words, last)
        return *self.laid(ids, others, before), ids, others

    def numbers(self, words: list[bytes], last: bool) -> tuple[np.ndarray, list[bytes]]:
        """Ids of words, -1 for those outside the dictionary, and the latter."""
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words))
        others = [words[at] for at in np.flatnonzero(ids < 0).tolist()]
        if last:
            ids = np.append(ids, np.int32(self.size + 1))
        return ids, others

    def encoded(self, text: bytes) -> tuple[np.ndarray, list[bytes]]:
        """``numbers`` of a whole text."""
        parts = [self.numbers(words, last) for words, last in _marked(parts_of(text))]
        if len(parts) == 1:
            return parts[0]
        return np.concatenate([ids for ids, _ in parts]), [w for _, o in parts for w in o]

    def encoded_together(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """``numbers`` of each of several whole texts: ids (int32), and other words by line feed."""
        if is_long(texts):
            ids, others = self.encoded(*common.raw_texts(texts))
            return pa.array([ids.tobytes()], pa.binary()), pa.array([b"\n".join(others)], pa.binary())
        words, place, ends = words_of(texts)
        # One text of all words, cut again: quicker than an object for each.
        spelled = _lines(words, np.array([0, len(words)]))[0].as_py().split(b"\n")
        known = np.fromiter(map(self.ids.get, spelled, repeat(-1)), np.int32, len(spelled))
        ids = known[place]
        rare = ids < 0
        before = np.concatenate([[0], np.cumsum(rare)])[np.append(0, ends)]
        others = _lines(words.take(pa.array(place[rare])), before)
        ids = np.insert(ids, ends, np.int32(self.size + 1))
        starts = 4 * np.append(0, ends + np.arange(1, len(ends) + 1))
        numbers = pa.Array.from_buffers(
            pa.binary(), len(ends), [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(ids)]
        )
        return numbers, others.cast(pa.binary())

    def laid(
        self, ids: np.ndarray, others: list[bytes], before: tuple[int, int],
        starts: np.ndarray | None = None,
    ):
        """Symbols of words, three contexts of each, and the last two words.

        Where several texts follow one another, no word is before those at ``starts``.
        """
        missing = np.flatnonzero(ids < 0)
        row = np.empty(len(ids) + 2, np.uint32)
        row[:2] = before
        named = row[2:]
        np.multiply((ids + 1).view(np.uint32), _M3, out=named)
        if others:
            named[missing] = np.fromiter(map(zlib.crc32, others), np.uint32, len(others))
        one, two = row[1:-1], row[:-2]
        if starts is not None:
            one, two = one.copy(), two.copy()
            one[starts] = two[starts] = 0
            two[(starts + 1)[starts + 1 < len(ids)]] = 0
        heads = one * _M1 + np.uint32(1), (one * _M2) ^ (two * _M1)
        last = int(row[-2]), int(row[-1])
        if not others:
            contexts = np.zeros((CONTEXTS, len(ids)), np.uint32)
            contexts[1], contexts[2] = heads
            return ids, contexts, last
        spelled = np.fromiter(map(len, others), np.int64, len(others)) + 1
        more = np.zeros(len(ids), np.int64)
        more[missing] = spelled
        start = np.arange(len(ids)) + np.cumsum(more) - more
        total = len(ids) + int(spelled.sum())
        # Bytes of the k-th word without a number stand behind its symbol and k words' bytes.
        spell = np.arange(total - len(ids)) + np.repeat(missing + 1, spelled)
        symbol = np.empty(total, np.int32)
        contexts = np.empty((CONTEXTS, total), np.uint32)
        symbol[start] = np.where(ids < 0, self.size, ids)
        contexts[0] = 0
        for context, head in zip(contexts[1:], heads):
            context[start] = head
        text = np.frombuffer(b"\n".join(others) + b"\n", np.uint8).astype(np.uint32)
        symbol[spell] = text.view(np.int32) + np.int32(self.size + 2)
        back = np.concatenate([np.full(4, 10, np.uint32), text])
        near = [back[4 - n : len(back) - n] for n in range(1, 5)]
        for n in range(1, 4):  # nothing from before the word
            near[n] = np.where(near[n - 1] == 10, np.uint32(10), near[n])
        contexts[0, spell] = (near[0] + np.uint32(1)) * _M2
        pair = near[0] | near[1] << np.uint32(8)
        contexts[1, spell] = pair * _M3 + np.uint32(7)
        packed = pair | near[2] << np.uint32(16) | near[3] << np.uint32(24)
        contexts[2, spell] = packed * _M1 + np.uint32(11)
        return symbol, contexts, last

    def laid_together(self, texts: list[tuple[np.ndarray, list[bytes]]]):
        """Symbols and contexts of short whole texts one after another, and where each ends."""
        ids = np.concatenate([i for i, _ in texts])
        others = [w for _, o in texts for w in o]
        words = np.cumsum([len(i) for i, _ in texts])
        symbol, contexts, _ = self.laid(ids, others, (0, 0), np.append(0, words[:-1]))
        return symbol, contexts, words + np.cumsum([sum(map(len, o)) + len(o) for _, o in texts])

    def chunks(self, texts: list[tuple[np.ndarray, list[bytes]]]) -> Iterator[tuple]:
        """Symbols and contexts of all texts, about ``CHUNK`` at a time."""
        short: list = []
        held = 0
        for n, (ids, others) in enumerate(texts):
            size = len(ids) + sum(map(len, others)) + len(others)
            if size > CHUNK:
                laid = ((symbol, contexts) for symbol, contexts, _ in self.parts(ids, others))
            else:
                short.append((ids, others))
                held += size
                laid = iter(())
            if short and (held > CHUNK or n + 1 == len(texts)):
                laid = chain(laid, [self.laid_together(short)[:2]])
                short, held = [], 0
            for symbol, contexts in laid:
                pieces = max(1, round(len(symbol) / CHUNK))  # none much smaller
                for n_th in range(pieces):
                    own = slice(len(symbol) * n_th // pieces, len(symbol) * (n_th + 1) // pieces)
                    yield symbol[own], contexts[:, own]

    def parts(self, ids: np.ndarray, others: list[bytes]) -> Iterator[tuple]:
        """``laid`` for about ``_PART`` symbols at a time: (symbols, contexts, last)."""
        before, at, taken = (0, 0), 0, 0
        costs = np.ones(len(ids), np.int64)
        costs[ids < 0] = [len(w) + 2 for w in others]
        ends = np.cumsum(costs)
        while at < len(ids):
            done = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + _PART, "right")))
            part = ids[at:end]
            rare = int((part < 0).sum())
            symbol, contexts, before = self.laid(part, others[taken : taken + rare], before)
            at, taken = end, taken + rare
            yield symbol, contexts, at == len(ids)

    def without_ids(self) -> Coder:
        """The same codes without the dictionary, for steps that read stored numbers."""
        light = copy.copy(self)
        light.ids = {}
        return light

    def bits(self, symbol: np.ndarray, contexts: np.ndarray):
        """Bits of the symbols: (bits of each symbol, bit, its slot in each table)."""
        lengths = self.lengths[symbol]
        total = int(lengths.sum())
        left = np.repeat(np.cumsum(lengths, dtype=np.int32), lengths)
        left -= np.arange(total, dtype=np.int32)
        code = np.repeat(self.codes[symbol], lengths)
        around = (np.repeat(context, lengths) for context in contexts)
        return lengths, *_slots(code, left.view(np.uint32), np.repeat(lengths.view(np.uint32), lengths), around)

    def layers(self, symbol: np.ndarray, contexts: np.ndarray, kind: np.ndarray):
        """``bits`` in another order, for counts: the symbols' first bits, their second ones
        and so on. Returns (``kind`` of the symbol of each bit, bit, its slot in each table).

        Symbols are put in order of length, so a layer is the first of them, as they are.
        """
        order, sizes, bit, slots = self.layered(symbol, contexts)
        return _spread(kind[order], sizes), bit, slots

    def layered(self, symbol: np.ndarray, contexts: np.ndarray):
        """(order of the symbols, symbols of each layer, and bits and slots as ``layers``)."""
        lengths = self.lengths[symbol].astype(np.uint8)
        order = np.argsort(~lengths, kind="stable")  # of bytes: by counting
        symbol, lengths = symbol[order], lengths[order].astype(np.uint32)
        longer = len(symbol) - np.cumsum(np.bincount(lengths))
        sizes = longer[longer > 0].tolist()
        lengths = _spread(lengths, sizes)
        left = lengths - np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        around = (_spread(context[order], sizes) for context in contexts)
        return order, sizes, *_slots(_spread(self.codes[symbol], sizes), left, lengths, around)


def _spread(values: np.ndarray, sizes: list[int]) -> np.ndarray:
    """For each layer the first values, so many as it has."""
    return np.concatenate([values[:size] for size in sizes])


def _lines(words: pa.Array, cuts: np.ndarray) -> pa.Array:
    """Words between each cut and the next, by line feed."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), words), b"\n")


def _slots(code: np.ndarray, left: np.ndarray, lengths: np.ndarray, contexts) -> tuple:
    """(bit, its slot in each table) of bits with so many ``left`` of their symbols' codes.

    Writes over its arguments.
    """
    node = code >> left  # codes have under 32 bits
    more = left * _M3
    node ^= more
    node *= _M1
    node += lengths
    left -= np.uint32(1)
    code >>= left
    code &= np.uint32(1)
    slots = []
    for slot in contexts:
        slot ^= node
        np.right_shift(slot, np.uint32(15), out=more)
        slot ^= more
        slot *= _M2
        slot >>= np.uint32(32 - SLOT_BITS)
        slots.append(slot.view(np.int32))
    return code, slots


def _prefix_code(weights: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code words and lengths: Huffman's lengths, numbered from the shortest on.

    Weights count as a millionth of the total at least, which keeps codes under 32 bits.
    """
    weights = np.array(weights, np.float64)
    weights = np.maximum(weights, weights.sum() / (1 << 20))
    order = np.argsort(-weights, kind="stable")[::-1]
    count = len(weights)
    leaves, joined = weights[order].tolist(), []
    parent = [0] * (2 * count - 1)
    at = up = 0
    for new in range(count, 2 * count - 1):
        total = 0.0
        for _ in range(2):
            if at < count and (up == len(joined) or leaves[at] <= joined[up]):
                total += leaves[at]
                parent[at] = new
                at += 1
            else:
                total += joined[up]
                parent[count + up] = new
                up += 1
        joined.append(total)
    depth = [0] * (2 * count - 1)
    for node in range(2 * count - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    lengths = np.empty(count, np.int64)
    lengths[order] = np.maximum(depth[:count], 1)
    by_length = np.argsort(lengths, kind="stable")
    steps = 2.0 ** (32 - lengths[by_length])  # exact in a double
    codes = np.zeros(count, np.int64)
    codes[by_length] = (np.cumsum(steps) - steps).astype(np.int64) >> (32 - lengths[by_length])
    return codes, lengths


def encode(docs: DataFrame, shared) -> DataFrame:
    """``docs`` with its texts' words as numbers: ids (int32), and other words by line feed."""
    at = docs.columns.index("text")
    names = [*(c for c in docs.columns if c != "text"), "bytes", "ids", "others"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder: Coder = shared.value
        for batch in batches:
            for slab in slabs(batch, at, SLAB):
                rest = slab.columns
                texts = rest.pop(at)
                lengths = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*rest, lengths, *coder.encoded_together(texts)], names
                )

    made = common.extended(docs.drop("text"), bytes="long", ids="binary", others="binary")
    return docs.mapInArrow(run, made)


def _read(ids: list[bytes], others: list[bytes]) -> list[tuple[np.ndarray, list[bytes]]]:
    """What ``encode`` wrote."""
    return [
        (np.frombuffer(i, np.int32), o.split(b"\n") if o else []) for i, o in zip(ids, others)
    ]


def _by_half(batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple]]]:
    """Texts of a batch of (drawn, ids, others) by half."""
    drawn, ids, others = (c.to_pylist() for c in batch.columns)
    texts = _read(ids, others)
    for half in range(2):
        own = [text for text, at in zip(texts, drawn) if at == half]
        if own:
            yield half, own


def tables(docs: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """Stretched probability of a set bit for each slot of the three tables.

    Once from all ``docs`` (text, drawn), once from those that are not drawn.
    """
    return halves(encode(docs.select("text", "drawn"), shared), shared)[:2]


def halves(encoded: DataFrame, shared) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tables`` of encoded texts: of all, of those that are not drawn, of those that are."""
    counters = 2 * CONTEXTS * _SLOTS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder: Coder = shared.value
        both = [[Counts(2 * _SLOTS) for _ in range(CONTEXTS)] for _ in range(2)]
        # Without a context a word's bits are the same each time: words are counted, and
        # their bits once at the end.
        plain = np.zeros((2, coder.size + 2), np.int64)
        squeeze = pa.Codec("zstd", 1)
        for batch in common.slices(batches):
            for half, texts in _by_half(batch):
                for part, around in coder.chunks(texts):
                    spelled = part >= coder.size + 2
                    np.add.at(plain[half], part[~spelled], 1)
                    for own, first in ((~spelled, 1), (spelled, 0)):
                        if not own.any():
                            continue
                        _, bit, slots = coder.layers(part[own], around[first:, own], spelled[own])
                        bit = bit.view(np.int32)
                        for sums, slot in zip(both[half][first:], slots):
                            slot <<= 1
                            slot |= bit
                            sums.add(slot)
        for drawn, (own, times) in enumerate(zip(both, plain)):
            sums = np.stack([own.pop(0).total() for _ in range(CONTEXTS)])
            seen = np.flatnonzero(times)
            for at in range(0, len(seen), 1 << 16):
                part = seen[at : at + (1 << 16)].astype(np.int32)
                none = np.zeros((1, len(part)), np.uint32)
                lengths, bit, slots = coder.bits(part, none)
                key = (slots[0] << 1) | bit.view(np.int32)
                weights = np.repeat(times[part], lengths)
                sums[0] += np.bincount(key, weights, len(sums[0])).astype(np.uint32)
            sums = sums.reshape(-1)
            for block in range(counters // _BLOCK):
                part = sums[block * _BLOCK : (block + 1) * _BLOCK]
                if drawn and not part.any():
                    continue
                wide = bool(part.max(initial=0) >> 16)
                if not wide:
                    part = part.astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int32()), pa.array([bool(drawn)]), pa.array([wide]),
                        pa.array([squeeze.compress(part, asbytes=True)], pa.binary()),
                    ],
                    ["block", "drawn", "wide", "counts"],
                )

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, squeeze = None, None, pa.Codec("zstd")
        for batch in batches:
            for block, drawn, wide, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    if now is not None:
                        yield _stretched(now, total)
                    now, total = block, np.zeros((2, _BLOCK), np.uint64)
                size = 4 * _BLOCK if wide else 2 * _BLOCK
                raw = squeeze.decompress(packed, size)
                total[int(drawn)] += np.frombuffer(raw, np.uint32 if wide else np.uint16)
        if now is not None:
            yield _stretched(now, total)

    made = encoded.select("drawn", "ids", "others").mapInArrow(
        count, "block int, drawn boolean, wide boolean, counts binary"
    )
    summed = (
        made.repartition("block").sortWithinPartitions("block")
        .mapInArrow(add, "block int, whole binary, rest binary, drawn binary")
    )
    found = np.zeros((3, CONTEXTS * _SLOTS), np.float32)  # a fixed size, whatever the corpus
    for row in summed.toLocalIterator():
        start = row["block"] * (_BLOCK // 2)
        for table, name in zip(found, ("whole", "rest", "drawn")):
            table[start : start + _BLOCK // 2] = np.frombuffer(row[name], np.float32)
    return tuple(found.reshape(3, CONTEXTS, _SLOTS))


def _stretched(block: int, counts: np.ndarray) -> pa.RecordBatch:
    """Of a block's counts by half: those of all, and of each half."""

    def values(of: np.ndarray) -> pa.Array:
        zeros, ones = of[0::2].astype(np.float64), of[1::2].astype(np.float64)
        stretched = np.log((ones + 0.05) / (zeros + 0.05)).astype(np.float32)
        return pa.array([stretched.tobytes()], pa.binary())

    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), values(counts.sum(0)), *map(values, counts)],
        ["block", "whole", "rest", "drawn"],
    )


def _marked(parts: Iterator[list[bytes]]) -> Iterator[tuple[list[bytes], bool]]:
    """Parts with whether they are the last."""
    held = next(parts)
    for part in parts:
        yield held, False
        held = part
    yield held, True


def classes(table: np.ndarray) -> np.ndarray:
    """The class of each stretched probability: zero in the middle, its sign on either side."""
    size = np.searchsorted(CLASS_ENDS, np.abs(table), "left") + 1
    return (CLASSES // 2 + np.where(table == 0, 0, np.where(table > 0, size, -size))).astype(np.uint8)


def lessons(encoded: DataFrame, shared, others_tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many bits of all training texts have each kind of symbol, classes of inputs, and value.

    ``others_tables``: for texts that are not drawn, and for drawn ones, the tables of the
    other half.
    """
    spark = encoded.sparkSession
    kinds = spark.sparkContext.broadcast(np.stack([classes(t) for t in others_tables]))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder: Coder = shared.value
        sums = np.zeros(CELLS, np.int64)
        for batch in common.slices(batches):
            for half, texts in _by_half(batch):
                for part, around in coder.chunks(texts):
                    spelled = (part >= coder.size + 2).astype(np.uint16)
                    cell, bit, slots = coder.layers(part, around, spelled)
                    for values, slot in zip(kinds.value[half], slots):
                        cell *= np.uint16(CLASSES)  # CELLS are under 2**16
                        cell += values.take(slot, mode="clip")
                    cell <<= 1
                    cell |= bit.astype(np.uint16)
                    np.add.at(sums, cell, 1)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), pa.array(sums[seen], pa.int64())], ["cell", "n"]
        )

    made = encoded.select("drawn", "ids", "others").mapInArrow(count, "cell int, n long")
    total = np.zeros(CELLS, np.int64)
    rows = made.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    total[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return total


class Mixer:
    """Weights by gate and a correction by level, for each of several texts."""

    def __init__(self, table: np.ndarray, coder: Coder):
        self.table, self.coder = table, coder
        self.weights = np.empty((CONTEXTS + 1, GATES), np.float32)
        self.weights[:] = np.array([[0.6], [0.3], [0.3], [0.0]], np.float32)
        self.levels = np.zeros(LEVELS, np.float32)

    def settle(self) -> None:
        """Copies tables that came with a broadcast to where numpy asks for large pages."""
        if not self.table.flags.owndata:
            self.table = self.table.copy()

    def start(self, lanes: int) -> list[np.ndarray]:
        return [np.tile(w, lanes) for w in self.weights] + [np.tile(self.levels, lanes)]

    def step(
        self, state, lanes: np.ndarray, sizes: list[int], symbol, contexts, ended: int = 0
    ) -> np.ndarray:
        """Log probabilities (natural) of the symbols of each lane; updates the state.

        ``sizes`` are the symbols of each of ``lanes``, one after another. Of the first
        lanes so many have ``ended``: no symbol follows, so their state need not learn.
        """
        if 0 < ended < len(sizes):
            cut = sum(sizes[:ended])
            last = lanes[:ended], sizes[:ended], symbol[:cut], contexts[:, :cut], ended
            more = lanes[ended:], sizes[ended:], symbol[cut:], contexts[:, cut:]
            return np.concatenate([self.step(state, *last), self.step(state, *more)])
        order, layers, bit, slots = self.coder.layered(symbol, contexts)
        inputs = [t.take(s, mode="clip") for t, s in zip(self.table, slots)]
        lane = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        spelled = symbol[order] >= self.coder.size + 2
        owner = _spread(lanes[lane] * np.int32(2) + spelled, layers)
        gates, all_levels = len(state[0]), len(state[-1])
        moves = np.zeros((CONTEXTS + 2, gates))
        refined = np.zeros((2, all_levels))
        logs = np.empty(len(bit), np.float32)
        for start in range(0, len(bit), BLOCK):
            own = slice(start, start + BLOCK)
            xs = [x[own] for x in inputs]
            sure = [np.abs(x) for x in xs[1:]]
            gate = (sure[0] > 0).view(np.int8) + (sure[0] > 2).view(np.int8)
            gate += np.int8(3) * ((sure[1] > 0).view(np.int8) + (sure[1] > 2).view(np.int8))
            at = owner[own] * np.intp(GATES // 2)
            at += gate
            mixed = state[CONTEXTS].take(at, mode="clip")
            for weight, x in zip(state, xs):
                mixed += weight.take(at, mode="clip") * x
            np.clip(mixed, -11.5, 11.5, out=mixed)
            level = (owner[own] >> 1) * np.intp(LEVELS)
            level += (mixed + 12).astype(np.int8)
            mixed += state[CONTEXTS + 1].take(level, mode="clip")
            sign = bit[own].astype(np.float32) * 2 - 1
            right = 1 / (1 + np.exp(-sign * mixed))
            np.log(np.maximum(right, 1e-7), out=logs[own])
            if not ended:
                error = sign * (1 - right)
                for move, x in zip(moves, [*(error * x for x in xs), error, None]):
                    move += np.bincount(at, x, gates)
                for move, x in zip(refined, [error, None]):
                    move += np.bincount(level, x, all_levels)
        each, done = np.zeros(len(symbol)), 0
        for size in layers:
            each[:size] += logs[done : done + size]
            done += size
        if not ended:
            scale = RATE / np.maximum(1, moves[-1] / 512)
            for weight, move in zip(state, moves[:-1]):
                weight += (move * scale).astype(np.float32)
            scale = REFINE / np.maximum(1, refined[1] / 64)
            state[-1] += (refined[0] * scale).astype(np.float32)
        return np.bincount(lane, each, len(sizes))

    def teach(self, counts: np.ndarray) -> None:
        """Starting weights and corrections that fit the bits counted by ``lessons`` best.

        Newton's method for each gate, and then for each level; weights that too few bits
        say anything about stay near where they were.
        """
        middles = np.concatenate([-CLASS_MIDDLES[::-1], [0], CLASS_MIDDLES])
        zeros, ones = counts.reshape(-1, 2).T.astype(np.float64)
        spelled, *inputs = np.unravel_index(np.arange(len(ones)), (2,) + (CLASSES,) * CONTEXTS)
        x = np.stack([*(middles[i] for i in inputs), np.ones(len(ones))])
        sure = [(np.abs(v) > 0).astype(int) + (np.abs(v) > 2) for v in x[1:CONTEXTS]]
        gate = sure[0] + 3 * sure[1] + 9 * spelled
        mixed = np.zeros(len(ones))
        seen = zeros + ones > 0
        for n in range(GATES):
            here = np.flatnonzero((gate == n) & seen)
            fitted = _fitted(x[:, here], zeros[here], ones[here], self.weights[:, n])
            self.weights[:, n] = fitted
            mixed[here] = np.clip(fitted @ x[:, here], -11.5, 11.5)
        level = (mixed + 12).astype(int)
        for n in range(LEVELS):
            here = np.flatnonzero((level == n) & seen)
            one = np.ones((1, len(here)))
            self.levels[n] = _fitted(one, zeros[here], ones[here], np.zeros(1), mixed[here])[0]

    def score(self, texts: list[bytes]) -> list[tuple]:
        """(natural log probability, tokens, ids of dictionary words, other words) of each text."""
        return self.score_encoded([self.coder.encoded(text) for text in texts])

    def score_encoded(self, texts: list[tuple[np.ndarray, list[bytes]]]) -> list[tuple]:
        """``score`` of what ``Coder.encoded`` makes of texts."""
        totals: list[float] = [0.0] * len(texts)
        # Texts of like length side by side, so that few wait for a long one.
        sizes = [len(ids) + sum(map(len, others)) + len(others) for ids, others in texts]
        short = sorted((n for n, size in enumerate(sizes) if size <= _PART // 4), key=sizes.__getitem__)
        for at in range(0, len(short), LANES):
            group = short[at : at + LANES]
            state, found = self.start(len(group)), np.zeros(len(group))
            symbol, contexts, ends = self.coder.laid_together([texts[n] for n in group])
            cuts = [slice(a, b) for a, b in zip([0, *ends[:-1]], ends)]
            self._run(state, [(symbol[cut], contexts[:, cut]) for cut in cuts], found)
            for lane, n in enumerate(group):
                totals[n] = found[lane]
        for n, (ids, others) in enumerate(texts):
            if sizes[n] > _PART // 4:
                state, total, done, rest = self.start(1), np.zeros(1), 0, None
                for symbol, contexts, last in self.coder.parts(ids, others):
                    if rest is not None:
                        symbol = np.concatenate([rest[0], symbol])
                        contexts = np.concatenate([rest[1], contexts], axis=1)
                    at = self._run(state, [(symbol, contexts)], total, done, last)
                    # Symbols short of a stride wait for the next part's.
                    done, rest = done + at, (symbol[at:], contexts[:, at:])
                totals[n] = total[0]
        return [(total, len(ids), [ids], others) for total, (ids, others) in zip(totals, texts)]

    def _run(self, state, coded, totals, done: int = 0, last: bool = True) -> int:
        """Adds to ``totals`` what the symbols of each lane get, ``done`` symbols into their texts.

        Returns how many symbols were taken: all, or whole strides if more are to follow.
        """
        longest, at = max(len(c[0]) for c in coded), 0
        while at < longest:
            end = at + min(LONG_STEP, max(STEP, (done + at) // 2))
            if end > longest and not last:
                return at
            lanes = [n for n, c in enumerate(coded) if len(c[0]) > at]
            # Lanes don't touch each other: so many at once that a table is read often in turn.
            width = max(1, WIDE // (end - at))
            for some in range(0, len(lanes), width):
                own = lanes[some : some + width]
                more = (k for k, n in enumerate(own) if not last or len(coded[n][0]) > end)
                ended = next(more, len(own))
                symbol = [coded[n][0][at:end] for n in own]
                contexts = np.concatenate([coded[n][1][:, at:end] for n in own], axis=1)
                totals[own] += self.step(
                    state, np.array(own, np.int32), list(map(len, symbol)),
                    np.concatenate(symbol), contexts, ended,
                )
            at = end
        return longest


def _fitted(x, zeros, ones, start, offset=0.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on counted rows, held weakly at ``start``."""
    start = start.astype(np.float64)
    weights = start.copy()
    many = zeros + ones

    def loss(at: np.ndarray) -> float:
        sums = at @ x + offset
        surprise = ones * np.logaddexp(0, -sums) + zeros * np.logaddexp(0, sums)
        return float(surprise.sum() + ((at - start) ** 2).sum() / 2)

    now = loss(weights)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(weights @ x + offset, -30, 30)))
        slope = x @ (ones - many * p) - (weights - start)
        curve = (x * (many * p * (1 - p))) @ x.T + np.eye(len(x))
        move = np.linalg.solve(curve, slope)
        # A full step may overshoot where predictions are far off.
        while (after := loss(weights + move)) > now and np.abs(move).max() > 1e-9:
            move = move / 2
        if after >= now:
            break
        weights, now = weights + move, after
    return weights


def score(docs: DataFrame, training: Column) -> DataFrame:
    """Scores of all ``docs`` under a model of those that ``training`` admits.

    Columns: doc_id, training, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte. ``base_score`` is the log10 probability with add-one smoothed counts.
    """
    spark = docs.sparkSession
    wide = docs.select("doc_id", "text", training.alias("training"))
    learned = wide.where("training")
    counts = common.stored(word_counts(learned), "words")
    row = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"),
        F.count("*").alias("different"),
        F.coalesce(F.sum(F.when(F.col("word") == F.lit(bytearray(END)), F.col("c"))), F.lit(0))
        .alias("ends"),
        F.coalesce(F.sum(F.when(F.col("c") == 1, 1)), F.lit(0)).alias("once"),
    ).first()
    words = frequent(counts, DICTIONARY)
    covered = sum(c for _, c in words)
    coder = Coder(words, row["ends"], row["tokens"] - row["ends"] - covered)
    # Copies of a text are in one half.
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 30)) < int(SHARE * (1 << 30))
    rows = wide.select(F.col("doc_id").cast("long"), "text", "training", drawn.alias("drawn"))
    encoded = common.stored(encode(rows, spark.sparkContext.broadcast(coder)), "encoded")
    taught = encoded.where("training")
    coder = coder.without_ids()
    shared_coder = spark.sparkContext.broadcast(coder)
    whole, rest, other = halves(taught, shared_coder)
    mixer = Mixer(whole, coder)
    mixer.teach(lessons(taught, shared_coder, (other, rest)))
    shared = spark.sparkContext.broadcast(mixer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer: Mixer = shared.value
        mixer.settle()
        part, n = TaskContext.get().partitionId(), 0
        counts = mixer.coder.counts
        logs = np.log10(counts + 1.0)
        known: dict[tuple, tuple] = {}
        size = 0
        for batch in chain.from_iterable(slabs(b, 3, GROUP) for b in batches):
            doc_ids, training, lengths, *coded = batch.columns
            texts = list(zip(*(c.to_pylist() for c in coded)))
            columns: list[list] = [[] for _ in range(8)]
            # A text's score depends on nothing else, so copies are scored once.
            new = [t for t in dict.fromkeys(texts) if t not in known]
            scores = mixer.score_encoded(_read(*zip(*new))) if new else []
            for text, (total, tokens, [ids], others) in zip(new, scores):
                found = ids[ids >= 0]
                rare = Counter(others)
                known[text] = (
                    tokens, int((counts[found] > 0).sum()), float(logs[found].sum()),
                    float(total) / np.log(10), list(rare), list(rare.values()),
                )
                size += len(text[0]) + len(text[1])
            for text, length in zip(texts, lengths.to_pylist()):
                tokens, seen, add, total, rare, times = known[text]
                value = (part << 33) + n, tokens, seen, add, total, length, rare, times
                for column, cell in zip(columns, value):
                    column.append(cell)
                n += 1
            if size > REMEMBERED_BYTES:
                known.clear()
                size = 0
            kinds = [pa.int64()] * 3 + [pa.float64()] * 2 + [
                pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())
            ]
            yield pa.RecordBatch.from_arrays(
                [doc_ids, training]
                + [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "training", "row", "n_tokens", "known", "logs", "score", "bytes",
                 "rare", "times"],
            )

    scored = common.stored(
        encoded.select("doc_id", "training", "bytes", "ids", "others").mapInArrow(
            run,
            "doc_id long, training boolean, row long, n_tokens long, known long, logs double, "
            "score double, bytes long, rare array<binary>, times array<long>",
        ),
        "scored",
    )
    rare = scored.where(F.size("rare") > 0).select(
        "row", F.explode(F.arrays_zip("rare", "times")).alias("r")
    ).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    seen = rare.join(counts, "word").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("add")
    )
    norm = float(np.log10(row["tokens"] + row["different"] + 1))
    return scored.join(seen, "row", "left").select(
        "doc_id", "training", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(row["tokens"]).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("add", F.lit(0.0)) - F.col("n_tokens") * norm)
        .alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.greatest("bytes", F.lit(1))).alias(
            "bits_per_byte"
        ),
    )
