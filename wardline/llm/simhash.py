"""Near-duplicate detection by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints that differ in two bits share a variant with one bit flipped; so
every distinct fingerprint emits all variants within half the radius, and variants
meet in a shuffle. An odd radius leaves one bit over: the variant is shuffled with
one of four 16-bit blocks masked, each block in turn. Whatever block one differing
bit of a linked pair lies in, the other two meet under that mask. (The alternative,
all variants within two bits, is 2,081 rows a fingerprint instead of 196.)

The fingerprints that meet under one key lie within one bit of the variant outside
the masked block, at most 49 values there and 65,536 inside, so a key's rows are
bounded by construction and streamed. They are verified without making all pairs:
fingerprints with equal masked blocks are always linked; two masked blocks one bit
apart always are; two or three bits apart depends only on which of the 49 values
occur beside each. Every block thus has at most 696 neighbours to look up.

Copies share a fingerprint, so they never meet each other: distinct fingerprints
are linked, and rows join their fingerprint's component.

Nulls and odd input: a null or empty text, or one without words, has fingerprint
zero and is linked like any other; a null id is kept but never names a component;
repeated rows each come back; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import common, components

WORDS = 3
SEED = 42
BLOCK_BITS = 16
#: Shingles that are hashed and counted at once.
CHUNK = 16_384
#: Up to so many fingerprints of a key are compared in one matrix.
MATRIX = 64


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint long): the 64 bits set in over half the shingles' XXH64."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = common.raw_texts(batch.column(1))
            marks = pa.array([fingerprint(t, words, seed) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), marks], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, fingerprint long"
    )


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Fingerprint of one UTF-8 text, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()
    if not tokens:
        return 0
    total = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, total, CHUNK):
        part = tokens[start : start + CHUNK + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words))))
        if len(tokens) < words:
            shingles = [b" ".join(tokens)]
        hashes = np.array([xxh64_intdigest(s, seed) for s in shingles], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def link(marks: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, enough to connect all within three bits.

    ``marks`` has distinct values of ``fingerprint``. Every pair returned differs in
    at most three bits; pairs whose fingerprints are connected by others may be left out.
    """
    value = F.col("fingerprint")
    blocks = 64 // BLOCK_BITS

    def variants(masked, flips):
        return F.transform(F.array(*map(F.lit, flips)), lambda f: masked.bitwiseXOR(f))

    keys = []
    for block in range(blocks):
        kept = ~(((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * block))
        masked = value.bitwiseAND(F.lit(_signed(kept)))
        flips = [0] + [1 << b for b in range(64) if b // BLOCK_BITS != block]
        keys.append(variants(masked, [_signed(f) for f in flips]))
    # A fingerprint is a small row that becomes many: as many tasks emit as will read. By a
    # hash of it, as rows that are already dealt by the column itself would not be dealt again.
    tasks = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    emitted = marks.repartition(tasks, F.xxhash64("fingerprint", F.lit(1))).select(
        value, F.posexplode(F.array(*keys)).alias("block", "variants")
    ).select("fingerprint", "block", F.explode("variants").alias("variant"))
    met = emitted.repartition("block", "variant").sortWithinPartitions("block", "variant")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [batch.column(n).to_numpy(zero_copy_only=False) for n in range(3)]
            if held is not None:
                rows = [np.concatenate(pair) for pair in zip(held, rows)]
            mark, block, variant = rows
            if not len(mark):
                continue
            new = np.flatnonzero((block[1:] != block[:-1]) | (variant[1:] != variant[:-1])) + 1
            last = new[-1] if len(new) else 0
            held = [r[last:] for r in rows]
            yield _linked(mark, block, np.concatenate([[0], new]).astype(np.int64))
        if held is not None:
            mark, block, _ = held
            yield _linked(mark, block, np.array([0, len(mark)]))

    return met.mapInArrow(verify, "a long, b long").distinct()


def _signed(bits: int) -> int:
    bits &= (1 << 64) - 1
    return bits - (1 << 64) if bits >> 63 else bits


def _linked(mark: np.ndarray, block: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """Links inside the groups that ``bounds`` delimit."""
    firsts, seconds = [], []
    sizes = np.diff(bounds)
    # Most groups are of two: all of them at once.
    two = bounds[:-1][sizes == 2]
    bits = mark.view(np.uint64)
    apart = np.bitwise_count(bits[two] ^ bits[two + 1]) <= 3
    firsts.append(mark[two][apart])
    seconds.append(mark[two + 1][apart])
    for at in np.flatnonzero(sizes > 2):
        group = mark[bounds[at] : bounds[at + 1]]
        a, b = matched(group) if len(group) <= MATRIX else met(group, int(block[bounds[at]]))
        firsts.append(a)
        seconds.append(b)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x), pa.int64()) for x in (firsts, seconds)], ["a", "b"]
    )


def matched(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links in a small group by one matrix, as a spanning forest."""
    bits = group.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3
    return _forest(group, *np.nonzero(np.triu(near, 1)))


def _forest(values: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Of the links left-right, those that connect something not yet connected."""
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    kept = np.array(kept, np.int64).reshape(-1, 2)
    return values[kept[:, 0]], values[kept[:, 1]]


def met(group: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among any number of fingerprints that met under one key.

    They share all bits outside ``block`` but for one flip at most, so what matters of
    a fingerprint is its masked block and which flip, if any, it has beside it.
    """
    shift = np.uint64(BLOCK_BITS * block)
    bits = group.view(np.uint64)
    inside = ((bits >> shift) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
    outside = bits & ~np.uint64(((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * block))
    values, which = np.unique(outside, return_inverse=True)
    # The variant itself is within one bit of every value: the bitwise majority of three
    # or more; between two that are two bits apart, either value in between.
    if len(values) > 2:
        spread = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        centre = np.packbits(spread.sum(0) * 2 > len(values), bitorder="little").view("<u8")[0]
    else:
        differing = int(values[0] ^ values[-1])
        lowest = differing & -differing
        centre = values[0] ^ np.uint64(lowest if lowest != differing else 0)
    flip = values ^ centre
    flags = np.where(flip == 0, np.uint64(1) << shift, flip)[which]  # a masked bit marks "none"
    none = np.uint64(1) << shift
    order = np.argsort(inside, kind="stable")
    places, first = np.unique(inside[order], return_index=True)
    seen = np.bitwise_or.reduceat(flags[order], first)
    pure = (seen & none) != 0
    at = np.full(1 << BLOCK_BITS, -1, np.int64)
    at[places] = np.arange(len(places))
    # Same masked block: at most two flips apart, always linked; a chain will do.
    same = np.flatnonzero(np.diff(inside[order]) == 0)
    firsts, seconds = [group[order[same]]], [group[order[same + 1]]]
    left, right = [], []
    ones = [1 << n for n in range(BLOCK_BITS)]
    masks = (
        [(m, 1) for m in ones]
        + [(m | n, 2) for i, m in enumerate(ones) for n in ones[:i]]
        + [
            (m | n | o, 3)
            for i, m in enumerate(ones) for j, n in enumerate(ones[:i]) for o in ones[:j]
        ]
    )
    by_place = np.split(order, first[1:])
    for mask, apart in masks:
        other = at[places ^ mask]
        here = np.flatnonzero((other >= 0) & (np.arange(len(places)) < other))
        other = other[here]
        if apart > 1:
            shared = (seen[here] & seen[other]) != 0
            fits = shared | (pure[here] | pure[other]) if apart == 2 else shared
            here, other = here[fits], other[fits]
        left.append(here)
        right.append(other)
    left, right = np.concatenate(left), np.concatenate(right)
    index = np.arange(len(places))
    a, b = _forest(index, left, right)
    for x, y in zip(a.tolist(), b.tolist()):
        # A pair of fingerprints that bears the link out.
        mine, theirs = by_place[x], by_place[y]
        i, j = np.nonzero(np.bitwise_count(bits[mine][:, None] ^ bits[theirs][None, :]) <= 3)
        firsts.append(group[mine[i[:1]]])
        seconds.append(group[theirs[j[:1]]])
    return np.concatenate(firsts), np.concatenate(seconds)


def roots_of(marks: DataFrame) -> DataFrame:
    """(fingerprint, root) of the fingerprints in ``marks`` that link to any other."""
    edges = link(marks.select("fingerprint").distinct())
    return components.smallest_reachable(edges).withColumnRenamed("node", "fingerprint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint long, component_id): the smallest doc_id that links lead to."""
    marks = common.cut_lineage(fingerprints(docs))
    distinct = marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    distinct = common.cut_lineage(distinct)
    named = distinct.join(roots_of(distinct), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.join(
        named.select("fingerprint", "root").join(lowest, "root").drop("root"), "fingerprint"
    ).select("doc_id", "fingerprint", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, of each component: the smallest doc_id's.

    Of rows with the same smallest doc_id (or none) the first by their other columns.
    """
    at = docs.columns.index("text")
    rows = common.numbered(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            marks = [fingerprint(t) for t in common.raw_texts(batch.column(at))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(marks, pa.int64())], [*batch.schema.names, "mark"]
            )

    marked = common.stored(rows.mapInArrow(run, common.extended(rows, mark="long")), "marked")
    roots = roots_of(marked.select(F.col("mark").alias("fingerprint"))).select(
        F.col("fingerprint").alias("mark"), "root"
    )
    return first_rows(marked, roots, docs)


def first_rows(marked: DataFrame, roots: DataFrame, docs: DataFrame) -> DataFrame:
    """Of ``marked`` (numbered ``docs`` and mark) the first row of each group in (mark, root)."""
    key = f"c{docs.columns.index('doc_id')}"
    # Which rows stay is settled on ids alone; whole rows are only joined to the answer.
    # Copies are summed up before anything is joined.
    keys = marked.groupBy("mark").agg(F.min(key).alias("id")).join(roots, "mark", "left")
    least = keys.groupBy(F.coalesce("root", "mark").alias("group")).agg(
        F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("least")
    )
    wanted = least.select(F.struct("least.mark", "least.id").alias("place"))
    # As a struct, in which nulls are equal: a null-safe comparison would be dealt by
    # expressions of its own, and whole rows would be dealt once more to be grouped.
    placed = marked.withColumn("place", F.struct("mark", F.col(key).alias("id")))
    kept = placed.join(wanted, "place")
    # A group has one place, so only repeated rows can still share it: they are together.
    row = F.struct(*[f"c{n}" for n in range(len(docs.columns))])
    first = kept.groupBy("place").agg(F.min(row).alias("row")).select("row.*")
    return common.renamed(first, docs)


def hexadecimal(column: str = "fingerprint"):
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
