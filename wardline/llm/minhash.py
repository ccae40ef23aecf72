"""Near-duplicate detection by one-permutation MinHash with optimal densification.

A text's set is that of its four-word shingles, as 64-bit hashes. One hash function deals
them into ``BANDS * ROWS`` bins and keeps each bin's least; an empty bin borrows from the
bins that a hash of its own number and the attempt points to, until one is not empty, so
that every bin agrees between two sets with a probability equal to their similarity.
Bins are banded into buckets; equal sets are summed up before that.

Candidates under a bucket are a star: each member against one centre, so that pairs are
in proportion to members. A second round takes other centres for buckets that still hold
several components. What a star can't see, two leaves that are similar while one of them
isn't to the centre, is then found exactly for all members of buckets that still hold
several components: of two similar sets the rarest shingles share one (prefix filter,
with the shorter prefix for the smaller set). Sketches that are too far apart to belong
to similar sets are dropped, and every link is confirmed on the full sets.

Nulls and odd input: a null or empty text, or one without words, has an empty set and is
linked with nothing; a text of fewer words than a shingle is one shingle; a null id links
others but never names a component; repeated rows each come back; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import lookup_join
from wardline.llm import common, components

WORDS = 4
#: Two sets link if 100 times what they share is at least 80 times what either has.
PERCENT = 80
#: Sets at the limit miss each other in all bands with a probability of 0.67 ** 28 = 1.5e-5.
BANDS, ROWS = 28, 5
BINS = BANDS * ROWS
STARS = 2
#: Links that a task of a round of components takes.
PAIRS_A_TASK = 5_000
SEED = 11
#: Standard deviations by which a sketch may fall short of the limit (for a normal: 3e-7).
DEVIATIONS = 5.0

_MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each value (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of hashed shingles; the hash of a word is remembered."""

    HELD = 500_000

    def __init__(self, words: int = WORDS):
        self.words = words
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        """The distinct hashes, sorted."""
        from xxhash import xxh64_intdigest

        tokens = text.lower().split()
        if len(self.known) > self.HELD:
            self.known.clear()
        known = self.known
        for token in set(tokens).difference(known):
            known[token] = xxh64_intdigest(token, SEED)
        hashes = np.fromiter((known[t] for t in tokens), np.uint64, len(tokens))
        if not len(hashes):
            return hashes
        total = max(1, len(hashes) - self.words + 1)
        # Shorter sequences are one shingle; the length keeps them apart from parts of others.
        found = np.full(total, np.uint64(min(len(hashes), self.words)))
        for k in range(min(len(hashes), self.words)):
            found = mixed(found * _STEP + hashes[k : k + total])
        return np.unique(found)


def sketch(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Least value of each bin, empty bins densified; ``hashes`` not empty."""
    hashes = mixed(hashes + _STEP)
    place = (hashes % np.uint64(bins)).astype(np.int64)
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, place, hashes)
    filled = np.zeros(bins, bool)
    filled[place] = True
    empty = np.flatnonzero(~filled)
    attempt = 0
    while len(empty):
        attempt += 1
        # The same for all sets: only the bin and the attempt decide where it looks.
        probe = mixed(empty.astype(np.uint64) * _STEP + np.uint64(attempt))
        source = (probe % np.uint64(bins)).astype(np.int64)
        lends = filled[source]
        least[empty[lends]] = least[source[lends]]
        empty = empty[~lends]
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One bucket key for each band of a sketch."""
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * _STEP + rows[:, k])
    return key


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): a number of a row's id and text, the same whenever it is read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.withColumn("row", F.xxhash64("doc_id", "text"))


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, mark, keys, sketch): mark is a digest of the set.

    ``sketch`` holds one byte of each bin. Sets without shingles have no mark. The sets
    themselves, larger than the texts, are not kept: see ``shingled``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in common.slices(batches):
            sizes, marks, keys, bytes_ = [], [], [], []
            for text in common.raw_texts(batch.column(1)):
                found = shingles.of(text)
                sizes.append(len(found))
                if not len(found):
                    for column in (marks, keys, bytes_):
                        column.append(None)
                    continue
                least = sketch(found)
                marks.append(mark_of(found))
                keys.append(bands(least).view(np.int64))
                # The least of many are small numbers, so they are mixed before they are cut short.
                bytes_.append((mixed(least) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(sizes, pa.int64()),
                    pa.array(marks, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                    pa.array(bytes_, pa.binary()),
                ],
                ["doc_id", "row", "n_shingles", "mark", "keys", "sketch"],
            )

    return _named(docs).mapInArrow(
        run,
        "doc_id long, row long, n_shingles long, mark long, keys array<long>, sketch binary",
    )


def mark_of(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def shingled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(mark, n, hashes) of the rows of ``docs`` that ``wanted`` (row, mark) names, each mark once.

    Texts are read again, but only those that share a bucket are hashed again.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in common.slices(batches, 64):
            sets = [shingles.of(text) for text in common.raw_texts(batch.column(1))]
            hashes = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            sizes = pa.array(map(len, sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, hashes], ["mark", "n", "hashes"])

    rows = lookup_join(_named(docs).select("row", "text"), wanted, ["row"]).select("mark", "text")
    # Only rows of the same id and text still share a mark.
    return rows.mapInArrow(run, "mark long, n long, hashes array<long>").dropDuplicates(["mark"])


def _sizes_allow() -> Column:
    """Sizes n_a and n_b that similar sets can have."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return 100 * small >= PERCENT * large


def plausible(pairs: DataFrame) -> DataFrame:
    """Of pairs with n_a, n_b, sketch_a and sketch_b those whose sketches may be of similar sets.

    A densified sketch of a small set repeats values, so its deviation is that of as many
    draws as it has shingles, doubled for the borrowing.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = PERCENT / 100
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(-1, BINS)
                for n in (4, 5)
            )
            small, large = (batch.column(n).to_numpy().astype(float) for n in (2, 3))
            draws = np.minimum(np.minimum(small, large), BINS)
            least = limit - DEVIATIONS * np.sqrt(2 * limit * (1 - limit) / draws)
            keep = (a == b).sum(axis=1) >= least * BINS
            yield batch.filter(pa.array(keep)).select([0, 1])

    shape = pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return shape.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, marks: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose sets are similar.

    ``marks`` has mark, n and sketch; ``sets`` mark, n and hashes. Sketches come first, as
    they are small rows: whole sets only meet for what those leave.
    """

    def side(of: DataFrame, name: str, column: str) -> DataFrame:
        return of.select(
            F.col("mark").alias(name), F.col("n").alias(f"n_{name}"), F.col(column).alias(f"{column}_{name}")
        )

    likely = pairs.join(side(marks, "a", "sketch"), "a").join(side(marks, "b", "sketch"), "b")
    likely = common.cut_lineage(plausible(likely.where(_sizes_allow())))
    both = likely.join(side(sets, "b", "hashes"), "b").join(side(sets, "a", "hashes"), "a")
    shared = F.size(F.array_intersect("hashes_a", "hashes_b"))
    either = F.col("n_a") + F.col("n_b") - shared
    return both.where(100 * shared >= PERCENT * either).select("a", "b")


def stars(members: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b) of every bucket's members (key, mark, root, met) and its centre.

    The first centre is the member that meets the most others in all its buckets: of
    copies that were each changed in another place it is the one they were made from.
    Later rounds take other orders. An order is the same for all buckets, so that the
    buckets of one group agree on their centre. Only members whose root isn't the
    centre's are paired.
    """
    by = F.xxhash64("mark", F.lit(number)) if number else -F.col("met")
    centres = members.groupBy("key").agg(
        F.min(F.struct(by.alias("by"), "mark", "root")).alias("centre"),
        F.min("root").alias("low"), F.max("root").alias("high"),
    ).where("low <> high").select(
        "key", F.col("centre.mark").alias("lead"), F.col("centre.root").alias("of")
    )
    met = members.join(centres, "key").where("root <> of")
    return met.select(F.least("mark", "lead").alias("a"), F.greatest("mark", "lead").alias("b")).distinct()


def prefixes(sets: DataFrame) -> DataFrame:
    """(mark, n, alone, rarest array<long>, few): the shingles by which similar sets meet.

    ``rarest`` are the first ``n - ceil(0.8 n) + 1`` in the order of how many of ``sets``
    hold them, without the ``alone`` first that only one holds. ``few`` of them are enough
    for the smaller set of a pair, as what is shared is at least 8 ninths of it.
    """
    each = sets.select("mark", "n", F.explode("hashes").alias("hash"))
    held = each.groupBy("hash").agg(F.count("*").alias("held")).where("held > 1")
    ranked = each.join(held, "hash").groupBy("mark", "n").agg(
        F.sort_array(F.collect_list(F.struct("held", "hash"))).alias("ranked")
    )
    alone = F.col("n") - F.size("ranked")

    def first(shared: Column) -> Column:
        return F.greatest(F.col("n") - shared + 1 - alone, F.lit(0)).cast("int")

    large = first(F.ceil(F.col("n") * PERCENT / 100))
    small = first(F.ceil(F.col("n") * (2 * PERCENT) / (100 + PERCENT)))
    return ranked.select(
        "mark", "n", alone.alias("alone"), F.slice("ranked.hash", 1, large).alias("rarest"),
        small.alias("few"),
    )


def remaining(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in different components that may be similar: none is left out."""
    rooted = prefixes(sets).join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    rooted = common.stored(rooted, "prefixes")
    def side(name: str, hashes: Column) -> DataFrame:
        # How many of the set are at this place of its order or after it.
        left = F.col("n") - F.col("alone") - F.col("place")
        return rooted.select(
            "*", F.posexplode(hashes).alias("place", "hash")
        ).select(
            F.col("mark").alias(name), F.col("n").alias(f"n_{name}"), F.col("root").alias(f"root_{name}"),
            left.alias(f"left_{name}"), "hash",
        )

    small, large = side("a", F.slice("rarest", 1, F.col("few"))), side("b", F.col("rarest"))
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    # From the first shingle that both have on, as many must be left as they have to share.
    needed = PERCENT * (F.col("n_a") + F.col("n_b"))
    enough = (100 + PERCENT) * F.least("left_a", "left_b") >= needed
    met = small.join(
        large,
        (small["hash"] == large["hash"]) & ordered & (F.col("root_a") != F.col("root_b"))
        & _sizes_allow() & enough,
    )
    return met.select("a", "b").distinct()


def _over(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(mark, root) of all that ``roots`` and ``links`` connect; only roots are connected anew."""
    for name in ("a", "b"):
        named = roots.select(F.col("mark").alias(name), F.col("root").alias("r"))
        links = links.join(named, name, "left").withColumn(name, F.coalesce("r", name)).drop("r")
    moved = components.smallest_reachable(links, PAIRS_A_TASK).select(
        F.col("node").alias("root"), F.col("root").alias("to")
    )
    kept = roots.join(moved, "root", "left").select("mark", F.coalesce("to", "root").alias("root"))
    fresh = moved.select(F.col("root").alias("mark"), F.col("to").alias("root"))
    return common.cut_lineage(kept.unionByName(fresh.join(roots, "mark", "left_anti")))


def roots_of(marked: DataFrame, docs: DataFrame) -> DataFrame:
    """(mark, root) of the sets that any other links to.

    ``marked`` has mark, row, n, keys and sketch, each mark once, its row in ``docs``.
    """
    spark = docs.sparkSession
    each = marked.select("mark", F.explode("keys").alias("key"))
    several = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    each = each.join(several, "key")
    degree = each.groupBy("mark").agg(F.sum("n").alias("met"))
    shared = common.stored(each.drop("n").join(degree, "mark"), "buckets")
    met = shared.select("mark").distinct()
    marks = common.stored(marked.select("mark", "row", "n", "sketch").join(met, "mark"), "met")
    sets = common.stored(shingled(docs, marks.select("row", "mark")), "sets")
    roots = spark.createDataFrame([], "mark long, root long")
    for number in range(STARS + 1):
        members = shared.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
        if number < STARS:
            pairs = stars(members, number)
        else:
            spread = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
            spread = spread.where("low <> high").select("key")
            rest = shared.join(spread, "key").select("mark").distinct()
            pairs = common.cut_lineage(remaining(sets.join(rest, "mark", "left_semi"), roots))
        links = common.cut_lineage(confirmed(pairs, marks, sets))
        if not links.isEmpty():
            roots = _over(links, roots)
    return roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links lead to."""
    rows = common.stored(sketched(docs), "sketched")
    marks = rows.where("mark is not null").groupBy("mark").agg(
        F.min("doc_id").alias("least"), F.min("row").alias("row")
    )
    marks = common.cut_lineage(marks)
    # A row number may be there twice, where a row is repeated.
    whole = rows.select("mark", "row", F.col("n_shingles").alias("n"), "keys", "sketch")
    marked = whole.join(marks.select("mark", "row"), ["mark", "row"], "left_semi").dropDuplicates(["mark"])
    roots = roots_of(common.stored(marked, "marked"), docs)
    named = marks.join(roots, "mark", "left").select("mark", "least", F.coalesce("root", "mark").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rows.select("doc_id", "n_shingles", "mark").join(
        named.join(lowest, "root").select("mark", "component_id"), "mark", "left"
    )
    alone = F.when(F.col("mark").isNull(), F.col("doc_id"))
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", alone).alias("component_id"))
