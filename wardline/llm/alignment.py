"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and links.

Both tokenizers cut the same bytes. Each side's cumulative ends are put into a dictionary
from end to token number; the ends in both dictionaries, sorted, slice the two lists of
ids into groups. Inside a slice every two tokens whose byte ranges overlap are linked.

Neither tokenizer's tokens reach over a blank that follows a character which is no white
space, so a text is cut there and each stretch (a word and what is attached to it) is
aligned once per worker and remembered; the stretches' common ends are the text's.
``Aligner`` checks the vocabulary for this and aligns whole texts if it doesn't hold.

A pair's corpus-wide count is an aggregate over each document's distinct pairs. It meets
the pairs again as a broadcast table when its counted rows fit, else in a shuffle.

Nulls and odd input: null and empty texts, and texts whose tokens don't spell them, have
no tokens: zeros and an empty digest. Repeated rows each count as a document; a null id
is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import common

#: Longer stretches are aligned each time; a worker remembers up to twice so many others.
LONGEST_REMEMBERED = 48
REMEMBERED = 250_000
#: Characters of stretches that are tokenized in one call.
AT_ONCE = 1 << 18
#: Rows of the table of counted pairs that are broadcast, at about 24 bytes each.
BROADCAST_ROWS = 2_000_000


def align(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups (from a, to a, from b, to b) of token numbers between common ends."""
    at_a = dict(zip(ends_a, range(1, len(ends_a) + 1)))
    at_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    groups, a, b = [], 0, 0
    for end in sorted(at_a.keys() & at_b.keys()):
        groups.append((a, at_a[end], b, at_b[end]))
        a, b = at_a[end], at_b[end]
    return groups


def links(group: tuple[int, int, int, int], ends_a: list[int], ends_b: list[int]):
    """Pairs (a, b) of token numbers of a group whose byte ranges overlap."""
    a, last_a, b, last_b = group
    found = []
    while a < last_a and b < last_b:
        found.append((a, b))
        # Whichever ends first makes room; both at once only at the group's end.
        if ends_a[a] <= ends_b[b]:
            a += 1
        else:
            b += 1
    return found


#: What a stretch of text adds to its document: numbers of A and B tokens and of groups, the
#: groups as text, and its links as packed integers. Of plain values only, as a worker holds
#: many, and the garbage collector then has nothing to follow.
Stretch = tuple[int, int, int, str, bytes]


def stretch(ids_a: list[int], lengths_a, ids_b: list[int], lengths_b) -> Stretch:
    ends_a, ends_b = list(accumulate(lengths_a)), list(accumulate(lengths_b))
    groups = align(ends_a, ends_b)
    written, pairs = [], array("q")
    for group in groups:
        a, to_a, b, to_b = group
        if to_a - a == 1 == to_b - b:
            written.append(f"{ids_a[a]}|{ids_b[b]}")
            pairs.append(ids_a[a] << 32 | ids_b[b])
            continue
        written.append(f"{','.join(map(str, ids_a[a:to_a]))}|{','.join(map(str, ids_b[b:to_b]))}")
        for x, y in links(group, ends_a, ends_b):
            pairs.append(ids_a[x] << 32 | ids_b[y])
    return len(ids_a), len(ids_b), len(groups), ";".join(written), pairs.tobytes()


class Aligner:
    """Both tokenizers, and the stretches they have met."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        # Spark's tasks already use every core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        decoded = {c: bytes([n]) for n, c in enumerate(byte_letters())}
        tokens = [self.a.id_to_token(n) or "" for n in range(self.a.get_vocab_size())]
        self.bytes_a = [b"".join(decoded.get(c, c.encode()) for c in t) for t in tokens]
        self.bytes_b = [piece_bytes(self.b.id_to_piece(n)) for n in range(self.b.get_piece_size())]
        # Stretches may be cut before a blank only if no token reaches over such a place.
        over = re.compile(rb"[^ ] ")
        self.cuts = not any(over.search(t) for t in self.bytes_b)
        self.held: dict[str, Stretch | None] = {}
        self.older: dict[str, Stretch | None] = {}

    def encoded(self, texts: list[str]) -> list[Stretch | None]:
        """Alignments of texts, given without the blank in front; None where tokens don't spell them."""
        every_a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        # B puts the blank in front by itself, but leaves an empty text empty.
        every_b = self.b.encode(texts, num_threads=1)
        found = []
        for text, ids_a, ids_b in zip(texts, (e.ids for e in every_a), every_b):
            ids_b = ids_b or [self.b.piece_to_id("▁")]
            parts_a = [self.bytes_a[n] for n in ids_a]
            parts_b = [self.bytes_b[n] for n in ids_b]
            if b"".join(parts_a) == b"".join(parts_b) == b" " + text.encode():
                found.append(stretch(ids_a, map(len, parts_a), ids_b, map(len, parts_b)))
            else:
                found.append(None)
        return found

    def documents(self, texts: list[str]) -> Iterator[list[Stretch] | None]:
        """The stretches of each text; None for one without tokens."""
        cut = [(parted(t) if self.cuts else [t]) if t else [] for t in texts]
        held, unknown, size, long = self.held, [], 0, []
        for part in [*set(chain.from_iterable(cut)).difference(held), None]:
            if unknown and (part is None or size + len(part) > AT_ONCE):
                held.update(zip(unknown, self.encoded(unknown)))
                unknown, size = [], 0
            if part is None:
                break
            if part in self.older:
                held[part] = self.older[part]
                continue
            if len(part) > LONGEST_REMEMBERED:
                long.append(part)
            unknown.append(part)
            size += len(part)
        for parts in cut:
            found = list(map(held.__getitem__, parts))
            yield None if not found or None in found else found
        for part in long:
            del held[part]
        if len(held) > REMEMBERED:
            self.held, self.older = {}, held


@functools.cache
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One for each worker: what a task has met serves the next one as well."""
    return Aligner(path_a, path_b)


#: A blank that doesn't follow a visible character.
_INNER = re.compile(r"(?:^|\s) ")


def parted(text: str) -> list[str]:
    """A text cut at every blank that follows a visible character, without those blanks."""
    pieces = text.split(" ")
    if not _INNER.search(text):
        return pieces
    parts, open_ = [], None
    for piece in pieces:
        part = piece if open_ is None else f"{open_} {piece}"
        # A piece that is empty or ends in white space is one with what follows.
        open_ = part if not piece or piece[-1].isspace() else None
        if open_ is None:
            parts.append(part)
    return parts if open_ is None else [*parts, open_]


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each of the 256 bytes."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(n if n in plain else next(others)) for n in range(256)]


def piece_bytes(piece: str) -> bytes:
    byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
    return bytes.fromhex(byte[1]) if byte else piece.replace("▁", " ").encode()


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every document.

    ``pairs`` are its distinct linked ids (a * 2**32 + b), each linked so many ``times``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        for batch in common.slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [document(parts) for parts in aligner.documents(texts)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), KINDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *NAMES])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(
        run,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<long>, times array<long>",
    )


NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
KINDS = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def document(parts: list[Stretch] | None) -> tuple:
    """The columns ``NAMES`` of a document."""
    if parts is None:
        return 0, 0, 0, 0, "", [], []
    n_a, n_b, n_groups, written, packed = zip(*parts)
    digest = hashlib.sha256(";".join(written).encode())
    every = np.frombuffer(b"".join(packed), np.int64)
    pairs, times = np.unique(every, return_counts=True)
    return sum(n_a), sum(n_b), sum(n_groups), len(every), digest.hexdigest(), pairs, times


def counted(documents: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents a pair is, and whether its A id has none above."""
    pairs = documents.select(F.explode("pairs").alias("pair"))
    counts = common.cut_lineage(pairs.groupBy("pair").agg(F.count("*").alias("n")))
    first = F.shiftright("pair", 32)
    top = counts.groupBy(first.alias("a")).agg(F.max("n").alias("top"))
    return counts.join(top, first == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def score(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    documents = common.stored(
        aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned"
    )
    counts = common.cut_lineage(counted(documents))
    if counts.count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    each = documents.select("row", F.arrays_zip("pairs", "times").alias("found")).select(
        "row", F.inline("found").alias("pair", "times")
    )
    sums = each.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    return documents.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256",
    )
