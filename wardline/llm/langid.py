"""Language identification with blended-spectrum string kernels.

The kernel of two texts is the number of different character n-grams (all lengths up
to ``ORDERS``) that both contain, over the root of the product of how many each has.
A bounded sample of labelled texts is drawn, some of it as Nyström landmarks: a
text's features are its kernel values with the landmarks times the inverse root of
the landmarks' own kernel matrix, and one-versus-rest kernel ridge regression is
fitted on them. The three matrices multiply into one weight for each n-gram and
language, so a batch of texts is scored by one product of its presence matrix.

n-grams are numbered by a hash of ``BITS`` bits. The sample is ``sample`` texts for
each label, those with the smallest hash of their text (copies count once) among
texts of at most ``longest`` characters; it does not depend on partitions or order.

Nulls and odd input: a null text, or one without a letter, is ``und`` with score 0;
without any labelled text all are; a null id or label is no obstacle (a null label
is not learned from); repeated rows get equal results; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm import common

ORDERS = 4
BITS = 18
SAMPLE = 192
LANDMARKS = 48
LONGEST = 20_000
RIDGE = 1e-3
#: Parts of a language that are drawn from before the language is.
PARTS = 64
UNKNOWN = "und"
#: Texts whose presence matrix is held at once; a row has up to a megabyte.
ROWS = 8
#: Characters that are hashed at once.
CHUNK = 1 << 18

_maybe_letter = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    languages: list[str]
    features: np.ndarray
    weights: np.ndarray
    offset: np.ndarray


def has_letter(text: str) -> bool:
    """Whether a text has a character of a letter category; numerals like a half have none."""
    return any(found[0].isalpha() for found in _maybe_letter.finditer(text))


class Presence:
    """Which n-grams a text has, in a table that is used again for the next text."""

    def __init__(self):
        self.table = np.zeros(1 << BITS, bool)

    def of(self, text: str) -> np.ndarray:
        """Numbers of the n-grams of a text, each once."""
        self.table[:] = False
        text = text.lower()
        for start in range(0, len(text), CHUNK):
            part = text[start : start + CHUNK + ORDERS - 1]
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
            rolled = np.zeros(len(points), np.uint32)
            for order in range(1, min(ORDERS, len(points)) + 1):
                rolled = rolled[: len(points) - order + 1] * np.uint32(0x01000193)
                rolled = rolled ^ points[order - 1 :]
                mixed = (rolled + np.uint32(order)) * np.uint32(0x9E3779B1)
                mixed ^= mixed >> np.uint32(15)
                self.table[(mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)] = True
        return np.flatnonzero(self.table)


def draw(docs: DataFrame, labelled: Column, sample: int = SAMPLE, longest: int = LONGEST):
    """(lang, text) pairs to learn from, at most ``sample`` for each language."""
    rows = docs.where(labelled).where("lang is not null and text is not null").where(
        F.char_length("text") <= longest
    )
    keyed = rows.select("lang", F.xxhash64("text").alias("key"), "text")
    # Copies are one candidate; only as many keys as are drawn leave a task.
    # The smallest of each of many parts come first, so that no task sees a whole language.
    keys = keyed.select("lang", "key", F.pmod("key", F.lit(PARTS)).alias("part")).distinct()
    for by in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*by).orderBy("key")
        keys = keys.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    picked = keys.select("lang", "key").collect()
    if not picked:
        return []
    wanted = docs.sparkSession.createDataFrame(picked, "lang string, key long")
    chosen = keyed.join(F.broadcast(wanted), ["lang", "key"])
    texts = chosen.groupBy("lang", "key").agg(F.min("text").alias("text")).collect()
    texts = sorted((r["lang"], r["key"], r["text"]) for r in texts)
    return [(lang, text) for lang, _, text in texts if has_letter(text)]


def fit(sample: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Ridge regression in the landmarks' feature space, folded into n-gram weights."""
    languages = sorted({lang for lang, _ in sample})
    taken: dict[str, int] = {}
    chosen = []
    for at, (lang, _) in enumerate(sample):
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= landmarks:
            chosen.append(at)
    presence = Presence()
    grams = [presence.of(sample[at][1]) for at in chosen]
    features = np.unique(np.concatenate(grams))

    def row(text: str) -> np.ndarray:
        size = len(presence.of(text))
        return presence.table[features].astype(np.float32) / np.float32(np.sqrt(size))

    marks = np.stack([row(sample[at][1]) for at in chosen])
    own = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    root = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    texts = [text for _, text in sample]
    kernel = [
        np.stack([row(t) for t in texts[at : at + 64]]) @ marks.T for at in range(0, len(texts), 64)
    ]
    space = np.concatenate(kernel) @ root
    truth = np.array([[1.0 if lang == other else -1.0 for other in languages] for lang, _ in sample])
    offset, centre = truth.mean(0), space.mean(0)
    moved = space - centre
    matrix = moved.T @ moved + ridge * len(sample) * np.eye(len(chosen))
    solved = np.linalg.solve(matrix, moved.T @ (truth - offset))
    weights = (marks.T @ (root @ solved)).astype(np.float32)
    return Model(languages, features, weights, offset - centre @ solved)


def annotate(docs: DataFrame, model: Model | None) -> DataFrame:
    """Columns c0, c1 and so on of ``docs``, lang_pred, and score (0 to 1)."""
    at = docs.columns.index("text")
    rows = common.numbered(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence()
        for batch in common.slices(batches, ROWS):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [n for n, text in enumerate(texts) if model and has_letter(text)]
            if known:
                rows = np.zeros((len(known), len(model.features)), np.float32)
                for row, n in zip(rows, known):
                    found = presence.of(texts[n])
                    row[:] = presence.table[model.features]
                    row /= np.sqrt(len(found))
                fits = rows @ model.weights + model.offset
                for n, language, value in zip(known, fits.argmax(1), fits.max(1)):
                    names[n] = model.languages[language]
                    scores[n] = min(1.0, max(0.0, (1 + float(value)) / 2))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores)],
                [*batch.schema.names, "lang_pred", "score"],
            )

    return rows.mapInArrow(run, common.extended(rows, lang_pred="string", score="double"))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every text."""
    found = annotate(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return found.select(F.col("c0").alias("doc_id"), "lang_pred", "score")


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, whose language could be told.

    Where no text could be learned from there is no model: all with a letter stay.
    """
    if model is None:
        at = docs.columns.index("text")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches, 64):
                texts = batch.column(at).to_pylist()
                yield batch.filter(pa.array([has_letter(t or "") for t in texts], pa.bool_()))

        rows = common.numbered(docs)
        return common.renamed(rows.mapInArrow(run, rows.schema), docs)
    return common.renamed(annotate(docs, model).where(F.col("lang_pred") != UNKNOWN), docs)


def train(docs: DataFrame, labelled: Column) -> Model | None:
    """A model learned from the rows that ``labelled`` admits, None if there are none."""
    sample = draw(docs, labelled)
    return fit(sample) if sample else None
