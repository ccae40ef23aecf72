"""What op2's starting weights are learned from."""

import random

import numpy as np
from pyspark.sql import functions as F

from wardline.llm import contextmix


def test_all_training_texts_teach(spark, monkeypatch):
    """Every bit of every training text is a lesson, told from the other half's tables."""
    monkeypatch.setattr(contextmix, "_PART", 2000)  # the last text has several parts
    draw = random.Random(7)
    coder = contextmix.Coder(sorted((f"w{n}".encode(), 40 // (n + 1) + 2) for n in range(20)), 4, 3)
    texts = [(" ".join(f"w{draw.randrange(24)}" for _ in range(size)), bool(k % 3)) for k, size in enumerate([0, 1, 30, 50, 9, 6000])]
    shared = spark.sparkContext.broadcast(coder)
    docs = spark.createDataFrame(texts, "text string, drawn boolean")
    encoded = contextmix.encode(docs.repartition(3), shared)
    _, rest, other = contextmix.halves(encoded, shared)
    want = np.zeros(contextmix.CELLS, np.int64)
    middle = contextmix.CLASSES // 2
    for text, drawn in texts:
        symbol, contexts, *_ = coder.symbols(text.encode().split(), (0, 0), True)
        lengths, bit, slots = coder.bits(symbol, contexts)
        cell = np.repeat(symbol >= coder.size + 2, lengths).astype(int)
        for table, slot in zip(rest if drawn else other, slots):
            size = 1 + (np.abs(table[slot])[:, None] > contextmix.CLASS_ENDS).sum(1)
            cell = cell * contextmix.CLASSES + middle + (np.sign(table[slot]) * size).astype(int)
        np.add.at(want, cell * 2 + bit, 1)
    found = contextmix.lessons(encoded, shared, (other, rest))
    assert np.array_equal(found, want)
    assert np.array_equal(contextmix.lessons(encoded.coalesce(1), shared, (other, rest)), want)


def test_taught_weights_fit(spark):
    """Bits that the third input tells exactly, and the others not, move weight to it."""
    middle, classes = contextmix.CLASSES // 2, contextmix.CLASSES
    counts = np.zeros(contextmix.CELLS, np.int64)
    for side in (-1, 1):
        for noise in (-3, 3):
            cell = ((middle + noise) * classes + middle + noise) * classes + middle + 6 * side
            counts[2 * cell + (side > 0)] = 990
            counts[2 * cell + (side < 0)] = 10
    mixer = contextmix.Mixer(np.zeros((3, contextmix._SLOTS), np.float32), contextmix.Coder([(b"a", 2)], 1, 1))
    start = mixer.weights.copy()
    mixer.teach(counts)
    x = 2.25  # the gate of both: second at 0.75, third over 2
    gate = 1 + 3 * 2
    assert abs(mixer.weights[2, gate] * x - np.log(99)) < 0.1
    assert np.abs(mixer.weights[:2, gate].sum()) < 0.1 < start[:2, gate].sum()
    assert np.array_equal(mixer.weights[:, 0], start[:, 0])  # nothing seen


def test_scores_are_the_same_in_any_partitions(spark):
    docs = spark.createDataFrame([(n, f"a text {n % 5} of {n} words " * (n % 9)) for n in range(60)], "doc_id long, text string")
    one, many = (
        {r["doc_id"]: r["score"] for r in contextmix.score(d, F.col("doc_id") % 7 != 2).collect()}
        for d in (docs.coalesce(1), docs.repartition(5))
    )
    assert all(abs(one[n] - many[n]) < 1e-6 * max(1, abs(one[n])) for n in one)


def test_layers_are_the_bits_in_another_order():
    """What is counted is told without a repeat for each bit, short and long symbols alike."""
    draw = np.random.default_rng(3)
    words = sorted((f"w{n}".encode(), 2 ** (n % 12) + 1) for n in range(90))
    coder = contextmix.Coder(words, 40, 9)
    for size in (1, 2, 500):
        symbol = draw.integers(0, len(coder.lengths), size).astype(np.int32)
        contexts = draw.integers(0, 1 << 32, (3, size), np.uint32)
        kind = (symbol >= coder.size + 2).astype(np.int32)
        lengths, bit, slots = coder.bits(symbol, contexts)
        want = sorted(zip(np.repeat(kind, lengths).tolist(), bit.tolist(), *(s.tolist() for s in slots)))
        found, bit, slots = coder.layers(symbol, contexts, kind)
        assert sorted(zip(found.tolist(), bit.tolist(), *(s.tolist() for s in slots))) == want


def test_texts_that_end_learn_nothing_more():
    """Work on weights is for texts that go on, also beside others; those learn as alone."""
    draw = np.random.default_rng(5)
    coder = contextmix.Coder(sorted((f"w{n}".encode(), n + 2) for n in range(30)), 4, 3)
    mixer = contextmix.Mixer(draw.normal(0, 1.5, (3, contextmix._SLOTS)).astype(np.float32), coder)
    symbol = draw.integers(0, coder.size, 60).astype(np.int32)
    contexts = draw.integers(0, 1 << 32, (3, 60), np.uint32)
    state = mixer.start(2)
    both = mixer.step(state, np.array([0, 1], np.int32), [20, 40], symbol, contexts, 1)
    alone = mixer.start(1)
    later = mixer.step(alone, np.array([0], np.int32), [40], symbol[20:], contexts[:, 20:])
    assert np.isclose(both[1], later[0])
    for two, one, start in zip(state, alone, mixer.start(1)):
        assert np.array_equal(two[: len(start)], start)
        assert np.array_equal(two[len(start) :], one) and not np.array_equal(one, start)
