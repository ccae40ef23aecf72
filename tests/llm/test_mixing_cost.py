"""What op2 does for its words and bits, once for many of them, and that it is the same."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wardline.llm import contextmix

ODD = [
    None, "", " \t\n ", "One two", "  One\x0btwo \x0c\r", "ÉTÉ Été x y a\x1cb\x00c", "two " * 50,
    "rare1 One rare2", "x" * 400, "\n",
]


class Counting(dict):
    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)


def coder_of(*words):
    return contextmix.Coder(sorted((w, 5) for w in words), 3, 2)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("slab", [1, 30, 1 << 23])
def test_words_are_numbered_alike_together_and_one_by_one(monkeypatch, kind, slab):
    monkeypatch.setattr(contextmix, "SLAB", slab)
    coder = coder_of(b"one", b"two", "ÉtÉ".encode())
    batch = pa.RecordBatch.from_arrays([pa.array(ODD, kind)], ["text"])
    ids, others = [], []
    for [texts] in contextmix.slabs(batch, 0, slab):
        one, two = coder.encoded_together(texts)
        ids += one.to_pylist()
        others += two.to_pylist()
    want = [coder.encoded((t or "").encode()) for t in ODD]
    assert ids == [i.tobytes() for i, _ in want] and others == [b"\n".join(o) for _, o in want]


def test_a_word_is_looked_up_once_for_many_texts():
    coder = coder_of(b"one", b"two")
    coder.ids = Counting(coder.ids)
    ids, _ = coder.encoded_together(pa.array(["One two other"] * 200))
    assert coder.ids.asked == 3
    assert np.frombuffer(ids[199].as_py(), np.int32).tolist() == [0, 1, -1, 3]


@pytest.mark.parametrize("slab, gathered", [(1 << 23, 800_000), (1, 4), (40, 4)])
def test_word_counts_are_those_of_all_texts(spark, monkeypatch, slab, gathered):
    monkeypatch.setattr(contextmix, "SLAB", slab)
    monkeypatch.setattr(contextmix, "GATHERED", gathered)
    docs = spark.createDataFrame([(t,) for t in ODD], "text string").coalesce(1)
    want = Counter(w for t in ODD for w in [*(t or "").encode().lower().split(), b"\n"])
    found = contextmix.word_counts(docs).collect()
    assert {bytes(r["word"]): r["c"] for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("gathered", [1000, 1 << 20])
def test_small_counters_count_beyond_their_bits(monkeypatch, gathered):
    monkeypatch.setattr(contextmix, "GATHERED_SLOTS", gathered)
    draw, want = np.random.default_rng(1), np.zeros(50, np.int64)
    counts = contextmix.Counts(50)
    for hot in (0, 7, 7, 49):
        slots = np.where(draw.random(90_000) < 0.9, hot, draw.integers(0, 50, 90_000)).astype(np.int32)
        want += np.bincount(slots, minlength=50)
        counts.add(slots)
    assert np.array_equal(counts.total(), want) and counts.low.dtype == np.uint16


def test_scores_are_the_same_in_blocks_and_side_by_side(monkeypatch):
    draw = np.random.default_rng(9)
    words = [f"w{n}".encode() for n in range(60)]
    coder = contextmix.Coder(sorted((w, n + 2) for n, w in enumerate(words)), 4, 3)
    mixer = contextmix.Mixer(draw.normal(0, 1.5, (3, contextmix._SLOTS)).astype(np.float32), coder)
    texts = [b" ".join(words[k] for k in draw.integers(0, 60, size)) for size in (0, 3, 300, 700, 700, 9000)]
    whole = [s[0] for s in mixer.score(texts)]
    alone = [mixer.score([t])[0][0] for t in texts]
    monkeypatch.setattr(contextmix, "BLOCK", 100)
    monkeypatch.setattr(contextmix, "WIDE", 600)
    assert np.allclose(whole, alone, rtol=1e-6) and np.allclose(whole, [s[0] for s in mixer.score(texts)], rtol=1e-6)
    # The first symbols of a text, bit by bit.
    symbol, contexts, *_ = coder.symbols(texts[1].split(), (0, 0), True)
    lengths, bit, slots = coder.bits(symbol, contexts)
    total = 0.0
    for n, b in enumerate(bit):
        x = [float(t[s[n]]) for t, s in zip(mixer.table, slots)]
        gate = sum(k * ((abs(v) > 0) + (abs(v) > 2)) for k, v in zip((1, 3), x[1:]))
        mixed = float(np.clip(mixer.weights[:, gate] @ [*x, 1], -11.5, 11.5))
        mixed += mixer.levels[int(mixed + 12)]
        total -= np.logaddexp(0, mixed if not b else -mixed)
    assert whole[1] == pytest.approx(total, rel=1e-5)
