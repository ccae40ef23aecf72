"""Operators do their whole job: cases that a cheaper method would leave out."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wardline.llm import contextmix, langid, linkrank, quality


def test_drawn_texts_count_in_the_tables(spark):
    words = [(b"a", 9), (b"b", 5), (b"c", 4)]
    shared = spark.sparkContext.broadcast(contextmix.Coder(words, 4, 3))
    rows = [("a b c a", True), ("b b a other", False), ("c a", True), ("a b c a", True)]
    docs = spark.createDataFrame(rows, "text string, drawn boolean").repartition(2)
    whole, rest = contextmix.tables(docs, shared)
    plain, _ = contextmix.tables(docs.withColumn("drawn", F.lit(False)), shared)
    assert np.array_equal(whole, plain) and not np.array_equal(whole, rest)
    alone, _ = contextmix.tables(docs.where("not drawn"), shared)
    assert np.array_equal(rest, alone)


def test_a_hot_drawn_text_is_learned(spark, monkeypatch):
    """A text that holds a third of the rows is known to the model, drawn or not."""
    hot = " ".join(f"hot{n % 9} word{n % 7}" for n in range(60))
    texts = [hot] * 100 + [f"plain text number {n} of many others" for n in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for share in (0.0, 1.0):
        monkeypatch.setattr(contextmix, "SHARE", share)
        rows = contextmix.score(docs, F.lit(True)).collect()
        found.append(next(r["bits_per_byte"] for r in rows if r["doc_id"] == 0))
    assert found[1] < 1.5 * found[0] + 0.05


def test_many_hosts_that_link_to_a_blocked_one(spark):
    rows = [("http://hub.net/es/1", "")]
    rows += [(f"http://bad{n}.org/x", "<a href='http://hub.net/es/1'>") for n in range(300)]
    rows += [(f"http://good{n}.com/x", f"<a href='http://fair{n}.org/x'>") for n in range(300)]
    rows += [(f"http://fair{n}.org/x", "<a href='http://hub.net/es/1'>" * (n < 3)) for n in range(300)]
    pages = spark.createDataFrame(
        [(n, u, h) for n, (u, h) in enumerate(rows)], "page_id long, url string, html string"
    )
    rules = spark.createDataFrame(linkrank.RULES, "action string, rule string")
    blocked = {r["host"] for r in linkrank.judge(pages, rules).collect() if r["verdict"] == "block"}
    assert blocked == {"hub.net"} | {f"bad{n}.org" for n in range(300)}


def test_planted_outliers_fail_their_fences(spark):
    plain = "these are words of a plain text that nobody would ever call a bad one at all "
    texts = {n: f"{plain}number {n}\nand its second line {n} is longer\n{plain[:20 + n % 7]}" for n in range(300)}
    for n, share in enumerate((40, 50, 60, 70)):
        # Long lines between the repeated ones, so that few words are repeated.
        lines = [" ".join(f"w{k}x{m}" for m in range(30)) for k in range(100 - share - 1)]
        texts[400 + n] = "\n".join(lines + [f"line {n}"] + [f"line {n}"] * share)
    texts[500] = " ".join(f"{k % 10} ab c" for k in range(60))
    texts[501] = " ".join(f"{chr(97 + k % 26)}{chr(97 + k % 7)}{k}averylongword" for k in range(60))
    texts[502] = " ".join(f"word{k}" + "%" * (k % 2) for k in range(60))
    docs = spark.createDataFrame(
        [(n, t, "en", "web") for n, t in texts.items()],
        "doc_id long, text string, lang string, source string",
    )
    rows = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    failed = {n for n, r in rows.items() if not r["kept"]}
    assert failed == {n for n in texts if n >= 400}
    adaptive = {n for n in failed if not rows[n]["base_failed"]}
    assert {400, 401, 402, 403, 501, 502} <= adaptive


def test_texts_with_letters_stay_without_a_model(spark):
    rows = [(0, "some clean text", None), (1, "12 ... 34", None), (2, None, None), (3, "Привет", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    assert model is None
    assert {r["doc_id"] for r in langid.identified(docs, model).collect()} == {0, 3}


def bit_by_bit(mixer, text):
    """The score of a text from scalar arithmetic, one bit after another."""
    coder, cut = mixer.coder, 0xFFFFFFFF
    m1, m2, m3 = 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35
    symbols, before = [], [0, 0]
    for word in [*text.lower().split(), None]:
        number = coder.size + 1 if word is None else coder.ids.get(word, -1)
        one, two = before[-1], before[-2]
        head = (0, (one * m1 + 1) & cut, ((one * m2) ^ (two * m1)) & cut)
        symbols.append((coder.size if number < 0 else number, head))
        if number < 0:
            for at, byte in enumerate(word + b"\n"):
                back = [word[at - n] if at >= n else 10 for n in range(1, 5)]
                packed = back[0] | back[1] << 8 | back[2] << 16 | back[3] << 24
                around = ((back[0] + 1) * m2, (back[0] | back[1] << 8) * m3 + 7, packed * m1 + 11)
                symbols.append((coder.size + 2 + byte, tuple(c & cut for c in around)))
        before.append(zlib.crc32(word) if number < 0 else ((number + 1) * m3) & cut)
    weights, levels = mixer.weights.astype(float).copy(), mixer.levels.astype(float).copy()
    total, at = 0.0, 0
    while at < len(symbols):
        end = at + min(contextmix.LONG_STEP, max(contextmix.STEP, at // 2))
        seen = []
        for symbol, around in symbols[at:end]:
            length, code = int(coder.lengths[symbol]), int(coder.codes[symbol])
            for left in range(length, 0, -1):
                node = (((code >> left) ^ (left * m3)) * m1 + length) & cut
                inputs = []
                for table, context in zip(mixer.table, around):
                    slot = context ^ node
                    slot ^= slot >> 15
                    inputs.append(float(table[((slot * m2) & cut) >> (32 - contextmix.SLOT_BITS)]))
                sure = [(abs(x) > 0) + (abs(x) > 2) for x in inputs[1:]]
                gate = sure[0] + 3 * sure[1] + 9 * (symbol >= coder.size + 2)
                mixed = weights[3, gate] + sum(w * x for w, x in zip(weights[:, gate], inputs))
                mixed = min(11.5, max(-11.5, mixed))
                level = int(mixed + 12)
                mixed += levels[level]
                sign = 1 if code >> (left - 1) & 1 else -1
                right = 1 / (1 + math.exp(-sign * mixed))
                total += math.log(max(right, 1e-7))
                seen.append((gate, level, sign * (1 - right), inputs))
        times = Counter(s[0] for s in seen), Counter(s[1] for s in seen)
        for gate, level, error, inputs in seen:
            for k, x in enumerate([*inputs, 1.0]):
                weights[k, gate] += error * x * contextmix.RATE / max(1, times[0][gate] / 512)
            levels[level] += error * contextmix.REFINE / max(1, times[1][level] / 64)
        at = end
    return total


def test_score_equals_bit_by_bit(monkeypatch):
    monkeypatch.setattr(contextmix, "STEP", 16)
    draw = np.random.default_rng(3)
    words = sorted((f"w{n}".encode(), 400 // (n + 1) + 2) for n in range(60))
    mixer = contextmix.Mixer(draw.normal(0, 1.5, (3, contextmix._SLOTS)).astype(np.float32), contextmix.Coder(words, 9, 40))
    mixer.table[:, draw.integers(0, contextmix._SLOTS, 300_000)] = 0
    texts = [
        b" ".join(draw.choice([f"W{n}".encode() for n in range(80)] + [b"other", b"\xc3\xa9t\xc3\xa9"], size))
        for size in (0, 1, 30, 200)
    ]
    together = mixer.score(texts)
    for text, (total, *_) in zip(texts, together):
        assert abs(total - bit_by_bit(mixer, text)) < 1e-3 * max(1, abs(total))
    # The same in one lane, and in parts of any size.
    for size in (40, 333):
        monkeypatch.setattr(contextmix, "_PART", size)
        for text, (total, *_) in zip(texts, together):
            assert abs(mixer.score([text])[0][0] - total) < 1e-4 * max(1, abs(total))


def test_tables_count_every_bit(spark):
    """Counts of whole words outside any context are the same as bit by bit."""
    draw = random.Random(5)
    words = sorted((f"w{n}".encode(), 40 // (n + 1) + 2) for n in range(20))
    coder = contextmix.Coder(words, 4, 3)
    texts = [(" ".join(f"w{draw.randrange(24)}" for _ in range(draw.randrange(40))), bool(k % 3 == 0)) for k in range(30)]
    whole, rest = contextmix.tables(
        spark.createDataFrame(texts, "text string, drawn boolean").repartition(3), spark.sparkContext.broadcast(coder)
    )
    for found, admitted in ((whole, lambda drawn: True), (rest, lambda drawn: not drawn)):
        counts = np.zeros((3, 2 * contextmix._SLOTS))
        for text, drawn in texts:
            if admitted(drawn):
                symbol, contexts, *_ = coder.symbols(text.encode().split(), (0, 0), True)
                _, bit, slots = coder.bits(symbol, contexts)
                for row, slot in zip(counts, slots):
                    np.add.at(row, slot * 2 + bit.astype(int), 1)
        want = np.log((counts[:, 1::2] + 0.05) / (counts[:, 0::2] + 0.05))
        assert np.allclose(found, want, atol=1e-5)


def test_copies_score_alike(spark, monkeypatch):
    docs = spark.createDataFrame([(n, f"some text {n % 4} of words") for n in range(40)], "doc_id long, text string")
    rows = contextmix.score(docs.coalesce(1), F.lit(True)).collect()
    assert len({r["doc_id"] for r in rows}) == 40
    monkeypatch.setattr(contextmix, "REMEMBERED_BYTES", 0)
    again = contextmix.score(docs.repartition(7), F.lit(True)).collect()
    assert {r["doc_id"]: round(r["score"], 6) for r in rows} == {r["doc_id"]: round(r["score"], 6) for r in again}
