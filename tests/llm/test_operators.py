"""Each operator against a brute-force version, and on odd input."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wardline.llm import (
    chat, components, contextmix, decontaminate, langid, linkrank, packing, quality, secret_scan,
    simhash, warc,
)

SPACES = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, mark long, root string"
LONG = " ".join(f"word{n % 977} tail{n % 13}" for n in range(9000))
TOKEN = 'set token = "abcdefghijklmnop" now'


def docs_of(spark, texts):
    rows = [(n, t, "en", "web", 7, "x") for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [
        (0, "The cat sat on the mat and looked at the moon", "en", "web", 7, "x"),
        (1, None, None, None, 7, "x"), (2, "", "en", "web", 7, "x"),
        (3, LONG, "en", None, 7, "x"), (4, " \t\n ", "en", "web", 7, "x"),
        (5, "123 ... 456", "en", "web", 7, "x"), (6, TOKEN, "en", "web", 7, "x"),
        (6, TOKEN, "en", "web", 7, "x"), (None, "nobody wrote this line", "en", "web", 7, "x"),
        (8, "<|endoftext|> Ünïcode ÉTÉ, d'été... 'S 's", "en", "web", 7, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


# Language identification


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.col("doc_id") % 5 == 0
    model = langid.train(docs, ~held)
    got = langid.predict(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_kernel_weights_equal_kernel_values():
    sample = [("a", "abc abd aab ab"), ("a", "aab bba"), ("b", "xyz xzz"), ("b", "yyx zzy xy")]
    model = langid.fit(sample, landmarks=2)
    presence = langid.Presence()
    grams = [set(presence.of(t).tolist()) for _, t in sample]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    values, vectors = np.linalg.eigh(kernel)
    space = kernel @ (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    truth = np.array([[1, -1], [1, -1], [-1, 1], [-1, 1]], float)
    moved = space - space.mean(0)
    solved = np.linalg.solve(moved.T @ moved + langid.RIDGE * 4 * np.eye(4), moved.T @ truth)
    for at, (_, text) in enumerate(sample):
        found = presence.of(text)
        fit = presence.table[model.features] / np.sqrt(len(found)) @ model.weights + model.offset
        assert np.allclose(fit, moved[at] @ solved, atol=1e-3)


def test_languages_odd(odd, nothing):
    model = langid.train(odd, F.lit(True))
    got = langid.predict(odd, model).collect()
    assert len(got) == 10
    unknown = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert unknown == {1, 2, 4, 5}
    kept = langid.identified(odd, model)
    assert kept.columns == odd.columns and kept.count() == 6
    assert langid.predict(nothing, None).count() == 0
    assert langid.train(nothing, F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}


def test_only_letters_are_letters():
    assert not any(langid.has_letter(t) for t in ("", "½ ² 12", "٣_٤", "Ⅻ ⓐ", "!?"))
    assert all(langid.has_letter(t) for t in ("½ a", "ё", "²ñ", "中"))


# Context mixing


def test_context_mixing_counts_and_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    training = F.col("doc_id") % 7 != 2
    rows = contextmix.score(docs, training).collect()
    texts = {r["doc_id"]: r["text"].encode().lower().split() + [b"\n"] for r in docs.collect()}
    counts = Counter(w for i, t in texts.items() if i % 7 != 2 for w in t)
    total, different = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        words = texts[r["doc_id"]]
        base = sum(np.log10((counts[w] + 1) / (total + different + 1)) for w in words)
        assert r["n_tokens"] == len(words) and r["train_tokens"] == total
        assert r["n_known"] == sum(counts[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    held = [r for r in rows if not r["training"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_codes_are_prefix_free_and_read_back():
    words = sorted((f"w{n}".encode(), 1 + 3000 // (n + 1)) for n in range(300))
    coder = contextmix.Coder(words, 50, 70)
    for group in (slice(0, coder.size + 2), slice(coder.size + 2, None)):
        codes = [format(c, f"0{n}b") for c, n in zip(coder.codes[group], coder.lengths[group])]
        codes.sort()
        assert not any(b.startswith(a) for a, b in zip(codes, codes[1:]))
        assert sum(2.0 ** -len(c) for c in codes) == pytest.approx(1)
    symbol, contexts, _, _, others = coder.symbols([b"w3", b"zebra", b"w4"], (0, 0), True)
    assert others == [b"zebra"] and len(symbol) == 1 + 1 + 6 + 1 + 1
    lengths, bit, slots = coder.bits(symbol, contexts)
    at = 0
    for s, n in zip(symbol, lengths):
        assert "".join(map(str, bit[at : at + n])) == format(coder.codes[s], f"0{n}b")
        at += n


def test_a_long_text_in_parts_scores_as_one(monkeypatch):
    words = [(b"a", 9), (b"b", 5)]
    coder = contextmix.Coder(words, 2, 3)
    mixer = contextmix.Mixer(np.zeros((3, contextmix._SLOTS), np.float32), coder)
    text = b"a b longer a a b " * 400
    whole = mixer.score([text])[0]
    monkeypatch.setattr(contextmix, "_PART", 1000)
    parts = mixer.score([text])[0]
    assert parts[1] == whole[1] and parts[0] == pytest.approx(whole[0], rel=0.02)


def test_context_mixing_odd(odd, nothing):
    rows = contextmix.score(odd, F.coalesce(F.col("doc_id") != 3, F.lit(True))).collect()
    assert len(rows) == 10
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[4]["n_tokens"] == 1
    assert by[3]["n_tokens"] == 18001 and by[3]["n_known"] == 1
    assert contextmix.score(nothing, F.lit(True)).count() == 0
    untrained = contextmix.score(odd, F.lit(False)).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and all(r["n_known"] == 0 for r in untrained)


# SimHash


def brute_components(marks):
    ids, bits = list(marks), np.array(list(marks.values()), np.uint64)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(bits[n + 1 :] ^ bits[n]) <= 3):
            a, b = find(i), find(ids[n + 1 + m])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_links_equal_brute_force(spark):
    random = np.random.default_rng(5)
    marks = [0]
    for _ in range(40):
        centre = int(random.integers(0, 1 << 63))
        marks.append(centre)
        for _ in range(30):
            flips = random.choice(64, int(random.integers(1, 5)), replace=False)
            marks.append(centre ^ sum(1 << int(b) for b in flips))
    marks = sorted({simhash._signed(m) for m in marks})
    frame = spark.createDataFrame([(m,) for m in marks], "fingerprint long")
    want = brute_components({m: m & (1 << 64) - 1 for m in marks})
    got = dict.fromkeys(marks)
    got.update({r["fingerprint"]: r["root"] for r in simhash.roots_of(frame).collect()})
    assert all((got[m] if got[m] is not None else m) == want[m] for m in marks)


def test_a_key_that_very_many_meet_under():
    random = np.random.default_rng(6)
    block, base = 1, 0x1234_5678_9ABC_DEF0
    flips = [0] + [1 << b for b in range(64) if b // 16 != block]
    outside = base & ~(0xFFFF << 16)
    group = {
        outside ^ flips[random.integers(0, 49)] | int(random.integers(0, 1 << 9)) << 16
        for _ in range(700)
    }
    group = np.array(sorted(simhash._signed(g) for g in group))
    a, b = simhash.met(group, block)
    assert (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= 3).all()
    left, right = np.searchsorted(group, a), np.searchsorted(group, b)
    linked = brute_components({n: int(g) & (1 << 64) - 1 for n, g in enumerate(group)})
    root = list(range(len(group)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(left.tolist(), right.tolist()):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    assert {n: find(n) for n in range(len(group))} == linked


def test_components_of_a_chain_and_a_star(spark):
    chain = [(n, n + 1) for n in range(60)]
    star = [(1000, 1000 + n) for n in range(1, 200)]
    edges = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    got = dict(components.smallest_reachable(edges).collect())
    assert got == {n: 0 for n in range(61)} | {1000 + n: 1000 for n in range(200)}


def test_simhash_odd(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10
    by = {r["doc_id"]: r for r in rows}
    assert {by[n]["fingerprint"] for n in (1, 2, 4)} == {0}
    assert {by[n]["component_id"] for n in (1, 2, 4)} == {1}
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 3, 5, 6, 8]
    assert simhash.representatives(nothing).count() == 0


# Quality rules


def brute_quality(text):
    words = re.findall(SPACES, text)
    places = {}
    for n in range(len(words) - 7):
        places.setdefault(tuple(words[n : n + 8]), []).append(n)
    covered = {k for v in places.values() if len(v) > 1 for n in v for k in range(n, n + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(SPACES, line):
            again += line in seen
            seen.add(line)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)
    )


def test_quality_measures(spark, odd, nothing):
    texts = ["a b c d e f g h " * 3 + "x", "one two\none two\n\n \n one two", "# $ <b>|", LONG]
    rows = quality.judge(docs_of(spark, texts)).collect()
    for r in rows:
        assert tuple(r[1:6]) == brute_quality(texts[r["doc_id"]])
    got = quality.judge(odd).collect()
    assert len(got) == 10 and not any(r["kept"] for r in got if r["doc_id"] in (1, 2, 4))
    assert quality.judge(nothing).count() == 0


def test_quality_fences_follow_the_group(spark):
    plain = "these are words of a plain text that nobody would ever call a bad one at all "
    texts = [plain + f"number {n} " + plain[: 20 + n % 7] for n in range(300)]
    texts.append(" ".join(w + "%%%%" for w in (plain + plain[:40]).split()))
    rows = {r["doc_id"]: r["kept"] for r in quality.judge(docs_of(spark, texts)).collect()}
    assert rows.pop(300) is False and all(rows.values())


# WARC


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "ü" * 40_000, "<p>a</p>"]
    rows = [(n, f"http://h/{n}\r\nX: y", h, 1) for n, h in enumerate(html)] + [(None, None, "n", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    files = warc.archive(spark, pages)
    for split in (1, 100, 1 << 20):
        got = {r["page_id"]: r for r in warc.read(files, split).collect()}
        assert len(got) == len(rows)
        for n, h in enumerate(html):
            payload = (h or "").encode()
            assert got[n]["payload_bytes"] == len(payload)
            assert got[n]["payload_digest"] == warc.digest(payload) == got[n]["stated_digest"]
        assert {n: got[n]["refers_to"] for n in range(7)} == {0: 6, 1: None, 2: 6, 3: 4, 4: None,
                                                              5: None, 6: None}
        assert bytes(got[5]["payload"]) == html[5].encode() and got[0]["payload"] is None
        assert got[None]["record_type"] == "response"
    assert warc.read(warc.archive(spark, pages.limit(0))).count() == 0


def test_false_magic_is_not_a_record(tmp_path):
    member = warc.record(1, "http://h/", b"x" * 300, None)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"\x1f\x8b\x08 not a member \x1f\x8b\x08\x00" + member + member)
    with open(path, "rb") as source:
        assert len(list(warc.members(source, 0, path.stat().st_size))) == 2
    path.write_bytes(member + member[:-9])
    with open(path, "rb") as source, pytest.raises(ValueError):
        list(warc.members(source, 0, path.stat().st_size))


# Secret scans


def brute_secrets(text):
    spans = []
    for place, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(rule.pattern, text):
            if len(m[rule.group]) >= rule.least:
                spans.append((m.start(), place, m.end(), rule.kind))
    return sorted(spans)


SECRETS = [
    'password = "hunter2hunter2" PASSWD:short token=secret=abcdefghijkl', "AKIA" + "Z" * 16 + " AKIA1",
    "0123456789abcdef é" * 40, "😀" * 9 + "token: abcdefghijkl" + "é😀" * 9, "ghp_" + "a1B2" * 10, "é api_key: 'ABCDEFGHIJKL' apikey=abcdefghijkl.x",
    "-----BEGIN RSA PRIVATE KEY-----", "secrets of the token trade: none", None, "",
]


def test_secret_spans(spark, odd, nothing):
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in
           secret_scan.scan(docs_of(spark, SECRETS)).collect()}
    for n, text in enumerate(SECRETS):
        assert got[n] == brute_secrets(text or "")
    assert secret_scan.scan(odd).count() == 10 and secret_scan.scan(nothing).count() == 0


def test_trigram_queries():
    queries = {r.kind: secret_scan.trigrams(r.pattern) for r in secret_scan.RULES}
    assert queries["hex"] == []
    assert queries["access"] == [[frozenset({"aki", "kia"})]]
    words = {"".join(sorted(s)) for s in queries["assign"][0]}
    assert len(words) == 6
    texts = ["Password: x", "API_KEY", "apikey", "nothing", "gitHUB ghp_"]
    assert [any(all(g in t.lower() for g in s) for s in queries["assign"][0]) for t in texts] == [
        True, True, True, False, False
    ]


@pytest.mark.parametrize("block", [secret_scan.MASK_BLOCK, 7])
def test_redaction(odd, spark, monkeypatch, block):
    monkeypatch.setattr(secret_scan, "MASK_BLOCK", block)
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs_of(spark, SECRETS)).collect()}
    for n, text in enumerate(SECRETS):
        want, end = "", 0
        for start, _, stop, _ in brute_secrets(text or ""):
            if start >= end:
                want += text[end:start] + secret_scan.MASK
            end = max(end, stop)
        assert got[n] == (None if text is None else want + text[end:])
    assert secret_scan.redact(odd).columns == odd.columns


# URL filters


def test_rules_and_trust(spark):
    urls = [
        "http://Example.com/en/1", "https://www.example.com/en/x?y", "http://a.net/es/", "http://a.net/es",
        "http://b.net/fr/q#z", "http://b.net/en/", "x.com/", None, "http://org.org", "a://com/",
    ]
    links = {5: '<a href="http://far.org/x">', 8: "<a href=//b.net/en/><a href='/x'>"}
    rows = [(n, u, links.get(n), "z") for n, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    rules = spark.createDataFrame(linkrank.RULES, "action string, rule string")
    got = {r["page_id"]: r for r in linkrank.judge(pages, rules).collect()}
    assert [got[n]["rule"] for n in range(10)] == [
        "example.com/en/", "www.example.com/en/", "net/es/", None, "net/fr/", None, None, None, None,
        "com/",
    ]
    assert got[0]["verdict"] == "block" and got[1]["verdict"] == got[7]["verdict"] == "allow"
    assert (got[6]["host"], got[6]["path"]) == ("", "") and got[8]["path"] == ""
    # Distrust reaches the host that links to a blocked one, and not the one linked to.
    assert got[8]["distrust"] > 0 and got[8]["trust"] == 0
    assert linkrank.judge(pages.limit(0), rules).count() == 0


def test_propagation_equals_matrix(spark):
    edges = [("a", "b", 3), ("a", "c", 1), ("b", "a", 2), ("c", "c", 5), ("d", "a", 1)]
    seeds = [("a", 1.0, 0.0), ("b", 0.0, 0.5), ("c", 0.0, 1.0), ("d", 0.25, 0.0)]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in linkrank.propagate(
        spark.createDataFrame(edges, "src string, dst string, links long"),
        spark.createDataFrame(seeds, "host string, trusted double, blocked double"),
    ).collect()}
    ahead = np.zeros((4, 4))
    for s, d, n in edges:
        ahead["abcd".index(s), "abcd".index(d)] = n
    back = ahead.T.copy()
    for m in (ahead, back):
        for n in range(4):
            m[n] = m[n] / m[n].sum() if m[n].sum() else np.eye(4)[n]
    seed = np.array([s[1:] for s in seeds])
    trust, distrust = seed.T
    for _ in range(linkrank.ROUNDS):
        trust = 0.3 * seed[:, 0] + 0.7 * trust @ ahead
        distrust = 0.3 * seed[:, 1] + 0.7 * distrust @ back
    for n, host in enumerate("abcd"):
        assert got[host] == pytest.approx((trust[n], distrust[n]))


# Decontamination


ITEM = "What colour has the old clock tower in the far town. It has been green since spring of last year."


def test_decontamination(spark, odd, nothing):
    filler = "the tower in a town and the year of the clock was last of the old spring far from it "
    texts = [
        filler * 30 + ITEM.upper() + filler * 20, filler * 40, ITEM, ITEM[:52], None, "",
        " ".join(reversed(ITEM.split())),
    ]
    items = [(1, ITEM), (2, "too short"), (3, None), (4, "completely different words stand here now ok")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs_of(spark, texts), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, 1), (2, 1)}
    clean = decontaminate.clean(docs_of(spark, texts), benchmark)
    assert sorted(r["doc_id"] for r in clean.collect()) == [1, 3, 4, 5, 6]
    assert decontaminate.clean(odd, benchmark).columns == odd.columns
    assert decontaminate.contaminated(nothing, benchmark).count() == 0
    assert decontaminate.contaminated(odd, benchmark.limit(0)).count() == 0


def test_pruned_search_equals_full_scoring():
    random = np.random.default_rng(3)
    words = [f"w{n}".encode() for n in range(300)]
    frequent = 1 / np.arange(1, 301)
    frequent /= frequent.sum()

    def text(n):
        return b" ".join(random.choice(words, n, p=frequent))

    items = [(n, text(int(random.integers(6, 30)))) for n in range(60)]
    counts = Counter(w for _, t in items for w in set(decontaminate.words_of(t)))
    mean = float(np.mean([len(t.split()) for _, t in items]))
    index = decontaminate.Index(items, counts, len(items), mean)
    documents = [index.coded(text(400) + b" " + items[n][1] + b" " + text(90)) for n in range(20)]
    documents.append(index.coded(b""))
    got = {(d, i, b) for d, i, _, b, _ in decontaminate.search(index, documents)}
    want, half = set(), index.longest
    for d, row in enumerate(documents):
        for begin in range(0, max(len(row), 1), half):
            held = set(row[begin : begin + 2 * half].tolist())
            for i in range(len(items)):
                mine = index.item == i
                term = np.repeat(np.arange(len(index.terms)), np.diff(index.start))
                score = sum(w for t, w in zip(term[mine], index.impact[mine]) if t in held)
                if score >= decontaminate.THRESHOLD:
                    want.add((d, i, begin))
    assert got == want and len(want) >= 20


# Chat


def test_chat_round_trip(spark):
    bad = "␛ <|im_end|>\n<|im_start|>assistant ␛0 <␛1"
    rows = []
    for conv in range(6):
        turns = [("system", "be brief " * conv)] if conv % 2 else []
        turns += [("user", f"q{n} " * (n * 40 % 900)) for n in range(conv)]
        for n in range(30 * conv):
            turns.append(("assistant" if n % 2 else "user", bad + f" {n} " + "x" * (n * 131 % 4000)))
        rows += [(conv, n, role, text, "z") for n, (role, text) in enumerate(turns)]
    rows += [(None, None, None, None, "z"), (9, 5000, "assistant", "late", "z"), (9, 0, "us\ner", None, "z")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    made = chat.windows(talk)
    back = sorted(
        chat.read_back(made).collect(),
        key=lambda r: (r["conv_id"] is None, r["conv_id"], r["chunk"], r["place"]),
    )
    for conv in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] or 0))
        mine = [r for r in back if r["conv_id"] == conv]
        turns = [(t["role"], t["text"]) for r in mine for t in r["turns"]]
        assert turns == [(r[2] or "", r[3] or "") for r in want]
        targets = "".join(t for r in mine for t in r["targets"])
        assert targets == "".join(r[3] or "" for r in want if r[2] == "assistant")
    for r in made.collect():
        sizes = [4 + -(-len(p) // 4) for p in r["formatted"].split(chat.START)[1:]]
        assert sum(sizes) <= chat.BUDGET + max(sizes) + 60
        if r["conv_id"] in (3, 5) and r["place"] > 1:
            assert r["formatted"].startswith(chat.START + "system\n") and r["repeated"] >= 1
    assert chat.windows(talk.limit(0)).count() == 0


# Packing


def test_packing(spark, odd, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = packing.pack(odd, path).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc in odd.collect():
        ids = plain.encode(doc["text"] or "", add_special_tokens=False).ids + [2]
        mine = sorted(pieces[doc["doc_id"]], key=lambda r: r["start"])
        copies = 2 if doc["doc_id"] == 6 else 1
        assert sum(r["length"] for r in mine) == copies * len(ids)
        for r in mine:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert np.frombuffer(r["ids"], "<u4").tolist() == part
            assert zlib.crc32(bytes(r["ids"])) == zlib.crc32(np.array(part, "<u4").tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        ends = [0] + [a + b for a, b in places]
        assert [a for a, _ in places] == ends[:-1] and ends[-1] <= packing.CAPACITY
    assert packing.pack(nothing, path).count() == 0


def test_packing_over_many_workers(spark):
    docs = docs_of(spark, [f"{n} few words here " * (n % 60 + 1) for n in range(800)]).repartition(7)
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=256, smallest=16)
    got = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 256 for r in got)
    assert sum(r["n"] for r in got) / 256 / len(got) > 0.95


def test_long_words_are_not_remembered():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    words, plain = packing.Words(path), Tokenizer.from_file(path)
    texts = ["x" * 5000 + " short", "short, " + "é" * 200 + ".", "a-b" * 90]
    for text, code in zip(texts, words.encode([t.encode() for t in texts])):
        ids = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(code, "<u4").tolist() == ids
    assert words and max(map(len, words)) <= packing.LONGEST_REMEMBERED


def test_cuts():
    for tokens in (1, 127, 128, 4095, 4096, 4097, 12_345):
        parts = packing.cuts(tokens)
        assert sum(parts) == tokens and all(p < 128 or p & (p - 1) == 0 for p in parts)


def test_hashes_are_what_the_digest_says():
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
