"""Operators 11 to 13 against brute force, on odd input and on hot groups."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wardline.llm import alignment, minhash, queries, spelling

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n long, word string, mark long, row long, root string"
PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def docs_of(spark, texts):
    return spark.createDataFrame([(n, t, "en", 1, "x", 2, 3, "y") for n, t in texts], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long_text = " ".join(f"word{n % 977}x tail{n % 13} longerword" for n in range(20_000))
    return docs_of(
        spark,
        [
            (0, "the cat sat on the mat"), (1, None), (2, ""), (3, long_text), (4, " \t\n "), (5, "one two"),
            (6, "some other text that repeats"), (6, "some other text that repeats"),
            (None, "THE cat sat on the mat"), (8, "<|endoftext|> <s> Ünïcode ÉTÉ▁ 中文"), (9, "日本語のテキスト"),
            (10, "ends in blanks   "), (11, "  starts\r\n \n\twith them"),
        ],
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# MinHash


def sets_of(texts):
    found = {}
    for i, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = minhash.WORDS
        found[i] = {" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    return found


def brute_near(texts):
    sets = sets_of(texts)
    places = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            places[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for k in {k for x in s for k in places[x] if k < i}:
            both = len(s & sets[k])
            if 100 * both >= 80 * (len(s) + len(sets[k]) - both):
                a, b = find(i), find(k)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}


def test_near_duplicates_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_near([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r for r in queries.op11_minhash(spark, "/root/testdata/sf0.01").collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i][1]) for i, r in got.items())
    assert sum(i != root for i, (_, root) in want.items()) > 50


def test_similar_texts_inside_a_template(spark):
    """Texts of one template share every bucket and are below the limit but for some pairs."""
    draw = random.Random(4)
    base = [f"t{n}" for n in range(120)]

    def filled(own):
        return " ".join(base[:60] + own + base[60:])

    texts = [(n, filled([f"w{draw.randrange(10**9)}" for _ in range(40)])) for n in range(500)]
    for n in range(40):
        own = [f"w{draw.randrange(10**9)}" for _ in range(40)]
        texts += [(1000 + 2 * n, filled(own)), (1001 + 2 * n, filled([*own[:-4], "p", "q", "r", f"s{n}"]))]
    want = brute_near(texts)
    assert sum(i != root for i, (_, root) in want.items()) == 40
    assert near(docs_of(spark, texts)) == want


def test_leaves_of_a_star_are_linked(spark):
    """A chain: every text is similar to the next one only."""
    draw = random.Random(9)
    words = [f"w{n}" for n in range(40)]
    texts = []
    for n in range(400):
        texts.append((n, " ".join(words)))
        words[draw.randrange(40)] = f"v{n}"
    want = brute_near(texts)
    assert near(docs_of(spark, texts)) == want


def test_copies_that_only_their_original_links(spark, monkeypatch):
    """Each copy is changed elsewhere: similar to the original, hardly to another copy."""
    draw = random.Random(6)
    base = [f"t{n}" for n in range(150)]
    texts = [(500, " ".join(base))]
    for n in range(300):
        words = list(base)
        for at in draw.sample(range(150), 3):
            words[at] = f"own{n}x{at}"
        texts.append((n if n < 150 else 1000 + n, " ".join(words)))
    want = brute_near(texts)
    assert {root for _, root in want.values()} == {0}
    tried = []
    plain = minhash.remaining
    monkeypatch.setattr(minhash, "remaining", lambda *args: tried.append(plain(*args).count()) or plain(*args))
    assert near(docs_of(spark, texts)) == want
    assert all(n < len(texts) for n in tried)


def test_short_sets_at_the_limit(spark):
    """Sets of 4 and 5 shingles, 4 of them shared: exactly 0.8, in many small pairs."""
    texts = []
    for n in range(300):
        words = [f"w{n}x{k}" for k in range(8)]
        texts += [(2 * n, " ".join(words[:7])), (2 * n + 1, " ".join(words))]
    want = brute_near(texts)
    assert all(root == i - i % 2 for i, (_, root) in want.items())
    assert near(docs_of(spark, texts)) == want


def test_prefixes_of_rarest_shingles_lose_nothing(spark):
    draw = random.Random(2)
    rows = []
    for n in range(150):
        kept = set(draw.sample(range(30), draw.randrange(3, 12))) if n % 3 != 2 else set(rows[-1][2]) ^ {draw.randrange(30)}
        rows.append((n, len(kept), sorted(kept)))
    rows = [r for r in rows if r[1]]
    sets = spark.createDataFrame(rows, "mark long, n long, hashes array<long>")
    roots = spark.createDataFrame([], "mark long, root long")
    got = {frozenset(r) for r in minhash.remaining(sets, roots).collect()}
    want = {
        frozenset((a, c)) for a, _, b in rows for c, _, d in rows
        if a < c and 100 * len(set(b) & set(d)) >= 80 * len(set(b) | set(d))
    }
    assert want and want <= got


def test_densified_bins_agree_like_the_sets():
    draw = random.Random(1)
    shares = []
    for _ in range(60):
        words = [f"w{draw.randrange(10**9)}" for _ in range(28)]
        a, b = (minhash.Shingles().of(" ".join(w).encode()) for w in (words, words[:-3]))
        shares.append((minhash.sketch(a) == minhash.sketch(b)).mean() - len(b) / len(a))
    assert abs(sum(shares) / len(shares)) < 0.04


def test_near_duplicates_odd(odd):
    got = rows_of(minhash.near_duplicates(odd))
    assert len(got) == 13
    by_id = {r[0]: r[1:] for r in got}
    assert by_id[0] == (3, 0) and by_id[None] == (3, 0)
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[4] == (0, 4)
    assert by_id[5] == (1, 5) and got.count((6, 2, 6)) == 2
    assert not minhash.near_duplicates(odd.limit(0)).collect()


# Alignment


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Aligner(*PATHS)


def brute_alignment(texts, tools):
    """The contract's columns, from whole texts and sets of overlapping byte ranges."""
    found, counts = [], Counter()
    for i, text in texts:
        ids_a = tools.a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = tools.b.encode(text or "")
        parts = [[tools.bytes_a[n] for n in ids_a], [tools.bytes_b[n] for n in ids_b]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(parts[0]) != whole or b"".join(parts[1]) != whole:
            found.append((i, [], [], [], ""))
            continue
        spans = []
        for side in parts:
            at, one = 0, []
            for p in side:
                one.append((at, at + len(p)))
                at += len(p)
            spans.append(one)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        written, start = [], 0
        for end in cuts:
            inside = [
                ",".join(str(n) for n, (s, e) in zip(ids, one) if s >= start and e <= end)
                for ids, one in zip((ids_a, ids_b), spans)
            ]
            written.append("|".join(inside))
            start = end
        linked = [
            (a, b) for a, (s, e) in zip(ids_a, spans[0]) for b, (u, v) in zip(ids_b, spans[1])
            if max(s, u) < min(e, v)
        ]
        counts.update(set(linked))
        digest = hashlib.sha256(";".join(written).encode()).hexdigest()
        found.append((i, ids_a, ids_b, linked, len(written), digest))
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return [
        (i, len(a), len(b), rest[0], len(linked), sum(counts[p] == top[p[0]] for p in linked),
         sum(counts[p] for p in linked), rest[1]) if a else (i, 0, 0, 0, 0, 0, 0, "")
        for i, a, b, linked, *rest in found
    ]


def short(rows):
    return [(r["doc_id"], (r["text"] or "")[:3000]) for r in rows]


@pytest.mark.parametrize("fits", [True, False])
def test_alignment_of_the_table(spark, tokenizers, monkeypatch, fits):
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", 10**6 if fits else 0)
    texts = short(spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    got = rows_of(alignment.score(docs_of(spark, texts), *PATHS))
    assert got == sorted(brute_alignment(texts, tokenizers), key=repr)


def test_alignment_odd(odd, tokenizers):
    texts = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != 3]
    got = rows_of(alignment.score(odd.where("doc_id is null or doc_id <> 3"), *PATHS))
    assert got == sorted(brute_alignment(texts, tokenizers), key=repr)
    assert rows_of(alignment.score(odd.where("doc_id = 3"), *PATHS))[0][1] > 100_000
    assert not alignment.score(odd.limit(0), *PATHS).collect()


def test_texts_cut_into_stretches_align_like_whole_ones(tokenizers):
    draw = random.Random(5)
    letters = list("ab cd  \n\t\r'sé ñ.,!3  　ᰮ\x1c\x1f<|>▁中文́ﬁ½😀") + [
        "<|endoftext|>", "<0x0A>", "<s>", " the", "\r\n", " ;\r", "'ll"
    ]
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(1, 25)))
        parts = next(tokenizers.documents([text]))
        whole = tokenizers.encoded([text])[0]
        cut, one = alignment.document(parts), alignment.document(whole and [whole])
        assert cut[:5] == one[:5] and [list(x) for x in cut[5:]] == [list(x) for x in one[5:]]


def test_groups_and_links_of_a_small_case():
    ends_a, ends_b = [2, 5, 6, 9], [3, 5, 9]
    assert alignment.align(ends_a, ends_b) == [(0, 2, 0, 2), (2, 4, 2, 3)]
    assert alignment.links((0, 2, 0, 2), ends_a, ends_b) == [(0, 0), (1, 0), (1, 1)]
    assert alignment.links((2, 4, 2, 3), ends_a, ends_b) == [(2, 2), (3, 2)]


# Spelling variants


def brute_words(texts):
    counts = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def brute_variants(texts):
    words = brute_words(texts)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        return root(forms[w]) if forms[w] else w

    return sorted(
        (
            (w, forms[w], root(w), n, len(near[w]), words[forms[w]] if forms[w] else None)
            for w, n in words.items()
        ),
        key=repr,
    )


def test_variants_of_the_table(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert rows_of(queries.op13_spelling_variants(spark, SMALL)) == brute_variants(texts)


def test_every_edit_at_every_place(spark):
    words = {"abcdefgh", "abcdefghij", "aaaaaaa", "aaaaaaaa", "éàüabcdef", "zzzzzzzzzzzzzzz"}
    for w in list(words):
        for k in range(len(w) + 1):
            words |= {w[:k] + "x" + w[k:], w[:k] + w[k + 1 :], w[:k] + "ø" + w[k + 1 :]}
    words = sorted(w for w in words if len(w) >= 7)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {frozenset(r) for r in spelling.near_pairs(df).collect()}
    want = {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert got == want
    assert spelling.near_pairs(df).count() == len(want)


def test_forms_lead_to_the_last(spark):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    text = " ".join(" ".join([w] * (2 * 10**k)) for k, w in enumerate(chain))
    # Ties go to the first word; a near word of less than ten times the count is no form.
    text += " qwertyu qwertyu" + " qwertyx" * 30 + " qwertya" * 30 + " poiuytr poiuytr" + " poiuyt" + " poiuytrs" * 19
    texts = [(n, t) for n, t in enumerate([text])]
    got = {r["word"]: r for r in spelling.variants(docs_of(spark, texts)).collect()}
    want = {r[0]: r for r in brute_variants(texts)}
    assert {w: tuple(r) for w, r in got.items()} == want
    assert got["abcdefg"]["root"] == "abcdefghij" and got["qwertyu"]["form"] == "qwertya"
    assert got["poiuytr"]["form"] is None and got["poiuytr"]["n_near"] == 1


def test_variants_odd(odd, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert rows_of(spelling.variants(odd)) == brute_variants(texts)
    assert not spelling.variants(odd.limit(0)).collect()
    whole = spelling.vocabulary(odd, damaged=0).where(F.col("word") == "longerword").first()
    assert whole["n"] == 20_000
