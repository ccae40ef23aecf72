"""What Python workers hold on to, in a step and for the steps after it."""

import public_tokenizers

from wardline.llm import langid, packing


def test_a_worker_remembers_a_bounded_number_of_words(monkeypatch):
    """Also within one batch of texts: what one remembers stays with it for later steps."""
    assert packing.REMEMBERED * 200 <= 50_000_000
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"word{n * m}" for n in range(40)).encode() for m in range(1, 9)]
    few = packing.Words(path)
    got = list(few.encode(texts))
    assert len(few) <= 50
    monkeypatch.setattr(packing, "REMEMBERED", 10_000)
    assert got == list(packing.Words(path).encode(texts))


def test_language_of_a_few_rows_at_a_time():
    assert langid.ROWS * 4 << langid.BITS <= 10_000_000
