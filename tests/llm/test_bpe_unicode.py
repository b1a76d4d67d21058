"""Every code point, and capitals and special tokens in their places, against the library."""

import random
import unicodedata

import pytest

from tapeloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    public = pytest.importorskip("public_tokenizers")
    raw = bpe.load(public.path("word_bpe_49k.json"))
    return bpe.Codec(bpe.Vocabulary(raw)), tokenizers.Tokenizer.from_str(raw)


def test_all_code_points(both):
    codec, library = both
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for s in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}b !{chr(c)}? 1{chr(c)}{chr(c)}2 {chr(c)}" for c in points[s : s + 20_000]]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        for t, (_, got), ids in zip(texts, codec.encode(texts), want, strict=True):
            assert got == " ".join(map(str, ids)), [hex(ord(x)) for x in t]


def test_marks_in_any_order(both):
    codec, library = both
    r = random.Random(5)
    marks = [c for c in range(0x300, 0x20000) if unicodedata.combining(chr(c)) or unicodedata.category(chr(c))[0] == "M"]
    marks += [0x11935, 0x11930, 0x11938]
    for _ in range(3):
        texts = ["".join(r.choice("aoe\u0e19\U00011935") + "".join(chr(r.choice(marks)) for _ in range(r.randint(1, 5))) for _ in range(3)) for _ in range(8000)]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        for t, (_, got), ids in zip(texts, codec.encode(texts), want, strict=True):
            assert got == " ".join(map(str, ids)), [hex(ord(x)) for x in t]


def test_special_tokens_and_other_normalisers(both):
    codec, library = both
    texts = ["<|endoftext|>", "a<|startoftext|>B<|endoftext|", "<|ENDOFTEXT|>", "ΑΣ Σͅ İ ẞ", " \n\t"]
    for t, (_, got) in zip(texts, codec.encode(texts), strict=True):
        assert got == " ".join(map(str, library.encode(t, add_special_tokens=False).ids)), t
    v = codec.v
    assert v.steps == ["NFC", "lower"] and v._steps(None) == []
    with pytest.raises(ValueError):
        v._steps({"type": "Prepend", "prepend": "x"})
