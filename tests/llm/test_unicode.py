"""Ids of every code point, in several surroundings, against the tokenizers library."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ionloom.llm.bpe import Codec


@pytest.mark.parametrize("form", ["a{}b {}", "{}"], ids=["inside", "alone"])
def test_every_code_point(form):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, codec = Tokenizer.from_file(path), Codec(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x32000 or 0xE0000 <= c < 0xE0200 or c % 257 == 0)]
    wrong = []
    for lo in range(0, len(points), 4096):
        texts = [form.format(chr(c), chr(c)) for c in points[lo : lo + 4096]]
        for c, t, e in zip(points[lo : lo + 4096], texts, library.encode_batch(texts, add_special_tokens=False)):
            if codec.encode(t) != e.ids:
                wrong.append(hex(c))
    assert not wrong, wrong[:50]


def test_long_chunks_and_trailing_blanks():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, codec = Tokenizer.from_file(path), Codec(path)
    for t in ("a " * 20_000, "x" * 40_000 + " ", " " * 40_000, "éa " * 9_000 + "՘", "ab" * 9_000 + "Ᲊ" * 3):
        assert codec.encode(t) == library.encode(t, add_special_tokens=False).ids
        assert codec.decode(codec.encode(t)) == library.decode(codec.encode(t), skip_special_tokens=False)
