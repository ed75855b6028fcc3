"""Every code point is encoded as the tokenizers library does."""

import struct

import pytest
from tokenizers import Tokenizer

from marquee.llm import bpe

POINTS = [*range(1, 0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200), 0x10FFFF]


@pytest.mark.parametrize("shape", ["a{}b", "{}", " {0}{0}é "])
def test_every_code_point_in_a_short_text(shape):
    own, library = bpe.WordBpe(bpe.VOCABULARY), Tokenizer.from_file(bpe.VOCABULARY)
    texts = [shape.format(chr(p)) for p in POINTS]
    theirs = library.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [hex(p) for p, mine, other in zip(POINTS, own.encode(texts), theirs)
             if b"".join(mine) != struct.pack(f"<{len(other.ids)}I", *other.ids)]
    assert wrong == []


def test_unsettled_characters_beside_others():
    own, library = bpe.WordBpe(bpe.VOCABULARY), Tokenizer.from_file(bpe.VOCABULARY)
    texts = ["Ꟊx it's ՘ok 𐵀 ΣΑΣ<|endoftext|>ꟋY", "౜Á I'LL 12Ᲊ ", "" * 50 + " word" * 50, "İ Ꟊİ ǅ ſ"]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert b"".join(own.encode([text])[0]) == struct.pack(f"<{len(ids)}I", *ids)
