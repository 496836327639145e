from __future__ import annotations

from array import array

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from linespark.llm.packing import _WordIds  # noqa: E402


def test_forms_of_a_word_share_an_entry():
    words = _WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Word word WORD wOrD", "H\u0331 Ha\u0331 J\u030c T\u0308ab", "a <|ENDOFTEXT|> B <|endoftext|> C", "\u00c9T\u00c9 \u0130I K\u212a \u03a3\u03a3A. Don'T!!"]
    for t in texts:
        assert words.encode(t.encode()) == array("I", words.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
    words.clear()
    words.encode(texts[0].encode())
    assert list(words) == [b"word"]
