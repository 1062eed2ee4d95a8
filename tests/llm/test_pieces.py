import random

import pytest

from lakeloom.llm.pieces import BLANK, PieceModel, default_path


@pytest.fixture(scope="module")
def models():
    import sentencepiece

    return PieceModel(default_path()), sentencepiece.SentencePieceProcessor(model_file=default_path())


def texts():
    rng = random.Random(7)
    fixed = ["", " ", "  ", "a", " a b  c   d", "\n\n\t x", "\r\n", BLANK, f"a{BLANK}{BLANK}b", "\x00", "é", "é", "🙂🙂", "<s></s>", "<0x41>", "﻿", "\xa0", "a" * 5000, " " * 333, "ab" * 900, "=" * 257, "0" * 1000]
    alphabets = ["ab", "abc  ", "the and ing", "=-_ ", "0123456789", "aé🙂 \n\t", "xyzXYZ.,;", "".join(map(chr, range(32, 127))), " \n", "日本語のテスト ", "слово в тексте"]
    for alphabet in alphabets:
        for _ in range(60):
            fixed.append("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))))
    return fixed


def test_equals_library(models):
    own, library = models
    all_texts = texts()
    ids, off = own.encode(all_texts)
    for i, t in enumerate(all_texts):
        want = library.encode(t, add_bos=True, add_eos=True)
        got = ids[off[i] : off[i + 1]]
        assert got.tolist() == want, repr(t)
        assert own.decode(got) == library.decode(want), repr(t)


def test_memory_does_not_matter(models, monkeypatch):
    import lakeloom.llm.pieces as pieces

    monkeypatch.setattr(pieces, "MEMORY", 3)
    own, library = models
    for t in ["one two three four five", "six seven one two", "ten"]:
        assert own.encode([t])[0].tolist() == library.encode(t, add_bos=True, add_eos=True)
