import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siltstone.llm.queries import tokenizer_path
from siltstone.llm.tokens import END_ID, WordEncoder

ODD = ["it's DON'T we'll'd''s", "İstanbul J̌ é ÅB", "ﬁ ß ẞ Σς", "a b c\u0085d", "«!» --x--y_9z a1b22", "日本語テキスト のテスト", "x!!'s y.'t \"q\"", "́lone mark", "ǅ ﬀ Ⅷ ⅷ ²³", "한글 한", "", "  \n\t ", "!!!", "'", "ȩ́x", "ͅᾼ", "emoji 😀👍🏽 z‍w", "the" * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("limit", [3, 150_000])
def test_same_ids_as_whole_texts(tokenizer, limit):
    rng = random.Random(5)
    signs = "abzÀéßñA'İı.,!#-«»1²²٣ \t\n ́̇ǅΣς中한가😀_’"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)] + [None]
    encoder = WordEncoder(tokenizer_path(), limit)
    for part in (texts[:700], texts[700:1500], texts[1500:], texts[:50]):
        ids, offsets = encoder.encode(pa.array(part, pa.string()))
        for i, t in enumerate(part):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [END_ID], repr(t)


def test_slices_of_an_array(tokenizer):
    texts = pa.array(["one two", None, "Three, four!", "five"])
    ids, offsets = WordEncoder(tokenizer_path()).encode(texts.slice(2, 2))
    assert ids.tolist() == tokenizer.encode("three, four!").ids + [1] + tokenizer.encode("five").ids + [1]
    ids, offsets = WordEncoder(tokenizer_path()).encode(texts.slice(0, 0))
    assert len(ids) == 0 and np.array_equal(offsets, [0])
