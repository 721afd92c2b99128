import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semspark.llm import tokens

SCHEMA = "doc_id long, text string, ids string, seq int, chunk string, text_key string"


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.TOKENIZERS)


def odd_texts():
    rng = random.Random(2)
    bits = ["the", " ", "  ", "\n\n", "\t", "don't", "'ll", "12345", "、", "中文字符", "ü", "é", "🚚📦", "‍", "...", "a" * 300, " " * 200, "</s>", "<|endoftext|>", " ", "　", "\x1c", "x1y2", "'S"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 400))) for _ in range(60)]


def test_ids_equal_those_of_the_whole_text(spark, enc):
    texts = odd_texts()
    page = "Page furniture, the same on each page. " * 40
    texts += [page + t + page for t in texts[:20]] + [texts[0], texts[0], "a" * 50_000, " " * 9000, "x " * 60_000, ".", "\n"]
    data = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (None, "null id"), (5, texts[5]), (5, "another text of the same id")]
    df = spark.createDataFrame([(*r, "clash", 1, "c", "c") for r in data], SCHEMA)
    got = sorted(((r.key, tuple(r.ids)) for r in tokens.encode_texts(df, "doc_id", "text").collect()), key=repr)
    want = sorted({(i, tuple(enc.encode_ordinary(t or ""))) for i, t in data}, key=repr)
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab '\n\t1.é中sS ")), min_size=1, max_size=60), st.lists(st.integers(1, 59), max_size=12))
def test_repair_of_any_cuts(text, cuts):
    enc = tokens.encoder(tokens.TOKENIZERS)
    at = sorted({0, len(text), *(c for c in cuts if c < len(text))})
    parts = []
    for a, b in zip(at, at[1:]):
        piece = text[a:b]
        w = list(tokens._words().finditer(piece))[-1]
        parts.append((piece, np.array(enc.encode_ordinary(piece), np.int32), w.start(), len(enc.encode_ordinary(w.group()))))
    assert tokens.assemble(parts, enc.encode_ordinary).tolist() == enc.encode_ordinary(text)


def repaired(text, at, enc):
    parts = []
    for a, b in zip(at, at[1:]):
        w = list(tokens._words().finditer(text[a:b]))[-1]
        parts.append((text[a:b], np.array(enc.encode_ordinary(text[a:b]), np.int32), w.start(), len(enc.encode_ordinary(w.group()))))
    return tokens.assemble(parts, enc.encode_ordinary).tolist()


@pytest.mark.parametrize("text", ["if we're", "they've gone", "you'll see", "x\n're y", "it''re", "a 're", "'ve", "x.'ll", "he's're we"])
def test_repair_of_each_cut_of_contractions(text, enc):
    for i in range(1, len(text)):
        assert repaired(text, [0, i, len(text)], enc) == enc.encode_ordinary(text)
        for j in range(i + 1, len(text)):
            assert repaired(text, [0, i, j, len(text)], enc) == enc.encode_ordinary(text)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("lver' '\na.1")), min_size=1, max_size=60), st.lists(st.integers(1, 59), max_size=12))
def test_repair_of_any_cuts_of_contractions(text, cuts):
    at = sorted({0, len(text), *(c for c in cuts if c < len(text))})
    enc = tokens.encoder(tokens.TOKENIZERS)
    assert repaired(text, at, enc) == enc.encode_ordinary(text)


def test_chunks_make_the_text_and_shift_with_it():
    gear = tokens._gear()
    rng = random.Random(1)
    body = " ".join(rng.choice(["order", "收入", "margin", "für", str(rng.random())]) for _ in range(3000))
    for t in [*odd_texts(), body]:
        assert "".join(tokens.chunks(t, gear)) == t
    own, moved = tokens.chunks(body, gear), tokens.chunks("A new first line. " + body, gear)
    assert len(set(own) & set(moved)) > 0.9 * len(own) > 20


def test_counts_and_empty_table(spark, enc):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, "text").collect()} == {1: 3, 2: 0, 3: 0}
    assert tokens.encode_texts(df.limit(0), "doc_id", "text").count() == 0
    assert [list(r.ids) for r in tokens.encode_texts(df.filter("doc_id = 2"), "doc_id", "text").collect()] == [[]]
