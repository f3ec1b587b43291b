import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import tokens as K

pytestmark = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary here")
SCHEMA = "doc_id bigint, text string, key int, ids string"


def in_segments(text, segment):
    """What the distributed path does, in one process."""
    enc, sides = K.encoding(), []
    for offset in range(0, max(len(text), 1), segment):
        at = max(offset, 1) - 1
        part = text[at : at + 2 * segment + 1]
        part = part[: 2 * segment] if not offset else part
        start, end, raw = K.segment_bounds(part, offset, len(text), segment)
        sides.append((raw, enc.encode_ordinary(part[start:end]) if end > start else []))
    while len(sides) > 1:
        sides = [(a[0], K.join_texts(enc, a[1], b[1]) if b[0] else a[1] + b[1]) for a, b in zip(sides[::2], sides[1::2])] + ([sides[-1]] if len(sides) % 2 else [])
    return sides[0][1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "hello", " ", "  ", "\n", "'s", "'", "12", "中文", "é", "!", "-", "😀", "\t", "ll", "aaaaaaaaaaaaaaaa", "11111111"]), max_size=60), st.sampled_from([3, 5, 8, 16]))
def test_segments_give_the_ids_of_the_whole(parts, segment):
    text = "".join(parts)
    assert in_segments(text, segment) == K.encoding().encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, "中" * 3000, "ab" * 3000 + "1" * 2000, " " * 4000 + "x", "!?" * 2000, "don't" * 900])
def test_unsplit_runs(text):
    assert in_segments(text, 100) == K.encoding().encode_ordinary(text)


def test_joins_inside_one_word():
    enc = K.encoding()
    for text in ("abcde" * 400, "中文字" * 300, "12345678" * 200):
        whole = enc.encode_ordinary(text)
        for cut in (1, 7, len(text) // 2, len(text) - 1):
            assert K.join_texts(enc, enc.encode_ordinary(text[:cut]), enc.encode_ordinary(text[cut:])) == whole
    assert K.join_texts(enc, [], [5]) == [5]


def test_corpus(spark):
    texts = [(1, "hello world"), (2, None), (3, ""), (4, "   "), (5, "<|endoftext|> x"), (6, "a" * 3000 + " b c " * 50), (7, "word " * 1000), (7, "word " * 1000), (8, "\x00\ud7ff é")]
    df = spark.createDataFrame([(*t, 1, "x") for t in texts], SCHEMA)
    got = sorted((r.doc_id, r.ids) for r in K.encode_corpus(df, segment=256).collect() if r.ids is not None)
    enc = K.encoding()
    assert got == sorted((i, enc.encode_ordinary(t)) for i, t in texts if t is not None)
    counts = {r.doc_id: r.n_tokens for r in K.encode_corpus(df, segment=256, counts_only=True).collect()}
    assert counts == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in texts}
    assert K.encode_corpus(df.limit(0)).collect() == []
    assert [enc.decode(ids) for i, ids in got if i == 6] == [texts[5][1]]


def test_json_and_ranks_agree(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(K.VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ("Don't stop, it's 42!", "  two  spaces\n\nnew", "中文字 é ß 😀", "<|endoftext|>"):
        assert t.encode(text, add_special_tokens=False).ids == K.encoding().encode_ordinary(text)
