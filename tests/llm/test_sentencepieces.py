import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import sentencepieces as S
from tidemark.llm.tokens import public_tokenizer

PATH = public_tokenizer("piece_bpe_32k.model")
TABLE, SURFACES = S.ChunkTable(PATH, entries=60), S.Surfaces(PATH)
PARTS = ["a", "the", "'s", " ", "  ", "\n", "\t", "▁", "é", "É", "é", ",", "12", "<s>", "<0x0A>", "</s>", " ", "\x00", "漢字",
         "　", "🙂", "ﬁ", "x" * 70, "The ", "\r\n", "�", "͏", "​"]
TEXTS = st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), st.lists(st.sampled_from(PARTS), max_size=16).map("".join))


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_joined_chunks_are_the_librarys_ids(texts):
    for text, blob in zip(texts, TABLE.encode(texts)):
        ids = list(memoryview(blob).cast("I"))
        assert ids == TABLE.model.encode(text)
        assert SURFACES.decode(ids) == TABLE.model.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 262), st.just(28705)), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    assert SURFACES.decode(ids) == TABLE.model.decode(ids)


@pytest.mark.parametrize("ids", [[-1], [32_000], [5, -2, 9]])
def test_ids_the_model_lacks_are_errors(ids):
    with pytest.raises(Exception):
        SURFACES.decode(ids)


def test_a_distinct_chunk_is_segmented_once():
    table = S.ChunkTable(PATH)
    texts = ["one two two\nthree", "two one", "three  one\nthree"]
    table.encode(texts)
    table.encode(texts)
    assert table.segmented == len({c for t in texts for c in table.chunks(t)})


def digest_of(model, doc, text):
    ids = model.encode(text or "")
    return doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), \
        hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_digest_equals_the_library(documents, odd):
    for docs in (documents, odd):
        want = [digest_of(TABLE.model, r["doc_id"], r["text"]) for r in docs.collect()]
        got = [tuple(r) for r in S.pieces_digest(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_nothing_and_null_ids(nothing, spark):
    assert S.pieces_digest(nothing).collect() == []
    rows = spark.createDataFrame([("a", None), ("b", [])], "doc_id string, ids array<int>")
    assert [r["decoded"] for r in S.decode(rows).collect()] == ["", ""]


def test_encoding_shuffles_nothing(documents):
    plan = S.pieces_digest(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
