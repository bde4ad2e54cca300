import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pieces
from tidemark.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
VOCABULARY = pieces.Vocabulary(MODEL, memory=50)
ALPHABET = st.sampled_from(list("abehinrst ▁ \n\t\x00é中🙂​<0x>/⁇") + ["the ", "ing", "  ", "</s>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=60).map("".join), min_size=1, max_size=5))
def test_encodes_and_decodes_as_the_library(texts):
    ids = VOCABULARY.encode(texts)
    assert ids == LIBRARY.encode(texts, add_eos=True)
    assert [VOCABULARY.decode(x) for x in ids] == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 260), st.integers(0, 31_999)), max_size=12))
def test_decodes_any_ids_as_the_library(ids):
    assert VOCABULARY.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "   ", "a" * 5000, "ab" * 40, " " * 333 + "x" + " " * 20, "word " * 3000, "\n" * 100])
def test_long_and_empty(text):
    assert VOCABULARY.encode([text]) == LIBRARY.encode([text], add_eos=True)


def test_units_are_checked(monkeypatch):
    own = pieces.Vocabulary(MODEL)
    monkeypatch.setattr(own, "merge", lambda units: [[5] for _ in units])
    with pytest.raises(ValueError, match="sentencepiece"):
        own.encode(["hello"])


class Wrong:
    """A library whose decoding is off."""

    encode = LIBRARY.encode

    def decode(self, ids, **more):
        return [x + "s" for x in LIBRARY.decode(ids)]


def test_decoding_is_checked(monkeypatch):
    own = pieces.Vocabulary(MODEL)
    monkeypatch.setattr(own, "library", Wrong())
    with pytest.raises(ValueError, match="decodes"):
        own.results(["hello"], ("decoded",))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=60).map("".join), min_size=1, max_size=5))
def test_results_join_what_units_have(texts):
    """Also across line ends, where a unit begins without a space mark."""
    texts = [*texts, *[f"{a}\n{b}" for a, b in zip(texts, texts[1:])]]
    ids = LIBRARY.encode(texts, add_eos=True)
    got = VOCABULARY.results(texts, ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"))
    assert got[0] == ids and got[1] == [len(x) for x in ids] and got[3] == LIBRARY.decode(ids)
    assert got[2] == [digest(" ".join(map(str, x))) for x in ids] and got[4] == [digest(x) for x in LIBRARY.decode(ids)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row(doc_id, text):
    ids = LIBRARY.encode(text or "", add_eos=True)
    return doc_id, len(ids), digest(" ".join(map(str, ids))), digest(LIBRARY.decode(ids))


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = QUERIES["op7_sentencepiece"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(row(d.doc_id, d.text) for d in docs)


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, "x"), (None, "", "x"), (2, "the the", None), (2, "the the", None), (3, "long " * 50_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encoded(docs, PATH, ("n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert sorted(map(tuple, got), key=str) == sorted((row(i, t) for i, t, _ in rows), key=str)
    full = pieces.encoded(docs.filter("doc_id = 2"), PATH, ("ids", "decoded")).first()
    assert full.ids == LIBRARY.encode("the the", add_eos=True) and full.decoded == "the the"
    assert pieces.encoded(docs.limit(0), PATH).count() == 0
