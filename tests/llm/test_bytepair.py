import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bytepair as B

pytestmark = pytest.mark.skipif(not os.path.exists(B.TOKENIZER), reason="no tokenizer files")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(B.TOKENIZER)
    t.encode_special_tokens = True
    with open(B.TOKENIZER, encoding="utf-8") as f:
        return B.BacktrackingEncoder(f.read()), t


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abcdeinorst '\n0129-_.=")), st.characters(blacklist_categories=("Cs",))), max_size=60))
def test_equals_reference_merges_and_round_trips(both, text):
    ours, theirs = both
    ids = ours.encode(text)
    assert ids == theirs.encode(text, add_special_tokens=False).ids and ours.decode(ids) == text


def test_long_pieces(both):
    ours, theirs = both
    for text in ("a" * 5000, "=-" * 3000, " " * 4000 + "x", "<|endoftext|> end", "日本" * 800):
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_table(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (2, None, 5), (3, "", 5)], "doc_id bigint, text string, ids int")
    got = sorted((r["doc_id"], len(r["ids"])) for r in B.encode_corpus(df, "doc_id", "text").collect())
    assert got == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert B.encode_corpus(df.where("false"), "doc_id", "text").count() == 0
