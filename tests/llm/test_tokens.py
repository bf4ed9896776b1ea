import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cpgloom.llm.tokens import DEFAULT_TOKENIZER, PairIndexEncoder, encode_corpus
from cpgloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ENC = PairIndexEncoder(open(DEFAULT_TOKENIZER, "rb").read())


def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return t


def test_every_document_matches_the_library(spark):
    t = library()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in QUERIES["p6_ids"](spark, SF).collect()}
    assert len(got) == len(text)
    for k, v in text.items():
        assert got[k] == (t.encode(v, add_special_tokens=False).ids if v else [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text_matches_the_library(texts):
    t = library()
    assert ENC.encode(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_special_names_repeats_and_long_words():
    t = library()
    texts = ["<|endoftext|> a", "aaaaaaa" * 3000, "  \n\n x  ", "ab" * 20000 + " cd", "\u0000퟿ é", None, ""]
    assert ENC.encode(texts) == [t.encode(x, add_special_tokens=False).ids if x else [] for x in texts]


def test_forgetting_words_changes_nothing():
    e = PairIndexEncoder(open(DEFAULT_TOKENIZER, "rb").read(), remembered=3)
    texts = ["the quick brown fox", "jumps over the lazy dog"]
    assert [e.encode([x])[0] for x in texts] == ENC.encode(texts)


def test_tables(spark):
    df = spark.createDataFrame([(1, "a b", 3), (1, "a b", 4), (None, None, 5), (2, "", 6)], "doc_id long, text string, ids int")
    got = sorted(((r["doc_id"], r["ids"]) for r in encode_corpus(df).collect()), key=str)
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, []), (None, [])]
    assert sorted(r["n_tokens"] for r in encode_corpus(df, counts_only=True).collect()) == [0, 0, 2, 2]
    assert encode_corpus(df.limit(0)).count() == 0
