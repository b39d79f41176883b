import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracklattice.llm import tokens

ENC = tokens.encoder(tokens.VOCABULARY)
PLAIN = tiktoken.Encoding("plain", pat_str=tokens.SPLIT_PATTERN, mergeable_ranks=tokens.read_ranks(tokens.VOCABULARY), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_equal_to_whole_encoding(text):
    assert ENC.encode(text) == PLAIN.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé ßZ　  '\t\n\r12٣字か🔥̈ﾊ.,-!?\x1c\x85", max_size=30))
def test_equal_around_boundaries(text):
    assert ENC.encode(text) == PLAIN.encode_ordinary(text)


def test_round_trip_and_special_strings():
    text = "<|endoftext|> It's 12:30 — naïve façade 🔥 字か。" * 500
    assert PLAIN.decode(ENC.encode(text)) == text
    assert 50256 not in ENC.encode("<|endoftext|>")


def test_table(spark):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (3, None, "x"), (4, "  \n", "x"), (5, "ab" * 40000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tokens.encode_corpus(df).collect()
    by = {r["doc_id"]: r["ids"] for r in got}
    assert len(got) == 6 and by[2] == [] and by[3] == [] and by[1] == PLAIN.encode_ordinary("Hello world") and by[4] == PLAIN.encode_ordinary("  \n")
    assert by[5] == PLAIN.encode_ordinary("ab" * 40000)
    assert tokens.encode_corpus(df.limit(0)).count() == 0
