import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tuplespace.llm.queries import op8_token_orc, word_tokenizer
from tuplespace.llm.token_orc import WordEncoder, read_token_orc, tokenize_documents, write_token_orc
from tuplespace.session import scratch_path

ODD = ["Ça va İstanbul <|endoftext|>X <|ENDOFTEXT|> it's don't 'S 'RE x.'s ..,. áb Á  q\xa0w \x1c\x1dz \x85k a€! é! ÉCOLE??? x'!",
       "9!! l'été d'!s ß ÿ ŒUVRE ΣΑΣ K ¼½x! á! Á!", "", " \n", "a" * 30000, "the cat, the Cat. THE cat"]


@pytest.fixture(scope="module")
def coder():
    return WordEncoder(word_tokenizer())


def whole(coder, text):
    return coder.full.encode(text or "", add_special_tokens=False).ids + [2]


def test_pieces_equal_whole_texts(coder):
    ids, offsets = coder.encode(ODD + [None], 2)
    for k, text in enumerate(ODD + [None]):
        assert ids[offsets[k]:offsets[k + 1]].tolist() == whole(coder, text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBé É.,!'sStT1½ \n\t\xa0́<|>endoftx€İK")), max_size=4))
def test_pieces_equal_whole_texts_for_any_text(coder, texts):
    ids, offsets = coder.encode(texts, 2)
    for k, text in enumerate(texts):
        assert ids[offsets[k]:offsets[k + 1]].tolist() == whole(coder, text)


def digest(coder, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = whole(coder, text)
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_query_matches_whole_encoding(spark, coder, sf_small):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in op8_token_orc(spark, sf_small).collect())
    assert got == digest(coder, rows)


def test_edges(spark, coder):
    rows = [(None, "x y"), (1, None), (1, ""), (2, "a b"), (2, "a b"), (7, "long " * 20000)]
    docs = spark.createDataFrame([(i, t, "part") for i, t in rows], "doc_id long, text string, part string").repartition(3)
    got = tokenize_documents(spark, docs, word_tokenizer()).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(whole(coder, t)) for _, t in rows)
    assert sorted(r.start for r in got)[0] == 0 and {r.doc_id for r in got if r.start == 0} == {None}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokenize_documents(spark, empty, word_tokenizer()).collect() == []


def test_lookup_by_id(spark, coder, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    path = scratch_path(spark, "lookup")
    write_token_orc(docs, path, word_tokenizer())
    text = docs.where("doc_id = 17").first().text
    row = read_token_orc(spark, path, [17]).collect()
    assert [r.tokens for r in row] == [whole(coder, text)]
