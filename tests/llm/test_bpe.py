import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm.bpe import TOKENIZER, Vocabulary, decode, encode, op12_bpe, vocabulary

LIBRARY = Tokenizer.from_file(TOKENIZER)

ODD = [
    "", None, " ", "\n\n", "It's we'll I'D 'S x's", "a<|endoftext|>b <|startoftext|><|endoftext|> <|END|> <|endoftext", "word " * 30_000, "nospace" * 20_000, "a" * 5001, "aaa aaaa aaaaa",
    "ÉḈ é ́x İ ΣΣ ẞ ﬁ", "\U0001f600\U0001f3fd‍♂️", "中文　测试", "x y z\u0085 w\x1cv\x1fu\x0bt", "3.14 ½ ٣٤ 12ab", "\x00\x01\x7f", "\tTabs\r\nand\fmore",
]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def numbers(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_odd_texts_match_the_library(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "x"), (3, "a\nb", "x"), (3, "a\nb", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted([(r.doc_id, numbers(r.ids), r.text) for r in decode(encode(docs)).collect()], key=str)
    assert got == sorted([(i, ids(t), LIBRARY.decode(ids(t), skip_special_tokens=False)) for i, t, _ in rows], key=str)
    assert encode(docs.limit(0)).count() == 0


def test_every_code_point_matches_the_library():
    v = Vocabulary(TOKENIZER)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}B " for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    assert [numbers(x) for x in v.encode(texts)] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abst're \n<|>́")), max_size=60))
def test_any_text_matches_the_library(text):
    assert numbers(vocabulary(TOKENIZER).encode([text])[0]) == ids(text)


def test_words_merged_together_equal_words_merged_alone():
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcdeinorst", k=rng.randint(1, 14))).encode() for _ in range(3000)} | {b"a" * k for k in range(1, 60)})
    v = Vocabulary(TOKENIZER)
    assert v.merge(words) == [v.merge([w])[0] for w in words]


def test_forgotten_pieces_are_learnt_again(monkeypatch):
    monkeypatch.setattr("quillon.llm.bpe.CACHE", 3)
    v = Vocabulary(TOKENIZER)
    for text in ("one two three four five", "five six one", "two"):
        assert numbers(v.encode([text])[0]) == ids(text)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        Vocabulary(TOKENIZER.replace("word_bpe_49k", "byte_bpe_50k"))


def test_query_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()

    def want(doc, text):
        n = ids(text)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return doc, len(n), digest(np.array(n, "<u4").tobytes()), digest(LIBRARY.decode(n, skip_special_tokens=False).encode())

    assert sorted(map(tuple, op12_bpe(spark, sf).collect())) == sorted(want(*r) for r in rows)
