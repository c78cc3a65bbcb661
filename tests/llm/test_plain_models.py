"""The queries of the trained operators against plain versions, word by word, over whole tables."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard

from quillon.llm import language, toxicity
from quillon.llm.common import held_out, table
from quillon.llm.samples import sample_by_label

SF = "/root/testdata/sf0.001"


def documents():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_toxicity(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(sample_by_label(docs, labels.where(~held_out(labels.doc_id)).select("doc_id", "toxic").distinct(), "toxic", toxicity.SAMPLE))
    plain = [toxicity._compressor(d) for d in (model.ordinary, model.toxic + model.ordinary)]
    open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(model.ordinary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), format=zstandard.FORMAT_ZSTD1_MAGICLESS)

    def gain(word):
        window = model.ordinary[-40:-20] + b" " + word.strip(toxicity.MARKS).encode("utf-8", "replace") + b" " + model.ordinary[-20:]
        packed = plain[0].compress(window)
        assert open_.decompress(packed, max_output_size=len(window)) == window  # a window and nothing else
        return max(0, min(toxicity.LEVELS, len(packed) - len(plain[1].compress(window))))

    known = {}

    def score(text):
        found = Counter(known[w] if w in known else known.setdefault(w, gain(w)) for w in (text or "").lower().split())
        reached = [math.log1p(sum(n for g, n in found.items() if g >= level)) for level in range(1, toxicity.LEVELS + 1)]
        x = [*reached, reached[3] * math.log1p(sum(found.values())) / 5, 1.0]
        z = max(-30.0, min(30.0, sum(a * b for a, b in zip(x, model.weights))))
        return 1 / (1 + math.exp(-z))

    out = {r.doc_id: r for r in toxicity.op1_toxicity(spark, SF).collect()}
    assert out.keys() == {i for i, _ in documents()}
    for i, text in documents():
        s = score(text)
        assert out[i].score == pytest.approx(s, abs=1e-9) and out[i].held_out == fold(i) and out[i].predicted == int(out[i].score >= 0.3)
    assert {r.predicted for r in out.values()} == {0, 1}


def test_language(spark):
    docs = table(spark, SF, "documents")
    known = docs.where(~held_out(docs.doc_id) & docs.text.isNotNull()).select("doc_id", "lang")
    model = language.train(sample_by_label(docs, known, "lang", language.SAMPLE))

    def buckets(word):
        codes, m = [ord(c) for c in f"\x02{word}\x03"], (1 << 64) - 1
        for n in language.SIZES:
            for at in range(len(codes) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 0x100000001B3 + codes[at + k] + k + 1) & m
                yield (h * 0x9E3779B97F4A7C15 & m) >> 49 & (language.BUCKETS - 1)

    rows = {}

    def of(word):
        if word not in rows:
            b = list(buckets(word))
            rows[word] = model.table[b].astype(float).sum(axis=0), len(b)
        return rows[word]

    out = {r.doc_id: r for r in language.op4_language(spark, SF).collect()}
    assert out.keys() == {i for i, _ in documents()}
    for i, text in documents():
        assert out[i].held_out == fold(i)
        if not any(map(str.isalpha, text or "")):
            assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
            continue
        parts = [of(w) for w in text.lower().split()]
        z = (sum(p for p, _ in parts) / sum(n for _, n in parts) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert out[i].score == pytest.approx(p.max(), abs=1e-4)
        assert out[i].lang_pred == model.langs[int(p.argmax())] or np.sort(p)[-2] > p.max() - 1e-4
