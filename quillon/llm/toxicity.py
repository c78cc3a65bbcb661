"""Toxicity by compression distance: a text's windows are compressed with a dictionary of ordinary text and with one of toxic text.

Training, on the driver, on a bounded sample of labelled documents (SAMPLE of each label; near copies, told by the two
smallest word hashes, count once). The ordinary dictionary is the windows that most ordinary documents share; the toxic
one has the windows typical of toxic documents in front of the same content. What differs between the two compressed
lengths of a window is then due to toxic text alone. A window is a word without the marks around it, framed by a common
phrase: a compressed block has fixed costs of a few bytes, which the phrase pays for in both lengths.

Both contents are word lists chosen by document frequencies, not the result of zstandard's own training, and the ordinary list is in
both dictionaries: on the labels of sf0.1 (held-out recall at CUT 0.925, 2 false alarms of 870), dictionaries trained by
zstandard on windows of 5 or 8 words, apart, found 0.02 to 0.07; trained around the typical words and with the ordinary one behind
the toxic one, 0.49 to 0.73 for windows of 2 to 4 words (16 to 57 false alarms) and 0.84 (8) for single words: its selection keeps too
few of the telling words, and in longer windows chance matches of ordinary text outweigh them.

A text's evidence is how many of its windows reach each gain; a logistic model, fitted on sampled documents that the
dictionaries have not seen, turns it into the score (calibration), and CUT decides.

Scoring is one pass without a shuffle over whole texts. Gains of words are cached in a worker, at most CACHE of them.

Defined cases: null, empty and blank texts get the score of a text without windows; very long texts are taken whole; ties and repeated rows score alike;
labels repeated or null count once, or not; without labels of both kinds every score is 0; empty tables give no rows;
extra columns do not matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import held_out, table
from quillon.llm.samples import sample_by_label

SAMPLE = 2400  # labelled documents of each kind
CUT = 0.3
LEVELS = 12  # gains of this many bytes and more count alike
ORDINARY_BYTES, TOXIC_BYTES = 8192, 4096
CACHE = 300_000
MARKS = ".,;:!?\"'()[]{}|*#$%&<>-"


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    p = zstandard.ZstdCompressionParameters(
        compression_level=12, strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=6, target_length=32,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)


class Gains(dict):
    """word -> bytes that the toxic dictionary saves on its window, 0 to LEVELS; filled on demand."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        super().__init__()
        self.head, self.tail = ordinary[-40:-20], ordinary[-20:]
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(toxic + ordinary)

    def __missing__(self, word: str) -> int:
        window = b"%s %s %s" % (self.head, word.strip(MARKS).encode("utf-8", "replace"), self.tail)
        gain = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
        self[word] = gain = min(max(gain, 0), LEVELS)
        return gain

    def evidence(self, text: str | None) -> np.ndarray:
        """How many windows gain at least 1, 2, ... LEVELS bytes, as logarithms, and the fourth of them times the text's length (a
        long text has more chance gains); all 0 for a text without windows."""
        found = np.bincount(np.frombuffer(bytes(map(self.__getitem__, (text or "").lower().split())), dtype=np.uint8), minlength=LEVELS + 1)
        if len(self) > CACHE:
            self.clear()
        reached = np.log1p(np.cumsum(found[:0:-1])[::-1])
        return np.append(reached, reached[3] * np.log1p(found.sum()) / 5)


class Model:
    """Two dictionaries and the calibration. Picklable; the compressors are made where they are used."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.column_stack([evidence, np.ones(len(evidence))]) @ self.weights, -30, 30)))


def _distinct(texts: list[str]) -> list[str]:
    """One of each group of near copies."""
    seen = {}
    for t in texts:
        seen.setdefault(tuple(sorted(zlib.crc32(w.encode("utf-8", "replace")) for w in set(t.split()))[:2]), t)
    return list(seen.values())


def _fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.02) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * len(x) / 100 * np.eye(len(w)), x.T @ (p - y) + penalty * len(x) / 100 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(rows: list[tuple[int, str]]) -> Model | None:
    """rows: (1 for toxic or 0, text). Every third document of a kind is for the calibration."""
    kinds = [_distinct([t.lower() for y, t in rows if y == k]) for k in (0, 1)]
    if not all(kinds):
        return None
    seen = [[t for i, t in enumerate(ts) if i % 3 or len(ts) < 3] for ts in kinds]
    unseen = [[t for i, t in enumerate(ts) if not i % 3 or len(ts) < 3] for ts in kinds]
    share = [Counter(w.strip(MARKS) for t in ts for w in set(t.split())) for ts in seen]
    n0, n1 = map(len, seen)
    typical = [w for w, n in share[1].items() if w and n >= max(2, 0.005 * n1) and n * n0 >= 5 * (share[0][w] + 1) * n1]
    join = lambda ws: b"".join(b" %s " % w.encode("utf-8", "replace") for w in ws)
    ordinary = join(sorted((w for w in share[0] if w), key=lambda w: (share[0][w], w)))[-ORDINARY_BYTES:] or b" " * 40
    toxic = join(sorted(typical, key=lambda w: (share[1][w], w)))[-TOXIC_BYTES:]
    gains = Gains(ordinary, toxic)
    x = np.array([gains.evidence(t) for ts in unseen for t in ts])
    y = np.repeat([0.0, 1.0], [len(ts) for ts in unseen])
    return Model(ordinary, toxic, _fit_logistic(x, y))


@cache
def _gains(ordinary: bytes, toxic: bytes) -> Gains:
    return Gains(ordinary, toxic)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score."""
    schema = "doc_id long, held_out boolean, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = _gains(model.ordinary, model.toxic) if model else None
        for b in batches:
            texts = b.column("text")
            s = model.score(np.array([gains.evidence(t.as_py()) for t in texts]).reshape(len(texts), LEVELS + 1)) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; labels are learnt outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(sample_by_label(docs, labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct(), "toxic", SAMPLE))
    return score(docs, model).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
