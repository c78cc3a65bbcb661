"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A word's subwords are the 1- to 4-grams of its characters with a mark at either end, hashed into BUCKETS rows of an
embedding of DIM numbers. A text is the average over all its subwords; a linear softmax gives the languages. Both layers
are trained together by stochastic gradient descent in numpy, on pieces of PIECE words of a bounded sample (SAMPLE
documents of a language). A temperature and the rejection threshold are calibrated on documents kept out of the training:
the threshold is the smallest score at which accepted pieces are right at least ACCEPT of the time.

As both layers are linear up to the softmax, a word adds a fixed vector of scores, one for each language; workers cache
it for at most CACHE words, so a text costs one lookup and one addition for each word. Whole texts are read in one pass
without a shuffle.

Defined cases: null texts and texts without a letter get `und` with score 0 and are rejected; a language without training
text is never predicted; with no training text at all everything is `und`; ties go to the first language by name;
very long texts are taken whole; repeated rows get the same; empty tables give no rows; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import held_out, table
from quillon.llm.samples import sample_by_label

SAMPLE = 150
PIECE = 30
BUCKETS, DIM = 1 << 15, 16
EPOCHS, RATE, BATCH = 3, 0.5, 64
STEPS = 300  # at least, however small the sample
ACCEPT = 0.99
CACHE = 250_000
SIZES = (1, 2, 3, 4)
UNKNOWN = "und"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all subwords of all words, and how many each word has (words are not empty)."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    length = np.array([len(w) + 2 for w in words])
    end = np.repeat(np.cumsum(length), length)
    at, h, out, of = np.arange(len(codes)), np.zeros(len(codes), np.uint64), [], []
    word = np.repeat(np.arange(len(words)), length)
    for n in range(1, max(SIZES) + 1):
        k = len(codes) - n + 1
        if k <= 0:
            break
        h = h[:k] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        if n in SIZES:
            ok = at[:k] + n <= end[:k]
            out.append((((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)) & np.uint64(BUCKETS - 1))[ok].astype(np.int64))
            of.append(word[:k][ok])
    buckets, of_word = np.concatenate(out), np.concatenate(of)
    order = np.argsort(of_word, kind="stable")
    return buckets[order], np.bincount(of_word, minlength=len(words))


class Model:
    """table: BUCKETS x languages, both layers multiplied out; bias; temperature; threshold."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.langs, self.table, self.bias, self.temperature, self.threshold = langs, table, bias, temperature, threshold

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _softmax((sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pieces(rows: list[tuple[str, str]], index: dict[str, int], size: int = PIECE) -> tuple[list[np.ndarray], np.ndarray]:
    xs, ys = [], []
    for lang, text in rows:
        ws = text.lower().split()
        for i in range(0, len(ws), size):
            xs.append(subwords(ws[i : i + size])[0])
            ys.append(index[lang])
    return xs, np.array(ys, dtype=np.int64)


def train(rows: list[tuple[str, str]], seed: int = 1) -> Model | None:
    """rows: (language, text). Every fifth document is for the calibration."""
    rows = [(lang, t) for lang, t in rows if any(map(str.isalpha, t))]
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    index = {lang: i for i, lang in enumerate(langs)}
    xs, ys = _pieces([r for i, r in enumerate(rows) if i % 5 or len(rows) < 10], index)
    rng = np.random.default_rng(seed)
    e, w = (rng.normal(0, 0.1, shape).astype(np.float32) for shape in ((BUCKETS, DIM), (DIM, len(langs))))
    b = np.zeros(len(langs), np.float32)
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(len(xs), 1)))
    steps, step = max(1, epochs * -(-len(xs) // BATCH)), 0
    weight = (len(ys) / np.maximum(np.bincount(ys, minlength=len(langs)), 1) / len(langs))[ys]
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for i in range(0, len(xs), BATCH):
            take = order[i : i + BATCH]
            sizes = np.array([len(xs[k]) for k in take])
            ids = np.concatenate([xs[k] for k in take])
            mean = np.add.reduceat(e[ids], np.cumsum(sizes) - sizes) / sizes[:, None]
            g = _softmax(mean @ w + b)
            g[np.arange(len(take)), ys[take]] -= 1
            g *= weight[take, None]
            rate = RATE * (1 - step / steps)
            back = np.repeat((g @ w.T) / sizes[:, None], sizes, axis=0)
            w -= rate * (mean.T @ g) / len(take)
            b -= rate * g.sum(axis=0) / len(take)
            by = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.diff(ids[by], prepend=-1))
            e[ids[by[first]]] -= rate * 20 * np.add.reduceat(back[by], first) / len(take)
            step += 1
    model = Model(langs, (e @ w).astype(np.float32), b, 1.0, 0.0)
    xs, ys = _pieces([r for i, r in enumerate(rows) if not i % 5 or len(rows) < 10], index, size=5000)  # as whole as they will be judged
    sums, counts = np.array([model.table[x].sum(axis=0) for x in xs]), np.array([len(x) for x in xs])
    loss = lambda t: -np.log(np.maximum(_softmax((sums / counts[:, None] + b) / t)[np.arange(len(ys)), ys], 1e-12)).mean()
    model.temperature = float(min((0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss))
    p = model.probabilities(sums, counts)
    best = p.max(axis=1)
    order = np.argsort(-best, kind="stable")
    right = np.cumsum((p.argmax(axis=1) == ys)[order]) / np.arange(1, len(ys) + 1)
    good = np.flatnonzero(right >= ACCEPT)
    model.threshold = float(best[order][good[-1]]) if len(good) else 1.0
    return model


class Scores(dict):
    """word -> row of `rows`: its summed scores for each language and, last, its number of subwords."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table, self.rows, self.new = table, np.zeros((4096, table.shape[1] + 1), np.float32), []

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i

    def total(self, text: str) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        ws = text.lower().split()
        at = np.fromiter(map(self.__getitem__, ws), np.int64, len(ws))
        if self.new:
            start = len(self) - len(self.new)
            while len(self) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for i in range(0, len(self.new), 5000):
                buckets, n = subwords(self.new[i : i + 5000])
                part = self.rows[start + i : start + i + len(n)]
                part[:, :-1] = np.add.reduceat(self.table[buckets], np.cumsum(n) - n)
                part[:, -1] = n
            self.new = []
        return self.rows[at].sum(axis=0, dtype=np.float64)


@lru_cache(maxsize=2)
def _scores(key: bytes, shape: tuple[int, int]) -> Scores:
    return Scores(np.frombuffer(key, np.float32).reshape(shape))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, lang_pred, score, rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model and (model, model.table.tobytes(), model.table.shape))  # BUCKETS x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, key, shape = sent.value or (None, b"", (0, 0))
        scores = _scores(key, shape) if model else None
        for b in batches:
            texts = [t.as_py() for t in b.column("text")]
            known = [model is not None and t is not None and any(map(str.isalpha, t)) for t in texts]
            lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            at = np.flatnonzero(known)
            if len(at):
                total = np.array([scores.total(texts[i]) for i in at])
                p = model.probabilities(total[:, :-1], total[:, -1])
                score[at] = p.max(axis=1)
                rejected[at] = score[at] < model.threshold
                for i, k in zip(at, p.argmax(axis=1)):
                    lang[i] = model.langs[k]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    cols = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return cols.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; languages are learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    known = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).select("doc_id", "lang")
    return identify(docs, train(sample_by_label(docs, known, "lang", SAMPLE)))


QUERIES = {"op4_language": op4_language}
ORACLES: dict[str, str] = {}
