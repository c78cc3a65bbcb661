"""Packing along a space-filling curve: neighbouring documents share training sequences of a fixed length.

Each document becomes token ids and an end mark. Its vector counts its tokens over hashed dimensions; a random projection
takes that to three dimensions, whose direction, on 16 bits an axis, is a point of a Hilbert curve. Documents are sorted
by that key (equal keys by a hash of doc_id, then doc_id) and their ids laid end to end; cutting that line every `room` ids
gives sequences without any padding but at the very end.

The line is laid in parallel: the tokens are written once to the shared folder; quantiles of the key cut the order into
several ranges for each shuffle partition (a key that a third of all documents have is itself cut, by the hash of doc_id);
the ranges' token counts, one number each, give each range its place on the line; each range is then sorted and cut alone.

A block's texts are split into words and these made distinct by Arrow, without a Python object for each. Distinct words are tokenized
once and kept by the worker (about CACHE of them): the tokenizer splits at white space, so a text's ids are those of its words in a row.

Defined cases: null text is an empty one (only the end mark); repeated rows and null ids are documents of their own; a text
longer than a sequence spans several, however long it is; an empty table gives no pieces; extra columns do not matter.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from quillon.llm.common import materialise, shuffle_partitions, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 2
ROOM = 4096
AXES, BITS, HASHED = 3, 16, 4096
SALT_BITS = 15  # with AXES * BITS: 63
RANGES_PER_PARTITION = 4
CACHE = 500_000
CHUNK = 256
BLOCK = 32 << 20  # bytes of text whose words are made distinct together
SLICE = 4 << 20  # bytes of text whose ids are gathered together


@dataclass
class Spans:
    """Lists of ids as places in one row of ids."""

    ids: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def row(cls, ids: np.ndarray, lengths: np.ndarray) -> Spans:
        """Lists that follow each other without gaps."""
        return cls(ids, np.cumsum(lengths) - lengths, lengths)

    @classmethod
    def of(cls, lists: list[np.ndarray], dtype: np.dtype | None = None) -> Spans:
        return cls.row(np.concatenate(lists) if lists else np.empty(0, dtype), np.array([len(x) for x in lists], np.int64))

    @classmethod
    def joined(cls, parts: list[Spans]) -> Spans:
        base = np.cumsum([0] + [len(p.ids) for p in parts])
        return cls(np.concatenate([p.ids for p in parts]), np.concatenate([p.starts + b for p, b in zip(parts, base)]), np.concatenate([p.lengths for p in parts]))

    def take(self, index: np.ndarray) -> Spans:
        return Spans(self.ids, self.starts[index], self.lengths[index])

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists `index` in a row and how many each has."""
        n = self.lengths[index]
        stops = np.cumsum(n)
        return self.ids[np.arange(n.sum()) + np.repeat(self.starts[index] - (stops - n), n)], n


def _cuts(size: np.ndarray, most: int) -> list[int]:
    """Where to cut rows of these sizes into runs of about `most`."""
    return np.append(np.unique(np.cumsum(size, dtype=np.int64) // most, return_index=True)[1], len(size)).tolist()


def binaries(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Each list of ids that follow each other as bytes."""
    offsets = np.append(0, np.cumsum(lengths)) * ids.dtype.itemsize
    if offsets[-1] >= 1 << 31:
        raise ValueError("more than 2 GB of ids in a batch")
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])


class Ids:
    """The ids of texts, as little-endian 16-bit (small vocabularies) or 32-bit numbers.

    The words of a block of texts are made distinct and tokenized together, in texts of CHUNK words with a mark between them. A
    word that ends in ASCII marks behind a letter is tokenized without them, as the tokenizer separates letters from
    marks, and capitals of words without letters beyond Latin are lowered, as it does itself: fewer words are distinct. What is
    left of letters only needs neither normalising nor splitting by patterns, so it goes to the same model without those steps.
    All else is done on whole columns: words are numbers, and a text's ids are gathered by the numbers of its words.
    """

    MARK = "|"
    MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
    LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f"  # all below BEYOND
    BEYOND = "\u0130"  # below, lower case is one letter's for one letter and nothing combines

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.ascii, self.letters = (Tokenizer(self.tokenizer.model) for _ in range(2))
        self.ascii.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")  # bytes stand for themselves
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        suffix = self.tokenizer.model.end_of_word_suffix
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])  # by id: a word's last
        self.marks: dict[str, np.ndarray] = {}
        self.mark = self._encode(self.MARK)
        self.known, self.kept = pa.array([], pa.string()), Spans.of([], self.dtype)

    @property
    def cores(self) -> set[str]:
        """The words without end marks whose ids are kept."""
        return set(self.known.to_pylist())

    def _encode(self, text: str, tokenizer: Tokenizer | None = None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _split(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, list[str]]:
        """words -> without the marks that can be cut off their ends, in lower case where that is safe; the places of words that lost marks; these."""
        special = pc.match_substring(words, "<|")  # perhaps a special token, which is found in the text as it is
        cut = pc.utf8_rtrim(words, self.MARKS)
        cut = pc.if_else(pc.and_not(pc.match_substring_regex(cut, f"[{self.LETTERS}]$"), special), cut, words)
        at = np.flatnonzero(pc.not_equal(pc.binary_length(cut), pc.binary_length(words)).to_numpy(zero_copy_only=False))
        marks = [w[n:] for w, n in zip(words.take(at).to_pylist(), pc.utf8_length(cut.take(at)).to_pylist())]
        as_is = pc.or_(special, pc.match_substring_regex(cut, f"[{self.BEYOND}-\U0010ffff]"))
        return pc.if_else(as_is, cut, pc.utf8_lower(cut)), at, marks

    def _learn(self, cores: pa.Array) -> Spans:
        """The ids of distinct words without end marks."""

        def those(mask: pa.Array) -> np.ndarray:
            return mask.to_numpy(zero_copy_only=False)

        odd = those(pc.or_(pc.match_substring(cores, "<|"), pc.or_(pc.match_substring(cores, self.MARK), pc.equal(cores, "")))) | (len(self.mark) != 1)
        letters = those(pc.match_substring_regex(cores, f"^[{self.LETTERS}]+$")) & self.ends.any() & ~odd
        ascii_ = those(pc.string_is_ascii(cores)) & letters
        spans, order = [], []
        for mask, tokenizer in ((ascii_, self.ascii), (letters & ~ascii_, self.letters)):
            order.append(np.flatnonzero(mask))
            ids = self._together(cores.take(order[-1]), " ", tokenizer)
            stop = np.flatnonzero(self.ends[ids]) + 1
            spans.append(Spans(ids, np.concatenate([[0], stop[:-1]])[: len(stop)], np.diff(stop, prepend=0)))
        order.append(np.flatnonzero(~letters & ~odd))
        ids = self._together(cores.take(order[-1]), f" {self.MARK} ", self.tokenizer)
        stop = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else np.empty(0, int)
        spans.append(Spans(ids, np.concatenate([[0], stop[:-1] + 1])[: len(stop)], np.diff(stop, prepend=-1) - 1))
        order.append(np.flatnonzero(odd))
        spans.append(Spans.of([self._encode(c) for c in cores.take(order[-1]).to_pylist()], self.dtype))
        if any(len(s.starts) != len(o) for s, o in zip(spans, order)):
            raise ValueError("the tokenizer does not keep words apart")
        return Spans.joined(spans).take(np.argsort(np.concatenate(order)))

    def _together(self, words: pa.Array, between: str, tokenizer: Tokenizer) -> np.ndarray:
        """The ids of all words in a row, `between` after each."""
        at = np.append(np.arange(0, len(words), CHUNK), len(words)).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(at, words), between)
        return np.concatenate([np.empty(0, self.dtype), *(self._encode(t.as_py() + between, tokenizer) for t in texts)])

    def of_words(self, words: pa.Array) -> Spans:
        """The ids of distinct words."""
        cores, at, marks = self._split(words)
        coded = cores.dictionary_encode()
        if len(self.known) > CACHE:
            self.known, self.kept = pa.array([], pa.string()), Spans.of([], self.dtype)
        new = coded.dictionary.filter(pc.invert(pc.is_in(coded.dictionary, self.known)))
        self.known, self.kept = pa.concat_arrays([self.known, new]), Spans.joined([self.kept, self._learn(new)])
        place = pc.index_in(coded.dictionary, self.known).to_numpy()[coded.indices.to_numpy()]
        if len(self.marks) > CACHE:
            self.marks.clear()
        tails = pa.array(marks, pa.string()).dictionary_encode()
        for m in tails.dictionary.to_pylist():
            if m not in self.marks:
                self.marks[m] = self._encode(m)
        pool = Spans.joined([self.kept, Spans.of([np.empty(0, self.dtype), *(self.marks[m] for m in tails.dictionary.to_pylist())])])
        pairs = np.full((len(words), 2), len(self.known))
        pairs[:, 0] = place
        pairs[at, 1] += 1 + tails.indices.to_numpy()
        ids, n = pool.gather(pairs.ravel())
        return Spans.row(ids, n.reshape(-1, 2).sum(axis=1))

    def slices(self, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Some texts at a time: the first one's place, the ids of all with each text's end mark, how many each has."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        blocks = _cuts(size, BLOCK)
        for a, b in zip(blocks, blocks[1:]):
            lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts[a:b], ""), "\n", " "), " ")
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.cast(pa.string())
            pool = Spans.joined([self.of_words(words), Spans.of([np.array([end], self.dtype)])])
            index, stops = coded.indices.to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)
            cuts, first = _cuts(size[a:b], SLICE), 0
            for c, d in zip(cuts, cuts[1:]):
                ends = stops[c:d] - first
                ids, n = pool.gather(np.insert(index[first : stops[d - 1]], ends, len(words)))
                yield a + c, ids, np.add.reduceat(n, np.append(0, ends[:-1] + np.arange(1, d - c)))
                first = stops[d - 1]

    def of(self, texts: list[str | None], end: int) -> list[bytes]:
        """The ids of each text and the end mark."""
        return [x.as_py() for _, ids, n in self.slices(pa.array(texts, pa.string()), end) for x in binaries(ids, n)]


@cache
def _ids(path: str) -> Ids:
    return Ids(path)


@cache
def _projection() -> np.ndarray:
    """A row for each hashed dimension."""
    return np.random.default_rng(7).normal(size=(HASHED, AXES)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """points: rows of unsigned numbers below 2 ** bits -> place on the Hilbert curve (Skilling's transform, all rows at once)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose ids (end mark included) stand in a row."""
    hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - HASHED.bit_length() + 1)
    v = np.add.reduceat(_projection()[hashed], np.cumsum(lengths) - lengths, dtype=np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return hilbert(np.clip((v + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def tokenize(docs: DataFrame, path: str = TOKENIZER, end: int = END) -> DataFrame:
    """docs(doc_id, text) -> doc_id, key, n, ids (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = _ids(path)
        for whole in batches:
            for at, ids, n in cached.slices(whole.column("text"), end):
                b = whole.slice(at, len(n))
                key = curve_keys(ids, n) << SALT_BITS | b.column("salt").to_numpy()
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(key, pa.int64()), pa.array(n, pa.int64()), binaries(ids, n)], ["doc_id", "key", "n", "ids"])

    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(1 << SALT_BITS)), F.lit(0)).cast("long").alias("salt")
    return docs.select("doc_id", "text", salt).mapInArrow(run, "doc_id long, key long, n long, ids binary")


def _range_of(bounds: list[int]):
    """How many bounds are below the key: binary search."""
    if not bounds:
        return F.lit(0)
    table_ = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(s, _):
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(table_, mid) < F.col("key")
        return F.when(s["lo"] >= s["hi"], s).when(below, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), state, step, lambda s: s["lo"])


def pack(docs: DataFrame, room: int = ROOM, path: str = TOKENIZER, end: int = END) -> DataFrame:
    """docs(doc_id, text) -> a row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (32-bit bytes)."""
    spark = docs.sparkSession
    tokens = materialise(tokenize(docs, path, end), "tokens")
    partitions = shuffle_partitions(spark)
    ranges = RANGES_PER_PARTITION * partitions
    cuts = tokens.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    placed = tokens.withColumn("range", _range_of(sorted(set(cuts or []))))
    place, base = 0, {}
    for r in sorted(placed.groupBy("range").agg(F.sum("n").alias("n")).collect()):  # a number for each range
        base[r["range"]] = place
        place += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at, kind = None, 0, _ids(path).dtype
        for whole in batches:
            for first in range(0, len(whole), 500):
                out: list[list] = [[] for _ in range(7)]
                b = whole.slice(first, 500)
                for doc, range_, n, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "range", "n", "ids"))):
                    if range_ != current:
                        current, at = range_, base[range_]
                    wide = np.frombuffer(ids, kind).astype("<u4")
                    start = 0
                    while start < n:
                        length = min(n - start, room - at % room)
                        for column, x in zip(out, (doc, start, length, n, at // room, at % room, wide[start : start + length].tobytes())):
                            column.append(x)
                        start, at = start + length, at + length
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(out)], NAMES)

    dealt = placed.repartition(partitions, "range").sortWithinPartitions("range", "key", "doc_id", "n", "ids")
    return dealt.select("doc_id", "range", "n", "ids").mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in NAMES))


NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return digest(pack(table(spark, sf_dir, "documents")))


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
