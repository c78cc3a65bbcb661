"""Byte-pair encoding and decoding of whole texts with a vocabulary file, by a pair occurrence index.

Texts are cut into pieces at blanks and line ends; each new piece is normalised and split into words as the vocabulary file
says (ASCII pieces by a pattern of our own with the same effect, others by the file's normaliser and splitter; strings of added
tokens are taken out first). The new words of a block of a partition stand as symbols in one line. An index maps each
mergeable pair to all its places on that line. Active merges are applied in ascending rank, each at all its places from
left to right, and the pairs that arise on both sides are entered in the index. That is what merging the lowest pair of each word
again and again gives, because a merge comes after those that make its parts (checked when the file is read).
The ids of a word and of a piece are kept by the worker, at most CACHE of each, so a word that a partition repeats is merged once.

Decoding joins the tokens of the ids with blanks, as a file without a decoder asks for.

Defined cases: null text is an empty one and has no ids; texts are encoded whole, however long; repeated rows and null doc_ids are
documents of their own; an empty table gives an empty one; extra columns do not matter, as only doc_id and text are read; equal
texts have equal ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CACHE = 400_000
BLOCK = 1000  # documents whose new words are indexed together
OUT = 200  # rows in a batch that goes back to Spark

#: The file's pattern on lower-case ASCII text.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)


class Vocabulary:
    """A vocabulary file of words with an end mark, whose splitter drops white space."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        added = self.tokenizer.get_added_tokens_decoder()
        plain = all(not (t.normalized or t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content)) for t in added.values())
        if model["type"] != "BPE" or self.split("B a") != [b"b", b"a"] or not plain or self.tokenizer.decoder is not None:
            raise ValueError(f"{path} is not a lower-case BPE vocabulary that drops white space and has no decoder")
        byte = {b: c for c, b in _bytes_of_chars().items()}
        self.inner = np.array([ids[byte[b]] for b in range(256)], np.int64)
        self.final = np.array([ids[byte[b] + end] for b in range(256)], np.int64)
        self.merges: list[tuple[int, int, int]] = []
        made_by: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, made = ids[a], ids[b], ids[a + b]
            self.merges.append((left, right, made))
            made_by[made] = rank
        if any(made_by.get(part, -1) > rank for rank, merge in enumerate(self.merges) for part in merge[:2]):
            raise ValueError(f"{path} has merges before those that make their parts")
        self.ranks = {left << 32 | right: rank for rank, (left, right, _) in enumerate(self.merges)}
        self.pair_keys = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[k] for k in self.pair_keys.tolist()], np.int64)
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.tokens = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def split(self, piece: str) -> list[bytes]:
        """The words of a text without added tokens, normalised, in UTF-8."""
        if piece.isascii():
            return [w.encode() for w in ASCII_WORDS.findall(piece.lower())]
        back = _bytes_of_chars()
        return [bytes(map(back.__getitem__, w)) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(piece))]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids (little-endian 32-bit) of each word; words are not empty."""
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        line = self.inner[raw]
        line[ends - 1] = self.final[raw[ends - 1]]
        after, before = np.arange(1, len(line) + 1), np.arange(-1, len(line) - 1)
        after[ends - 1] = -1
        before[0] = -1
        before[ends[:-1]] = -1
        places = np.flatnonzero(after >= 0)
        keys = line[places] << 32 | line[places + 1]
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        known = self.pair_keys[at] == keys
        places, found = places[known], self.pair_ranks[at[known]]
        order = np.argsort(found, kind="stable")
        heap, starts = np.unique(found[order], return_index=True)
        index = {r: p.tolist() for r, p in zip(heap.tolist(), np.split(places[order], starts[1:]))}
        self._apply(symbols := line.tolist(), after.tolist(), before.tolist(), index, heap.tolist())
        left = np.array(symbols, np.int64)
        alive = left >= 0
        size = np.add.reduceat(alive, ends - np.diff(ends, prepend=0), dtype=np.int64)
        out, stops = left[alive].astype("<u4").tobytes(), np.cumsum(size) * 4
        return [out[a:b] for a, b in zip((stops - size * 4).tolist(), stops.tolist())]

    def _apply(self, symbols: list[int], after: list[int], before: list[int], index: dict[int, list[int]], heap: list[int]) -> None:
        """Apply all merges that are active on the line; a symbol that went into the one before it becomes -1."""
        ranks, merges = self.ranks.get, self.merges
        while heap:
            rank = heappop(heap)
            left, right, made = merges[rank]
            for p in sorted(index.pop(rank)):
                q = after[p]
                if symbols[p] != left or q < 0 or symbols[q] != right:  # another merge took one of them
                    continue
                symbols[p], symbols[q] = made, -1
                after[p] = n = after[q]
                b = before[p]
                if n >= 0:
                    before[n] = p
                    if (new := ranks(made << 32 | symbols[n])) is not None:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heappush(heap, new)
                if b >= 0 and (new := ranks(symbols[b] << 32 | made)) is not None:
                    if new in index:
                        index[new].append(b)
                    else:
                        index[new] = [b]
                        heappush(heap, new)

    def learn(self, pieces: list[str]) -> None:
        """Keep the ids of new pieces."""
        parts: dict[str, list[bytes | tuple[bytes]]] = {}
        new: set[bytes] = set()
        for piece in pieces:
            if self.cut and (sections := self.cut.split(piece))[1:]:
                ws = [w for s in sections if s for w in ([(self.added[s],)] if s in self.added else self.split(s))]
            else:
                ws = self.split(piece)
            parts[piece] = ws
            new.update(w for w in ws if type(w) is bytes and w not in self.words)
        fresh = sorted(new)
        self.words.update(zip(fresh, self.merge(fresh)))
        for piece, ws in parts.items():
            self.pieces[piece] = b"".join([self.words[w] if type(w) is bytes else w[0] for w in ws])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        for kept in (self.pieces, self.words):
            if len(kept) > CACHE:
                kept.clear()
        lists = [(t or "").replace("\n", " ").split(" ") for t in texts]
        self.learn(list(set().union(*lists).difference(self.pieces)))
        return [b"".join(map(self.pieces.__getitem__, ps)) for ps in lists]

    def decode(self, ids: bytes) -> str:
        """The tokens with a blank between; ids that the vocabulary lacks are left out."""
        return " ".join(filter(None, map(self.tokens.get, np.frombuffer(ids, "<u4").tolist())))


@cache
def _bytes_of_chars() -> dict[str, int]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids (binary: little-endian unsigned 32-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for at in range(0, len(whole), BLOCK):
                b = whole.slice(at, BLOCK)
                made = v.encode(b.column(1).to_pylist())
                for k in range(0, len(made), OUT):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(k, OUT), pa.array(made[k : k + OUT], pa.binary())], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """encoded(doc_id, ids) -> doc_id, ids, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for at in range(0, len(whole), OUT):
                b = whole.slice(at, OUT)
                texts = [v.decode(ids or b"") for ids in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, text string")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded, as digests."""
    coded = decode(encode(table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )


QUERIES = {"op12_bpe": op12_bpe}
ORACLES: dict[str, str] = {}
