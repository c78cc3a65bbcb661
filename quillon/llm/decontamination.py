"""Benchmark decontamination: documents that hold a benchmark item, up to a few edited words.

Texts are sequences of words (lower case, without marks at the ends). The CGK embedding walks over a sequence with random
bits: step j emits the word at the current place and moves on if bit j of that word's hash is 1. Two sequences within a few edits
mostly walk in step again soon after each edit, so that their emitted sequences differ in few places (Hamming distance).

Windows. An item of up to WINDOW words is one window; a longer one is cut into equal windows of at most WINDOW words. Of the
windows of an item with EDIT_RATE of its words edited at least one has no more than that rate, so finding one is enough.

Bit sampling. WALKS walks, with a hash of their own each, start at a window's first word. Of each, KEYS keys are made: the words
emitted at SAMPLES steps, drawn from a stretch as long as the window. A key that reads past its window's end is left out; the first of each
walk reads within as many steps as the window has words, so that unchanged windows always meet. Windows and places of a text
that share one of the WALKS * KEYS keys are candidates. Samples of a size class (SIZES) are the same for items and texts.

Where walks start. Each edit takes two pairs of adjacent words from a window at most, so that c - 1 - 2 * edits of its pairs are left
within the next c + edits words of a text. Places with fewer pairs that occur in any item start no walk; that
loses nothing and is a running sum. A phrase that many items share does not make a candidate of each item: a key spans a window.

Verification. The edit distance in words between the whole item and the best part of the document around the candidates, by
dynamic programming, must be at most EDIT_RATE of the item's words, rounded down, at any length. One pass over whole texts, no
shuffle. Items travel with the tasks in blocks of MAX_ITEMS at most; more items take more passes.

Defined cases: null or empty texts match nothing; items of fewer than five words must be there word for word, as a fifth of them is no
word; items without words match nothing; null item_id stays null; repeated items are found each; repeated rows are judged alike; of
places with equally many edits in one stretch of candidates the first end counts, of stretches the first; very long texts are taken whole;
empty tables give no matches; extra columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import table
from quillon.llm.wordhash import MULTIPLIER, WordHashes, mix, split, times

EDIT_RATE = 0.2
WINDOW = 24
SIZES = (1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 18, 21)
WALKS = 10
KEYS = 8
SAMPLES = 4
MAX_ITEMS = 20_000
STEP = 400  # documents at once
CHUNK = 16_384  # places at once
MARKS = b".,;:!?\"'()[]{}|*#$%&<>-"

MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("edits", T.IntegerType())]))


class PlainHashes(WordHashes):
    """word -> hash of its lower case without marks at the ends."""

    def __missing__(self, word: bytes) -> int:
        plain = word.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass").strip(MARKS)
        self[word] = h = super().__missing__(plain or word) if plain != word else super().__missing__(word)
        return h


@cache
def _hashes() -> PlainHashes:
    return PlainHashes()


def most_edits(n: int) -> int:
    return int(EDIT_RATE * n)


def cuts(n: int) -> list[int]:
    """Where the windows of an item of n words begin, and n."""
    k = -(-n // WINDOW)
    return [n * j // k for j in range(k + 1)]


@cache
def samples(size: int, walk: int) -> tuple[tuple[int, ...], ...]:
    """The steps of each key of a walk over windows of `size` words or a little more."""
    rng = np.random.default_rng((size, walk))
    low = [0, *rng.integers(0, max(1, round(0.6 * size)), KEYS - 1)]
    k = min(SAMPLES, size)
    return tuple(tuple(sorted(int(x + at) for x in rng.choice(size, k, replace=False))) for at in low)


def walk_places(words: np.ndarray, starts: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """Row j: where each walk is at step j. `words` must go on for `steps` words after each start."""
    bits = np.unpackbits(mix(words ^ times(2 * walk + 1)).view(np.uint8)).reshape(-1, 64).T[:steps].copy()
    at = starts.astype(np.int32)
    out = np.empty((steps, len(at)), np.int32)
    for j in range(steps):
        out[j] = at
        at = at + bits[j][at]
    return out


def key_of(words: np.ndarray, places: np.ndarray, some: np.ndarray, steps: tuple[int, ...], salt: int) -> np.ndarray:
    """The key of the words that some of the walks emit at these steps."""
    key = np.full(len(some), times(salt))
    for j in steps:
        key ^= words[places[j][some]]
        key *= MULTIPLIER
        key ^= key >> np.uint64(29)
    return key


def size_of(c: int) -> int:
    """The size class of windows of c words."""
    return max(s for s in SIZES if s <= c)


def reach(sizes: list[int]) -> int:
    """The steps that keys of these size classes read."""
    return 1 + max(j for s in sizes for w in range(WALKS) for key in samples(s, w) for j in key)


def pairs_of(words: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each word and the next one."""
    h = (words[:-1] * MULTIPLIER ^ words[1:]) * MULTIPLIER
    return (h >> np.uint64(32)).astype(np.uint32)


def best_match(item: np.ndarray, text: np.ndarray, most: int | None = None) -> tuple[int, int]:
    """(least edit distance between item and a part of text, where that part starts); more than `most` if that is exceeded."""
    cost, start = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    place = np.arange(len(text) + 1)
    for i, w in enumerate(item, 1):
        change = cost[:-1] + (text != w)
        skip = cost[1:] + 1
        new = np.append(i, np.minimum(change, skip))
        from_ = np.append(start[0], np.where(change <= skip, start[:-1], start[1:]))
        run = np.minimum.accumulate(new - place)  # insertions from the left
        left = np.maximum.accumulate(np.where(new - place == run, place, 0))
        cost, start = run + place, from_[left]
        if most is not None and i % 16 == 0 and cost.min() > most:  # the least cost never falls
            return most + 1, 0
    end = int(cost.argmin())
    return int(cost[end]), int(start[end])


class Present:
    """A table of bits: whether a 32-bit hash may be one of the keys."""

    def __init__(self, keys: np.ndarray):
        size = min(24, max(16, (16 * len(keys)).bit_length()))
        self.shift = np.uint32(32 - size)
        self.bits = np.zeros(1 << size, bool)
        self.bits[keys >> self.shift] = True

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return self.bits[keys >> self.shift]


class Windows:
    """The windows of one size class by the keys of their walks."""

    def __init__(self, size: int, rows: list[tuple[int, int, np.ndarray]]):
        self.size = size
        steps = reach([size])
        length = np.array([len(w) for _, _, w in rows])
        gap = np.zeros(steps, np.uint64)
        line = np.concatenate([x for _, _, w in rows for x in (w, gap)])
        starts = np.cumsum(length + steps) - length - steps
        keys, which = [], []
        for walk in range(WALKS):
            places = walk_places(line, starts, walk, steps)
            for m, chosen in enumerate(samples(size, walk)):
                inside = np.flatnonzero(places[chosen[-1]] < starts + length)
                keys.append(key_of(line, places, inside, chosen, walk * KEYS + m))
                which.append(inside)
        keys, which = np.concatenate(keys), np.concatenate(which)
        order = np.argsort(keys, kind="stable")
        self.window = which[order].astype(np.int32)
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        self.item = np.array([n for n, _, _ in rows])
        self.offset = np.array([o for _, o, _ in rows])
        self.present = Present((self.keys >> np.uint64(32)).astype(np.uint32))

    def hits(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, offset in the item) for windows with the key of a place."""
        at = np.flatnonzero(self.present((key >> np.uint64(32)).astype(np.uint32)))
        k = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
        same = self.keys[k] == key[at]
        at, k = at[same], k[same]
        count = self.first[k + 1] - self.first[k]
        row = self.window[np.repeat(self.first[k + 1] - np.cumsum(count), count) + np.arange(count.sum())]
        return np.repeat(at, count), self.item[row], self.offset[row]


class Items:
    """A block of items and their windows."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        made = [(i, _hashes().of(split(t))) for i, t in rows]
        self.rows = [(i, w) for i, w in made if len(w)]
        self.words = [frozenset(w.tolist()) for _, w in self.rows]
        self.most = np.array([most_edits(len(w)) for _, w in self.rows], np.int64)
        by: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        lengths = set()
        for n, (_, w) in enumerate(self.rows):
            edge = cuts(len(w))
            for low, high in zip(edge, edge[1:]):
                by.setdefault(size_of(high - low), []).append((n, low, w[low:high]))
                lengths.add(high - low)
        self.windows = [Windows(size, found) for size, found in sorted(by.items())]
        self.lengths = {size: sorted(c for c in lengths if size_of(c) == size) for size in by}
        self.steps = reach(list(by)) if by else 0
        if by:
            self.pairs = Present(np.unique(np.concatenate([pairs_of(w) for _, w in self.rows])))
            self.single = np.unique([w[0] for _, w in self.rows if len(w) == 1]).astype(np.uint64)

    def starts(self, line: np.ndarray, edge: np.ndarray) -> dict[int, np.ndarray]:
        """For each size class whether a walk starts at a place."""
        flag = np.zeros(len(line) + 2 * WINDOW, bool)
        flag[: len(line) - 1] = self.pairs(pairs_of(line))
        flag[edge[1:][edge[1:] > 0] - 1] = False  # pairs across documents
        sums = np.append(np.int32(0), np.cumsum(flag, dtype=np.int32))
        out = {}
        for size, lengths in self.lengths.items():
            out[size] = np.isin(line, self.single) if size == 1 else np.zeros(len(line), bool)
            for c in lengths:
                e = most_edits(c)
                if c > 1:
                    out[size] |= sums[c + e - 1 :][: len(line)] - sums[: len(line)] >= c - 1 - 2 * e
        return out

    def candidates(self, line: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, where the item would start in the line), sorted, each once."""
        none = (np.empty(0, np.int64),) * 3
        if not len(line) or not self.windows:
            return none
        starts = self.starts(line, edge)
        every = np.flatnonzero(np.logical_or.reduce(list(starts.values())))
        found = []
        for low in range(0, len(every), CHUNK):
            place = every[low : low + CHUNK]
            # The words that walks can reach, with all others left out.
            change = np.zeros(len(line) + 1, np.int32)
            change[place] += 1
            np.subtract.at(change, np.minimum(place + self.steps, len(line)), 1)
            near = np.cumsum(change[:-1]) > 0
            words = np.append(line[near], np.zeros(self.steps, np.uint64))
            at = (np.cumsum(near, dtype=np.int32) - 1)[place]
            chosen = [np.flatnonzero(starts[w.size][place]) for w in self.windows]
            for walk in range(WALKS):
                places = walk_places(words, at, walk, self.steps)
                for w, some in zip(self.windows, chosen):
                    if len(some):
                        for m, steps in enumerate(samples(w.size, walk)):
                            k, n, offset = w.hits(key_of(words, places, some, steps, walk * KEYS + m))
                            if len(k):
                                found.append(np.stack([place[some[k]], n, offset]))
        if not found:
            return none
        at, n, offset = np.concatenate(found, axis=1)
        doc = np.searchsorted(edge, at, side="right") - 1
        start = at - offset
        width = np.int64(len(line) - start.min() + 1)
        code = np.unique((doc * len(self.rows) + n) * width + start - start.min())
        doc, n = np.divmod(code // width, len(self.rows))
        return doc, n, code % width + start.min()

    def find(self, texts: list[str | None]) -> list[list[dict]]:
        """The matches in each text."""
        words = [_hashes().of(split(t)) for t in texts]
        edge = np.cumsum([0, *map(len, words)])
        line = np.concatenate(words) if words else np.empty(0, np.uint64)
        doc, n, start = self.candidates(line, edge)
        # Candidates that differ by no more than the edits are one stretch of the text.
        new = np.append(True, (np.diff(doc) != 0) | (np.diff(n) != 0) | (np.diff(start) > self.most[n[1:]]))[: len(doc)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, i, a, b in zip(doc[first].tolist(), n[first].tolist(), start[first].tolist(), start[last].tolist()):
            item, most = self.rows[i][1], int(self.most[i])
            low, high = max(int(edge[d]), a - most), min(int(edge[d + 1]), b + len(item) + most)
            # An edit takes away one of the item's distinct words at most.
            if len(self.words[i].intersection(line[low:high].tolist())) < len(self.words[i]) - most:
                continue
            edits, at = best_match(item, line[low:high], most)
            if edits <= most:
                found = (edits, int(low - edge[d]) + at)
                best[d, i] = min(found, best.get((d, i), found))
        out: list[list[dict]] = [[] for _ in texts]
        for (d, i), (edits, at) in sorted(best.items()):
            out[d].append({"item_id": self.rows[i][0], "start": at, "edits": edits})
        return out


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of about MAX_ITEMS."""
    rows = benchmark.select("item_id", "text")
    n = -(-rows.count() // MAX_ITEMS) or 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [tuple(r) for r in part.collect()]


def annotate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(text, ...) -> row (struct of all columns of docs), matches (item_id, start in words, edits)."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(None).cast(MATCHES).alias("matches"))
    schema = T.StructType([out.schema["row"], T.StructField("matches", MATCHES)])
    for rows in blocks(benchmark):
        items = Items(rows)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), STEP):
                    b = whole.slice(at, STEP)
                    texts = b.column("row").field("text").to_pylist()
                    known = [m or [] for m in b.column("matches").to_pylist()]
                    found = [[*m, *f] for m, f in zip(known, items.find(texts))]
                    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("edits", pa.int32())]))
                    yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(found, kind)], ["row", "matches"])

        out = out.mapInArrow(run, schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    return annotate(docs, benchmark).where(F.size("matches") == 0).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and each item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = annotate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.start", "m.edits")


QUERIES = {"op5_decontamination": op5_decontamination}
ORACLES: dict[str, str] = {}
