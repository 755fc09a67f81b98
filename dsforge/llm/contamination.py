"""Evaluation passages inside training documents (problem 8).

Method: winnowing. Words are compared in lower case and without punctuation. Of every ``WINDOW`` neighbouring hashes of ``K`` words the
smallest is kept as fingerprint, on either side; equal windows keep equal fingerprints, so every exactly shared span of
``K + WINDOW - 1`` words shares one. A stretch of 20 words or more with at most one fault in eight holds such a span of six words: n words with f <= n / 8 faults fall into f + 1 runs of (n - f) / (f + 1) words on average. Fingerprints of the corpus are joined
to those of the test items, and every hit is extended: exact runs around the hit are chained, gaps cost the larger of their two
lengths, and a document counts if a chain covers ``MIN_WORDS`` consecutive words of the passage with at most one fault in ``ONE_IN``.
Nothing else bounds the extension: a gap and the way a passage may drift from the hit's diagonal are at most the faults that the whole passage may have, and every earlier run within that gap is tried.

Scale: the test side is a stated query set and is joined in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters, one after the other; each
is broadcast, and released when its pairs are written, so no more than one block is held at a time. The corpus is scanned once per block, is never shuffled and never leaves its partition. Nothing of the
corpus but the found pairs is produced. Documents of any length are read whole, in batches of bounded text.

Defined results: null, empty and blank documents and passages match nothing; passages of fewer than ``MIN_WORDS`` words match nothing;
repeated documents and repeated items each give their own rows, ties likewise; one row per (document, item).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from dsforge.session import spread, written

K, WINDOW, MIN_WORDS, ONE_IN = 5, 2, 20, 8
#: Bounds of one broadcast block of test items.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 32 << 20
#: A hit is looked at if so many of the words around it, within so many places, agree; a stretch of the least length may lack 2, one nearly twice as long and next to its faults 4 and more.
NEED, REACH = 15, 4
PAD = 64
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = str.maketrans("", "", "­​‌‍﻿")


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_HIDDEN).lower())


def _hashes(ids, k: int):
    """Hashes of all k-grams of an array of word hashes, as uint64."""
    import numpy as np

    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(ids) - k + 1), np.uint64)
        for j in range(k):
            h = (h ^ ids[j : len(ids) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def winnow(hashes, window: int):
    """Positions kept: the right-most smallest hash of every window of neighbouring hashes."""
    import numpy as np

    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))] if n else [], np.int64)
    best = np.arange(n - window + 1)
    low = hashes[: n - window + 1].copy()
    for j in range(1, window):
        other = hashes[j : n - window + 1 + j]
        take = other <= low
        low = np.where(take, other, low)
        best = np.where(take, np.arange(j, n - window + 1 + j), best)
    return np.unique(best)


class _Ids(dict):
    """Text between white space to the 64-bit hashes of its words, the same in every process."""

    def __missing__(self, part: str) -> tuple[int, ...]:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        value = tuple(xxhash.xxh64_intdigest(w) for w in words(part))
        if len(part) <= 64:
            self[part] = value
        return value

    def of(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, text.split()))) if text else []


class Index:
    """Fingerprints of a block of passages and the extension of hits."""

    def __init__(self, passages: list[str]):
        import numpy as np

        self.ids = _Ids()
        self.passages = [self.ids.of(p) for p in passages]
        prints, items, places = [], [], []
        for i, p in enumerate(self.passages):
            if len(p) < MIN_WORDS:
                continue
            h = _hashes(np.array(p, np.uint64), K)
            at = winnow(h, WINDOW)
            prints.append(h[at]), items.append(np.full(len(at), i)), places.append(at)
        self.prints = np.concatenate(prints) if prints else np.array([], np.uint64)
        order = np.argsort(self.prints, kind="stable")
        self.prints = self.prints[order]
        self.items = np.concatenate(items)[order] if items else np.array([], np.int64)
        self.places = np.concatenate(places)[order] if places else np.array([], np.int64)
        self.spots: dict[int, dict[int, list[int]]] = {}
        # all passages in one array, far enough apart that a window never reaches the next
        self.begin = np.cumsum([PAD, *[len(p) + PAD for p in self.passages]])
        self.flat = np.ones(int(self.begin[-1]), np.uint64)
        for p, x in zip(self.passages, self.begin.tolist()):
            self.flat[x : x + len(p)] = p

    def hits(self, docs: list[list[int]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(document, item) to the hits (place in the document, place in the passage)."""
        import numpy as np

        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if not len(self.prints):
            return found
        starts = np.cumsum([0, *map(len, docs)])
        flat = np.fromiter(chain.from_iterable(docs), np.uint64, int(starts[-1]))
        h = _hashes(flat, K)
        if not len(h):
            return found
        # a hash across two documents can't match but by chance, and the extension looks at one document only
        at = winnow(h, WINDOW)
        kept = h[at]
        lo = np.searchsorted(self.prints, kept, "left")
        known = (lo < len(self.prints)) & (self.prints[np.minimum(lo, len(self.prints) - 1)] == kept)
        at, kept, lo = at[known], kept[known], lo[known]
        hi = np.searchsorted(self.prints, kept, "right")
        n = hi - lo
        hit = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        at, item, place = np.repeat(at, n), self.items[hit], self.places[hit]
        good = self._promising(flat, at, item, place)
        at, item, place = at[good], item[good], place[good]
        doc = np.searchsorted(starts, at, "right") - 1
        for d, i, p, q in zip(doc.tolist(), item.tolist(), (at - starts[doc]).tolist(), place.tolist()):
            found.setdefault((d, i), []).append((p, q))
        return found

    def covered(self, doc: list[int], item: int, hits: list[tuple[int, int]]) -> tuple[int, int]:
        """(words, faults) of the longest stretch of the passage that ``doc`` holds with few enough faults, else (0, 0)."""
        passage = self.passages[item]
        if item not in self.spots:
            spots: dict[int, list[int]] = {}
            for j, w in enumerate(passage):
                spots.setdefault(w, []).append(j)
            self.spots[item] = spots
        spots = self.spots[item]
        best = (0, 0)
        done: list[int] = []
        for place, at in sorted(hits):
            diagonal = place - at
            if any(abs(diagonal - d) <= 2 for d in done):
                continue
            done.append(diagonal)
            drift = max(REACH, len(passage) // ONE_IN)  # as many faults as the passage may have
            begin, end = max(0, diagonal - drift), min(len(doc), diagonal + len(passage) + drift)
            runs: dict[int, list[list[int]]] = {}  # by diagonal: [first in passage, after last]
            for i in range(begin, end):
                for j in spots.get(doc[i], ()):
                    d = i - j
                    if abs(d - diagonal) <= drift:
                        own = runs.setdefault(d, [])
                        if own and own[-1][1] == j:
                            own[-1][1] = j + 1
                        else:
                            own.append([j, j + 1])
            chain = self._chain(sorted((a, b, d) for d, own in runs.items() for a, b in own), drift)
            best = max(best, self._stretch(chain), key=lambda x: (x[0], -x[1]))
        return best

    def _promising(self, flat, at, items, places):
        """Of each hit, whether of ``MIN_WORDS`` and a few words around it ``NEED`` agree near the hit's diagonal."""
        import numpy as np

        span, need, reach = MIN_WORDS + MIN_WORDS // ONE_IN, NEED, REACH
        offsets = np.arange(-span, span + K)
        own = np.concatenate([np.zeros(PAD, np.uint64), flat, np.zeros(PAD, np.uint64)])
        out = np.zeros(len(at), bool)
        for x in range(0, len(at), 20_000):
            of_doc = own[(at[x : x + 20_000] + PAD)[:, None] + offsets]
            spot = (self.begin[items[x : x + 20_000]] + places[x : x + 20_000])[:, None] + offsets
            same = np.zeros(of_doc.shape, bool)
            for shift in range(-reach, reach + 1):
                same |= of_doc == self.flat[spot + shift]
            sums = np.cumsum(same, 1, dtype=np.int32)
            out[x : x + 20_000] = np.maximum(sums[:, span - 1], (sums[:, span:] - sums[:, :-span]).max(1)) >= need
        return out

    @staticmethod
    def _chain(runs: list[tuple[int, int, int]], most: int) -> list[tuple[int, int, int]]:
        """The best chain of runs (first, after last, faults before it), by words matched less faults; ``most`` faults in one gap at most."""
        longest = max((b - a for a, b, _ in runs), default=0)
        score: list[int] = []
        back: list[tuple[int, int, int]] = []  # previous run, words cut at the start, faults
        for x, (a, b, d) in enumerate(runs):
            top, link = b - a, (-1, 0, 0)
            for y in range(x - 1, -1, -1):
                c, e, f = runs[y]
                if a - c > most + longest:
                    break  # those before begin too early to reach
                # the next run begins after the other's end in the passage and in the document
                cut = max(0, e - a, e + f - (a + d))
                if cut >= b - a:
                    continue
                faults = max(a + cut - e, a + cut + d - (e + f))
                if faults <= most and (s := score[y] + b - a - cut - faults) > top:
                    top, link = s, (y, cut, faults)
            score.append(top)
            back.append(link)
        if not runs:
            return []
        x, out = max(range(len(runs)), key=score.__getitem__), []
        while x >= 0:
            y, cut, faults = back[x]
            out.append((runs[x][0] + cut, runs[x][1], faults))
            x = y
        return out[::-1]

    @staticmethod
    def _stretch(chain: list[tuple[int, int, int]]) -> tuple[int, int]:
        best = (0, 0)
        for i in range(len(chain)):
            faults = 0
            for j in range(i, len(chain)):
                faults += chain[j][2] if j > i else 0
                n = chain[j][1] - chain[i][0]
                if n > best[0] and faults * ONE_IN <= n:
                    best = (n, faults)
        return best


_INDEXES: dict[int, Index] = {}


def _index(shared) -> Index:
    key = hash(tuple(shared.value))
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(shared.value)
    return _INDEXES[key]


def _blocks(items: DataFrame, item_col: str, passage_col: str) -> Iterator[list[tuple]]:
    """The test items in blocks of bounded size; they pass through the driver one block at a time."""
    block, chars = [], 0
    for row in items.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{passage_col}`").cast("string").alias("p")).where("p is not null").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(row.p) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((row.i, row.p))
        chars += len(row.p)
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage") -> DataFrame:
    """(doc_id, item_id, n_words, n_faults) of every document that holds a long enough part of an item's passage."""
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema[doc_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"_d {doc_kind}, _i {item_kind}, n_words int, n_faults int"
    as_arrow = to_arrow_schema(StructType.fromDDL(schema))
    texts = spread(docs.select(F.col(f"`{doc_col}`").alias("_d"), F.col(f"`{text_col}`").cast("string").alias("_t")).where("_t is not null"))
    out, blocks = None, _blocks(items, item_col, passage_col)
    block = next(blocks, None)
    while block is not None:
        shared = spark.sparkContext.broadcast([p for _, p in block])
        numbers = spark.sparkContext.broadcast([i for i, _ in block])

        def run(batches: Iterator, shared=shared, numbers=numbers) -> Iterator:
            import pyarrow as pa

            index = _index(shared)
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    docs = [index.ids.of(t) for t in part.column(1).to_pylist()]
                    rows = []
                    for (d, i), hits in index.hits(docs).items():
                        n, faults = index.covered(docs[d], i, hits)
                        if n >= MIN_WORDS:
                            rows.append((part.column(0)[d].as_py(), numbers.value[i], n, faults))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), as_arrow)], schema=as_arrow)

        found = texts.mapInArrow(run, schema)
        block = next(blocks, None)
        if block is not None or out is not None:
            found = written(found)
            shared.destroy(), numbers.destroy()
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.select(F.col("_d").alias(doc_col), F.col("_i").alias(item_col), "n_words", "n_faults")
