"""Encoding of a corpus with a byte-level BPE vocabulary (problem 7).

Method: a segment tree over the ranks of adjacent pairs. Every leaf holds the merge rank of one adjacent pair, every inner
node the smaller of its two children under the order (rank, position), so the root is always the leftmost pair of lowest
rank. A merge changes three leaves, each in logarithmic time, until the root holds no mergeable pair: O(n log n) for a piece
of n bytes, also for pieces of a million letters without a space.

Scale: one pass over the texts, no shuffle. The vocabulary is read on the driver, its size is checked against
``MAX_VOCAB_BYTES`` and it is broadcast once. Each Python worker keeps the ids of the pieces it has met, up to
``CACHE_ENTRIES``, so the tree runs once per distinct piece and worker, not once per occurrence.

Defined results: null, empty and missing text give an empty list; special-token strings inside a text are ordinary text; every other
text gives the ids of its UTF-8 bytes. Blank texts are encoded as they are. Rows are never dropped; repeated documents give repeated rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsforge.session import spread

VOCAB_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary file larger than this is refused: it is broadcast to every executor.
MAX_VOCAB_BYTES = 64 << 20
#: Distinct pieces and words remembered by one worker; beyond that the memory is emptied, results stay the same.
CACHE_ENTRIES = 400_000
#: The published pre-tokenisation pattern of this vocabulary family.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space that is neither the first nor the last character of a run of white space: splitting before it would change the pieces.
_INNER_SPACE = re.compile(r"\s (?=\s|$)")

NO_RANK = 1 << 40


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 token and rank."""
    return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in data.splitlines() if line)}


class SegmentTreeBpe:
    """Byte-pair merges of one piece, driven by a segment tree over adjacent pair ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)

    def encode(self, piece: bytes) -> list[int]:
        ranks, longest = self.ranks, self.longest
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n < 2:
            return [ranks[piece]] if n else []
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        leaves = 1
        while leaves < n - 1:
            leaves *= 2
        shift = n.bit_length()
        # a node is rank << shift | position: the smaller number is the lower rank, and the more left of equals
        empty = NO_RANK << shift
        tree = [empty] * (2 * leaves)
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                tree[leaves + i] = r << shift | i
        for node in range(leaves - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def put(i: int, value: int) -> None:
            node = leaves + i
            tree[node] = value
            node //= 2
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                best = a if a < b else b
                if tree[node] == best:
                    return
                tree[node] = best
                node //= 2

        def rank_at(i: int) -> int:
            j = after[i]
            if j >= n or len(parts[i]) + len(parts[j]) > longest:
                return empty
            r = ranks.get(parts[i] + parts[j])
            return empty if r is None else r << shift | i

        mask = (1 << shift) - 1
        while tree[1] < empty:
            i = tree[1] & mask
            j = after[i]
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if j < n - 1:
                put(j, empty)
            if i < n - 1:
                put(i, rank_at(i))
            if before[i] >= 0:
                put(before[i], rank_at(before[i]))
        return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Texts to ids, with a memory of the words met."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.bpe = SegmentTreeBpe(ranks)
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, tuple[int, ...]] = {}

    def _slow(self, text: str) -> list[int]:
        encode = self.bpe.encode
        return [i for p in self.pieces.findall(text) for i in encode(p.encode("utf-8", "surrogatepass"))]

    def words(self, text: str) -> list[tuple[int, ...]]:
        """The ids of ``text``, as one tuple for each word with the space before it."""
        if _INNER_SPACE.search(text):
            return [tuple(self._slow(text))]
        known = self.known
        first, *rest = text.split(" ")
        out = [known.get(w) for w in [first, *[" " + w for w in rest]]]
        if None in out:
            if len(known) > CACHE_ENTRIES:
                known.clear()
            for k, w in enumerate([first, *[" " + w for w in rest]]):
                if out[k] is None:
                    ids = known.get(w)
                    if ids is None:
                        ids = tuple(self._slow(w))
                        if len(w) <= 64:
                            known[w] = ids
                    out[k] = ids
        return out

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.words(text))) if text else []


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocab) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    key = hash(vocab.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(vocab.value))
    return _ENCODERS[key]


def encode_corpus(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocab_path: str = VOCAB_PATH, ids_col: str = "ids") -> DataFrame:
    """(id, ids) of every row of ``df``; see the module's text for nulls, empty texts and repeated rows."""
    with open(vocab_path, "rb") as f:
        data = f.read(MAX_VOCAB_BYTES + 1)
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"the vocabulary is larger than {MAX_VOCAB_BYTES} bytes and can't be broadcast")
    vocab = df.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = _encoder(vocab)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lengths, flat = [0], []
                for text in part.column(1).to_pylist():
                    ids = encoder.words(text) if text else ()
                    flat.extend(chain.from_iterable(ids))
                    lengths.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(np.array(lengths, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["_id", "_ids"])

    kind = df.schema[id_col].dataType.simpleString()
    small = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return spread(small).mapInArrow(run, f"_id {kind}, _ids array<int>").toDF(id_col, ids_col)
