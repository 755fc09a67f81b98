"""Reading level of documents, from 1 (simple) to 4 (expert) (problem 9).

Method: every sentence is classified by a multinomial logistic model with L2 regularisation over its words and the character n-grams of its
words; the distribution of a document's sentences over the levels is the input of a second, calibrating model that gives the level
of the document. The second model is fitted on cross-fitted sentence results, so it sees sentences as they look when they are new.

The models are fitted at query time on at most ``MAX_DOCS`` labelled documents of at most ``MAX_TRAIN_CHARS`` characters each, taken in the order of a hash of
their id (a bounded sample of labelled rows); a document's label is the median of its raters' levels, the lower of two. Everything
else covers all documents and whole texts: one pass, no shuffle, the model's weights are broadcast (fixed size, ``WORDS`` +
``GRAMS`` rows of four numbers).

Words score additively, so each worker computes a distinct word once and then adds up remembered scores.

Defined results: null, empty and blank texts give no row; texts without any letter get the level of the model's prior; fewer than two
distinct levels among the labels give that level (2 without any label) to every document; repeated documents give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsforge.session import spread

LEVELS = 4
MAX_DOCS, MAX_TRAIN_CHARS = 3000, 20_000
WORDS, GRAMS = 1 << 16, 1 << 16
L2, STEPS, FOLDS = 2e-5, 60, 3
#: With fewer labelled documents there is nothing to calibrate on: the level of the largest mean log-probability is taken.
MIN_CALIBRATION = 30
_SENTENCE = re.compile(r"(?<=[.!?…;])[\"'”’»)]*\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+")


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence in lower case, numbers as 0; sentences without a word are left out."""
    out = [[w if not w.isdigit() else "0" for w in _WORD.findall(s)] for s in _SENTENCE.split(text.lower())]
    return [s for s in out if s]


def features(word: str) -> list[int]:
    """Rows of the weight table: the word's own, then those of its n-grams of 3 to 5 characters."""
    from zlib import crc32

    rows = [crc32(word.encode()) % WORDS]
    padded = f"<{word}>"
    for n in (3, 4, 5):
        rows += [WORDS + crc32(padded[i : i + n].encode()) % GRAMS for i in range(len(padded) - n + 1)]
    return rows


def _softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class SentenceModel:
    """Weights by row of the table; a word's score is the mean over its rows, a sentence's the mean over its words."""

    def __init__(self, weights, bias):
        self.weights, self.bias, self.known, self.table = weights, bias, {}, np.zeros((0, LEVELS), np.float32)

    def scores(self, words: list[str]):
        """One row per word; distinct words are worked out once and remembered as rows of a table."""
        known = self.known
        if len(known) > 500_000:
            known.clear()
            self.table = self.table[:0]
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            rows = [features(w) for w in new]
            sizes = np.array([len(r) for r in rows])
            sums = np.add.reduceat(self.weights[np.concatenate(rows)], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
            first = len(known)
            if first + len(new) > len(self.table):
                self.table = np.concatenate([self.table[:first], np.zeros((max(4096, first, len(new)), LEVELS), np.float32)])
            self.table[first : first + len(new)] = sums
            known.update(zip(new, range(first, first + len(new))))
        return self.table[[known[w] for w in words]]

    def predict(self, sents: list[list[str]]):
        flat = self.scores([w for s in sents for w in s])
        starts = np.cumsum([0, *[len(s) for s in sents]])
        total = np.add.reduceat(flat, starts[:-1], axis=0)
        return _softmax(total / np.sqrt(np.diff(starts))[:, None] + self.bias)

    @classmethod
    def fit(cls, sents: list[list[str]], levels) -> SentenceModel:
        """Full-batch Adam; the n-gram table is worked on per distinct word, so a step costs as much as the words, not the n-grams."""
        index: dict[str, int] = {}
        flat = np.array([index.setdefault(w, len(index)) for s in sents for w in s])
        lengths = np.array([len(s) for s in sents])
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        sent_of = np.repeat(np.arange(len(sents)), lengths)
        scale = 1 / np.sqrt(lengths)
        rows = [features(w) for w in index]
        n_rows = np.array([len(r) for r in rows])
        row_flat, word_of = np.concatenate(rows), np.repeat(np.arange(len(rows)), n_rows)
        used, row_id = np.unique(row_flat, return_inverse=True)
        row_scale = 1 / np.sqrt(n_rows)
        row_starts = np.concatenate([[0], np.cumsum(n_rows)])[:-1]
        y = np.eye(LEVELS)[levels]
        counts = y.sum(0)
        # each level weighs the same, within reason
        weight = (np.minimum(len(y) / np.maximum(counts, 1) / LEVELS, 4) @ y.T) / len(y)
        w, b = np.zeros((len(used), LEVELS)), np.log(np.maximum(counts, 1) / counts.sum()) * 0
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
        for t in range(1, STEPS + 1):
            word_score = np.add.reduceat(w[row_id], row_starts, axis=0) * row_scale[:, None]
            z = np.add.reduceat(word_score[flat], starts, axis=0) * scale[:, None] + b
            d = (_softmax(z) - y) * weight[:, None]
            ds = (d * scale[:, None])[sent_of]
            gs = np.stack([np.bincount(flat, ds[:, k], len(index)) for k in range(LEVELS)], 1) * row_scale[:, None]
            gw = np.stack([np.bincount(row_id, gs[word_of, k], len(used)) for k in range(LEVELS)], 1) + L2 * w
            for x, g, m, v in ((w, gw, state[0], state[1]), (b, d.sum(0), state[2], state[3])):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                x -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        full = np.zeros((WORDS + GRAMS, LEVELS), np.float32)
        full[used] = w
        return cls(full, b.astype(np.float32))


def shares(probs, lengths):
    """What the calibrating model sees of a document: mean and log-mean of its sentences' distributions, and the shares of their first choices."""
    weight = lengths / lengths.sum()
    mean = weight @ probs
    log_mean = weight @ np.log(np.maximum(probs, 1e-4))
    first = weight @ np.eye(LEVELS)[probs.argmax(1)]
    return np.concatenate([mean, log_mean - log_mean.mean(), first])


def _start(width: int):
    w = np.zeros((width + 1, LEVELS))
    w[LEVELS : 2 * LEVELS] = np.eye(LEVELS)
    return w


def _fit_calibration(x, y):
    w = _start(x.shape[1])  # begins as: the level of largest log-mean
    x1 = np.hstack([x, np.ones((len(x), 1))])
    target = np.eye(LEVELS)[y]
    m, v = np.zeros_like(w), np.zeros_like(w)
    start = w.copy()
    for t in range(1, 301):
        g = x1.T @ (_softmax(x1 @ w) - target) / len(x) + 3e-3 * (w - start)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


class ReadingModel:
    def __init__(self, sentence: SentenceModel | None, calibration, constant: int | None):
        self.sentence, self.calibration, self.constant = sentence, calibration, constant

    @classmethod
    def fit(cls, texts: list[str], levels: list[int]) -> ReadingModel:
        docs = [sentences(t) for t in texts]
        kept = [(d, lv - 1) for d, lv in zip(docs, levels) if d]
        if len({y for _, y in kept}) < 2:
            return cls(None, None, kept[0][1] + 1 if kept else 2)
        docs, y = [d for d, _ in kept], np.array([y for _, y in kept])
        x = np.zeros((len(docs), 3 * LEVELS))
        enough = len(docs) >= MIN_CALIBRATION
        folds = np.arange(len(docs)) % FOLDS
        for k in range(FOLDS if enough else 0):
            train = [i for i in range(len(docs)) if folds[i] != k]
            model = SentenceModel.fit([s for i in train for s in docs[i]], np.array([y[i] for i in train for _ in docs[i]]))
            for i in np.flatnonzero(folds == k):
                x[i] = shares(model.predict(docs[i]), np.array([len(s) for s in docs[i]]))
        return cls(SentenceModel.fit([s for d in docs for s in d], np.array([lv for lv, d in zip(y, docs) for _ in d])), _fit_calibration(x, y) if enough else _start(3 * LEVELS), None)

    def predict(self, texts: list[str]) -> list[int]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        docs = [sentences(t) for t in texts]
        flat = [s for d in docs for s in d]
        probs = self.sentence.predict(flat) if flat else None
        lengths = np.array([len(s) for s in flat])
        x, at = np.zeros((len(docs), 3 * LEVELS + 1)), 0
        x[:, -1] = 1
        for i, d in enumerate(docs):
            if d:
                x[i, :-1] = shares(probs[at : at + len(d)], lengths[at : at + len(d)])
            at += len(d)
        return (1 + (x @ self.calibration).argmax(1)).tolist()


def fit_levels(docs: DataFrame, labels: DataFrame, doc_col: str = "doc_id", text_col: str = "text", level_col: str = "level_no") -> ReadingModel:
    """Fits both models on the bounded sample of labelled documents."""
    by_doc = (
        labels.where(F.col(f"`{level_col}`").between(1, LEVELS) & F.col(f"`{doc_col}`").isNotNull())
        .groupBy(F.col(f"`{doc_col}`").alias("_d"))
        .agg(F.array_sort(F.collect_list(F.col(f"`{level_col}`").cast("int"))).alias("_l"))
        .select("_d", F.element_at("_l", F.expr("cast((size(_l) + 1) div 2 as int)")).alias("_level"))
    )
    # the sample is drawn from the labels alone: about twice as many as needed pass the hash, so no task sends more than its share of numbers to the driver
    share = max(1, by_doc.count() // (2 * MAX_DOCS))
    drawn = by_doc.where(F.pmod(F.xxhash64("_d"), F.lit(share)) == 0).orderBy(F.xxhash64("_d", F.lit(1))).limit(MAX_DOCS)
    texts = docs.select(F.col(f"`{doc_col}`").alias("_d"), F.col(f"`{text_col}`").cast("string").alias("_t")).where(f"_t is not null and length(_t) <= {MAX_TRAIN_CHARS}")
    sample = texts.join(F.broadcast(drawn), "_d").dropDuplicates(["_d"]).orderBy("_d").collect()
    return ReadingModel.fit([r._t for r in sample], [r._level for r in sample])


_MODELS: dict[str, ReadingModel] = {}


def reading_levels(docs: DataFrame, labels: DataFrame, doc_col: str = "doc_id", text_col: str = "text", level_col: str = "level_no", out_col: str = "level_no") -> DataFrame:
    """(doc_id, level_no) of every document with non-blank text."""
    import uuid

    model = docs.sparkSession.sparkContext.broadcast(fit_levels(docs, labels, doc_col, text_col, level_col))
    key = uuid.uuid4().hex
    kind = docs.schema[doc_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if key not in _MODELS:  # the memory of words lives as long as the worker
            _MODELS.clear()
            _MODELS[key] = model.value
        own = _MODELS[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.predict(part.column(1).to_pylist()), pa.int32())], names=["_d", "_level"])

    texts = docs.select(F.col(f"`{doc_col}`").alias("_d"), F.col(f"`{text_col}`").cast("string").alias("_t")).where(F.col("_t").rlike(r"(?U)\S"))
    return spread(texts).mapInArrow(run, f"_d {kind}, _level int").toDF(doc_col, out_col)
