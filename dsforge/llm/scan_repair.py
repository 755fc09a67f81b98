"""Text of scanned pages repaired to readable paragraphs (problem 6).

Method: an averaged perceptron edits characters. At every position of a word it chooses between keeping the character and replacing it,
deleting it or inserting one beside it, and at a hyphenated line end between joining with and without the hyphen; an edit counts only if it scores above keeping and
the result is a word of the corpus at least ``RATIO`` times as frequent, the least that the training has seen; how much more frequent is a feature. Furniture (running
headers, footers, page numbers) goes by page-position features: form of a page number, place at a page's edge, likeness to the document's title or its source's owner, repetition at page tops.

Training needs no labelled pairs: words are counted over the whole corpus; a rare word that one edit (a replaced, lost or added letter) turns into a word at least ``RATIO`` times as
frequent is an aligned pair; frequent words, taken as if they were rare, teach keep. A word that no single edit repairs is edited at several places, each by a score above keeping. The fit takes at most
``MAX_PAIRS`` words drawn by hash and looks for pairs among the ``MAX_WORDS`` most frequent words (a bounded sample); nothing else is bounded: counts cover all texts and every word is decided.

Scale: each distinct word is decided once, not in each place it stands. Counting adds up per task before one grouping by word. Words are scored against all words they may become, which are broadcast in
blocks of ``MAX_WORDS``, and the best of all blocks is taken, so the lexicon has no cut; pairs at line ends look their counts up in joins. A last pass over the texts gives the line of every drop, pair and word that is not
among the ``KNOWN`` most frequent right ones (a bounded list, which only spares the join work), and a join on the word gives the faults. Texts are read twice and are not shuffled; ``repair`` joins each text once to its own faults.

Defined results: null, empty and blank texts give no row; a text without any fault gives no row in ``find_noise`` and itself in ``repair``; the last line of a text is never joined; of
several possible words the one of fewer edits, then of higher score, then the more frequent, then the first in order is taken; equal texts each give their own rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsforge.session import spread, written

MAX_WORDS, MIN_COUNT, MAX_PAIRS, RATIO, EPOCHS, MARGIN, KNOWN = 300_000, 3, 20_000, 20, 4, 30.0, 200_000
_MARKS = "-\xad¬"
_END = re.compile(rf"(\S*\w)[{_MARKS}]\s*$")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SPLIT = re.compile(r"(['’\-/.,])")
#: The same marks between the parts of a word, for the JVM.
_BETWEEN = r"['’\-/.,]"
_NUMBER_LINE = re.compile(r"^(?:\W*(?:page|p|pg|seite)\W*)?\W*[\dlIOoSBZ]{1,4}\W*(?:(?:of|sur|de|von|/)\W*[\dlIOoSBZ]{1,4})?\W*$", re.I)
_ROMAN = re.compile(r"^\W*[ivxlcIVXLC1]{1,6}\W*$")
_PAGED = re.compile(r"^(.*?\S)(?:\s{2,}|\s*\|\s*)[\dlIOoSB]{1,4}\s*$|^\s*[\dlIOoSB]{1,4}(?:\s{2,}|\s*\|\s*)(\S.*)$")
#: Letters that stand for digits in numbers.
_DIGIT = str.maketrans("lIioOSsBZz|", "11100558221")


def _core(token: str) -> str:
    """Lower case, without punctuation around it."""
    return _EDGE.sub("", token).lower()


def _parts(core: str) -> list[str]:
    """The word's parts with the hyphens, apostrophes and marks between them."""
    return _SPLIT.split(core)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts in column ``_t``; each task adds up before anything is shuffled."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def flush(tokens: Counter):
            out: Counter = Counter()
            for t, n in tokens.items():
                if t[-1] not in _MARKS:
                    core = _core(t)
                    pieces = _parts(core)
                    if len(pieces) > 1 and not core.isdigit():
                        out[core] += n
                    for p in pieces[::2]:
                        if p and not p.isdigit():
                            out[p] += n
            return pa.RecordBatch.from_arrays([pa.array(list(out)), pa.array(list(out.values()), pa.int64())], names=["word", "n"])

        tokens: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                tokens.update(t.split())
                if len(tokens) > 300_000:
                    yield flush(tokens)
                    tokens.clear()
        yield flush(tokens)

    return texts.select("_t").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _edits(word: str, ops: dict[str, list[str]], start: int = 0) -> Iterator[tuple[int, str, str, str]]:
    """(place, seen, meant, result) of every edit of ``ops`` that applies to the word from a place on; the empty text seen stands for an insertion."""
    for i in range(start, len(word) + 1):
        for k in (0, 1, 2):
            seen = word[i : i + k]
            if len(seen) == k:
                for meant in ops.get(seen, ()):
                    yield i, seen, meant, word[:i] + meant + word[i + k :]


def one_edit_pairs(word: str, lexicon: dict[str, int], letters: list[str]) -> list[tuple[int, str, str, str]]:
    """Edits of one or two neighbouring characters, with a lost or an added letter, that lead into the lexicon."""
    out = []
    for i in range(len(word) + 1):
        for c in letters:
            if word[:i] + c + word[i:] in lexicon:
                out.append((i, "", c, word[:i] + c + word[i:]))
        if i < len(word) and word[:i] + word[i + 1 :] in lexicon:
            out.append((i, word[i], "", word[:i] + word[i + 1 :]))
    for i in range(len(word)):
        head = word[:i]
        for k in (1, 2):
            if i + k > len(word):
                continue
            tail = word[i + k :]
            for c in letters:
                if c != word[i : i + k] and head + c + tail in lexicon:
                    out.append((i, word[i : i + k], c, head + c + tail))
            if k == 1:
                for c in _PAIRS_OF_TWO:
                    if head + c + tail in lexicon:
                        out.append((i, word[i], c, head + c + tail))
    return out


#: Two letters that are seen as one; the perceptron learns which of them matter.
_PAIRS_OF_TWO = ["rn", "in", "ri", "cl", "li", "ii", "nn", "vv", "ni", "ci", "fi", "il", "ti", "rr"]


def _times(m: int, n: int) -> int:
    """How many times as frequent, as a power of two."""
    return min(12, (m // max(n, 1)).bit_length())


class Editor:
    """Averaged perceptron over character edits; ``lexicon`` are the words the fit may use."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.weights: dict[str, float] = {}
        self.ops: dict[str, list[str]] = {}
        self.join_weights: dict[str, float] = {}
        self.known: dict[tuple, float] = {}

    @staticmethod
    def features(word: str, i: int, seen: str, meant: str) -> list[str]:
        left, right = word[i - 1 : i] or "^", word[i + len(seen) : i + len(seen) + 1] or "$"
        op = f"{seen}>{meant}"
        return ["bias", op, f"{left}|{op}", f"{op}|{right}", f"L{len(seen)}{len(meant)}", f"n{min(len(word), 8)}", "digit" if seen.isdigit() else "letter"]

    @staticmethod
    def ratio_features(seen: str, meant: str, times: int) -> list[str]:
        return [f"r{times}", f"r{times // 3}|{seen}>{meant}"]

    def score(self, word: str, i: int, seen: str, meant: str, times: int) -> float:
        """An edit's score; keeping scores 0."""
        key = (word[i - 1 : i], seen, meant, word[i + len(seen) : i + len(seen) + 1], min(len(word), 8), times)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            w = self.weights
            got = self.known[key] = sum(w.get(f, 0.0) for f in self.features(word, i, seen, meant) + self.ratio_features(seen, meant, times))
        return got

    def fit(self, rare: list[tuple[str, int]], epochs: int = EPOCHS) -> Editor:
        """Learns from rare words one edit away from words that are far more frequent; frequent words teach when to keep."""
        letters = sorted({c for w in list(self.lexicon)[:5000] for c in w if c.isalpha()})
        pairs = []
        seen_ops: Counter = Counter()
        known = {w for w, _ in rare}  # misread words that recur are rare only beside the word meant
        often = [(w, n) for w, n in self.lexicon.items() if w not in known]
        for word, n in rare + often[:: 1 + len(often) // MAX_PAIRS]:
            if len(word) < 4 or not any(c.isalpha() for c in word):
                continue
            hits = [h for h in one_edit_pairs(word, self.lexicon, letters) if self.lexicon[h[3]] >= RATIO * n]
            if hits and len({h[3] for h in hits}) == 1:
                pairs.append((word, n, hits[0]))
                seen_ops[hits[0][1:3]] += word in known  # true words must not make operations
        floor = max(2, sum(seen_ops.values()) // 2000)
        sure = sorted((w for w in self.lexicon if len(w) >= 2 and self.lexicon[w] >= RATIO), key=lambda w: (-self.lexicon[w], w))[:MAX_PAIRS]
        # an added letter that parts frequent words about as often as rare ones is a matter of grammar
        alone: dict[str, list[str]] = {}
        for seen, meant in seen_ops:
            if not meant:
                alone.setdefault(seen, []).append(meant)
        true = Counter(op for w in sure for op in {e[1:3] for e in _edits(w, alone) if e[3] in self.lexicon})
        for (seen, meant), n in seen_ops.items():
            if n >= floor and (meant or n * len(sure) >= 2 * true[seen, meant] * len(rare)):
                self.ops.setdefault(seen, []).append(meant)
        pairs = [p for p in pairs if p[2][2] in self.ops.get(p[2][1], ())]
        # frequent words that no edit turns into a more frequent one are right: were they as rare as a misread word, the edits into other words would be wrong.
        # They teach keep, in the share they would have among as many rare words
        order = np.random.RandomState(7)
        low = [n for _, n, _ in pairs] or [1]
        edits = lambda w: [e for e in _edits(w, self.ops) if e[3] != w and self.lexicon.get(e[3], 0) >= RATIO]
        items = []
        for word, n, gold in pairs:
            held = [(*e, _times(self.lexicon[e[3]], n)) for e in edits(word)]
            items.append((word, held, (*gold, _times(self.lexicon[gold[3]], n))))
        for word in sure:
            held = edits(word)
            if held and all(self.lexicon[e[3]] <= self.lexicon[word] for e in held):
                for _ in range(max(1, round(len(rare) / max(1, len(sure))))):
                    n = low[order.randint(len(low))]
                    items.append((word, [(*e, _times(self.lexicon[e[3]], n)) for e in held if self.lexicon[e[3]] >= RATIO * n], None))
        weights: dict[str, float] = {}
        sums: dict[str, float] = {}
        step = 0

        def told(word: str, e: tuple) -> list[str]:
            return self.features(word, *e[:3]) + self.ratio_features(e[1], e[2], e[4])

        def update(features: list[str], by: float) -> None:
            for f in features:
                weights[f] = weights.get(f, 0.0) + by
                sums[f] = sums.get(f, 0.0) + step * by

        for _ in range(epochs):
            for x in order.permutation(len(items)):
                word, held, gold = items[x]
                step += 1
                # keeping every character scores 0; a margin of several updates both ways lets the majority win where words contradict each other
                best, top = None, MARGIN if gold else -MARGIN
                for edit in held:
                    s = sum(weights.get(f, 0.0) for f in told(word, edit))
                    if s > top:
                        best, top = edit, s
                # edits at several places may give the same word, as in doubled letters
                if (best and best[3]) != (gold and gold[3]):
                    if best:
                        update(told(word, best), -1.0)
                    if gold:
                        update(told(word, gold), 1.0)
        self.weights = {f: w - sums[f] / max(1, step) for f, w in weights.items()}
        return self

    def decide(self, word: str, n: int, targets: dict[str, int]) -> tuple[int, float, int, str] | None:
        """(edits, -score, -count, word meant) for a part of a word that occurs ``n`` times, or None to keep it; the least is the best of several blocks of ``targets``."""
        if not word or word.isdigit():
            return None
        digits = sum(c.isdigit() for c in word)
        if digits * 2 > len(word) or (digits and len(word) <= 2):
            fixed = word.translate(_DIGIT)
            return (0, 0.0, 0, fixed) if fixed != word and fixed.isdigit() else None
        if len(word) <= 2 and not digits and n >= MIN_COUNT:
            return None
        least = max(RATIO * n, 2 * MIN_COUNT)
        options = []
        for i, seen, meant, result in _edits(word, self.ops):
            m = targets.get(result, 0)
            if m >= least and (score := self.score(word, i, seen, meant, _times(m, n))) > 0:
                options.append((1, -score - 0.5 * np.log(m), -m, result))
        if not options and n < MIN_COUNT:
            options = self._several(word, n, least, targets)
        if not options and digits:  # several digits for letters in one word
            result = word.replace("0", "o").replace("1", "l").replace("5", "s")
            if targets.get(result, 0) >= 2 * MIN_COUNT:
                return (len(word), 0.0, -targets[result], result)
        return min(options) if options else None

    def _several(self, word: str, n: int, least: int, targets: dict[str, int]) -> list[tuple]:
        """Words that several edits lead to, at later and later places, each of which beats keeping; one edit for three characters at most, the fewest that do."""
        reached = {(word, 0): 0.0}
        times = _times(least, n)  # how frequent the last word is shows only at the end
        for k in range(len(word) // 3):
            after: dict[tuple[str, int], float] = {}
            for (now, start), total in reached.items():
                for i, seen, meant, result in _edits(now, self.ops, start):
                    if (score := self.score(now, i, seen, meant, times)) > 0:
                        at = (result, i + max(1, len(meant)))
                        after[at] = max(after.get(at, 0.0), total + score)
            reached = after
            options = [(k + 1, -score - 0.5 * np.log(m), -m, result) for (result, _), score in reached.items() if (m := targets.get(result, 0)) >= least]
            if k and options:
                return options
        return []

    @staticmethod
    def join_features(left: str, right: str, mark: str, counts: tuple[int, int, int, int]) -> list[str]:
        """``counts``: how often the corpus has the whole word, the hyphenated one, and the two halves as words."""
        solid, split, a, b = (n.bit_length() for n in counts)
        return [
            "join", f"mark{mark}", f"solid{solid}", f"split{split}", f"which{(solid > split) - (solid < split)}", f"left{min(a, 6)}", f"right{min(b, 6)}", f"halves{min(a, b, 6)}|{bool(solid)}{bool(split)}",
            f"short{min(len(left), len(right), 4)}", "digit" if left[-1:].isdigit() or right[:1].isdigit() else "letter",
        ]

    def fit_joins(self, epochs: int = EPOCHS, most: int = 5000) -> Editor:
        """Learns when a broken word keeps its hyphen from the corpus's own words, broken at random; some are hidden, so that halves speak for themselves."""
        rnd = np.random.RandomState(11)
        words = sorted(self.lexicon, key=lambda w: (-self.lexicon[w], w))
        solid = [w for w in words if w.isalpha() and len(w) >= 6][:most]
        split = [w for w in words if w.count("-") == 1 and len(w) >= 5][:most]
        cases = []
        for w in solid:
            k = rnd.randint(2, len(w) - 1)
            cases.append((w[:k], w[k:], 1))
        for w in split * max(1, min(20, len(solid) // max(1, 4 * len(split)))):
            cases.append((*w.split("-"), -1))
        n = self.lexicon.get
        weights: dict[str, float] = {}
        sums: dict[str, float] = {}
        step = 0
        for _ in range(epochs):
            for x in rnd.permutation(len(cases)):
                left, right, want = cases[x]
                step += 1
                counts = (n(left + right, 0), n(f"{left}-{right}", 0), n(left, 0), n(right, 0))
                if rnd.rand() < 0.2 and counts[2] and counts[3] and want < 0 or rnd.rand() < 0.2 and want > 0:
                    counts = (0, 0, *counts[2:])
                features = self.join_features(left, right, _MARKS[0] if want < 0 else _MARKS[rnd.randint(3)], counts)
                if want * sum(weights.get(f, 0.0) for f in features) <= 0:
                    for f in features:
                        weights[f] = weights.get(f, 0.0) + want
                        sums[f] = sums.get(f, 0.0) + step * want
        self.join_weights = {f: w - sums[f] / max(1, step) for f, w in weights.items()}
        return self

    def joined(self, left: str, right: str, mark: str, counts: tuple[int, int, int, int], solid_fix: str | None, split_fix: str | None) -> str:
        """The whole word of two halves around a line end, with a hyphen if the perceptron keeps it; the fixes are what the whole words are misread from."""
        solid, split = left + right, f"{left}-{right}"
        if not counts[0] and not counts[1] and mark == "-" and solid_fix and len(_parts(solid)) == 1:
            return solid_fix
        keeps = mark == "-" and (left[-1:].isdigit() or right[:1].isdigit() or sum(self.join_weights.get(f, 0.0) for f in self.join_features(left, right, mark, counts)) < 0)
        return (split_fix or split) if keeps else (solid_fix or solid)


def _near(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    if len(a) == len(b) and sum(map(str.__ne__, a, b)) <= most:
        return True
    # of most + 1 pieces of one text at least one stands unchanged in the other
    size = max(1, len(a) // (most + 1))
    if not any(a[k * size : (k + 1) * size] in b for k in range(most + 1)):
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


_LETTERS = re.compile(r"[\W_]+")


def _begins(name: str, bare: str) -> bool:
    """Whether a name begins with about that text; some stretch of four letters must stand in its place."""
    n = len(bare)
    return (bare[:4] == name[:4] or bare[4:8] == name[4:8] or bare[-4:] == name[n - 4 : n]) and _near(bare, name[:n], 1 + n // 9)


#: Letters that are often read as others stand for the same in comparisons of whole lines.
_FOLD = [("rn", "m"), ("li", "h"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("in", "m")]
_FOLD_DIGITS = str.maketrans("015i", "olsl")


def _bare(text: str) -> str:
    """A line's letters and digits in lower case, what is often misread made equal."""
    out = _LETTERS.sub("", text).lower()
    for seen, meant in _FOLD:
        out = out.replace(seen, meant)
    return out.translate(_FOLD_DIGITS)


def furniture(lines: list[str], names: list[str]) -> list[bool]:
    """Which lines are page furniture; ``names`` are texts that running headers tend to hold (title, owner)."""
    n = len(lines)
    stripped = [x.strip() for x in lines]
    out = [False] * n
    filled = [i for i in range(n) if stripped[i]]
    names = [b for b in map(_bare, names) if len(b) >= 4]
    names += [x + y for x in names for y in names]
    width = max(map(len, stripped), default=0)
    edge = {filled[0], filled[-1]} if filled else set()
    short = {}
    for k, i in enumerate(filled):
        s = stripped[i]
        if len(s) <= 20 and (_NUMBER_LINE.match(s) or _ROMAN.match(s)) and any(c.isdigit() or c in "ivxlcIVXLC" for c in s):
            alone = s[-1] not in ".,;" or not s[:-1].isdigit()
            if alone:
                out[i] = True
                continue
        if len(s) > 100:
            continue
        m = _PAGED.match(s)
        body = (m[1] or m[2]) if m else s
        bare = _bare(body)
        if len(bare) < 4:
            continue
        if any(_near(bare, x, 1 + len(x) // 9) for x in names if abs(len(x) - len(bare)) <= 1 + len(x) // 9):
            out[i] = True
        elif len(bare) >= (8 if m else 16) and any(_begins(x, bare) for x in names if len(x) > len(bare)):
            out[i] = True  # a header cut off, often to make room for the page's number
        else:
            short[i] = (bare, bool(m))
    # the same short line at the edge of several pages
    tops = [i for i in short if i in edge or (i and (not stripped[i - 1] or out[i - 1])) or (i + 1 < n and not stripped[i + 1]) or short[i][1]]
    # lines of the text fill the page's width, headers that are not known by name are told by being shorter
    tops = [i for i in tops if (short[i][1] or len(stripped[i]) <= 0.75 * width) and not stripped[i].endswith((".", ",", ";", ":", "?", "!")) and (stripped[i][0].isupper() or stripped[i][0].isdigit())]
    groups: dict[int, list[int]] = {}
    for i in tops:
        groups.setdefault(len(short[i][0]) // 8, []).append(i)
    for i in tops:
        b = short[i][0]
        like = [j for g in (-1, 0, 1) for j in groups.get(len(b) // 8 + g, ()) if j != i and abs(len(short[j][0]) - len(b)) <= 2]
        if any(_near(b, short[j][0], 1 + len(b) // 20) for j in like):
            out[i] = True
    return out


def scan(text: str, names: list[str], core_of) -> tuple[list[int], list[tuple[int, str, str, str]], list[tuple[int, str]]]:
    """(lines to drop, (line, left, right, mark) of words broken at line ends, (line, word) of the other words that ``core_of`` gives for a token), lines counted from 1."""
    lines = text.replace("\r", "").split("\n")
    drop = furniture(lines, names)
    rest = [i for i in range(len(lines)) if not drop[i] and lines[i].strip()]
    pairs, words = [], []
    tail = -1  # the line whose first token is the second half of a broken word
    for x, i in enumerate(rest):
        tokens = lines[i].split()
        broken = False
        m = _END.search(lines[i]) if x + 1 < len(rest) and tokens[-1][-1] in _MARKS else None
        if m:
            nxt = lines[rest[x + 1]].split()
            right = _core(nxt[0]) if nxt else ""
            left = re.sub(r"^[\W_]+", "", m[1]).lower()
            if right and left and nxt[0][0].isalnum():
                pairs.append((i + 1, left, right, lines[i].rstrip()[-1]))
                broken = True
        own = tokens[1 if tail == i else 0 : len(tokens) - broken]
        words += [(i + 1, c) for c in dict.fromkeys(map(core_of, own)) if c]
        tail = rest[x + 1] if broken else -1
    return [i + 1 for i in range(len(lines)) if drop[i]], pairs, words


def fit_editor(counts: DataFrame) -> Editor:
    """Fits the editor on (word, n); the words drawn and those they are compared with are bounded and the same in every run."""
    frequent = counts.where(f"n >= {MIN_COUNT}")
    total = frequent.count()
    if total > MAX_WORDS:  # spares the sort most words; ties at the cut stay and are settled by their order
        frequent = frequent.where(F.col("n") >= int(frequent.select(F.percentile_approx("n", max(0.0, 1 - 1.1 * MAX_WORDS / total), 10_000)).first()[0]))
    lexicon = {r.word: r.n for r in frequent.orderBy(F.desc("n"), "word").limit(MAX_WORDS).toLocalIterator()}
    rare = counts.where("n <= 3 and length(word) between 4 and 30")
    share = max(1, rare.count() // (2 * MAX_PAIRS))
    drawn = rare.where(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).orderBy(F.xxhash64("word", F.lit(1)), "word").limit(MAX_PAIRS)
    return Editor(lexicon).fit(sorted((r.word, r.n) for r in drawn.collect())).fit_joins()


def _blocks(counts: DataFrame) -> list[DataFrame]:
    """Words that others may be misread from, in blocks of about ``MAX_WORDS``."""
    targets = counts.where(F.col("n") >= 2 * MIN_COUNT)
    n = max(1, -(-targets.count() // MAX_WORDS))
    return [targets.where(F.pmod(F.xxhash64("word", F.lit(3)), F.lit(n)) == b) if n > 1 else targets for b in range(n)]


def decide_parts(words: DataFrame, counts: DataFrame, editor: Editor) -> DataFrame:
    """(core, fixed) of the words in (word, n) that are misread; each block of possible words is one pass over the distinct words."""
    sc = words.sparkSession.sparkContext
    model = sc.broadcast((editor.weights, editor.ops))
    words = spread(words)
    out = None
    blocks = _blocks(counts)
    for block in blocks:
        targets = sc.broadcast({r.word: r.n for r in block.toLocalIterator()})

        def run(batches: Iterator, targets=targets) -> Iterator:
            import pyarrow as pa

            own = Editor({})
            own.weights, own.ops = model.value
            for batch in batches:
                found = [(w, *d) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (d := own.decide(w, n, targets.value))]
                cols = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.string()))], names=["core", "k", "s", "m", "fixed"])

        found = words.select("word", "n").mapInArrow(run, "core string, k int, s double, m long, fixed string")
        # written before the next block is made, so the driver holds one block at a time
        found = found if len(blocks) == 1 else written(found)
        out = found if out is None else out.unionAll(found)
    return written(out.groupBy("core").agg(F.min_by("fixed", F.struct("k", "s", "m", "fixed")).alias("fixed")) if len(blocks) > 1 else out.select("core", "fixed"))


def _assembled(cores: DataFrame, parts: DataFrame) -> DataFrame:
    """(core, fixed) of the words of several parts of which some part is misread."""
    pieces = F.split("core", _BETWEEN, -1)
    marks = F.regexp_extract_all("core", F.lit(f"({_BETWEEN})"), 1)
    one = cores.select("core", F.posexplode(pieces).alias("_at", "_piece"))
    hits = one.join(parts.select(F.col("core").alias("_piece"), "fixed"), "_piece").groupBy("core").agg(F.map_from_entries(F.collect_list(F.struct("_at", "fixed"))).alias("_fixes"))
    whole = F.transform(pieces, lambda x, i: F.concat(F.coalesce(F.try_element_at("_fixes", i), x), F.coalesce(F.get(marks, i), F.lit(""))))
    return hits.select("core", F.array_join(whole, "").alias("fixed"))


def _prepared(df: DataFrame, row_col: str, text_col: str, name_cols: tuple[str, ...]) -> DataFrame:
    names = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in name_cols]) if name_cols else F.array(F.lit(""))
    return df.select(F.col(f"`{text_col}`").cast("string").alias("_t"), F.col(f"`{row_col}`").alias("_no"), names.alias("_names")).where(F.col("_t").rlike(r"(?U)\S"))


def _places(texts: DataFrame, known: list[str], kind: str) -> DataFrame:
    """Where there is something to drop, to join or to look up: (_no, _key, _uid, line_no, kind, core, right, mark); ``_uid`` numbers the texts, ``_key`` tells different texts apart."""
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(known))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        good, cores = shared.value, {}
        uid = TaskContext.get().partitionId() << 40

        def core_of(token: str) -> str | None:
            got = cores.get(token, "")
            if got == "":
                if len(cores) > 500_000:
                    cores.clear()
                core = _core(token)
                got = cores[token] = core if core and core not in good and not core.isdigit() else None
            return got

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for x, (t, n) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                    drop, pairs, words = scan(t, n, core_of)
                    rows += [(x, line, "drop", None, None, None) for line in drop]
                    rows += [(x, line, "join", a, b, mark) for line, a, b, mark in pairs]
                    rows += [(x, line, "char", c, None, None) for line, c in words]
                cols = list(zip(*rows)) or [[]] * 6
                place = pa.array(cols[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(1).take(place), part.column(3).take(place), pa.array([uid + x for x in cols[0]], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.string()) for c in cols[2:]]],
                    names=["_no", "_key", "_uid", "line_no", "kind", "core", "right", "mark"],
                )
                uid += part.num_rows

    keyed = texts.select("_t", "_no", "_names", F.xxhash64("_no", "_t").alias("_key"))
    return keyed.mapInArrow(run, f"_no {kind}, _key long, _uid long, line_no int, kind string, core string, right string, mark string")


def _pair_words(pairs: DataFrame, counts: DataFrame, parts: DataFrame, whole: DataFrame, editor: Editor) -> DataFrame:
    """(core, right, mark, fixed): the whole word of every distinct pair of halves."""
    distinct = pairs.select("core", "right", "mark").distinct()
    left, right = F.col("core"), F.col("right")
    a, b = F.element_at(F.split(left, _BETWEEN, -1), -1), F.element_at(F.split(right, _BETWEEN, -1), 1)
    asked = [F.concat(left, right), F.concat(a, b), F.concat_ws("-", left, right), F.concat_ws("-", a, b), a, b]
    slots = distinct.select("core", "right", "mark", F.posexplode(F.array(*asked)).alias("_slot", "word"))
    counted = written(slots.join(counts, "word", "left").groupBy("core", "right", "mark").agg(*[F.coalesce(F.max(F.when(F.col("_slot") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(6)]))
    # whole words that stand nowhere in one piece have not been decided yet
    both = counted.select(F.explode(F.array(asked[0], asked[2])).alias("core")).distinct()
    new = both.join(counts.select(F.col("word").alias("core")), "core", "left_anti")
    pieces = new.select(F.explode(F.split("core", _BETWEEN, -1)).alias("word")).where("word != ''").distinct().join(counts.select("word"), "word", "left_anti")
    more = decide_parts(pieces.select("word", F.lit(1).cast("long").alias("n")), counts, editor)
    all_parts = parts.unionAll(more)
    fixes = whole.unionAll(more).unionAll(_assembled(new.where(F.col("core").rlike(_BETWEEN)), all_parts))
    solid = fixes.select(F.col("core").alias("_solid"), F.col("fixed").alias("_solid_fix"))
    split = fixes.select(F.col("core").alias("_split"), F.col("fixed").alias("_split_fix"))
    rows = counted.withColumns({"_solid": asked[0], "_split": asked[2]}).join(solid, "_solid", "left").join(split, "_split", "left")
    weights = editor.join_weights

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Editor({})
        own.join_weights = weights
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(11)]
            fixed = [own.joined(x, y, z, (max(n0, n1), max(n2, n3), n4, n5), f, g) for x, y, z, n0, n1, n2, n3, n4, n5, f, g in zip(*cols)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(fixed, pa.string())], names=["core", "right", "mark", "fixed"])

    return rows.select("core", "right", "mark", *[f"n{i}" for i in range(6)], "_solid_fix", "_split_fix").mapInArrow(run, "core string, right string, mark string, fixed string")


def _faults(texts: DataFrame, kind: str) -> DataFrame:
    """(_no, _key, _uid, line_no, kind, core, right, mark, fixed) of every fault."""
    counts = written(count_words(texts))
    editor = fit_editor(counts)
    several = F.col("word").rlike(_BETWEEN)
    parts = decide_parts(counts.where(~several), counts, editor)
    whole = written(parts.unionAll(_assembled(counts.where(several & (F.col("n") < RATIO)).select(F.col("word").alias("core")), parts)))
    right = counts.join(whole.select(F.col("core").alias("word")), "word", "left_anti").orderBy(F.desc("n"), "word").limit(KNOWN)
    places = written(_places(texts, [r.word for r in right.toLocalIterator()], kind))
    drops = places.where("kind = 'drop'").withColumn("fixed", F.lit(""))
    pairs = places.where("kind = 'join'")
    joins = pairs.join(_pair_words(pairs, counts, parts, whole, editor), ["core", "right", "mark"])
    chars = places.where("kind = 'char'").join(whole, "core")
    columns = [*places.columns, "fixed"]
    return drops.select(columns).unionAll(joins.select(columns)).unionAll(chars.select(columns))


def find_noise(df: DataFrame, row_col: str = "row_no", text_col: str = "text", name_cols: tuple[str, ...] = ("title",)) -> DataFrame:
    """(row_no, line_no, kind, word) of every fault."""
    faults = _faults(spread(_prepared(df, row_col, text_col, name_cols)), df.schema[row_col].dataType.simpleString())
    # two misread words of a line may mean the same one
    return faults.dropDuplicates(["_uid", "line_no", "kind", "fixed"]).select(F.col("_no").alias(row_col), "line_no", "kind", F.col("fixed").alias("word"))


def mend(text: str, drop: set[int], joins: dict[int, str], fixes: dict[str, str]) -> str:
    """Continuous paragraphs: lines dropped, broken words joined, misread words corrected in their own case."""
    out, carry = [], None
    for n, line in enumerate(text.replace("\r", "").split("\n"), 1):
        if n in drop:
            continue
        if not line.strip():
            if out and out[-1] is not None and carry is None:
                out.append(None)
            continue
        tokens = line.split()
        if carry is not None:
            lead, word = carry
            ending = re.search(r"[\W_]*$", tokens[0])[0]
            tokens[0] = lead + word + ending
            carry = None
            start = 1
        else:
            start = 0
        last = len(tokens) - (n in joins)
        for k in range(start, last):
            core = _core(tokens[k])
            fixed = fixes.get(core)
            if fixed is not None:
                a = tokens[k].lower().find(core)
                old = tokens[k][a : a + len(core)]
                tokens[k] = tokens[k][:a] + (fixed.upper() if old.isupper() and len(old) > 1 else fixed.capitalize() if old[:1].isupper() else fixed) + tokens[k][a + len(core) :]
        if n in joins:
            half = tokens.pop()
            lead = re.match(r"^[\W_]*", half)[0]
            carry = (lead, joins[n].capitalize() if half[len(lead) : len(lead) + 1].isupper() else joins[n])
        out += tokens
    paragraphs, run = [], []
    for t in [*out, None]:
        if t is None:
            if run:
                paragraphs.append(" ".join(run))
            run = []
        else:
            run.append(t)
    return "\n\n".join(paragraphs)


def repair(df: DataFrame, row_col: str = "row_no", text_col: str = "text", name_cols: tuple[str, ...] = ("title",), out_col: str = "repaired") -> DataFrame:
    """(row_no, repaired) of every row with text."""
    texts = spread(_prepared(df, row_col, text_col, name_cols))
    kind = df.schema[row_col].dataType.simpleString()
    # the faults of one text, whose number its length bounds; equal texts of equal number share them
    own = _faults(texts, kind).dropDuplicates(["_key", "line_no", "kind", "core"]).groupBy("_key").agg(
        F.collect_list(F.when(F.col("kind") == "drop", F.col("line_no"))).alias("_drop"),
        F.collect_list(F.when(F.col("kind") == "join", F.struct("line_no", "fixed"))).alias("_joins"),
        F.collect_list(F.when(F.col("kind") == "char", F.struct("core", "fixed"))).alias("_fixes"),
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [
                    mend(t, set(d or ()), {x["line_no"]: x["fixed"] for x in j or ()}, {x["core"]: x["fixed"] for x in f or ()})
                    for t, d, j, f in zip(*(part.column(i).to_pylist() for i in range(1, 5)))
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.string())], names=["_no", "_out"])

    rows = texts.withColumn("_key", F.xxhash64("_no", "_t")).join(own, "_key", "left").select("_no", "_t", "_drop", "_joins", "_fixes")
    return rows.mapInArrow(run, f"_no {kind}, _out string").toDF(row_col, out_col)
