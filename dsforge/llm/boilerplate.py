"""The main body of web pages whose text mixes it with furniture (problem 1).

Method: gradient-boosted trees score every leaf of the page's tree by its own form and words, its depth, the tokens of its ancestors' attributes, the density of text in the subtrees it stands in, and its siblings.
Decoding goes over the whole tree: a node taken as furniture has no main leaf below it, a node taken as main body has at least one, and the cheapest reading of all nodes wins, so
ancestors and descendants never contradict each other. Text with markup gives the elements as tree; text without gives page, zones between blank lines, blocks of lines of one kind, and lines.

No list of phrases is used: labels come from repetition and form. Sure furniture are lines on at least ``REPEATED`` of a source's pages, rows of parts that each stand on many pages, titles of other pages, and short lines of several sources that stand anywhere; sure main body are
the page's own title, whole sentences that do not repeat, and short lines of several sources that text always follows, as it does headings; all else is unlabelled. A first set of trees learns from the sure lines without the features that made them sure, in two halves of the sources; each
half labels the other's unlabelled lines, and the trees that score all pages learn from both. Word scores are cross-fitted by source in the same way, so what is furniture in one source is known by its words in another.
The trees are fitted at query time on at most ``MAX_PAGES`` pages of at most ``MAX_TRAIN_CHARS`` characters (a bounded sample, drawn by hash); repetition is counted over all pages and all pages are scored whole.

Scale: repetition is one grouping of distinct lines by source, with map-side combine, kept only for lines on at least ``KEPT`` of a source's pages (at most
page length / ``KEPT`` per source). The kept lines are broadcast if there are at most ``MAX_BROADCAST``; beyond that each source's list is joined to its pages, sources with many pages in several
parts (``dsforge.operators.skew``), so no source meets in one task. Scoring is one pass over the pages.

Defined results: null, empty and blank texts give no row; blank lines are never given; a page's own title line is main body; a null source counts as one source; equal pages
each give their own rows; line numbers count from 1 over all parts between line feeds; a line with several leaves is main body if one of them is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsforge.llm.boosting import BoostedTrees
from dsforge.operators.skew import salted_lookup
from dsforge.session import spread, written

MAX_PAGES, MAX_TRAIN_CHARS = 1200, 50_000
REPEATED, KEPT, MIN_PAGES, MAX_BROADCAST = 0.42, 0.05, 6, 2_000_000
#: A sentence: so many words and an end. Parts of a row count as repeated if they stand on this share of the sample's pages.
SENTENCE, PART = 9, 0.02
#: A short line that repeats over sources is no heading if text does not follow it this often; it is one if that is four times as rare.
LOOSE = 0.1
#: Levels of a page's tree that are looked at; deeper elements count to their ancestor there.
LEVELS = 10

_SEPARATOR = re.compile(r" [|·>»/•-] |  +")
_BULLET = re.compile(r"^([-*•–»›]) *(.?)")
_DIGITS = re.compile("[0-9]+")
_NOISE = re.compile(r"[\W_]+")
_TOKEN = re.compile(r"[^\W\d_]+")
_ONE_DIGIT, _CAPITAL = re.compile(r"[0-9]"), re.compile(r"[A-ZÀ-Þ]")
_SENTENCE_END = (".", "!", "?", '"', "”", ":", ";", "’", ")")
_MARKUP = re.compile(r"<(?:/?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?|!--.*?--)>", re.S)


def _mask(line: str) -> str:
    return _DIGITS.sub("9", line.strip(" ")).lower()


def _key(line: str) -> int:
    """The hash that Spark's xxhash64 gives of the masked line."""
    import xxhash

    x = xxhash.xxh64_intdigest(_mask(line).encode(), 42)
    return x - (1 << 64) if x >= 1 << 63 else x


def _squeeze(text: str | None) -> str:
    return _NOISE.sub("", text.lower()) if text else ""


def _parts(line: str) -> list[str]:
    """The parts of a row of links, masked; none for other lines."""
    parts = [_mask(x) for x in _SEPARATOR.split(line) if x.strip()]
    return parts if len(parts) > 1 else []


class Lines:
    """What a line says by itself, remembered by its text: furniture repeats from page to page."""

    def __init__(self, scores: dict[str, float], first_words: dict[str, float]):
        self.scores, self.first_words, self.known = scores, first_words, {}

    def of(self, x: str) -> tuple:
        """(key, squeezed, words, ends like a sentence, kind of bullet, likeness to a title, whether a row of parts, features)."""
        got = self.known.get(x)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[x] = self._read(x)
        return got

    def _read(self, x: str) -> tuple:
        low, words, ends = x.lower(), x.split(), x.endswith(_SENTENCE_END)
        m = _BULLET.match(x)
        bullet = 0 if not m else 3 if m[1] in "»›" else 1 if m[2].islower() or m[2].isdigit() else 2
        bare = words[1:] if bullet and len(words[0]) == 1 else words
        titled = self.first_words.get(bare[0].lower(), 0.0) if bare and len(bare) <= 18 and not x.endswith((".", "!", "?", "…", ",", ";")) else 0.0
        get = self.scores.get
        tokens = [get(t, 0.0) for t in _TOKEN.findall(low)] or [0.0]
        own = (
            np.log1p(len(x)), len(words), ends, x.endswith("…"), x[0].islower(), bullet, len(_SEPARATOR.findall(x)), len(_ONE_DIGIT.findall(x)) / len(x), len(_CAPITAL.findall(x)) / len(x), 0 < x.find(":") < 24,
            sum(tokens) / len(tokens), max(tokens), min(tokens), tokens[0], tokens[-1], get("^" + " ".join(low.split()[:2]), 0.0), get("=" + _mask(x), 0.0), titled,
        )
        return _key(x), _squeeze(x), len(words), ends, bullet, titled, own[6] > 0 and bool(_parts(x)), own

    @staticmethod
    def words(x: str, attributes: str) -> set[str]:
        """What word scores are counted for: words, how the line begins, the line as a whole, attributes."""
        low = x.lower()
        return {*_TOKEN.findall(low), "^" + " ".join(low.split()[:2]), "=" + _mask(x), *("@" + t for t in _TOKEN.findall(attributes))}


class _Dom(HTMLParser):
    """The leaves of a page with markup: (line, text, path of element numbers, attributes of the ancestors, whether in a link)."""

    EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.leaves: list[tuple[int, str, tuple[int, ...], str, bool]] = []
        self.stack: list[tuple[str, int, str]] = []
        self.n = 0

    def handle_starttag(self, tag, attrs):
        if tag not in self.EMPTY:
            self.n += 1
            self.stack.append((tag, self.n, " ".join([tag, *(v for k, v in attrs if k in ("class", "id", "role") and v)]).lower()))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        line = self.getpos()[0]
        tags = {t for t, _, _ in self.stack}
        if tags & {"script", "style", "noscript", "head"}:
            return
        for k, part in enumerate(data.split("\n")):
            if part.strip():
                self.leaves.append((line + k, part.strip(), tuple(n for _, n, _ in self.stack), " ".join(a for _, _, a in self.stack), "a" in tags))


class Page:
    """The leaves of a page, the tree they stand in, and what is known of each."""

    def __init__(self, text: str, title: str | None, shares: dict[int, float], reader: Lines):
        self.reader, self.marked = reader, bool(_MARKUP.search(text))
        if self.marked:
            dom = _Dom()
            dom.feed(text.replace("\r", ""))
            dom.close()
            leaves = dom.leaves
        else:
            leaves = [(k, line.strip(), (), "", False) for k, line in enumerate(text.split("\n"), 1) if line.strip()]
        self.numbers, self.lines, self.paths, self.attributes, self.linked = map(list, zip(*leaves)) if leaves else ([] for _ in range(5))
        got = [reader.of(x) for x in self.lines]
        keys, self.squeezed, self.words, self.ends, self.bullet, self.titled, self.rows, self.alone = map(list, zip(*got)) if got else ([] for _ in range(8))
        self.share = [shares.get(k, 0.0) for k in keys]
        if self.marked:  # lines are counted with their markup
            raw = text.split("\n")
            self.share = [max(s, shares.get(_key(raw[k - 1]), 0.0)) for s, k in zip(self.share, self.numbers)]
        own = _squeeze(title)
        self.own = [bool(own) and x == own for x in self.squeezed]
        self.sentence = [w >= SENTENCE and e and s < KEPT for w, e, s in zip(self.words, self.ends, self.share)]
        for i, runs in enumerate(self._running()):
            self.sentence[i] = self.sentence[i] or runs
        if not any(self.own):
            # without a title to go by, the last short line before the first sentence that does not repeat is the page's own
            first = next((i for i, x in enumerate(self.sentence) if x), 0)
            near = [i for i in range(max(0, first - 3), first) if self.share[i] < KEPT and self.titled[i] > 0 and not self.bullet[i] and not self.rows[i]]
            if near:
                self.own[near[0]] = True
        held = [x for x, o in zip(self.squeezed, self.own) if o][:1]
        self.holds = [bool(held) and not o and held[0] in x for o, x in zip(self.own, self.squeezed)]
        self.levels = self._levels()

    def _running(self) -> list[bool]:
        """Lines of wrapped text: one that does not end goes on in the next, which begins small, and so on to the end of the sentence."""
        n = len(self.lines)
        plain = [not b and s < KEPT and not o and not r for b, s, o, r in zip(self.bullet, self.share, self.own, self.rows)]
        opens = [plain[i] and len(x) >= 40 and not self.ends[i] and x[-1] != "…" for i, x in enumerate(self.lines)]
        out = [False] * n
        for i in range(1, n):
            if opens[i - 1] and plain[i] and self.numbers[i] == self.numbers[i - 1] + 1 and (out[i - 1] or self.lines[i][0].islower()):
                out[i - 1] = out[i] = True
        for i in range(n - 2, -1, -1):
            if out[i + 1] and opens[i] and self.numbers[i] == self.numbers[i + 1] - 1:
                out[i] = True
        return out

    def _kind(self, i: int) -> int:
        if self.own[i]:
            return 0
        if self.bullet[i]:
            return 1 + self.bullet[i]
        return 1 if self.words[i] > 6 else 0

    def _levels(self) -> np.ndarray:
        """The number of each leaf's ancestor on every level, from the page down; leaves count as their own ancestor below their depth."""
        n = len(self.lines)
        if self.marked:
            depth = [min(len(p), LEVELS) for p in self.paths]
            out = np.array([[p[min(k, d - 1)] if d > k else -1 - i for k in range(LEVELS)] for i, (p, d) in enumerate(zip(self.paths, depth))], np.int64).reshape(n, LEVELS)
            return np.stack([np.unique(out[:, k], return_inverse=True)[1] for k in range(LEVELS)], 1) if n else out
        out, zone, block = np.zeros((n, 3), np.int64), 0, 0
        for i in range(1, n):
            gap = self.numbers[i] != self.numbers[i - 1] + 1
            zone += gap
            block += gap or self._kind(i) != self._kind(i - 1)
            out[i] = 0, zone, block
        return out

    def sure(self, titles: set[str], parts: set[str], genre: set[str], short: dict[str, int]) -> list[int]:
        """1 for sure furniture, 0 for sure main body, -1 for all else, by repetition and form."""
        out = []
        for i, x in enumerate(self.lines):
            if self.own[i]:
                out.append(0)
            elif (self.share[i] >= REPEATED and _mask(x) not in genre) or self._names_a_page(x, titles) or ((row := _parts(x)) and sum(p in parts for p in row) > len(row) / 2):
                out.append(1)
            elif (key := self._short(i)) in short:
                out.append(short[key])
            else:
                out.append(0 if self.sentence[i] or (self.bullet[i] == 1 and self.share[i] >= KEPT) or (self.bullet[i] and _mask(x) in genre) else -1)
        # what stands between two sure neighbours is of their kind
        between = [out[i - 1] if v < 0 and 0 < i < len(out) - 1 and out[i - 1] == out[i + 1] == 1 else v for i, v in enumerate(out)]
        return between

    def _short(self, i: int) -> str | None:
        """A line that could be a heading or a call by its form, masked; of one with a colon what stands before it."""
        x = self.lines[i]
        if self.bullet[i] or self.own[i] or self.sentence[i] or self.rows[i] or x.endswith((".", "!", "?", ";", ",", "…")):
            return None
        lead = x.partition(": ")[0]
        if lead != x and self.words[i] <= 20:
            return _mask(lead) + ":" if len(lead.split()) <= 5 else None
        return _mask(x) if self.words[i] <= 8 else None

    def short_lines(self) -> list[tuple[str, bool]]:
        """The masked short lines that do not repeat on most pages, and whether text follows each of them."""
        n = len(self.lines)
        follows = lambda i: i + 1 < n and self.numbers[i + 1] == self.numbers[i] + 1 and self.words[i + 1] > 4 and not self.bullet[i + 1]
        return [(key, follows(i)) for i in range(n) if self.share[i] < REPEATED and (key := self._short(i))]

    @staticmethod
    def _names_a_page(x: str, titles: set[str]) -> bool:
        """Whether the line, or what follows its first colon, is the title of a page."""
        low = _BULLET.sub(r"\2", x.lower())
        return len(x) <= 200 and (_NOISE.sub("", low) in titles or _NOISE.sub("", low.partition(":")[2]) in titles)


def nested(pages: list[Page]) -> np.ndarray:
    """The levels of pages of one kind one below the other, nodes numbered over all of them."""
    parts, ends = [], 0
    for p in pages:
        parts.append(p.levels + ends)
        ends = ends + p.levels.max(0) + 1
    return np.concatenate(parts)


def features(pages: list[Page], own_share: bool) -> np.ndarray:
    """One row per leaf of non-empty pages of one kind; without ``own_share`` nothing that makes a leaf sure is among them but words and form."""
    join = lambda name, kind=float: np.array([x for p in pages for x in getattr(p, name)], kind)
    sizes = np.array([len(p.lines) for p in pages])
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    n, g = np.repeat(sizes, sizes), np.arange(int(sizes.sum()))
    at = g - start
    levels = nested(pages)
    block, zone = levels[:, -1], levels[:, LEVELS // 2 if pages[0].marked else 1]
    share, ends, count, sentence, titled, bullet, linked, is_own = (join(x) for x in ("share", "ends", "words", "sentence", "titled", "bullet", "linked", "own"))

    def mean(v, of):
        return (np.bincount(of, v) / np.bincount(of))[of]

    def others(v, of):  # without the leaf itself
        return (np.bincount(of, v)[of] - v) / np.maximum(np.bincount(of)[of] - 1, 1)

    before, after = np.where(at > 0, g - 1, g), np.where(at < n - 1, g + 1, g)
    first = np.cumsum(sizes) - sizes
    own = np.minimum.reduceat(np.where(is_own > 0, at, 1 << 30), first)
    own = np.repeat(own, sizes)
    done = np.cumsum(sentence) - sentence
    above = done - done[start]
    below = np.repeat(np.add.reduceat(sentence, first), sizes) - above - sentence
    last = np.maximum.accumulate(np.where(sentence > 0, g, -1))
    nxt = np.minimum.accumulate(np.where(sentence > 0, g, 1 << 30)[::-1])[::-1]
    get = pages[0].reader.scores.get
    tags = [[get("@" + t, 0.0) for t in _TOKEN.findall(a)] or [0.0] for p in pages for a in p.attributes] if pages[0].marked else [[0.0]] * len(g)
    tag = np.array([sum(t) / len(t) for t in tags])
    around = np.stack([
        is_own, join("holds"), at / n, np.minimum(at, 20), np.minimum(n - 1 - at, 20), np.where(own < 1 << 30, np.sign(at - own), 0), np.minimum(above, 10), np.minimum(below, 10), np.where(last >= start, np.minimum(g - last, 20), 20),
        np.where(nxt < start + n, np.minimum(nxt - g, 20), 20), mean(count, block), np.bincount(block)[block], mean(ends, block), others(share, block), mean(count, zone), np.bincount(zone)[zone], mean(sentence, zone), others(share, zone),
        count[before], count[after], titled[before], titled[after], ends[before], ends[after], bullet[before], bullet[after], np.where(before != g, share[before], 0), np.where(after != g, share[after], 0),
        np.array([min(len(x), LEVELS) for p in pages for x in p.paths], float), tag, np.array([max(t) for t in tags]), np.array([min(t) for t in tags]), linked, *[mean(v, of) for v in (tag, linked) for of in (block, zone)],
        *([share] if own_share else []),
    ], 1)
    return np.hstack([np.array([x for p in pages for x in p.alone], float), around])


def by_kind(pages: list[Page]) -> list[list[int]]:
    """The places of the non-empty pages, those without and those with markup."""
    return [x for kind in (False, True) if (x := [i for i, p in enumerate(pages) if p.lines and p.marked == kind])]


#: Log-odds that taking a whole inner node as furniture costs, and a single furniture leaf inside a main node.
NODE_COST, LEAF_COST = 0.3, 0.2


def decode(levels: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Furniture leaves, from their log-odds of furniture and their ancestors (leaves x levels, from the page down).

    From the lowest level up each node is read as furniture as a whole or as the best readings of its children, of which one at least is main body; from the page down the choices are carried out.
    """
    cost_f, cost_m = np.logaddexp(0, -z), np.logaddexp(0, z)
    out = cost_f + LEAF_COST < cost_m
    best, main = np.where(out, cost_f + LEAF_COST, cost_m), ~out
    whole = np.zeros(len(z), bool)  # below a node taken as furniture
    child = np.arange(len(z))
    for k in range(levels.shape[1] - 1, -1, -1):
        node = levels[:, k]
        first = np.unique(child, return_index=True)[1]  # one leaf of each child
        size = node.max() + 1
        mixed = np.bincount(node[first], best[first], size)
        held = np.bincount(node[first], main[first].astype(float), size) > 0
        alone = np.bincount(node, minlength=size) == 1  # a node of one leaf is that leaf
        all_f = np.bincount(node, cost_f, size) + np.where(alone, LEAF_COST, NODE_COST)
        taken = ~held | (all_f <= mixed)
        whole |= taken[node]
        best, main, child = np.where(taken, all_f, mixed)[node], ~taken[node], node
    return out | whole


class FurnitureModel:
    def __init__(self, trees: BoostedTrees | None, scores: dict[str, float], first_words: dict[str, float]):
        self.trees, self.reader = trees, Lines(scores, first_words)

    @classmethod
    def fit(cls, pages: list[tuple[str, str | None, dict[int, float], str]]) -> FurnitureModel:
        """Fits trees and word scores on (text, title, line shares, source)."""
        import xxhash

        starts: dict[str, int] = {}
        for _, title, _, _ in pages:
            if title and title.split():
                w = title.split()[0].lower()
                starts[w] = starts.get(w, 0) + 1
        first_words = {w: n / len(pages) for w, n in starts.items() if n >= 2}
        plain = Lines({}, first_words)
        made = [Page(text, title, shares, plain) for text, title, shares, _ in pages]
        titles = {t for _, title, _, _ in pages if len(t := _squeeze(title)) >= 8}
        seen: dict[str, int] = {}
        for p in made:
            for x in {q for line in p.lines for q in (_parts(line) or [_mask(line)])}:
                seen[x] = seen.get(x, 0) + 1
        parts = {x for x, n in seen.items() if n >= max(3, PART * len(pages))}
        genre = cls._genre(pages, made)
        short = cls._short(pages, made)
        sure = [p.sure(titles, parts, genre, short) for p in made]
        fold = [xxhash.xxh64_intdigest(s) & 1 for _, _, _, s in pages]
        if len(set(fold)) < 2:
            fold = [i & 1 for i in range(len(pages))]
        flat = [v for y in sure for v in y if v >= 0]
        if len(set(flat)) < 2:
            return cls(None, {}, first_words)
        labels = [np.array(y) for y in sure]
        # each half of the sources labels what is unlabelled in the other
        for k in (0, 1):
            learn, tell = [i for i in range(len(pages)) if fold[i] != k], [i for i in range(len(pages)) if fold[i] == k]
            halves = [[i for j, i in enumerate(learn) if j % 2 == h] for h in (0, 1)]
            x, y = [], []
            for h in (0, 1):  # word scores of the other half of the pages that learn
                scores = cls._scores([made[i] for i in halves[1 - h]], [labels[i] for i in halves[1 - h]])
                cls._learn(x, y, halves[h], [np.array(v) for v in sure], pages, Lines(scores, first_words), False)
            if not x or len(set(np.concatenate(y))) < 2:
                continue
            trees = BoostedTrees(60, 4, columns=0.25).fit(np.concatenate(x), np.concatenate(y))
            reader = Lines(cls._scores([made[i] for i in learn], [labels[i] for i in learn]), first_words)
            told = [Page(*pages[i][:3], reader) for i in tell]
            for group in by_kind(told):
                own = [told[j] for j in group]
                known = np.concatenate([np.array(sure[tell[j]]) for j in group])
                z = np.where(known < 0, trees.predict(features(own, False)), np.where(known > 0, 6.0, -6.0))
                found = np.where(known < 0, decode(nested(own), z), known)
                for j, part in zip(group, np.split(found, np.cumsum([len(p.lines) for p in own])[:-1])):
                    labels[tell[j]] = part
        return cls._final(pages, made, labels, fold, first_words)

    @staticmethod
    def _learn(x: list, y: list, which: list[int], labels: list[np.ndarray], pages, reader: Lines, own_share: bool) -> None:
        """Adds features and labels of the labelled leaves of some pages."""
        made = [Page(*pages[i][:3], reader) for i in which]
        for group in by_kind(made):
            label = np.concatenate([labels[which[j]] for j in group])
            x.append(features([made[j] for j in group], own_share)[label >= 0])
            y.append(label[label >= 0].astype(float))

    @classmethod
    def _final(cls, pages, made, labels, fold, first_words) -> FurnitureModel:
        x, y = [], []
        for k in (0, 1):  # word scores of the other half of the sources
            reader = Lines(cls._scores([made[i] for i in range(len(pages)) if fold[i] != k], [labels[i] for i in range(len(pages)) if fold[i] != k]), first_words)
            cls._learn(x, y, [i for i in range(len(pages)) if fold[i] == k], labels, pages, reader, True)
        scores = cls._scores(made, labels)
        return cls(BoostedTrees().fit(np.concatenate(x), np.concatenate(y)), scores, first_words)

    @staticmethod
    def _genre(pages, made: list[Page], sources: int = 4) -> set[str]:
        """Masked lines that stand in several sources and nowhere on many of a source's pages: what such texts say, not what a site says on each page."""
        where: dict[str, set[str]] = {}
        often: dict[str, set[str]] = {}
        for (_, _, _, source), p in zip(pages, made):
            for x, share in zip(p.lines, p.share):
                m = _mask(x)
                where.setdefault(m, set()).add(source)
                if share >= REPEATED:
                    often.setdefault(m, set()).add(source)
        return {m for m, s in where.items() if len(s) >= sources and 10 * len(often.get(m, ())) < len(s)}

    @staticmethod
    def _short(pages, made: list[Page], sources: int = 4, least: int = 8) -> dict[str, int]:
        """Short lines of several sources: 0 for headings, which text always follows, 1 for calls, which stand anywhere."""
        where: dict[str, set[str]] = {}
        counts: dict[str, list[int]] = {}
        for (_, _, _, source), p in zip(pages, made):
            for m, follows in p.short_lines():
                where.setdefault(m, set()).add(source)
                counts.setdefault(m, [0, 0])[follows] += 1
        told = {m: a / (a + b) for m, (a, b) in counts.items() if a + b >= least and len(where[m]) >= sources}
        return {m: int(share > LOOSE) for m, share in told.items() if share > LOOSE or share <= LOOSE / 4}

    @staticmethod
    def _scores(pages: list[Page], labels: list[np.ndarray]) -> dict[str, float]:
        """How much each word speaks for furniture; what is not known to be furniture counts against it, but for attributes, which say where a leaf stands, only sure leaves count."""
        counts: dict[str, list[float]] = {}
        total = [1.0, 1.0]
        for p, y in zip(pages, labels):
            for x, a, v in zip(p.lines, p.attributes, y):
                total[int(v > 0)] += 1
                for t in Lines.words(x, a):
                    if t[0] == "@" and v < 0:
                        continue
                    counts.setdefault(t, [0.0, 0.0])[int(v > 0)] += 1
        base = np.log(total[1] / total[0])
        return {t: float(np.log((f + 0.5) / (m + 0.5)) - base) for t, (m, f) in counts.items() if m + f >= 3}

    def furniture(self, pages: list[tuple[str, str | None, dict[int, float]]]) -> list[list[int]]:
        """The numbers of each page's furniture lines."""
        made = [Page(text, title, shares, self.reader) for text, title, shares in pages]
        if self.trees is None:
            return [[n for n, f in zip(p.numbers, p.sure(set(), set(), set(), {})) if f > 0] for p in made]
        out: list[list[int]] = [[] for _ in made]
        for group in by_kind(made):
            own = [made[i] for i in group]
            found = decode(nested(own), self.trees.predict(features(own, True))).tolist()
            at = 0
            for i, p in zip(group, own):
                here = found[at : at + len(p.lines)]
                at += len(p.lines)
                if p.marked:
                    main = {k for k, f in zip(p.numbers, here) if not f}
                    out[i] = [k for k in dict.fromkeys(p.numbers) if k not in main]
                else:
                    out[i] = [k for k, f in zip(p.numbers, here) if f]
        return out


#: Stands on every page once and so counts the pages of a source.
_PAGE = "\x00"


def line_counts(pages: DataFrame) -> DataFrame:
    """(_site, _h, _n): on how many of a source's pages each masked line stands, if on three at least; the hash of ``_PAGE`` has the number of pages."""
    masks = F.array_distinct(F.transform(F.split("_text", "\n"), lambda x: F.lower(F.regexp_replace(F.trim(x), "[0-9]+", "9"))))
    lines = pages.select("_site", F.explode(F.concat(F.array(F.lit(_PAGE)), masks)).alias("_m")).where("_m != ''").groupBy("_site", F.xxhash64("_m").alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    return lines.where((F.col("_n") >= 3) | (F.col("_h") == F.xxhash64(F.lit(_PAGE))))


_MODELS: dict[str, tuple] = {}


def furniture_lines(df: DataFrame, row_col: str = "row_no", text_col: str = "text", title_col: str = "title", site_col: str = "source_site") -> DataFrame:
    """(row_no, line_no) of every non-blank line that is not main body."""
    import uuid

    spark = df.sparkSession
    pages = df.select(F.col(f"`{row_col}`").alias("_no"), F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("")).alias("_site"), F.col(f"`{title_col}`").cast("string").alias("_title"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    pages = pages.where(F.col("_text").rlike(r"(?U)\S"))
    counts = line_counts(pages).persist()
    try:
        is_page = F.col("_h") == F.xxhash64(F.lit(_PAGE))
        per_site = counts.where(is_page).select("_site", F.col("_n").alias("_pages"))
        kept = counts.where(~is_page).join(per_site.where(f"_pages >= {MIN_PAGES}"), "_site").where(f"_n >= {KEPT} * _pages")
        lists = kept.groupBy("_site").agg(F.collect_list(F.struct("_h", (F.col("_n") / F.col("_pages")).alias("_share"))).alias("_shares"))
        by_site = per_site.join(lists, "_site", "left")  # a row for every source
        total, most, lines = by_site.agg(F.coalesce(F.sum("_pages"), F.lit(0)), F.coalesce(F.max("_pages"), F.lit(0)), F.coalesce(F.sum(F.size("_shares")), F.lit(0))).first()
        small = lines <= MAX_BROADCAST
        if not small:
            by_site = written(by_site)
        # drawn by hash and order alone, so every run takes the same pages
        share = max(1, total // (2 * MAX_PAGES))
        drawn = pages.where(f"length(_text) <= {MAX_TRAIN_CHARS}").where(F.pmod(F.xxhash64("_no", "_text"), F.lit(share)) == 0).orderBy(F.xxhash64("_no", F.lit(1)), "_no", F.xxhash64("_text")).limit(MAX_PAGES)
        known: dict[str, dict[int, float]] = {}
        if small:
            known = {r._site: {x._h: x._share for x in r._shares or ()} for r in by_site.toLocalIterator()}
            sample = [(r._text, r._title, known.get(r._site, {}), r._site) for r in drawn.orderBy("_no", F.xxhash64("_text")).collect()]
        else:
            sample = [(r._text, r._title, {x._h: x._share for x in r._shares or ()}, r._site) for r in drawn.join(by_site, "_site", "left").orderBy("_no", F.xxhash64("_text")).collect()]
        model = FurnitureModel.fit(sample)
    finally:
        counts.unpersist()
    shared = spark.sparkContext.broadcast((model, known))
    key = uuid.uuid4().hex
    kind = df.schema[row_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = shared.value
        model, by_site = _MODELS[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                site, title, text = (part.column(i).to_pylist() for i in (1, 2, 3))
                shares = [by_site.get(s, {}) for s in site] if small else [{x["_h"]: x["_share"] for x in r or []} for r in part.column(4).to_pylist()]
                found = model.furniture(list(zip(text, title, shares)))
                rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array([n for f in found for n in f], pa.int32())], names=["_no", "line_no"])

    pages = spread(pages)
    if not small:
        pages = salted_lookup(pages, by_site, "_site", "_pages", total, "_no", heaviest=most).select("_no", "_site", "_title", "_text", "_shares")
    return pages.mapInArrow(run, f"_no {kind}, line_no int").withColumnRenamed("_no", row_col)


def main_body(df: DataFrame, row_col: str = "row_no", text_col: str = "text", **columns) -> DataFrame:
    """(row_no, body): the main body of every page with text, its lines in order."""
    drop = furniture_lines(df, row_col, text_col, **columns).groupBy(F.col(f"`{row_col}`").alias("_no")).agg(F.collect_set("line_no").alias("_drop"))
    rows = df.select(F.col(f"`{row_col}`").alias("_no"), F.col(f"`{text_col}`").cast("string").alias("_text")).where("_text is not null").join(drop, "_no", "left")
    kept = F.filter(F.split("_text", "\n"), lambda x, i: ~F.array_contains(F.coalesce("_drop", F.array().cast("array<int>")), (i + 1).cast("int")))
    return rows.select(F.col("_no").alias(row_col), F.trim(F.array_join(kept, "\n"), F.lit("\n ")).alias("body"))
