"""Freely typed names mapped to a reference list (problem 4).

Method: one multi-pattern automaton (Aho-Corasick) per list holds all canonical names and their aliases, written without spaces and
punctuation; mentions that begin and end with a word are taken longest first without overlap. Names without a mention go to weighted token-set similarity: every token
of a canonical name weighs by its rarity in the lists, distinctive tokens must agree up to one edit and the rest must reach ``MIN_SCORE``.

Aliases come from rules, not from data: order of words, a missing or spelt-out legal form, words without vowels, cut to four letters, or
as initials. An alias that fits several entries is no alias.

Scale: one pass over the rows, no shuffle. Lists are broadcast in blocks of at most ``MAX_CHARS`` characters; a block's rows are those of its lists. A list that is longer is cut into parts: its distinct
names go through every part, and the best answer of all parts is taken, the same as of the whole list: how rare tokens are and which aliases fit several entries is counted over all lists first.
A worker remembers the answers for the names it has met, up to ``CACHE``.

Defined results: null and blank names give no row; a name spelt exactly like an entry gives no row in ``mapped`` and itself in ``map_names``; a name without a match,
or of a list that is null, unknown or empty, gives the empty string; ties in similarity go to the higher score, then to no entry.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsforge.operators.skew import salted_lookup
from dsforge.session import spread, written

MAX_CHARS = 8 << 20
CACHE = 500_000
#: Weighted share of an entry's tokens that a name must hold.
MIN_SCORE = 0.6
#: A token is common, not distinctive, if at least this share of all entries have it, and at least three.
COMMON = 0.015
# Legal forms of companies and how else they are written, without spaces and punctuation.
LEGAL = {
    "sa": ["societeanonyme"], "sas": ["societeparactionssimplifiee"], "inc": ["incorporated"], "ltd": ["limited"], "gmbh": ["gesellschaftmbh"],
    "ag": ["aktiengesellschaft"], "bv": ["beslotenvennootschap"], "foundation": ["found", "fdn"], "association": ["assoc", "ass"], "group plc": ["plc", "grpplc", "groupepublic"],
}
_TOKEN = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def tokens(text: str) -> list[str]:
    """Lower case words without accents; digits inside words that look like letters become letters."""
    out = _TOKEN.findall(fold(text))
    return [t.replace("0", "o").replace("1", "l") if not t.isdigit() and not t.isalpha() else t for t in out]


def skeleton(word: str) -> str:
    return word[:1] + re.sub("[aeiou]", "", word[1:])


def one_edit(a: str, b: str) -> bool:
    """At most one letter put in, left out or replaced, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and x[:2] == y[1::-1] and x[2:] == y[2:])


class Lists:
    """Automata and token weights of a block of reference lists; ``counts`` (entries by token, entries) of all lists, if there is more than this block, and aliases that fit entries elsewhere."""

    def __init__(self, lists: dict[str, list[str]], counts: tuple[dict[str, int], int] | None = None, taken: frozenset[tuple[str, str]] = frozenset()):
        self.taken = taken
        self.exact = {k: set(v) for k, v in lists.items()}
        self.known: dict[tuple[str, str], str] = {}
        split = {k: [(e, tokens(e)) for e in dict.fromkeys(v)] for k, v in lists.items()}
        if counts is None:
            counts = Counter(t for v in split.values() for _, ts in v for t in set(ts)), sum(map(len, split.values()))
        df, n = counts
        common = {t for t, x in df.items() if x >= max(3, COMMON * n)}
        self.weight = {t: math.log(1 + n / x) for t, x in df.items()}
        self.common, self.df = common, df
        self.automata, self.entries, self.near, self.aliases = {}, {}, {}, {}
        for k, v in split.items():
            self._build(k, v)

    def _build(self, k: str, entries: list[tuple[str, list[str]]]) -> None:
        import ahocorasick

        aliases: dict[str, set[int]] = {}
        near: dict[str, set[tuple[str, int]]] = {}
        parts = []
        for i, (_, ts) in enumerate(entries):
            legal = next((" ".join(ts[-m:]) for m in (2, 1) if len(ts) > m and " ".join(ts[-m:]) in LEGAL), "")
            rest = ts[: len(ts) - len(legal.split())]
            rare = [t for t in rest if t not in self.common] or rest
            own = [t for t in rare if self.df[t] == min(self.df[x] for x in rare)]
            sector = [t for t in rest if t not in own]
            parts.append((own, sector, legal.split()))
            forms = {"".join(sector), "".join(map(skeleton, sector)), "".join(t[:4] for t in sector), "".join(t[:4] for t in sector[:1]), "".join(t[0] for t in sector)}
            ends = ["".join(legal.split()), *LEGAL.get(legal, []), ""]
            root = "".join(own)
            for form in forms:
                for end in ends:
                    if not form and not end and sector:
                        continue
                    for alias in {root + form + end, form + root + end}:
                        aliases.setdefault(alias, set()).add(i)
            aliases.setdefault("".join(ts), set()).add(i)
            for t in own:
                for key in {t, *(t[:j] + t[j + 1 :] for j in range(len(t)))}:
                    near.setdefault(key, set()).add((t, i))
        self.aliases[k] = [a for a in aliases if a]
        automaton = ahocorasick.Automaton()
        for alias, who in aliases.items():
            if alias and len(who) == 1 and (k, alias) not in self.taken:
                automaton.add_word(alias, (len(alias), next(iter(who))))
        automaton.make_automaton()
        self.automata[k], self.entries[k], self.near[k] = automaton, [(e, *p) for (e, _), p in zip(entries, parts)], near

    def map(self, k: str, name: str) -> str:
        return self.find(k, name)[3]

    def find(self, k: str, name: str) -> tuple[int, float, int, str]:
        """(kind of answer, its worth, its place, entry); the greatest is the best of several parts of a list. Kinds: 3 the entry itself, 2 a mention, 1 likeness, 0 nothing."""
        key = (k, name)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > CACHE:
                self.known.clear()
            found = self.known[key] = self._find(k, name)
        return found

    def _find(self, k: str, name: str) -> tuple[int, float, int, str]:
        if k not in self.exact:
            return 0, 0.0, 0, ""
        if name in self.exact[k]:
            return 3, 0.0, 0, name
        ts = tokens(name)
        return self._mention(k, ts) or self._similar(k, ts) or (0, 0.0, 0, "")

    def _mention(self, k: str, ts: list[str]) -> tuple[int, float, int, str] | None:
        """The entry of the longest mention; shorter ones that don't overlap it are further mentions, which the longest outranks."""
        starts, at = set(), 0
        for t in ts:
            starts.add(at)
            at += len(t)
        ends = starts - {0} | {at}
        automaton = self.automata[k]
        if not at or not len(automaton):
            return None
        best = None
        for end, (n, i) in automaton.iter("".join(ts)):
            if end + 1 in ends and end + 1 - n in starts and (best is None or (n, -(end - n)) > best[:2]):
                best = (n, -(end - n), i)
        return None if best is None else (2, float(best[0]), best[1], self.entries[k][best[2]][0])

    def _similar(self, k: str, ts: list[str]) -> tuple[int, float, int, str] | None:
        near, pieces = self.near[k], []
        for j, t in enumerate(ts):
            pieces.append(t)
            if j + 1 < len(ts):
                pieces.append(t + ts[j + 1])
        for t in list(pieces):  # a word written together with a common one
            for w in self.common:
                if len(t) >= len(w) + 5 and len(w) >= 4:
                    if t.endswith(w):
                        pieces += [t[: -len(w)], w]
                    elif t.startswith(w):
                        pieces += [t[len(w) :], w]
        candidates: set[int] = set()
        for t in pieces:
            if len(t) < 5:  # too short for an edit
                candidates.update(i for own, i in near.get(t, ()) if own == t)
                continue
            for key in {t, *(t[:j] + t[j + 1 :] for j in range(len(t)))}:
                for own, i in near.get(key, ()):
                    if one_edit(t, own):
                        candidates.add(i)
        scores = sorted(((self._score(self.entries[k][i], pieces), i) for i in candidates), reverse=True)
        if not scores or scores[0][0] < MIN_SCORE:
            return None
        tied = len(scores) > 1 and scores[1][0] == scores[0][0]
        return 1, scores[0][0], 0, "" if tied else self.entries[k][scores[0][1]][0]

    def _score(self, entry: tuple, pieces: list[str]) -> float:
        _, own, sector, legal = entry
        have = set(pieces)
        total = got = 0.0
        for t in own:
            w = self.weight[t]
            total += w
            if t in have:
                got += w
            elif any(len(p) >= 5 and one_edit(p, t) for p in pieces):
                got += 0.9 * w
            else:
                return 0.0
        initials = "".join(t[0] for t in sector)
        for t in sector:
            w = self.weight[t]
            total += w
            if t in have:
                got += w
            elif initials in have or skeleton(t) in have or (len(t) > 4 and t[:4] in have) or any(len(p) >= 5 and one_edit(p, t) for p in pieces):
                got += 0.8 * w
        # words that belong to other entries speak against this one
        other = [p for p in have if p in self.common and p not in sector and p not in legal and p not in own]
        joined = "".join(pieces)
        for t in legal:
            w = self.weight[t] / 2
            total += w
            if t in have or any(x in joined for x in LEGAL.get(" ".join(legal), [])):
                got += w
        total += sum(self.weight[p] for p in other)
        return got / total


_LISTS: dict[str, Lists] = {}


def _lists(key: str, shared) -> Lists:
    if key not in _LISTS:
        _LISTS.clear()
        _LISTS[key] = Lists(*shared.value)
    return _LISTS[key]


def _entries(lists: DataFrame, list_col: str, values_col: str) -> DataFrame:
    """(_k, _e) of every entry."""
    return lists.select(F.col(f"`{list_col}`").cast("string").alias("_k"), F.explode(F.col(f"`{values_col}`")).alias("_e")).where("_k is not null and _e != ''")


def _blocks(lists: DataFrame, list_col: str, values_col: str) -> tuple[list[dict[str, list[str]]], dict[str, int]]:
    """(the short lists in blocks, the characters of each list that is too long for one); each list's entries in their order."""
    chars = F.coalesce(F.expr(f"aggregate(`{values_col}`, 0L, (a, x) -> a + coalesce(length(x), 0))"), F.lit(0))
    rated = lists.select(F.col(f"`{list_col}`").cast("string").alias("k"), F.col(f"`{values_col}`").alias("v"), chars.alias("n")).where("k is not null and v is not null")
    long = {r.k: r.n for r in rated.groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > MAX_CHARS).collect()}
    short = rated.where(~F.col("k").isin(*long)) if long else rated
    out, n = [{}], 0
    for r in short.toLocalIterator():
        own = [x for x in r.v if x]
        if out[-1] and n + r.n > MAX_CHARS and r.k not in out[-1]:
            out.append({})
            n = 0
        out[-1].setdefault(r.k, []).extend(own)
        n += r.n
    return out, long


class _Counts:
    """How many entries of all lists have each token, for lists that don't fit one block."""

    def __init__(self, entries: DataFrame):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                found = [t for e in batch.column(0).to_pylist() for t in set(tokens(e))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["t"])

        distinct = entries.distinct()
        self.n = distinct.count()
        self.df = written(distinct.select("_e").mapInArrow(run, "t string").groupBy("t").agg(F.count(F.lit(1)).alias("n")))
        # at most as many as an entry has tokens, over ``COMMON``
        self.common = {r.t: r.n for r in self.df.where(F.col("n") >= max(3, COMMON * self.n)).collect()}

    def of(self, lists: dict[str, list[str]]) -> tuple[dict[str, int], int]:
        """The counts of a block's own tokens and of the common ones."""
        own = {t for v in lists.values() for e in v for t in tokens(e)}
        rows = self.df.join(F.broadcast(self.df.sparkSession.createDataFrame([(t,) for t in own] or [("",)], "t string")), "t").collect()
        return self.common | {r.t: r.n for r in rows}, self.n


def map_names(df: DataFrame, lists: DataFrame, id_col: str = "ex_no", list_col: str = "collection", name_col: str = "name", values_col: str = "enum_values", keep: bool = False) -> DataFrame:
    """(id, canonical, exact) of every row whose name is not blank, with ``keep`` its list and name too; ``lists`` has one row per reference list."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = spread(df.select(F.col(f"`{id_col}`").alias("_i"), F.col(f"`{list_col}`").cast("string").alias("_k"), F.col(f"`{name_col}`").cast("string").alias("_n")).where(F.col("_n").rlike(r"(?U)\S")))
    blocks, long = _blocks(lists, list_col, values_col)
    counts = _Counts(_entries(lists, list_col, values_col)) if long or len(blocks) > 1 else None
    out = None
    for x, block in enumerate(blocks):
        shared = df.sparkSession.sparkContext.broadcast((block, counts and counts.of(block)))

        def run(batches: Iterator, shared=shared, key=uuid.uuid4().hex) -> Iterator:
            import pyarrow as pa

            own = _lists(key, shared)
            for batch in batches:
                k, n = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                canon = [own.map(a, b) for a, b in zip(k, n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(canon, pa.string()), pa.array([a == b for a, b in zip(canon, n)], pa.bool_())], names=["_i", "_k", "_n", "canonical", "exact"])

        inside = F.coalesce(F.col("_k").isin(*block), F.lit(False))
        # rows of no list at all go with the first block
        elsewhere = [k for b in blocks for k in b] + list(long)
        part = rows if len(blocks) == 1 and not long else rows.where(inside | ~F.coalesce(F.col("_k").isin(*elsewhere), F.lit(False)) if x == 0 else inside)
        found = part.mapInArrow(run, f"_i {kind}, _k string, _n string, canonical string, exact boolean")
        out = found if out is None else out.unionAll(found)
    for k, n in long.items():
        out = out.unionAll(_map_in_parts(rows.where(F.col("_k") == k), k, -(-n // max(1, MAX_CHARS // 2)), _entries(lists, list_col, values_col).where(F.col("_k") == k), counts))
    return out.withColumnsRenamed({"_i": id_col, "_k": list_col, "_n": name_col}) if keep else out.withColumnRenamed("_i", id_col).drop("_k", "_n")


def _map_in_parts(rows: DataFrame, k: str, n_parts: int, entries: DataFrame, counts: _Counts) -> DataFrame:
    """The rows of one list that is too long for a block: every distinct name goes through all its parts."""
    sc = rows.sparkSession.sparkContext
    cut = entries.select("_e", F.pmod(F.xxhash64("_e"), F.lit(n_parts)).alias("_p")).distinct()

    def part(p: int) -> dict[str, list[str]]:
        return {k: [r._e for r in cut.where(F.col("_p") == p).toLocalIterator()]}

    aliases = None
    for p in range(n_parts):
        own = part(p)
        made = rows.sparkSession.createDataFrame([(a, p) for a in Lists(own, counts.of(own)).aliases[k]] or [("", p)], "a string, p int")
        aliases = written(made) if aliases is None else aliases.unionAll(written(made))
    # aliases that fit entries of several parts
    shared_aliases = written(aliases.join(aliases.groupBy("a").agg(F.countDistinct("p").alias("n")).where("n > 1").select("a"), "a", "left_semi"))
    names = written(rows.groupBy("_n").agg(F.count(F.lit(1)).alias("_rows")))
    found = None
    for p in range(n_parts):
        own = part(p)
        taken = frozenset((k, r.a) for r in shared_aliases.where(F.col("p") == p).toLocalIterator())
        shared = sc.broadcast((own, counts.of(own), taken))

        def run(batches: Iterator, shared=shared, key=uuid.uuid4().hex) -> Iterator:
            import pyarrow as pa

            own = _lists(key, shared)
            for batch in batches:
                n = batch.column(0).to_pylist()
                got = list(zip(*(own.find(k, x) for x in n))) or [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got[0], pa.int32()), pa.array(got[1], pa.float64()), pa.array(got[2], pa.int32()), pa.array(got[3], pa.string())], names=["_n", "kind", "worth", "place", "entry"])

        made = written(spread(names.select("_n")).mapInArrow(run, "_n string, kind int, worth double, place int, entry string"))
        shared.destroy()
        found = made if found is None else found.unionAll(made)
    # one answer per part
    best = found.groupBy("_n").agg(F.array_sort(F.collect_list(F.struct((-F.col("kind")).alias("kind"), (-F.col("worth")).alias("worth"), (-F.col("place")).alias("place"), "entry"))).alias("x"))
    first, second = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    tied = (first["kind"] == -1) & F.coalesce((second["kind"] == -1) & (second["worth"] == first["worth"]), F.lit(False))
    answers = best.select("_n", F.when(tied, "").otherwise(first["entry"]).alias("canonical")).join(names, "_n")
    total, most = names.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.max("_rows"), F.lit(0))).first()
    return salted_lookup(rows, answers, "_n", "_rows", total, "_i", heaviest=most).select("_i", "_k", "_n", "canonical", (F.col("canonical") == F.col("_n")).alias("exact"))


def mapped(df: DataFrame, lists: DataFrame, id_col: str = "ex_no", **columns) -> DataFrame:
    """(id, canonical) of every row whose name is not blank and not spelt like an entry."""
    return map_names(df, lists, id_col, **columns).where("not exact").select(id_col, "canonical")
