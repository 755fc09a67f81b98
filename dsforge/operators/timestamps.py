"""Timestamps written in many ways, brought to one unambiguous form (problem 3).

Method: every value gives the array of all its valid interpretations (order of day and month, both instants of a local time that occurs
twice), each with a cost; of each source's records in order, the sequence of interpretations of least total cost is chosen by Viterbi.
A switch of format and a jump back in time cost a little, an interpretation against the source's declared order much more, so a declared
order always decides and undeclared sources are settled by their neighbours.

Scale: values are read in Arrow batches: the same tree of built-in expressions, used by several later ones, grows exponentially in the optimiser. A task remembers the values it has met.
Each value is read once and its interpretations are written. One that costs more than the best and two transitions together can't be on the cheapest sequence and is left out, which leaves most values with one; only
sources that still have a value with several go through Viterbi, all other values are final and are never shuffled.
Viterbi is a product of small (min, +) matrices and so associative: a source is cut by record number into blocks of about
``BLOCK`` rows (as its numbers lie on average), every block is reduced to the matrix between its first and last record, the matrices of a source
are chained (one row per block), and each block is then resolved with both its ends fixed. The result equals that of one pass over
the whole source.

Defined results: null, blank and unusable values (no such day, no such time, words) give no row; a value without zone of a source without
known zone is taken as UTC; of two interpretations of equal cost the first is taken: day before month, earlier instant; extra columns of
the input are ignored; an empty table gives an empty result; rows of equal number are ordered by their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dsforge.functions.coerce import MONTHS as NAMES
from dsforge.session import spread, written

#: Rows in one block of a source, on average.
BLOCK = 1 << 18
#: Costs: against the declared order; second instant of a repeated hour; order unknown; switch of format; jump back by more than a day.
AGAINST, SECOND, SWITCH, BACK = 100.0, 50.0, 1.0, 0.5
DAY = 86_400_000_000

# Further short forms of month names, without accents.
MONTHS = NAMES | {"sept": 9, "janv": 1, "fevr": 2, "fev": 2, "avr": 4, "juil": 7}
# Zone abbreviations and their offsets in minutes.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "jst": 540, "aest": 600, "aedt": 660, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

_ZONE = r"(?:\s*((?:utc|gmt)?\s*[+-]\d{2}:?\d{2}|[a-z]{1,5})?(?:\[[a-z0-9_/+-]+\])?)"
_CLOCK = r"(?P<h>\d{1,2})(?::|h)(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<half>[ap])\.?m\.?)?" + _ZONE.replace("((?:", "(?P<z>(?:")
_COMPACT = r"(?P<h>\d{2}):?(?P<mi>\d{2})(?::?(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?" + _ZONE.replace("((?:", "(?P<z>(?:")
_WEEKDAY = r"(?:[a-z]{2,9}\.?,?\s+)?"
#: Kind and pattern of the whole value; a, b, c are the date's fields as written.
_SHAPES = [
    (kind, re.compile(pattern + r"$"))
    for kind, pattern in (
        ("ymd", rf"(?P<a>\d{{4}})([-/.])(?P<b>\d{{1,2}})\2(?P<c>\d{{1,2}})(?:(?:t|,?\s+){_CLOCK})?"),
        ("ymd", rf"(?P<a>\d{{4}})(?P<b>\d{{2}})(?P<c>\d{{2}})(?:t{_COMPACT})?"),
        ("num", rf"(?P<a>\d{{1,2}})([/.-])(?P<b>\d{{1,2}})\2(?P<c>\d{{4}}|\d{{2}})(?:(?:t|,?\s+){_CLOCK})?"),
        ("dmon", rf"{_WEEKDAY}(?P<a>\d{{1,2}})(?:er|st|nd|rd|th)?[\s-]+(?P<b>[a-z]+)\.?,?[\s-]+(?P<c>\d{{4}})(?:(?:,|\s+a|\s+at)?\s+{_CLOCK})?"),
        ("mond", rf"{_WEEKDAY}(?P<a>[a-z]+)\.?\s+(?P<b>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<c>\d{{4}})(?:(?:,|\s+at)?\s+{_CLOCK})?"),
    )
]
_EPOCH = re.compile(r"(\d{10,19})(?:\.(\d{1,9}))?$")
_PLAIN = str.maketrans("éèêëàâäîïôöûùüç", "eeeeaaaiioouuuc")
_OFFSET = re.compile(r"^(?:utc|gmt)?\s*(?=[+-])|:")


def _ordinal(y: int, m: int, d: int) -> int | None:
    """Days since 1970 of a day that exists."""
    try:
        return date(y, m, d).toordinal() - 719163
    except ValueError:
        return None


def interpretations(value: str | None, order: str | None = None, zone: str | None = None) -> list[tuple[int, float, int, bool]]:
    """All valid interpretations (fmt, cost, at, day_only) of a text; ``at`` counts microseconds from 1970 in UTC, ``fmt`` numbers the formats."""
    if not value:
        return []
    s = " ".join(value.lower().split()).translate(_PLAIN).rstrip(". ")
    if m := _EPOCH.match(s):
        n, rest = int(m[1]), int((m[2] or "0")[:6].ljust(6, "0"))
        length = len(m[1])
        return [(6, 0.0, n * 1_000_000 + rest if length <= 11 else n * 1000 if length <= 14 else n if length <= 17 else n // 1000, False)]
    for kind, pattern in _SHAPES:
        if m := pattern.match(s):
            break
    else:
        return []
    g = m.groupdict()
    a, b, c = g["a"], g["b"], g["c"]
    if kind == "num":
        year = int(c) + 2000 if len(c) == 2 else int(c)
        days = [(2, 0.0 if order != "mdy" or a == b else AGAINST, _ordinal(year, int(b), int(a)))]
        if int(a) != int(b):
            days.append((3, AGAINST if order == "dmy" else 0.0, _ordinal(year, int(a), int(b))))
        elif days[0][1]:
            days = [(2, 0.0, days[0][2])]
    elif kind == "ymd":
        days = [(1, 0.0, _ordinal(int(a), int(b), int(c)))]
    else:
        month, day = (MONTHS.get(b), int(a)) if kind == "dmon" else (MONTHS.get(a), int(b))
        days = [(4 if kind == "dmon" else 5, 0.0, _ordinal(int(c), month, day) if month else None)]
    days = [x for x in days if x[2] is not None and x[2] > -354_000]  # from the year 1000 on
    if g["h"] is None:
        return [(f, cost, day * DAY, True) for f, cost, day in days]
    h, minute, second, half = int(g["h"]), int(g["mi"]), int(g["s"] or 0), g.get("half")
    if half:
        if not 1 <= h <= 12:
            return []
        h = h % 12 + 12 * (half == "p")
    if h > 23 or minute > 59 or second > 59:
        return []
    micros = (h * 3600 + minute * 60 + second) * 1_000_000 + int((g["f"] or "0")[:6].ljust(6, "0"))
    given = _OFFSET.sub("", g["z"] or "").strip()
    if given[:1] in ("+", "-"):
        offset = int(given[1:3]) * 60 + int(given[3:5])
        offset = -offset if given[0] == "-" else offset
    elif given:
        if given not in ZONES:
            return []
        offset = ZONES[given]
    else:
        info = _zone(zone)
        out = []
        for f, cost, day in days:
            local = datetime.fromordinal(day + 719163) + timedelta(hours=h, minutes=minute, seconds=second)
            # fold 0 is the earlier of two instants, and moves a time in a gap on by the length of the gap
            shifts = [info.utcoffset(local.replace(fold=x)) for x in (0, 1)]
            out.append((f, cost, day * DAY + micros - int(shifts[0].total_seconds()) * 1_000_000, False))
            if shifts[1] < shifts[0]:
                out.append((f, cost + SECOND, day * DAY + micros - int(shifts[1].total_seconds()) * 1_000_000, False))
        return out
    return [(f, cost, day * DAY + micros - offset * 60_000_000, False) for f, cost, day in days]


@lru_cache(4096)
def _zone(name: str | None):
    """The time zone of that name; UTC if there is none."""
    try:
        return ZoneInfo(name) if name else ZoneInfo("UTC")
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return ZoneInfo("UTC")


_READ = "_no {kind}, _field string, _source string, _text string, _fmt array<int>, _at array<long>, _cost array<double>, _day array<boolean>"


def possible(found: list[tuple[int, float, int, bool]]) -> list[tuple[int, float, int, bool]]:
    """The interpretations that can be on a cheapest sequence: another choice changes two transitions at most."""
    if len(found) < 2:
        return found
    most = min(x[1] for x in found) + 2 * (SWITCH + BACK)
    return [x for x in found if x[1] <= most]


def _parse(batches: Iterator) -> Iterator:
    """Reads every value; the columns are number, field, source, text, order and zone."""
    import pyarrow as pa

    known: dict[tuple, list] = {}

    def read(*key) -> list:
        got = known.get(key)
        if got is None:
            if len(known) > 200_000:
                known.clear()
            got = known[key] = possible(interpretations(*key))
        return got

    for batch in batches:
        found = [read(*x) for x in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)))]
        keep = [i for i, f in enumerate(found) if f]
        lists = [pa.array([[x[k] for x in found[i]] for i in keep], pa.list_(t)) for k, t in ((0, pa.int32()), (2, pa.int64()), (1, pa.float64()), (3, pa.bool_()))]
        kept = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(4)), *lists], names=["_no", "_field", "_source", "_text", "_fmt", "_at", "_cost", "_day"])


def utc_text(at: Column, day_only: Column) -> Column:
    """YYYY-MM-DD or YYYY-MM-DDTHH:MM:SS.ffffffZ, whatever the session's zone."""
    day = F.date_from_unix_date(F.floor(at / DAY).cast("int")).cast("string")
    rest = F.pmod(at, F.lit(DAY))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    seconds = F.floor(rest / 1_000_000)
    clock = F.concat(F.lit("T"), two(seconds / 3600), F.lit(":"), two(seconds % 3600 / 60), F.lit(":"), two(seconds % 60), F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("Z"))
    return F.when(day_only, day).otherwise(F.concat(day, clock))


def _step(prev: tuple, cur: tuple) -> float:
    """Cost between neighbouring interpretations (fmt, at)."""
    return (SWITCH if prev[0] != cur[0] else 0.0) + (BACK if cur[1] < prev[1] - DAY else 0.0)


def _viterbi(cands: list[list[tuple]], first: int | None, last: int | None) -> list[int]:
    """The cheapest choice for each record; the ends may be given."""
    best = [x[2] if first is None or i == first else float("inf") for i, x in enumerate(cands[0])]
    back: list[list[int]] = [[0] * len(best)]
    for prev, cur in zip(cands, cands[1:]):
        if len(prev) == 1:
            back.append([0] * len(cur))
            best = [best[0] + _step(prev[0], x) + x[2] for x in cur]
            continue
        costs = [[best[i] + _step(p, x) for i, p in enumerate(prev)] for x in cur]
        pick = [min(range(len(prev)), key=c.__getitem__) for c in costs]
        back.append(pick)
        best = [c[i] + x[2] for c, i, x in zip(costs, pick, cur)]
        low = min(best)
        if low > 1e6 and low != float("inf"):  # only differences matter; keeps the sums exact
            best = [b - low for b in best]
    at = min(range(len(best)), key=best.__getitem__) if last is None else last
    out = [at]
    for pick in back[:0:-1]:
        out.append(at := pick[at])
    return out[::-1]


def _records(pdf):
    """The rows in order and their interpretations (fmt, at, cost)."""
    pdf = pdf.sort_values(["_no", "_text"], kind="stable")
    return pdf, [list(zip(f, a, c)) for f, a, c in zip(pdf["_fmt"], pdf["_at"], pdf["_cost"])]


_KEY = ["_source", "_field", "_block"]
_ENDS = "_source string, _field string, _block long, _first_fmt array<int>, _first_at array<long>, _last_fmt array<int>, _last_at array<long>, _matrix array<double>"


def _summary(key, pdf):
    """The block's matrix of least costs from each interpretation of its first record to each of its last."""
    import pandas as pd

    _, cands = _records(pdf)
    matrix = []
    for i in range(len(cands[0])):
        best = [x[2] if j == i else float("inf") for j, x in enumerate(cands[0])]
        for prev, cur in zip(cands, cands[1:]):
            best = [min(b + _step(p, x) for b, p in zip(best, prev)) + x[2] for x in cur]
        matrix += best
    ends = [[x[k] for x in cands[e]] for e in (0, -1) for k in (0, 1)]
    return pd.DataFrame([[*key, *ends, matrix]], columns=[c.split()[0] for c in _ENDS.split(", ")])


def _chain(key, pdf):
    """The interpretations of each block's first and last record on the source's cheapest sequence."""
    import pandas as pd

    pdf = pdf.sort_values("_block")
    nodes: list[list[tuple]] = []
    blocks = pdf.to_dict("records")
    best, backs = None, []
    for b in blocks:
        firsts, lasts = list(zip(b["_first_fmt"], b["_first_at"])), list(zip(b["_last_fmt"], b["_last_at"]))
        if best is None:
            enter, from_last = [0.0] * len(firsts), [0] * len(firsts)
        else:
            costs = [[x + _step(p, f) for x, p in zip(best, prev)] for f in firsts]
            from_last = [min(range(len(c)), key=c.__getitem__) for c in costs]
            enter = [c[i] for c, i in zip(costs, from_last)]
        n = len(lasts)
        across = [[enter[i] + b["_matrix"][i * n + j] for i in range(len(firsts))] for j in range(n)]
        from_first = [min(range(len(c)), key=c.__getitem__) for c in across]
        best, prev = [c[i] for c, i in zip(across, from_first)], lasts
        low = min(best)
        best = [x - low for x in best]
        backs.append((from_last, from_first))
    at = min(range(len(best)), key=best.__getitem__)
    rows = []
    for b, (from_last, from_first) in zip(reversed(blocks), reversed(backs)):
        i = from_first[at]
        rows.append((b["_source"], b["_field"], b["_block"], i, at))
        at = from_last[i]
    return pd.DataFrame(rows, columns=[*_KEY, "_begin", "_end"])


def _resolve(key, pdf):
    import pandas as pd

    pdf, cands = _records(pdf)
    picks = _viterbi(cands, int(pdf["_begin"].iloc[0]), int(pdf["_end"].iloc[0]))
    return pd.DataFrame({"_no": pdf["_no"].to_numpy(), "_field": pdf["_field"].to_numpy(), "_at": [r[i][1] for r, i in zip(cands, picks)], "_day": [d[i] for d, i in zip(pdf["_day"], picks)]})


def normalise(df: DataFrame, sources: DataFrame, fields: tuple[str, ...] = ("date", "last_updated"), row_col: str = "row_no", source_col: str = "source_site", zone_col: str = "tz_name", order_col: str = "date_order", block: int = BLOCK) -> DataFrame:
    """(row_no, field_name, utc_value) of every usable value of ``fields``; ``sources`` has zone and order of each source."""
    known = sources.select(F.col(f"`{source_col}`").cast("string").alias("_source"), F.col(f"`{zone_col}`").cast("string").alias("_zone"), F.lower(F.col(f"`{order_col}`")).alias("_order")).where("_source is not null").dropDuplicates(["_source"])
    kind = df.schema[row_col].dataType.simpleString()
    values = df.select(
        F.col(f"`{row_col}`").alias("_no"),
        F.col(f"`{source_col}`").cast("string").alias("_source"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"`{f}`").cast("string").alias("t")) for f in fields])).alias("_v"),
    ).where(F.col("_v.t").rlike(r"\d"))
    texts = spread(values).join(known, "_source", "left").select("_no", F.col("_v.f").alias("_field"), F.coalesce("_source", F.lit("")).alias("_source"), F.col("_v.t").alias("_text"), "_order", "_zone")
    read = written(texts.mapInArrow(_parse, _READ.format(kind=kind)))
    only = lambda df: df.select("_no", "_field", F.get("_at", F.lit(0)).alias("_at"), F.get("_day", F.lit(0)).alias("_day"))
    unsure = read.where(F.size("_at") > 1).select("_source", "_field").distinct()
    if unsure.isEmpty():
        picked = only(read)
    else:
        # at most one row per source and field
        unsure = written(read.join(unsure, ["_source", "_field"], "left_semi").groupBy("_source", "_field").agg(F.min("_no").alias("_from"), (F.max("_no") - F.min("_no") + 1).alias("_range"), F.count(F.lit(1)).alias("_rows")))
        place = F.coalesce(F.floor((F.col("_no") - F.col("_from")) * F.col("_rows") / (F.col("_range") * F.lit(float(block)))), F.lit(0)).cast("long")
        chains = read.join(unsure, ["_source", "_field"]).withColumn("_block", place).drop("_from", "_range", "_rows")
        ends = chains.groupBy(*_KEY).applyInPandas(_summary, _ENDS)
        chosen = ends.groupBy("_source", "_field").applyInPandas(_chain, "_source string, _field string, _block long, _begin int, _end int")
        found = chains.join(chosen, _KEY).groupBy(*_KEY).applyInPandas(_resolve, f"_no {kind}, _field string, _at long, _day boolean")
        picked = only(read.join(unsure, ["_source", "_field"], "left_anti")).unionAll(found)
    return picked.select(F.col("_no").alias(row_col), F.col("_field").alias("field_name"), utc_text(F.col("_at"), F.col("_day")).alias("utc_value"))
