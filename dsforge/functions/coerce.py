"""Coercion of loosely written values to typed columns: built-in expressions only, a value that can't be read becomes null and never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dsforge.plans.model import Codebook, VariableSpec

# Spellings of yes and no.
TRUE = ["true", "t", "yes", "y", "oui", "vrai", "v", "sí", "si", "verdadero", "ja", "正", "是"]
FALSE = ["false", "f", "no", "n", "non", "faux", "nein", "否", "非"]
# Multiplier words in their order of precedence.
MULTIPLIERS = [
    ("milliers?|mille", 1e3), ("millions?", 1e6), ("milliards?|billions?", 1e9), ("k|thousand", 1e3), ("m|mn", 1e6), ("b|bn", 1e9), ("t|trillion", 1e12),
]
# Numbers from one to ten in French and English.
NUMBER_WORDS = {
    "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuf": 9, "dix": 10,
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
}
# Month names in French and English, without accents, and the short English forms.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_BARE = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
_NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _BARE), r"\p{M}+", "")


def to_boolean(c: Column, kind: str = "string") -> Column:
    """Booleans as they are, numbers unknown, texts by the fixed spellings."""
    if kind == "boolean":
        return c
    if kind in _NUMERIC or kind.startswith("decimal"):
        return F.lit(None).cast("boolean")
    s = F.lower(strip(c.cast("string")))
    return F.when(s.isin(*TRUE), F.lit(True)).when(s.isin(*FALSE), F.lit(False))


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often the expression names it: else the tree below it is written out again each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def multiplier(c: Column) -> Column:
    """The factor of the first multiplier word, by precedence; 1 if there is none."""

    def factor_of(low: Column) -> Column:
        out = F.lit(1.0)
        for words, factor in reversed(MULTIPLIERS):
            out = F.when(low.rlike(rf"\b(?:{words})\b"), F.lit(factor)).otherwise(out)
        return out

    return once(F.lower(c), factor_of)


def _plain_number(c: Column) -> Column:
    """The first number of a text in the form that a cast reads; two or more groups after commas are thousands, a single comma is decimal."""
    spaced = F.regexp_replace(F.translate(c, "  ", "  "), "[€$£¥]", " ")
    token = F.regexp_extract(spaced, r"-?\d[\d\s,.]*", 0)
    return once(F.regexp_replace(token, r"\s", ""), _castable)


def _castable(dense: Column) -> Column:
    comma, dot = dense.contains(","), dense.contains(".")
    last_comma, last_dot = F.length(dense) - F.locate(",", F.reverse(dense)), F.length(dense) - F.locate(".", F.reverse(dense))
    only_comma = F.when(dense.rlike(r"^-?\d{1,3}(?:,\d{3}){2,}$"), F.replace(dense, F.lit(","))).otherwise(F.replace(dense, F.lit(","), F.lit(".")))
    both = F.when(last_comma > last_dot, F.replace(F.replace(dense, F.lit(".")), F.lit(","), F.lit("."))).otherwise(F.replace(dense, F.lit(",")))
    return once(F.when(comma & dot, both).when(comma, only_comma).otherwise(dense), lambda text: F.when(text.rlike(r"^-?\d+\.?\d*$"), text))


def to_float(c: Column, kind: str = "string") -> Column:
    if kind == "boolean":
        return F.when(c, 1.0).when(~c, 0.0)
    if kind in _NUMERIC or kind.startswith("decimal"):
        return c.cast("double")
    return _plain_number(c.cast("string")).try_cast("double") * multiplier(c.cast("string"))


def to_integer(c: Column, kind: str = "string") -> Column:
    """Half to even; numbers are cut off; a leading number word counts."""
    if kind == "boolean":
        return F.when(c, F.lit(1)).when(~c, F.lit(0)).cast("long")
    if kind in _NUMERIC or kind.startswith("decimal"):
        return c.try_cast("long")
    s = c.cast("string")
    word = F.regexp_extract(F.lower(strip(s)), r"^(\p{L}+)", 1)
    spelt = F.try_element_at(F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv]), word) * multiplier(s)
    return F.bround(F.coalesce(spelt, to_float(s))).try_cast("long")


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd").cast("string")


def to_date_text(c: Column) -> Column:
    """ISO text of a date: year first, day first (month first only where the day is impossible), or with a month's name; null if it does not exist."""
    return once(F.lower(strip_accents(strip(c.cast("string")))), _date_of)


def _date_of(low: Column) -> Column:
    group = lambda p, i: F.nullif(F.regexp_extract(low, p, i), F.lit("")).try_cast("int")
    ymd = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)"
    dmy = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})\b"
    named = r"(\d{1,2})(?:er|st|nd|rd|th)?\s+([a-z]+)\.?\s+(\d{4})$"
    reverse = r"^([a-z]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    a, b, y = group(dmy, 1), group(dmy, 2), group(dmy, 3)
    year = F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)
    day_first = F.when((b > 12) & (a <= 12), _iso(year, a, b)).otherwise(_iso(year, b, a))
    return (
        F.when(low.rlike(ymd), _iso(group(ymd, 1), group(ymd, 2), group(ymd, 3)))
        .when(low.rlike(dmy), day_first)
        .when(low.rlike(named), _iso(group(named, 3), F.try_element_at(months, F.regexp_extract(low, named, 2)), group(named, 1)))
        .when(low.rlike(reverse), _iso(group(reverse, 3), F.try_element_at(months, F.regexp_extract(low, reverse, 1)), group(reverse, 2)))
    )


def _enum_key(c: Column) -> Column:
    return strip(strip_accents(F.lower(c)))


def to_enum(c: Column, values: list[str], kind: str = "string") -> Column:
    """Exact, then equal without case and accents, then one containing the other at 0.6 of its length, then the nearest within a quarter of its length (two at least)."""
    if kind != "string" or not values:
        return F.lit(None).cast("string")
    return F.when(c.isin(*values), c).otherwise(once(_enum_key(c), lambda key: _nearest(key, values)))


def _nearest(key: Column, values: list[str]) -> Column:
    keys = [_enum_key(F.lit(v)) for v in values]
    equal = F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in zip(keys, values)])
    length = F.length(key)
    inside = F.coalesce(*[F.when((length > 0) & (key.contains(k) | k.contains(key)) & (F.least(length, F.length(k)) >= 0.6 * F.greatest(length, F.length(k))), F.lit(v)) for k, v in zip(keys, values)])
    ranked = F.array_min(F.filter(F.array(*[F.struct(F.levenshtein(key, k).alias("d"), F.lit(i).alias("i"), F.greatest(F.lit(2), F.floor(F.length(k) / 4)).alias("cap"), F.lit(v).alias("v")) for i, (k, v) in enumerate(zip(keys, values))]), lambda x: x["d"] <= x["cap"]))
    return F.when(length > 0, F.coalesce(equal, inside, ranked["v"]))


def to_array(c: Column, kind: str = "string") -> Column:
    """Arrays as they are; texts split at ; | , without empty parts."""
    if kind.startswith("array"):
        return c
    if kind != "string":
        return F.lit(None).cast("array<string>")
    return F.filter(F.transform(F.split(c, r"[;|,]\s*"), strip), lambda y: y != "")


def to_text(c: Column) -> Column:
    return F.nullif(strip(c.cast("string")), F.lit(""))


def bounded(c: Column, low: float | None, high: float | None) -> Column:
    """Null outside the range, not clamped."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (c >= low)
    if high is not None:
        ok = ok & (c <= high)
    return F.when(ok, c)


def coerce(c: Column, var: VariableSpec, kind: str = "string") -> Column:
    """A column of loosely written values as the type of ``var``; ``kind`` is the column's own type."""
    if var.type == "boolean":
        return to_boolean(c, kind)
    if var.type == "integer":
        return bounded(to_integer(c, kind), var.min_value, var.max_value)
    if var.type == "float":
        return bounded(to_float(c, kind), var.min_value, var.max_value)
    if var.type == "date":
        return to_date_text(c)
    if var.type == "enum":
        return to_enum(c, var.enum_values or [], kind)
    if var.type == "array":
        return to_array(c, kind)
    return to_text(c)


def coerce_row(df, codebook: Codebook, keep: list[str] = ()):
    """All variables of the codebook as typed columns, absent ones null, with ``_warnings``: what was lost or missing by variable."""
    kinds = dict(df.dtypes)
    typed = [(v, coerce(F.col(f"`{v.name}`"), v, kinds[v.name]) if v.name in kinds else F.lit(None).cast(v.spark_type())) for v in codebook.variables]
    out = df.select(*[F.col(f"`{k}`") for k in keep], *[F.col(f"`{v.name}`").alias(f"_raw_{v.name}") for v, _ in typed if v.name in kinds], *[c.alias(v.name) for v, c in typed])
    notes = []
    for v, _ in typed:
        given = F.col(f"`_raw_{v.name}`").isNotNull() if v.name in kinds else F.lit(False)
        note = F.when(F.col(f"`{v.name}`").isNull() & given, F.lit("coercion lost value"))
        if v.required:
            note = note.when(F.col(f"`{v.name}`").isNull(), F.lit("required but missing"))
        notes += [F.lit(v.name), note]
    warnings = F.map_filter(F.create_map(*notes), lambda k, x: x.isNotNull()) if notes else F.create_map()
    return out.withColumn("_warnings", warnings).drop(*[f"_raw_{v.name}" for v, _ in typed if v.name in kinds])
