"""Records that differ only in formatting (problem 5).

Method: byte-identical raw rows are collapsed first, with counts; only the distinct survivors are made canonical; they are grouped
again on the full canonical text (its 256-bit digest) and the counts are added up.

Scale: both groupings combine before the shuffle, so a group of copies that holds a third of all rows reaches the reducers as one
partial row per task. The survivors, as digests and numbers, are written once to the shared checkpoint folder; groups and totals come from there. Row-level membership never
gathers a group: rows of a spelling of their own are known from the survivors, and only spellings that repeat need a second look at the rows, a join on digests with hot
keys salted (``dsforge.operators.skew``). Texts are shuffled once.

Canonical text: lower case, without white space, punctuation and control characters. In the URL column the query parameters are sorted, and name and value stay apart; in
the JSON column keys and strings are made canonical one by one and keys are sorted at every depth, while numbers, booleans, nulls and the structure stay as they are, so 1.5 is not 15, -3 is not 3,
null is not "null" and two keys are never one. JSON that cannot be read is treated as plain text. Defined results: null equals only null
and an empty text only texts that are empty after this; very long texts are compared whole; of equal row numbers one row is kept; an empty
table gives an empty result; columns of the input that are not named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dsforge.operators.skew import salted_lookup
from dsforge.session import written

#: White space, punctuation, control characters and the ASCII symbols that count as punctuation.
NOISE = r"[\p{P}\p{Z}\s\p{C}$+<=>^`|~]+"


def plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), NOISE, "")


def canonical_url(c: Column) -> Column:
    """Path without noise, then the sorted query parameters, each as name=value."""
    at = F.locate("?", c)
    path = F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)
    params = F.transform(F.split(F.substring(c, at + 1, F.length(c)), "[&;]"), lambda p: F.array_join(F.transform(F.split(p, "=", 2), plain), "="))
    params = F.filter(params, lambda p: ~p.isin("", "="))
    return F.when(at > 0, F.concat_ws("?", plain(path), F.nullif(F.array_join(F.array_sort(params), "&"), F.lit("")))).otherwise(plain(c))


def _plain_strings(json: Column) -> Column:
    """JSON text with every key and string made canonical; all else stays."""
    # what is escaped in a string is noise itself: quotes, backslashes and control characters
    parts = F.split(F.regexp_replace(json, r"\\(?:u[0-9A-Fa-f]{4}|.)", ""), '"', -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, plain(x)).otherwise(x)), '"')


def canonical_json(c: Column) -> Column:
    """A variant keeps its keys sorted at every depth; it is read again after keys are made canonical, which may change their order."""
    text = _plain_strings(F.to_json(F.coalesce(F.try_parse_json(F.lower(c)), F.try_parse_json(c))))
    return F.coalesce(F.to_json(F.try_parse_json(text)), text, F.concat(F.lit("text:"), plain(c)))


def _digest(columns: list[str]) -> Column:
    """One 256-bit key of several columns; null differs from every text and lengths keep the columns apart."""
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns]), 256))


def _named(df: DataFrame, row_col: str, plain_cols: tuple[str, ...], url_cols: tuple[str, ...], json_cols: tuple[str, ...]) -> tuple[DataFrame, list]:
    kinds = [(c, plain) for c in plain_cols] + [(c, canonical_url) for c in url_cols] + [(c, canonical_json) for c in json_cols]
    return df.select(F.col(f"`{row_col}`").alias("_no"), *[F.col(f"`{c}`").cast("string").alias(f"_r{i}") for i, (c, _) in enumerate(kinds)]), [how for _, how in kinds]


def survivors(df: DataFrame, row_col: str = "row_no", plain_cols: tuple[str, ...] = ("id", "title"), url_cols: tuple[str, ...] = ("detail_url",), json_cols: tuple[str, ...] = ("extra",)) -> DataFrame:
    """One row per distinct raw row: ``_raw`` (its digest), ``_canon`` (its canonical text's digest), ``first_no``, ``n_raw``."""
    rows, kinds = _named(df, row_col, plain_cols, url_cols, json_cols)
    names = [f"_r{i}" for i in range(len(kinds))]
    distinct = rows.groupBy(*names).agg(F.min("_no").alias("first_no"), F.count(F.lit(1)).alias("n_raw"))
    canon = distinct.select(_digest(names).alias("_raw"), "first_no", "n_raw", *[how(F.col(r)).alias(f"_c{i}") for i, (how, r) in enumerate(zip(kinds, names))])
    return canon.select("_raw", _digest([f"_c{i}" for i in range(len(kinds))]).alias("_canon"), "first_no", "n_raw")


def groups(distinct: DataFrame) -> DataFrame:
    """One row per canonical text: ``_canon``, ``keep_no`` (smallest row number), ``n_copies`` (rows), ``n_spellings`` (distinct raw rows)."""
    return distinct.groupBy("_canon").agg(F.min("first_no").alias("keep_no"), F.sum("n_raw").alias("n_copies"), F.count(F.lit(1)).alias("n_spellings"))


def copies(df: DataFrame, row_col: str = "row_no", **columns) -> DataFrame:
    """(keep_no, copy_no, n_copies): every row that repeats an earlier one, with the row to keep."""
    distinct = written(survivors(df, row_col, **columns))
    several = written(groups(distinct).where("n_copies > 1"))
    total, most_raw = distinct.agg(F.coalesce(F.sum("n_raw"), F.lit(0)), F.coalesce(F.max("n_raw"), F.lit(0))).first()
    most_spellings = several.agg(F.coalesce(F.max("n_spellings"), F.lit(0))).first()[0]
    keep = written(salted_lookup(distinct, several, "_canon", "n_spellings", total, "_raw", heaviest=most_spellings).select("_raw", "first_no", "n_raw", "keep_no", "n_copies"))
    alone = keep.where("n_raw = 1 and first_no != keep_no").select("keep_no", F.col("first_no").alias("copy_no"), "n_copies")
    if most_raw < 2:
        return alone
    rows, kinds = _named(df, row_col, **{"plain_cols": ("id", "title"), "url_cols": ("detail_url",), "json_cols": ("extra",)} | columns)
    rows = rows.select(F.col("_no").alias("copy_no"), _digest([f"_r{i}" for i in range(len(kinds))]).alias("_raw"))
    repeated = keep.where("n_raw > 1").select("_raw", "n_raw", "keep_no", "n_copies")
    return alone.unionAll(salted_lookup(rows, repeated, "_raw", "n_raw", total, "copy_no", heaviest=most_raw).where("copy_no != keep_no").select("keep_no", "copy_no", "n_copies"))


def one_per_group(df: DataFrame, row_col: str = "row_no", **columns) -> DataFrame:
    """(keep_no, n_copies, n_spellings): one record per group, with the number of copies."""
    return groups(survivors(df, row_col, **columns)).select("keep_no", "n_copies", "n_spellings")
