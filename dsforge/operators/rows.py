"""Ids, keep-first append, upsert, patch and bronze-silver merge: changes of a dataset as joins, never as loops over rows.

Order matters to most of them, so each takes the name of an order column; "first" and "last" are by it, never by place in a file.
"""

from __future__ import annotations

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dsforge.session import checkpoint

# Fields that don't take part in a row's content id.
UNSTABLE = {"id", "text_path", "txt_path", "txt_file", "text_file", "cache_path"}


@F.pandas_udf(T.StringType())
def _float_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "NaN" if x != x else repr(float(x)))


def _json_text(c: Column, kind: str) -> Column:
    """A value as JSON; texts with the escapes of JSON and no others."""
    if kind == "string":
        quoted = c
        for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            quoted = F.replace(quoted, F.lit(old), F.lit(new))
        text = F.concat(F.lit('"'), quoted, F.lit('"'))
    elif kind in ("double", "float"):
        text = _float_text(c.cast("double"))
    elif kind in ("boolean", "int", "bigint", "smallint", "tinyint"):
        text = c.cast("string")
    else:
        text = F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    return F.coalesce(text, F.lit("null"))


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The row's content as one JSON object, keys in order; equal rows give equal texts whatever the order of their columns."""
    kinds = dict(df.dtypes)
    names = sorted(c for c in (columns or df.columns) if not c.startswith("_") and c not in UNSTABLE)
    parts: list[Column] = []
    for i, n in enumerate(names):
        parts += [F.lit((", " if i else "") + f'"{n}": '), _json_text(F.col(f"`{n}`"), kinds[n])]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def content_id(df: DataFrame, prefix: str = "sig_", columns: list[str] | None = None) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(canonical_json(df, columns).cast("binary")), 1, 12))


def with_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Gives rows without an id one from their content."""
    if id_col not in df.columns:
        return df.withColumn(id_col, content_id(df))
    given = F.col(f"`{id_col}`").cast("string")
    return df.withColumn(id_col, F.when(given.isNull() | given.isin("", "0"), content_id(df)).otherwise(given))


def _picked(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    names, kinds = df.columns, dict(df.dtypes)
    order_by = F.struct(*[F.col(f"`{o}`") for o in order])
    # texts as keys are grouped by their digest, so each row carries them once
    texts = any(kinds[k] not in _SHORT for k in keys)
    by = [F.unhex(F.sha2(F.to_json(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])), 256)).alias("_k")] if texts else [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]
    picked = df.groupBy(*by).agg(pick(F.struct(*[F.col(f"`{n}`") for n in names]), order_by).alias("_row"))
    return picked.select(*[F.col(f"_row.`{n}`").alias(n) for n in names])


_SHORT = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``, as one aggregation with map-side combine: a hot key never gathers its rows."""
    return _picked(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _picked(df, keys, order, F.max_by)


def left_join_by_key(rows: DataFrame, other: DataFrame, key: str = "_key") -> DataFrame:
    """Left join on a key that may be missing: rows without one never match and would all meet in one task, so they go around the join."""
    return rows.where(F.col(key).isNotNull()).join(other, key, "left").unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def append_report(new: DataFrame, key: str, order: str, existing: DataFrame | None = None, violation: Column | None = None) -> DataFrame:
    """The new rows with ``_reason``: schema violation, missing key, duplicate (of an existing or an earlier row), or null for those to add."""
    k = F.col(f"`{key}`").cast("string")
    rows = new.withColumn("_violation", violation if violation is not None else F.lit(None).cast("string")).withColumn("_key", F.when(F.col("_violation").isNull(), F.nullif(k, F.lit(""))))
    firsts = rows.where("_key is not null").groupBy("_key").agg(F.min(order).alias("_first"))
    if existing is not None:
        held = existing.select(F.col(f"`{key}`").cast("string").alias("_key")).where("_key is not null").distinct().withColumn("_held", F.lit(True))
        firsts = firsts.join(held, "_key", "left")
    else:
        firsts = firsts.withColumn("_held", F.lit(None).cast("boolean"))
    reason = F.when(F.col("_violation").isNotNull(), F.concat(F.lit("schema: "), F.col("_violation"))).when(F.col("_key").isNull(), F.lit("missing key")).when(F.col("_held") | (F.col(order) > F.col("_first")), F.lit("duplicate"))
    return left_join_by_key(rows, firsts).withColumn("_reason", reason).select(*new.columns, "_reason")


def append(existing: DataFrame, new: DataFrame, key: str, order: str, violation: Column | None = None) -> DataFrame:
    """Keep-first append: rows that pass, added to what is there."""
    return existing.unionByName(append_report(new, key, order, existing, violation).where("_reason is null").drop("_reason"), allowMissingColumns=True)


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Full outer merge by key: the last non-null new value of each column wins, else the old one. Old rows without a key stay, new ones are added."""
    columns = [c for c in dict.fromkeys([*existing.columns, *new.columns]) if c not in (key, order)]
    latest = new.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("string").alias("_key")).agg(*[F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(order))).alias(f"_n_{c}") for c in columns if c in new.columns])
    old = existing.where(F.col(f"`{key}`").isNotNull()).withColumn("_key", F.col(f"`{key}`").cast("string"))
    both = old.join(latest, "_key", "full")
    merged = [F.coalesce(*([F.col(f"_n_{c}")] if c in new.columns else []), *([F.col(f"`{c}`")] if c in existing.columns else [])).alias(c) for c in columns]
    out = both.select(F.col("_key").alias(key), *merged)
    for df in (existing, new):
        without = df.where(F.col(f"`{key}`").isNull())
        out = out.unionAll(without.select(F.lit(None).cast("string").alias(key), *[F.col(f"`{c}`").cast(out.schema[c].dataType).alias(c) if c in df.columns else F.lit(None).cast(out.schema[c].dataType).alias(c) for c in columns]))
    return out


def patch(existing: DataFrame, patches: DataFrame, key: str, order: str) -> DataFrame:
    """Update only: of each id the last patch wins, its nulls too; ids that don't exist change nothing."""
    changed = [c for c in patches.columns if c not in (key, order)]
    last = keep_last(patches.where(F.col(key).isNotNull()), [key], [order]).select(F.col(key).cast("string").alias("_key"), *[F.col(f"`{c}`").alias(f"_p_{c}") for c in changed], F.lit(True).alias("_hit"))
    rows = left_join_by_key(existing.withColumn("_key", F.col(f"`{key}`").cast("string")), last)
    own = [F.when(F.col("_hit"), F.col(f"_p_{c}")).otherwise(F.col(f"`{c}`")).alias(c) if c in changed else F.col(f"`{c}`") for c in existing.columns]
    extra = [F.when(F.col("_hit"), F.col(f"_p_{c}")).alias(c) for c in changed if c not in existing.columns]
    return rows.select(*own, *extra)


def patch_counts(existing: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """One row: distinct patch ids that exist, those that don't, and the rows there are."""
    ids = patches.select(F.col(key).cast("string").alias("_key")).where("_key is not null").distinct()
    held = existing.select(F.col(key).cast("string").alias("_key")).where("_key is not null").distinct().withColumn("_held", F.lit(1))
    asked = ids.join(held, "_key", "left").select(F.coalesce("_held", F.lit(0)).alias("a"), (1 - F.coalesce("_held", F.lit(0))).alias("b"), F.lit(0).alias("c"))
    both = asked.unionAll(existing.select(F.lit(0), F.lit(0), F.lit(1)))
    return both.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in (("a", "n_patched"), ("b", "n_not_found"), ("c", "n_rows"))])


def merge_silver(bronze: DataFrame, silver: DataFrame, key: str, order: str, silver_wins_null: bool = True) -> DataFrame:
    """Left join on the id as text; of each id the last silver row overrides bronze, its nulls too unless told otherwise."""
    typed = [c for c in silver.columns if c not in (key, order)]
    last = keep_last(silver.where(F.col(key).isNotNull()), [key], [order]).select(F.col(key).cast("string").alias("_key"), *[F.col(f"`{c}`").alias(f"_s_{c}") for c in typed], F.lit(True).alias("_hit"))
    rows = left_join_by_key(bronze.withColumn("_key", F.col(f"`{key}`").cast("string")), last)

    def pick(c: str) -> Column:
        if c not in typed:
            return F.col(f"`{c}`")
        held = F.col("_hit") if silver_wins_null else F.col(f"_s_{c}").isNotNull()
        return F.when(held, F.col(f"_s_{c}")).otherwise(F.col(f"`{c}`")).alias(c)

    return rows.select(*[pick(c) for c in bronze.columns], *[F.col(f"_s_{c}").alias(c) for c in typed if c not in bronze.columns])


def scrub(df: DataFrame, drop: list[str] = (), rename: dict[str, str] | None = None, keep_only: list[str] | None = None, key: str = "id") -> DataFrame:
    """Brings typed rows along with an edited codebook."""
    out = df.drop(*drop).withColumnsRenamed(rename or {})
    return out if keep_only is None else out.select(*[c for c in out.columns if c == key or c in keep_only])


def canonical_names(observed: list[str], required: list[str]) -> dict[str, str]:
    """Observed name to required name, where a required name is not observed but a variant of it is."""
    from dsforge.operators.contracts import field_variants

    out = {}
    for name in required:
        if name not in observed:
            hit = next((v for v in field_variants(name) if v in observed and v != name), None)
            if hit:
                out[hit] = name
    return out


def signature(df: DataFrame, required: list[str]) -> Column:
    """What tells rows apart: the first required URL, else id, else first required field; rows without it by their content."""
    by_rank = [f for f in required if f == "url" or f.endswith("_url")] or [f for f in required if f.endswith(("_id", "_slug")) or f == "id"] or list(required[:1])
    content = F.concat(F.lit("row:"), canonical_json(df))
    if not by_rank or by_rank[0] not in df.columns:
        return content
    value = F.nullif(F.col(f"`{by_rank[0]}`").cast("string"), F.lit(""))
    return F.coalesce(F.concat(F.lit("pk:"), value), content)


def dedupe_new(existing: DataFrame, new: DataFrame, required: list[str], order: str) -> DataFrame:
    """New rows whose signature is neither among the existing rows nor that of an earlier new row."""
    held = existing.select(signature(existing, required).alias("_sig")).distinct()
    return keep_first(new.withColumn("_sig", signature(new, required)), ["_sig"], [order]).join(held, "_sig", "left_anti").drop("_sig")


def shape_overlap(a: list[str], b: list[str]) -> float:
    """Jaccard similarity of two sets of keys."""
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def shape_lock(existing: DataFrame, incoming: DataFrame, order: str, sample: int = 20, least: float = 0.5) -> DataFrame:
    """One row: the overlap of the keys that the first rows of both tables fill, and whether it is too small for the new rows to belong to the table."""

    def keys(df: DataFrame) -> list[str]:
        names = [c for c in df.columns if c != order and not c.startswith("_")]
        filled = df.orderBy(order).limit(sample).agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)]).first()
        return [c for c, n in zip(names, filled) if n]

    overlap = shape_overlap(keys(existing), keys(incoming))
    return existing.sparkSession.createDataFrame([(overlap, overlap < least)], "overlap double, refused boolean")


def fill_booleans(df: DataFrame, required: list[str]) -> DataFrame:
    """Required has_ and is_ columns with silence read as no; only where asked for."""
    kinds = dict(df.dtypes)
    names = [c for c in required if c in kinds and c.startswith(("has_", "is_"))]
    return df.withColumns({c: F.coalesce(F.col(c) if kinds[c] == "boolean" else F.nullif(F.col(c), F.lit("")).cast("boolean"), F.lit(False)) for c in names})


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def stratified_sample(df: DataFrame, k: int, order: str, seed: int = 42) -> DataFrame:
    """First and last row and the rest at random, in order: places are drawn on the driver from the count, rows picked by a join."""
    import random

    n = df.count()
    places = list(range(n)) if n <= k else sorted({0, n - 1, *random.Random(seed).sample(range(1, n - 1), max(0, k - 2))})
    numbered = numbered_rows(df, order)
    wanted = df.sparkSession.createDataFrame([(p,) for p in places], "_n long")
    return numbered.join(F.broadcast(wanted), "_n", "left_semi").orderBy("_n").drop("_n")


def numbered_rows(df: DataFrame, order: str, out: str = "_n") -> DataFrame:
    """Rows with their place by ``order``, from zero: range partitions are numbered each by itself and shifted by the sizes of those before."""
    # written once: the places must come from the same partitions as the sizes, also after a task is repeated
    parts = checkpoint(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition, so the window without partitions is small
    shifts = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return local.join(F.broadcast(shifts), "_part").withColumn(out, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")
