"""A work queue and paged harvesting as joins and windows: pending items are an anti-join, stop rules are running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dsforge.operators.rows import keep_first


def _ids(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").cast("string").alias("_key")).where("_key is not null").distinct()


def add(queue: DataFrame, processed: DataFrame, items: DataFrame, key: str, order: str) -> DataFrame:
    """Items with an id that is neither queued nor processed; of a repeated id the first."""
    new = keep_first(items.where(F.col(key).isNotNull()).withColumn("_key", F.col(key).cast("string")), ["_key"], [order])
    return new.join(_ids(queue, key), "_key", "left_anti").join(_ids(processed, key), "_key", "left_anti").drop("_key")


def pending(queue: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    return queue.withColumn("_key", F.col(key).cast("string")).join(_ids(processed, key), "_key", "left_anti").drop("_key")


def next_item(queue: DataFrame, processed: DataFrame, key: str, order: str) -> DataFrame:
    return pending(queue, processed, key).orderBy(order, key).limit(1)


def mark_done(processed: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return processed.select(F.col(key).cast("string").alias(key)).unionByName(ids.select(F.col(key).cast("string").alias(key))).distinct()


def status(queue: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """One row: total, processed and remaining items."""
    done = _ids(processed, key).withColumn("_done", F.lit(1))
    return queue.withColumn("_key", F.col(key).cast("string")).join(done, "_key", "left").agg(F.count(F.lit(1)).alias("n_total"), F.count("_done").alias("n_processed"), (F.count(F.lit(1)) - F.count("_done")).alias("n_remaining"))


def already_extracted(rows: DataFrame, silver: DataFrame, key: str) -> DataFrame:
    """Rows that the typed table already has: those to fill new variables into."""
    return rows.withColumn("_key", F.col(key).cast("string")).join(_ids(silver, key), "_key", "left_semi").drop("_key")


def pilot(rows: DataFrame, silver: DataFrame, order: str, size: int = 3) -> DataFrame:
    """The first few rows while nothing has been extracted, else all."""
    return rows.orderBy(order).limit(size) if silver.isEmpty() else rows


def sweep(items: DataFrame, page: str, place: str, key: str, known: DataFrame | None = None, target: int | None = None, max_pages: int | None = None, empty_pages: int = 2) -> DataFrame:
    """What a page-by-page harvest keeps: of each id the first item, up to the page that reaches the target or follows so many pages without a new one.

    Windows without partition run over one row per page only.
    """
    first = keep_first(items.where(F.col(key).isNotNull()).withColumn("_key", F.col(key).cast("string")), ["_key"], [page, place])
    if known is not None:
        first = first.join(_ids(known, key), "_key", "left_anti")
    pages = items.select(page).distinct().join(first.groupBy(page).agg(F.count(F.lit(1)).alias("_new")), page, "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    in_order = Window.orderBy(page)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, -1)
    lately = in_order.rowsBetween(-empty_pages, -1)
    pages = pages.withColumns({
        "_got": F.coalesce(F.sum("_new").over(so_far), F.lit(0)), "_nth": F.row_number().over(in_order),
        "_idle": F.sum(F.when(F.col("_new") == 0, 1).otherwise(0)).over(lately),
    })
    stop = F.col("_idle") >= empty_pages
    if target is not None:
        stop = stop | (F.col("_got") >= target)
    if max_pages is not None:
        stop = stop | (F.col("_nth") > max_pages)
    pages = pages.withColumn("_stopped", F.max(F.when(F.coalesce(stop, F.lit(False)), 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return first.join(pages.where("_stopped = 0").select(page), page).drop("_key")


def first_page(counts: dict[int, int]) -> int:
    """Where paging starts: at 1 if page 0 has no items and page 1 has."""
    return 1 if not counts.get(0) and counts.get(1) else 0


def pages_to_fetch(target: int, items_per_page: int | None, pages_needed: int | None = None, spare: int = 5, default: int = 20) -> int:
    if pages_needed:
        return pages_needed + spare
    return target // items_per_page + spare if items_per_page else default


def pagination_verdict(variants: DataFrame) -> Column:
    """Which way of paging works, by the digests of the page's variants: columns base, page0, page1, page2, p1, p2, offset."""
    d = lambda c: F.substring(F.sha1(F.col(c).cast("binary")), 1, 10)
    return (
        F.when(F.col("base").isNull(), "no_page")
        .when(F.col("page1").isNotNull() & (d("page1") != d("base")) & (F.col("page0").isNull() | (d("page0") == d("base"))), "page_from_0")
        .when(F.col("page2").isNotNull() & (d("page2") != d("base")) & (d("page1") == d("base")), "page_from_1")
        .when(F.col("p2").isNotNull() & (d("p2") != d("base")), "p_from_1")
        .when(F.col("p1").isNotNull() & (d("p1") != d("base")), "p_from_0")
        .when(F.col("offset").isNotNull() & (d("offset") != d("base")), "offset")
        .otherwise("single_page")
    )


def paging_variants(variants: DataFrame, key: str, names: tuple[str, ...] = ("base", "page0", "page1", "page2", "p1", "p2", "offset"), row_pattern: str | None = None) -> DataFrame:
    """(key, variant, n_chars, n_rows, same_as_first): what each way of asking for a page gave; rows are counted if a pattern is given. Variants that were not fetched are left out."""
    rows_of = (lambda c: F.regexp_count(c, F.lit("(?s)" + row_pattern))) if row_pattern else (lambda c: F.lit(None).cast("int"))
    cells = [F.struct(F.lit(n).alias("variant"), F.length(n).alias("n_chars"), rows_of(F.col(n)).cast("int").alias("n_rows"), (F.sha1(F.col(n).cast("binary")) == F.sha1(F.col(names[0]).cast("binary"))).alias("same_as_first")) for n in names if n in variants.columns]
    return variants.select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.*").where("n_chars is not null")


def rows_from_queue(queue: DataFrame, processed: DataFrame, key: str, required: list[str], order: str, drop_empty: bool = True, limit: int | None = None) -> DataFrame:
    """Pending items as rows: variants renamed to the required names, rows without any required value left out, at most ``limit`` in order."""
    from dsforge.operators.contracts import meaningful
    from dsforge.operators.rows import canonical_names

    rows = pending(queue, processed, key)
    rows = rows.withColumnsRenamed(canonical_names(rows.columns, required))
    kinds = dict(rows.dtypes)
    held = [c for c in required if c in kinds]
    if drop_empty and held:
        any_of = F.lit(False)
        for c in held:
            any_of = any_of | meaningful(F.col(f"`{c}`"), kinds[c])
        rows = rows.where(any_of)
    return rows if limit is None else rows.orderBy(order).limit(limit)
