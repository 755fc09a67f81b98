"""Statistics of typed tables, and windows over run histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dsforge.operators.contracts import covered, distinct_counts
from dsforge.plans.model import Codebook, VariableSpec

NUMBERS = ("int", "bigint", "smallint", "tinyint", "double", "float")


def _unpivot(one: DataFrame, names: list[str], fields: dict[str, str]) -> DataFrame:
    """One row of aggregates named <prefix><i> to one row per name."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), *[F.col(f"{p}{i}").alias(f) for f, p in fields.items()]) for i, n in enumerate(names)])).alias("x")).select("x.*")


def key_presence(rows: DataFrame, map_col: str) -> DataFrame:
    """(variable, n_present) of the keys of semi-structured rows; a key counts where it is present, even with null."""
    return rows.select(F.explode(F.map_keys(map_col)).alias("variable")).groupBy("variable").agg(F.count(F.lit(1)).alias("n_present"))


def field_coverage(df: DataFrame, names: list[str]) -> DataFrame:
    """(variable, n_rows, n_covered) in one pass."""
    kinds = dict(df.dtypes)
    aggs = [F.sum(F.when(covered(F.col(f"`{c}`"), kinds[c]), 1).otherwise(0)).cast("long").alias(f"c{i}") for i, c in enumerate(names)]
    one = df.agg(*aggs, F.count(F.lit(1)).alias("_rows")).select("*", *[F.col("_rows").alias(f"n{i}") for i in range(len(names))])
    return _unpivot(one, names, {"n_rows": "n", "n_covered": "c"})


def _with_distinct(long: DataFrame, counts: DataFrame, name: str, always: bool = False) -> DataFrame:
    """Both have a row per variable."""
    n = F.coalesce(F.col("n_unique"), F.lit(0)).cast("long")
    return long.join(F.broadcast(counts), "variable", "left").withColumn(name, n if always else F.when(F.col("_scalar"), n)).drop("_scalar", *({"n_unique"} - {name}))


def codebook_stats(df: DataFrame, codebook: Codebook, approximate: bool = False) -> DataFrame:
    """Per variable: rows, non-empty values, distinct scalars, least, greatest and mean number, share of true; ``approximate`` counts distinct values by sketches in the same pass."""
    kinds = dict(df.dtypes)
    variables = [v for v in codebook.variables if v.name in kinds]
    scalars = [v.name for v in variables if not kinds[v.name].startswith(("array", "struct", "map"))]
    aggs: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    for i, v in enumerate(variables):
        c, k = F.col(f"`{v.name}`"), kinds[v.name]
        has = covered(c, k)
        number = c.cast("double") if k in NUMBERS else F.lit(None).cast("double")
        aggs += [
            F.sum(F.when(has, 1).otherwise(0)).cast("long").alias(f"a{i}"), F.min(number).alias(f"c{i}"), F.max(number).alias(f"d{i}"), F.avg(number).alias(f"e{i}"),
            (F.avg(c.cast("double")) if k == "boolean" else F.lit(None).cast("double")).alias(f"f{i}"), F.lit(v.name in scalars).alias(f"s{i}"),
            *([(F.approx_count_distinct(F.when(has, c)) if v.name in scalars else F.lit(None).cast("long")).alias(f"b{i}")] if approximate else []),
        ]
    one = df.agg(*aggs).select("*", *[F.col("_rows").alias(f"n{i}") for i in range(len(variables))])
    fields = {"n_rows": "n", "n_non_null": "a", "min_value": "c", "max_value": "d", "mean_value": "e", "share_true": "f"}
    if approximate:
        return _unpivot(one, [v.name for v in variables], fields | {"n_distinct": "b"})
    given = df.select(*[F.when(covered(F.col(f"`{n}`"), kinds[n]), F.col(f"`{n}`")).alias(n) for n in scalars])
    return _with_distinct(_unpivot(one, [v.name for v in variables], fields | {"_scalar": "s"}), distinct_counts(given, scalars), "n_distinct")


def inferred_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """Statistics of columns no codebook describes: coverage, range, mean, sample deviation, distinct values, mean length, share of true."""
    kinds = dict(df.dtypes)
    aggs: list[Column] = []
    for i, c in enumerate(names):
        k, x = kinds[c], F.col(f"`{c}`")
        number = x.cast("double") if k in NUMBERS else F.lit(None).cast("double")
        aggs += [
            F.sum(F.when(covered(x, k), 1).otherwise(0)).cast("long").alias(f"a{i}"), F.min(number).alias(f"b{i}"), F.max(number).alias(f"c{i}"), F.avg(number).alias(f"d{i}"), F.stddev_samp(number).alias(f"e{i}"),
            (F.avg(F.length(x)) if k == "string" else F.lit(None).cast("double")).alias(f"g{i}"), (F.avg(x.cast("double")) if k == "boolean" else F.lit(None).cast("double")).alias(f"h{i}"), F.lit(k).alias(f"k{i}"),
        ]
    fields = {"type": "k", "n_non_null": "a", "min_value": "b", "max_value": "c", "mean_value": "d", "sd_value": "e", "mean_length": "g", "share_true": "h"}
    return _with_distinct(_unpivot(df.agg(*aggs), names, fields), distinct_counts(df, names), "n_unique", always=True)


def infer_codebook(df: DataFrame, name: str = "inferred") -> Codebook:
    """A codebook from the table's own types; columns of text that hold only booleans or numbers are typed by what they hold."""
    kinds = dict(df.dtypes)
    texts = [c for c, k in kinds.items() if k == "string" and not c.startswith("_")]
    facts = {}
    if texts:
        given = {c: F.nullif(F.col(f"`{c}`"), F.lit("")) for c in texts}
        one = df.agg(*[x for i, c in enumerate(texts) for x in (
            F.count(given[c]).alias(f"n{i}"), F.min(given[c].isin("true", "false")).alias(f"b{i}"), F.min(given[c].rlike(r"^-?\d+$")).alias(f"i{i}"), F.min(given[c].rlike(r"^-?\d+(\.\d+)?$")).alias(f"f{i}"),
        )]).first()
        facts = {c: (one[f"n{i}"], one[f"b{i}"], one[f"i{i}"], one[f"f{i}"]) for i, c in enumerate(texts)}
    made = []
    for c, k in kinds.items():
        if c.startswith("_"):
            continue
        if k == "string":
            n, is_bool, is_int, is_float = facts[c]
            kind = "string" if not n else "boolean" if is_bool else "integer" if is_int else "float" if is_float else "string"
        else:
            kind = {"boolean": "boolean", "int": "integer", "bigint": "integer", "smallint": "integer", "tinyint": "integer", "double": "float", "float": "float", "date": "date"}.get(k, "array" if k.startswith("array") else "string")
        made.append(VariableSpec(c, kind, item_schema={"type": "string"} if kind == "array" else None))
    return Codebook(name, made)


def validate_extras(df: DataFrame, codebook: Codebook, low: float = 0.2, constant: float = 0.98) -> DataFrame:
    """(variable, issue) by thresholds of our own: low coverage, near-constant boolean, enum of a single value."""
    stats = codebook_stats(df, codebook)
    kinds = df.sparkSession.createDataFrame([(v.name, v.type) for v in codebook.variables], "variable string, type string")
    rated = stats.join(F.broadcast(kinds), "variable")
    issue = F.array_compact(F.array(
        F.when(F.col("n_non_null") < low * F.col("n_rows"), F.lit("low coverage")),
        F.when((F.col("type") == "boolean") & ((F.col("share_true") >= constant) | (F.col("share_true") <= 1 - constant)), F.lit("near-constant boolean")),
        F.when((F.col("type") == "enum") & (F.col("n_distinct") == 1), F.lit("single-value enum")),
    ))
    return rated.select("variable", F.explode(issue).alias("issue"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def top_frequencies(df: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The most frequent values; of equally frequent ones the first seen comes first."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first").limit(n).drop("_first")


def pilot_verdict(stats: DataFrame) -> DataFrame:
    """One row: whether a pilot extraction is good enough to scale."""
    one = stats.agg(F.max("n_rows").alias("n"), F.avg(F.col("n_non_null") / F.col("n_rows")).alias("mean_coverage"), F.sum((F.col("n_non_null") == 0).cast("int")).alias("n_zero"), F.count(F.lit(1)).alias("n_variables"))
    verdict = F.when(F.coalesce("n", F.lit(0)) == 0, "FIX_FIRST").when(F.col("mean_coverage") < 0.1, "FIX_BRONZE_FIRST").when((F.col("mean_coverage") < 0.4) | (F.col("n_zero") >= F.greatest(F.lit(3), F.floor(F.col("n_variables") / 4))), "FIX_FIRST").otherwise("SCALE_OK")
    return one.select("mean_coverage", "n_zero", verdict.alias("verdict"))


# ---- windows over a run's history: one partition per run


def history_tail(df: DataFrame, run: str, order: str, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def repeated_calls(df: DataFrame, run: str, order: str, call: Column, within: int = 5, times: int = 3, compared: int | None = None) -> DataFrame:
    """Rows whose call occurs so many times among the run's last ``within`` ones; calls are compared whole, or by their first ``compared`` characters."""
    last = F.collect_list("_call").over(Window.partitionBy(run).orderBy(order).rowsBetween(-(within - 1), 0))
    seen = df.withColumn("_call", call if compared is None else F.substring(call, 1, compared)).withColumn("_last", last)
    return seen.withColumn("n_repeats", F.size(F.filter("_last", lambda x: x == F.col("_call")))).where(F.col("n_repeats") >= times).drop("_call", "_last")


def repeated_failures(df: DataFrame, run: str, order: str, tool: str, failed: Column, within: int = 8, times: int = 3) -> DataFrame:
    """(run, order, tool, n_failures) where the row's tool failed so often among the run's last ``within`` rows."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(-(within - 1), 0)
    seen = df.withColumn("_f", F.collect_list(F.when(failed, F.col(tool))).over(w))
    return seen.withColumn("n_failures", F.size(F.filter("_f", lambda x: x == F.col(tool)))).where(F.col("n_failures") >= times).select(run, order, tool, "n_failures")


def churn(df: DataFrame, run: str, order: str, value: str, flips: int = 2, tail: int = 6) -> DataFrame:
    """(run, n_flips) of runs whose row count, over its last ``tail`` distinct steps, changed direction so often."""
    w = Window.partitionBy(run).orderBy(order)
    steps = df.withColumn("_prev", F.lag(value).over(w)).where(F.col("_prev").isNull() | (F.col("_prev") != F.col(value)))
    last = steps.withColumn("_r", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(order)))).where(F.col("_r") <= tail)
    turn = last.withColumn("_d", F.signum(F.col(value) - F.lag(value).over(w))).withColumn("_e", F.lag("_d").over(w))
    out = turn.groupBy(run).agg(F.sum(F.when(F.col("_d") != F.col("_e"), 1).otherwise(0)).cast("long").alias("n_flips"), F.count(F.lit(1)).alias("_n"))
    return out.where((F.col("_n") >= 5) & (F.col("n_flips") >= flips)).select(run, "n_flips")


def consecutive(df: DataFrame, run: str, order: str, hit: Column, out: str = "n_consecutive") -> DataFrame:
    """How many hits in a row end at each row; zero where there is none."""
    w = Window.partitionBy(run).orderBy(order)
    islands = df.withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("int")).withColumn("_island", F.sum(1 - F.col("_hit")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.withColumn(out, F.sum("_hit").over(Window.partitionBy(run, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_hit", "_island")


def no_progress(df: DataFrame, run: str, order: str, n_rows: str, turns: int = 10) -> DataFrame:
    """(run, n_turns) of runs that took so many turns and have no row at the last of them."""
    one = df.groupBy(run).agg(F.count(F.lit(1)).alias("n_turns"), F.max_by(n_rows, order).alias("_n"))
    return one.where((F.col("n_turns") >= turns) & (F.coalesce("_n", F.lit(0)) == 0)).select(run, "n_turns")


def dataset_validate(df: DataFrame, codebook: Codebook | None = None) -> DataFrame:
    """(variable, fact, value) of a table, as a rule the joined view: coverage of every variable, the range of dates, the values of enums with their shares, and issues."""
    book = codebook or infer_codebook(df)
    kinds = dict(df.dtypes)
    stats = codebook_stats(df, book)
    text = lambda c: F.format_string("%.8f", c)
    out = stats.select("variable", F.lit("coverage").alias("fact"), text(F.when(F.col("n_rows") > 0, F.col("n_non_null") / F.col("n_rows")).otherwise(0.0)).alias("value"))
    dates = [v.name for v in book.variables if v.type == "date" and v.name in kinds]
    if dates:
        one = df.agg(*[f(F.nullif(F.col(f"`{d}`").cast("string"), F.lit(""))).alias(f"{n}{i}") for i, d in enumerate(dates) for n, f in (("a", F.min), ("b", F.max))])
        cells = [F.struct(F.lit(d).alias("variable"), F.lit(n).alias("fact"), F.col(f"{x}{i}").alias("value")) for i, d in enumerate(dates) for n, x in (("first date", "a"), ("last date", "b"))]
        out = out.unionAll(one.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("value is not null"))
    enums = [v.name for v in book.variables if v.type == "enum" and v.name in kinds]
    if enums:
        cells = [F.struct(F.lit(e).alias("variable"), F.nullif(F.col(f"`{e}`").cast("string"), F.lit("")).alias("v")) for e in enums]
        n = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("v is not null").groupBy("variable", "v").agg(F.count(F.lit(1)).alias("n"))
        share = n.join(F.broadcast(n.groupBy("variable").agg(F.sum("n").alias("_all"))), "variable")  # one row per enum
        out = out.unionAll(share.select("variable", F.concat(F.lit("value "), "v"), text(F.col("n") / F.col("_all"))))
    return out.unionAll(validate_extras(df, book).select("variable", F.lit("issue"), "issue"))


def trace_summary(df: DataFrame, tool: str, failed: Column) -> DataFrame:
    return df.groupBy(tool).agg(F.count(F.lit(1)).alias("n_calls"), F.sum(F.when(failed, 1).otherwise(0)).cast("long").alias("n_failed"))
