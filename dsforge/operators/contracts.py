"""Contracts: assertions on a table that compile to aggregates, all of a book in one pass."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# What may stand before and after a noun that counts something.
COUNT_BEFORE = ["n", "num", "number_of", "nb"]
COUNT_AFTER = ["count", "total", "num", "number"]
_BARE = re.compile(r"^(?:n|num|number_of|nb|count_of|amount_of)_|_(?:count|total|amount|num|number)$")


def field_variants(name: str) -> list[str]:
    """Names that a field may go by, in fixed order: as given, in snake case, as a bare noun, and the last two with every count word before or after."""
    given = name.strip()
    snake = re.sub(r"\W+", "_", given.lower()).strip("_")
    nouns = [snake, _BARE.sub("", snake).strip("_") or snake]
    shapes = ["{}", *[p + "_{}" for p in COUNT_BEFORE], *["{}_" + p for p in COUNT_AFTER]]
    return list(dict.fromkeys(v for v in [given, *(shape.format(n) for shape in shapes for n in nouns)] if v))


def meaningful(c: Column, kind: str = "string") -> Column:
    """Not null, not blank, not an empty list or map; zero and false do count."""
    if kind == "string":
        return c.isNotNull() & F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))
    if kind.startswith(("array", "map")):
        return c.isNotNull() & (F.coalesce(F.size(c), F.lit(0)) > 0)
    return c.isNotNull()


def covered(c: Column, kind: str = "string") -> Column:
    """Not null and not the empty string; white space counts."""
    return c.isNotNull() & (c != "") if kind == "string" else c.isNotNull()


def any_variant(df: DataFrame, name: str) -> Column:
    kinds = dict(df.dtypes)
    out = F.lit(False)
    for v in field_variants(name):
        if v in kinds:
            out = out | meaningful(F.col(f"`{v}`"), kinds[v])
    return out


@dataclass
class Contract:
    """A named check: aggregates over the table, and the verdict from their values."""

    name: str
    aggregates: Callable[[DataFrame], dict[str, Column]]
    judge: Callable[[dict], tuple[bool, str]]
    required_fields: list[str] = field(default_factory=list)
    locked: bool = False
    #: Columns whose distinct values the verdict needs, given to it as ``distinct:<column>``.
    distinct: list[str] = field(default_factory=list)


def min_rows(n: int) -> Contract:
    return Contract("min_rows", lambda df: {"rows": F.count(F.lit(1))}, lambda v: (v["rows"] >= n, f"{v['rows']} of {n} rows"))


def required(fields: list[str]) -> Contract:
    def judge(v: dict) -> tuple[bool, str]:
        missing = {f: v[f] or 0 for f in fields if v[f]}
        return not missing, "all present" if not missing else "missing: " + ", ".join(f"{f} in {n} rows" for f, n in missing.items())

    return Contract("fields", lambda df: {f: F.sum(F.when(any_variant(df, f), 0).otherwise(1)) for f in fields}, judge, list(fields))


def unique_field(name: str) -> Contract:
    def judge(v: dict) -> tuple[bool, str]:
        n = v["given"] - v[f"distinct:{name}"]
        return n == 0, f"{n} repeated values of {name}"

    return Contract(f"unique:{name}", lambda df: {"given": F.count(F.col(f"`{name}`"))}, judge, distinct=[name])


def distinct_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(variable, n_unique): values are grouped first, then counted, so a column's rows are combined before they meet."""
    cells = F.array(*[F.struct(F.lit(n).alias("variable"), F.col(f"`{n}`").cast("string").alias("v")) for n in names])
    long = df.select(F.explode(cells).alias("x")).select("x.*").where("v is not null")
    return long.groupBy("variable", "v").agg(F.lit(1).alias("_")).groupBy("variable").agg(F.count(F.lit(1)).alias("n_unique"))


def coverage(variables: list[str], least: float = 0.5) -> Contract:
    def aggregates(df: DataFrame) -> dict[str, Column]:
        kinds = dict(df.dtypes)
        return {"rows": F.count(F.lit(1))} | {f"c_{v}": F.sum(F.when(covered(F.col(f"`{v}`"), kinds[v]), 1).otherwise(0)) if v in kinds else F.lit(0) for v in variables}

    def judge(v: dict) -> tuple[bool, str]:
        if not v["rows"]:
            return False, "no rows"
        low = [x for x in variables if (v[f"c_{x}"] or 0) / v["rows"] < least]
        return not low, "all covered" if not low else "low coverage: " + ", ".join(low[:5])

    return Contract("coverage", aggregates, judge)


def codebook_contract(codebook, least: int = 20, ratio: float = 0.5) -> Contract:
    """Of a codebook, not of rows: enough variables, enough of them numeric or boolean."""
    n = len(codebook.variables) if codebook else 0
    r = codebook.numeric_or_boolean_ratio() if codebook else 0.0
    return Contract("codebook", lambda df: {}, lambda v: (n >= least and r >= ratio, f"{n} of {least} variables, ratio {r:.2f} of {ratio}"))


def custom(name: str, aggregates: Callable[[DataFrame], dict[str, Column]], judge: Callable[[dict], tuple[bool, str]]) -> Contract:
    return Contract(name, aggregates, judge)


class ContractBook:
    """Contracts by name; locked ones can't be replaced or removed."""

    def __init__(self) -> None:
        self.contracts: dict[str, Contract] = {}

    def add(self, contract: Contract) -> None:
        held = self.contracts.get(contract.name)
        if held is not None and held.locked:
            raise PermissionError(f"contract {contract.name!r} is locked")
        self.contracts[contract.name] = contract

    def remove(self, name: str) -> None:
        if name in self.contracts and self.contracts[name].locked:
            raise PermissionError(f"contract {name!r} is locked")
        self.contracts.pop(name, None)

    def locked_fields(self) -> set[str]:
        return {f for c in self.contracts.values() if c.locked for f in c.required_fields}

    def check(self, df: DataFrame) -> list[tuple[str, bool, str]]:
        """(name, ok, detail) of every contract; all their aggregates run as one query, all their distinct counts as another."""
        wanted = {f"{i}|{k}": c for i, x in enumerate(self.contracts.values()) for k, c in x.aggregates(df).items()}
        got = df.agg(*[c.alias(f"a{j}") for j, c in enumerate(wanted.values())]).first() if wanted else ()
        values: dict[int, dict] = {}
        for key, v in zip(wanted, got):
            i, k = key.split("|", 1)
            values.setdefault(int(i), {})[k] = v
        names = list(dict.fromkeys(n for x in self.contracts.values() for n in x.distinct))
        distinct = {f"distinct:{n}": 0 for n in names} | ({f"distinct:{r.variable}": r.n_unique for r in distinct_counts(df, names).collect()} if names else {})
        values = {i: values.get(i, {}) | distinct for i in range(len(self.contracts))}
        return [(x.name, *x.judge(values.get(i, {}))) for i, x in enumerate(self.contracts.values())]

    def status(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(self.check(df), "name string, ok boolean, detail string")

    def all_satisfied(self, df: DataFrame) -> bool:
        return all(ok for _, ok, _ in self.check(df))


def low_cardinality(df: DataFrame, fields: list[str], order: str, least_rows: int = 10, share: float = 0.6, longest: int = 80, compared: int | None = None) -> DataFrame:
    """(field, mode, n_mode, n_populated) of required fields whose most frequent value fills most rows; of equally frequent ones the first seen. Values are compared whole, or by their first ``compared`` characters."""
    text = lambda v: F.col(f"`{v}`").cast("string") if compared is None else F.substring(F.col(f"`{v}`").cast("string"), 1, compared)
    values = [F.struct(F.lit(f).alias("f"), F.coalesce(*[F.when(meaningful(F.col(f"`{v}`"), k), text(v)) for v in field_variants(f) for n, k in df.dtypes if n == v], F.lit(None).cast("string")).alias("v")) for f in fields]
    long = df.select(F.col(order).alias("_o"), F.explode(F.array(*values)).alias("x")).select("_o", F.col("x.f").alias("field"), F.col("x.v").alias("value")).where("value is not null")
    by_value = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("first"))
    top = by_value.groupBy("field").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("mode"), F.max("n").alias("n_mode"), F.sum("n").alias("n_populated"))
    return top.where((F.col("n_populated") >= least_rows) & (F.col("n_mode") >= share * F.col("n_populated")) & (F.length("mode") <= longest))


def _json_kind(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.NumericType):
        return "number"
    return "array" if isinstance(kind, T.ArrayType) else "object" if isinstance(kind, (T.StructType, T.MapType)) else "string"


def violation(schema: dict, c: Column, kind: T.DataType, path: Column) -> Column:
    """The first violation of a JSON Schema by a column, as text, or null: types, enums, objects with their required and other properties, arrays with their items, at every depth."""
    said = lambda x: F.concat(path, F.lit(x))
    types = schema.get("type")
    types = [types] if isinstance(types, str) else types
    own = _json_kind(kind)
    checks: list[Column] = [F.lit(None).cast("string")]
    if types:
        fits = own in types or (own in ("integer", "boolean") and ("number" in types or "integer" in types))
        null = F.lit(None).cast("string") if "null" in types else said(f": expected {'/'.join(types)}, got null")
        checks.append(F.when(c.isNull(), null).otherwise(F.lit(None).cast("string") if fits else said(f": expected {'/'.join(types)}, got {own}")))
    if "enum" in schema:
        allowed = [str(v) for v in schema["enum"] if v is not None]
        checks.append(F.when(c.isNotNull() & ~c.cast("string").isin(*allowed), said(": not one of the allowed values")))
    if isinstance(kind, T.StructType) and (not types or "object" in types):
        held = {f.name: f.dataType for f in kind}
        for r in schema.get("required", []):
            checks.append(F.when(c.isNotNull() & c[r].isNull(), said(f".{r}: required")) if r in held else F.when(c.isNotNull(), said(f".{r}: required")))
        for name, sub in schema.get("properties", {}).items():
            if name in held:  # a property of null is skipped
                checks.append(F.when(c[name].isNotNull(), violation(sub, c[name], held[name], said(f".{name}"))))
    if isinstance(kind, T.ArrayType) and schema.get("items") and (not types or "array" in types):
        found = F.transform(c, lambda x, i: violation(schema["items"], x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        checks.append(F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)))
    return F.coalesce(*checks)


def row_violation(schema: dict, df: DataFrame) -> Column:
    """The first violation by a row: required columns first, then properties in the schema's order; a property of null is skipped."""
    kinds = {f.name: f.dataType for f in df.schema}
    checks = [F.when(F.col(f"`{r}`").isNull(), F.lit(f"$.{r}: required")) if r in kinds else F.lit(f"$.{r}: required") for r in schema.get("required", [])]
    for name, sub in schema.get("properties", {}).items():
        if name in kinds:
            c = F.col(f"`{name}`")
            checks.append(F.when(c.isNotNull(), violation(sub, c, kinds[name], F.lit(f"$.{name}"))))
    return F.coalesce(*checks, F.lit(None).cast("string"))


def row_quality(df: DataFrame, fields: list[str]) -> Column:
    """Share of the required fields with a meaningful variant."""
    return sum((any_variant(df, f).cast("int") for f in fields), F.lit(0)) / F.lit(float(len(fields) or 1))


def quality_gate(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row: mean quality, share of rows without anything, verdict."""
    q = df.agg(F.avg(row_quality(df, fields)).alias("mean_quality"), F.avg((row_quality(df, fields) == 0).cast("double")).alias("share_empty"))
    return q.withColumn("verdict", F.when(F.col("share_empty") >= 0.8, "reject").when(F.col("mean_quality") < 0.5, "warn").otherwise("ok"))


def finish(results: list[tuple[str, bool, str]], force: bool = False) -> tuple[bool, str]:
    """Whether a run may end, and how: done, partial (rows are enough, other contracts fail), forced or not yet."""
    failing = [n for n, ok, _ in results if not ok]
    if not failing:
        return True, "done"
    if force:
        return True, "forced: " + ", ".join(failing)
    rows_ok = all(ok for n, ok, _ in results if n == "min_rows") and any(n == "min_rows" for n, _, _ in results)
    return False, ("partial: " if rows_ok else "not yet: ") + ", ".join(failing)


def sparse_fields(df: DataFrame, least: float = 0.7) -> DataFrame:
    """(field, share) of columns present in fewer rows than that; names that begin with an underscore are internal."""
    names = [c for c in df.columns if not c.startswith("_")]
    shares = df.agg(*[F.avg(F.col(f"`{c}`").isNotNull().cast("double")).alias(f"s{i}") for i, c in enumerate(names)])
    long = shares.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"s{i}").alias("share")) for i, c in enumerate(names)])).alias("x")).select("x.*")
    return long.where(F.col("share") < least)
