"""Typed Parquet, JSONL and a data card."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dsforge.functions.coerce import to_boolean
from dsforge.operators.profiling import codebook_stats, infer_codebook
from dsforge.operators.rows import merge_silver
from dsforge.plans.model import Codebook, VariableSpec
from dsforge.sources.files import file_system, write_bytes


def export_column(c: Column, kind: str, var: VariableSpec) -> Column:
    """A column as its type on disk; what does not fit is null. Dates become dates, a single value in a list of records becomes the record's first field."""
    if var.type == "date":
        text = c.cast("string")
        return F.when(text.rlike(r"^.{4}-.{2}-.{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    if var.type == "boolean":
        return c if kind == "boolean" else to_boolean(c, kind)
    if var.type == "integer":
        return c.try_cast("double").try_cast("long") if kind == "string" else c.try_cast("long")
    if var.type == "float":
        return c.try_cast("double")
    if var.type == "array":
        target = var.spark_type()
        if kind.startswith("array<struct") or not target.simpleString().startswith("array<struct"):
            return c.cast(target) if kind.startswith("array") else F.when(c.isNotNull(), F.array(c.cast("string")))
        first = target.elementType.fields[0].name
        items = c if kind.startswith("array") else F.array(c)
        return F.transform(items, lambda x: F.struct(*[(x.cast(f.dataType) if f.name == first else F.lit(None).cast(f.dataType)).alias(f.name) for f in target.elementType.fields]))
    return c.cast("string")


def typed(df: DataFrame, codebook: Codebook, extra: list[str] = ()) -> DataFrame:
    """The codebook's columns in their types on disk, then other columns as text; a name is never taken twice."""
    kinds = dict(df.dtypes)
    names = {v.name for v in codebook.variables}
    own = [(export_column(F.col(f"`{v.name}`"), kinds[v.name], v) if v.name in kinds else F.lit(None).cast(v.spark_type())).alias(v.name) for v in codebook.variables]
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in extra if c in kinds and c not in names], *own)


def write_parquet(df: DataFrame, codebook: Codebook, path: str, extra: list[str] = ()) -> None:
    typed(df, codebook, extra).write.mode("overwrite").option("compression", "snappy").parquet(path)


def data_card(codebook: Codebook, stats: list[dict], n_rows: int, source_url: str | None = None) -> str:
    """A Markdown card: front matter, what the table holds, its variables with coverage."""
    cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    by_name = {s["variable"]: s for s in stats}
    lines = ["---", f"name: {codebook.name}", f"rows: {n_rows}", f"variables: {len(codebook.variables)}", "---", "", f"# {codebook.name}", "", codebook.description, ""]
    if codebook.domain:
        lines += [f"Domain: {codebook.domain}", ""]
    if source_url:
        lines += [f"Source: {source_url}", ""]
    lines += ["| variable | type | coverage | description |", "|-|-|-|-|"]
    for v in codebook.variables:
        s = by_name.get(v.name)
        share = f"{s['n_non_null'] / s['n_rows']:.0%}" if s and s["n_rows"] else "-"
        lines.append(f"| {cell(v.name)} | {v.type} | {share} | {cell(v.description)} |")
    notes = [f"- {v.name}: {'; '.join(v.adversary_notes)}" for v in codebook.variables if v.adversary_notes]
    return "\n".join(lines + (["", "## Notes", *notes] if notes else [])) + "\n"


def export_dataset(bronze: DataFrame, silver: DataFrame | None, codebook: Codebook | None, out_dir: str, key: str = "id", order: str = "_ord", source_url: str | None = None) -> dict[str, str]:
    """All artefacts of a dataset: merged and typed Parquet, merged, raw and typed JSONL, the codebook and its card. Gives their paths."""
    merged = (merge_silver(bronze, silver, key, order) if silver is not None else bronze).persist()
    try:
        book = codebook or infer_codebook(silver if silver is not None else bronze)
        name = book.name or "dataset"
        at = {k: os.path.join(out_dir, v) for k, v in {"parquet": f"{name}.parquet", "merged": "merged.jsonl", "raw": "raw.jsonl", "typed": "typed.jsonl", "typed_parquet": f"{name}_typed.parquet", "codebook": "codebook.json", "card": "codebook.md"}.items()}
        names = {v.name for v in book.variables}
        write_parquet(merged, book, at["parquet"], [c for c in merged.columns if not c.startswith("_") and c not in names])
        merged.write.mode("overwrite").json(at["merged"])
        bronze.write.mode("overwrite").json(at["raw"])
        if silver is not None:
            silver.write.mode("overwrite").json(at["typed"])
            write_parquet(silver, book, at["typed_parquet"], [key])
        stats = [r.asDict() for r in codebook_stats(merged, book).collect()]
        texts = {at["codebook"]: json.dumps(book.to_dict(), ensure_ascii=False, indent=2), at["card"]: data_card(book, stats, merged.count(), source_url), os.path.join(out_dir, "stats.json"): json.dumps(stats)}
        for path, text in texts.items():
            write_bytes(path, text.encode())
    finally:
        merged.unpersist()
    return at


def push_source(out_dir: str, name: str) -> str | None:
    """What a publisher should take: the codebook's Parquet, else any Parquet, else JSONL."""
    from pyarrow.fs import FileSelector

    fs, at = file_system(out_dir)
    found = sorted(x.base_name for x in fs.get_file_info(FileSelector(at, allow_not_found=True)))
    for pick in ([f for f in found if f == f"{name}.parquet"], [f for f in found if f.endswith(".parquet")], [f for f in found if f.endswith(".jsonl")]):
        if pick:
            return os.path.join(out_dir, pick[0])
    return None
