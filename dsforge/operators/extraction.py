"""Typed extraction: texts go through a pluggable extractor, its loose answers through the codebook's coercion, what fails into quarantine."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsforge.functions import tolerant_json
from dsforge.functions.coerce import coerce_row
from dsforge.functions.text import truncate
from dsforge.operators.rows import keep_first
from dsforge.plans.model import Codebook


class Extractor(Protocol):
    """Answers a text with (something that holds) a JSON object of loose values; it travels to the executors, so it must pickle."""

    def __call__(self, text: str) -> str: ...


@dataclass
class RuleExtractor:
    """The deterministic extractor: one pattern per variable, its first group is the value."""

    patterns: dict[str, str]

    def __call__(self, text: str) -> str:
        found = {}
        for name, pattern in self.patterns.items():
            if m := re.search(pattern, text, re.S):
                found[name] = m[1] if m.re.groups else m[0]
        return json.dumps(found, ensure_ascii=False)


@dataclass
class RetryingExtractor:
    """Wraps an extractor that may fail for a while: so many tries, waits that double up to a bound, other errors pass at once."""

    inner: Extractor
    tries: int = 3
    wait: float = 1.0
    longest: float = 30.0
    transient: tuple[type[Exception], ...] = field(default=(TimeoutError, ConnectionError))

    def __call__(self, text: str) -> str:
        import time

        for k in range(self.tries):
            try:
                return self.inner(text)
            except self.transient:
                if k + 1 == self.tries:
                    raise
                time.sleep(min(self.longest, self.wait * 2**k))
        raise RuntimeError("no try was made")


def extract(df: DataFrame, codebook: Codebook, extractor: Extractor, key: str, text: str, max_chars: int | None = None) -> DataFrame:
    """(key, variables, _warnings, _error): one typed row per text; a failed answer is a row of nulls with its error and raw answer cut to 2000 characters.

    Columns the extractor doesn't need never reach Python. Texts go in whole; ``max_chars`` cuts them for extractors with a context limit.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [v.name for v in codebook.variables]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, t in zip(pdf["_k"], pdf["_t"]):
                raw = ""
                try:
                    raw = extractor(t) if t is not None else ""
                    value = tolerant_json.parse_object(raw)
                    error = None if value is not None else f"no object in: {raw[:2000]}"
                except Exception as e:  # noqa: BLE001 - one bad item must not end the job
                    value, error = None, f"{type(e).__name__}: {e}"[:2000]
                value = value or {}
                loose = {n: x if x is None or isinstance(x, str) else "; ".join(map(str, x)) if isinstance(x, list) else str(x) for n, x in value.items()}
                rows.append((k, {n: loose[n] for n in names if loose.get(n) is not None}, error))
            yield pd.DataFrame(rows, columns=["_k", "_v", "_error"])

    texts = df.select(F.col(key).alias("_k"), (F.col(text) if max_chars is None else truncate(F.col(text), max_chars)).alias("_t"))
    loose = texts.mapInPandas(run, f"_k {kind}, _v map<string,string>, _error string")
    wide = loose.select(F.col("_k").alias(key), "_error", *[F.try_element_at("_v", F.lit(n)).alias(n) for n in names])
    return coerce_row(wide, codebook, keep=[key, "_error"])


def quarantine(extracted: DataFrame, key: str) -> DataFrame:
    return extracted.where("_error is not null").select(key, F.col("_error").alias("error"))


def extract_missing(bronze: DataFrame, silver: DataFrame, codebook: Codebook, extractor: Extractor, key: str, text: str, least_chars: int = 200, least_fields: int = 3) -> DataFrame:
    """Extraction of the rows that the typed table lacks, with ``_extract_status``: rows of enough text go in by it, rows of enough structured fields by their fields as lines,
    the others come out as ``no_text`` with nulls, so no row is lost. The filters come before the extractor."""
    from dsforge.operators.inspection import row_text, text_gate

    done = silver.where("_extract_status = 'ok'") if "_extract_status" in silver.columns else silver
    held = done.select(F.col(key).cast("string").alias("_key")).where("_key is not null").distinct()
    todo = bronze.withColumn("_key", F.col(key).cast("string")).join(held, "_key", "left_anti")
    own = [c for c in bronze.columns if not c.startswith("_") and c not in (key, text)]
    fields = todo.select(*own)
    rated = text_gate(todo.withColumn("_text", F.when(F.length(text) >= least_chars, F.col(text)).otherwise(row_text(fields) if own else F.lit(None).cast("string"))), F.col(text), own, least_chars, least_fields)
    ok = rated.where("_extract_status = 'ok'").select(key, "_text")
    out = extract(ok, codebook, extractor, key, "_text").withColumn("_extract_status", F.lit("ok"))
    return out.unionByName(rated.where("_extract_status != 'ok'").select(key, "_extract_status"), allowMissingColumns=True)


def fill_new(bronze: DataFrame, silver: DataFrame, codebook: Codebook, new: list[str], extractor: Extractor, key: str, text: str) -> DataFrame:
    """New variables for the rows the typed table has, laid over what it holds."""
    from dsforge.operators.queueing import already_extracted

    part = Codebook(codebook.name, [v for v in codebook.variables if v.name in new])
    fresh = extract(already_extracted(bronze, silver, key), part, extractor, key, text).drop("_error", "_warnings")
    renamed = fresh.select(F.col(key).cast("string").alias("_key"), *[F.col(n).alias(f"_f_{n}") for n in new])
    rows = silver.withColumn("_key", F.col(key).cast("string")).join(renamed, "_key", "left")
    kept = [F.col(f"`{c}`") for c in silver.columns if c not in new]
    return rows.select(*kept, *[F.col(f"_f_{n}").alias(n) for n in new])


def scrape(pages: DataFrame, extractor: Extractor, html: str, key: str, fields: list[str], size: int, target: int | None = None) -> DataFrame:
    """Rows out of pages without a spec: chrome off, cut in pieces, each piece through the extractor, equal rows once, the first ``target`` in page order."""
    from dsforge.functions.text import chunk_html, strip_chrome

    pieces = pages.select(F.col(key).alias("_page"), F.posexplode(chunk_html(strip_chrome(F.col(html)), size)).alias("_piece", "_t"))
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for page, piece, t in zip(pdf["_page"], pdf["_piece"], pdf["_t"]):
                for i, row in enumerate(tolerant_json.parse_rows(extractor(t))):
                    out.append((page, piece, i, [None if row.get(f) is None else str(row[f]) for f in fields]))
            yield pd.DataFrame(out, columns=["_page", "_piece", "_i", "_v"])

    rows = pieces.mapInPandas(run, f"_page {kind}, _piece int, _i int, _v array<string>").select("_page", "_piece", "_i", *[F.col("_v")[i].alias(f) for i, f in enumerate(fields)])
    first = keep_first(rows, fields, ["_page", "_piece", "_i"])
    return first if target is None else first.orderBy("_page", "_piece", "_i").limit(target)
