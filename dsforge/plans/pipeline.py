"""From listing pages to an exported dataset: the operators in the order a run takes them, each step a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsforge.operators import contracts, extraction, inspection, profiling, queueing, rows
from dsforge.plans.control import RunState, current_phase
from dsforge.plans.model import Codebook
from dsforge.plans.spec import Spec
from dsforge.sources import export
from dsforge.sources.fetch import fetch_saved


class Dataset:
    """A table with a unique key, changed by whole batches; ``_ord`` is the order rows came in."""

    def __init__(self, df: DataFrame, key: str = "id", schema: dict | None = None):
        self.df, self.key, self.schema = df, key, schema

    def append(self, new: DataFrame) -> DataFrame:
        """Adds the rows that pass and gives the report of all."""
        violation = contracts.row_violation(self.schema, new) if self.schema else None
        report = rows.append_report(new, self.key, "_ord", self.df, violation)
        self.df = self.df.unionByName(report.where("_reason is null").drop("_reason"), allowMissingColumns=True)
        return report

    def upsert(self, new: DataFrame) -> None:
        """New rows keep their own place; of repeated keys the first place holds. A key that is repeated here is one row for each repetition, as before."""
        place = self.df.withColumn("_at", F.col("_ord")).drop("_ord")
        first = new.where(F.col(self.key).isNotNull()).groupBy(F.col(self.key).cast("string").alias(self.key)).agg(F.min("_ord").alias("_new_at"))
        merged = rows.upsert(place, new, self.key, "_ord")
        self.df = rows.left_join_by_key(merged, first, self.key).withColumn("_ord", F.coalesce("_at", "_new_at")).drop("_at", "_new_at")

    def changed_outside(self, path: str, schema, form: str = "json") -> None:
        """Reads the table again after another program has written it."""
        spark = self.df.sparkSession
        spark.catalog.refreshByPath(path)
        self.df = spark.read.schema(schema).format(form).load(path)

    def patch(self, patches: DataFrame) -> None:
        self.df = rows.patch(self.df, patches, self.key, "_ord")

    def stats(self) -> DataFrame:
        return profiling.field_coverage(self.df, [c for c in self.df.columns if not c.startswith("_")])

    def sample(self, n: int = 3) -> DataFrame:
        return rows.first_rows(self.df, n, "_ord")

    def wipe(self) -> None:
        self.df = self.df.where("false")


class HarvestRefused(ValueError):
    """A sample shows that harvesting on would be in vain."""


def check_sample(items: DataFrame, fields: list[str], order: list[str]) -> None:
    """Refuses when a page gives nothing, when of the first five URLs two are filters, or when most fields of the first three rows are empty."""
    few = items.orderBy(*order).limit(5).collect()
    if not few:
        raise HarvestRefused("the sample page has no rows")
    urls = [f for f in fields if "url" in f]
    filters = sum(any(x in (r[u] or "") for x in ("f[", "filter=", "facet", "sort=")) for r in few for u in urls)
    if filters >= 2:
        raise HarvestRefused("the URLs are filters of the listing")
    values = [r[f] for r in few[:3] for f in fields]
    if sum(v in (None, "") for v in values) * 2 > len(values):
        raise HarvestRefused("most fields of the sample are empty")


def guard_force(selected: DataFrame, silver: DataFrame, key: str, most: int = 50) -> None:
    """Refuses to extract again more rows than that which the typed table has; filling new variables is not concerned."""
    n = queueing.already_extracted(selected, silver, key).limit(most + 1).count()
    if n > most:
        raise PermissionError(f"more than {most} rows are extracted already; fill new variables instead")


def process_queue(pending: DataFrame, pages: DataFrame, url: str, key: str, detail: Spec | None = None, template: dict | None = None, batch: int | None = None, order: str = "_ord") -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of pending items: their pages looked up, the detail spec read, the row template filled. Failed items stay pending."""
    todo = pending if batch is None else pending.orderBy(order).limit(batch)
    fetched = fetch_saved(todo, pages, url)
    good = fetched.where("_error is null")
    if detail is not None:
        good = detail.detail(good.withColumn("html", F.col("_page")), "html", keep=tuple(c for c in todo.columns if c not in detail.fields))
    else:
        good = good.withColumn("text", inspection_text(F.col("_page"))).drop("_page", "_error")
    if template is not None:
        made = inspection.template_column(template, good.columns)
        good = good.select(*[F.col(c) for c in (key, order) if c in good.columns and c not in template], made.alias("_t")).select(*[c for c in (key, order) if c in good.columns and c not in template], "_t.*")
    return good, fetched.where("_error is not null").select(key, F.col("_error").alias("error"))


def inspection_text(page):
    from dsforge.functions.text import strip_tags

    return strip_tags(page)


@dataclass
class Pipeline:
    """What a run knows; every step leaves its result here, kept because later steps read it several times."""

    book: contracts.ContractBook = field(default_factory=contracts.ContractBook)
    codebook: Codebook | None = None
    bronze: DataFrame | None = None
    silver: DataFrame | None = None
    queue: DataFrame | None = None
    signature: str | None = None
    key: str = "id"
    _kept: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def harvest(self, pages: DataFrame, spec: Spec, page: str, target: int | None = None) -> DataFrame:
        """Listing pages to the queue; items without an id get one from their content."""
        items = spec.listing(pages, keep=(page,))
        check_sample(items, list(spec.fields), [page, "_pos"])
        items = rows.with_id(items, self.key) if self.key in items.columns else items.withColumn(self.key, rows.content_id(items, columns=list(spec.fields)))
        swept = queueing.sweep(items, page, "_pos", self.key, known=self.queue, target=target)
        new = swept.withColumn("_ord", F.col(page).cast("long") * 1_000_000 + F.col("_pos")).drop("_pos", page)
        self.queue = self._keep("queue", new if self.queue is None else self.queue.unionByName(new))
        return self.queue

    def to_rows(self, required: list[str]) -> DataFrame:
        none = self.queue.where("false") if self.bronze is None else self.bronze
        new = queueing.rows_from_queue(self.queue, none, self.key, required, "_ord")
        self.bronze = self._keep("bronze", new if self.bronze is None else self.bronze.unionByName(new, allowMissingColumns=True))
        return self.bronze

    def extract(self, extractor: extraction.Extractor, text: str, least_chars: int = 200) -> DataFrame:
        """Rows the typed table lacks; a changed codebook starts it anew."""
        signature = self.codebook.extraction_signature()
        if self.silver is None or signature != self.signature:
            empty = self.bronze.select(self.key, "_ord").where("false")
            self.silver, self.signature = None, signature
        else:
            empty = self.silver
        new = extraction.extract_missing(self.bronze, empty, self.codebook, extractor, self.key, text, least_chars).join(self.bronze.select(self.key, "_ord"), self.key)
        # rows that had no text are tried again each time
        kept = None if self.silver is None else self.silver.where("_extract_status = 'ok'")
        self.silver = self._keep("silver", new if kept is None else kept.unionByName(new))
        return self.silver

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        """The step's result in the cache, its predecessor out of it."""
        old = self._kept.get(name)
        self._kept[name] = df.persist()
        df.count()
        if old is not None:
            old.unpersist()
        return df

    def close(self) -> None:
        """Releases what the steps have kept."""
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()

    def joined(self) -> DataFrame:
        if self.silver is None:
            return self.bronze
        return rows.merge_silver(self.bronze, self._typed(), self.key, "_ord")

    def _typed(self) -> DataFrame:
        return self.silver.where("_extract_status = 'ok'").drop("_error", "_warnings", "_extract_status")

    def process(self, details: DataFrame, url: str, detail: Spec | None = None, template: dict | None = None) -> DataFrame:
        """Pending items with what their own pages say, as rows; gives the failures, which stay pending."""
        waiting = self.queue if self.bronze is None else queueing.pending(self.queue, self.bronze, self.key)
        good, failed = process_queue(waiting, details, url, self.key, detail, template)
        good = good.drop("_page", "_error")
        self.bronze = self._keep("bronze", good if self.bronze is None else self.bronze.unionByName(good, allowMissingColumns=True))
        return failed

    def run(
        self, pages: DataFrame, spec: Spec, page: str, details: DataFrame | None = None, url: str = "detail_url", detail: Spec | None = None, extractor: extraction.Extractor | None = None, text: str = "body",
        target: int | None = None, required: list[str] = (), out_dir: str | None = None, source_url: str | None = None,
    ) -> dict:
        """A whole run from listing pages to files: harvest, detail pages, typed extraction, verification, export.

        Verification that fails is tried once more after the items that are still pending have been taken as they are, without their pages. Gives the verification, the phase, the number of failed items and the paths.
        """
        self.harvest(pages, spec, page, target)
        failed = 0
        if details is not None:
            failed = self.process(details, url, detail).count()
        else:
            self.to_rows(list(required) or list(spec.fields))

        def typed() -> dict:
            if extractor is not None:
                self.codebook = self.codebook or profiling.infer_codebook(self.bronze)
                self.extract(extractor, text)
            return self.verify()

        verdict = typed()
        if not verdict["ok"] and failed:
            self.to_rows(list(required) or list(spec.fields))
            verdict = typed()
        paths = self.export(out_dir, source_url) if out_dir else {}
        return {"verified": verdict, "phase": self.phase(target or 0), "n_rows": self.bronze.count(), "n_failed": failed, "paths": paths}

    def verify(self) -> dict:
        """Contracts on the joined view, and columns that few rows have."""
        df = self.joined()
        results = self.book.check(df)
        return {"ok": all(ok for _, ok, _ in results), "contracts": results, "sparse": [r.field for r in contracts.sparse_fields(df).collect()]}

    def phase(self, target: int) -> str:
        n = self.bronze.count() if self.bronze is not None else 0
        return current_phase(RunState(n_rows=n, target=target, contracts_ok=bool(n) and self.book.all_satisfied(self.joined()), has_page=True, has_extractor=True, n_queue=0 if self.queue is None else self.queue.count(), has_codebook=self.codebook is not None, n_silver=0 if self.silver is None else self._typed().count(), stale_codebook=self.codebook is not None and self.codebook.extraction_signature() != self.signature))

    def export(self, out_dir: str, source_url: str | None = None) -> dict[str, str]:
        silver = None if self.silver is None else self._typed()
        return export.export_dataset(self.bronze, silver, self.codebook, out_dir, self.key, "_ord", source_url)


def describe(pipe: Pipeline, target: int) -> str:
    """A short text of where a run stands."""
    n = pipe.bronze.count() if pipe.bronze is not None else 0
    lines = [f"phase: {pipe.phase(target)}", f"rows: {n} of {target}", f"queue: {0 if pipe.queue is None else pipe.queue.count()}", f"typed: {0 if pipe.silver is None else pipe._typed().count()}"]
    if n:
        lines += [f"{'ok ' if ok else 'FAIL'} {name}: {detail}" for name, ok, detail in pipe.book.check(pipe.joined())]
    return "\n".join(lines)


def format_stats(stats: DataFrame) -> str:
    """Statistics as a text table."""
    data = [stats.columns, *[["" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r] for r in stats.collect()]]
    widths = [max(len(r[i]) for r in data) for i in range(len(data[0]))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in data)


def extract_structured(df: DataFrame, schema: dict, extractor: extraction.Extractor, key: str, text: str) -> DataFrame:
    """(key, properties, violation): one object per text by a JSON Schema, with its first violation."""
    from dsforge.plans.model import VariableSpec

    kinds = {"boolean": "boolean", "integer": "integer", "number": "float", "array": "array"}
    variables = []
    for name, sub in schema.get("properties", {}).items():
        t = next((x for x in ([sub.get("type")] if isinstance(sub.get("type"), str) else sub.get("type") or ["string"]) if x != "null"), "string")
        values = [v for v in sub.get("enum", []) if v is not None]
        variables.append(VariableSpec(name, "enum" if values else kinds.get(t, "string"), enum_values=values, item_schema={"type": "string"} if t == "array" else None, required=name in schema.get("required", [])))
    out = extraction.extract(df, Codebook("schema", variables), extractor, key, text)
    return out.withColumn("violation", F.coalesce(F.col("_error"), contracts.row_violation(schema, out))).drop("_error", "_warnings")


def context_snippet(df: DataFrame, codebook: Codebook | None = None, n: int = 20, size: int = 6000, order: str = "_ord") -> str:
    """The first rows as JSON lines and the names of the variables, cut to ``size``."""
    names = "" if codebook is None else "variables: " + ", ".join(v.name for v in codebook.variables) + "\n"
    return (names + "\n".join(r.j for r in df.orderBy(order).limit(n).select(F.to_json(F.struct(*df.columns)).alias("j")).collect()))[:size]


def run_listing(lines: DataFrame, path: str = "_path") -> DataFrame:
    """(run, n_rows) of rows read from the folders of several runs."""
    return lines.groupBy(F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1).alias("run")).agg(F.count(F.lit(1)).alias("n_rows"))
