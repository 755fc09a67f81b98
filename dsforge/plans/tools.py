"""The engine's operators under the names of tools, for programs that choose the next step by name."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dsforge.operators import contracts, extraction, inspection, profiling, queueing, rows
from dsforge.plans import pipeline
from dsforge.plans.control import Plan, Registry, Tool
from dsforge.plans.model import Codebook, VariableSpec
from dsforge.plans.spec import Spec
from dsforge.sources import export, fetch, files
from dsforge.sources.extract_text import extract_text

# The names of the tools; those of the second list need an extractor.
NAMES = [
    "http_get", "html_inspect", "html_extract", "html_find", "extractor_define", "scrape_paginated", "process_queue", "python", "bash", "read_file", "write_file", "list_dir", "extract_text", "save_attachment",
    "dataset_append", "dataset_patch", "dataset_from_queue", "dataset_stats", "dataset_sample", "field_probe", "pagination_probe", "queue_add", "queue_next", "queue_mark_done", "queue_status", "memory_get",
    "memory_set", "memory_list", "set_plan", "show_plan", "dataset_validate", "dataset_export", "hf_push", "codebook_show", "codebook_edit", "finish",
]
WITH_EXTRACTOR = ["extract_structured", "codebook_propose", "codebook_test", "extract_items", "llm_scrape"]
#: Tools whose arguments may refer to files.
WITH_REFS = {"write_file", "dataset_append", "dataset_patch", "queue_add", "memory_set", "extractor_define", "codebook_edit"}


def _json(df: DataFrame, n: int = 50) -> str:
    """The first rows as JSON lines; what a tool shows is for reading and bounded."""
    return "\n".join(r.j for r in df.limit(n).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("j")).collect())


class Workspace:
    """What the tools of one run share: the pipeline, its pages, specs, plan and memory, below one folder."""

    def __init__(self, spark: SparkSession, root: str, pipe: pipeline.Pipeline | None = None, fetcher=None, extractor: extraction.Extractor | None = None, pages: DataFrame | None = None):
        self.spark, self.root, self.pipe, self.fetcher, self.extractor = spark, root, pipe or pipeline.Pipeline(), fetcher, extractor
        self.pages = pages if pages is not None else spark.createDataFrame([], "url string, html string")
        self.specs: dict[str, Spec] = {}
        self.plan: Plan | None = None
        os.makedirs(root, exist_ok=True)
        self.memory = files.Memory(os.path.join(root, "memory.json"))

    def registry(self) -> Registry:
        out = Registry(self.root, WITH_REFS)
        for name in [*NAMES, *(WITH_EXTRACTOR if self.extractor else [])]:
            out.register(Tool(name, getattr(self, f"_{name}")))
        return out

    def _page(self, source: str) -> DataFrame:
        """One page by its markup, URL or file, as a table."""
        known = self.pages.where(F.col("url") == source).select("url", "html")
        html = None if source.startswith("http") and not known.isEmpty() else fetch.html_source(source, self.root)
        return known if html is None else self.spark.createDataFrame([(source[:200], html)], "url string, html string")

    # pages
    def _http_get(self, url: str) -> str:
        if self.fetcher is None:
            return _json(self._page(url).select("url", F.substring("html", 1, 8000).alias("preview")))
        one = self.spark.createDataFrame([(url,)], "url string")
        return _json(fetch.fetch_and_keep(one, self.fetcher, os.path.join(self.root, "cache")))

    def _html_inspect(self, source: str, top_n: int = 25) -> str:
        page = self._page(source)
        parts = {"tags": inspection.tag_counts(page).orderBy(F.desc("n"), "tag"), "classes": inspection.class_counts(page).orderBy(F.desc("n"), "token"), "sample": inspection.sample_block(page, "url")}
        return "\n".join(f"# {k}\n{_json(v, top_n)}" for k, v in parts.items())

    def _html_extract(self, source: str, pattern: str, limit: int = 10) -> str:
        return _json(inspection.extract_pattern(self._page(source), pattern, "url", limit))

    def _html_find(self, source: str, class_token: str, tag: str | None = None, limit: int = 5) -> str:
        return _json(inspection.find_class(self._page(source), class_token, "url", tag, limit))

    def _field_probe(self, source: str, values: list[str], context_chars: int = 400, max_hits: int = 2) -> str:
        return _json(inspection.probe_values(self._page(source), values, "url", context_chars, max_hits))

    def _pagination_probe(self, variants: dict[str, str | None]) -> str:
        names = ["base", "page0", "page1", "page2", "p1", "p2", "offset"]
        one = self.spark.createDataFrame([tuple(variants.get(n) for n in names)], ", ".join(f"{n} string" for n in names))
        return one.select(queueing.pagination_verdict(one).alias("v")).first().v

    def _extractor_define(self, name: str, spec: dict) -> str:
        self.specs[name] = Spec.normalise(spec)
        return "; ".join(("defined", *self.specs[name].notes))

    def _scrape_paginated(self, extractor: str, page: str = "page", target: int | None = None) -> str:
        return f"{self.pipe.harvest(self.pages, self.specs[extractor], page, target).count()} items in the queue"

    def _process_queue(self, detail_extractor: str | None = None, url: str = "detail_url", row_template: dict | None = None) -> str:
        failed = self.pipe.process(self.pages, url, self.specs.get(detail_extractor), row_template)
        return f"{self.pipe.bronze.count()} rows, {failed.count()} failures"

    # code is run by nobody
    def _python(self, **_) -> str:
        raise PermissionError("arbitrary code is not run here; use the engine's operators")

    _bash = _python

    # files
    def _read_file(self, path: str) -> str:
        return files.read_file(self.root, path)

    def _write_file(self, path: str, text: str) -> str:
        return files.write_file(self.root, path, text)

    def _list_dir(self, path: str = ".") -> str:
        return _json(files.list_files(self.spark, self.root, path).orderBy("path"))

    def _extract_text(self, path: str) -> str:
        return extract_text(path, files.read_bytes(files.confined(self.root, path)) or b"")

    def _save_attachment(self, path: str, item: int) -> str:
        data = files.read_bytes(files.confined(self.root, path)) or b""
        taken = len([x for x in os.listdir(os.path.join(self.root, f"items/item_{item:04d}")) if not x.endswith(".txt")]) if os.path.isdir(os.path.join(self.root, f"items/item_{item:04d}")) else 0
        one = self.spark.createDataFrame([(f"items/item_{item:04d}/attachment_{taken + 1:02d}{os.path.splitext(path)[1]}", bytearray(data), extract_text(path, data))], "saved_as string, content binary, text string")
        fetch.save_attachments(one, self.root)
        return one.first().saved_as

    # dataset
    def _rows(self, value) -> DataFrame:
        text = files.read_file(self.root, value) if isinstance(value, str) and value.strip()[:1] not in "[{" else value
        given = extraction.tolerant_json.parse_rows(text) if isinstance(text, str) else [text] if isinstance(text, dict) else list(text)
        if not given:
            return self.spark.createDataFrame([], f"{self.pipe.key} string, _ord long")
        one = self.spark.createDataFrame([(json.dumps(given),)], "j string")
        schema = one.select(F.schema_of_json(F.lit(json.dumps(given)))).first()[0]
        df = one.select(F.explode(F.from_json("j", schema)).alias("x")).select("x.*")
        start = 0 if self.pipe.bronze is None else self.pipe.bronze.agg(F.coalesce(F.max("_ord"), F.lit(-1))).first()[0] + 1
        return rows.with_id(df, self.pipe.key).withColumn("_ord", F.monotonically_increasing_id() + start)

    def _dataset_append(self, rows: list | dict | str) -> str:
        new = self._rows(rows)
        held = self.pipe.bronze if self.pipe.bronze is not None else new.where("false")
        data = pipeline.Dataset(held, self.pipe.key)
        report = data.append(new)
        self.pipe.bronze = self.pipe._keep("bronze", data.df)
        return _json(report.groupBy(F.coalesce("_reason", F.lit("added")).alias("outcome")).count().orderBy("outcome"))

    def _dataset_patch(self, patches: list | dict | str) -> str:
        new = self._rows(patches)
        counts = _json(rows.patch_counts(self.pipe.bronze, new, self.pipe.key))
        self.pipe.bronze = self.pipe._keep("bronze", rows.patch(self.pipe.bronze, new, self.pipe.key, "_ord"))
        return counts

    def _dataset_from_queue(self, fields: list[str]) -> str:
        return f"{self.pipe.to_rows(fields).count()} rows"

    def _dataset_stats(self) -> str:
        df = self.pipe.joined()
        return _json(profiling.field_coverage(df, [c for c in df.columns if not c.startswith("_")]).orderBy(F.desc("n_covered"), "variable"))

    def _dataset_sample(self, n: int = 3) -> str:
        return _json(rows.first_rows(self.pipe.joined(), n, "_ord"), n)

    def _dataset_validate(self) -> str:
        return _json(profiling.dataset_validate(self.pipe.joined(), self.pipe.codebook).orderBy("variable", "fact"), 500)

    def _dataset_export(self, out_dir: str = "export", source_url: str | None = None) -> str:
        return json.dumps(self.pipe.export(files.confined(self.root, out_dir), source_url))

    def _hf_push(self, out_dir: str = "export") -> str:
        name = self.pipe.codebook.name if self.pipe.codebook else "dataset"
        return f"a publisher would take {export.push_source(files.confined(self.root, out_dir), name)}; nothing is sent from here"

    # queue
    def _done(self) -> DataFrame:
        empty = self.pipe.queue.where("false").select(self.pipe.key)
        marked = [(x,) for x in self.memory.get("processed", [])]
        return empty.unionByName(self.spark.createDataFrame(marked, f"{self.pipe.key} string")) if marked else empty

    def _queue_add(self, items: list[dict]) -> str:
        new = self._rows(items)
        queue = self.pipe.queue if self.pipe.queue is not None else new.where("false")
        self.pipe.queue = queue
        added = queueing.add(queue, self._done(), new, self.pipe.key, "_ord")
        self.pipe.queue = self.pipe._keep("queue", queue.unionByName(added, allowMissingColumns=True))
        return self._queue_status()

    def _queue_next(self) -> str:
        return _json(queueing.next_item(self.pipe.queue, self._done(), self.pipe.key, "_ord"))

    def _queue_mark_done(self, id: str) -> str:
        self.memory.set("processed", sorted({*self.memory.get("processed", []), str(id)}))
        return self._queue_status()

    def _queue_status(self) -> str:
        return _json(queueing.status(self.pipe.queue, self._done(), self.pipe.key))

    # memory and plan
    def _memory_get(self, key: str) -> str:
        return json.dumps(self.memory.get(key))

    def _memory_set(self, key: str, value) -> str:
        self.memory.set(key, value)
        return "set"

    def _memory_list(self) -> str:
        return json.dumps(self.memory.list())

    def _set_plan(self, **plan) -> str:
        self.plan = Plan.validated(plan)
        self.plan.reconcile(self.pipe.book)
        return self._show_plan()

    def _show_plan(self) -> str:
        return json.dumps(vars(self.plan)) if self.plan else "no plan"

    # codebook
    def _codebook_show(self) -> str:
        return show_codebook(self.pipe.codebook) if self.pipe.codebook else "no codebook"

    def _codebook_edit(self, drop: list[str] = (), rename: dict | None = None, add: list[dict] = (), required: dict | None = None) -> str:
        change = self.pipe.codebook.edit(drop, rename, Codebook.from_dict({"variables": list(add)}).variables, required, self.pipe.book.locked_fields())
        if self.pipe.silver is not None:
            internal = [c for c in self.pipe.silver.columns if c.startswith("_")]
            self.pipe.silver = rows.scrub(self.pipe.silver, change["drop"], change["rename"], [*change["keep_only"], *internal], self.pipe.key)
        return self._codebook_show()

    def _codebook_propose(self, k: int = 5, replace: bool = False) -> str:
        if self.pipe.codebook is not None and not replace:
            raise PermissionError("there is a codebook; pass replace to start anew")
        self.pipe.codebook = propose_codebook(self.pipe.bronze, self.extractor, "_ord", k)
        self.pipe.silver = None
        return self._codebook_show()

    def _codebook_test(self, text: str, k: int = 5) -> str:
        return _json(codebook_test(self.pipe.bronze, self.pipe.codebook, self.extractor, self.pipe.key, text, "_ord", k))

    def _extract_items(self, text: str) -> str:
        return _json(self.pipe.extract(self.extractor, text).groupBy("_extract_status").count())

    def _extract_structured(self, schema: dict, text: str) -> str:
        one = self.spark.createDataFrame([(1, text)], "_k int, t string")
        return _json(pipeline.extract_structured(one, schema, self.extractor, "_k", "t"))

    def _llm_scrape(self, source: str, fields: list[str], target: int = 30, size: int = 8000) -> str:
        found = extraction.scrape(self._page(source), self.extractor, "html", "url", fields, size, target)
        return self._dataset_append([r.asDict() for r in found.select(*fields).limit(target).collect()])

    def _finish(self, force: bool = False) -> str:
        return contracts.finish(self.pipe.book.check(self.pipe.joined()), force)[1]


def default_registry(spark: SparkSession, root: str, **parts) -> Registry:
    """All tools over a new workspace below a folder."""
    return Workspace(spark, root, **parts).registry()


def show_codebook(book: Codebook) -> str:
    """A codebook as text, one line per variable."""
    lines = [f"{book.name} v{book.version}: {len(book.variables)} variables, {book.numeric_or_boolean_ratio():.0%} numeric or boolean"]
    for v in book.variables:
        extras = [f"one of {', '.join(v.enum_values)}" if v.enum_values else "", f"in {v.unit}" if v.unit else "", f"{v.min_value} to {v.max_value}" if v.min_value is not None or v.max_value is not None else "", "required" if v.required else "", f"pass {v.pass_}" if v.pass_ != 1 else ""]
        lines.append(f"- {v.name} ({v.type})" + "".join(f", {x}" for x in extras if x) + (f": {v.description}" if v.description else ""))
    return "\n".join(lines)


def codebook_test(bronze: DataFrame, book: Codebook, extractor: extraction.Extractor, key: str, text: str, order: str, k: int = 5) -> DataFrame:
    """The statistics of a codebook on a small sample of rows, first and last among them."""
    sample = rows.stratified_sample(bronze, k, order)
    return profiling.codebook_stats(extraction.extract(sample, book, extractor, key, text), book)


def propose_codebook(bronze: DataFrame, proposer: extraction.Extractor | None, order: str, k: int = 5) -> Codebook:
    """A codebook proposed for a sample of rows by an extractor that answers with variables, or inferred from the values; of variables that say the same the first is kept."""
    book = None
    if proposer is not None:
        lines = [r.j for r in rows.stratified_sample(bronze, k, order).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in bronze.columns])).alias("j")).collect()]
        answer = extraction.tolerant_json.parse_object(proposer("\n".join(lines)))
        if answer and answer.get("variables"):
            book = Codebook.from_dict(answer)
    book = book or profiling.infer_codebook(bronze)
    again = {n for group in book.duplicate_groups().values() for n in group[1:]}
    book.variables = [v for v in book.variables if v.name not in again]
    book.validate()
    return book


__all__ = ["NAMES", "WITH_EXTRACTOR", "VariableSpec", "Workspace", "codebook_test", "default_registry", "propose_codebook", "show_codebook"]
