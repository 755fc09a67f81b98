"""Queries of the operators that touch files, codebooks, contracts, runs and streams, each over the tables, with the same in SQL."""

from __future__ import annotations

import io
import uuid

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dsforge.functions import coerce as C
from dsforge.functions import text as X
from dsforge.functions.tolerant_json import json_object
from dsforge.operators import contracts, extraction, inspection, profiling, queueing, rows
from dsforge.plans import pipeline, tools
from dsforge.plans.control import Plan, PlanError, RunState, chunk_budget, current_phase, goal_hints, snake_field
from dsforge.plans.model import JSON_TYPES, Codebook, VariableSpec
from dsforge.plans.page_queries import PAGES, pages
from dsforge.plans.registry import query
from dsforge.plans.row_queries import BOOK
from dsforge.plans.spec import Spec, SpecError
from dsforge.session import ensure_checkpoint_dir, spread, table
from dsforge.sources import export, fetch, files
from dsforge.sources.extract_text import with_text
from dsforge.streaming import incremental


def folder(spark: SparkSession) -> str:
    """A new place in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def _values(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def _sql_values(data: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in data)}) t({names})"


# ---- files


@query("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines appended in two goes, some of them malformed, read back."""
    at = folder(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    files.append_jsonl(d.where("lang is not null and doc_id % 2 = 0"), at)
    files.append_jsonl(d.where("lang is not null and doc_id % 2 = 1"), at)
    d.where("lang is null").select(F.concat(F.lit("{broken "), F.col("doc_id").cast("string")).alias("value")).write.mode("append").text(at)
    return files.read_jsonl(spark, at, "doc_id long, lang string")


@query("SELECT '{broken ' || doc_id::VARCHAR AS line FROM documents WHERE lang IS NULL")
def jsonl_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    d.select(F.when(F.col("lang").isNull(), F.concat(F.lit("{broken "), F.col("doc_id").cast("string"))).otherwise(F.to_json(F.struct("doc_id", "lang"))).alias("value")).write.text(at)
    return files.malformed_lines(spark, at, T.StructType())


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def table_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    files.rewrite(d, at, "parquet")
    files.rewrite(spark.read.parquet(at).where("lang = 'en'").select("doc_id"), at, "parquet")
    return spark.read.schema("doc_id long").parquet(at)


@query("SELECT ex_no::VARCHAR AS ex_no, country_code, amount_eur, n_persons, is_public, TRY_CAST(CASE WHEN regexp_matches(decided_on, '^.{4}-.{2}-.{2}') THEN left(decided_on, 10) END AS DATE)::VARCHAR AS decided_on FROM extracted")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark)
    export.write_parquet(table(spark, sf_dir, "extracted"), BOOK, at, ["ex_no"])
    return spark.read.parquet(at).select("ex_no", "country_code", "amount_eur", "n_persons", "is_public", F.col("decided_on").cast("string").alias("decided_on"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS flag FROM events")
def export_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes is true, no is false, what says neither is null."""
    words = F.element_at(F.array(*[F.lit(x) for x in ("yes", "no", "true", "unknown", "7")]), (F.col("event_id") % 5 + 1).cast("int"))
    book = Codebook("flags", [VariableSpec("flag", "boolean")])
    return export.typed(table(spark, sf_dir, "events").select("event_id", words.alias("flag")), book, ["event_id"]).select(F.col("event_id").cast("long").alias("event_id"), "flag")


@query("""WITH n AS (SELECT count(*) AS b FROM dataset), s AS (SELECT count(DISTINCT row_no) AS t FROM extracted WHERE row_no IS NOT NULL)
 SELECT 'merged' AS artefact, b AS n FROM n UNION ALL SELECT 'raw', b FROM n UNION ALL SELECT 'parquet', b FROM n UNION ALL SELECT 'typed', t FROM s UNION ALL SELECT 'typed_parquet', t FROM s UNION ALL SELECT 'codebook', 8 UNION ALL SELECT 'card', 8""")  # fmt: skip
def export_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of an export, read back: rows of the tables, variables of the codebook and of its card."""
    bronze = table(spark, sf_dir, "dataset").select(F.col("row_no").alias("id"), F.col("row_no").alias("_ord"), "title")
    silver = rows.keep_last(table(spark, sf_dir, "extracted").where("row_no is not null").select(F.col("row_no").alias("id"), F.col("ex_no").alias("_ord"), *[v.name for v in BOOK.variables]), ["id"], ["_ord"])
    at = export.export_dataset(bronze, silver, BOOK, folder(spark))
    counts = [(k, (spark.read.parquet if "parquet" in k else spark.read.text)(at[k]).count()) for k in ("merged", "raw", "parquet", "typed", "typed_parquet")]
    book = Codebook.from_dict(__import__("json").loads(files.read_bytes(at["codebook"])))
    card = sum(line.startswith("| ") and not line.startswith("| variable") for line in files.read_bytes(at["card"]).decode().splitlines())
    return _values(spark, [*counts, ("codebook", len(book.variables)), ("card", card)], "artefact string, n long")


def _answer(url: str) -> tuple[int, dict, bytes]:
    if ".test/" in url:
        return 200, {"Content-Type": "application/json; charset=utf-8"}, b'{"a": 1}'
    return (404 if url.endswith("3") else 200), {"Content-Type": "text/html"}, b"<html></html>"


@query("""SELECT DISTINCT detail_url AS url, CASE WHEN contains(detail_url, '.test/') OR detail_url NOT LIKE '%3' THEN 200 ELSE 404 END::INTEGER AS status, left(sha1(detail_url), 12) || CASE WHEN contains(detail_url, '.test/') THEN '.json' ELSE '.html' END AS saved_as, TRUE AS from_cache,
 CASE WHEN NOT contains(detail_url, '.test/') AND detail_url LIKE '%3' THEN 'status 404' END AS error FROM dataset WHERE detail_url IS NOT NULL""")  # fmt: skip
def fetch_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL fetched and kept, then asked for again, which finds the kept pages."""
    at, urls = folder(spark), spread(table(spark, sf_dir, "dataset").select("detail_url"))
    fetch.fetch_and_keep(urls, _answer, at, "detail_url").count()
    return fetch.fetch_and_keep(urls, _answer, at, "detail_url").withColumnRenamed("_error", "error")


@query("SELECT row_no, CASE WHEN detail_url IS NULL THEN NULL WHEN EXISTS (SELECT 1 FROM dataset x WHERE x.detail_url = d.detail_url AND x.row_no % 3 <> 0) THEN length(detail_url) END::INTEGER AS n_chars FROM dataset d")
def saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset").select("row_no", F.col("detail_url").alias("url"))
    held = d.where("row_no % 3 != 0").select("url", F.col("url").alias("html"))
    return fetch.fetch_saved(d, held).select("row_no", F.length("_page").alias("n_chars"))


_ATTEMPTS = [("busy then well", 200, 2), ("asks to wait", 200, 1), ("client error", 404, 0), ("always failing", 500, 4)]


@query(_sql_values(_ATTEMPTS, "server, status, n_waits"))
def fetch_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = {"busy then well": [(503, {}), (429, {}), (200, {})], "asks to wait": [(429, {"Retry-After": "9"}), (200, {})], "client error": [(404, {})], "always failing": [(500, {})] * 5}
    out = []
    for name, given in answers.items():
        waits, turn = [], iter(given)
        status, _, _ = fetch.RetryPolicy(sleep=waits.append).run(lambda u, turn=turn: (*next(turn), b""), "u")
        out.append((name, status, len(waits)))
    return _values(spark, out, "server string, status int, n_waits int")


@query("SELECT r_name || '.txt' AS name, length(r_name)::BIGINT AS n_bytes, r_name AS text FROM region")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written below a folder, listed and read."""
    import tempfile

    with tempfile.TemporaryDirectory() as root:  # the driver's own files, as the tools that edit them see them
        for r in table(spark, sf_dir, "region").collect():
            files.write_file(root, f"sub/{r.r_name}.txt", r.r_name)
        listed = files.list_files(spark, root, "sub").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("n_bytes")).collect()
        found = [(r.name.replace("%20", " "), r.n_bytes, files.read_file(root, f"sub/{r.name}".replace("%20", " "))) for r in listed]
    return _values(spark, found, "name string, n_bytes long, text string")


@query(_sql_values([("markup", 9), ("kept page", 13), ("file", 8), ("nothing", None)], "source, n_chars"))
def html_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    import tempfile

    with tempfile.TemporaryDirectory() as root:
        files.write_file(root, "cache/p.html", "<p>x</p>")
        fetch.fetch_and_keep(_values(spark, [("https://h.example/1",)], "url string"), _answer, f"{root}/cache").count()
        given = {"markup": "<p>hi</p>", "kept page": "https://h.example/1", "file": "p.html", "nothing": "q.html"}
        out = [(k, None if (h := fetch.html_source(v, root)) is None else len(h)) for k, v in given.items()]
    return _values(spark, out, "source string, n_chars int")


@query("SELECT r_regionkey::BIGINT AS k, r_name AS name, given FROM region, (VALUES ('list'), ('text'), ('lines')) t(given)")
def rows_as_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    schema = T.StructType.fromDDL("k long, name string")
    data = [{"k": r.r_regionkey, "name": r.r_name} for r in table(spark, sf_dir, "region").collect()]
    forms = {"list": data, "text": json.dumps(data), "lines": "\n".join(json.dumps(x) for x in data)}
    out = None
    for name, value in forms.items():
        df = files.rows_argument(spark, value, schema).withColumn("given", F.lit(name))
        out = df if out is None else out.unionAll(df)
    return out


_KINDS = ["html", "xml", "json", "jsonl", "csv", "tsv", "gz", "zip", "tar", "toml", "rtf", "docx", "odt", "pptx", "epub", "sniffed", "latin"]


def _packed(kind: str, t: str) -> bytes:
    import gzip
    import tarfile
    import zipfile

    if kind in ("zip", "docx", "odt", "pptx", "epub"):
        name = {"zip": "a.txt", "docx": "word/document.xml", "odt": "content.xml", "pptx": "ppt/slides/slide1.xml", "epub": "c/one.xhtml"}[kind]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, t if kind == "zip" else f"<?xml version='1.0'?><w:p>{t}</w:p>")
        return out.getvalue()
    if kind == "tar":
        out, info = io.BytesIO(), tarfile.TarInfo("a.txt")
        info.size = len(t.encode())
        with tarfile.open(fileobj=out, mode="w") as z:
            z.addfile(info, io.BytesIO(t.encode()))
        return out.getvalue()
    if kind == "gz":
        return gzip.compress(t.encode())
    texts = {
        "html": f"<html><body><p>{t}</p><script>x</script><div>b</div></body></html>", "xml": f"<?xml version='1.0'?><a><b>{t}</b><!-- no --><c>d</c></a>", "json": f'{{"t": "{t}"}}', "jsonl": f'{{"t": "{t}"}}\n\n{{"n": 1}}',
        "csv": f'"{t}, x",b\n1,2', "tsv": f"{t}\tb\n1\t2", "toml": f't = "{t}"', "rtf": rf"{{\rtf1 {t}}}", "sniffed": f"<!DOCTYPE html><p>{t}</p>",
    }
    return ("é" + t).encode("latin-1") if kind == "latin" else texts[kind].encode()


@F.pandas_udf(T.BinaryType())
def _pack(kinds: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([_packed(k, t) for k, t in zip(kinds, texts)])


_BARE = "trim(regexp_replace(regexp_replace(title, '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH d AS (SELECT row_no, list_extract([{', '.join(f"'{k}'" for k in _KINDS)}], (row_no % {len(_KINDS)} + 1)::INTEGER) AS form, {_BARE} AS t FROM dataset WHERE title IS NOT NULL)
 SELECT row_no, form, CASE WHEN form IN ('docx', 'odt', 'pptx', 'epub', 'rtf', 'gz', 'sniffed') THEN t WHEN form = 'html' THEN t || chr(10) || chr(10) || 'b' WHEN form = 'xml' THEN t || ' d' WHEN form IN ('json', 'toml') THEN '{{' || chr(10) || '  "t": "' || t || '"' || chr(10) || '}}'
 WHEN form = 'jsonl' THEN '{{"t": "' || t || '"}}' || chr(10) || '{{"n": 1}}' WHEN form = 'csv' THEN t || ', x' || chr(9) || 'b' || chr(10) || '1' || chr(9) || '2' WHEN form = 'tsv' THEN t || chr(9) || 'b' || chr(10) || '1' || chr(9) || '2'
 WHEN form IN ('zip', 'tar') THEN chr(10) || '=== a.txt ===' || chr(10) || t WHEN form = 'latin' THEN 'é' || t END AS text FROM d""")  # fmt: skip
def extract_text_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles packed into files of many kinds and read out again."""
    bare = F.trim(F.regexp_replace(F.regexp_replace("title", "[^A-Za-z0-9 ]", ""), " +", " "))
    form = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("row_no") % len(_KINDS) + 1).cast("int"))
    d = spread(table(spark, sf_dir, "dataset").where("title is not null").select("row_no", form.alias("form"), bare.alias("t")))
    ext = F.when(F.col("form") == "sniffed", "").when(F.col("form") == "latin", ".txt").when(F.col("form") == "gz", ".txt.gz").otherwise(F.concat(F.lit("."), F.col("form")))
    packed = d.select(F.concat(F.col("row_no").cast("string"), F.lit("/"), F.col("form"), ext).alias("path"), _pack("form", "t").alias("content"))
    out = with_text(packed)
    return out.select(F.split_part("path", F.lit("/"), F.lit(1)).cast("long").alias("row_no"), F.regexp_extract("path", r"/([a-z]+)", 1).alias("form"), "text")


# ---- specs and pages

_BAD_SPECS = [("no fields", {"row_pattern": "x"}), ("typo", {"row_regex": "x", "fields": {"a": "b"}}), ("selector", {"fields": {"a": {"css": "p", "regex": "x"}}}), ("bad pattern", {"fields": {"a": "("}}), ("unknown transform", {"fields": {"a": {"regex": "x", "transform": "zap"}}}), ("good", {"fields": [{"name": "a", "pattern": "x", "all": True, "zap": 1}], "more": 1})]


@query(_sql_values([("no fields", True, 0), ("typo", True, 0), ("selector", True, 0), ("bad pattern", True, 0), ("unknown transform", True, 0), ("good", False, 2)], "spec, refused, n_notes"))
def spec_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name, data in _BAD_SPECS:
        try:
            out.append((name, False, len(Spec.normalise(data).notes)))
        except SpecError:
            out.append((name, True, 0))
    return _values(spark, out, "spec string, refused boolean, n_notes int")


@query("SELECT row_no, title FROM dataset WHERE title IS NOT NULL")
def loose_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec whose class tokens stand in another order on half of the pages finds all of them after its repair."""
    d = table(spark, sf_dir, "dataset").where("title is not null")
    html = F.concat(F.when(F.col("row_no") % 2 == 0, '<div class="item big n">').otherwise('<div class="n big item">'), F.col("title"), F.lit("</div>"))
    spec = Spec.normalise({"row_pattern": r'<div class="big item">(.*?)</div>', "fields": {"title": r"^(.*)$"}}).loose_class()
    return spec.listing(d.select("row_no", html.alias("html")), keep=("row_no",)).select("row_no", "title")


@query("SELECT row_no, coalesce(id, '') AS a, coalesce(title, '') AS b FROM dataset")
def positional_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset")
    html = F.concat(F.lit("<tr><td>"), F.coalesce("id", F.lit("")), F.lit('</td> <td class="x">'), F.coalesce("title", F.lit("")), F.lit("</td></tr>"))
    spec = Spec.normalise({"row_pattern": "<tr>(.*?)</tr>", "fields": {"a": "<td[^>]*>(.*?)</td>", "b": "<td[^>]*>(.*?)</td>"}}).positional_cells()
    return spec.listing(d.select("row_no", html.alias("html")), keep=("row_no",)).select("row_no", "a", "b")


@query("SELECT 'label' AS a, 'name' AS b")
def duplicate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("label"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return inspection.duplicate_fields(n, ["label", "name", "region"], "n_nationkey")


@query("""SELECT r_regionkey, 'row' AS token, '<li class="row">' || r_name || '</li></ul>' AS block FROM region""")
def sample_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return inspection.sample_block(r.select("r_regionkey", F.concat(F.lit('<ul class="menu"><li class="row">'), "r_name", F.lit("</li></ul>")).alias("html")), "r_regionkey")


@query(f"""WITH RECURSIVE {PAGES}, c AS (SELECT page_id, html, 0 AS begin_at, CASE WHEN length(html) > 300 AND strpos(reverse(substr(html, 1, 300)), '>') BETWEEN 1 AND 299 THEN 301 - strpos(reverse(substr(html, 1, 300)), '>') ELSE least(300, length(html)) END AS fin, 0 AS piece FROM pages
 UNION ALL SELECT page_id, html, fin, CASE WHEN fin + 300 < length(html) AND strpos(reverse(substr(html, fin + 1, 300)), '>') BETWEEN 1 AND 299 THEN fin + 301 - strpos(reverse(substr(html, fin + 1, 300)), '>') ELSE least(fin + 300, length(html)) END, piece + 1 FROM c WHERE fin < length(html))
 SELECT page_id, piece::INTEGER AS piece, substr(html, begin_at + 1, fin - begin_at) AS part FROM c""")  # fmt: skip
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(pages(spark, sf_dir)).select("page_id", F.posexplode(X.chunk_html(F.col("html"), 300)).alias("piece", "part"))


@query("""WITH d AS (SELECT row_no, coalesce(title, '') AS t, coalesce(source_site, '') AS s FROM dataset)
 SELECT row_no AS page_id, regexp_replace(regexp_replace(t || chr(10) || 'Home' || chr(10) || t || chr(10) || t || chr(10) || chr(10) || 'Report & annex' || chr(10) || chr(10) || 'Mail' || chr(10) || chr(10) || s || chr(10), '\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM d""")  # fmt: skip
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(pages(spark, sf_dir)).select("page_id", X.html_to_text("html").alias("body"))


@query("SELECT row_no, '--- asset_01 (pdf): ' || coalesce(title, '') || ' ---' || chr(10) || coalesce(id, '') || chr(10) || chr(10) || '--- asset_02 (csv):  ---' || chr(10) || coalesce(date, '') AS text FROM dataset")
def asset_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset")
    two = F.explode(F.array(F.struct(F.lit(2).alias("rank"), F.lit("csv").alias("kind"), F.lit(None).cast("string").alias("anchor"), F.col("date").alias("text")), F.struct(F.lit(1).alias("rank"), F.lit("pdf").alias("kind"), F.col("title").alias("anchor"), F.col("id").alias("text"))))
    return inspection.asset_text(d.select("row_no", two.alias("x")).select("row_no", "x.*"), "row_no")


@query("SELECT n_nationkey, least(80000, greatest(8000, (n_nationkey * 4000 - 1000 - 3000) * 4))::BIGINT AS n FROM nation")
def chunk_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, [(r.n_nationkey, chunk_budget(r.n_nationkey * 4000, 1000)) for r in table(spark, sf_dir, "nation").collect()], "n_nationkey int, n long")


@query("SELECT row_no, CASE WHEN row_no % 3 = 0 THEN 'value ' || row_no::VARCHAR ELSE 'n=' || row_no::VARCHAR END AS found FROM dataset")
def probe_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern suggested for a value finds it again on every page of the same make."""
    d = table(spark, sf_dir, "dataset")
    html = F.concat(F.lit('<p class="a">x</p><p class="v">'), F.when(F.col("row_no") % 3 == 0, F.concat(F.lit("value "), F.col("row_no").cast("string"))).otherwise(F.concat(F.lit("n="), F.col("row_no").cast("string"))), F.lit("</p>"))
    shown = spark.createDataFrame([(1, '<p class="a">x</p><p class="v">known</p>')], "k int, html string")
    pattern = inspection.probe_values(shown, ["known"], "k").first().pattern
    return d.select("row_no", F.regexp_extract(html, pattern, 1).alias("found"))


# ---- queue


@query("SELECT user_id::VARCHAR AS user_id FROM events WHERE user_id <= 20 UNION SELECT user_id::VARCHAR FROM events WHERE event_type = 'purchase'")
def queue_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return queueing.mark_done(e.where("user_id <= 20").select("user_id"), e.where("event_type = 'purchase'").select("user_id"), "user_id")


@query("""SELECT n_nationkey, CASE WHEN n_regionkey = 0 AND n_nationkey > 2 THEN 1 ELSE 0 END::INTEGER AS first_page, CASE WHEN n_regionkey = 1 THEN n_nationkey + 5 WHEN n_regionkey = 2 THEN 20 ELSE 100 // (n_regionkey + 7) + 5 END::INTEGER AS n_pages FROM nation""")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for r in table(spark, sf_dir, "nation").collect():
        first = queueing.first_page({0: r.n_regionkey, 1: max(0, r.n_nationkey - 2)})
        out.append((r.n_nationkey, first, queueing.pages_to_fetch(100, None if r.n_regionkey == 2 else r.n_regionkey + 7, r.n_nationkey if r.n_regionkey == 1 else None)))
    return _values(spark, out, "n_nationkey int, first_page int, n_pages int")


@query("""SELECT row_no, CASE row_no % 7 WHEN 0 THEN 'no_page' WHEN 1 THEN 'page_from_0' WHEN 2 THEN 'page_from_1' WHEN 3 THEN 'p_from_1' WHEN 4 THEN 'p_from_0' WHEN 5 THEN 'offset' ELSE 'single_page' END AS verdict FROM dataset""")
def paging_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset")
    k, page = F.col("row_no") % 7, F.concat_ws("|", F.lit("page"), "title")
    other = F.concat(page, F.lit("2"))
    on = lambda *ks: F.when(k.isin(*ks), other).otherwise(page)
    v = d.select("row_no", F.when(k != 0, page).alias("base"), page.alias("page0"), on(1).alias("page1"), on(1, 2).alias("page2"), on(3).alias("p2"), on(4).alias("p1"), on(5).alias("offset"))
    return v.select("row_no", queueing.pagination_verdict(v).alias("verdict"))


@query("""SELECT row_no, unnest(['base', 'page1', 'offset']) AS variant, unnest([length(t), length(t) + 7, length(t)])::INTEGER AS n_chars, unnest([1, 2, 1])::INTEGER AS n_rows, unnest([TRUE, FALSE, TRUE]) AS same_as_first FROM (SELECT row_no, '<p>' || coalesce(replace(title, '<p>', ''), '') AS t FROM dataset)""")
def paging_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("<p>"), F.coalesce(F.replace("title", F.lit("<p>"), F.lit("")), F.lit("")))
    d = table(spark, sf_dir, "dataset").select("row_no", base.alias("base"), F.concat(base, F.lit("<p>more")).alias("page1"), base.alias("offset"), F.lit(None).cast("string").alias("page2"))
    return queueing.paging_variants(d, "row_no", row_pattern="<p>")


@query(_sql_values([("no rows", True), ("filters", True), ("empty fields", True), ("good", False)], "sample, refused"))
def sample_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset").where("title is not null and detail_url is not null").select("row_no", "title", "detail_url")
    samples = {"no rows": d.where("false"), "filters": d.withColumn("detail_url", F.lit("/list?facet=1")), "empty fields": d.withColumn("title", F.lit("")).withColumn("detail_url", F.lit(None).cast("string")), "good": d}
    out = []
    for name, df in samples.items():
        try:
            pipeline.check_sample(df, ["title", "detail_url"], ["row_no"])
            out.append((name, False))
        except pipeline.HarvestRefused:
            out.append((name, True))
    return _values(spark, out, "sample string, refused boolean")


@query("""SELECT row_no, CASE WHEN row_no % 4 <> 0 THEN coalesce(title, '') END AS heading, row_no % 4 = 0 AS failed FROM dataset""")
def processed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's page looked up and read; those without a page come out as failures."""
    d = table(spark, sf_dir, "dataset").select("row_no", F.concat(F.lit("u"), F.col("row_no").cast("string")).alias("detail_url"), "title")
    held = d.where("row_no % 4 != 0").select(F.col("detail_url").alias("url"), F.concat(F.lit("<h1>"), F.coalesce("title", F.lit("")), F.lit("</h1>")).alias("html"))
    spec = Spec.normalise({"fields": {"heading": "<h1>(.*?)</h1>"}})
    good, failed = pipeline.process_queue(d.drop("title"), held, "detail_url", "row_no", spec, order="row_no")
    return good.select("row_no", "heading", F.lit(False).alias("failed")).unionAll(failed.select("row_no", F.lit(None).cast("string"), F.lit(True)))


@query("SELECT row_no, 'first' AS run FROM (SELECT row_no FROM dataset ORDER BY row_no LIMIT 3) UNION ALL SELECT row_no, 'later' FROM dataset")
def pilot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset").select("row_no")
    first, later = queueing.pilot(d, d.where("false"), "row_no"), queueing.pilot(d, d, "row_no")
    return first.withColumn("run", F.lit("first")).unionAll(later.withColumn("run", F.lit("later")))


@query(_sql_values([(10, False), (50, False), (51, True)], "n, refused"))
def force_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset").select("row_no").orderBy("row_no")
    out = []
    for n in (10, 50, 51):
        some = d.limit(n)
        try:
            pipeline.guard_force(some, some, "row_no")
            out.append((n, False))
        except PermissionError:
            out.append((n, True))
    return _values(spark, out, "n int, refused boolean")


# ---- rows


@query("""SELECT row_no, CASE WHEN coalesce(id, '') IN ('', '0') THEN 'sig_' || left(sha1('{"title": ' || coalesce('"' || replace(replace(title, '\\', '\\\\'), '"', '\\"') || '"', 'null') || '}'), 12) ELSE id END AS id FROM dataset""")
def ensured_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset").select("id", "title", F.col("row_no").alias("_no"))
    return rows.with_id(d).select(F.col("_no").alias("row_no"), "id")


@query("SELECT ex_no, sector AS branch FROM extracted")
def scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows brought along with an edited codebook."""
    book = Codebook("c", [VariableSpec("sector"), VariableSpec("status_code"), VariableSpec("name")])
    change = book.edit(drop=["status_code", "name"], rename={"sector": "branch"})
    e = table(spark, sf_dir, "extracted").select("ex_no", "sector", "status_code", "name")
    return rows.scrub(e, change["drop"], change["rename"], change["keep_only"], "ex_no")


@query("SELECT ex_no, coalesce(has_appeal, FALSE) AS has_appeal, is_public FROM extracted")
def boolean_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.fill_booleans(table(spark, sf_dir, "extracted").select("ex_no", "has_appeal", "is_public"), ["has_appeal"])


@query("SELECT n_rows, n_left FROM (SELECT count(*) AS n_rows FROM documents), (SELECT 0::BIGINT AS n_left)")
def wiped(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = pipeline.Dataset(table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("_ord")), "doc_id")
    n = data.df.count()
    data.wipe()
    return data.df.agg(F.lit(n).cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_left"))


@query("SELECT doc_id FROM documents WHERE lang = 'fr'")
def reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that another program has written since it was read."""
    at, d = folder(spark), table(spark, sf_dir, "documents").select("doc_id", "lang")
    d.write.parquet(at)
    data = pipeline.Dataset(spark.read.parquet(at), "doc_id")
    d.where("lang = 'fr'").write.mode("overwrite").parquet(at)
    data.changed_outside(at, d.schema, "parquet")
    return data.df.select("doc_id")


@query("SELECT 'same' AS pair, 1.0::DOUBLE AS overlap, FALSE AS refused UNION ALL SELECT 'other', (1.0 / 7)::DOUBLE, TRUE")
def shape_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    other = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_orderkey").alias("o_custkey"), "l_partkey", "l_suppkey", "l_quantity", "l_tax")
    same, differs = rows.shape_lock(o, o, "o_orderkey"), rows.shape_lock(o, other, "o_orderkey")
    return same.withColumn("pair", F.lit("same")).unionByName(differs.withColumn("pair", F.lit("other")))


@query("""SELECT row_no, CASE WHEN row_no % 2 = 0 AND length(text) >= 200 THEN TRY_CAST(regexp_extract(text, '([0-9]{4})', 1) AS BIGINT) END AS n_year, CASE WHEN length(text) >= 200 THEN 'ok' WHEN (CASE WHEN coalesce(title, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(id, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(date, '') <> '' THEN 1 ELSE 0 END) >= 3 THEN 'ok' ELSE 'no_text' END AS status FROM dataset WHERE row_no % 2 = 0""")
def extraction_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows the typed table lacks, whatever text they have; those without enough say so."""
    d = table(spark, sf_dir, "dataset").select("row_no", "text", "title", "id", "date")
    book = Codebook("years", [VariableSpec("n_year", "integer")])
    rule = extraction.RuleExtractor({"n_year": r"^(?!text:|title:|id:|date:).*?([0-9]{4})"})
    out = extraction.extract_missing(spread(d), d.where("row_no % 2 = 1").select("row_no"), book, rule, "row_no", "text")
    long_text = d.select("row_no", (F.coalesce(F.length("text"), F.lit(0)) >= 200).alias("_long"))
    return out.join(long_text, "row_no").select("row_no", F.when(F.col("_long"), F.col("n_year")).alias("n_year"), F.col("_extract_status").alias("status"))


@query("SELECT ex_no, status_code, CASE WHEN regexp_matches(case_ref, '[0-9]{4}') THEN CAST(regexp_extract(case_ref, '([0-9]{4})', 1) AS BIGINT) END AS n_year FROM extracted")
def partial_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new variable filled into typed rows, laid over what they hold."""
    e = table(spark, sf_dir, "extracted").select("ex_no", "status_code", "case_ref")
    silver = e.select("ex_no", "status_code", F.lit(-1).cast("long").alias("n_year"))
    book = Codebook("c", [VariableSpec("status_code"), VariableSpec("n_year", "integer")])
    return extraction.fill_new(e, silver, book, ["n_year"], extraction.RuleExtractor({"n_year": r"([0-9]{4})"}), "ex_no", "case_ref")


@query("SELECT row_no, strip_accents(title) AS title FROM dataset")
def without_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dataset").select("row_no", C.strip_accents(F.col("title")).alias("title"))


# ---- codebooks: those of the tables

_TYPED = {"name": "enum"}


def codebooks(spark: SparkSession, sf_dir: str) -> list[Codebook]:
    """The codebooks of the table of variables, through their file format."""
    out: dict[str, dict] = {}
    for r in table(spark, sf_dir, "variable_spec").orderBy("collection", "name").collect():
        v = {"name": r.name, "type": r.var_type, "enum_values": list(r.enum_values or []) or None, "min_value": r.min_value, "max_value": r.max_value, "required": r.required, "pass_": r.pass_no, "more": 1}
        out.setdefault(r.collection, {"name": r.collection, "variables": []})["variables"].append(v)
    return [Codebook.from_dict(Codebook.from_dict(x).to_dict()) for x in out.values()]


@query("SELECT collection, name, min_value, max_value, required, pass_no FROM variable_spec")
def codebook_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = [(b.name, v.name, v.min_value, v.max_value, v.required, v.pass_) for b in codebooks(spark, sf_dir) for v in b.variables]
    return _values(spark, data, "collection string, name string, min_value double, max_value double, required boolean, pass_no int")


@query("SELECT collection, var_type, count(*) AS n, round((SELECT avg(CASE WHEN s.var_type IN ('integer', 'float', 'boolean') THEN 1.0 ELSE 0 END) FROM variable_spec s WHERE s.collection = v.collection), 6)::DOUBLE AS ratio FROM variable_spec v GROUP BY collection, var_type")
def codebook_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, [(b.name, k, n, round(b.numeric_or_boolean_ratio(), 6)) for b in codebooks(spark, sf_dir) for k, n in b.type_breakdown().items()], "collection string, var_type string, n long, ratio double")


@query(f"SELECT collection, name, pass_no, CASE var_type {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in JSON_TYPES.items())} END AS json_type, CASE WHEN var_type = 'enum' THEN len(enum_values) + 1 END::INTEGER AS n_enum, coalesce(required, FALSE) AS required FROM variable_spec")
def codebook_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON Schemas by pass."""
    out = []
    for b in codebooks(spark, sf_dir):
        for p in sorted({v.pass_ for v in b.variables}):
            schema = b.json_schema(p)
            assert [v.name for v in b.by_pass(p)] == list(schema["properties"])
            out += [(b.name, n, p, x["type"][0], len(x["enum"]) if "enum" in x else None, n in schema["required"]) for n, x in schema["properties"].items()]
    return _values(spark, out, "collection string, name string, pass_no int, json_type string, n_enum int, required boolean")


@query("SELECT collection, name FROM variable_spec WHERE name NOT IN ('sector', 'name') UNION ALL SELECT DISTINCT collection, unnest(['label', 'extra']) FROM variable_spec")
def codebook_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One variable dropped, one renamed, one added, and a locked one that stays."""
    out = []
    for b in codebooks(spark, sf_dir):
        try:
            b.edit(drop=["status_code"], locked={"status_code"})
        except PermissionError:
            pass
        b.edit(drop=["sector"], rename={"name": "label"}, add=[VariableSpec("extra")], required={"extra": True})
        out += [(b.name, v.name) for v in b.variables]
    return _values(spark, out, "collection string, name string")


_SIGNATURE = [("as it is", False), ("required", False), ("notes", False), ("pass", True), ("range", True), ("hint", True), ("enum", True)]


@query(_sql_values(_SIGNATURE, "changed, stale"))
def codebook_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda **x: Codebook("c", [VariableSpec(**({"name": "a", "type": "enum", "enum_values": ["x"]} | x))]).extraction_signature()
    changes = {"as it is": {}, "required": {"required": True}, "notes": {"adversary_notes": ["n"]}, "pass": {"pass_": 2}, "range": {"max_value": 9.0}, "hint": {"extraction_hint": "h"}, "enum": {"enum_values": ["x", "y"]}}
    return _values(spark, [(k, made(**v) != made()) for k, v in changes.items()], "changed string, stale boolean")


_CHECKS = [("no name", True), ("unknown type", True), ("enum without values", True), ("array without items", True), ("same name twice", True), ("no variables", True), ("good", False)]


@query(_sql_values(_CHECKS, "book, refused"))
def codebook_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = VariableSpec
    books = {"no name": [v(" ")], "unknown type": [v("a", "blob")], "enum without values": [v("a", "enum")], "array without items": [v("a", "array")], "same name twice": [v("a"), v("a")], "no variables": [], "good": [v("a"), v("b", "enum", enum_values=["x"])]}
    out = []
    for name, variables in books.items():
        try:
            Codebook("c", variables).validate()
            out.append((name, False))
        except ValueError:
            out.append((name, True))
    return _values(spark, out, "book string, refused boolean")


@query("SELECT collection, name, contains(v.line, 'required') AS required FROM (SELECT collection, name, CASE WHEN required THEN 'required' ELSE '' END AS line FROM variable_spec) v")
def codebook_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook shown as text: one line per variable."""
    out = []
    for b in codebooks(spark, sf_dir):
        lines = tools.show_codebook(b).splitlines()[1:]
        out += [(b.name, line[2:].split(" (")[0], line.endswith("required") or ", required," in line) for line in lines]
    return _values(spark, out, "collection string, name string, required boolean")


@query("SELECT 'n_year' AS variable, 10::BIGINT AS n_rows, 10::BIGINT AS n_non_null UNION ALL SELECT 'nothing', 10, 0")
def codebook_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook tried on a sample of ten rows."""
    book = Codebook("c", [VariableSpec("n_year", "integer"), VariableSpec("nothing")])
    d = table(spark, sf_dir, "dataset").where("id rlike '-[0-9]{4}-'").select("row_no", "id", F.col("row_no").alias("_ord"))
    stats = tools.codebook_test(d, book, extraction.RuleExtractor({"n_year": "-([0-9]{4})-", "nothing": "%%%"}), "row_no", "id", "_ord", 10)
    return stats.select("variable", "n_rows", "n_non_null")


@query("SELECT * FROM (VALUES ('has_db', 'boolean'), ('n_seats', 'integer')) t(name, type)")
def codebook_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a proposer answers, of variables that say the same the first."""
    answer = '{"name": "p", "variables": [{"name": "has_db", "type": "boolean"}, {"name": "is_mentions_database", "type": "boolean"}, {"name": "n_seats", "type": "integer"}]}'
    d = table(spark, sf_dir, "dataset").select("row_no", "title", F.col("row_no").alias("_ord"))
    book = tools.propose_codebook(d, lambda text: f"Here: {answer}", "_ord")
    return _values(spark, [(v.name, v.type) for v in book.variables], "name string, type string")


@query("SELECT row_no FROM dataset WHERE row_no IN (SELECT min(row_no) FROM dataset UNION ALL SELECT max(row_no) FROM dataset) UNION ALL SELECT r_regionkey FROM region")
def stratified_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last of many rows; all of few."""
    d = table(spark, sf_dir, "dataset").select("row_no")
    ends = d.agg(F.min("row_no").alias("a"), F.max("row_no").alias("b")).first()
    sample = rows.stratified_sample(d, 20, "row_no").where(F.col("row_no").isin(ends.a, ends.b))
    few = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("row_no"))
    return sample.unionAll(rows.stratified_sample(few, 10, "row_no"))


# ---- contracts and profiles

_VARIANTS = ["case", "n_case", "num_case", "number_of_case", "nb_case", "case_count", "case_total", "case_num", "case_number"]


@query(_sql_values([(v,) for v in ["n_case", "case", *[x for v in _VARIANTS[1:5] for x in (v.replace("case", "n_case"), v)], *[x for v in _VARIANTS[5:] for x in (v.replace("case", "n_case"), v)]] if v], "variant").replace("SELECT *", "SELECT DISTINCT *"))
def field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, [(v,) for v in contracts.field_variants("n_case")], "variant string")


@query("""SELECT 'codebook' AS name, FALSE AS ok UNION ALL SELECT 'mean amount', avg(amount_eur) > 0 FROM extracted UNION ALL SELECT 'n_rows', FALSE""")
def more_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract on the codebook, and two of one's own."""
    book = contracts.ContractBook()
    book.add(contracts.codebook_contract(BOOK, least=20))
    book.add(contracts.custom("mean amount", lambda df: {"m": F.avg("amount_eur")}, lambda v: (v["m"] > 0, str(v["m"]))))
    book.add(contracts.custom("n_rows", lambda df: {"n": F.count(F.lit(1))}, lambda v: (v["n"] < 0, str(v["n"]))))
    return book.status(table(spark, sf_dir, "extracted")).select("name", "ok")


@query(_sql_values([("all ok", False, True, "done"), ("rows only", False, False, "partial: fields"), ("rows only", True, True, "forced: fields"), ("nothing", False, False, "not yet: min_rows, fields")], "state, forced, may, how"))
def finish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = {"all ok": (True, True), "rows only": (True, False), "nothing": (False, False)}
    out = []
    for name, force in (("all ok", False), ("rows only", False), ("rows only", True), ("nothing", False)):
        a, b = states[name]
        out.append((name, force, *contracts.finish([("min_rows", a, ""), ("fields", b, "")], force)))
    return _values(spark, out, "state string, forced boolean, may boolean, how string")


_SPARSE = ["id", "title", "date", "text", "pdf_text", "text_path", "extra"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, round(avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0 END), 6)::DOUBLE AS share FROM dataset HAVING avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0 END) < 0.7" for c in _SPARSE))
def sparse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.sparse_fields(table(spark, sf_dir, "dataset").select(*_SPARSE)).withColumn("share", F.round("share", 6))


_NESTED = {"type": "object", "properties": {"who": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "enum": ["view", "click"]}}}, "list": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "integer", "enum": [0, 1, 2]}}}}}}


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN '$.who.name: required' WHEN event_type NOT IN ('view', 'click') THEN '$.who.name: not one of the allowed values' WHEN event_id % 4 = 3 THEN '$.list[1].n: not one of the allowed values' END AS violation FROM events""")
def nested_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") != "error", F.col("event_type"))
    items = F.array(F.struct(F.lit(0).cast("long").alias("n")), F.struct((F.col("event_id") % 4).alias("n")))
    d = e.select("event_id", F.struct(name.alias("name"), F.lit(1).alias("x")).alias("who"), items.alias("list"))
    return d.select("event_id", contracts.row_violation(_NESTED, d).alias("violation"))


def _validate_sql() -> str:
    parts = []
    for v in BOOK.variables:
        c = v.name
        given = f"{c} IS NOT NULL AND {c}::VARCHAR <> ''"
        share = f"avg(CASE WHEN {given} THEN 1.0 ELSE 0 END)"
        parts.append(f"SELECT '{c}' AS variable, 'coverage' AS fact, printf('%.8f', {share}) AS value FROM extracted")
        parts.append(f"SELECT '{c}', 'issue', 'low coverage' FROM extracted HAVING {share} < 0.2")
        if v.type == "date":
            parts += [f"SELECT '{c}', '{n} date', {f}(nullif({c}, '')) FROM extracted" for n, f in (("first", "min"), ("last", "max"))]
        if v.type == "enum":
            parts.append(f"SELECT '{c}', 'value ' || {c}, printf('%.8f', count(*) * 1.0 / (SELECT count(*) FROM extracted WHERE {given})) FROM extracted WHERE {given} GROUP BY {c}")
            parts.append(f"SELECT '{c}', 'issue', 'single-value enum' FROM extracted WHERE {given} HAVING count(DISTINCT {c}) = 1")
        if v.type == "boolean":
            parts.append(f"SELECT '{c}', 'issue', 'near-constant boolean' FROM extracted HAVING avg(CASE WHEN {c} THEN 1.0 WHEN NOT {c} THEN 0.0 END) >= 0.98 OR avg(CASE WHEN {c} THEN 1.0 WHEN NOT {c} THEN 0.0 END) <= 0.02")
    return " UNION ALL ".join(parts)


@query(_validate_sql())
def dataset_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.dataset_validate(table(spark, sf_dir, "extracted"), BOOK)


@query("""WITH c AS (SELECT avg(n) AS m, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS z FROM (SELECT avg(CASE WHEN title <> '' THEN 1.0 ELSE 0 END) AS n FROM dataset UNION ALL SELECT avg(CASE WHEN pdf_text <> '' THEN 1.0 ELSE 0 END) FROM dataset))
 SELECT round(m, 6)::DOUBLE AS mean_coverage, z::BIGINT AS n_zero, CASE WHEN m < 0.1 THEN 'FIX_BRONZE_FIRST' WHEN m < 0.4 OR z >= 3 THEN 'FIX_FIRST' ELSE 'SCALE_OK' END AS verdict FROM c""")  # fmt: skip
def pilot_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profiling.codebook_stats(table(spark, sf_dir, "dataset"), Codebook("c", [VariableSpec("title"), VariableSpec("pdf_text")]))
    v = profiling.pilot_verdict(stats)
    return v.select(F.round("mean_coverage", 6).alias("mean_coverage"), F.col("n_zero").cast("long").alias("n_zero"), "verdict")


@query("SELECT coalesce(collection, 'none') AS run, count(*) AS n_rows FROM documents GROUP BY 1")
def run_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/runs/"), F.coalesce("collection", F.lit("none")), F.lit("/rows.jsonl"))
    return pipeline.run_listing(d.select(path.alias("_path")))


@query("SELECT user_id, count(*) AS n_turns FROM events GROUP BY user_id HAVING count(*) >= 10 AND arg_max(CASE WHEN value > 50 THEN 1 ELSE 0 END, event_id) = 0")
def no_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 50, 1).otherwise(0).alias("n_rows"))
    return profiling.no_progress(e, "user_id", "event_id", "n_rows")


# ---- parsing, extraction, runs


@query("SELECT event_id, event_type AS tool, event_id % 2 = 0 AS flag FROM events")
def single_quoted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in single quotes with JSON's and Python's words."""
    e = spread(table(spark, sf_dir, "events"))
    flag = F.element_at(F.array(F.lit("true"), F.lit("False"), F.lit("True"), F.lit("false")), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat(F.lit("{'tool': '"), F.col("event_type"), F.lit("', 'none': null, 'say': 'a \"b\"', 'flag': "), flag, F.lit("}"))
    made = json_object(text)
    return e.select("event_id", made.alias("j")).select("event_id", F.get_json_object("j", "$.tool").alias("tool"), F.get_json_object("j", "$.flag").cast("boolean").alias("flag"))


@query("SELECT row_no, TRY_CAST(regexp_extract(id, '-([0-9]{4})-', 1) AS BIGINT) AS n_year, CASE WHEN NOT regexp_matches(coalesce(id, ''), '-[0-9]{4}-') THEN '$.n_year: required' END AS violation FROM dataset WHERE id IS NOT NULL")
def structured_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"required": ["n_year"], "properties": {"n_year": {"type": "integer"}}}
    d = spread(table(spark, sf_dir, "dataset").where("id is not null").select("row_no", "id"))
    return pipeline.extract_structured(d, schema, extraction.RuleExtractor({"n_year": "-([0-9]{4})-"}), "row_no", "id")


class _Lines:
    """Answers a page with one row per line that holds a code."""

    def __call__(self, text: str) -> str:
        import json
        import re

        return json.dumps([{"code": c, "more": 1} for c in re.findall(r"[A-Z]{3}-\d{4}-\d+", text)])


@query("SELECT DISTINCT regexp_extract(id, '([A-Z]{3}-[0-9]{4}-[0-9]+)', 1) AS code FROM dataset WHERE regexp_matches(id, '[A-Z]{3}-[0-9]{4}-[0-9]+')")
def scraped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "dataset").where("id is not null").select("row_no", F.concat(F.lit("<html><head>x</head><body>"), "id", F.lit("<p>"), "id", F.lit("</body></html>")).alias("html")))
    return extraction.scrape(d, _Lines(), "html", "row_no", ["code"], 8000).select("code")


_FIELDS = [("Number of pages", "n_pages"), ("count of appeals", "n_appeals"), ("whether there is a fine", "has_fine"), ("Any annex", "has_annex"), ("Decision date", "decision_date")]


@query(_sql_values(_FIELDS, "said, field"))
def planned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, [(s, snake_field(s)) for s, _ in _FIELDS], "said string, field string")


_GOALS = [("Get 250 cases from https://h.example/list?page=100.", "https://h.example/list?page=100", 250), ("all of 2 pages at http://h.example/a", "http://h.example/a", None), ("about 3.14 and 12345 things", None, None), ("the first 40", None, 40)]


@query(_sql_values(_GOALS, "goal, url, n_rows"))
def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, [(g, *goal_hints(g)) for g, _, _ in _GOALS], "goal string, url string, n_rows int")


@query("SELECT r_regionkey, '{\"k\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}' AS line FROM region")
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows as lines for a question about the data."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    lines = pipeline.context_snippet(r, order="k").splitlines()
    return _values(spark, list(enumerate(lines)), "r_regionkey int, line string")


_PHASES = {
    "nothing yet": RunState(target=10), "a page": RunState(target=10, has_page=True), "no queue": RunState(target=10, has_page=True, has_extractor=True), "pending": RunState(target=10, has_page=True, has_extractor=True, n_queue=9, n_pending=5),
    "rows enough": RunState(n_rows=10, target=10, wants_codebook=True), "texts missing": RunState(n_rows=10, target=10, wants_codebook=True, text_share=0.5), "stale": RunState(n_rows=10, target=10, wants_codebook=True, has_codebook=True, n_silver=4, stale_codebook=True),
    "typed": RunState(n_rows=10, target=10, has_codebook=True, n_silver=10), "exported": RunState(n_rows=10, target=10, exported=True), "all ok": RunState(n_rows=10, target=10, contracts_ok=True), "nearly, with errors": RunState(n_rows=8, target=10, recent_errors=3),
    "was extracting": RunState(n_rows=3, target=10, was_extracting=True, has_codebook=True, n_silver=3),
}


@query(_sql_values([
    ("nothing yet", "DISCOVER_LISTING"), ("a page", "DEFINE_EXTRACTOR"), ("no queue", "ENUMERATE"), ("pending", "PROCESS"), ("rows enough", "CODEBOOK"), ("texts missing", "PROCESS"), ("stale", "EXTRACT"), ("typed", "EXPORT"), ("exported", "FINISH"),
    ("all ok", "FINISH"), ("nearly, with errors", "EXPORT"), ("was extracting", "EXPORT"),
], "state, phase"))
def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, [(k, current_phase(s)) for k, s in _PHASES.items()], "state string, phase string")


@query(_sql_values([("filled", 10), ("kept", 12), ("put right", 10), ("refused", None)], "plan, pages_needed"))
def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = {"item": "case", "source": "listing_html", "harvest_strategy": "listing_only", "items_per_page": 10, "target_rows": 100}
    given = {"filled": {}, "kept": {"pages_needed": 12}, "put right": {"pages_needed": 90}, "refused": {"source": "moon"}}
    out = []
    for name, more in given.items():
        try:
            out.append((name, Plan.validated(base | more).pages_needed))
        except PlanError:
            out.append((name, None))
    return _values(spark, out, "plan string, pages_needed int")


@query(_sql_values([("inside", True), ("a/../b", True), ("../out", False), ("/etc/passwd", False)], "path, allowed"))
def path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    import tempfile

    out = []
    with tempfile.TemporaryDirectory() as root:
        for path in ("inside", "a/../b", "../out", "/etc/passwd"):
            try:
                files.confined(root, path)
                out.append((path, True))
            except PermissionError:
                out.append((path, False))
    return _values(spark, out, "path string, allowed boolean")


_TALK = [
    ("zap", {}, True), ("python", {"code": "1"}, True), ("memory_set", {"key": "a", "value": 1}, False), ("memory_get", {"key": "a"}, False), ("write_file", {"path": "x.txt", "text": "hello"}, False), ("read_file", {"path": "x.txt"}, False), ("read_file", {"path": "../x"}, True),
    ("dataset_append", {"rows": [{"id": "1", "t": "a"}, {"id": "1", "t": "b"}, {"id": "2", "t": "c"}]}, False), ("dataset_patch", {"patches": [{"id": "2", "t": "z"}]}, False), ("dataset_sample", {"n": 2}, False), ("dataset_stats", {}, False), ("queue_add", {"items": [{"id": "q1"}, {"id": "q2"}]}, False),
    ("queue_mark_done", {"id": "q1"}, False), ("queue_next", {}, False), ("queue_status", {}, False), ("set_plan", {"item": "x", "source": "feed", "harvest_strategy": "api_only"}, False), ("show_plan", {}, False), ("html_find", {"source": "<p class=\"a\">x</p>", "class_token": "a"}, False),
    ("codebook_show", {}, False), ("dataset_validate", {}, False), ("finish", {}, False),
]


@query(_sql_values([(i, name, failed) for i, (name, _, failed) in enumerate(_TALK)], "turn, tool, failed"))
def tool_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run by tool names: what is unknown or refused fails, all else works."""
    import tempfile

    with tempfile.TemporaryDirectory() as root:
        registry = tools.default_registry(spark, root)
        out = [(i, name, registry.run(name, **args)[1]) for i, (name, args, _) in enumerate(_TALK)]
    return _values(spark, out, "turn int, tool string, failed boolean")


@query(_sql_values([(n,) for n in [*tools.NAMES, *tools.WITH_EXTRACTOR]], "tool"))
def tool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    import tempfile

    with tempfile.TemporaryDirectory() as root:
        return _values(spark, [(n,) for n in tools.default_registry(spark, root, extractor=_Lines()).tools], "tool string")


@query("""WITH d AS (SELECT row_no, title, row_number() OVER (ORDER BY row_no) - 1 AS k FROM dataset WHERE title IS NOT NULL) SELECT 'https://h.example/' || row_no::VARCHAR AS detail_url, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS title, CASE WHEN row_no % 5 <> 0 THEN row_no END AS n_case FROM d WHERE row_no % 5 <> 0""")
def pipeline_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From listing pages over detail pages to typed rows, verified, exported and read back."""
    d = table(spark, sf_dir, "dataset").where("title is not null").select("row_no", "title")
    n = F.col("row_no").cast("string")
    listing = d.groupBy(F.floor(F.col("row_no") / 40).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", F.concat(F.lit('<li><a href="/'), n, F.lit('">'), "title", F.lit("</a></li>")).alias("h")))), lambda x: x["h"]), "").alias("html"))
    details = d.where("row_no % 5 != 0").select(F.concat(F.lit("https://h.example/"), n).alias("url"), F.concat(F.lit("<p>Case number "), n, F.lit(" " + "x" * 200 + "</p>")).alias("html"))
    spec = Spec.normalise({"row_pattern": r"<li>(.*?)</li>", "base_url": "https://h.example", "fields": {"detail_url": {"regex": r'href="([^"]+)"', "prefix_base": True}, "title": {"regex": r"<a[^>]*>(.*?)</a>", "transform": "strip"}}})
    pipe = pipeline.Pipeline(codebook=Codebook("cases", [VariableSpec("n_case", "integer", required=True)]))
    pipe.book.add(contracts.min_rows(1))
    got = pipe.run(listing, spec, "page", details, detail=Spec.normalise({"fields": {"body": "<p>(.*?)</p>"}}), extractor=extraction.RuleExtractor({"n_case": r"number (\d+)"}), out_dir=folder(spark))
    assert got["verified"]["ok"] and got["phase"] == "FINISH"
    out = spark.read.parquet(got["paths"]["parquet"]).select("detail_url", "title", "n_case")
    pipe.close()
    return out


@query("SELECT r_name AS name, 'event' AS log, r_regionkey::BIGINT AS n FROM region UNION ALL SELECT r_name, 'failure', length(repeat(r_name, 1000))::BIGINT FROM region WHERE length(r_name) * 1000 < 2000 UNION ALL SELECT r_name, 'failure', 2000 FROM region WHERE length(r_name) * 1000 >= 2000")
def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and failures as a run writes them, read back as tables; a subscriber that fails doesn't matter, raw answers are cut in the log."""
    import tempfile

    from dsforge.plans.control import Tracer, log_failure

    with tempfile.TemporaryDirectory() as root:  # a run's own log is a file of the driver
        tracer = Tracer(f"{root}/trace.jsonl")
        tracer.subscribers.append(lambda record: 1 / 0)
        for r in table(spark, sf_dir, "region").collect():
            tracer.event("turn", name=r.r_name, n=r.r_regionkey)
            log_failure(f"{root}/failures.jsonl", r.r_name, r.r_name * 1000)
        events = [(r.name, "event", r.n) for r in files.read_jsonl(spark, f"{root}/trace.jsonl", "name string, n long").collect()]
        failures = [(r.where, "failure", len(r.raw)) for r in files.read_jsonl(spark, f"{root}/failures.jsonl", "`where` string, raw string").collect()]
    return _values(spark, events + failures, "name string, log string, n long")


@query("SELECT 'phase' AS line, 'FINISH' AS said UNION ALL SELECT 'rows', count(*)::VARCHAR || ' of 1' FROM dataset UNION ALL SELECT 'queue', '0' UNION ALL SELECT 'typed', '0' UNION ALL SELECT 'ok  min_rows', count(*)::VARCHAR || ' of 1 rows' FROM dataset")
def state_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = pipeline.Pipeline(bronze=table(spark, sf_dir, "dataset").select(F.col("row_no").alias("id"), F.col("row_no").alias("_ord")))
    pipe.book.add(contracts.min_rows(1))
    return _values(spark, [tuple(x.split(": ", 1)) for x in pipeline.describe(pipe, 1).splitlines()], "line string, said string")


@query("SELECT 'o_orderkey' AS variable, count(o_orderkey)::VARCHAR AS n_covered, count(*)::VARCHAR AS n_rows FROM orders UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus <> '')::VARCHAR, count(*)::VARCHAR FROM orders")
def stats_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profiling.field_coverage(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"]).select("variable", "n_covered", "n_rows")
    return _values(spark, [tuple(x.split()) for x in pipeline.format_stats(stats).splitlines()[1:]], "variable string, n_covered string, n_rows string")


@query("SELECT 'items/item_' || lpad(n_regionkey::VARCHAR, 4, '0') || '/attachment_' || lpad(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::VARCHAR, 2, '0') || '.txt' AS saved_as, n_name AS text FROM nation")
def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files saved in their items' folders and read back."""
    at = folder(spark)
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.lit(".txt").alias("ext"), F.col("n_name").cast("binary").alias("content"), F.col("n_name").alias("text"))
    placed = fetch.attachment_paths(n, "n_regionkey", "n_nationkey", "ext")
    fetch.save_attachments(placed, at)
    back = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(at)
    return back.select(F.regexp_extract(F.col("_metadata.file_path"), r"(items/.*)$", 1).alias("saved_as"), F.col("value").alias("text"))


_SHOWN = [(0.125, "12%"), (0.375, "38%"), (0.005, "0%"), (0.015, "2%"), (1.0, "100%")]


@query(_sql_values(_SHOWN, "share, shown"))
def shares_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares as a data card shows them: half to even on the binary value."""
    out = []
    for x, _ in _SHOWN:
        card = export.data_card(Codebook("c", [VariableSpec("v")]), [{"variable": "v", "n_non_null": x * 1000, "n_rows": 1000}], 1)
        out.append((x, card.split("| v | string | ")[1].split(" |")[0]))
    return _values(spark, out, "share double, shown string")


# ---- streams: the events as a growing folder


def _drained(spark: SparkSession, sf_dir: str, make, schema: str, mode: str = "append", columns: tuple[str, ...] = ("user_id", "event_id", "event_type", "value")) -> DataFrame:
    at = folder(spark)
    stream = incremental.read_rows(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema, "parquet").select(*columns)
    writer = make(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "complete":
        writer.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{at}/out")).start().awaitTermination()
    else:
        writer.format("parquet").option("path", f"{at}/out").start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


@query("SELECT event_type, count(*) AS n_events FROM events GROUP BY event_type")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, lambda s: incremental.live_counters(s, "event_type"), "event_type string, n_events long", "complete")


@query("SELECT event_id FROM events WHERE user_id > 20")
def stream_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed rows that the typed table lacks."""
    at, e = folder(spark), table(spark, sf_dir, "events")
    step = incremental.missing_from(lambda: e.where("user_id <= 20").select("user_id"), "user_id", lambda df, epoch: df.select("event_id").write.mode("append").parquet(f"{at}/out"))
    stream = incremental.read_rows(spark, f"{sf_dir}/events.parquet*", e.schema, "parquet").select("user_id", "event_id")
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long").parquet(f"{at}/out")


@query("""WITH i AS (SELECT user_id, event_id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS h, sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
 n AS (SELECT user_id, event_id, sum(h) OVER (PARTITION BY user_id, g ORDER BY event_id)::BIGINT AS n_in_a_row FROM i) SELECT * FROM n WHERE n_in_a_row >= 3""")  # fmt: skip
def stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda s: incremental.failures_in_a_row(s.withColumn("failed", F.coalesce(F.col("value") > 50, F.lit(False))), "user_id", "event_id", "failed")
    return _drained(spark, sf_dir, make, "user_id long, event_id long, n_in_a_row long")
