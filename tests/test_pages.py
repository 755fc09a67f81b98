"""Specs, markup, tolerant JSON, text out of files, extraction, export and streams."""

import gzip
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from dsforge.functions import text as X
from dsforge.functions import tolerant_json as J
from dsforge.operators import extraction, inspection, profiling
from dsforge.plans.model import Codebook, VariableSpec
from dsforge.plans.spec import Spec, SpecError
from dsforge.sources import export, files
from dsforge.sources.extract_text import extract_text, with_text
from dsforge.streaming import incremental

TABLE = "<table>" + "".join(f"<tr><td>{i}</td><td>name {i}</td></tr>" for i in range(3)) + "</table>"


def test_spec(spark):
    pages = spark.createDataFrame([(1, TABLE), (2, None), (3, "")], "k int, html string")
    spec = Spec.normalise({"row_pattern": r"<tr>(.*?)</tr>", "fields": {"n": r"<td[^>]*>(.*?)</td>", "name": {"pattern": r"<td[^>]*>(.*?)</td>"}}})
    assert [(r.n, r.name) for r in spec.positional_cells().listing(pages, keep=("k",)).orderBy("_pos").collect()] == [(str(i), f"name {i}") for i in range(3)]
    loose = Spec.normalise({"row_pattern": r'<div class="row card">(.*?)</div>', "fields": {"x": "(.+)"}}).loose_class()
    html = spark.createDataFrame([(1, '<div class="card big row">hit</div>')], "k int, html string")
    assert loose.listing(html).count() == 1
    for bad in ({"row_regex": "x", "fields": {"a": "b"}}, {"fields": {"a": {"css": "x"}}}, {"fields": {"a": "("}}, {"fields": {"a": {"regex": "x", "transform": "odd"}}}, {}):
        with pytest.raises(SpecError):
            Spec.normalise(bad)


def test_markup(spark):
    page = "<html><head><title>t</title></head><body><nav>n</nav><p>a &amp; b</p><script>x</script><!-- c --></body></html>"
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(X.strip_tags(F.col("h"))).collect()][0].endswith("a & b x")
    assert df.select(X.strip_chrome(F.col("h"))).first()[0] == "<html><body><p>a &amp; b</p></body></html>"
    assert X.html_text("<p>a<br>b</p><script>no</script><div>c &eacute;</div>") == "a\nb\n\nc é"
    assert X.chunks("<a>xx</a>" * 10, 20) == ["<a>xx</a>" * 2] * 5
    assert "".join(X.chunks("y" * 5001, 1000)) == "y" * 5001


def test_tolerant_json():
    assert J.parse_object('Sure:\n```json\n{"a": [1, 2,],}\n```') == {"a": [1, 2]}
    assert J.parse_object("{'a': 'it', 'b': None}") == {"a": "it", "b": None}
    assert J.parse_object('{"a": {"b": "x') == {"a": {"b": "x"}}
    assert J.parse_object("no") is None and J.parse_object(None) is None
    assert J.parse_rows('{"items": [{"a": 1}, 2]}') == [{"a": 1}] and J.parse_rows('{"a": 1}') == [{"a": 1}] and J.parse_rows("[]") == []
    assert J.parse_call('<tool_call>{"name": "t", "arguments": "{\\"x\\": 1}"}</tool_call>') == ("t", {"x": 1}, None)
    assert J.parse_call("rubbish")[2] == "no tool call"


def test_extract_text(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.html", "<p>one</p>")
        z.writestr("b.csv", "x,y\n1,2\n")
    assert extract_text("f.zip", inner.getvalue()) == "\n=== a.html ===\none\n=== b.csv ===\nx\ty\n1\t2"
    assert extract_text("t.txt.gz", gzip.compress(b"plain")) == "plain"
    assert extract_text("x.json", b"{broken").startswith("ERROR:") and extract_text("x", "é".encode("latin-1")) == "é"
    df = spark.createDataFrame([("a.xml", bytearray(b"<?xml version='1.0'?><r>hi <b>you</b></r>")), ("n", None)], "path string, content binary")
    assert [(r.kind, r.text, r.error) for r in with_text(df).orderBy("path").collect()] == [("xml", "hi you", None), (None, None, None)]


def test_extraction_pipeline(spark):
    book = Codebook("b", [VariableSpec("n_items", "integer"), VariableSpec("is_open", "boolean")])
    bronze = spark.createDataFrame([(1, "items: 5, open: yes " + "x" * 200), (2, "items: none " + "x" * 200), (3, "short"), (4, None)], "id int, text string")
    rule = extraction.RuleExtractor({"n_items": r"items: (\w+)", "is_open": r"open: (\w+)"})
    silver = spark.createDataFrame([(2,)], "id int")
    # rows without enough text are marked, not lost; a row marked before is tried again, one extracted before is not
    silver = silver.selectExpr("id", "'ok' as _extract_status").unionAll(spark.createDataFrame([(3, "no_text")], "id int, _extract_status string"))
    got = extraction.extract_missing(bronze, silver, book, rule, "id", "text").orderBy("id").collect()
    assert [(r.id, r.n_items, r.is_open, r._extract_status) for r in got] == [(1, 5, True, "ok"), (3, None, None, "no_text"), (4, None, None, "no_text")]
    # enough structured fields do without a text
    wide = spark.createDataFrame([(5, None, "items: 7", "b", "c")], "id int, text string, x string, y string, z string")
    assert [(r.n_items, r._extract_status) for r in extraction.extract_missing(wide, silver, book, rule, "id", "text").collect()] == [(7, "ok")]

    class Broken:
        def __call__(self, text):
            raise ConnectionError("down")

    failed = extraction.quarantine(extraction.extract(bronze.where("id = 1"), book, extraction.RetryingExtractor(Broken(), tries=2, wait=0.0), "id", "text"), "id").collect()
    assert failed[0].error.startswith("ConnectionError")
    page = spark.createDataFrame([(1, "<p>a</p>")], "id int, html string")
    assert extraction.scrape(page, lambda t: '[{"x": 1}, {"x": 1}, {"x": 2}]', "html", "id", ["x"], 100).count() == 2


def test_inspection(spark):
    html = '<a href="/d/a.pdf">A</a><a href="#x">no</a><a href="b.csv?v=1">B</a><a href="/d/a.pdf">again</a><div class="row x">1</div><div class="row">2</div>'
    df = spark.createDataFrame([(1, "https://h.example/p/q", html)], "k int, base string, html string")
    assert [(r.url, r.score) for r in inspection.top_assets(df, "k", "base").orderBy("rank").collect()] == [("https://h.example/d/a.pdf", 90), ("https://h.example/p/b.csv?v=1", 80)]
    assert inspection.find_class(df, "row", "k").first().n_hits == 2
    same = spark.createDataFrame([(1, "a", "a", "b"), (2, "c", "c", "d")], "o int, x string, y string, z string")
    assert [tuple(r) for r in inspection.duplicate_fields(same, ["x", "y", "z"], "o").collect()] == [("x", "y")]
    stats = profiling.codebook_stats(same, Codebook("c", [VariableSpec("x"), VariableSpec("y"), VariableSpec("z")]))
    assert profiling.pilot_verdict(stats).first().verdict == "SCALE_OK" and profiling.pilot_verdict(stats.where("false")).first().verdict == "FIX_FIRST"


def test_files_and_export(spark, tmp_path):
    path = str(tmp_path / "rows.jsonl")
    with open(path, "w") as f:
        f.write('{"id": "1", "v": 2}\n\nnot json\n{"id": "2", "v": 3}\n')
    schema = spark.createDataFrame([], "id string, v long").schema
    assert files.read_jsonl(spark, path, schema).where("id is not null").count() == 2
    with pytest.raises(PermissionError):
        files.confined(str(tmp_path), "../x")
    files.write_file(str(tmp_path), "a/b.txt", "text")
    assert files.resolve_refs({"x": [{"$file": "a/b.txt"}]}, str(tmp_path)) == {"x": ["text"]}
    with pytest.raises(FileNotFoundError):
        files.resolve_refs({"$file": "gone"}, str(tmp_path))
    assert files.rows_argument(spark, '[{"id": "1"}]', schema).first().v is None
    table = str(tmp_path / "t")
    files.rewrite(spark.range(3).toDF("x"), table)
    files.rewrite(spark.read.json(table).where("x > 0"), table)
    assert spark.read.json(table).count() == 2
    memory = files.Memory(str(tmp_path / "m.json"))
    memory.set("k", {"a": 1})
    assert files.Memory(str(tmp_path / "m.json")).get("k") == {"a": 1}
    (tmp_path / "bad.json").write_text("{")
    assert files.Memory(str(tmp_path / "bad.json")).list() == [] and (tmp_path / "bad.corrupt.json").exists()

    book = Codebook("cases", [VariableSpec("n", "integer", "Count | of"), VariableSpec("day", "date"), VariableSpec("tags", "array", item_schema={"type": "object", "properties": {"k": {"type": "string"}}})])
    bronze = spark.createDataFrame([("1", "t", 0), ("2", "u", 1)], "id string, title string, _ord int")
    silver = spark.createDataFrame([("1", "5", "2020-01-02", "x", 0)], "id string, n string, day string, tags string, _ord int")
    at = export.export_dataset(bronze, silver, book, str(tmp_path / "out"))
    got = {r.id: r for r in spark.read.parquet(at["parquet"]).collect()}
    assert got["1"].n == 5 and str(got["1"].day) == "2020-01-02" and got["1"].tags[0].k == "x" and got["2"].n is None
    card = open(at["card"]).read()
    assert "Count \\| of" in card and "50%" in card and Codebook.load(at["codebook"]).name == "cases"
    assert export.push_source(str(tmp_path / "out"), "cases") == os.path.join(str(tmp_path / "out"), "cases.parquet")


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [{"run": "a", "o": i, "failed": i != 2} for i in range(6)]
    os.makedirs(source)
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    schema = spark.createDataFrame([], "run string, o long, failed boolean").schema
    seen = []
    stream = incremental.append_distinct(incremental.read_rows(spark, source, schema), "run")
    stream.writeStream.foreachBatch(incremental.missing_from(lambda: spark.createDataFrame([("b",)], "run string"), "run", lambda df, e: seen.extend(df.collect()))).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert [r.run for r in seen] == ["a"]
    out = str(tmp_path / "out")
    fails = incremental.failures_in_a_row(incremental.read_rows(spark, source, schema), "run", "o", "failed")
    fails.writeStream.format("json").option("path", out).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert [r.n_in_a_row for r in spark.read.json(out).collect()] == [3]
