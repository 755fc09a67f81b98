"""A run from listing pages to files, and the parts around it."""

import pytest

from dsforge.operators import contracts
from dsforge.operators.extraction import RuleExtractor
from dsforge.plans import pipeline as P
from dsforge.plans.model import Codebook, VariableSpec
from dsforge.plans.spec import Spec
from dsforge.sources.fetch import RetryPolicy, attachment_paths, fetch_saved, save_attachments

SPEC = Spec.normalise({"row_pattern": r"<li>(.*?)</li>", "base_url": "https://h.example", "fields": {"detail_url": {"regex": r'href="([^"]+)"', "prefix_base": True}, "title": {"regex": r"<a[^>]*>(.*?)</a>", "transform": "strip_html"}}})


def test_run(spark, tmp_path):
    listing = [(p, "<ul>" + "".join(f'<li><a href="/d/{p * 3 + i}">Case {p * 3 + i}</a></li>' for i in range(3)) + "</ul>") for p in range(3)]
    pages = spark.createDataFrame(listing, "page long, html string")
    pipe = P.Pipeline(codebook=Codebook("cases", [VariableSpec("n_case", "integer", required=True)]))
    pipe.book.add(contracts.min_rows(6))
    assert pipe.harvest(pages, SPEC, "page", target=6).count() == 6
    details = spark.createDataFrame([(f"https://h.example/d/{i}", f"<p>Case number {i} {'x' * 200}</p>") for i in range(5)], "url string, html string")
    good, failed = P.process_queue(pipe.queue, details, "detail_url", "id", Spec.normalise({"fields": {"body": {"regex": "<p>(.*?)</p>"}}}))
    assert good.count() == 5 and failed.count() == 1 and good.where("body like 'Case number%'").count() == 5
    pipe.to_rows(["title"])
    pipe.bronze = pipe.bronze.join(good.select("id", "body"), "id", "left").persist()
    for _ in range(2):  # the second time there is nothing new
        status = pipe.extract(RuleExtractor({"n_case": r"number (\d+)"}), "body").groupBy("_extract_status").count().collect()
        assert {r[0]: r[1] for r in status} == {"ok": 5, "no_text": 1}  # no row is lost
    assert pipe.joined().where("n_case is not null").count() == 5 and pipe.verify()["ok"] and pipe.phase(6) == "FINISH"
    assert "min_rows" in P.describe(pipe, 6)
    at = pipe.export(str(tmp_path))
    assert spark.read.parquet(at["parquet"]).count() == 6
    with pytest.raises(P.HarvestRefused):
        P.check_sample(SPEC.listing(pages.where("false"), keep=("page",)), ["title"], ["page"])
    P.guard_force(pipe.bronze, pipe.silver, "id")
    with pytest.raises(PermissionError):
        P.guard_force(pipe.bronze, pipe.silver, "id", most=2)


def test_dataset(spark):
    df = spark.createDataFrame([("1", "a", 0)], "id string, v string, _ord long")
    data = P.Dataset(df, schema={"required": ["v"]})
    report = data.append(spark.createDataFrame([("1", "b", 1), ("2", "c", 2), ("3", None, 3)], "id string, v string, _ord long"))
    assert {r.id: r._reason for r in report.collect()} == {"1": "duplicate", "2": None, "3": "schema: $.v: required"}
    data.upsert(spark.createDataFrame([("2", "z", 4)], "id string, v string, _ord long"))
    data.patch(spark.createDataFrame([("1", None, 5)], "id string, v string, _ord long"))
    assert sorted(((r.id, r.v) for r in data.df.collect()), key=str) == [("1", None), ("2", "z")]
    assert data.sample(1).first().id == "1" and "v" in P.format_stats(data.stats()) and '"id":"1"' in P.context_snippet(data.df)
    assert {r.id: r._ord for r in data.df.collect()} == {"1": 0, "2": 2}  # an update keeps the row's place
    data.upsert(spark.createDataFrame([("9", "n", 7), (None, "q", 8)], "id string, v string, _ord long"))
    assert {r.id: r._ord for r in data.df.collect()} == {"1": 0, "2": 2, "9": 7, None: None}
    data.wipe()
    assert data.df.count() == 0


def test_structured(spark):
    schema = {"required": ["n"], "properties": {"n": {"type": "integer"}, "kind": {"type": ["string", "null"], "enum": ["a", "b", None]}}}
    df = spark.createDataFrame([(1, "n=5 kind=a"), (2, "kind=b")], "k int, t string")
    got = {r.k: (r.n, r.kind, r.violation) for r in P.extract_structured(df, schema, RuleExtractor({"n": r"n=(\d+)", "kind": r"kind=(\w)"}), "k", "t").collect()}
    assert got == {1: (5, "a", None), 2: (None, "b", "$.n: required")}


def test_fetch(spark, tmp_path):
    answers = iter([(503, {}, b""), (429, {"Retry-After": "7"}, b""), (200, {}, b"ok")])
    waits = []
    assert RetryPolicy(sleep=waits.append).run(lambda u: next(answers), "u")[2] == b"ok" and waits == [1.0, 7.0]
    assert RetryPolicy(sleep=waits.append).run(lambda u: (404, {}, b""), "u")[0] == 404 and len(waits) == 2
    urls, pages = spark.createDataFrame([("a",), ("b",), (None,)], "url string"), spark.createDataFrame([("a", "<p>")], "url string, html string")
    assert fetch_saved(urls, pages).where("_error is null").count() == 1
    files = spark.createDataFrame([(1, 1, ".pdf", bytearray(b"x"), "t"), (1, 2, ".csv", bytearray(b"y"), None)], "item int, o int, ext string, content binary, text string")
    save_attachments(attachment_paths(files, "item", "o", "ext"), str(tmp_path))
    assert (tmp_path / "items/item_0001/attachment_02.csv").read_bytes() == b"y" and (tmp_path / "items/item_0001/attachment_01.txt").read_text() == "t"
    lines = spark.createDataFrame([("f/run1/a",), ("f/run1/b",), ("f/run2/a",)], "_path string")
    assert sorted((r.run, r.n_rows) for r in P.run_listing(lines).collect()) == [("run1", 2), ("run2", 1)]
