"""Ids, append, upsert, patch, merge, queue and contracts."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from dsforge.operators import contracts, queueing, rows
from dsforge.operators.skew import salted_lookup
from dsforge.plans.control import Plan, PlanError, Registry, RunState, Tool, current_phase, snake_field


def test_content_id_is_the_json_digest(spark):
    df = spark.createDataFrame([("A \"b\"\n", "u", 1.5, True, None, 7)], "title string, url string, f double, ok boolean, none string, _scratch int")
    row = {"title": 'A "b"\n', "url": "u", "f": 1.5, "ok": True, "none": None}
    want = "sig_" + hashlib.sha1(json.dumps(row, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]
    assert df.select(rows.content_id(df)).first()[0] == want
    swapped = df.select("url", "ok", "none", "f", "title")
    assert swapped.select(rows.content_id(swapped)).first()[0] == want
    assert rows.with_id(df.withColumn("id", F.lit(""))).first().id == want


def test_append(spark):
    new = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, None, 3), (4, "", 4), (5, "b", 5), (6, "c", 6)], "o int, id string, v int")
    held = spark.createDataFrame([(0, "b", 0)], "o int, id string, v int")
    got = {r.o: r._reason for r in rows.append_report(new, "id", "o", held, F.when(F.col("v") == 6, F.lit("$.v: bad"))).collect()}
    assert got == {1: None, 2: "duplicate", 3: "missing key", 4: "missing key", 5: "duplicate", 6: "schema: $.v: bad"}
    assert rows.append(held, new.where("v < 6"), "id", "o").count() == 2


def test_upsert_patch_merge(spark):
    old = spark.createDataFrame([("1", "x", "p"), ("2", "y", None)], "id string, a string, b string")
    new = spark.createDataFrame([("1", None, "q", 1), ("1", "z", None, 2), ("3", "n", "m", 3)], "id string, a string, b string, o int")
    assert sorted(map(tuple, rows.upsert(old, new, "id", "o").collect())) == [("1", "z", "q"), ("2", "y", None), ("3", "n", "m")]
    assert sorted(map(tuple, rows.patch(old, new, "id", "o").collect()), key=str) == [("1", "z", None), ("2", "y", None)]
    silver = new.select("id", "o", F.col("b"), F.lit(5).alias("n"))
    got = {r.id: (r.a, r.b, r.n) for r in rows.merge_silver(old, silver, "id", "o").collect()}
    assert got == {"1": ("x", None, 5), "2": ("y", None, None)}
    kept = {r.id: r.b for r in rows.merge_silver(old, silver, "id", "o", silver_wins_null=False).collect()}
    assert kept["1"] == "p"


def test_sample_and_numbers(spark):
    df = spark.range(50).select(F.col("id").alias("o"))
    places = [r.o for r in rows.stratified_sample(df, 5, "o").collect()]
    assert places[0] == 0 and places[-1] == 49 and places == sorted(places) and len(places) == 5
    assert sorted((r.o, r._n) for r in rows.numbered_rows(df, "o").collect()) == [(i, i) for i in range(50)]


def test_salted_lookup_keeps_every_row(spark):
    big = spark.range(1000).select((F.col("id") % 3 * F.when(F.col("id") < 900, 0).otherwise(1)).alias("k"), F.col("id").alias("row"))
    keys = big.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10)
    out = salted_lookup(big, keys, "k", "n", 1000, "row", threshold=100)
    assert out.count() == 1000 and out.where("v != k * 10").count() == 0 and out.select("row").distinct().count() == 1000


def test_queue_and_sweep(spark):
    items = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (4, 1, "d")], "page int, pos int, id string")
    assert sorted(r.id for r in queueing.sweep(items, "page", "pos", "id").collect()) == ["a", "b"]  # two pages without news end it
    assert sorted(r.id for r in queueing.sweep(items, "page", "pos", "id", empty_pages=3).collect()) == ["a", "b", "c", "d"]
    assert sorted(r.id for r in queueing.sweep(items, "page", "pos", "id", target=1).collect()) == ["a", "b"]
    assert sorted(r.id for r in queueing.sweep(items, "page", "pos", "id", max_pages=1, known=items.where("id = 'a'")).collect()) == ["b"]
    assert queueing.first_page({0: 0, 1: 5}) == 1 and queueing.pages_to_fetch(100, 20) == 10
    empty = items.where("false")
    assert queueing.next_item(items, empty, "id", "page").first().id == "a" and queueing.pilot(items, empty, "page").count() == 3
    assert queueing.mark_done(items.where("id = 'a'"), items, "id").count() == 4


def test_contracts(spark):
    df = spark.createDataFrame([("1", "t", 1), ("2", " ", None), ("2", "u", 3)], "id string, title string, comments int")
    book = contracts.ContractBook()
    for c in (contracts.min_rows(3), contracts.required(["title", "n_comments"]), contracts.unique_field("id"), contracts.coverage(["title", "gone"])):
        book.add(c)
    assert [(n, ok) for n, ok, _ in book.check(df)] == [("min_rows", True), ("fields", False), ("unique:id", False), ("coverage", False)]
    locked = contracts.min_rows(5)
    locked.locked = True
    book.add(locked)
    with pytest.raises(PermissionError):
        book.add(contracts.min_rows(1))
    assert contracts.finish(book.check(df))[0] is False and contracts.finish([("min_rows", True, ""), ("x", False, "")])[1].startswith("partial")
    assert contracts.field_variants("number of comments")[:3] == ["number of comments", "number_of_comments", "comments"]
    constant = spark.createDataFrame([(i, "u") for i in range(12)], "o int, decision_url string")
    assert contracts.low_cardinality(constant, ["decision_url"], "o").first().n_mode == 12
    assert contracts.low_cardinality(constant.where("o < 5"), ["decision_url"], "o").count() == 0
    assert contracts.sparse_fields(df).count() == 1
    schema = {"required": ["id"], "properties": {"title": {"type": "string", "enum": ["t", "u"]}, "comments": {"type": "string"}}}
    got = [r[0] for r in df.select(contracts.row_violation(schema, df)).collect()]
    assert got == ["$.comments: expected string, got int".replace("int", "integer"), "$.title: not one of the allowed values", "$.comments: expected string, got integer"]


def test_control():
    assert current_phase(RunState(target=10)) == "DISCOVER_LISTING"
    assert current_phase(RunState(n_rows=15, target=10, contracts_ok=True)) == "FINISH"
    assert current_phase(RunState(n_rows=10, target=20, n_silver=10, has_codebook=True, was_extracting=True)) == "EXPORT"
    assert current_phase(RunState(n_rows=10, target=10, wants_codebook=True)) == "CODEBOOK"
    assert current_phase(RunState(target=10, has_page=True, has_extractor=True, n_queue=5, n_pending=5)) == "PROCESS"
    plan = Plan.validated({"item": "x", "source": "listing_html", "harvest_strategy": "listing_only", "items_per_page": 396, "target_rows": 396, "pages_needed": 9})
    assert plan.pages_needed == 1
    book = contracts.ContractBook()
    book.add(contracts.min_rows(400))
    assert plan.reconcile(book) and "396" in book.contracts["min_rows"].judge({"rows": 1})[1]
    with pytest.raises(PlanError):
        Plan.validated({"item": "x", "source": "nowhere", "harvest_strategy": "listing_only"})
    reg = Registry()
    reg.register(Tool("long", lambda: "line\n" * 5000, max_output_chars=1000))
    reg.register(Tool("bad", lambda: 1 / 0))
    assert reg.run("none")[1] and reg.run("bad")[1] and len(reg.run("long")[0]) < 1100
    assert snake_field("Number of comments") == "n_comments" and snake_field("whether there is an appeal") == "has_appeal"
