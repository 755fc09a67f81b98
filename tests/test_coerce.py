"""Coercion case by case, and codebooks."""

import pytest
from pyspark.sql import functions as F

from dsforge.functions import coerce as C
from dsforge.plans.model import Codebook, VariableSpec, stem


def values(spark, made, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", made(F.col("x")).alias("y")).orderBy("i").collect()]


def test_boolean(spark):
    assert values(spark, C.to_boolean, ["yes", " Oui", "non", "FALSE", "0", "1", "not stated", "", None]) == [True, True, False, False, None, None, None, None, None]
    assert values(spark, lambda c: C.to_boolean(c, "int"), [0, 1], "int") == [None, None]


def test_numbers(spark):
    texts = ["1 234,5", "27,000,000", "1,234", "1.234,50 €", "1,234.50", "3 millions", "2 milliards", "5 m", "27M", "trois mille", "2.5", "3.5", "none", "", None, "-7"]
    assert values(spark, C.to_float, texts) == [1234.5, 27e6, 1.234, 1234.5, 1234.5, 3e6, 2e9, 5e6, 27.0, None, 2.5, 3.5, None, None, None, -7.0]
    assert values(spark, C.to_integer, ["2.5", "3.5", "trois mille", "ten", "1e3", "5 10", "1d"]) == [2, 4, 3000, 10, 1, 510, 1]
    assert values(spark, lambda c: C.to_integer(c, "double"), [2.9, -2.9, None], "double") == [2, -2, None]


def test_dates(spark):
    texts = ["08/01/2026", "16/04/2026", "04/16/2026", "2026-01-08T15:30:00Z", "16 avril 2026", "1er février 2020", "12 août 2019", "January 5, 2021", "1/2/49", "1/2/50", "2022-02-30", "31/04/2020", "soon", None]
    assert values(spark, C.to_date_text, texts) == ["2026-01-08", "2026-04-16", "2026-04-16", "2026-01-08", "2026-04-16", "2020-02-01", "2019-08-12", "2021-01-05", "2049-02-01", "1950-02-01", None, None, None, None]


def test_enum(spark):
    labels = ["data_security_failure", "retention_too_long"]
    made = lambda c: C.to_enum(c, labels)
    assert values(spark, made, ["data_security_failure", "Data Security Failure", "retention-too-long", "weather", "", None]) == [labels[0], labels[0], labels[1], None, None, None]
    assert values(spark, lambda c: C.to_enum(c, ["FR", "DE"]), ["US"]) == ["FR"]
    assert values(spark, lambda c: C.to_enum(c, ["public sector", "retail"]), ["Público sector", "the retail", "ret"]) == ["public sector", "retail", None]


def test_array_string_bounds(spark):
    assert values(spark, C.to_array, ["a; b|c,d", " ", "", None]) == [["a", "b", "c", "d"], [], [], None]
    assert values(spark, C.to_text, ["  x ", " ", None]) == ["x", None, None]
    assert values(spark, lambda c: C.bounded(c, 0, 10), [-1, 0, 10, 11, None], "int") == [None, 0, 10, None, None]


def test_row_warnings(spark):
    book = Codebook("b", [VariableSpec("n", "integer", max_value=5), VariableSpec("t", required=True), VariableSpec("absent", "boolean", required=True)])
    df = spark.createDataFrame([(1, "9", None), (2, "3", "x")], "k int, n string, t string")
    rows = C.coerce_row(df, book, ["k"]).orderBy("k").collect()
    assert rows[0]._warnings == {"n": "coercion lost value", "t": "required but missing", "absent": "required but missing"}
    assert (rows[1].n, rows[1].t, rows[1].absent) == (3, "x", None) and set(rows[1]._warnings) == {"absent"}


def test_codebook_rules():
    with pytest.raises(ValueError):
        Codebook("b", []).validate()
    for bad in (VariableSpec("", "string"), VariableSpec("x", "colour"), VariableSpec("x", "enum"), VariableSpec("x", "array")):
        with pytest.raises(ValueError):
            bad.validate()
    with pytest.raises(ValueError):
        Codebook("b", [VariableSpec("a"), VariableSpec("a")]).validate()
    book = Codebook("b", [VariableSpec("has_llm", "boolean"), VariableSpec("is_mentions_llm", "boolean"), VariableSpec("n_years_experience_required", "integer"), VariableSpec("n_years_experience_req", "integer"), VariableSpec("title")])
    assert len(book.duplicate_groups()) == 2 and stem("has_vector_database") == stem("has_vector_db")
    assert book.numeric_or_boolean_ratio() == 0.8 and book.type_breakdown() == {"boolean": 2, "integer": 2, "string": 1}
    before = book.extraction_signature()
    with pytest.raises(PermissionError):
        book.edit(drop=["title"], locked={"title"})
    change = book.edit(drop=["is_mentions_llm"], rename={"title": "name"}, add=[VariableSpec("when", "date")])
    assert book.extraction_signature() != before and change["keep_only"] == ["has_llm", "n_years_experience_required", "n_years_experience_req", "name", "when"]
    assert Codebook.from_dict(book.to_dict() | {"variables": [v | {"odd": 1} for v in book.to_dict()["variables"]]}).to_dict() == book.to_dict()
    schema = VariableSpec("s", "enum", "Sector", ["a"], unit="u", extraction_hint="h").json_schema()
    assert schema["enum"] == ["a", None] and "Unit: u" in schema["description"]
