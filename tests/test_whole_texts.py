"""Long texts and files come out whole."""

import json

from dsforge.operators.extraction import RuleExtractor, extract
from dsforge.plans.model import Codebook, VariableSpec
from dsforge.sources.extract_text import extract_text


def test_values_late_in_a_text(spark):
    df = spark.createDataFrame([(1, "x" * 30_000 + " n=5")], "k int, t string")
    book, rule = Codebook("c", [VariableSpec("n", "integer")]), RuleExtractor({"n": r"n=(\d+)"})
    assert extract(df, book, rule, "k", "t").first().n == 5
    assert extract(df, book, rule, "k", "t", max_chars=1000).first().n is None


def test_all_rows_of_files():
    assert extract_text("a.csv", "\n".join(f"{i},v" for i in range(900)).encode()).splitlines()[-1] == "899\tv"
    lines = extract_text("a.jsonl", "\n".join(json.dumps({"i": i}) for i in range(900)).encode()).splitlines()
    assert len(lines) == 900 and json.loads(lines[-1]) == {"i": 899}
