"""Queries of the general data-quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dsforge.operators import quality_profile, timestamps
from dsforge.plans.registry import query
from dsforge.session import table

COLUMNS = ["name", "country_code", "case_ref", "sector", "status_code", "amount_eur", "n_persons", "pct_fill", "is_public", "has_appeal", "decided_on"]
COMPARED = ["country_code", "sector", "status_code", "amount_eur", "n_persons", "pct_fill", "is_public", "has_appeal"]
NUMBERS = ["amount_eur", "n_persons", "pct_fill"]
PATTERNS = ["country_code", "case_ref", "status_code", "decided_on"]


@query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_profile.find_faults(
        table(spark, sf_dir, "extracted"), table(spark, sf_dir, "dataset_validate"), COLUMNS, COMPARED, PATTERNS, ["case_ref"], table(spark, sf_dir, "variable_spec")
    )


def _range_sql(c: str) -> str:
    number, text = f"min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value", f"min(CASE WHEN {c}::VARCHAR <> '' THEN {c}::VARCHAR END) AS min_text, max(CASE WHEN {c}::VARCHAR <> '' THEN {c}::VARCHAR END) AS max_text"
    none = "NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, " + text
    return number + ", NULL::VARCHAR AS min_text, NULL::VARCHAR AS max_text" if c in NUMBERS else none


@query(
    " UNION ALL ".join(
        f"""SELECT load_no, '{c}' AS column_name, count(*) AS n_rows, sum(CASE WHEN {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' THEN 1 ELSE 0 END)::BIGINT AS n_present,
        count(DISTINCT CASE WHEN CAST({c} AS VARCHAR) <> '' THEN {c} END) AS n_unique, {_range_sql(c)} FROM extracted WHERE load_no IS NOT NULL GROUP BY load_no"""
        for c in COLUMNS
    )
)
def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = quality_profile.value_counts(quality_profile.long_values(table(spark, sf_dir, "extracted"), "load_no", COLUMNS))
    return quality_profile.profile(counts, NUMBERS).drop("n_not_null").withColumnsRenamed({"_load": "load_no", "_column": "column_name"})


@query()
def p2_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each load is told from the others, by all compared columns, by one alone, and without it."""
    rows = quality_profile.compare_loads(table(spark, sf_dir, "extracted"), COMPARED, PATTERNS, table(spark, sf_dir, "variable_spec"))
    return spark.createDataFrame(rows, "load_no int, column_name string, n_values long, area_alone double, area_all double, area_without double, gain double")


@query()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalise(table(spark, sf_dir, "dataset"), table(spark, sf_dir, "sites"))
