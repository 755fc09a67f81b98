"""Queries of the text problems, with their SQL where SQL can say the same on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dsforge.llm import boilerplate, contamination, dedupe, entity_map, reading_level, scan_repair, tokenizer
from dsforge.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _with_source(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """Rows of ``dataset`` whose collection has one of ``fields`` as primary source, with that field's name."""
    book = table(spark, sf_dir, "codebook").where(F.col("primary_source_field").isin(*fields)).select("collection", "primary_source_field")
    return table(spark, sf_dir, "dataset").join(book, "collection")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.furniture_lines(_with_source(spark, sf_dir, "text"))


def p1_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_body(_with_source(spark, sf_dir, "text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "variable_spec").where("name = 'name'")
    return entity_map.mapped(table(spark, sf_dir, "extracted"), lists)


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmatched names by collection and spelling, with their number of rows."""
    lists = table(spark, sf_dir, "variable_spec").where("name = 'name'")
    unmatched = entity_map.map_names(table(spark, sf_dir, "extracted"), lists, keep=True).where("canonical = ''")
    return unmatched.groupBy("collection", "name").agg(F.count(F.lit(1)).alias("n_rows"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.copies(table(spark, sf_dir, "dataset")).select("keep_no", "copy_no")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.one_per_group(table(spark, sf_dir, "dataset"))


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned texts, from the row or from the file it names, with title and the owner of its site."""
    columns = ["row_no", "source_site", "title"]
    rows = _with_source(spark, sf_dir, "pdf_text", "text_path")
    files = table(spark, sf_dir, "text_files").select(F.col("path").alias("text_path"), F.col("content").alias("text"))
    sites = table(spark, sf_dir, "sites").select("source_site", "owner_name")
    # texts held in the row need no join: rows without a path would all meet in one task, and their texts would be shuffled for nothing
    held = rows.where("primary_source_field = 'pdf_text'").select(*columns, F.col("pdf_text").alias("text"))
    read = rows.where("primary_source_field = 'text_path' and text_path is not null").select(*columns, "text_path").join(files, "text_path").select(*columns, "text")
    return held.unionAll(read).join(sites, "source_site", "left").select("row_no", "title", "owner_name", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.find_noise(_scans(spark, sf_dir), name_cols=("title", "owner_name"))


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.repair(_scans(spark, sf_dir), name_cols=("title", "owner_name"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_bodies, p4_found, p4_report, p5_found, p5_groups, p6_found, p6_repaired, p7_ids, p8_found, p9_found)}


def _plain(c: str) -> str:
    return f"regexp_replace(lower({c}), '[\\p{{P}}\\p{{Z}}\\s\\p{{C}}$+<=>^`|~]+', '', 'g')"


_PARAMS = "string_split(replace(substr(detail_url, strpos(detail_url, '?') + 1), ';', '&'), '&')"
_PARAM = f"CASE WHEN strpos(x, '=') > 0 THEN {_plain("substr(x, 1, strpos(x, '=') - 1)")} || '=' || {_plain("substr(x, strpos(x, '=') + 1)")} ELSE {_plain('x')} END"
_VALUE = "json_extract(lower(extra), '$.\"' || k || '\"')"
# strings of one level are made canonical, other values keep their text
_PAIR = f"""'"' || {_plain('k')} || '":' || CASE json_type({_VALUE}) WHEN 'VARCHAR' THEN '"' || {_plain(f"({_VALUE} ->> '$')")} || '"' ELSE CAST({_VALUE} AS VARCHAR) END"""
_CANONICAL = f"""c AS (SELECT row_no, id, detail_url, title, extra, {_plain('id')} AS k1, {_plain('title')} AS k2,
 CASE WHEN strpos(detail_url, '?') > 0 THEN {_plain("substr(detail_url, 1, strpos(detail_url, '?') - 1)")} || coalesce('?' || nullif(array_to_string(list_sort(list_filter(list_transform(
 {_PARAMS}, lambda x : {_PARAM}), lambda x : x NOT IN ('', '='))), '&'), ''), '') ELSE {_plain('detail_url')} END AS k3,
 CASE WHEN extra IS NULL THEN NULL WHEN json_valid(extra) THEN array_to_string(list_sort(list_transform(json_keys(lower(extra)), lambda k : {_PAIR})), ',')
 ELSE 'text:' || {_plain('extra')} END AS k4 FROM dataset)"""


def oracle_sql() -> dict[str, str]:
    """SQL exists where it can say the same on whole tables; the other operators are tested against brute force, round trips and held-out data."""
    return {
        "p5_found": f"WITH {_CANONICAL}, k AS (SELECT row_no, min(row_no) OVER (PARTITION BY k1, k2, k3, k4) AS keep_no FROM c) SELECT keep_no, row_no AS copy_no FROM k WHERE row_no <> keep_no",
        "p5_groups": f"WITH {_CANONICAL} SELECT min(row_no) AS keep_no, count(*) AS n_copies, count(DISTINCT struct_pack(a := id, b := detail_url, c := title, d := extra)) AS n_spellings FROM c GROUP BY k1, k2, k3, k4",
    }
