"""Queries of coercion, dataset changes, queue, contracts, profiling and run history, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dsforge.functions import coerce as C
from dsforge.operators import contracts, extraction, profiling, queueing, rows
from dsforge.plans.model import Codebook, VariableSpec
from dsforge.plans.registry import query
from dsforge.session import spread, table

# ---- coercion

_NUMBERS = "CASE row_no % 6 WHEN 0 THEN row_no::VARCHAR WHEN 1 THEN row_no::VARCHAR || ' 500' WHEN 2 THEN row_no::VARCHAR || ',5' WHEN 3 THEN '1.' || lpad((row_no % 1000)::VARCHAR, 3, '0') || ',25 EUR' WHEN 4 THEN row_no::VARCHAR || ' millions' ELSE 'none' END"


def _number_texts(d: DataFrame) -> DataFrame:
    n = F.col("row_no").cast("string")
    text = (
        F.when(F.col("row_no") % 6 == 0, n).when(F.col("row_no") % 6 == 1, F.concat(n, F.lit(" 500"))).when(F.col("row_no") % 6 == 2, F.concat(n, F.lit(",5")))
        .when(F.col("row_no") % 6 == 3, F.concat(F.lit("1."), F.lpad((F.col("row_no") % 1000).cast("string"), 3, "0"), F.lit(",25 EUR"))).when(F.col("row_no") % 6 == 4, F.concat(n, F.lit(" millions"))).otherwise("none")
    )
    return d.select("row_no", text.alias("t"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN TRUE WHEN event_type = 'error' THEN FALSE END AS flag FROM events")
def coerce_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "view", " Oui ").when(F.col("event_type") == "click", "YES").when(F.col("event_type") == "error", "faux").when(F.col("event_type") == "signup", "0").otherwise("not stated")
    return table(spark, sf_dir, "events").select("event_id", C.to_boolean(text).alias("flag"))


@query("SELECT row_no, CASE row_no % 6 WHEN 0 THEN row_no::DOUBLE WHEN 1 THEN row_no * 1000.0 + 500 WHEN 2 THEN row_no + 0.5 WHEN 3 THEN 1000 + row_no % 1000 + 0.25 WHEN 4 THEN row_no * 1e6 END::DOUBLE AS x FROM dataset")
def coerce_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number_texts(table(spark, sf_dir, "dataset")).select("row_no", C.to_float(F.col("t")).alias("x"))


@query("SELECT row_no, CASE row_no % 6 WHEN 0 THEN row_no WHEN 1 THEN row_no * 1000 + 500 WHEN 2 THEN row_no + row_no % 2 WHEN 3 THEN 1000 + row_no % 1000 WHEN 4 THEN row_no * 1000000 END::BIGINT AS n FROM dataset")
def coerce_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number_texts(table(spark, sf_dir, "dataset")).select("row_no", C.to_integer(F.col("t")).alias("n"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def coerce_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy.M.d")).when(k == 2, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.to_date_text(text).alias("day"))


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer")
def coerce_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    k = F.col("c_custkey") % 4
    s = F.col("c_mktsegment")
    text = F.when(k == 0, s).when(k == 1, F.lower(s)).when(k == 2, F.concat(F.initcap(s), F.lit(" co"))).otherwise(F.concat(F.substring(s, 1, 3), F.substring(s, 5, 20)))
    return table(spark, sf_dir, "customer").select("c_custkey", C.to_enum(text, values).alias("segment"))


@query("SELECT p_partkey, p_brand || '|' || p_type AS parts, 2::INTEGER AS n FROM part")
def coerce_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = C.to_array(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ; "), F.col("p_type"), F.lit("|")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(a, "|").alias("parts"), F.size(a).alias("n"))


@query("SELECT row_no, CASE WHEN regexp_matches(title, '[^\\s\\x{00A0}]') THEN regexp_replace(title, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g') END AS t FROM dataset")
def coerce_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dataset").select("row_no", C.to_text(F.concat(F.lit("  "), F.col("title"), F.lit("\t"))).alias("t"))


BOOK = Codebook("cases", [
    VariableSpec("country_code", "string", required=True), VariableSpec("sector", "enum", enum_values=["education", "finance", "health", "media", "public sector", "research", "retail", "telecom"]),
    VariableSpec("amount_eur", "float", min_value=0, max_value=20_000_000), VariableSpec("n_persons", "integer", min_value=0, max_value=1000), VariableSpec("pct_fill", "float", min_value=0, max_value=100), VariableSpec("is_public", "boolean"),
    VariableSpec("has_appeal", "boolean"), VariableSpec("decided_on", "date"),
])


@query("""SELECT ex_no, CASE WHEN n_persons BETWEEN 0 AND 1000 THEN n_persons END AS n_bounded, (CASE WHEN n_persons NOT BETWEEN 0 AND 1000 THEN 1 ELSE 0 END + CASE WHEN pct_fill NOT BETWEEN 0 AND 100 THEN 1 ELSE 0 END + CASE WHEN amount_eur NOT BETWEEN 0 AND 20000000 THEN 1 ELSE 0 END)::INTEGER AS n_lost,
 CASE WHEN country_code IS NULL OR trim(country_code) = '' THEN 1 ELSE 0 END::INTEGER AS n_missing FROM extracted""")  # fmt: skip
def coerce_row_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row as it is: numbers that were lost, and required values that are missing."""
    out = C.coerce_row(table(spark, sf_dir, "extracted"), BOOK, keep=["ex_no"])
    numbers = F.map_filter("_warnings", lambda k, v: (v == "coercion lost value") & k.isin("n_persons", "pct_fill", "amount_eur"))
    missing = F.coalesce(F.try_element_at("_warnings", F.lit("country_code")), F.lit("")) != ""
    return out.select("ex_no", F.col("n_persons").alias("n_bounded"), F.size(numbers).alias("n_lost"), missing.cast("int").alias("n_missing"))


@query()
def coerce_warning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variable, warning, n_rows) over all rows and variables; SQL can't say the snapping of enums and the reading of dates."""
    out = C.coerce_row(table(spark, sf_dir, "extracted"), BOOK, keep=["ex_no"])
    return out.select(F.explode("_warnings").alias("variable", "warning")).groupBy("variable", "warning").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- ids, append, upsert, patch, merge


@query("""SELECT 'nation' AS t, n_nationkey AS k, 'sig_' || left(sha1('{"n_name": "' || n_name || '", "n_nationkey": ' || n_nationkey::VARCHAR || ', "n_regionkey": ' || n_regionkey::VARCHAR || '}'), 12) AS id FROM nation
 UNION ALL SELECT 'region', r_regionkey, 'sig_' || left(sha1('{"r_name": "' || r_name || '", "r_regionkey": ' || r_regionkey::VARCHAR || '}'), 12) FROM region""")  # fmt: skip
def synth_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.select(F.lit("nation").alias("t"), F.col("n_nationkey").alias("k"), rows.content_id(n).alias("id")).unionAll(r.select(F.lit("region"), "r_regionkey", rows.content_id(r)))


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1")
def append_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.keep_first(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), ["text"], ["doc_id"])


@query("""WITH v AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN '$.o_orderpriority: not one of the allowed values' END AS bad FROM orders),
 f AS (SELECT o_custkey, min(o_orderkey) AS k FROM v WHERE bad IS NULL GROUP BY o_custkey)
 SELECT v.o_orderkey, CASE WHEN bad IS NOT NULL THEN 'schema: ' || bad WHEN v.o_custkey IS NULL THEN 'missing key' WHEN v.o_custkey <= 20 OR v.o_orderkey > f.k THEN 'duplicate' END AS reason FROM v LEFT JOIN f ON v.o_custkey = f.o_custkey""")  # fmt: skip
def append_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    schema = {"type": "object", "required": ["o_orderkey"], "properties": {"o_orderpriority": {"type": "string", "enum": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}}}
    held = table(spark, sf_dir, "customer").where("c_custkey <= 20").select(F.col("c_custkey").alias("o_custkey"))
    report = rows.append_report(o, "o_custkey", "o_orderkey", held, contracts.row_violation(schema, o))
    return report.select("o_orderkey", F.col("_reason").alias("reason"))


@query("""WITH l AS (SELECT doc_id, arg_max(level_no, labelled_by || level_no::VARCHAR) AS level_no FROM reading_labels GROUP BY doc_id)
 SELECT coalesce(d.doc_id, l.doc_id)::VARCHAR AS doc_id, d.lang, l.level_no FROM (SELECT doc_id, lang FROM documents) d FULL JOIN l ON d.doc_id = l.doc_id""")  # fmt: skip
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "reading_labels").select("doc_id", "level_no", F.concat("labelled_by", F.col("level_no").cast("string")).alias("_ord"))
    return rows.upsert(table(spark, sf_dir, "documents").select("doc_id", "lang"), labels, "doc_id", "_ord")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def patch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = c.where("c_custkey % 10 < 2").select("c_custkey", F.lit(1).alias("_ord"), F.when(F.col("c_custkey") % 10 == 1, "PATCHED").alias("c_mktsegment"))
    older = changes.select("c_custkey", F.lit(0).alias("_ord"), F.lit("OLD").alias("c_mktsegment"))
    return rows.patch(c, changes.unionAll(older), "c_custkey", "_ord")


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0) AS n_patched, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0 AND c_custkey <> 0) AS n_not_found, (SELECT count(*) FROM customer) AS n_rows")
def patch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    hits = c.where("c_custkey % 10 = 0")
    return rows.patch_counts(c, hits.unionAll(hits).unionAll(hits.select((-F.col("c_custkey")).alias("c_custkey"))), "c_custkey")


_SILVER = "s AS (SELECT row_no, arg_max(struct_pack(a := name, b := country_code, c := source_site), ex_no) AS x FROM extracted WHERE row_no IS NOT NULL GROUP BY row_no)"


@query(f"WITH {_SILVER} SELECT d.row_no, d.title, CASE WHEN s.row_no IS NOT NULL THEN s.x.c ELSE d.source_site END AS source_site, s.x.a AS name, s.x.b AS country_code FROM dataset d LEFT JOIN s ON d.row_no = s.row_no")
def bronze_silver_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze = table(spark, sf_dir, "dataset").select("row_no", "title", "source_site")
    silver = table(spark, sf_dir, "extracted").select("row_no", F.col("ex_no").alias("_ord"), "source_site", "name", "country_code")
    return rows.merge_silver(bronze, silver, "row_no", "_ord")


@query("SELECT row_no FROM dataset d WHERE NOT EXISTS (SELECT 1 FROM extracted e WHERE e.row_no = d.row_no)")
def anti_join_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queueing.pending(table(spark, sf_dir, "dataset").select("row_no"), table(spark, sf_dir, "extracted"), "row_no")


@query("SELECT row_no FROM dataset d WHERE EXISTS (SELECT 1 FROM extracted e WHERE e.row_no = d.row_no)")
def semi_reextract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queueing.already_extracted(table(spark, sf_dir, "dataset").select("row_no"), table(spark, sf_dir, "extracted"), "row_no")


@query("SELECT row_no, detail_url FROM (SELECT row_no, detail_url, row_number() OVER (PARTITION BY detail_url ORDER BY row_no) AS r FROM dataset WHERE coalesce(detail_url, '') <> '' AND load_no > 2) WHERE r = 1 AND detail_url NOT IN (SELECT detail_url FROM dataset WHERE load_no <= 2 AND coalesce(detail_url, '') <> '')")
def signature_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset").where("coalesce(detail_url, '') <> ''").select("row_no", "detail_url", "load_no")
    return rows.dedupe_new(d.where("load_no <= 2").drop("load_no"), d.where("load_no > 2").drop("load_no"), ["title", "detail_url"], "row_no")


@query("SELECT (len(list_filter(['o_orderkey', 'o_custkey', 'o_orderstatus'], lambda x : x IN ('o_orderkey', 'l_linenumber'))) * 1.0 / 4)::DOUBLE AS jaccard")
def shape_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(rows.shape_overlap(["o_orderkey", "o_custkey", "o_orderstatus"], ["o_orderkey", "l_linenumber"]),)], "jaccard double")


# ---- queue


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id > 20 AND event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id <= 200) GROUP BY user_id")
def queue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    added = queueing.add(e.where("user_id <= 20"), e.where("event_type = 'purchase' and event_id <= 200"), e.where("event_type = 'view'"), "user_id", "event_id")
    return added.select("user_id", "event_id")


@query("SELECT count(*) AS n_total, sum(CASE WHEN e.row_no IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_processed, sum(CASE WHEN e.row_no IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_remaining FROM dataset d LEFT JOIN (SELECT DISTINCT row_no FROM extracted) e ON d.row_no = e.row_no")
def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queueing.status(table(spark, sf_dir, "dataset").select("row_no"), table(spark, sf_dir, "extracted"), "row_no")


@query("SELECT row_no FROM dataset d WHERE NOT EXISTS (SELECT 1 FROM extracted e WHERE e.row_no = d.row_no) ORDER BY row_no LIMIT 1")
def queue_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queueing.next_item(table(spark, sf_dir, "dataset").select("row_no"), table(spark, sf_dir, "extracted"), "row_no", "row_no")


@query("""WITH f AS (SELECT user_id, event_id, page, row_number() OVER (PARTITION BY user_id ORDER BY page, event_id) AS r FROM (SELECT user_id, event_id, event_id // 50 AS page FROM events)),
 n AS (SELECT p.page, count(f.user_id) AS new FROM (SELECT DISTINCT event_id // 50 AS page FROM events) p LEFT JOIN f ON f.page = p.page AND f.r = 1 GROUP BY p.page),
 g AS (SELECT page, coalesce(sum(new) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS got, coalesce(sum(CASE WHEN new = 0 THEN 1 ELSE 0 END) OVER (ORDER BY page ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS idle FROM n),
 s AS (SELECT page, max(CASE WHEN got >= 100 OR idle >= 2 THEN 1 ELSE 0 END) OVER (ORDER BY page) AS stopped FROM g)
 SELECT f.user_id, f.event_id FROM f JOIN s ON f.page = s.page WHERE f.r = 1 AND s.stopped = 0""")  # fmt: skip
def paginated_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("event_id div 50").alias("page"))
    return queueing.sweep(items, "page", "event_id", "user_id", target=100).select("user_id", "event_id")


@query("SELECT row_no, title AS name FROM dataset d WHERE regexp_matches(title, '\\S') AND NOT EXISTS (SELECT 1 FROM extracted e WHERE e.row_no = d.row_no)")
def rows_from_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "dataset").select("row_no", F.col("title").alias("n_name"))
    return queueing.rows_from_queue(queue, table(spark, sf_dir, "extracted"), "row_no", ["name"], "row_no")


@query("SELECT doc_id, 'page_from_0' AS verdict FROM documents WHERE text IS NOT NULL")
def pagination_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    v = d.select("doc_id", F.col("text").alias("base"), F.col("text").alias("page0"), F.reverse(F.concat("text", F.lit("x"))).alias("page1"), *[F.lit(None).cast("string").alias(c) for c in ("page2", "p1", "p2", "offset")])
    return v.select("doc_id", queueing.pagination_verdict(v).alias("verdict"))


# ---- contracts and profiling


@query("""SELECT 'min_rows' AS name, count(*) >= 1000 AS ok FROM extracted UNION ALL SELECT 'fields', sum(CASE WHEN regexp_matches(name, '\\S') THEN 0 ELSE 1 END) = 0 FROM extracted
 UNION ALL SELECT 'unique:ex_no', count(ex_no) = count(DISTINCT ex_no) FROM extracted UNION ALL SELECT 'coverage', avg(CASE WHEN sector <> '' THEN 1.0 ELSE 0 END) >= 0.5 AND avg(CASE WHEN amount_eur IS NOT NULL THEN 1.0 ELSE 0 END) >= 0.5 FROM extracted""")  # fmt: skip
def contract_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = contracts.ContractBook()
    for c in (contracts.min_rows(1000), contracts.required(["name"]), contracts.unique_field("ex_no"), contracts.coverage(["sector", "amount_eur"])):
        book.add(c)
    return book.status(table(spark, sf_dir, "extracted")).select("name", "ok")


@query("""WITH c AS (SELECT lang, count(*) AS n, min(doc_id) AS f FROM documents WHERE regexp_matches(lang, '\\S') GROUP BY lang), t AS (SELECT lang, n FROM c ORDER BY n DESC, f LIMIT 1)
 SELECT 'lang' AS field, lang AS mode, n AS n_mode, (SELECT sum(n) FROM c)::BIGINT AS n_populated FROM t WHERE n >= 0.6 * (SELECT sum(n) FROM c)""")  # fmt: skip
def low_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.low_cardinality(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id")


@query("SELECT round(avg((CASE WHEN regexp_matches(name, '\\S') THEN 1 ELSE 0 END + CASE WHEN amount_eur IS NOT NULL THEN 1 ELSE 0 END) / 2.0), 6)::DOUBLE AS mean_quality, round(avg(CASE WHEN NOT regexp_matches(coalesce(name, ''), '\\S') AND amount_eur IS NULL THEN 1.0 ELSE 0 END), 6)::DOUBLE AS share_empty, 'ok' AS verdict FROM extracted")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = contracts.quality_gate(table(spark, sf_dir, "extracted"), ["name", "amount_eur"])
    return q.select(F.round("mean_quality", 6).alias("mean_quality"), F.round("share_empty", 6).alias("share_empty"), "verdict")


def _stats_sql(name: str, kind: str) -> str:
    given = f"{name} IS NOT NULL AND {name} <> ''" if kind == "text" else f"{name} IS NOT NULL"
    low, high = (f"min({name})::DOUBLE", f"max({name})::DOUBLE") if kind == "number" else ("NULL::DOUBLE", "NULL::DOUBLE")
    mean, true = (f"round(avg({name}), 6)::DOUBLE" if kind == "number" else "NULL::DOUBLE"), (f"round(avg(CASE WHEN {name} THEN 1.0 WHEN NOT {name} THEN 0.0 END), 6)::DOUBLE" if kind == "flag" else "NULL::DOUBLE")
    return f"SELECT '{name}' AS variable, count(*) AS n_rows, sum(CASE WHEN {given} THEN 1 ELSE 0 END)::BIGINT AS n_non_null, count(DISTINCT CASE WHEN {given} THEN {name} END) AS n_distinct, {low} AS min_value, {high} AS max_value, {mean} AS mean_value, {true} AS share_true FROM extracted"


_KINDS = {"country_code": "text", "sector": "text", "amount_eur": "number", "n_persons": "number", "pct_fill": "number", "is_public": "flag", "has_appeal": "flag", "decided_on": "text"}


@query(" UNION ALL ".join(_stats_sql(n, k) for n, k in _KINDS.items()))
def codebook_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = profiling.codebook_stats(table(spark, sf_dir, "extracted"), BOOK)
    return s.withColumns({"mean_value": F.round("mean_value", 6), "share_true": F.round("share_true", 6)})


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS n_non_null, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, round(avg({c}), 4)::DOUBLE AS mean_value, round(stddev_samp({c}), 4)::DOUBLE AS sd_value, count(DISTINCT {c}) AS n_unique FROM lineitem" for c in ("l_quantity", "l_discount", "l_linenumber")
))
def inferred_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = profiling.inferred_stats(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_linenumber"])
    return s.select("variable", "n_non_null", "min_value", "max_value", F.round("mean_value", 4).alias("mean_value"), F.round("sd_value", 4).alias("sd_value"), "n_unique")


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) AS n_rows, sum(CASE WHEN {c} IS NOT NULL AND {c} <> '' THEN 1 ELSE 0 END)::BIGINT AS n_covered FROM dataset" for c in ("id", "title", "text", "pdf_text", "extra")))
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.field_coverage(table(spark, sf_dir, "dataset"), ["id", "title", "text", "pdf_text", "extra"])


@query("SELECT k AS variable, count(*) AS n_present FROM (SELECT unnest(json_keys(extra)) AS k FROM dataset WHERE json_valid(extra)) GROUP BY k")
def key_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset").where("try_parse_json(extra) is not null")
    return profiling.key_presence(d.select(F.from_json("extra", "map<string,string>").alias("m")), "m")


@query("""SELECT 'one' AS variable, 'single-value enum' AS issue FROM extracted HAVING count(DISTINCT CASE WHEN is_public THEN 'yes' END) = 1 UNION ALL SELECT 'rare', 'low coverage' FROM extracted HAVING avg(CASE WHEN n_persons > 900 THEN 1.0 ELSE 0 END) < 0.2
 UNION ALL SELECT 'flag', 'near-constant boolean' FROM extracted HAVING avg(CASE WHEN ex_no % 100 <> 0 THEN 1.0 ELSE 0 END) >= 0.98""")  # fmt: skip
def validate_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns made of the table's own, each with another issue, beside one without any."""
    e = table(spark, sf_dir, "extracted")
    d = e.select("sector", F.when(F.col("is_public"), "yes").alias("one"), F.when(F.col("n_persons") > 900, F.col("n_persons")).alias("rare"), (F.col("ex_no") % 100 != 0).alias("flag"))
    book = Codebook("more", [VariableSpec("sector", "enum", enum_values=["x"]), VariableSpec("one", "enum", enum_values=["yes"]), VariableSpec("rare", "integer"), VariableSpec("flag", "boolean")])
    return profiling.validate_extras(d, book)


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY o_orderpriority")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT source_site, n FROM (SELECT source_site, count(*) AS n, min(row_no) AS f FROM dataset GROUP BY source_site) ORDER BY n DESC, f LIMIT 10")
def top_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.top_frequencies(table(spark, sf_dir, "dataset"), "source_site", "row_no", 10)


@query("SELECT * FROM (VALUES ('llm', 'has_llm'), ('llm', 'is_mentions_llm'), ('vector_db', 'has_vector_database'), ('vector_db', 'has_vector_db')) t(stem, name)")
def duplicate_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["has_llm", "is_mentions_llm", "has_vector_database", "has_vector_db", "n_seats"]
    groups = Codebook("c", [VariableSpec(n) for n in names]).duplicate_groups()
    return spark.createDataFrame([(k, n) for k, v in groups.items() for n in v], "stem string, name string")


@query("SELECT * FROM (VALUES ('c_custkey', 'integer'), ('c_name', 'string'), ('c_nationkey', 'integer'), ('c_acctbal', 'float'), ('c_mktsegment', 'string')) t(name, type)")
def inferred_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = profiling.infer_codebook(table(spark, sf_dir, "customer"))
    return spark.createDataFrame([(v.name, v.type) for v in book.variables], "name string, type string")


@query("SELECT row_no FROM (SELECT row_no, row_number() OVER (ORDER BY row_no) AS r FROM dataset) WHERE r <= 3")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.first_rows(table(spark, sf_dir, "dataset").select("row_no"), 3, "row_no")


@query("SELECT row_no, row_number() OVER (ORDER BY row_no) - 1 AS place FROM dataset")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.numbered_rows(table(spark, sf_dir, "dataset").select("row_no"), "row_no", "place").select("row_no", F.col("place").cast("long").alias("place"))


# ---- run history: events by user stand for the turns of runs


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.history_tail(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 3)


@query("SELECT user_id, event_id, n_repeats FROM (SELECT user_id, event_id, len(list_filter(list(event_type) OVER w, lambda x : x = event_type))::INTEGER AS n_repeats FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n_repeats >= 3")
def loop_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return profiling.repeated_calls(e, "user_id", "event_id", F.col("event_type")).select("user_id", "event_id", "n_repeats")


@query("SELECT user_id, event_id, tool, n_failures FROM (SELECT user_id, event_id, event_type AS tool, len(list_filter(list(CASE WHEN value > 50 THEN event_type END) OVER w, lambda x : x = event_type))::INTEGER AS n_failures FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) WHERE n_failures >= 3")
def failure_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("tool"), "value")
    return profiling.repeated_failures(e, "user_id", "event_id", "tool", F.col("value") > 50)


@query("""WITH s AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events), t AS (SELECT * FROM s WHERE p IS NULL OR p <> value),
 l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM t), d AS (SELECT user_id, event_id, sign(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM l WHERE r <= 6),
 e AS (SELECT user_id, d, lag(d) OVER (PARTITION BY user_id ORDER BY event_id) AS e FROM d) SELECT user_id, sum(CASE WHEN d <> e THEN 1 ELSE 0 END)::BIGINT AS n_flips FROM e GROUP BY user_id HAVING count(*) >= 5 AND sum(CASE WHEN d <> e THEN 1 ELSE 0 END) >= 2""")  # fmt: skip
def churn_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.churn(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query("""WITH i AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS h, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events)
 SELECT user_id, event_id, sum(h) OVER (PARTITION BY user_id, g ORDER BY event_id)::BIGINT AS n_consecutive FROM i""")  # fmt: skip
def consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return profiling.consecutive(e, "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id", "n_consecutive")


@query("SELECT event_type, count(*) AS n_calls, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS n_failed FROM events GROUP BY event_type")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.trace_summary(table(spark, sf_dir, "events"), "event_type", F.col("value") > 50)


# ---- extraction, export, streaming


@query("""SELECT row_no, TRY_CAST(regexp_extract(id, '-([0-9]{4})-', 1) AS BIGINT) AS n_year, CASE WHEN regexp_extract(id, '^([A-Z]{3})-', 1) <> '' THEN regexp_extract(id, '^([A-Z]{3})-', 1) END AS kind FROM dataset WHERE id IS NOT NULL""")
def rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Codebook("ids", [VariableSpec("n_year", "integer", min_value=1900, max_value=2100), VariableSpec("kind")])
    rule = extraction.RuleExtractor({"n_year": r"-([0-9]{4})-", "kind": r"^([A-Z]{3})-"})
    d = spread(table(spark, sf_dir, "dataset").where("id is not null"))
    return extraction.extract(d, book, rule, "row_no", "id").select("row_no", "n_year", "kind")


@query("SELECT ex_no, country_code, TRY_CAST(CASE WHEN regexp_matches(decided_on, '^.{4}-.{2}-.{2}') THEN left(decided_on, 10) END AS DATE)::VARCHAR AS decided_on, amount_eur FROM extracted")
def export_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dsforge.sources.export import typed

    out = typed(table(spark, sf_dir, "extracted"), BOOK, ["ex_no"])
    return out.select(F.col("ex_no").cast("long").alias("ex_no"), "country_code", F.col("decided_on").cast("string").alias("decided_on"), "amount_eur")


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id")
def stream_append_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, each user once, read to the end into a table in the checkpoint folder."""
    import uuid

    from dsforge.session import ensure_checkpoint_dir
    from dsforge.streaming.incremental import append_distinct, read_rows

    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = append_distinct(read_rows(spark, f"{sf_dir}/events.parquet*", schema, "parquet").select("user_id"), "user_id")
    run = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("user_id long").parquet(f"{at}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
