"""Queries of the operators over pages and texts. The pages are made from the rows of ``dataset``: one small page per row, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dsforge.functions import text as X
from dsforge.functions.tolerant_json import json_object, json_rows, tool_call
from dsforge.operators import inspection
from dsforge.plans.registry import query
from dsforge.plans.spec import TEMPLATES, Spec
from dsforge.session import spread, table
from dsforge.sources.extract_text import with_text

HEAD = '<html><head><title>'
STYLE = '</title><style>.x { color: red }</style></head><body class="page wide"><!-- top --><nav><ul class="menu"><li class="item nav"><a href="/home">Home</a></li></ul></nav><article class="main"><h1>'
LIST = '</h1><ul class="list"><li class="item"><a href="/item/'
NEXT = '</a></li><li class="item"><a href="https://files.example/'
PDF = '.pdf">Report &amp; annex</a></li><li class="item"><a href="mailto:a@b.example">Mail</a></li></ul><script>var s = "</p>";</script><p style="x">'
TAIL = "</p></article></body></html>"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html) of every row of ``dataset``."""
    d = table(spark, sf_dir, "dataset")
    title, n = F.coalesce("title", F.lit("")), F.col("row_no").cast("string")
    html = F.concat(F.lit(HEAD), title, F.lit(STYLE), title, F.lit(LIST), n, F.lit('">'), title, F.lit(NEXT), n, F.lit(PDF), F.coalesce("source_site", F.lit("")), F.lit(TAIL))
    return d.select(F.col("row_no").alias("page_id"), F.concat(F.lit("https://site.example/p/"), n).alias("url"), html.alias("html"))


PAGES = f"""pages AS (SELECT row_no AS page_id, 'https://site.example/p/' || row_no::VARCHAR AS url,
 '{HEAD}' || coalesce(title, '') || '{STYLE}' || coalesce(title, '') || '{LIST}' || row_no::VARCHAR || '">' || coalesce(title, '') || '{NEXT}' || row_no::VARCHAR || '{PDF}' || coalesce(source_site, '') || '{TAIL}' AS html FROM dataset)"""
ITEMS = f"{PAGES}, blocks AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li class=\"item\">(.*?)</li>', 1)) AS b, generate_subscripts(regexp_extract_all(html, '(?s)<li class=\"item\">(.*?)</li>', 1), 1) AS i FROM pages)"

LISTING = {
    "row_pattern": r'<li class="item">(.*?)</li>', "base_url": "https://site.example/",
    "fields": {"url": {"regex": r'href="([^"]+)"', "prefix_base": True}, "label": {"regex": r"<a[^>]*>(.*?)</a>", "transform": "strip_html"}},
}


def _plain(sql: str) -> str:
    """Tags off, common entities resolved, white space collapsed, in SQL."""
    out = f"regexp_replace({sql}, '(?s)<[^>]+>', ' ', 'g')"
    for entity, char in X.ENTITIES.items():
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


@query(f"WITH {ITEMS} SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN regexp_extract(b, 'href=\"([^\"]+)\"', 1) LIKE '/%' THEN 'https://site.example' ELSE '' END || regexp_extract(b, 'href=\"([^\"]+)\"', 1) AS url, {_plain('''regexp_extract(b, '(?s)<a[^>]*>(.*?)</a>', 1)''')} AS label FROM blocks")
def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Spec.normalise(LISTING).listing(pages(spark, sf_dir), keep=("page_id",)).withColumnRenamed("_pos", "pos")


@query(f"WITH {PAGES} SELECT page_id, {_plain('''regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)''')} AS title, regexp_extract(html, '<p style=\"x\">([^<]*)</p>', 1) AS site FROM pages")
def detail_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Spec.normalise({"fields": {"title": {"regex": r"<h2>(.*?)</h2>", "fallback_regex": r"<h1>(.*?)</h1>", "transform": "strip_html"}, "site": r'<p style="x">([^<]*)</p>'}})
    return spec.detail(pages(spark, sf_dir), keep=("page_id",))


@query(f"WITH {PAGES} SELECT page_id, array_to_string(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), ' ') AS urls FROM pages")
def listing_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Spec.normalise({"fields": {"urls": {"regex": r'href="([^"]+)"', "multi": True}}})
    return spec.detail(pages(spark, sf_dir), keep=("page_id",)).withColumn("urls", F.array_join("urls", " "))


@query(f"WITH {ITEMS} SELECT page_id, regexp_extract(b, 'href=\"([^\"]+)\"', 1) AS url FROM blocks WHERE contains(b, '/') AND NOT contains(b, '.pdf')")
def listing_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Spec.normalise({"row_pattern": LISTING["row_pattern"], "include_substring": "/", "exclude_substring": ".pdf", "fields": {"url": r'href="([^"]+)"'}})
    return spec.listing(pages(spark, sf_dir), keep=("page_id",)).drop("_pos")


@query(f"WITH {PAGES} SELECT page_id, {_plain('html')} AS body FROM pages")
def strip_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", X.strip_tags(F.col("html")).alias("body"))


@query(f"""WITH {PAGES} SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', '', 'g'), '(?is)<head\\b[^>]*>.*?</head>', '', 'g'),
 '(?s)<!--.*?-->', '', 'g'), '(?is)<nav\\b[^>]*>.*?</nav>', '', 'g'), ' style="[^"]*"', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n\\s*\\n+', chr(10), 'g'))::INTEGER AS n_chars FROM pages""")  # fmt: skip
def strip_chrome_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.length(X.strip_chrome(F.col("html"))).alias("n_chars"))


@query(f"""WITH {PAGES}, s AS (SELECT regexp_replace(regexp_replace(regexp_replace(html, '(?is)(<script\\b[^>]*>).*?(</script>)', '\\1\\2', 'g'), '(?is)(<style\\b[^>]*>).*?(</style>)', '\\1\\2', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
 t AS (SELECT lower(unnest(regexp_extract_all(h, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM s) SELECT tag, count(*) AS n FROM t GROUP BY tag""")  # fmt: skip
def tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.tag_counts(pages(spark, sf_dir))


@query(f"""WITH {PAGES}, a AS (SELECT unnest(regexp_extract_all(html, '\\bclass="([^"]*)"', 1)) AS a FROM pages), t AS (SELECT unnest(string_split(trim(a), ' ')) AS token FROM a)
 SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY token""")  # fmt: skip
def class_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.class_counts(pages(spark, sf_dir))


@query(f"""WITH {PAGES}, c AS (SELECT page_id, len(regexp_extract_all(html, 'views-row')) AS v, len(regexp_extract_all(html, '(?i)<tr\\b')) AS tr, len(regexp_extract_all(html, '(?i)<article\\b')) AS ar,
 len(regexp_extract_all(html, '(?i)<li\\b[^>]*class="[^"]*(?:post|item|card|result)')) AS li FROM pages)
 SELECT page_id, CASE WHEN v >= 5 THEN 'drupal_views' WHEN tr >= 20 AND tr > 2 * ar THEN 'table' WHEN ar >= 5 THEN 'wp_article' WHEN li >= 5 THEN 'li_card' ELSE 'generic_div' END AS pattern FROM c""")  # fmt: skip
def listing_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", X.listing_pattern(F.col("html")).alias("pattern"))


@query(f"WITH {PAGES} SELECT page_id, len(regexp_extract_all(html, '(?is)<li\\b[^>]*class=\"[^\"]*\\bitem\\b[^\"]*\"[^>]*>.*?</li>'))::INTEGER AS n_hits FROM pages")
def html_find_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.find_class(pages(spark, sf_dir), "item", "page_id", "li").select("page_id", "n_hits")


@query(f"WITH {PAGES} SELECT page_id, len(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1))::INTEGER AS n_hits, regexp_extract(html, 'href=\"(/[^\"]*)\"', 1) AS first_hit FROM pages")
def html_extract_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.extract_pattern(pages(spark, sf_dir), r'href="(/[^"]*)"', "page_id").select("page_id", "n_hits", F.get("hits", F.lit(0)).alias("first_hit"))


@query(f"""WITH {PAGES}, v AS (SELECT unnest(['example', 'Report']) AS value), p AS (SELECT page_id, value, html, string_split(html, value) AS parts FROM pages, v)
 SELECT page_id, value, (strpos(html, value))::INTEGER AS first_at, (CASE WHEN len(parts) - 1 > 2 THEN 2 ELSE len(parts) - 1 END)::BIGINT AS n_shown FROM p WHERE len(parts) > 1""")  # fmt: skip
def field_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = inspection.probe_values(pages(spark, sf_dir), ["example", "Report"], "page_id")
    return hits.groupBy("page_id", "value").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n_shown"))


_EXTENSIONS = {
    "": "", "text/html; charset=x": ".html", "application/json": ".json", "application/pdf": ".pdf", "text/csv": ".csv", "application/xml": ".xml", "text/plain": ".txt",
}
_ENDS = ["", ".csv?x=1", ".JPG#a", "/"]
_HEADS = ["<html>", "%PDF-1", "PK..", "<?xml ?>", '{"a": 1}', '[1]', "x", '{"a": 1}\n{"a": 2}']


@query(f"""WITH d AS (SELECT row_no AS page_id, 'https://h.example/p' || row_no::VARCHAR || list_extract({_ENDS}, (row_no % 4 + 1)::INTEGER) AS url, nullif(list_extract({list(_EXTENSIONS)}, (row_no % 7 + 1)::INTEGER), '') AS kind, (row_no % 8 + 1)::INTEGER AS h FROM dataset),
 e AS (SELECT *, CASE WHEN kind IS NOT NULL THEN list_extract({list(_EXTENSIONS.values())}, (page_id % 7 + 1)::INTEGER) WHEN page_id % 4 = 1 THEN '.csv' WHEN page_id % 4 = 2 THEN '.jpg' ELSE list_extract(['.html', '.pdf', '.zip', '.xml', '.json', '.json', '.bin', '.json'], h) END AS ext FROM d)
 SELECT page_id, left(sha1(url), 12) AS slug, CASE WHEN ext = '.json' AND h = 8 THEN '.jsonl' ELSE ext END AS ext FROM e""")  # fmt: skip
def page_slug_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names by content type, suffix and first bytes, in all their combinations."""
    d, n = table(spark, sf_dir, "dataset"), F.col("row_no")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (n % k + 1).cast("int"))
    url = F.concat(F.lit("https://h.example/p"), n.cast("string"), pick(_ENDS, 4))
    return d.select(n.alias("page_id"), X.page_slug(url).alias("slug"), X.page_extension(url, F.nullif(pick(list(_EXTENSIONS), 7), F.lit("")), pick(_HEADS, 8)).alias("ext"))


@query(f"WITH {PAGES} SELECT page_id, substr(regexp_replace(regexp_replace(html, '(?is)<head\\b[^>]*>.*?</head>', '', 'g'), '(?is)<script\\b[^>]*>.*?</script>', '', 'g'), strpos(regexp_replace(html, '(?is)<head\\b[^>]*>.*?</head>', '', 'g'), '<article'), 40) AS preview FROM pages")
def body_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", X.body_preview(F.col("html"), 40).alias("preview"))


@query("SELECT left(sha1(text), 10) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY digest HAVING count(*) > 1")
def content_hash_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.substring(F.sha1(F.col("text").cast("binary")), 1, 10).alias("digest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"WITH {PAGES} SELECT page_id, 1::INTEGER AS rank, 'https://files.example/' || page_id::VARCHAR || '.pdf' AS url, 90::INTEGER AS score FROM pages")
def asset_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.top_assets(pages(spark, sf_dir), "page_id", "url").select("page_id", F.col("rank").cast("int").alias("rank"), "url", F.col("score").cast("int").alias("score"))


@query("SELECT path, 'plain' AS kind, length(content)::INTEGER AS n_chars FROM text_files WHERE content IS NOT NULL AND NOT regexp_matches(ltrim(content), '^[\\[{]')")
def extract_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "text_files").where("content is not null")
    return with_text(spread(files)).where("kind = 'plain'").select("path", "kind", F.length("text").alias("n_chars"))


@query("SELECT row_no, CASE WHEN length(coalesce(text, '')) >= 200 OR (CASE WHEN coalesce(title, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(date, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(detail_url, '') <> '' THEN 1 ELSE 0 END) >= 3 THEN 'ok' ELSE 'no_text' END AS status FROM dataset")
def text_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset")
    return inspection.text_gate(d, F.col("text"), ["title", "date", "detail_url"]).select("row_no", F.col("_extract_status").alias("status"))


@query("SELECT row_no, CASE WHEN length(pdf_text) > 200 THEN pdf_text WHEN length(text) > 200 THEN text ELSE concat_ws(chr(10), CASE WHEN regexp_matches(text, '\\S') THEN 'text: ' || text END, CASE WHEN regexp_matches(title, '\\S') THEN 'title: ' || title END, 'load_no: ' || load_no::VARCHAR) END AS body FROM (SELECT row_no, pdf_text, text, title, load_no FROM dataset)")
def row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset").select("pdf_text", "text", "title", "load_no", F.col("row_no").alias("_row_no"))
    return d.select(F.col("_row_no").alias("row_no"), inspection.row_text(d).alias("body"))


@query("SELECT sum(CASE WHEN length(coalesce(d.pdf_text, '')) >= 500 OR length(coalesce(d.text, '')) >= 500 OR coalesce(f.n_bytes, 0) >= 500 THEN 1 ELSE 0 END)::BIGINT AS n_with_text, count(*) AS n_rows FROM dataset d LEFT JOIN text_files f ON d.text_path = f.path")
def bronze_text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "text_files").select(F.col("path").alias("text_path"), "n_bytes")
    d = table(spark, sf_dir, "dataset").select("text", "pdf_text", "text_path").join(files, "text_path", "left")
    return inspection.text_coverage(d, "n_bytes").select("n_with_text", "n_rows")


@query("SELECT d.row_no, CASE WHEN length(f.content) > 100 THEN left(f.content, 100) || chr(10) || '[truncated, full ' || length(f.content)::VARCHAR || ' chars]' ELSE f.content END AS head FROM dataset d LEFT JOIN text_files f ON d.text_path = f.path WHERE d.text_path IS NOT NULL")
def file_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dsforge.sources.files import join_files

    d = table(spark, sf_dir, "dataset").where("text_path is not null")
    return join_files(d, table(spark, sf_dir, "text_files"), "text_path").select("row_no", X.truncate(F.col("_file_text"), 100).alias("head"))


@query("SELECT variable, issue, count(*) AS n FROM (SELECT 'detail_url' AS variable, CASE WHEN coalesce(detail_url, '') = '' THEN 'null' WHEN regexp_matches(detail_url, '[?&](?:f\\[|filter|facet|sort)') THEN 'filter url' WHEN NOT regexp_matches(detail_url, '^[a-z]+://') THEN 'relative url' END AS issue FROM dataset UNION ALL SELECT 'date', CASE WHEN coalesce(date, '') = '' THEN 'null' WHEN regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T') THEN 'time stamp in date' END FROM dataset) t WHERE issue IS NOT NULL GROUP BY variable, issue")
def field_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.diagnose_fields(table(spark, sf_dir, "dataset"), ["detail_url", "date"])


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' properties, found again inside a fence with prose around it and a trailing comma."""
    e = spread(table(spark, sf_dir, "events"))
    broken = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```\nDone."))
    return e.select("event_id", F.get_json_object(json_object(broken), "$.k").alias("k"))


@query("SELECT event_id, event_type AS tool, NULL::VARCHAR AS error FROM events")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "events"))
    text = F.concat(F.lit("I will call {'action': '"), F.col("event_type"), F.lit("', 'input': {'n': "), F.col("event_id").cast("string"), F.lit("}} now"))
    return e.select("event_id", tool_call(text).alias("c")).select("event_id", "c.tool", "c.error")


@query("SELECT event_id, list_extract([2, 1, 3, 1, 0], (event_id % 5 + 1)::INTEGER)::INTEGER AS n_rows FROM events")
def json_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under a key with a stray number, a bare list in prose, another key in a fence, a single object, and an empty envelope."""
    e = spread(table(spark, sf_dir, "events"))
    p = F.col("props")
    forms = [
        F.concat(F.lit('{"results": ['), p, F.lit(", "), p, F.lit(", 7]}")), F.concat(F.lit("["), p, F.lit("]")), F.concat(F.lit("So:\n```json\n{'items': ["), p, F.lit(","), p, F.lit(","), p, F.lit(",]}\n```")), p, F.lit('{"rows": []}'),
    ]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", F.size(json_rows(text)).alias("n_rows"))


@query(f"WITH {ITEMS} SELECT page_id, count(*) AS n_rows FROM blocks GROUP BY page_id")
def template_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in template for cards in lists, narrowed to plain items."""
    spec = Spec.normalise(TEMPLATES["li_card"] | {"row_pattern": r'<li class="item">(.*?)</li>', "base_url": "https://site.example"})
    return spec.listing(pages(spark, sf_dir), keep=("page_id",)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"WITH {PAGES} SELECT page_id, 'page ' || page_id::VARCHAR || ' at ' || url AS line, page_id AS kept FROM pages")
def row_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    made = inspection.template_column({"line": "page {queue.page_id} at {queue.url}", "kept": "{queue.page_id}"}, p.columns)
    return p.select("page_id", made.alias("t")).select("page_id", "t.line", "t.kept")
