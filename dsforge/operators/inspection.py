"""Looking into pages: what repeats, where values stand, which links lead to data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What class names of page chrome contain.
CHROME = ["nav", "btn", "button", "header", "footer", "breadcrumb", "menu", "language", "search-bar", "form-", "carousel", "logo"]
# Data files by extension, with the score of their kind.
ASSETS = {".pdf": 90, ".xml": 80, ".json": 80, ".csv": 80, ".tsv": 75, ".xlsx": 75, ".xls": 70, ".docx": 70, ".doc": 65, ".zip": 60, ".tar": 60, ".gz": 55, ".txt": 50}


def _scanned(html: Column, most: int | None = None) -> Column:
    """Markup without the bodies of scripts and styles and without comments; whole, or its first ``most`` characters."""
    for tag in ("script", "style"):
        html = F.regexp_replace(html, rf"(?is)(<{tag}\b[^>]*>).*?(</{tag}>)", "$1$2")
    plain = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return plain if most is None else F.substring(plain, 1, most)


def tag_counts(pages: DataFrame, html: str = "html", most: int | None = None) -> DataFrame:
    """(tag, n) over all pages."""
    tags = pages.select(F.explode(F.regexp_extract_all(_scanned(F.col(html), most), F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.select(F.lower("tag").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def class_counts(pages: DataFrame, html: str = "html", most: int | None = None) -> DataFrame:
    """(token, n) over the class attributes of all pages."""
    attrs = pages.select(F.explode(F.regexp_extract_all(_scanned(F.col(html), most), F.lit(r'\bclass="([^"]*)"'), F.lit(1))).alias("a"))
    return attrs.select(F.explode(F.split(F.trim("a"), r"\s+")).alias("token")).where("token != ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def sample_block_class(counts: DataFrame) -> DataFrame:
    """The class that most likely marks a row: the first of the top 20 that occurs 3 to 200 times and isn't chrome."""
    top = counts.orderBy(F.desc("n"), "token").limit(20)
    plain = F.lit(True)
    for c in CHROME:
        plain = plain & ~F.lower("token").contains(c)
    return top.where(plain & F.col("n").between(3, 200)).orderBy(F.desc("n"), "token").limit(1)


def sample_block(pages: DataFrame, key: str, html: str = "html", size: int = 30_000) -> DataFrame:
    """(key, token, block): from the first element of the class that most likely marks a row, up to ``size`` characters, ended at the last tag."""
    best = sample_block_class(class_counts(pages, html)).first()
    token = best.token if best else None
    rows = pages.select(key, F.col(html).alias("_h"), F.lit(token).cast("string").alias("token"))
    at = F.regexp_instr("_h", F.concat(F.lit(r'<[a-zA-Z][a-zA-Z0-9]*\b[^>]*class="[^"]*\b\Q'), F.col("token"), F.lit(r'\E\b')))
    cut = F.substring(F.col("_h"), at, F.lit(size))
    whole = F.when(F.length("_h") - at < size, cut).otherwise(F.regexp_extract(cut, r"(?s)^.*>", 0))
    return rows.where(at > 0).select(key, "token", whole.alias("block"))


def find_class(pages: DataFrame, token: str, key: str, tag: str | None = None, limit: int = 5, size: int = 1200, html: str = "html") -> DataFrame:
    """(key, n_hits, blocks): elements with a class token, their number and the first few, each cut to ``size``."""
    name = tag or "[a-zA-Z][a-zA-Z0-9]*"
    pattern = rf'(?is)<({name})\b[^>]*class="[^"]*\b{token}\b[^"]*"[^>]*>.*?</\1>'
    found = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(0))
    return pages.select(key, F.size(found).alias("n_hits"), F.transform(F.slice(found, 1, limit), lambda x: F.substring(x, 1, size)).alias("blocks"))


def extract_pattern(pages: DataFrame, pattern: str, key: str, limit: int = 10, size: int = 1200, html: str = "html") -> DataFrame:
    """(key, n_hits, hits) of a pattern; several groups are joined."""
    import re

    groups = re.compile(pattern).groups
    at = [F.regexp_extract_all(F.col(html), F.lit("(?s)" + pattern), F.lit(g)) for g in (range(1, groups + 1) if groups else [0])]
    joined = at[0] if len(at) == 1 else F.transform(F.arrays_zip(*[a.alias(f"g{i}") for i, a in enumerate(at)]), lambda x: F.concat_ws(" | ", *[x[f"g{i}"] for i in range(len(at))]))
    return pages.select(key, F.size(joined).alias("n_hits"), F.transform(F.slice(joined, 1, limit), lambda x: F.substring(x, 1, size)).alias("hits"))


def probe_values(pages: DataFrame, values: list[str], key: str, context: int = 400, max_hits: int = 2, html: str = "html") -> DataFrame:
    """(key, value, hit, at, context, pattern): the first places of literal values, what stands around them and a pattern that finds them again."""
    wanted = F.explode(F.array(*[F.lit(v) for v in values])).alias("value")
    rows = pages.select(key, F.col(html).alias("_h"), wanted)
    # the texts between the hits give the hits' places
    pieces = F.split("_h", F.concat(F.lit(r"\Q"), F.col("value"), F.lit(r"\E")), -1)
    ends = F.transform(F.slice(pieces, 1, max_hits), lambda x, i: F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda a, y: a + F.length(y)) + i * F.length("value") + 1)
    hits = rows.withColumn("_n", F.size(pieces) - 1).withColumn("_at", F.slice(ends, 1, F.least(F.lit(max_hits), F.col("_n")))).where("_n > 0")
    out = hits.select(key, "value", "_h", F.posexplode("_at").alias("hit", "at")).select(
        key, "value", "hit", F.col("at").cast("int").alias("at"), F.substring(F.col("_h"), F.greatest(F.lit(1), F.col("at") - context // 2).cast("int"), F.lit(context) + F.length("value")).alias("context")
    )
    return out.withColumn("pattern", suggested_pattern(F.col("context"), F.col("value")))


def suggested_pattern(context: Column, value: Column) -> Column:
    """A pattern that finds the value again: what stands before it on its line, back to the last tag, and up to the next one."""
    before = F.split_part(context, value, F.lit(1))
    lead = F.regexp_extract(before, r"(<[^<>]*>)[^<>]*$", 1)
    label = F.regexp_extract(before, r"([^<>\n]*)$", 1)
    quoted = lambda c: F.regexp_replace(c, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return F.concat(F.regexp_replace(quoted(lead), r"\s+", r"\\s+"), F.regexp_replace(quoted(label), r"\d+", r"\\d+"), F.lit("([^<]+)"))


def links(pages: DataFrame, key: str, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, href, anchor) of all links that lead somewhere."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?is)<a\s+[^>]*href="[^"]+"[^>]*>.*?</a>'), F.lit(0))
    rows = pages.select(key, *keep, F.posexplode(found).alias("pos", "_a"))
    href = F.trim(F.regexp_extract("_a", r'(?is)<a\s+[^>]*href="([^"]+)"', 1))
    anchor = F.trim(F.regexp_replace(F.regexp_replace("_a", r"(?s)<[^>]+>", " "), r"\s+", " "))
    return rows.select(key, *keep, "pos", href.alias("href"), anchor.alias("anchor")).where(~F.col("href").rlike("^(?:javascript:|mailto:|tel:|#)") & (F.col("href") != ""))


def resolve_url(base: Column, href: Column) -> Column:
    """An absolute URL of a link; covers what pages use: absolute, scheme-relative, root-relative and relative to the page's folder."""
    scheme, host = F.regexp_extract(base, r"^([a-z]+):", 1), F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([a-z]+://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    return F.when(href.rlike("^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), href))


def asset_score(url: Column) -> Column:
    """Score of a link to a data file by its extension, 0 for others."""
    names = "|".join(sorted((e[1:] for e in ASSETS), key=len, reverse=True))
    ext = F.regexp_extract(F.lower(url), rf"(\.(?:{names}))(?:$|[?#])", 1)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ASSETS.items() for x in kv]), ext), F.lit(0))


def top_assets(pages: DataFrame, key: str, base: str, k: int = 5, least: int = 15, html: str = "html") -> DataFrame:
    """(key, rank, url, score, anchor): of each page the best-scored links to data files, each URL once."""
    rows = links(pages, key, html, keep=(base,)).withColumn("score", asset_score(F.col("href"))).where(F.col("score") >= least).withColumn("url", resolve_url(F.col(base), F.col("href")))
    first = rows.groupBy(key, "url").agg(F.min(F.struct("pos", "score", "anchor")).alias("x")).select(key, "url", "x.*")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos"))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "url", "score", "anchor")


def asset_text(assets: DataFrame, key: str) -> DataFrame:
    """The texts of each item's assets (columns rank, kind, anchor, text) as one, in order of rank; an item has at most as many as ``top_assets`` gives."""
    block = F.concat(F.lit("--- asset_"), F.lpad(F.col("rank").cast("string"), 2, "0"), F.lit(" ("), F.col("kind"), F.lit("): "), F.coalesce("anchor", F.lit("")), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    return assets.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))


def duplicate_fields(df: DataFrame, fields: list[str], order: str, sample: int = 5) -> DataFrame:
    """(a, b): pairs of fields that are equal and not null on all of the first few rows, two at least."""
    names = [f for f in fields if not f.startswith("_") and f != "id" and "url" not in f]
    few = df.orderBy(order).limit(sample)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string")
    aggs = [F.min((F.col(f"`{a}`").cast("string") == F.col(f"`{b}`").cast("string")) & F.col(f"`{a}`").isNotNull()).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    nulls = [F.count(F.when(F.col(f"`{a}`").isNull() | F.col(f"`{b}`").isNull(), 1)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)]
    one = few.agg(*aggs, *nulls, F.count(F.lit(1)).alias("_rows"))
    long = one.select("_rows", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("same"), F.col(f"n{i}").alias("nulls")) for i, (a, b) in enumerate(pairs)])).alias("x"))
    return long.where("_rows >= 2 and x.same and x.nulls = 0").select("x.a", "x.b")


def diagnose_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """(variable, issue, n): suspicious values: null, relative or filter URLs, time stamps in dates, times in ids."""
    rows = []
    for f in fields:
        c = F.col(f"`{f}`").cast("string")
        issue = F.when(c.isNull() | (c == ""), "null")
        if "url" in f or "link" in f:
            issue = issue.when(c.rlike(r"[?&](?:f\[|filter|facet|sort)"), "filter url").when(~c.rlike("^[a-z]+://"), "relative url")
        if "date" in f:
            issue = issue.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T"), "time stamp in date")
        if f == "id" or f.endswith("_id"):
            issue = issue.when(c.rlike(r"\d{2}T\d{2}"), "time in id")
        rows.append(F.struct(F.lit(f).alias("variable"), issue.alias("issue")))
    return df.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("issue is not null").groupBy("variable", "issue").agg(F.count(F.lit(1)).alias("n"))


# Fields that hold a row's text, by preference, fields left out of a row's description, and fields that count as inline text.
TEXT_FIELDS = ["pdf_text", "text", "body", "content"]
SKIPPED = ["id", "text_path", "txt_path", "txt_file", "text_file", "pdf_text", "pdf_path", "attachment", "attachment_path"]
INLINE = ["pdf_text", "text", "body", "content", "abstract", "description", "full_description_text", "short_summary", "summary"]


def row_text(df: DataFrame, file_text: str | None = None) -> Column:
    """A row's text: of its file, else a long text field, else its fields as lines."""
    kinds = dict(df.dtypes)
    choices = [F.col(file_text)] if file_text else []
    choices += [F.when(F.length(F.col(f"`{f}`")) > 200, F.col(f"`{f}`")) for f in TEXT_FIELDS if kinds.get(f) == "string"]
    lines = []
    for c, k in kinds.items():
        if c in SKIPPED or c.startswith("_") or c == file_text:
            continue
        x = F.col(f"`{c}`")
        if k == "string":
            lines.append(F.when(x.rlike(r"(?U)\S"), F.concat(F.lit(f"{c}: "), x)))
        elif k.startswith("array"):
            lines.append(F.when(F.size(x) > 0, F.concat(F.lit(f"{c}: "), F.array_join(F.slice(x.cast("array<string>"), 1, 20), ", "))))
        elif k in ("int", "bigint", "double", "float", "boolean"):
            lines.append(F.when(x.isNotNull(), F.concat(F.lit(f"{c}: "), x.cast("string"))))
    return F.coalesce(*choices, F.concat_ws("\n", *lines))


def text_gate(df: DataFrame, text: Column, structured: list[str], least: int = 200, fields: int = 3) -> DataFrame:
    """Rows with ``_extract_status``: ok, or no_text where neither text nor structured fields suffice."""
    kinds = dict(df.dtypes)
    filled = sum((F.when(F.col(f"`{c}`").isNotNull() & ((F.col(f"`{c}`") != "") if kinds[c] == "string" else F.lit(True)), 1).otherwise(0) for c in structured), F.lit(0))
    return df.withColumn("_extract_status", F.when((F.coalesce(F.length(text), F.lit(0)) >= least) | (filled >= fields), "ok").otherwise("no_text"))


def text_coverage(df: DataFrame, file_bytes: str | None = None, least: int = 500) -> DataFrame:
    """One row: rows with enough text inline or in a file, all rows, and their share."""
    kinds = dict(df.dtypes)
    enough = F.lit(False)
    for f in INLINE:
        if kinds.get(f) == "string":
            enough = enough | (F.coalesce(F.length(F.col(f"`{f}`")), F.lit(0)) >= least)
    if file_bytes:
        enough = enough | (F.coalesce(F.col(file_bytes), F.lit(0)) >= least)
    return df.agg(F.sum(enough.cast("int")).cast("long").alias("n_with_text"), F.count(F.lit(1)).alias("n_rows"), F.avg(enough.cast("double")).alias("share"))


def template_column(template, fields: list[str]) -> Column:
    """A row template as a column: "{queue.k}" alone keeps the type, inside a text it is written out (null as nothing); lists and dicts go into depth."""
    import re

    if isinstance(template, dict):
        return F.struct(*[template_column(v, fields).alias(k) for k, v in template.items()])
    if isinstance(template, list):
        return F.array(*[template_column(v, fields) for v in template])
    if not isinstance(template, str):
        return F.lit(template)
    whole = re.fullmatch(r"\{queue\.(\w+)\}", template)
    if whole:
        return F.col(f"`{whole[1]}`") if whole[1] in fields else F.lit(None)
    parts = re.split(r"\{queue\.(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(F.col(f"`{p}`").cast("string"), F.lit("")) if p in fields else F.lit("") for i, p in enumerate(parts)])
