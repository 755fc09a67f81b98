"""Pages by URL: an interface for fetching, its retry policy, and the offline form, a lookup in a table of saved pages."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dsforge.operators.rows import left_join_by_key
from dsforge.sources.files import confined, read_bytes, write_bytes


class Fetcher(Protocol):
    """(status, content type, body) of a URL."""

    def __call__(self, url: str) -> tuple[int, str, bytes]: ...


@dataclass
class RetryPolicy:
    """Busy and failing servers are tried again, after growing waits or as long as they ask, within a bound; other errors of the client fail at once."""

    waits: tuple[float, ...] = (1.0, 4.0, 16.0, 60.0)
    longest: float = 60.0
    sleep: Callable[[float], None] = time.sleep

    def run(self, fetch: Callable[[str], tuple[int, dict, bytes]], url: str) -> tuple[int, dict, bytes]:
        for wait in (*self.waits, None):
            status, headers, body = fetch(url)
            if wait is None or (status != 429 and status < 500):
                return status, headers, body
            asked = headers.get("Retry-After", "")
            self.sleep(min(self.longest, float(asked) if asked.isdigit() else wait))
        raise AssertionError("unreachable")


def fetch_saved(urls: DataFrame, pages: DataFrame, url: str = "url", content: str = "html") -> DataFrame:
    """Rows with the saved page of their URL, and ``_error`` where there is none. Pages are found by the whole URL; its slug, which is short, only names files."""
    saved = pages.where("url is not null").groupBy(F.col("url").alias("_url")).agg(F.min(content).alias("_page"))
    rows = left_join_by_key(urls.withColumn("_url", F.col(url).cast("string")), saved, "_url").drop("_url")
    return rows.withColumn("_error", F.when(F.col("_page").isNull(), F.concat(F.lit("no saved page for "), F.coalesce(F.col(url), F.lit("null")))))


def cache_name(url: str, content_type: str = "", body: bytes = b"") -> str:
    """The file a page is kept in: the slug of its URL and an extension by content type, URL or first bytes."""
    slug = hashlib.sha1(url.encode()).hexdigest()[:12]
    kind = CONTENT_TYPES.get(content_type.split(";")[0].strip().lower(), "")
    ext = kind or (m[0] if (m := re.search(r"\.[a-z0-9]{1,6}$", url.split("?")[0].split("#")[0].split("://")[-1].lower())) else "")
    ext = ext or next((e for start, e in FIRST_BYTES if body.lstrip()[:9].lower().startswith(start)), ".bin")
    return slug + (".jsonl" if ext == ".json" and b"\n{" in body[:4096] else ext)


# Extensions by content type and by first bytes.
CONTENT_TYPES = {
    "text/html": ".html", "application/xhtml+xml": ".html", "application/json": ".json", "application/pdf": ".pdf", "text/csv": ".csv", "text/xml": ".xml", "application/xml": ".xml",
    "text/plain": ".txt", "application/zip": ".zip",
}
FIRST_BYTES = [(b"%pdf", ".pdf"), (b"pk", ".zip"), (b"<?xml", ".xml"), (b"<!doctype", ".html"), (b"<html", ".html"), (b"{", ".json"), (b"[", ".json")]


def fetch_and_keep(urls: DataFrame, fetch: Callable[[str], tuple[int, dict, bytes]], root: str, url: str = "url", policy: RetryPolicy | None = None) -> DataFrame:
    """(url, status, saved_as, from_cache, _error): every distinct URL fetched once and kept below a folder that all executors share.

    A URL that is kept already is not fetched again; error pages are kept too. The index beside a page names its URL, so two URLs of one slug don't get each other's page.
    """
    policy = policy or RetryPolicy()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for u in pdf["url"]:
                index = os.path.join(root, "index", hashlib.sha256(u.encode()).hexdigest() + ".json")
                held = read_bytes(index)
                if held:
                    known = json.loads(held)
                    out.append((u, known["status"], known["saved_as"], True, known["error"]))
                    continue
                try:
                    status, headers, body = policy.run(fetch, u)
                except Exception as e:  # noqa: BLE001 - one page must not end the job
                    out.append((u, None, None, False, f"{type(e).__name__}: {e}"))
                    continue
                # the short name as a rule, the long one where another URL has it
                name = cache_name(u, next((v for k, v in headers.items() if k.lower() == "content-type"), ""), body)
                if read_bytes(os.path.join(root, name)) is not None:
                    name = hashlib.sha256(u.encode()).hexdigest() + os.path.splitext(name)[1]
                write_bytes(os.path.join(root, name), body)
                error = f"status {status}" if status >= 400 else None
                write_bytes(index, json.dumps({"url": u, "status": status, "saved_as": name, "error": error}).encode())
                out.append((u, status, name, False, error))
            yield pd.DataFrame(out, columns=["url", "status", "saved_as", "from_cache", "_error"])

    distinct = urls.select(F.col(url).cast("string").alias("url")).where("url is not null").distinct()
    return distinct.mapInPandas(run, "url string, status int, saved_as string, from_cache boolean, _error string")


def html_source(source: str, root: str) -> str | None:
    """What a text stands for: markup itself, the kept page of a URL, or a file below ``root``, its cache or its items; None if there is nothing."""
    if "<" in source[:8] or "\n" in source:
        return source
    if re.match(r"https?://", source):
        index = read_bytes(os.path.join(root, "cache", "index", hashlib.sha256(source.encode()).hexdigest() + ".json"))
        data = read_bytes(os.path.join(root, "cache", json.loads(index)["saved_as"])) if index else None
    else:
        data = next((d for folder in ("", "cache", "items") if (d := read_bytes(confined(root, os.path.join(folder, source)))) is not None), None)
    return None if data is None else data.decode("utf-8", "replace")


def attachment_paths(files: DataFrame, item: str, order: str, extension: str) -> DataFrame:
    """Each file's place: items/item_NNNN/attachment_NN with its extension, items by number, attachments in order within the item."""
    n = F.row_number().over(Window.partitionBy(item).orderBy(order))
    return files.withColumn("saved_as", F.concat(F.lit("items/item_"), F.lpad(F.col(item).cast("string"), 4, "0"), F.lit("/attachment_"), F.lpad(n.cast("string"), 2, "0"), F.col(extension)))


def save_attachments(files: DataFrame, root: str, content: str = "content", text: str = "text") -> None:
    """Writes the files and their texts below a folder that all executors share; a file written twice is the same file."""

    def write(rows) -> None:
        for r in rows:
            path = os.path.join(root, r["saved_as"])
            write_bytes(path, bytes(r[content] or b""))
            write_bytes(os.path.splitext(path)[0] + ".txt", (r[text] or "").encode())

    files.select("saved_as", content, text).foreachPartition(write)
