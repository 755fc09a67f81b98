"""Text out of files of many kinds, over a binary column; archives go into depth. Optional libraries missing give an error text, never a failed job."""

from __future__ import annotations

import csv
import gzip
import io
import json
import re
import tarfile
import tomllib
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsforge.functions.text import html_text

# Kinds of file by extension.
KINDS = {
    ".pdf": "pdf", ".docx": "docx", ".pptx": "pptx", ".xlsx": "xlsx", ".xls": "xlsx", ".odt": "odt", ".rtf": "rtf", ".epub": "epub", ".html": "html", ".htm": "html", ".xhtml": "html", ".xml": "xml", ".svg": "xml",
    ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".tsv": "tsv", ".toml": "toml", ".yaml": "yaml", ".yml": "yaml", ".zip": "zip", ".tar": "tar",
}
MAX_DEPTH = 8


def decode(data: bytes) -> str:
    """UTF-8, else UTF-16 where a byte order mark says so, else Latin-1, which always succeeds."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        pass
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        try:
            return data.decode("utf-16")
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def sniff(data: bytes) -> str:
    head = data[:512].lstrip().lower()
    for start, kind in ((b"%pdf", "pdf"), (b"pk\x03\x04", "zip"), (b"<?xml", "xml"), (b"<svg", "xml"), (b"<!doctype html", "html"), (b"<html", "html"), (b"{", "json"), (b"[", "json")):
        if head.startswith(start):
            return kind
    return "gz" if data[:2] == b"\x1f\x8b" else "plain"


def kind_of(path: str, data: bytes) -> str:
    low = path.lower()
    for ends, kind in (((".tar.gz", ".tgz", ".tar.bz2"), "tar"), ((".gz",), "gz")):
        if low.endswith(ends):
            return kind
    m = re.search(r"\.[a-z0-9]+$", low)
    return KINDS.get(m[0] if m else "", "") or sniff(data)


def _markup(text: str) -> str:
    text = re.sub(r"<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>", " ", text, flags=re.S)
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text)).strip()


def _table(text: str, separator: str) -> str:
    return "\n".join("\t".join(r) for r in csv.reader(io.StringIO(text), delimiter=separator))


def _zipped(data: bytes, pattern: str) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n\n".join(_markup(decode(z.read(n))) for n in sorted(z.namelist()) if re.search(pattern, n))


def _library(kind: str, data: bytes) -> str:
    if kind == "pdf":
        from pypdf import PdfReader

        return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)
    if kind == "xlsx":
        from openpyxl import load_workbook

        out = []
        for sheet in load_workbook(io.BytesIO(data), read_only=True, data_only=True):
            out.append(f"# {sheet.title}")
            out += ["\t".join("" if c is None else str(c) for c in r) for r in sheet.iter_rows(values_only=True)]
        return "\n".join(out)
    if kind == "yaml":
        import yaml

        return json.dumps(yaml.safe_load(decode(data)), ensure_ascii=False, indent=2, default=str)
    raise ValueError(kind)


def extract_text(path: str, data: bytes, depth: int = 0) -> str:
    """The text of one file; a file that can't be read gives a text that begins with ERROR:."""
    if depth > MAX_DEPTH:
        return "ERROR: archives too deep"
    kind = kind_of(path, data)
    try:
        if kind == "html":
            return html_text(decode(data))
        if kind == "xml":
            return _markup(decode(data))
        if kind == "json":
            return json.dumps(json.loads(decode(data)), ensure_ascii=False, indent=2)
        if kind == "jsonl":
            lines = [x for x in decode(data).splitlines() if x.strip()]
            return "\n".join(json.dumps(json.loads(x), ensure_ascii=False) for x in lines)
        if kind in ("csv", "tsv"):
            return _table(decode(data), "\t" if kind == "tsv" else ",")
        if kind == "toml":
            return json.dumps(tomllib.loads(decode(data)), ensure_ascii=False, indent=2, default=str)
        if kind == "docx":
            return _zipped(data, r"^word/document\.xml$")
        if kind == "pptx":
            return _zipped(data, r"^ppt/slides/slide\d+\.xml$")
        if kind == "odt":
            return _zipped(data, r"^content\.xml$")
        if kind == "epub":
            return _zipped(data, r"\.x?html?$")
        if kind == "rtf":
            return re.sub(r"\s+", " ", re.sub(r"\\'[0-9a-f]{2}|\\[a-z]+-?\d* ?|[{}]", " ", decode(data))).strip()
        if kind == "gz":
            inner = re.sub(r"\.gz$", "", path, flags=re.I)
            return extract_text(inner, gzip.decompress(data), depth + 1)
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return "".join(f"\n=== {n} ===\n{extract_text(n, z.read(n), depth + 1)}" for n in z.namelist() if not n.endswith("/"))
        if kind == "tar":
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                return "".join(f"\n=== {m.name} ===\n{extract_text(m.name, t.extractfile(m).read(), depth + 1)}" for m in t.getmembers() if m.isfile())
        if kind in ("pdf", "xlsx", "yaml"):
            return _library(kind, data)
        return decode(data)
    except ImportError as e:
        return f"ERROR: {kind} needs a library that is not installed: {e.name}"
    except Exception as e:  # noqa: BLE001 - one bad file must not end the job
        return f"ERROR: {type(e).__name__}: {e}"


def with_text(files: DataFrame, path: str = "path", content: str = "content", max_chars: int | None = None) -> DataFrame:
    """(path, kind, text, error) of files with a binary column."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            texts = [None if d is None else extract_text(p or "", bytes(d)) for p, d in zip(pdf["_p"], pdf["_c"])]
            kinds = [None if d is None else kind_of(p or "", bytes(d)) for p, d in zip(pdf["_p"], pdf["_c"])]
            yield pd.DataFrame({"path": pdf["_p"], "kind": kinds, "text": [None if t is None or t.startswith("ERROR:") else t[:max_chars] for t in texts], "error": [t if t and t.startswith("ERROR:") else None for t in texts]})

    return files.select(F.col(path).alias("_p"), F.col(content).cast("binary").alias("_c")).mapInPandas(run, "path string, kind string, text string, error string")
