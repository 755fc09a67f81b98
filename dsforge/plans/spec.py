"""Listing and detail specs: how pages are cut into rows, as data that compiles to columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dsforge.functions.text import TRANSFORMS, transform_text

# Other names of a field's keys, and keys that are accepted and have no effect.
ALIASES = {
    "pattern": "regex", "re": "regex", "regexp": "regex", "fallback": "fallback_regex", "fallback_pattern": "fallback_regex", "base": "prefix_base", "prefix": "prefix_base",
    "post": "transform", "clean": "transform", "many": "multi", "all": "multi", "multiple": "multi", "list": "multi", "capture": "group", "index": "group",
}
BENIGN = {"name", "type", "description", "required", "example", "notes", "comment"}
# Keys of a spec that are close to a valid one but would be misread.
TYPOS = {"row_regex": "row_pattern", "pattern": "row_pattern", "rows": "row_pattern", "row": "row_pattern", "columns": "fields", "field": "fields", "include": "include_substring", "exclude": "exclude_substring", "base": "base_url"}
_KEYS = {"row_pattern", "row_group", "include_substring", "exclude_substring", "base_url", "fields"}


class SpecError(ValueError):
    """A spec that can't be compiled."""


def java(pattern: str) -> str:
    """The pattern for Java's engine: dot matches line ends, Python's named groups renamed."""
    return "(?s)" + pattern.replace("(?P<", "(?<")


@dataclass(frozen=True)
class FieldSpec:
    regex: str
    group: int = 1
    fallback_regex: str | None = None
    prefix_base: bool = False
    transform: str | None = None
    multi: bool = False

    def column(self, block: Column, base_url: str | None) -> Column:
        """The field's value in a block; null without a match, an empty array if many are asked for."""
        if self.multi:
            out = None
            for p in (self.regex, self.fallback_regex):
                if p:
                    all_of = F.regexp_extract_all(block, F.lit(java(p)), F.lit(self._index(p)))
                    out = all_of if out is None else F.when(F.size(out) > 0, out).otherwise(all_of)
            return F.filter(F.transform(out, lambda x: self._post(x, base_url)), lambda y: y.isNotNull() & (y != ""))
        out = F.when(block.rlike(java(self.regex)), F.regexp_extract(block, java(self.regex), self._index(self.regex)))
        if self.fallback_regex:
            out = out.when(block.rlike(java(self.fallback_regex)), F.regexp_extract(block, java(self.fallback_regex), self._index(self.fallback_regex)))
        return self._post(out, base_url)

    def _index(self, pattern: str) -> int:
        return self.group if re.compile(pattern).groups >= self.group else 0

    def _post(self, c: Column, base_url: str | None) -> Column:
        if self.prefix_base and base_url:
            c = F.when(c.startswith("/"), F.concat(F.lit(base_url.rstrip("/")), c)).otherwise(c)
        return transform_text(c, self.transform)


@dataclass(frozen=True)
class Spec:
    fields: dict[str, FieldSpec]
    row_pattern: str | None = None
    row_group: int | None = None
    include_substring: str | None = None
    exclude_substring: str | None = None
    base_url: str | None = None
    notes: tuple[str, ...] = field(default=())

    @classmethod
    def normalise(cls, data: dict) -> Spec:
        """Checks a spec given as plain data: known typos are errors, other unknown keys are dropped with a note."""
        notes = []
        for k in data:
            if k in TYPOS and k not in _KEYS:
                raise SpecError(f"unknown key {k!r}; did you mean {TYPOS[k]!r}?")
            if k not in _KEYS:
                notes.append(f"dropped unknown key {k!r}")
        given = data.get("fields") or {}
        if isinstance(given, list):
            given = {f.get("name", ""): f for f in given}
        made = {}
        for name, conf in given.items():
            conf = {"regex": conf} if isinstance(conf, str) else dict(conf)
            if not name:
                raise SpecError("a field needs a name")
            if {"css", "xpath", "selector"} & set(conf):
                raise SpecError(f"{name}: selectors are not supported; give a regex")
            conf = {ALIASES.get(k, k): v for k, v in conf.items() if k not in BENIGN}
            extra = set(conf) - set(FieldSpec.__dataclass_fields__)
            notes += [f"{name}: dropped unknown key {k!r}" for k in sorted(extra)]
            if not conf.get("regex"):
                raise SpecError(f"{name}: a field needs a regex")
            if conf.get("transform") not in TRANSFORMS:
                raise SpecError(f"{name}: unknown transform {conf['transform']!r}")
            made[name] = FieldSpec(**{k: v for k, v in conf.items() if k not in extra})
        if not made:
            raise SpecError("a spec needs fields")
        for p in [data.get("row_pattern"), *[x for f in made.values() for x in (f.regex, f.fallback_regex)]]:
            try:
                re.compile(p or "")
            except re.error as e:
                raise SpecError(f"{p!r} is no pattern: {e}") from e
        return cls(made, *[data.get(k) for k in ("row_pattern", "row_group", "include_substring", "exclude_substring", "base_url")], tuple(notes))

    def _row_index(self) -> int:
        if self.row_group is not None:
            return self.row_group
        return 1 if re.compile(self.row_pattern).groups == 1 else 0

    def listing(self, pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
        """One row per block of every page: ``keep``, the block's place ``_pos`` and the fields. Blocks are filtered before any field is read."""
        blocks = pages.select(*keep, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(java(self.row_pattern)), F.lit(self._row_index()))).alias("_pos", "_block"))
        if self.include_substring:
            blocks = blocks.where(F.col("_block").contains(self.include_substring))
        if self.exclude_substring:
            blocks = blocks.where(~F.col("_block").contains(self.exclude_substring))
        return blocks.select(*keep, "_pos", *[f.column(F.col("_block"), self.base_url).alias(n) for n, f in self.fields.items()])

    def detail(self, pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
        """The whole page as one block."""
        return pages.select(*keep, *[f.column(F.col(html), self.base_url).alias(n) for n, f in self.fields.items()])

    def loose_class(self) -> Spec:
        """The same spec with every class attribute of several tokens matched in any order."""

        def loosen(m: re.Match) -> str:
            looks = "".join(rf"(?=[^\"]*\b{re.escape(t)}\b)" for t in m[1].split())
            return f'class="{looks}[^"]*"'

        return replace(self, row_pattern=re.sub(r'class="([^"\\\[\](){}*+?]+ [^"\\\[\](){}*+?]+)"', loosen, self.row_pattern or ""))

    def positional_cells(self) -> Spec:
        """Fields that each take the first table cell take the first, second, third ... cell instead."""
        cell = re.compile(r"^<td[^>]*>\(.*\)</td>$|^<td\[\^>\]\*>\(.*\)</td>$")
        same = [n for n, f in self.fields.items() if cell.match(f.regex)]
        if len(same) < 2:
            return self
        made = dict(self.fields)
        for k, n in enumerate(same):
            made[n] = replace(made[n], regex=r"(?:<td[^>]*>.*?</td>\s*){" + str(k) + "}" + made[n].regex)
        return replace(self, fields=made)


#: Listing templates by page pattern.
TEMPLATES = {
    "table": {"row_pattern": r"<tr[^>]*>(.*?)</tr>", "fields": {"title": {"regex": r"<td[^>]*>(.*?)</td>", "transform": "strip_html"}, "url": {"regex": r'href="([^"]+)"', "prefix_base": True}}},
    "wp_article": {"row_pattern": r"<article[^>]*>(.*?)</article>", "fields": {"title": {"regex": r"<h[1-3][^>]*>(.*?)</h[1-3]>", "transform": "strip_html"}, "url": {"regex": r'href="([^"]+)"', "prefix_base": True}}},
    "li_card": {"row_pattern": r"<li[^>]*>(.*?)</li>", "fields": {"title": {"regex": r"<a[^>]*>(.*?)</a>", "transform": "strip_html"}, "url": {"regex": r'href="([^"]+)"', "prefix_base": True}}},
    "drupal_views": {"row_pattern": r'<div class="[^"]*views-row[^"]*"[^>]*>(.*?)</div>', "fields": {"title": {"regex": r"<a[^>]*>(.*?)</a>", "transform": "strip_html"}, "url": {"regex": r'href="([^"]+)"', "prefix_base": True}}},
    "generic_div": {"row_pattern": r"<div[^>]*>(.*?)</div>", "fields": {"title": {"regex": r"<a[^>]*>(.*?)</a>", "transform": "strip_html"}, "url": {"regex": r'href="([^"]+)"', "prefix_base": True}}},
}
