"""The small driver-side parts of a run: its phase, its plan, its tools and its trace."""

from __future__ import annotations

import json
import math
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

# What a plan may say.
SOURCES = ("listing_html", "paginated_html", "api_json", "feed", "sitemap", "archive", "custom")
STRATEGIES = ("listing_only", "listing+detail", "listing+attachment", "listing+multi_asset", "api_only", "custom_python")


class PlanError(ValueError):
    pass


@dataclass
class Plan:
    item: str
    source: str
    harvest_strategy: str
    source_url: str | None = None
    items_per_page: int | None = None
    target_rows: int | None = None
    pages_needed: int | None = None
    fields: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    @classmethod
    def validated(cls, data: dict) -> Plan:
        """Checks keys and arithmetic; a number of pages that is missing or can't be right is put right."""
        missing = [k for k in ("item", "source", "harvest_strategy") if not data.get(k)]
        if missing:
            raise PlanError(f"missing: {', '.join(missing)}")
        data = {k: v for k, v in data.items() if k in cls.__dataclass_fields__}
        data["source"], data["harvest_strategy"] = data["source"].lower().strip(), data["harvest_strategy"].lower().strip()
        for key, allowed in (("source", SOURCES), ("harvest_strategy", STRATEGIES)):
            if data[key] not in allowed:
                raise PlanError(f"{key} {data[key]!r} is not one of {', '.join(allowed)}")
        plan = cls(**data)
        if plan.items_per_page and plan.target_rows:
            need = math.ceil(plan.target_rows / plan.items_per_page)
            if plan.pages_needed is None:
                plan.pages_needed = need
            elif not need - 1 <= plan.pages_needed <= 2 * need:
                plan.notes.append(f"pages_needed {plan.pages_needed} set to {need}")
                plan.pages_needed = need
        return plan

    def reconcile(self, book) -> bool:
        """Lowers an unlocked row contract to the plan's target; a locked one stays and is noted."""
        from dsforge.operators.contracts import min_rows

        held = book.contracts.get("min_rows")
        if held is None or self.target_rows is None:
            return False
        if held.locked:
            self.notes.append("min_rows is locked and was not lowered")
            return False
        book.contracts["min_rows"] = min_rows(self.target_rows)
        return True


PHASES = ("DISCOVER_LISTING", "DEFINE_EXTRACTOR", "ENUMERATE", "PROCESS", "CODEBOOK", "EXTRACT", "EXPORT", "FINISH")


@dataclass(frozen=True)
class RunState:
    """What the phase depends on, as numbers and flags."""

    n_rows: int = 0
    target: int = 0
    contracts_ok: bool = False
    has_page: bool = False
    has_extractor: bool = False
    n_queue: int = 0
    n_pending: int = 0
    wants_codebook: bool = False
    has_codebook: bool = False
    text_share: float = 1.0
    n_silver: int = 0
    stale_codebook: bool = False
    exported: bool = False
    recent_errors: int = 0
    was_extracting: bool = False


def needs_extraction(s: RunState) -> bool:
    return s.has_codebook and (s.n_silver == 0 or s.stale_codebook)


def current_phase(s: RunState, text_least: float = 0.8, soft: float = 0.8) -> str:
    """The phase of a run. Later phases hold once reached: a run that has extracted does not go back to harvesting."""
    if s.contracts_ok and s.n_rows and not needs_extraction(s) and not (s.wants_codebook and not s.has_codebook):
        return "FINISH"
    if s.was_extracting and s.n_silver:
        return "EXTRACT" if needs_extraction(s) else "FINISH" if s.exported else "EXPORT"
    enough = s.n_rows >= s.target > 0 or (s.target and s.n_rows >= soft * s.target and s.recent_errors >= 3)
    if enough:
        if s.wants_codebook and not s.has_codebook:
            return "CODEBOOK" if s.text_share >= text_least else "PROCESS"
        if needs_extraction(s):
            return "EXTRACT"
        return "FINISH" if s.exported else "EXPORT"
    if not s.has_page:
        return "DISCOVER_LISTING"
    if not s.has_extractor:
        return "DEFINE_EXTRACTOR"
    if not s.n_queue or (not s.n_pending and s.n_rows < s.target):
        return "ENUMERATE"
    return "PROCESS"


@dataclass
class Tool:
    name: str
    run: Callable
    args_schema: dict = field(default_factory=dict)
    max_output_chars: int = 8000
    readonly: bool = False


class Registry:
    """Tools by name: unknown names and exceptions become results, file references are resolved where asked for, long outputs are cut at a line end."""

    def __init__(self, root: str = ".", with_refs: set[str] = frozenset()):
        self.tools: dict[str, Tool] = {}
        self.root, self.with_refs = root, set(with_refs)

    def register(self, tool: Tool) -> None:
        self.tools[tool.name] = tool

    def run(self, name: str, **args) -> tuple[str, bool]:
        """(output, failed)."""
        from dsforge.sources.files import resolve_refs

        tool = self.tools.get(name)
        if tool is None:
            return f"unknown tool {name!r}; known: {', '.join(sorted(self.tools))}", True
        try:
            out = str(tool.run(**(resolve_refs(args, self.root) if name in self.with_refs else args)))
        except Exception as e:  # noqa: BLE001 - a failing tool is a result
            return f"{type(e).__name__}: {e}", True
        if len(out) > tool.max_output_chars:
            cut = out.rfind("\n", tool.max_output_chars - 200, tool.max_output_chars)
            out = out[: cut if cut > 0 else tool.max_output_chars] + f"\n[cut, {len(out)} characters]"
        return out, False


class Tracer:
    """Events as JSONL; errors of subscribers are swallowed."""

    def __init__(self, path: str):
        self.path, self.subscribers = path, []
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)

    def event(self, kind: str, **data) -> None:
        record = {"ts": time.time(), "event": kind, **data}
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(record, ensure_ascii=False, default=str) + "\n")
        for s in self.subscribers:
            try:
                s(record)
            except Exception:  # noqa: BLE001, S110 - a subscriber must not end a run
                pass


def log_failure(path: str, where: str, raw: str, **data) -> None:
    """Appends one failure with its raw answer cut to 2000 characters; never raises."""
    try:
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"ts": time.time(), "where": where, "raw": raw[:2000], **data}, ensure_ascii=False, default=str) + "\n")
    except OSError:
        pass


def chunk_budget(context: int, output: int) -> int:
    """Characters of a page that fit beside the prompt and the answer."""
    return min(80_000, max(8_000, (context - output - 3_000) * 4))


def snake_field(text: str) -> str:
    """A free description of a field as its column name: counts get n_, yes-no questions has_."""
    import re

    low = text.strip().lower()
    for lead, prefix in ((r"(?:number|count) of ", "n_"), (r"(?:any|whether(?: there is| it has)?(?: an?)?) ", "has_")):
        if re.match(lead, low):
            low = prefix + re.sub(f"^{lead}", "", low)
            break
    return re.sub(r"\W+", "_", low).strip("_")


def goal_hints(text: str) -> tuple[str | None, int | None]:
    """(URL, number of rows) that a goal in plain words names: its first URL, and its first number of two to four digits outside URLs."""
    import re

    url = re.search(r"https?://[^\s<>\"']+", text)
    count = re.search(r"(?<![\w.,/-])(\d{2,4})(?![\w.,/-]*\d)", re.sub(r"https?://\S+", " ", text))
    return (url[0].rstrip(".,;)") if url else None), (int(count[1]) if count else None)
