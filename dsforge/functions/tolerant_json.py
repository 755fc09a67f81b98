"""JSON out of texts that hold it somewhere, or almost: fences, prose around it, trailing commas, single quotes, missing ends.

Parsing is tried on ever more repaired candidates; what can't be read is null, never an error. These are parsers, so they run in Arrow batches.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```[a-zA-Z]*\s*\n?(.*?)```", re.S)
_CALL = re.compile(r"<tool_call>(.*?)(?:</tool_call>|$)", re.S)
# Keys under which lists of rows are wrapped, and the names of a call's parts.
ENVELOPES = ["items", "rows", "data", "results", "list", "stories", "records", "entries", "objects"]
CALL_NAMES = ["tool", "name", "action"]
CALL_ARGS = ["args", "arguments", "input"]


def balanced(text: str) -> str | None:
    """The first object from its brace to the one that closes it; braces inside texts don't count. Without an end, all from the brace on."""
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return text[start:]


def candidates(text: str) -> Iterator[str]:
    yield from (m.strip() for m in _CALL.findall(text))
    yield from (m.strip() for m in _FENCE.findall(text))
    if block := balanced(text):
        yield block
    yield text.strip()


def without_trailing_commas(text: str) -> str:
    return re.sub(r",\s*([}\]])", r"\1", text)


def with_valid_escapes(text: str) -> str:
    return re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", text)


def closed(text: str) -> str:
    """The text with its open quote, brackets and braces closed."""
    stack, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    return re.sub(r"[,:]\s*$", "", text + ('"' if quoted else "")) + "".join(reversed(stack))


_STRING = re.compile(r"""("(?:\\.|[^"\\])*")|'((?:\\.|[^'\\])*)'|\b(True|False|None)\b""", re.S)
# Python's words for JSON's.
_WORDS = {"True": "true", "False": "false", "None": "null"}


def double_quoted(text: str) -> str:
    """Strings in single quotes as JSON strings and Python's words as JSON's, wherever they stand outside other strings."""

    def swap(m: re.Match) -> str:
        if m[1]:
            return m[1]
        return _WORDS[m[3]] if m[3] else '"' + re.sub(r'(?<!\\)"', r'\"', m[2].replace("\\'", "'")) + '"'

    return _STRING.sub(swap, text)


def loads(text: str):
    """The value of a text that is JSON after some repair, else None."""
    for repair in (str, without_trailing_commas, with_valid_escapes, lambda x: without_trailing_commas(with_valid_escapes(x))):
        try:
            return json.loads(repair(text))
        except ValueError:
            pass
    for repair in (double_quoted, lambda x: without_trailing_commas(with_valid_escapes(double_quoted(x)))):
        try:
            return json.loads(repair(text))
        except ValueError:
            pass
    try:
        value = ast.literal_eval(text)
        if isinstance(value, (dict, list)):
            return value
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        pass
    try:
        return json.loads(without_trailing_commas(closed(text)))
    except ValueError:
        pass
    try:
        return json.loads(without_trailing_commas(closed(double_quoted(text))))
    except ValueError:
        return None


def parse_object(text: str | None) -> dict | None:
    """The first object in a text."""
    for c in candidates(text or ""):
        value = loads(c)
        if isinstance(value, dict):
            return value
    return None


def parse_rows(text: str | None) -> list[dict]:
    """The rows in a text: a list of objects, an envelope around one, or a single object."""

    def read(value) -> list[dict] | None:
        if isinstance(value, list):
            return [x for x in value if isinstance(x, dict)]
        if isinstance(value, dict):
            for k in ENVELOPES:
                if isinstance(value.get(k), list):
                    return [x for x in value[k] if isinstance(x, dict)]
            return [value] if value and not any(k in value for k in ENVELOPES) else None
        return None

    for c in ((text or "").strip(), *candidates(text or "")):
        rows = read(loads(c))
        if rows is not None:
            return rows
    return []


def parse_call(text: str | None) -> tuple[str | None, dict | None, str | None]:
    """(tool, arguments, error) of a text that asks for a tool."""
    truncated = False
    for c in candidates(text or ""):
        value = loads(c)
        if isinstance(value, dict):
            name = next((value[k] for k in CALL_NAMES if isinstance(value.get(k), str)), None)
            args = next((value[k] for k in CALL_ARGS if k in value), {})
            if isinstance(args, str):
                args = loads(args) or {}
            if name:
                return name, args if isinstance(args, dict) else {}, None
        truncated = truncated or c.count("{") > c.count("}")
    return None, None, "truncated call" if truncated else "no tool call"


@F.pandas_udf(T.StringType())
def json_object(s: pd.Series) -> pd.Series:
    """The first object of a text as plain JSON, null if there is none."""
    return s.map(lambda x: None if (v := parse_object(x)) is None else json.dumps(v, ensure_ascii=False, sort_keys=True), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_rows(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [json.dumps(v, ensure_ascii=False, sort_keys=True) for v in parse_rows(x)])


@F.pandas_udf(T.StructType([T.StructField("tool", T.StringType()), T.StructField("args", T.StringType()), T.StructField("error", T.StringType())]))
def tool_call(s: pd.Series) -> pd.DataFrame:
    rows = [parse_call(x) for x in s]
    return pd.DataFrame([(t, None if a is None else json.dumps(a, ensure_ascii=False, sort_keys=True), e) for t, a, e in rows], columns=["tool", "args", "error"])
