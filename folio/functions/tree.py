"""Nested data to Markdown and back: small recursive helpers for Arrow functions."""

from __future__ import annotations

import contextlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = re.compile(r"-?\d+$")
_DECIMAL = re.compile(r"-?\d+\.\d+$")
#: Of YAML: tabs, tags and comments right after a block's sign, which the two parsers take otherwise.
_ODD_YAML = re.compile(r"[\t!]|[|>][-+0-9]*#")
#: Of JSON: keys that are empty or long, which the two writers put otherwise.
_ODD_KEY = re.compile(r'"((\\.|[^"\\]){100,})?": ')
_SEPARATOR = re.compile(r"[|\s:-]+$")


def scalar_text(x: object) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x).replace("\\", "\\\\").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")


def scalar_value(s: str) -> object:
    """A scalar from its text; what looks like a date or an address stays text."""
    low = s.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "none", "~"):
        return None
    if _NUMBER.match(s):
        return int(s)
    if _DECIMAL.match(s):
        return float(s)
    if s[:1] + s[-1:] in ("[]", "{}"):
        try:
            return json.loads(s)
        except ValueError:
            pass
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), s)


def _cell(x: object) -> str:
    s = "" if x is None else json.dumps(x, ensure_ascii=False) if isinstance(x, dict | list) else scalar_text(x)
    return s.replace("|", "\\|")


def to_markdown(x: object, depth: int = 1) -> str:
    """A tree as Markdown: first what is flat as bullets, then what is nested under
    headings; records of flat values are tables."""
    out: list[str] = []
    if isinstance(x, dict):
        flat = {k: v for k, v in x.items() if not isinstance(v, dict | list)}
        out += [f"- **{k}**: {scalar_text(v)}" for k, v in flat.items()]
        for k, v in x.items():
            if k not in flat:
                out += ["", f"{'#' * min(depth, 6)} {k}", "", to_markdown(v, depth + 1) if v else f"*(Empty {'Object' if isinstance(v, dict) else 'List'})*"]
    elif isinstance(x, list) and x and all(isinstance(r, dict) for r in x):
        keys = list(dict.fromkeys(k for r in x for k in r))
        out += ["| " + " | ".join(map(str, keys)) + " |", "|" + " --- |" * len(keys)]
        out += ["| " + " | ".join(_cell(r.get(k)) for k in keys) + " |" for r in x]
    elif isinstance(x, list):
        out += [f"- {json.dumps(v, ensure_ascii=False) if isinstance(v, dict | list) else scalar_text(v)}" for v in x]
    else:
        out.append(scalar_text(x))
    return "\n".join(out).strip("\n")


def _cells(line: str) -> list[str]:
    parts = re.split(r"(?<!\\)\|", line.strip())
    return [p.strip().replace("\\|", "|") for p in parts[1 if not parts[0].strip() else 0 : -1 if not parts[-1].strip() else None]]


def from_markdown(text: str) -> object:
    """The tree of a text as to_markdown writes it: fenced JSON as it is; else
    headings open objects by their level, bullets with a bold name set values,
    others append, tables are records, other lines go on with the last value."""
    fence = re.search(r"```(?:json)?\s*\n(.*?)\n\s*```", text, re.S)
    for raw in ([fence[1]] if fence else []) + [text]:
        try:
            return json.loads(raw)
        except ValueError:
            pass
    root: dict = {}
    # (level, the object that a heading opened, its name, what was put under it)
    stack: list[tuple[int, dict]] = [(0, root)]
    items: list | None = None
    name, last, header = None, None, None
    for line in text.split("\n"):
        s = line.strip()
        if "|" in s and s.startswith("|"):
            if _SEPARATOR.match(s):
                continue
            if header is None:
                header, items = _cells(s), []
                _put(stack, name, items)
            else:
                items.append({k: scalar_value(v) if v else None for k, v in zip(header, _cells(s), strict=False)})
            continue
        header = None
        if not s:
            continue
        if m := re.match(r"(#{1,6})\s+(.*)", s):
            level, name = len(m[1]), m[2].strip("* ")
            while stack[-1][0] >= level:
                stack.pop()
            inner: dict = {}
            stack[-1][1][name] = inner
            stack.append((level, inner))
            items = last = None
        elif m := re.match(r"[-*] \*\*(.+?)\*\*:\s*(.*)", s):
            stack[-1][1][m[1]] = scalar_value(m[2])
            last = (stack[-1][1], m[1])
        elif m := re.match(r"[-*] (.*)", s):
            if not isinstance(items, list):
                items = []
                _put(stack, name, items)
            items.append(scalar_value(m[1]))
            last = (items, len(items) - 1)
        elif re.match(r"\*\(Empty (Object|List)\)\*", s):
            if "List" in s:
                _put(stack, name, [])
        elif last:
            last[0][last[1]] = f"{last[0][last[1]]}\n{s}"
    return root[""] if set(root) == {""} else root


def _put(stack: list, name: str | None, value: list) -> None:
    """A list takes the place of the object that its heading opened."""
    if len(stack) > 1 and not stack[-1][1] and stack[-2][1].get(name) is stack[-1][1]:
        stack[-2][1][name] = value
    else:
        stack[-1][1]["" if len(stack) == 1 and not stack[-1][1] else "_items"] = value


def json_to_markdown(text: Column) -> Column:
    """JSON texts as Markdown; null where it can't be read."""

    @F.pandas_udf("string")
    def convert(x: pd.Series) -> pd.Series:
        return x.map(lambda t: to_markdown(json.loads(t)))

    return F.when(F.try_parse_json(text).isNotNull(), convert(F.when(F.try_parse_json(text).isNotNull(), text).otherwise("null")))


def markdown_to_json(text: Column) -> Column:
    @F.pandas_udf("string")
    def convert(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else json.dumps(from_markdown(t), ensure_ascii=False))

    return convert(text)


def yaml_value(text: str) -> object:
    """A YAML text's value, by the library's compiled parser; the plain one reads
    what that refuses or has rules of its own for, or says what is wrong."""
    import yaml

    if text.isascii() and not _ODD_YAML.search(text):
        with contextlib.suppress(yaml.YAMLError, AttributeError):
            return yaml.load(text, yaml.CSafeLoader)
    return yaml.safe_load(text)


def yaml_text(value: object) -> str:
    """A tree as YAML, by the compiled writer where it writes what the plain one does."""
    import yaml

    whole = json.dumps(value, ensure_ascii=False)
    plain = isinstance(value, dict | list) and whole.isascii() and not _ODD_KEY.search(whole)
    return yaml.dump(value, Dumper=getattr(yaml, "CSafeDumper", yaml.SafeDumper) if plain else yaml.SafeDumper, sort_keys=False, allow_unicode=True)


def yaml_to_markdown(text: Column) -> Column:
    """YAML texts as Markdown; null where it can't be read."""

    @F.pandas_udf("string")
    def convert(x: pd.Series) -> pd.Series:
        import yaml

        def one(t: str | None) -> str | None:
            try:
                return None if t is None else to_markdown(json.loads(json.dumps(yaml_value(t), default=str)))
            except yaml.YAMLError:
                return None

        return x.map(one)

    return convert(text)


def markdown_to_yaml(text: Column) -> Column:
    @F.pandas_udf("string")
    def convert(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else yaml_text(from_markdown(t)))

    return convert(text)
