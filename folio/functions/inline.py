"""Inline Markdown as styled segments."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = ("bold", "italic", "strike", "underline", "code")
SEGMENT = "array<struct<text:string,bold:boolean,italic:boolean,strike:boolean,underline:boolean,code:boolean,url:string,is_image:boolean>>"
#: The grammar's patterns in the order in which they win where two begin at one place, with what they switch on.
MARKS: list[tuple[re.Pattern, tuple[str, ...]]] = [
    (re.compile(r"!\[([^\]]*?)\]\((.+?\.(?:png|jpg|jpeg|gif|svg|webp|bmp|ico)|https?://\S+|@media/\S+?|[^\n)]+)\)", re.IGNORECASE), ("image",)),
    (re.compile(r"\[([^\]]*?)\]\(([^)]*?)\)"), ("link",)),
    (re.compile(r"\*\*\*(.*?)\*\*\*"), ("bold", "italic")),
    (re.compile(r"___(.*?)___"), ("bold", "italic")),
    (re.compile(r"\*\*(.*?)\*\*"), ("bold",)),
    (re.compile(r"__(.*?)__"), ("bold",)),
    (re.compile(r"\*(.*?)\*"), ("italic",)),
    (re.compile(r"_(.*?)_"), ("italic",)),
    (re.compile(r"~~(.*?)~~"), ("strike",)),
    (re.compile(r"<u>(.*?)</u>", re.IGNORECASE), ("underline",)),
    (re.compile(r"`(.*?)`"), ("code",)),
]
#: A sign with which a mark begins.
SIGNS = r"[*_~`<\[]"


def segments_of(text: str) -> list[dict]:
    """Segments in order. What is still to be read stands on a stack, so any
    nesting will do: of each stretch the earliest mark is taken, and what is inside
    keeps the styles, the address and the kind around it. Empty stretches, such as
    an image without an alternative text, give no segment."""
    out, todo = [], [(text or "", frozenset(), None, False)]
    while todo:
        rest, on, url, image = todo.pop()
        found = [(m.start(), k, m) for k, (p, _) in enumerate(MARKS) if (m := p.search(rest))]
        if not found:
            if rest:
                out.append({"text": rest, **{s: s in on for s in STYLES}, "url": url, "is_image": image})
            continue
        _, k, m = min(found, key=lambda f: f[:2])
        kind = MARKS[k][1]
        inside = (m[1], on, url or m[2], image or kind[0] == "image") if kind[0] in ("image", "link") else (m[1], on | set(kind), url, image)
        todo += [(rest[m.end() :], on, url, image), inside, (rest[: m.start()], on, url, image)]
    return out


def segments(text: Column) -> Column:
    """The styled segments of each text; null for null."""

    @F.arrow_udf(SEGMENT)
    def parse(x: pa.Array) -> pa.Array:
        flag = [(s, pa.bool_()) for s in STYLES]
        kind = pa.list_(pa.struct([("text", pa.string()), *flag, ("url", pa.string()), ("is_image", pa.bool_())]))
        return pa.array([None if t is None else segments_of(t) for t in x.to_pylist()], kind)

    return parse(text)


def stripped(text: Column) -> Column:
    """Texts without marks. Python only gets those that have a mark's sign."""

    @F.pandas_udf("string")
    def strip(x: pd.Series) -> pd.Series:
        return x.map(lambda t: t if t is None else "".join(s["text"] for s in segments_of(t)))

    marked = text.rlike(SIGNS)
    return F.when(marked, strip(F.when(marked, text))).otherwise(text)
