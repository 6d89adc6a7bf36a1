"""Web pages to Markdown, and Markdown to pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DROPPED = {"script", "style", "head", "title", "noscript", "template"}
BREAKS = {"p", "div", "article", "section", "nav", "footer", "header", "main", "table", "ul", "ol", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "code": "`"}


class Walker(HTMLParser):
    """Writes Markdown while the parser goes over a page. Marks are closed where
    a block ends, so tags that were never closed do no harm."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = self.pre = 0
        self.lists: list[list] = []
        self.open: list[str] = []
        self.href: list[str] = []
        self.row: list[str] | None = None
        self.rows = 0
        self.quotes: list[int] = []  # where the open ones begin

    def put(self, s: str) -> None:
        if self.row is not None:
            self.row[-1] += s.replace("|", "\\|").replace("\n", " ")
        else:
            self.out.append(s)

    def close_marks(self) -> None:
        while self.open:
            self.put(MARKS[self.open.pop()])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in DROPPED:
            self.skip += 1
        if self.skip:
            return
        if tag == "tr":
            self.end_row()
        if tag in BREAKS and self.row is None and not (self.lists and tag in ("ul", "ol")):
            self.close_marks()
            self.out.append("\n\n")
        if tag[0] == "h" and tag[1:].isdigit():
            self.put("#" * int(tag[1:]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            self.close_marks()
            of = self.lists[-1] if self.lists else ["ul", 0]
            of[1] += 1
            self.put("\n" + "  " * max(0, len(self.lists) - 1) + ("- " if of[0] == "ul" else f"{of[1]}. "))
        elif tag == "pre":
            self.pre += 1
            self.put("```" + (re.findall(r"(?:^|\s)lang(?:uage)?-(\S+)", a.get("class") or "") or [""])[0] + "\n")
        elif tag in MARKS and not self.pre:
            self.open.append(tag)
            self.put(MARKS[tag])
        elif tag == "a":
            self.href.append(a.get("href") or "")
            self.put("[" if self.href[-1] else "")
        elif tag == "img":
            self.put(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "br":
            self.put("\n")
        elif tag == "hr":
            self.put("\n\n---\n\n")
        elif tag == "blockquote" and self.row is None:
            self.quotes.append(len(self.out))
        elif tag == "table":
            self.rows = 0
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append("")

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in MARKS and tag in self.open:
            while self.open:
                top = self.open.pop()
                self.put(MARKS[top])
                if top == tag:
                    break
        elif tag == "a" and self.href:
            to = self.href.pop()
            self.put(f"]({to})" if to else "")
        elif tag == "blockquote" and self.quotes and self.row is None:
            self.end_quote()
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.put("\n```")
        elif tag in ("tr", "table"):
            self.end_row()
        if tag in BREAKS and self.row is None and not (self.lists and tag in ("ul", "ol")):
            self.close_marks()
            self.out.append("\n\n")

    def end_quote(self) -> None:
        """Every line of a quote has the mark, and quotes in it have theirs."""
        self.end_row()
        self.close_marks()
        at = self.quotes.pop()
        inner = tidy("".join(self.out[at:]))
        self.out[at:] = ["\n".join(f"> {x}".rstrip() for x in inner.split("\n"))] if inner else []

    def end_row(self) -> None:
        if self.row is not None:
            self.close_marks()
            row, self.row, self.rows = self.row, None, self.rows + 1
            self.out.append("\n| " + " | ".join(c.strip() for c in row) + " |")
            if self.rows == 1:
                self.out.append("\n|" + " --- |" * len(row))

    def handle_data(self, data: str) -> None:
        if not self.skip and (self.row is None or self.row):
            self.put(data if self.pre else re.sub(r"\s+", " ", data))


def page_markdown(page: str) -> str:
    w = Walker()
    w.feed(page or "")
    w.close()
    while w.quotes:
        w.end_quote()
    w.close_marks()
    return tidy("".join(w.out))


def tidy(text: str) -> str:
    """Text without spaces around line ends and more than one blank line."""
    text = re.sub(r"[ \t]+\n", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]+(?![-\d ])", "\n", text)).strip()


def html_to_markdown(page: Column) -> Column:
    @F.pandas_udf("string")
    def convert(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else page_markdown(t))

    return convert(page)


def inline_html(text: Column) -> Column:
    """A line's text with its marks as tags, signs of markup escaped."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    for pattern, to in ((r"!\[([^\]]*)\]\(([^)]*)\)", '<img alt="$1" src="$2">'), (r"\[([^\]]*)\]\(([^)]*)\)", '<a href="$2">$1</a>'), (r"\*\*\*(.+?)\*\*\*", "<strong><em>$1</em></strong>"), (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"\*(.+?)\*", "<em>$1</em>"), (r"~~(.+?)~~", "<del>$1</del>"), (r"&lt;u&gt;(.+?)&lt;/u&gt;", "<u>$1</u>"), (r"`(.+?)`", "<code>$1</code>")):
        text = F.regexp_replace(text, pattern, to)
    return text


def line_html(kind: Column, level: Column, line: Column) -> Column:
    """A classified line as HTML; what a run of items, rows, code or quotes stands
    in is put around by html_islands(), as row_html() makes table rows."""
    bare = inline_html(F.regexp_replace(line, r"^\s*(#{1,6}\s+|[-*+•] |\d+[.)] |> ?)", ""))
    tag = F.concat(F.lit("h"), level.cast("string"))
    escaped = line
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return (
        F.when(kind == "heading", F.concat(F.lit("<"), tag, F.lit(">"), bare, F.lit("</"), tag, F.lit(">")))
        .when(kind.isin("bullet", "number"), F.concat(F.when(level > 1, F.concat(F.lit('<li style="margin-left: '), ((level - 1) * 2).cast("string"), F.lit('em">'))).otherwise("<li>"), bare, F.lit("</li>")))
        .when(kind == "quote", bare)
        .when(kind == "rule", "<hr>")
        .when(kind == "code", escaped)
        .otherwise(F.concat(F.lit("<p>"), inline_html(line), F.lit("</p>")))
    )


def row_html(cells: Column, head: Column) -> Column:
    """A table row; the cells of the first one are headings."""
    tag = F.when(head, "th").otherwise("td")
    return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<"), tag, F.lit(">"), inline_html(c), F.lit("</"), tag, F.lit(">"))), ""), F.lit("</tr>"))
