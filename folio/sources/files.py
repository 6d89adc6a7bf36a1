"""Reading files of every format into documents, and writing documents back.

A file is one row (path, content); what can't be read becomes a row with an
error. Only the columns that a step needs are read: checks take the first bytes.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.html import page_markdown
from folio.functions.inline import segments_of
from folio.functions.tree import to_markdown, yaml_value

#: Limits of one entry of an archive and of all of them against bombs.
ENTRY_BYTES, RATIO = 1 << 28, 200
NOTE = "{http://schemas.openxmlformats.org/%s}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SHEET, WORD, DRAW, SLIDE = (NOTE % f"{x}/2006/main" for x in ("spreadsheetml", "wordprocessingml", "drawingml", "presentationml"))


def files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, length, content of all files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder).select("path", "length", "content")


def heads(found: DataFrame) -> DataFrame:
    """What the checks need of files."""
    return found.select("path", "length", F.substring("content", 1, 4096).alias("head"))


def _table(rows: list[list[str]]) -> str:
    width = max(map(len, rows))
    clean = [[c.replace("\r\n", " ").replace("\n", " ").replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
    head, *body = ["| " + " | ".join(r) + " |" for r in clean]
    return "\n".join([head, "|" + " --- |" * width, *body])


def csv_markdown(raw: bytes) -> str:
    """A comma-separated file as a table; short rows are filled, long ones kept."""
    rows = list(csv.reader(io.StringIO(raw.decode("utf-8-sig", "replace"))))
    return _table(rows) if rows else "*(Empty Table)*"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return max(0, n - 1)


def opened(raw: bytes) -> zipfile.ZipFile:
    """A packed document, unless its members are far larger than it gives reason for."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    sizes = [i.file_size for i in z.infolist()]
    if max(sizes, default=0) > ENTRY_BYTES or sum(sizes) > RATIO * max(len(raw), 1 << 16):
        raise ValueError("the members are too large")
    return z


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """What a part's relations lead to, by their ids: addresses, and members by their whole name."""
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    out = {}
    for r in ElementTree.fromstring(z.read(rels)) if rels in z.namelist() else ():
        to = r.get("Target") or ""
        inside = to.lstrip("/") if to.startswith("/") else posixpath.normpath(f"{folder}/{to}")
        out[r.get("Id")] = to if r.get("TargetMode") == "External" else inside
    return out


def _parts(z: zipfile.ZipFile, part: str, tag: str, name: str) -> Iterator[tuple[str, str]]:
    """(name, member) of the parts that a part lists, in its order."""
    to = _targets(z, part)
    for x in ElementTree.fromstring(z.read(part)).iter(tag):
        member = to.get(x.get(f"{RELATION}id"))
        if member in z.namelist():
            yield x.get(name), member


def sheets(raw: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of the cells of a workbook, values as stored."""
    with opened(raw) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        for name, part in _parts(z, "xl/workbook.xml", f"{SHEET}sheet", "name"):
            for r, row in enumerate(ElementTree.fromstring(z.read(part)).iter(f"{SHEET}row")):
                for k, c in enumerate(row.iter(f"{SHEET}c")):
                    kind, v = c.get("t"), c.find(f"{SHEET}v")
                    text = "".join(t.text or "" for t in c.iter(f"{SHEET}t")) if kind == "inlineStr" else "" if v is None else v.text or ""
                    if kind == "s" and text:
                        text = strings[int(text)]
                    at = c.get("r")
                    yield name, int(re.sub(r"\D", "", at)) - 1 if at else r, _column(at) if at else k, {"1": "True", "0": "False"}.get(text, text) if kind == "b" else text


def xlsx_markdown(raw: bytes) -> str:
    out: dict[str, list[list[str]]] = {}
    for name, r, c, text in sheets(raw):
        rows = out.setdefault(name, [])
        rows.extend([] for _ in range(r + 1 - len(rows)))
        rows[r].extend("" for _ in range(c + 1 - len(rows[r])))
        rows[r][c] = text
    parts = []
    for name, rows in out.items():
        while rows and not any(rows[-1]):
            rows.pop()
        parts.append(f"## {name}\n\n{_table(rows) if rows else '*(Empty Sheet)*'}")
    return "\n\n".join(parts)


#: Faces in which code is set.
CODE_FACES = ("courier new", "courier", "consolas", "monospace")


def marked(text: str, marks: list[str]) -> str:
    """A text in its marks, white space at its ends left outside."""
    inner = text.strip()
    if not inner:
        return text
    left, right = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    for mark in marks:
        inner = f"<u>{inner}</u>" if mark == "<u>" else f"{mark}{inner}{mark}"
    return left + inner + right


def _run(r: ElementTree.Element, to: dict[str, str]) -> str:
    text = "".join((t.text or "") if t.tag == f"{WORD}t" else "\n" for t in r if t.tag in (f"{WORD}t", f"{WORD}br"))
    style, marks = r.find(f"{WORD}rPr"), []
    if style is not None:
        face, name = style.find(f"{WORD}rFonts"), style.find(f"{WORD}rStyle")
        for tag, mark in (("b", "**"), ("i", "*"), ("strike", "~~"), ("u", "<u>")):
            x = style.find(f"{WORD}{tag}")
            if x is not None and x.get(f"{WORD}val") not in ("0", "false", "none"):
                marks.append(mark)
        if (face is not None and (face.get(f"{WORD}ascii") or "").lower() in CODE_FACES) or (name is not None and "code" in (name.get(f"{WORD}val") or "").lower()):
            marks.append("`")
    for x in r.iter(f"{DRAW}blip"):
        src = to.get(x.get(f"{RELATION}embed") or x.get(f"{RELATION}link"), "")
        size = next((e.get("cx") for e in r.iter() if e.tag.endswith("}extent")), None)
        alt = next((e.get("descr") or "" for e in r.iter() if e.tag.endswith("}docPr")), "") or "image"
        text += f'<img src="{src}" alt="{alt}" width="{round(int(size) / 9525)}">' if size else f"![{alt}]({src})"
    return marked(text, marks)


def _runs(p: ElementTree.Element, to: dict[str, str]) -> str:
    """The runs of a paragraph, those in a link as one."""
    out = []
    for x in p:
        if x.tag == f"{WORD}r":
            out.append(_run(x, to))
        elif x.tag in (f"{WORD}hyperlink", f"{WORD}fldSimple"):
            text = "".join(_run(r, to) for r in x.iter(f"{WORD}r"))
            at = re.search(r'HYPERLINK\s+"([^"]*)"', x.get(f"{WORD}instr") or "")
            url = at[1] if at else to.get(x.get(f"{RELATION}id"), "")
            text = re.sub(r"^<u>(.*)</u>$", r"\1", text)
            out.append(f"[{text}]({url})" if url and text.strip() else text)
        elif x.tag in (f"{WORD}ins", f"{WORD}smartTag", f"{WORD}sdt", f"{WORD}sdtContent"):
            out.append(_runs(x, to))
    return "".join(out)


def docx_markdown(raw: bytes) -> str:
    """Paragraphs (headings, lists by level, styles, links, pictures, code) and
    tables of a document in their order."""
    with opened(raw) as z:
        body, to = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body"), _targets(z, "word/document.xml")
    out: list[str] = []
    code: list[str] | None = None
    for x in body if body is not None else ():
        style = next((s.get(f"{WORD}val") or "" for s in x.iter(f"{WORD}pStyle")), "").lower() if x.tag == f"{WORD}p" else ""
        if style in ("code", "sourcecode", "htmlpreformatted"):
            code = [*(code or []), "".join(t.text or "" for t in x.iter(f"{WORD}t"))]
            continue
        if code is not None:
            out, code = [*out, "```", *code, "```", ""], None
        if x.tag == f"{WORD}tbl":
            rows = [["<br>".join(_runs(p, to) for p in c.iter(f"{WORD}p")) for c in r.findall(f"{WORD}tc")] for r in x.findall(f"{WORD}tr")]
            out += [_table(rows), ""] if rows else []
        elif x.tag == f"{WORD}p":
            text = _runs(x, to)
            level = re.fullmatch(r"(?:heading|title)\s*(\d?)", style)
            depth = x.find(f"{WORD}pPr/{WORD}numPr/{WORD}ilvl")
            deep = int(depth.get(f"{WORD}val") or 0) if depth is not None else int((re.search(r"\d$", style) or ["1"])[0]) - 1
            listed = x.find(f"{WORD}pPr/{WORD}numPr") is not None or style.startswith("list")
            if x.find(f"{WORD}pPr/{WORD}pBdr/{WORD}bottom") is not None and not text.strip():
                out += ["---", ""]
            elif text.strip():
                out.append(f"{'#' * int(level[1] or 1)} {text}" if level else f"{'  ' * deep}{'1.' if 'number' in style else '-'} {text}" if listed else text)
                out += [] if listed else [""]
    return "\n".join([*out, *(["```", *code, "```"] if code is not None else [])]).strip()


def _shape_lines(x: ElementTree.Element) -> list[str]:
    """A shape's text: a title as heading, other paragraphs as bullets by level,
    numbered where they are."""
    if x.tag == f"{SLIDE}graphicFrame":
        rows = [["".join(t.text or "" for t in c.iter(f"{DRAW}t")) for c in r.findall(f"{DRAW}tc")] for t in x.iter(f"{DRAW}tbl") for r in t.findall(f"{DRAW}tr")]
        return ["", _table(rows)] if rows else []
    out, title = [], any((p.get("type") or "").lower().endswith("title") for p in x.iter(f"{SLIDE}ph"))
    for p in x.iter(f"{DRAW}p"):
        own = p.find(f"{DRAW}pPr")
        text, level = "".join(t.text or "" for t in p.iter(f"{DRAW}t")), int((own.get("lvl") if own is not None else 0) or 0)
        if text.strip():
            numbered = own is not None and own.find(f"{DRAW}buAutoNum") is not None
            out.append(f"## {text}\n" if title else f"{'  ' * level}{'1.' if numbered else '-'} {text}")
    return out


def _top(x: ElementTree.Element) -> int:
    """Where a shape begins; those without a place come first."""
    off = next(x.iter(f"{DRAW}off"), None)
    return int(off.get("y") or 0) if off is not None else 0


def pptx_markdown(raw: bytes) -> str:
    """Slides in their order, divided by rules: shapes by their top (those of a group
    in its place), titles as headings, other text as bullets, tables, pictures, notes."""
    slides = []
    with opened(raw) as z:
        for _, name in _parts(z, "ppt/presentation.xml", f"{SLIDE}sldId", "id"):
            to, lines = _targets(z, name), []
            tree = ElementTree.fromstring(z.read(name)).find(f"{SLIDE}cSld/{SLIDE}spTree")
            for top in sorted(tree if tree is not None else (), key=_top):
                for x in top.iter():
                    if x.tag in (f"{SLIDE}sp", f"{SLIDE}graphicFrame"):
                        lines += _shape_lines(x)
                    elif x.tag == f"{SLIDE}pic":
                        lines += [f"![image]({to[b.get(f'{RELATION}embed')]})" for b in x.iter(f"{DRAW}blip") if b.get(f"{RELATION}embed") in to]
            for note in (t for t in to.values() if "/notesSlides/" in t and t in z.namelist()):
                said = [x for s in ElementTree.fromstring(z.read(note)).iter(f"{SLIDE}sp") if any(p.get("type") == "body" for p in s.iter(f"{SLIDE}ph")) for x in ("".join(t.text or "" for t in p.iter(f"{DRAW}t")) for p in s.iter(f"{DRAW}p")) if x.strip()]
                lines += ["", "### Notes:", *said] if said else []
            slides.append("\n".join(lines).strip())
    return "\n\n---\n\n".join(slides)


def json_markdown(raw: bytes) -> str:
    import json

    return to_markdown(json.loads(raw.decode("utf-8-sig")))


def yaml_markdown(raw: bytes) -> str:
    import json

    return to_markdown(json.loads(json.dumps(yaml_value(raw.decode("utf-8-sig")), default=str)))


READERS: dict[str, Callable[[bytes], str]] = {
    ".csv": csv_markdown,
    ".xlsx": xlsx_markdown,
    ".docx": docx_markdown,
    ".pptx": pptx_markdown,
    ".html": lambda raw: page_markdown(raw.decode("utf-8", "replace")),
    ".htm": lambda raw: page_markdown(raw.decode("utf-8", "replace")),
    ".json": json_markdown,
    ".yaml": yaml_markdown,
    ".yml": yaml_markdown,
    ".md": lambda raw: raw.decode("utf-8-sig", "replace"),
}


def imported(found: DataFrame, keep: Iterable[str] = ("copy",)) -> DataFrame:
    """path, text, error of each file (path, content), with the columns to keep, if
    they are there, as they are. A file that can't be read doesn't stop the others, and
    one with a problem, or whose whole column says that it needn't be, isn't read.
    Files are spread by their bytes by Spark's reader."""
    more = [c for c in keep if c in found.columns]
    given = [F.col(c) if c in found.columns else F.lit(None).cast(k).alias(c) for c, k in (("problem", "string"), ("whole", "boolean"))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for path, raw, problem, whole in zip(x.path, x.content, x.problem, x.whole, strict=True):
                ext = re.search(r"(\.[^./]*)?$", path)[0].lower()
                try:
                    out.append((path, None, problem) if problem or whole else (path, READERS[ext](bytes(raw)), None))
                except KeyError:
                    out.append((path, None, f"no reader for {ext or 'files without an extension'}"))
                except Exception as e:  # noqa: BLE001 - any defect of a file is its row's error
                    out.append((path, None, f"{type(e).__name__}: {e}"[:500]))
            made = pd.DataFrame(out, columns=["path", "text", "error"])
            yield made.assign(**{c: x[c].to_numpy() for c in more})

    return found.select("path", "content", *given, *more).mapInPandas(run, ", ".join(["path string, text string, error string", *(f"{c} {found.schema[c].dataType.simpleString()}" for c in more)]))


def workbook_cells(found: DataFrame) -> DataFrame:
    """path, sheet, row_no, col_no, cell of workbooks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for path, raw in zip(x.path, x.content, strict=True):
                yield pd.DataFrame([(path, *c) for c in sheets(bytes(raw))], columns=["path", "sheet", "row_no", "col_no", "cell"])

    return found.select("path", "content").mapInPandas(run, "path string, sheet string, row_no int, col_no int, cell string")


def entries(archives: DataFrame) -> DataFrame:
    """archive, path, length, content, error of the files in zip and tar archives.
    Entries with a path that leads outside, or that are far larger than the
    archive gives reason for, come with an error and without content."""

    def members(raw: bytes) -> Iterator[tuple[str, int, Callable[[], bytes]]]:
        if zipfile.is_zipfile(io.BytesIO(raw)):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield i.filename, i.file_size, lambda i=i: z.read(i)
        else:
            with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                for m in t:
                    if m.isfile():
                        yield m.name, m.size, lambda m=m: t.extractfile(m).read()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for archive, raw in zip(x.path, x.content, strict=True):
                out, total = [], 0
                try:
                    for path, size, read in members(bytes(raw)):
                        total += size
                        bad = "path" if path.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", path) or ":" in path else "size" if size > ENTRY_BYTES or total > RATIO * max(len(raw), 1 << 16) else None
                        out.append((archive, path, size, None if bad else read(), bad))
                except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError) as e:
                    out.append((archive, None, 0, None, f"{type(e).__name__}: {e}"[:500]))
                yield pd.DataFrame(out, columns=["archive", "path", "length", "content", "error"])

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, length long, content binary, error string")


def workbook(rows: list[list[str]], title: str = "Sheet1") -> bytes:
    """A workbook of one sheet of text cells, the first row bold."""
    from xml.sax.saxutils import escape, quoteattr

    cell = lambda c, style: f'<c t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(c)}</t></is></c>'
    body = "".join(f"<row>{''.join(cell(c, int(not k)) for c in r)}</row>" for k, r in enumerate(rows))
    ns, rel = SHEET.strip("{}"), "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name={quoteattr(re.sub(r"[][*?:/]", "_", title)[:31])} sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{ns}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>',
    }
    return _zipped(parts)


def csv_bytes(rows: list[list[str]]) -> bytes:
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    return out.getvalue().encode("utf-8-sig")


def _styled_runs(text: str) -> str:
    """A line's segments as runs with their styles, those with an address as links."""
    from xml.sax.saxutils import escape, quoteattr

    out = []
    for x in segments_of(text):
        tags = [t for k, t in (("bold", "<w:b/>"), ("italic", "<w:i/>"), ("strike", "<w:strike/>"), ("underline", '<w:u w:val="single"/>'), ("code", '<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>')) if x[k]]
        run = f'<w:r>{f"<w:rPr>{chr(32).join(tags)}</w:rPr>" if tags else ""}<w:t xml:space="preserve">{escape(x["text"])}</w:t></w:r>'
        link = quoteattr('HYPERLINK "' + (x["url"] or "").replace('"', "%22") + '"')
        out.append(f"<w:fldSimple w:instr={link}>{run}</w:fldSimple>" if x["url"] and not x["is_image"] else run)
    return "".join(out)


def document(blocks: list[tuple[int, str, int, list[str]]]) -> bytes:
    """A word-processor document of blocks (line number, kind, level, cells or the
    one text). Table rows that follow each other, with nothing but separators
    between them, are one table. Blank lines and fences only part others."""
    from xml.sax.saxutils import escape

    def paragraph(kind: str, level: int, text: str) -> str:
        style = {"heading": f"Heading{level}", "bullet": "ListBullet" + (str(level) if level > 1 else ""), "number": "ListNumber" + (str(level) if level > 1 else ""), "code": "Code", "quote": "Quote"}.get(kind)
        if kind == "rule":
            return '<w:p><w:pPr><w:pBdr><w:bottom w:val="single"/></w:pBdr></w:pPr></w:p>'
        runs = f'<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r>' if kind == "code" else _styled_runs(text)
        return f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}{runs}</w:p>'

    body, rows = [], []
    for at, kind, level, cells in [*blocks, (None, "", 0, [])]:
        if rows and kind not in ("table", "separator"):
            width = max(map(len, rows))
            body.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p>{_styled_runs(c)}</w:p></w:tc>" for c in [*r, *[""] * (width - len(r))]) + "</w:tr>" for r in rows) + "</w:tbl>")
            rows = []
        if kind == "table":
            rows = [*rows, cells]
        elif kind not in ("", "blank", "fence", "separator"):
            body.append(paragraph(kind, level, cells[0]))
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{WORD.strip("{}")}"><w:body>{"".join(body)}</w:body></w:document>',
    }
    return _zipped(parts)


def presentation(lines: list[tuple[int, int, str, int, list[str]]]) -> bytes:
    """Slides of lines (slide, page, kind, level, cells or the one text). A slide's
    first heading is its title, which its further pages carry on with "(Cont.)";
    other lines are bullets by level, table rows a table whose first row comes again
    on each page, and what stands below a heading of notes the slide's notes."""
    from xml.sax.saxutils import escape

    ns = f'xmlns:a="{DRAW.strip("{}")}" xmlns:p="{SLIDE.strip("{}")}" xmlns:r="{RELATION.strip("{}")}"'
    inch, rel, kinds = 914_400, "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "application/vnd.openxmlformats-officedocument.presentationml."
    plain = lambda t: "".join(s["text"] for s in segments_of(t))
    run = lambda t: "".join(f'<a:r><a:rPr lang="en"{"".join(f" {k}={v}" for k, v, on in (("b", chr(34) + "1" + chr(34), s["bold"]), ("i", chr(34) + "1" + chr(34), s["italic"])) if on)}/><a:t>{escape(s["text"])}</a:t></a:r>' for s in segments_of(t))
    frame = lambda tag, y, h: f'<{tag}><a:off x="{inch // 2}" y="{round(y * inch)}"/><a:ext cx="{11 * inch}" cy="{round(h * inch)}"/></{tag}>'
    empty = f'<p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
    pages: dict[tuple[int, int], dict] = {}
    titles: dict[int, str] = {}
    heads: dict[int, list[str]] = {}
    noting: dict[int, bool] = {}
    for slide, page, kind, level, cells in lines:
        of = pages.setdefault((slide, page), {"text": [], "rows": [], "notes": []})
        if kind == "heading" and re.match(r"(?i)notes:", cells[0]):
            noting[slide] = True
        elif noting.get(slide):
            pages[slide, 1]["notes"] += [plain(cells[0])] if kind != "blank" else []
        elif kind == "heading" and slide not in titles:
            titles[slide] = plain(cells[0])
        elif kind == "table":
            if not of["rows"] and slide in heads:
                of["rows"].append(heads[slide])
            heads.setdefault(slide, cells)
            of["rows"].append(cells)
        elif kind not in ("blank", "fence", "separator", "rule"):
            of["text"].append((max(0, level - 1) if kind in ("bullet", "number") else 0, cells[0], kind))
    parts, shown = {}, [k for k in sorted(pages) if pages[k]["text"] or pages[k]["rows"] or pages[k]["notes"] or k[1] == 1 and k[0] in titles]
    for n, (slide, page) in enumerate(shown, 1):
        of, y = pages[slide, page], 1.5
        title = titles.get(slide, "") + (" (Cont.)" if page > 1 and slide in titles else "")
        shapes = [f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="Title"/><p:cNvSpPr/><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:spPr>{frame("a:xfrm", 0.4, 0.9)}</p:spPr><p:txBody><a:bodyPr/><a:p>{run(title)}</a:p></p:txBody></p:sp>'] if title else []
        if of["text"]:
            number = '<a:buAutoNum type="arabicPeriod"/>'
            body = "".join(f'<a:p><a:pPr lvl="{level}">{number if kind == "number" else ""}</a:pPr>{run(t)}</a:p>' for level, t, kind in of["text"])
            shapes.append(f'<p:sp><p:nvSpPr><p:cNvPr id="3" name="Text"/><p:cNvSpPr/><p:nvPr><p:ph idx="1"/></p:nvPr></p:nvSpPr><p:spPr>{frame("a:xfrm", y, 0.45 * len(of["text"]))}</p:spPr><p:txBody><a:bodyPr/>{body}</p:txBody></p:sp>')
            y += 0.45 * len(of["text"])
        if of["rows"]:
            width = max(map(len, of["rows"]))
            rows = "".join(f'<a:tr h="{inch * 2 // 5}">' + "".join(f"<a:tc><a:txBody><a:bodyPr/><a:p>{run(c)}</a:p></a:txBody><a:tcPr/></a:tc>" for c in [*r, *[""] * (width - len(r))]) + "</a:tr>" for r in of["rows"])
            grid = "".join(f'<a:gridCol w="{11 * inch // width}"/>' for _ in range(width))
            shapes.append(f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="4" name="Table"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr>{frame("p:xfrm", y, 0.4 * len(of["rows"]))}<a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/table"><a:tbl><a:tblPr firstRow="1"/><a:tblGrid>{grid}</a:tblGrid>{rows}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>')
        parts[f"ppt/slides/slide{n}.xml"] = f"<p:sld {ns}><p:cSld>{empty}{''.join(shapes)}</p:spTree></p:cSld></p:sld>"
        note = f'<Relationship Id="r2" Type="{rel}/notesSlide" Target="../notesSlides/notesSlide{n}.xml"/>' if of["notes"] else ""
        parts[f"ppt/slides/_rels/slide{n}.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/slideLayout" Target="../slideLayouts/slideLayout1.xml"/>{note}</Relationships>'
        if of["notes"]:
            said = "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in of["notes"])
            parts[f"ppt/notesSlides/notesSlide{n}.xml"] = f'<p:notes {ns}><p:cSld>{empty}<p:sp><p:nvSpPr><p:cNvPr id="2" name="Notes"/><p:cNvSpPr/><p:nvPr><p:ph type="body" idx="1"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>{said}</p:txBody></p:sp></p:spTree></p:cSld></p:notes>'
            parts[f"ppt/notesSlides/_rels/notesSlide{n}.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/slide" Target="../slides/slide{n}.xml"/></Relationships>'
    ids = range(1, len(shown) + 1)
    parts |= {
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="m1"/></p:sldMasterIdLst><p:sldIdLst>{"".join(f"""<p:sldId id="{255 + n}" r:id="s{n}"/>""" for n in ids)}</p:sldIdLst><p:sldSz cx="{12 * inch}" cy="{7 * inch}"/><p:notesSz cx="{7 * inch}" cy="{9 * inch}"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="m1" Type="{rel}/slideMaster" Target="slideMasters/slideMaster1.xml"/>{"".join(f"""<Relationship Id="s{n}" Type="{rel}/slide" Target="slides/slide{n}.xml"/>""" for n in ids)}</Relationships>',
        "ppt/slideMasters/slideMaster1.xml": f'<p:sldMaster {ns}><p:cSld>{empty}</p:spTree></p:cSld><p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="r1"/></p:sldLayoutIdLst></p:sldMaster>',
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/slideLayout" Target="../slideLayouts/slideLayout1.xml"/></Relationships>',
        "ppt/slideLayouts/slideLayout1.xml": f"<p:sldLayout {ns}><p:cSld>{empty}</p:spTree></p:cSld></p:sldLayout>",
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/slideMaster" Target="../slideMasters/slideMaster1.xml"/></Relationships>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="ppt/presentation.xml"/></Relationships>',
    }
    of_part = {"slides": "slide", "notesSlides": "notesSlide", "slideMasters": "slideMaster", "slideLayouts": "slideLayout"}
    overrides = "".join(f'<Override PartName="/{x}" ContentType="{kinds}{"presentation.main" if x == "ppt/presentation.xml" else of_part[x.split("/")[1]]}+xml"/>' for x in parts if x.endswith(".xml"))
    types = f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{overrides}</Types>'
    return _zipped({"[Content_Types].xml": types} | parts)


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}', zipfile.ZIP_DEFLATED)
    return out.getvalue()
