"""Page texts, joined tables and ruled tables by plain loops, to hold the operators against."""

import re

END = re.compile(r"[.!?…;~”\"’»)\]}]$")
CONTINUES = re.compile(r"[,–—/&、，-]\s*$")


def caps(t):
    return t.upper() == t and t.lower() != t


def lines_of(glyphs):
    """Glyphs to lines, greedily from the top; glyphs are dicts."""
    size = lambda top, bottom: bottom - top
    found = []
    for g in sorted(glyphs, key=lambda g: ((g["top"] + g["bottom"]) / 2, g["x0"], g["glyph_no"])):
        s, m = size(g["top"], g["bottom"]), (g["top"] + g["bottom"]) / 2
        for line in found:
            a, b = min(x["top"] for x in line), max(x["bottom"] for x in line)
            if min(g["bottom"], b) - max(g["top"], a) >= 0.35 * min(s, b - a) or abs(m - (a + b) / 2) <= 0.4 * max(s, b - a):
                line.append(g)
                break
        else:
            found.append([g])
    return found


def text_of(part):
    """(text, level) of a stretch of a line, or None."""
    part = sorted(part, key=lambda g: (g["x0"], (g["top"] + g["bottom"]) / 2, g["glyph_no"]))
    runs = []
    for before, g in zip([None, *part], part, strict=False):
        style = (bool(g["bold"]), bool(g["italic"]))
        if not runs or runs[-1][0] != style:
            runs.append([style, g["text"]])
        else:
            wide = g["x0"] - before["x1"] > (g["x1"] - g["x0"]) * 0.25 and not before["text"].endswith(" ") and g["text"] != " "
            runs[-1][1] += " " * wide + g["text"]
    out = ""
    for (bold, italic), t in runs:
        mark = "***" if bold and italic else "**" if bold else "*" if italic else ""
        s = t.strip()
        out += t if not s else t[: len(t) - len(t.lstrip())] + mark + s + mark + t[len(t.rstrip()) :]
    out = out.strip()
    if out in ("", "-", "•", "·", "⁃", "▪"):
        return None
    for _ in range(3):
        out = re.sub(r"\*\*(.*?)\*\*([^\s*]{1,3})\*\*(.*?)\*\*", r"**\1\2\3**", out)
        out = re.sub(r"\*\*(.*?)\*\*\s*\*\*(.*?)\*\*", r"**\1 \2**", out)
    bullet = re.match(r"[•·⁃▪]|[-*]\s", out)
    if bullet:
        out = re.sub(r"\s+[•·⁃▪]\s+", "\n- ", re.sub(r"^\*\s+", "- ", re.sub(r"^[•·⁃▪]\s*", "- ", out)))
    level, mean = 0, sum(g["size"] for g in part) / len(part)
    if not bullet and not out.startswith("- ") and not re.fullmatch(r"\s*(\*{0,2}\d{1,3}\*{0,2}|p\.\s*\d+)\s*", out, re.I) and (out[0].isupper() or caps(out)):
        n = len(out.split())
        level = 1 if mean >= 22 and n <= 7 else 3 if 13.5 <= mean < 17 and caps(out) and n <= 5 else 0
    return (re.sub(r"\*{2,3}", "", out) if level else out), level


def joined(items):
    out = []
    for t, level in items:
        if not t.strip():
            continue
        if out:
            p, v = out[-1]
            ends = bool(END.search(p.strip()))
            if t[0].islower() or v > 0 and level == v and not ends:
                out[-1] = (f"{p} {t}", v)
                continue
            plain = v == 0 == level and not p.startswith(("- ", "**")) and not t.startswith("- ")
            if plain and (CONTINUES.search(p.strip()) or len(p.split()) >= 5 and not ends):
                out[-1] = (f"{p} {t}", 0)
                continue
        out.append((t, level))
    return out


def marked(items):
    return ["#" * v + " " + t if v else t for t, v in items]


def head_first(texts):
    texts = [t.strip() for t in texts if t.strip()]
    alone = re.compile(r"\*{0,2}(\d{1,3})\*{0,2}")
    number = next((m[1] for t in texts if (m := alone.fullmatch(t))), None)
    banner = title = None
    rest = []
    for t in texts:
        m = alone.fullmatch(t)
        if m and m[1] == number:
            continue
        if t.startswith("### ") and not banner and not title and not rest and caps(t[4:].strip()) and len(t[4:].split()) <= 4:
            banner = t
        elif t.startswith("# ") and not title and len(rest) <= 2:
            title = t
        else:
            rest.append(t)
    return [x for x in (banner, number and f"**{number}**", title) if x] + rest


def sections(items):
    out, h, body = [], None, []
    for t, v in items:
        if v > 0 or caps(t) and len(t.split()) <= 4:
            if h or body:
                out.append((h or "", "<br><br>".join(body)))
            h, body = t, []
        else:
            body.append(t)
    return out + ([(h or "", "<br><br>".join(body))] if h or body else [])


def compared(left, right):
    if not left or not right or any(s[0][0].startswith("- ") or len(s[0][0].split()) > 5 for s in (left, right)):
        return None
    a, b = sections(left), sections(right)
    if len(a) != len(b) or not (a[0][0] and a[0][1] and b[0][0] and b[0][1]):
        return None
    rows = [f"| {a[0][0]} | {b[0][0]} |", "| --- | --- |", f"| {a[0][1]} | {b[0][1]} |"]
    for (h, x), (g, y) in zip(a[1:], b[1:], strict=True):
        rows += [f"| **{h}** | **{g}** |"] * bool(h or g) + [f"| {x} | {y} |"] * bool(x or y)
    return "\n".join(rows)


def drawn(texts, rate):
    w = " ".join(texts).split()
    if not w:
        return False
    mean = sum(map(len, w)) / len(w)
    return sum(len(x) <= 2 for x in w) / len(w) > rate and mean < 3.8 or len(w) <= 3 and mean <= 3


def page_text(glyphs, width=595.0):
    """(layout, text) of a page's glyphs."""
    glyphs = [g for g in glyphs if g["top"] >= 0 and g["x0"] >= 0]
    found = []
    for k, line in enumerate(lines_of(glyphs)):
        line = sorted(line, key=lambda g: (g["x0"], (g["top"] + g["bottom"]) / 2, g["glyph_no"]))
        segs = [[line[0]]]
        for a, b in zip(line, line[1:], strict=False):
            if b["x0"] - a["x1"] >= 20:
                segs.append([b])
            else:
                segs[-1].append(b)
        found.append((min(g["top"] for g in line), k, segs))
    found.sort(key=lambda x: x[:2])
    page_top, cols = found[0][0], max(len(s) for _, _, s in found)
    streams = {k: [] for k in range(max(cols, 2) + 1)}
    for top, _, segs in found:
        lo, hi = min(g["x0"] for g in sum(segs, [])), max(g["x1"] for g in sum(segs, []))
        first = len(segs) == 1 and (top < page_top + 60 or hi - lo > 300 and lo < 250 and hi > 550)
        for k, s in enumerate(segs):
            mid = (min(g["x0"] for g in s) + max(g["x1"] for g in s)) / 2
            if first:
                to = 0
            elif cols >= 3:
                to = k + 1 if len(segs) == cols else min(cols - 1, max(0, int(mid / width * cols))) + 1
            else:
                to = min(k + 1, 2) if len(segs) > 1 else 1 if mid < 420 else 2
            streams[to].append(s)
    texts = {k: [x for s in of if (x := text_of(s))] for k, of in streams.items()}
    if cols >= 3:
        if drawn([t for k in texts if k >= 2 for t, _ in texts[k]], 0.35):
            return "drawing", "\n\n".join(head_first(marked(joined(texts[0]) + joined(texts[1]))))
        of = [joined(texts[k]) for k in range(1, cols + 1)]
        line = lambda cells: "| " + " | ".join(cells) + " |"
        table = "\n".join([line([o[0][0] if o else "" for o in of]), line(["---"] * cols), line(["<br>".join(t for t, _ in o[1:]) for o in of])])
        return "grid", "\n\n".join([*head_first(marked(joined(texts[0]))), table])
    if cols > 1 or streams[1] and streams[2]:
        if (table := compared(texts[1], texts[2])) is not None:
            return "comparison", "\n\n".join([*head_first(marked(texts[0])), table])
        noise = drawn([t for t, _ in texts[2]], 0.4)
        return "drawing" if noise else "columns", "\n\n".join(head_first(marked(joined(texts[0]) + joined(texts[1]) + ([] if noise else joined(texts[2])))))
    alone = [x for _, _, s in found if (x := text_of(s[0]))]
    return "text", "\n\n".join(head_first(marked(joined(alone))))


def joined_tables(elements, columns, rows):
    """Tables of one document over page breaks, as (table_no, cells) in order.

    elements: (elem_no, type, n_chars, n_cols) in order; columns and rows by elem_no."""
    out, before, chars, broke = [], None, 0, False
    for no, kind, n_chars, n_cols in elements:
        if kind == "text":
            chars += n_chars
        elif kind == "page_break":
            broke = True
        elif kind != "table":
            chars += 9999
        else:
            mine = [list(r) for r in rows.get(no, [])]
            if before is not None and broke and chars < 150 and before["n"] == n_cols:
                mapped = []
                for r in mine:
                    new = [""] * len(before["cols"])
                    for (x0, x1), cell in zip(columns[no], r, strict=False):
                        best, most = -1, -1
                        for k, (a, b) in enumerate(before["cols"]):
                            if min(x1, b) - max(x0, a) > most:
                                best, most = k, min(x1, b) - max(x0, a)
                        if best != -1 and most > 0:
                            new[best] = (cell or "").strip()
                    mapped.append(new)
                if mapped and before["rows"] and goes_on(before["rows"][-1], mapped[0]):
                    last = before["rows"][-1]
                    for k, c in enumerate(mapped.pop(0)):
                        last[k] = f"{last[k]} {c}" if last[k] and c else last[k] or c
                before["rows"] += mapped
                before["n"] = n_cols
            else:
                before = {"n": n_cols, "cols": columns[no], "rows": [[c or "" for c in r] for r in mine]}
                out.append(before)
            chars, broke = 0, False
    return [(k, r) for k, t in enumerate(out, 1) for r in t["rows"]]


def goes_on(last, first):
    if len(last) != len(first) or len(first) < 2 or first[0]:
        return False
    if any(not last[c] and first[c] for c in range(1, len(first))):
        return True
    return bool(last[-1] and first[-1] and last[-1].strip()[-1:] not in (".", "!", "?", ":"))


def ruled(strokes, near=3.0, least=3.0):
    """Cells (table, row, column, x0, top, x1, bottom) of a page's strokes, all against all."""
    lines = []
    for x0, y0, x1, y1 in strokes:
        x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
        if x1 - x0 > near and y1 - y0 > near:
            lines += [(True, y0, x0, x1), (True, y1, x0, x1), (False, x0, y0, y1), (False, x1, y0, y1)]
        else:
            lines.append((True, y0, x0, x1) if y1 - y0 <= x1 - x0 else (False, x0, y0, y1))
    found = []
    for flat in (True, False):
        clusters = []
        for line in sorted(x for x in lines if x[0] == flat):
            if clusters and line[1] <= clusters[-1][-1][1] + near:
                clusters[-1].append(line)
            else:
                clusters.append([line])
        for c in clusters:
            at, runs = sum(x[1] for x in c) / len(c), []
            for lo, hi in sorted((x[2], x[3]) for x in c):
                if runs and lo <= runs[-1][1] + near:
                    runs[-1][1] = max(runs[-1][1], hi)
                else:
                    runs.append([lo, hi])
            found += [(flat, at, lo, hi) for lo, hi in runs if hi - lo >= least]
    points = {}
    for i, (f, y, a, b) in enumerate(found):
        for j, (g, x, c, d) in enumerate(found):
            if f and not g and c <= y + near and d >= y - near and a - near <= x <= b + near:
                at = points.setdefault((x, y), (set(), set()))
                at[0].add(i)
                at[1].add(j)
    cells = []
    for x, y in points:
        options = [
            (low, far)
            for fx, low in points
            for far, fy in points
            if fx == x and low > y and fy == y and far > x and (far, low) in points
            and points[x, low][1] & points[x, y][1] and points[far, y][0] & points[x, y][0] and points[far, low][1] & points[far, y][1] and points[far, low][0] & points[x, low][0]
        ]
        if options:
            low, far = min(options)
            cells.append((x, y, far, low))
    tables = []
    for c in cells:
        corners = {(c[0], c[1]), (c[2], c[1]), (c[0], c[3]), (c[2], c[3])}
        meets = [t for t in tables if t[0] & corners]
        tables = [t for t in tables if t not in meets] + [(corners.union(*(t[0] for t in meets)), [c, *(x for t in meets for x in t[1])])]
    tables = sorted((t for _, t in tables if len(t) > 1), key=lambda t: min((c[1], c[0]) for c in t))
    out = []
    for k, t in enumerate(tables, 1):
        tops, lefts = sorted({c[1] for c in t}), sorted({c[0] for c in t})
        out += [(k, tops.index(c[1]) + 1, lefts.index(c[0]) + 1, c[0], c[1], c[2], c[3]) for c in t]
    return sorted(out)


def chosen(edits):
    """Edits (priority, start, end, new) that are made, each held against all before."""
    made = []
    for e in sorted(set(edits), key=lambda e: (e[0], e[1], e[2] > e[1], -e[2], e[3] is not None, e[3] or "")):
        if not any(m[1] < e[2] and e[1] < m[2] for m in made):
            made.append(e)
    return sorted(made, key=lambda e: (e[1], e[2], e[3] or ""))


def spliced(text, edits):
    for _, start, end, new in reversed(edits):
        text = text[:start] + (new or "") + text[end:]
    return text
