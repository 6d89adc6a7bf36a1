"""Image tokens in Markdown and HTML, and links to assets."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOKEN = "array<struct<start:int,end:int,raw:string,src:string,alt:string,width:string,height:string,align:string,is_html:boolean>>"
_ALIGNED = re.compile(r"<p\b([^>]*)>\s*<img\b([^>]*)>\s*</p>", re.I)
_TAG = re.compile(r"<img\b([^>]*)>", re.I)
_MARK = re.compile(r"!\[([^\]]*)\]\((?:<([^>]*)>|((?:[^()\s]|\s(?!\")|\((?:[^()]|\([^()]*\))*\))*))(?:\s+\"[^\"]*\")?\)")
_ATTR = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


def attributes(s: str) -> dict[str, str]:
    return {m[1].lower(): next(x for x in (*m.groups()[1:], "") if x is not None) for m in _ATTR.finditer(s)}


def tokens_of(text: str) -> list[dict]:
    """Images in order; what stands inside one found before isn't another one."""
    out: list[dict] = []
    for pattern in (_ALIGNED, _TAG, _MARK):
        for m in pattern.finditer(text):
            if any(t["start"] <= m.start() and m.end() <= t["end"] for t in out):
                continue
            if pattern is _MARK:
                t = {"src": (m[2] if m[2] is not None else m[3] or "").strip(), "alt": m[1], "width": "", "height": "", "align": "", "is_html": False}
            else:
                a = attributes(m[m.lastindex])
                outer = attributes(m[1]) if pattern is _ALIGNED else a
                align = outer.get("align") or next(iter(re.findall(r"text-align:\s*(\w+)", outer.get("style", ""))), "")
                t = {"src": a.get("src", ""), "alt": a.get("alt", ""), "width": a.get("width", ""), "height": a.get("height", ""), "align": align, "is_html": True}
            out.append({"start": m.start(), "end": m.end(), "raw": m[0], **t})
    return sorted(out, key=lambda t: t["start"])


def image_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, token_no and the token's fields. Only texts with a sign of an image
    go through Python."""

    @F.arrow_udf(TOKEN)
    def found(x: pa.Array) -> pa.Array:
        fields = [("start", pa.int32()), ("end", pa.int32()), *((n, pa.string()) for n in ("raw", "src", "alt", "width", "height", "align")), ("is_html", pa.bool_())]
        return pa.array([tokens_of(t or "") for t in x.to_pylist()], pa.list_(pa.struct(fields)))

    maybe = docs.where(F.col(text_col).contains("![") | F.col(text_col).rlike("(?i)<img"))
    return maybe.select(F.col(id_col).alias("doc_id"), F.posexplode(found(text_col)).alias("token_no", "t")).select("doc_id", "token_no", "t.*")


def token_at(tokens: DataFrame, first: int, last: int) -> DataFrame:
    """Of each document the first token that the selection touches."""
    hit = tokens.where((F.col("start") <= last) & (F.lit(first) <= F.col("end")))
    return hit.groupBy("doc_id").agg(F.min_by("token_no", "start").alias("token_no"))


def relinked(docs: DataFrame, tokens: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the sources of images replaced: targets (src, path). Only the source
    itself changes, not an alternative text that is like it. Texts are put together
    from the stretches between tokens, each read once."""
    head = F.when(F.col("is_html"), F.regexp_extract("raw", r"(?is)^(.*?\ssrc\s*=\s*[\"']?)", 1)).otherwise(F.regexp_extract("raw", r"(?s)^(!\[[^\]]*\]\(\s*<?)", 1))
    made = F.concat("_head", "path", F.substr(F.col("raw"), F.length("_head") + F.length("src") + 1))
    new = tokens.join(targets, "src").withColumn("_head", head).select("doc_id", "start", "end", "src", "path", made.alias("raw"))
    by = W.partitionBy("doc_id").orderBy("start")
    x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(new, "doc_id")
    x = x.withColumn("from", F.coalesce(F.lag("end").over(by), F.lit(0)))
    x = x.withColumn("part", F.concat(F.substring(F.col("text"), F.col("from") + 1, F.col("start") - F.col("from")), "raw"))
    made = x.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda p: p.part), "").alias("_head"), F.max("end").alias("_end"))
    out = docs.join(made.withColumnRenamed("doc_id", "_d"), docs[id_col] == F.col("_d"), "left")
    return out.withColumn(text_col, F.when(F.col("_end").isNull(), F.col(text_col)).otherwise(F.concat("_head", F.substring(F.col(text_col), F.col("_end") + 1, F.lit(1 << 30))))).select(*docs.columns)


def diagrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mermaid blocks: doc_id, block_no, code, the name of the picture made of it
    and the payload for a renderer."""
    code = F.regexp_extract_all(text_col, F.lit(r"(?s)```mermaid[ \t]*\n(.*?)\n[ \t]*```"), 1)
    x = docs.where(F.col(text_col).contains("```mermaid")).select(F.col(id_col).alias("doc_id"), F.posexplode(code).alias("block_no", "code"))
    return x.withColumns({"name": F.concat(F.lit("mermaid_"), F.substring(F.md5(F.col("code").cast("binary")), 1, 12), F.lit(".png")), "payload": F.base64(F.to_json(F.struct("code")).cast("binary"))})
