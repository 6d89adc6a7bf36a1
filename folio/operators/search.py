"""Search and replace in documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.operators.lines import lines, offsets


def pattern_of(query: str, regex: bool = False, case: bool = True) -> str:
    return ("" if case else "(?i)") + (query if regex else re.escape(query))


def hits(docs: DataFrame, query: str, regex: bool = False, case: bool = True, snippet: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hit_no, start, end, line_no and a snippet of each match within a
    line. Only documents with a match are cut into lines."""
    p = pattern_of(query, regex, case)
    rows = offsets(lines(docs.where(F.col(text_col).rlike(p)), id_col, text_col)).where(F.col("line").rlike(p))
    # the text between matches gives their places
    parts = F.split("line", p)
    found = F.regexp_extract_all("line", F.lit(p), 0)
    x = rows.select("doc_id", "line_no", "line", "start", parts.alias("parts"), F.posexplode(found).alias("k", "match"))
    before = F.aggregate(F.slice("parts", F.lit(1), F.col("k") + 1), F.lit(0), lambda a, s: a + F.length(s)) + F.aggregate(F.slice(F.regexp_extract_all("line", F.lit(p), 0), F.lit(1), F.col("k")), F.lit(0), lambda a, s: a + F.length(s))
    x = x.withColumn("at", F.col("start") + before)
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("at"))
    return x.select("doc_id", n.alias("hit_no"), F.col("at").alias("start"), (F.col("at") + F.length("match")).alias("end"), "line_no", F.substring(F.trim("line"), 1, snippet).alias("snippet"))


def neighbours(found: DataFrame) -> DataFrame:
    """Hits with the numbers of the next and the previous one, going round."""
    n = F.count("*").over(W.partitionBy("doc_id"))
    return found.withColumns({"next_no": F.col("hit_no") % n + 1, "prev_no": F.pmod(F.col("hit_no") - 2, n) + 1})


def replaced(docs: DataFrame, query: str, to: str, regex: bool = False, case: bool = True, text_col: str = "text") -> DataFrame:
    """docs with all matches replaced; without regex the replacement is plain text
    as well."""
    plain = to if regex else to.replace("\\", "\\\\").replace("$", "\\$")
    return docs.withColumn(text_col, F.regexp_replace(text_col, pattern_of(query, regex, case), plain))


def changed_range(pairs: DataFrame) -> DataFrame:
    """pairs (before, after) with the length of their common beginning and, of what
    is left, of their common end."""
    same = lambda a, b: F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, e: F.struct((s.on & e).alias("on"), (s.n + F.when(s.on & e, 1).otherwise(0)).alias("n")), lambda s: s.n)
    x = pairs.withColumn("prefix", F.when((F.col("before") == "") | (F.col("after") == ""), 0).otherwise(same(F.col("before"), F.col("after"))))
    rest = lambda c: F.reverse(F.substring(F.col(c), F.col("prefix") + 1, F.lit(1 << 30)))
    return x.withColumn("suffix", F.when((rest("before") == "") | (rest("after") == ""), 0).otherwise(same(rest("before"), rest("after"))))
