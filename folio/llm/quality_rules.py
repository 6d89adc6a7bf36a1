"""Rule-based quality filtering with cutoffs certified on labelled rows."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.names import column, sliced, unused
from folio.runtime import Scratch

SPACE, SYMBOLS = b"\t\n\x0b\x0c\r ", b"#*$%&|<>"
TAILS, UPPER, LOWER = bytes(range(0x80, 0xC0)), bytes(range(65, 91)), bytes(range(97, 123))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks")

#: Rules: a ratio that is high in bad texts, and the cutoffs that may be chosen, lenient ones last.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5)),
    "shouting": ("n_upper / greatest(n_upper + n_lower, 1)", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
    "marks": ("n_marks / greatest(n_words, 1)", (0.1, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0)),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.05, 0.1, 0.15, 0.2, 0.25, 0.3)),
    "length": ("word_chars / greatest(n_words, 1)", (8.0, 10.0, 12.0, 15.0, 20.0, 30.0)),
}


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words in windows of ``width`` (a power of two) that occur twice or more."""
    n = len(words) - width + 1
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if n < 2 or len(ids) == len(words):
        return 0
    # a hash finds the many texts without any repeat; equal windows are then named exactly
    v = (x + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + v[i : i + n]
    h.sort()
    if not (h[1:] == h[:-1]).any():
        return 0
    step = 1
    while step < width:
        x = np.unique(x[:-step] * (x.max() + 1) + x[step:], return_inverse=True)[1]
        step *= 2
    found = np.flatnonzero(np.bincount(x)[x] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of one text; all 0 for null."""
    b = text or b""
    without = lambda drop: len(b.translate(None, drop))
    words, seen, lines, again = b.split(), set(), 0, 0
    for line in b.split(b"\n"):
        if line.strip():
            lines += 1
            again += line in seen
            seen.add(line)
    size = len(b)
    return (len(words), without(TAILS + SPACE), size - without(SYMBOLS), again, repeat_words(words), lines, size - without(UPPER), size - without(LOWER), b.count(b"!") + b.count(b"?"))


def measured(docs: DataFrame, text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """docs with two columns more, the stratum and the counts as an array, whatever
    names are free for them."""
    stratum, found = unused(docs.columns, "stratum", "counts")
    rows = docs.withColumn(stratum, F.coalesce(column(stratum_col).cast("string") if stratum_col else F.lit(""), F.lit("")))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1000):
            made = np.array([counts(t) for t in b.column(at).cast(pa.binary()).to_pylist()], np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, made.size + 1, len(COUNTS), dtype=np.int32), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, found])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField(found, T.ArrayType(T.LongType()))]))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """id, stratum and COUNTS of every row."""
    few = docs.select(*map(column, dict.fromkeys([id_col, text_col, *([stratum_col] if stratum_col else [])])))
    return _named(measured(few, text_col, stratum_col), column(id_col).alias("id"))


def _named(rows: DataFrame, *more: Column) -> DataFrame:
    """measured() rows as stratum and COUNTS, and more columns before them."""
    *_, stratum, found = rows.columns
    return rows.select(*more, column(stratum).alias("stratum"), *(column(found)[i].alias(c) for i, c in enumerate(COUNTS)))


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial (n, p): the regularised incomplete beta function
    I(1-p; n-k, k+1), by its continued fraction."""
    if k >= n:
        return 1.0
    x, a, b = 1 - p, n - k, k + 1
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(p, b, a)
    return _beta(x, a, b)


def _beta(x: float, a: float, b: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d, out, m = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny), 0.0, 1
    out = d
    while m < 10_000:
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-12:
            break
        m += 1
    return min(1.0, front * out)


def steps(table: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int]]:
    """(rule, index of its cutoff) in the order in which a filter is tightened.

    table: by rule, how many good and bad rows lie in each gap between its cutoffs.
    Each rule goes from its lenient cutoffs to the strict ones, passing over those
    that reach no more bad rows; the rule whose next one costs the fewest good rows
    for each bad one goes first.
    """
    above = {rule: [(sum(g for g, _ in gaps[j:]), sum(b for _, b in gaps[j:])) for j in range(len(gaps) + 1)] for rule, gaps in table.items()}
    at, out = {rule: len(RULES[rule][1]) for rule in table}, []
    while True:
        nexts = []
        for k, rule in enumerate(RULES):
            if rule in table:
                good, bad = above[rule][at[rule] + 1]
                j = next((j for j in reversed(range(at[rule])) if above[rule][j + 1][1] > bad), None)
                if j is not None:
                    more_good, more_bad = above[rule][j + 1][0] - good, above[rule][j + 1][1] - bad
                    nexts.append((more_good / more_bad, -more_bad, k, rule, j))
        if not nexts:
            return out
        *_, rule, j = min(nexts)
        at[rule] = j
        out.append((rule, j))


def levels(sizes: dict[str, int], risk: float, doubt: float) -> list[tuple[list[str], float]]:
    """The groups of strata to certify, each with the level of its tests; all levels
    sum up to ``doubt``. Strata are groups of their own while their levels allow it,
    those with too few rows for that are one group together, if it has enough.

    A group needs the level at which it is certified without any rejection; what
    is left of the doubt is shared evenly. Only the numbers of rows decide, which
    say nothing of the rejections among them."""
    order = sorted((s for s in sizes if sizes[s]), key=lambda s: (-sizes[s], s))
    least = lambda names: at_most(0, sum(sizes[s] for s in names), risk)
    for k in range(len(order), -1, -1):
        groups, rest = [[s] for s in order[:k]], order[k:]
        used = sum(map(least, groups))
        if rest and used + least(rest) <= doubt:
            groups.append(rest)
        if used <= doubt and groups:
            spare = (doubt - sum(map(least, groups))) / len(groups)
            return [(names, least(names) + spare) for names in groups]
    return []


def choose(table: dict[tuple[str, str], list[tuple[int, int]]], risk: float, doubt: float, drawn: dict[tuple[str, str], list[int]] | None = None) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule.

    table: for each (stratum, rule), how many good and bad labelled rows lie in each
    gap between its cutoffs. drawn: the gaps of other good rows, which only serve
    to find the order of steps(). A stratum whose rows without those are fewer than
    twice what a certificate takes tests them as well, and finds the order by its
    bad rows alone.

    The tests are of joint filters: with every step one rule is tighter. A filter is
    certified if the exact binomial test rejects "more than risk of the stratum's
    good rows are rejected" at the level that levels() gives the stratum, with the
    sum of the rules' rejections as the count, which is never below that of the
    joint filter. The steps don't depend on the good rows that are tested and end
    with the first failed test, so each test has the whole level (fixed sequence),
    and the chance that any stratum's filter rejects more is below ``doubt`` (weighted
    Bonferroni). Strata with too few rows for a certificate of their own are tested
    as one; the bound then holds for them together. Among the certified filters that
    with the most bad rows beyond the good ones wins, the most lenient on ties.
    """
    drawn, whole = drawn or {}, defaultdict(int)
    for (stratum, rule), gaps in table.items():
        whole[stratum] = max(whole[stratum], sum(g for g, _ in gaps) + sum(drawn.get((stratum, rule), ())))
    out: dict[str, dict[str, float]] = {}
    for names, level in levels(whole, risk, doubt):
        of: dict[str, list[list[int]]] = {}  # by rule and gap: tested, bad, drawn
        for stratum in names:
            for rule in RULES:
                if (stratum, rule) in table:
                    gaps = of.setdefault(rule, [[0, 0, 0] for _ in table[stratum, rule]])
                    for gap, (good, bad), more in zip(gaps, table[stratum, rule], drawn.get((stratum, rule), [0] * len(gaps)), strict=True):
                        gap[0], gap[1], gap[2] = gap[0] + good, gap[1] + bad, gap[2] + more
        n = max(sum(g[0] for g in gaps) for gaps in of.values())
        if at_most(0, n // 2, risk) > level:
            of = {rule: [[good + more, bad, 0] for good, bad, more in gaps] for rule, gaps in of.items()}
            n = max(sum(g[0] for g in gaps) for gaps in of.values())
        cuts, best = {}, 0
        for rule, j in steps({rule: [(more, bad) for _, bad, more in gaps] for rule, gaps in of.items()}):
            cuts[rule] = j
            good, bad = (sum(x[i] for r, c in cuts.items() for x in of[r][c + 1 :]) for i in (0, 1))
            if at_most(good, n, risk) > level:
                break
            if bad - 3 * good > best:
                best = bad - 3 * good
                out |= {stratum: {r: RULES[r][1][c] for r, c in cuts.items()} for stratum in names}
    return out


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float, doubt: float, id_col: str = "doc_id", label_col: str = "quality") -> dict[str, dict[str, float]]:
    """choose() on the labelled rows of stats. Only the counts in each stratum,
    rule and gap reach the driver. A third of the ids, told by a hash, give their
    good rows to the order of the steps and not to the tests. An id with several
    labels counts as bad if one of them is; null labels are left out. Rows that
    repeat an id count each."""
    marks = labels.where(column(label_col).isNotNull()).groupBy(column(id_col).alias("id")).agg((F.min(column(label_col)) >= 1).alias("good"))
    gaps = [F.struct(F.lit(rule).alias("rule"), sum((F.expr(ratio) > c).cast("int") for c in cuts).alias("gap")) for rule, (ratio, cuts) in RULES.items()]
    rows = stats.where(~base_failed()).join(marks, "id").withColumn("plan", F.pmod(F.xxhash64("id"), F.lit(3)) == 0)
    found = rows.select("stratum", "good", "plan", F.explode(F.array(*gaps)).alias("g")).groupBy("stratum", "g.rule", "g.gap").agg(F.count_if(F.col("good") & ~F.col("plan")).alias("good"), F.count_if(F.col("good") & F.col("plan")).alias("drawn"), F.count_if(~F.col("good")).alias("bad"))
    table: dict[tuple[str, str], list[tuple[int, int]]] = {}
    drawn: dict[tuple[str, str], list[int]] = {}
    for r in found.toLocalIterator():
        size = len(RULES[r.rule][1]) + 1
        table.setdefault((r.stratum, r.rule), [(0, 0)] * size)[r.gap] = (r.good, r.bad)
        drawn.setdefault((r.stratum, r.rule), [0] * size)[r.gap] = r.drawn
    return choose(table, risk, doubt, drawn)


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


def verdicts(stats: DataFrame, chosen: dict[str, dict[str, float]]) -> DataFrame:
    """stats with base_failed and rule, the first one that rejects the row."""
    spark = stats.sparkSession
    rows = [(s, r, float(c)) for s, of in chosen.items() for r, c in of.items()]
    cut = spark.createDataFrame(rows, "stratum string, rule string, cut double").groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cuts"))
    over = F.coalesce(*(F.when(F.expr(f"{ratio} > cuts['{rule}']"), F.lit(rule)) for rule, (ratio, _) in RULES.items()))
    # one row for each stratum that has a certificate: as many as there are strata among the labels
    joined = stats.join(F.broadcast(cut) if len(rows) <= 10_000 else cut, "stratum", "left")
    return joined.withColumns({"base_failed": base_failed(), "rule": over})


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", label_col: str = "quality", risk: float = 0.03, doubt: float = 0.05) -> DataFrame:
    """id, COUNTS, base_failed, kept and the rule that rejected, for each row.

    Null and empty texts have no words and fail the base. Without labels, or with
    too few in a stratum for any certificate, only the base rejects. Repeated rows
    are judged each; other columns are not read. Empty tables give empty results.
    """
    stats = Scratch(docs.sparkSession, "quality").save(measure(docs, id_col, text_col, stratum_col), "stats")
    out = verdicts(stats, cutoffs(stats, labels, risk, doubt, id_col, label_col))
    return out.select(F.col("id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", label_col: str = "quality", risk: float = 0.03, doubt: float = 0.05) -> DataFrame:
    """docs without the rows that quality_rules rejects, all columns as they are.

    The rows are written with their counts, and filtered once the cutoffs are
    known, so texts are read by one Python pass and aren't shuffled."""
    rows = Scratch(docs.sparkSession, "quality").save(measured(docs, text_col, stratum_col), "rows")
    chosen = cutoffs(_named(rows, column(id_col).alias("id")), labels, risk, doubt, id_col, label_col)
    held = _named(rows, F.struct(*map(column, docs.columns)).alias("doc"))
    return verdicts(held, chosen).where("not base_failed and rule is null").select("doc.*")
