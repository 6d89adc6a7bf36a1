"""Ranked lexical search over inverted treaps, one for each term of a segment."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.names import column, sliced
from folio.runtime import Scratch

#: Postings in a segment, bytes of items that are searched for at once, and bytes of a text cut into terms at a time.
POSTINGS, ITEMS_AT_ONCE, SLICE = 300_000, 2 << 20, 1 << 20
#: Of so many segments one gives the scores to begin with.
FIRST_OF = 16
#: What parts terms becomes a space, A-Z become small; bytes from 0x80 on belong to terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
FORWARD = "id long, n long, terms array<int>, tfs array<int>"
SEGMENT = "ids array<long>, nameless int, terms array<int>, starts array<int>, docs array<int>, units array<long>, lefts array<int>, rights array<int>"
LAST = np.iinfo(np.int64).max


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms in order, from a slice of it at a time."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and FOLD[text[end]] != 32:
            end += 1
        yield text[at:end].translate(FOLD).split()
        at = end


def forward(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n: all terms, terms and tfs of the vocabulary's terms) of rows with a term."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of ITEMS_AT_ONCE bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for part in sliced(batches, 1000):
            ids, sizes, terms, tfs, ends = [], [], [], [], [0]
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                n, found = 0, Counter()
                for words in terms_of(text or b""):
                    n += len(words)
                    found.update(map(get, words))
                if n:
                    found.pop(None, None)
                    ids.append(i)
                    sizes.append(n)
                    terms += found
                    tfs += found.values()
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    return docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("binary").alias("text")).mapInArrow(run, FORWARD)


def treaps(starts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lefts, rights) over postings that are sorted by term and document.

    A term's treap is in the order of documents from left to right, and a node's
    ``order`` is above all below it; -1 is no node."""
    n, of = len(order), order.tolist()
    left, right = [-1] * n, [-1] * n
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        spine: list[int] = []
        for i in range(s, e):
            below, x = -1, of[i]
            while spine and of[spine[-1]] < x:
                below = spine.pop()
            left[i] = below
            if spine:
                right[spine[-1]] = i
            spine.append(i)
    return np.array(left, np.int32), np.array(right, np.int32)


def _segment(ids: list, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, per: np.ndarray, n_docs: int, n_terms: int) -> list:
    """A SEGMENT row of documents with their terms; per: how many terms each has."""
    nameless = sum(i is None for i in ids)
    key = np.array([LAST if i is None else i for i in ids], np.int64)
    by = np.lexsort((sizes, key, [i is None for i in ids]))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    docs = np.repeat(place, per)
    m = 50 + 50 * sizes * n_docs // n_terms
    tf, m = tfs.astype(np.int64), np.repeat(m, per)
    units = 1_000_000_000 * tf // (1000 * tf + 20 * m)
    to = np.lexsort((docs, terms))
    terms, docs, units = terms[to], docs[to], units[to]
    names, starts = np.unique(terms, return_index=True)
    starts = np.append(starts, len(terms))
    # equal impacts are ordered by a hash, so their treaps don't become lists
    left, right = treaps(starts, units << 20 | (docs * 0x9E3779B1 >> 7 & 0xFFFFF))
    return [key[by], nameless, names, starts, docs, units, left, right]


def _lists(row: list) -> pa.RecordBatch:
    kinds = [pa.int64(), None, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    out = [pa.array([x], pa.int32()) if k is None else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, k)) for x, k in zip(row, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(out, [x.split()[0] for x in SEGMENT.split(", ")])


def segments(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """forward() rows to an index of treaps, a row for each segment.

    A segment has the documents that a task has read one after the other, up to
    POSTINGS postings: their ids in order (rows without an id last, as many as
    nameless says), and for each term, from starts[k] to starts[k + 1], the
    postings' documents by place, their impacts but for the term's own weight,
    and their left and right children. Every row with a term is in one segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def made() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            per = t["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            terms, tfs = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
            return _lists(_segment(t["id"].to_pylist(), t["n"].to_numpy(), terms, tfs, per, n_docs, n_terms))

        for b in sliced(batches, 2000):
            b = b.filter(pc.greater(b.column(2).value_lengths(), 0))
            held.append(b)
            size += len(b.column(2).flatten())
            if size >= POSTINGS:
                yield made()
                held, size = [], 0
        if size:
            yield made()

    return rows.mapInArrow(run, SEGMENT)


class Best:
    """The k best of an item so far: by score, then by id, rows without one last."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.worst = k, max(1, least), LAST
        self.scores, self.ids, self.nameless = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        may = scores >= self.least
        scores, ids, nameless = (np.concatenate([a, b[may]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.nameless, nameless)))
        to = np.lexsort((ids, nameless, -scores))[: self.k]
        self.scores, self.ids, self.nameless = scores[to], ids[to], nameless[to]
        if len(to) == self.k:
            self.least, self.worst = int(self.scores[-1]), int(self.ids[-1])


class Index:
    """A segment in memory."""

    def __init__(self, row: list[np.ndarray], nameless: int, weights: np.ndarray):
        self.ids, self.terms, self.starts, self.docs, units, self.left, self.right = row
        self.named = len(self.ids) - nameless
        self.impact = units * np.repeat(weights[self.terms], np.diff(self.starts))
        inner = np.zeros(len(self.docs), bool)
        for x in (self.left, self.right):
            inner[x[x >= 0]] = True
        self.roots = np.flatnonzero(~inner)  # one a term, in the order of terms

    def top(self, node: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The highest node between two documents in each subtree, -1 if there is none."""
        node, at = node.copy(), np.arange(len(node))
        while at.size:
            of = node[at]
            d = self.docs[of]
            after = d >= below[at]
            off = after | (d <= above[at])
            at, of, after = at[off], of[off], after[off]
            node[at] = of = np.where(after, self.left[of], self.right[of])
            at = at[of >= 0]
        return node

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Puts what belongs to the best into them.

        All treaps of the item's terms are gone through together. A state is a
        range of documents with the highest node that each treap has in it; the
        sum of their impacts bounds every score in the range, and states below
        the last of the best are left. Of the others the document of the node
        with the highest impact is scored, which parts the range in two. A round
        takes all open states at once.
        """
        cells = self.roots[np.flatnonzero(np.isin(self.terms, terms))]
        lo, hi = np.array([-1]), np.array([len(self.ids)])
        of = np.zeros(len(cells), np.int64)  # the state of each cell, in order
        while len(cells):
            first = np.flatnonzero(np.diff(of, prepend=-1))
            impact = self.impact[cells]
            bound = np.add.reduceat(impact, first)
            go = (bound > best.least) | (bound == best.least) & (self.ids[lo + 1] <= best.worst)
            if not go.all():
                stay = go[of]
                cells, of, impact = cells[stay], (np.cumsum(go) - 1)[of[stay]], impact[stay]
                lo, hi = lo[go], hi[go]
                if not len(cells):
                    return
                first = np.flatnonzero(np.diff(of, prepend=-1))
            high = np.flatnonzero(impact == np.maximum.reduceat(impact, first)[of])
            high = high[np.flatnonzero(np.diff(of[high], prepend=-1))]
            v = self.docs[cells[high]].astype(np.int64)
            mid = v[of]
            own = self.top(cells, mid - 1, mid + 1)
            has = own >= 0
            scores = np.bincount(of[has], self.impact[own[has]], len(lo)).astype(np.int64)  # exact below 2^53
            best.add(scores, self.ids[v], v >= self.named)
            both = np.concatenate([self.top(cells, lo[of], mid), self.top(cells, mid, hi[of])])
            states = np.concatenate([of, of + len(lo)])
            lo, hi = np.concatenate([lo, v]), np.concatenate([v, hi])
            cells, states = both[both >= 0], states[both >= 0]
            some = np.zeros(len(lo), bool)
            some[states] = True
            of = (np.cumsum(some) - 1)[states]
            lo, hi = lo[some], hi[some]


def search(index: DataFrame, items: list[np.ndarray], weights: np.ndarray, k: int, least: list[int] | None = None) -> DataFrame:
    """(item: its place in the list, id, score): of each task the k best of each
    item, those that can't be below ``least`` only."""
    asked = index.sparkSession.sparkContext.broadcast((items, weights, least or [0] * len(items)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, least = asked.value
        best = [Best(k, x) for x in least]
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                of = Index([c.flatten().to_numpy() for j, c in enumerate(row.columns) if j != 1], row.column(1)[0].as_py(), weights)
                for terms, found in zip(items, best, strict=True):
                    of.search(terms, found)
        for i, x in enumerate(best):
            if len(x.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x.ids), i), pa.int32()), pa.array(x.ids, pa.int64(), mask=x.nameless), pa.array(x.scores, pa.int64())], ["item", "id", "score"])

    return index.mapInArrow(run, "item int, id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item over all tasks, with their rank."""
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _blocks(items: DataFrame) -> Iterator[list]:
    """Items in blocks of ITEMS_AT_ONCE bytes, or one."""
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append(row)
        size += len(row[1] or b"")
        if size >= ITEMS_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item, rank, id and score: for each row of items the k rows of docs with the
    highest scores above 0, equal ones by ascending id.

    Terms are runs of ASCII letters and digits and of all other characters from
    U+0080 on, A-Z lower-cased. With N rows that have a term, L terms in all, n
    in a row, df rows with a term and tf of it in the row, the score adds up
    floor(1000 ln((2N + 2) / (2df + 1))) * (10^9 tf div (1000 tf + 20 m)) over
    the item's distinct terms, m being 50 + (50 n N div L).

    Null and empty texts have no terms, and are in no result nor in N; an item
    without a term that docs have gives no row. Items that repeat have their own
    results each, rows that repeat are found as often. Ids are integers; a null id
    comes last among equal scores. Other columns aren't read. Where either table
    is empty the result is.

    Items are searched for in blocks of a bounded size; each block goes over all
    of docs once. Every row is indexed under the block's terms (those that no
    item has can't score), in segments that are written. A few segments are
    searched first: what an item's k best there score at least bounds the search
    of all, which so gives out little besides the result.
    """
    spark = docs.sparkSession
    asked = items.select(column(item_col).alias("item"), column(query_col).cast("binary").alias("text"))
    kind = asked.schema["item"].dataType.simpleString()
    out = spark.createDataFrame([], f"item {kind}, rank int, id long, score long")
    for block in _blocks(asked):
        out = out.unionByName(_ranked_block(spark, docs, block, kind, k, id_col, text_col))
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _ranked_block(spark: SparkSession, docs: DataFrame, block: list, kind: str, k: int, id_col: str, text_col: str) -> DataFrame:
    scratch = Scratch(spark, "search")
    words = [sorted({w for part in terms_of(bytes(r[1] or b"")) for w in part}) for r in block]
    vocabulary = {w: i for i, w in enumerate(sorted({w for x in words for w in x}))}
    items = [np.array([vocabulary[w] for w in x], np.int32) for x in words]
    rows = scratch.save(forward(docs, vocabulary, id_col, text_col), "forward")
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    index = scratch.save(segments(rows, n_docs, n_terms), "index")
    scratch.drop("forward")
    some = ranked(search(index.where(F.pmod(F.xxhash64("ids"), F.lit(FIRST_OF)) == 0), items, weights, k), k)
    least = [0] * len(items)
    for i, score in some.where(F.col("rank") == k).select("item", "score").collect():  # a number for each item of the block
        least[i] = score
    found = scratch.save(ranked(search(index, items, weights, k, least), k), "found")
    scratch.drop("index")
    named = spark.createDataFrame([(i, r[0]) for i, r in enumerate(block)], f"at int, called {kind}")
    return found.join(F.broadcast(named), F.col("item") == F.col("at")).select(F.col("called").alias("item"), F.col("rank").cast("int").alias("rank"), "id", "score")


def oracle(k: int = 50) -> str:
    """ranked_search(documents, benchmark) in DuckDB's SQL."""
    terms = "unnest(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
    t AS (SELECT k, {terms.format("text")} FROM d),
    p AS (SELECT k, term, count(*) AS tf FROM t GROUP BY ALL),
    n AS (SELECT k, count(*) AS n FROM t GROUP BY ALL),
    s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, s),
    q AS (SELECT i, item_id, {terms.format("text")} FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
    c AS (SELECT i, item_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // s.terms))))::BIGINT AS score
          FROM (SELECT DISTINCT * FROM q) JOIN w USING (term) JOIN p USING (term) JOIN n USING (k), s GROUP BY ALL)
    SELECT item_id, rank, doc_id, score FROM (
        SELECT *, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank FROM c JOIN d USING (k) WHERE score > 0) WHERE rank <= {k}"""
