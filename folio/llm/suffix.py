"""Exact removal of long strings that occur twice, by prefix doubling over thinned positions.

Two positions are equal at length h if the h symbols from them on are. Spark ranks
positions at growing lengths, drops those whose rank is unique and splits the rest
until the threshold decides. Symbols are bytes, or words. Three things keep that small:

* A rank is a name of the string, taken from prefix sums in O(1), so a rank pair
  (i, i + h) needs no join with the ranks of the round before. Names that only
  drop positions are hashes modulo 2**64: equal strings never differ. Names by
  which strings are taken as equal are modulo two primes as well.
* Positions are thinned first. Each window of positions has an anchor, the position
  whose next symbols hash lowest. Equal strings have equal anchors, so the start
  positions that share an anchor go through the rounds as one item, a range of
  offsets before it.
* An item's core is what all its strings share, its full string what they span.
  Items with equal full strings are copies at every offset; an item with a unique
  core has none at any. Only what lies between is split, one item for each
  distinct full string, into smaller ranges and then single positions. For 400
  bytes, cores grow from 113 bytes over 385 to the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.names import column, sliced, unused
from folio.runtime import Scratch

SLICE = 1 << 20
POS = np.uint64((1 << 21) - 1)
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_GAP = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BASE = 0x9E3779B97F4A7C15
#: The two largest primes below 2**31, and the bases of the names modulo them.
PRIMES = ((2147483647, 1103515245), (2147483629, 1979284091))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


#: Rounds after the one over anchors, as many as a unit has steps.
ROUNDS = 2
#: The largest threshold.
LONGEST = 2047
#: Longer words are hashed whole, shorter ones from the sums over the text.
WORD = 64


@dataclass(frozen=True)
class Unit:
    """What a text is a string of: bytes, or the words of which they are, told by hash."""

    name: str
    share: float  # of the threshold that a window takes
    k: int  # symbols that choose an anchor
    steps: tuple[int, ...]  # offsets in a part, round by round
    salt: int  # keeps the names of the units apart

    def window(self, span: int) -> int:
        out = int(span * self.share)
        if out < 1 or span - out < self.k or span > LONGEST:
            raise ValueError(f"a threshold of {span} {self.name} is not supported")
        return out


BYTES, WORDS = Unit("bytes", 0.72, 32, (16, 1), 0), Unit("words", 0.86, 4, (8, 1), 0xA5A5F0F012345678)


def powers(modulus: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a base and of its inverse for one slice; modulus 0 stands for 2**64."""
    if modulus not in _powers:
        made = []
        for x in (base, pow(base, -1, modulus or 1 << 64)):
            p, n = np.ones(SLICE + 1024, np.uint64), 1
            while n < len(p):  # the powers so far times base**n are the next n
                more = p[: min(n, len(p) - n)] * np.uint64(pow(x, n, modulus or 1 << 64))
                p[n : n + len(more)] = more % np.uint64(modulus) if modulus else more
                n *= 2
            made.append(p)
        _powers[modulus] = made[0], made[1]
    return _powers[modulus]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hashed:
    """Hashes of the substrings of up to one slice of symbols."""

    def __init__(self, symbols: np.ndarray):
        self.n, (up, self.down) = len(symbols), powers(0, _BASE)
        self.values = _TABLE[symbols] if symbols.dtype == np.uint8 else symbols
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(self.values * up[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def everywhere(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[: self.n - size + 1])

    def named(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names modulo both primes, for strings that are taken as equal by their names."""
        out = np.zeros(len(start), np.uint64)
        for prime, base in PRIMES:
            (up, down), p, sums = powers(prime, base), np.uint64(prime), np.zeros(self.n + 1, np.uint64)
            np.cumsum(self.values % p * up[: self.n] % p, out=sums[1:])  # below 2**51: slices are short
            out = out << np.uint64(31) | (sums[end] - sums[start]) % p * down[start] % p
        return out


def spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sets full strings of other offset ranges apart."""
    return mix((lo.astype(np.uint64) << np.uint64(16)) + hi.astype(np.uint64) + np.uint64(1))


def word_ends(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text begins and ends."""
    gap = np.ones(len(text) + 2, bool)
    gap[1:-1] = _GAP[np.frombuffer(text, np.uint8)]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    return turn[::2], turn[1::2]


def slices(text: bytes, more: int) -> Iterator[tuple[int, Hashed]]:
    """The hashed slices of a text, each with so many bytes of the next."""
    b = np.frombuffer(text, np.uint8)
    for at in range(0, len(b), SLICE):
        yield at, Hashed(b[at : at + SLICE + more])


def word_symbols(text: bytes, parts: Iterable[tuple[int, Hashed]]) -> np.ndarray:
    """The hashes of a text's words, from its hashed slices with WORD bytes more."""
    first, last = word_ends(text)
    out = np.zeros(len(first), np.uint64)
    for at, h in parts:
        i, j = np.searchsorted(first, (at, at + SLICE))
        short = np.flatnonzero(last[i:j] - first[i:j] <= WORD) + i
        out[short] = h.of(first[short] - at, last[short] - at)
    for i in np.flatnonzero(last - first > WORD):
        out[i] = xxhash.xxh64_intdigest(text[first[i] : last[i]])
    return out


def anchors_of(texts: list[bytes], span: int, words: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """ranges() of the bytes of texts, and of their words if asked for, each slice
    hashed once for both. A few texts that fit into a slice are one, a line end
    between any two; of a longer one its slices come one after the other."""
    joined, parts = b"\n".join(texts), []
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    for at, h in slices(joined, max(span - 1, WORD)):
        if h.n >= span:
            yield ranges(h, at, bounds, span, BYTES)
        if words:
            parts.append((at, h))
    if parts:
        first, _ = word_ends(joined)
        w, bounds = word_symbols(joined, parts), np.searchsorted(first, bounds)
        for at in range(0, max(0, len(w) - words + 1), SLICE):
            yield ranges(Hashed(w[at : at + SLICE + words - 1]), at, bounds, words, WORDS)


def ranges(h: Hashed, at: int, bounds: np.ndarray, span: int, unit: Unit) -> tuple[np.ndarray, ...]:
    """Of a slice that begins at ``at``: number of the text, whether it is words,
    anchor position, smallest and largest offset before it, core hash and full name,
    of every range of start positions. bounds: where texts begin; a byte that parts
    two texts is in no string."""
    window, gap = unit.window(span), int(unit == BYTES)
    size, starts = span - window + 1, min(SLICE, h.n - span + 1)
    m = h.everywhere(unit.k)
    m = (m & ~POS) | np.arange(len(m), dtype=np.uint64)
    wide = 1
    while 2 * wide <= window:
        m = np.minimum(m[:-wide], m[wide:])
        wide *= 2
    if wide < window:
        m = np.minimum(m[: len(m) - (window - wide)], m[window - wide :])
    a = (m[:starts] & POS).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(np.clip(bounds - at, 0, starts)))
    inside = np.arange(starts) + at + span <= bounds[text + 1] - gap
    cut = np.flatnonzero((a[1:] != a[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])) + 1
    first, last = np.append(0, cut), np.append(cut, starts) - 1
    first, last = first[inside[first]], last[inside[first]]
    anchor, text, salt = a[first], text[first], np.uint64(unit.salt)
    lo, hi = anchor - last, anchor - first
    return text, np.full(len(anchor), unit == WORDS), anchor + at - bounds[text], lo, hi, h.of(anchor, anchor + size) ^ salt, h.named(first, last + span) ^ spread(lo, hi) ^ salt


def split(ctx: list[bytes], top: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: int, step: int, unit: Unit) -> tuple[np.ndarray, ...]:
    """(number of the item, lo, hi, core, full) of the parts of items with the offsets
    lo..hi. ctx: the text from the offset ``top`` on to the end of the smallest
    one's string. The items, few enough for a slice together, are hashed in one go."""
    joined, salt = b"\n".join(ctx), np.uint64(unit.salt)
    if unit == BYTES:
        h, at = Hashed(np.frombuffer(joined, np.uint8)), np.cumsum([0, *(len(c) + 1 for c in ctx[:-1])])
    else:
        first, _ = word_ends(joined)
        h, at = Hashed(word_symbols(joined, slices(joined, WORD))), np.searchsorted(first, np.cumsum([0, *(len(c) + 1 for c in ctx[:-1])]))
    start, n = lo // step, hi // step - lo // step + 1
    item = np.repeat(np.arange(len(ctx)), n)
    block = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + start[item]
    zero, lo, hi = (at + top)[item], lo[item], hi[item]  # where the offset 0 stands
    low, high = np.maximum(block * step, lo), np.minimum(block * step + step - 1, hi)
    # the core of the whole block, also where the range covers a part of it
    core = h.of(zero - block * step, zero - (block * step + step - 1) + span)
    core ^= spread(block, np.full(len(block), step)) ^ salt
    return item, low, high, core, h.named(zero - high, zero - low + span) ^ spread(low, high) ^ salt


def merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """The maximal ranges of a union of ranges."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]], whole_chars: bool = False) -> tuple[bytes, int, int]:
    """The text without the union of spans, the bytes removed, the runs removed.
    whole_chars: a character that is partly covered stays."""
    out, at, runs, gone = [], 0, 0, 0
    for s, e in merged(spans):
        while whole_chars and s < e and s < len(text) and text[s] & 0xC0 == 0x80:
            s += 1
        while whole_chars and s < e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append(text[at:s])
            at, runs, gone = e, runs + 1, gone + e - s
    out.append(text[at:])
    return b"".join(out), gone, runs


def _u(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and a hash of the text tell rows apart; rows equal in both are cut alike."""
    text = F.coalesce(column(text_col).cast("binary"), F.lit(b""))
    return docs.select(column(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _resolve(items: DataFrame, scratch: Scratch, k: int) -> tuple[DataFrame, DataFrame]:
    """Items with a copy at every offset, and one item of each distinct full string
    in groups whose core is shared but which hold several full strings. Column
    alone says that some item of this full string is still open and has no copy.

    Counts are written before they are joined: a join of two plain tables is one
    whose hot keys Spark can split."""
    classes = scratch.save(items.groupBy("core", "full").agg(F.count("*").alias("n"), F.min("item").alias("item"), F.bool_or("open").alias("open")), f"classes-{k}")
    mixed = scratch.save(classes.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core"), f"mixed-{k}")
    copies = items.where("open").join(classes.where("n > 1").select("core", "full").hint("shuffle_hash"), ["core", "full"], "left_semi").select("item.*")
    return copies, classes.join(mixed.hint("shuffle_hash"), "core").select("core", "full", "item", (F.col("open") & (F.col("n") == 1)).alias("alone"))


def repeated_spans(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", span: int = 400, words: int | None = None) -> DataFrame:
    """(id, th, w, s, e): ranges of the bytes of texts, or of their words where w,
    each made of strings of ``span`` bytes or ``words`` words that also start
    anywhere else, all of them together every such string. Bytes and words go
    through the same rounds."""
    BYTES.window(span)
    if words:
        WORDS.window(words)
    rows = _keyed(docs, id_col, text_col)
    limits = {False: (BYTES, span), True: (WORDS, words or 0)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "full", "id", "th", "pos"]
        for b in batches:
            size = pc.cast(pc.binary_length(b.column(2)), pa.int64()).to_numpy()
            at = 0
            while at < b.num_rows:  # as many texts as fit into a slice, one at least
                n = max(1, int(np.searchsorted(np.cumsum(size[at:] + 1), SLICE)))
                part, at = b.slice(at, n), at + n
                found = list(anchors_of(part.column(2).to_pylist(), span, words))
                if found:
                    text, w, a, lo, hi, core, full = (np.concatenate(x) for x in zip(*found, strict=True))
                    of = pa.array(text)
                    yield pa.RecordBatch.from_arrays([_u(core), _u(full), part.column(0).take(of), part.column(1).take(of), pa.array(a << 23 | lo << 12 | hi << 1 | w)], names)

    least = min(span, 2 * words - 1) if words else span
    item = F.struct("id", "th", "w", "a", "lo", "hi").alias("item")
    # place and offsets are one number where most rows are shuffled
    anchors = scratch.save(rows.where(F.length("text") >= least).mapInArrow(scan, "core long, full long, id long, th long, pos long"), "anchors")
    place = {"w": F.col("pos").bitwiseAND(1) == 1, "a": F.shiftright("pos", 23), "lo": F.shiftright("pos", 12).bitwiseAND(LONGEST).cast("int"), "hi": F.shiftright("pos", 1).bitwiseAND(LONGEST).cast("int")}
    shared = scratch.save(anchors.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "shared")
    # the smaller side is hashed in each partition: the anchors needn't be sorted
    items = scratch.save(anchors.join(shared.hint("shuffle_hash"), "core").withColumns(place).select("core", "full", F.lit(True).alias("open"), item), "items")
    scratch.drop("anchors")
    copies, open_items = _resolve(items, scratch, 0)
    done = [scratch.save(copies, "copies-0")]
    open_items = scratch.save(open_items, "open-0")
    scratch.drop("items")

    # the open items' own symbols, with which the later rounds go without the texts
    lists = open_items.groupBy("item.id", "item.th").agg(F.collect_list(F.struct("item.w", "item.a", "item.lo", "item.hi", "alone")).alias("x"))
    wanted = rows.join(lists, rows["id"].eqNullSafe(lists["id"]) & (rows["th"] == lists["th"])).select(rows["id"], rows["th"], "text", "x")
    kinds = "id long, th long, w boolean, a long, lo int, hi int, alone boolean, top int, ctx binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 500):
            out = []
            for r in b.to_pylist():
                text, ends = r["text"], word_ends(r["text"]) if any(x["w"] for x in r["x"]) else None
                for x in r["x"]:
                    s, e = x["a"] - x["hi"], x["a"] - x["lo"] + limits[x["w"]][1]
                    s, e = (int(ends[0][s]), int(ends[1][e - 1])) if x["w"] else (s, e)
                    out.append({"id": r["id"], "th": r["th"], **x, "top": x["hi"], "ctx": text[s:e]})
            yield pa.RecordBatch.from_pylist(out, _arrow(kinds))

    ctx = scratch.save(wanted.mapInArrow(cut, kinds), "ctx-0")
    for k in range(1, ROUNDS + 1):

        def parts(batches: Iterator[pa.RecordBatch], k=k) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches, 1000):
                words_too = b.column(2).to_numpy(zero_copy_only=False)
                for w, (unit, size) in limits.items():
                    rows = np.flatnonzero(words_too == w)
                    if len(rows):
                        own = b.take(pa.array(rows))
                        lo, hi, top = (own.column(i).to_numpy().astype(np.int64) for i in (4, 5, 7))
                        item, low, high, core, full = split(own.column(8).to_pylist(), top, lo, hi, size, unit.steps[k - 1], unit)
                        at = pa.array(item)
                        keep = [own.column(i).take(at) for i in range(4)]
                        yield pa.RecordBatch.from_arrays([*keep, pa.array(low, pa.int32()), pa.array(high, pa.int32()), own.column(6).take(at), _u(core), _u(full)], ["id", "th", "w", "a", "lo", "hi", "alone", "core", "full"])

        small = scratch.save(ctx.mapInArrow(parts, "id long, th long, w boolean, a long, lo int, hi int, alone boolean, core long, full long"), f"parts-{k}")
        # parts with alone false are there to be met; their own symbols are covered already
        met, still = _resolve(small.select("core", "full", F.col("alone").alias("open"), item), scratch, k)
        done.append(scratch.save(met, f"copies-{k}"))
        if k < ROUNDS:
            still = still.select("item.*", F.col("alone").alias("still"))
            whole = ctx.select("id", "th", "w", "a", F.col("lo").alias("from"), F.col("hi").alias("to"), "top", "ctx").distinct()
            match = whole["id"].eqNullSafe(still["id"]) & still["lo"].between(F.col("from"), F.col("to"))
            for c in ("th", "w", "a"):
                match &= whole[c] == still[c]
            # bytes are cut to the part's own; words keep their item's text
            piece = F.when(still["w"], F.col("ctx")).otherwise(F.substring(F.col("ctx"), F.col("top") - still["hi"] + 1, still["hi"] - still["lo"] + F.lit(span)))
            top = F.when(still["w"], F.col("top")).otherwise(still["hi"])
            ctx = scratch.save(whole.join(still, match).select(still["id"], still["th"], still["w"], still["a"], "lo", "hi", F.col("still").alias("alone"), top.alias("top"), piece.alias("ctx")), f"ctx-{k}")
    found = reduce(DataFrame.unionByName, done)
    return found.select("id", "th", "w", (F.col("a") - F.col("hi")).alias("s"), (F.col("a") - F.col("lo") + F.when(F.col("w"), words or 0).otherwise(span)).alias("e"))


def _arrow(kinds: str) -> pa.Schema:
    of = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, of[kind]) for name, kind in (x.split() for x in kinds.split(", "))])


def in_bytes(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of bytes, from the first one's first byte to the last one's last."""
    first, last = word_ends(text) if spans else ((), ())
    return [(int(first[s]), int(last[e - 1])) for s, e in spans]


def _with_spans(docs: DataFrame, id_col: str, text_col: str, span: int, words: int | None) -> DataFrame:
    """docs and a last column, of any free name: an array of (w, s, e), null without any."""
    scratch = Scratch(docs.sparkSession, "suffix")
    spans = repeated_spans(docs, scratch, id_col, text_col, span, words)
    key, mark, one, two, found = unused(docs.columns, "key", "mark", "one", "two", "found")
    # sets: rows that repeat an id and a text have the same ranges each
    lists = scratch.save(spans.groupBy(F.col("id").alias(one), F.col("th").alias(two)).agg(F.collect_set(F.struct("w", "s", "e")).alias(found)), "spans")
    scratch.drop(*(f"{x}-{k}" for x in ("copies", "parts", "ctx", "open", "classes", "mixed") for k in range(ROUNDS + 1)))
    th = F.xxhash64(F.coalesce(column(text_col).cast("binary"), F.lit(b"")))
    out = docs.withColumns({key: column(id_col).cast("long"), mark: th}).join(lists, F.col(key).eqNullSafe(F.col(one)) & (F.col(mark) == F.col(two)), "left")
    return out.select(*map(column, docs.columns), found)


def _by_unit(found: pa.Array) -> Iterator[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """The ranges of bytes and those of words of each row of a batch."""
    for x in found:
        both: tuple[list, list] = [], []
        for r in x.as_py() or ():
            both[r["w"]].append((r["s"], r["e"]))
        yield both


def suffix_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400, words: int | None = None) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of each row: what is left once
    each byte is removed that a ``span``-byte string covers which also starts
    anywhere else in any text. With ``words`` also n_repeated_words: the row's words
    that a passage of so many words covers which also starts anywhere else, however
    its words are set apart. Such passages may have fewer bytes than ``span``; they
    are counted and not removed here.

    A null text is an empty one. Rows that repeat a text remove each other's, also
    if they share an id. Ids are integers or null. Other columns aren't read. An
    empty table gives an empty result. A text is held in memory by one task.
    """
    rows = docs.select(column(id_col).cast("long").alias("id"), F.coalesce(column(text_col).cast("binary"), F.lit(b"")).alias("text"))
    kinds = {id_col: "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"} | ({"n_repeated_words": "long"} if words else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1000):
            out = []
            for text, (own, passages) in zip(b.column(1), _by_unit(b.column(2)), strict=True):
                t = text.as_py()
                left, gone, n = kept_bytes(t, own)
                out.append((len(t), gone, n, hashlib.sha256(left).hexdigest(), sum(e - s for s, e in merged(passages))))
            cols = list(zip(*out, strict=True))[: len(kinds) - 1] or [()] * (len(kinds) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, _arrow(", ".join(f"x {k}" for k in [*kinds.values()][1:])).types)], [*kinds])

    return _with_spans(rows, "id", "text", span, words).mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400, words: int | None = None, length_col: str | None = None) -> DataFrame:
    """docs with the repeats cut out of their texts, all columns as before:
    ``span``-byte strings that also start anywhere else, and with ``words`` also
    passages of so many words.

    Whole characters are removed only, so texts stay valid; one that a repeat
    covers in part stays. length_col, if given, gets the new number of code
    points. Texts without repeats, nulls included, stay as they are. Columns may
    have any name."""
    names, at = docs.columns, docs.columns.index(text_col)
    size = None if length_col is None else names.index(length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1000):
            texts, cut = b.column(at).to_pylist(), np.zeros(b.num_rows, bool)
            for i, (own, passages) in enumerate(_by_unit(b.column(len(names)))):
                if own or passages:
                    text = texts[i].encode()
                    texts[i], cut[i] = kept_bytes(text, own + in_bytes(text, passages), True)[0].decode(), True
            cols = b.columns[: len(names)]
            if size is not None:
                cols[size] = pc.if_else(pa.array(cut), pa.array([None if t is None else len(t) for t in texts], cols[size].type), cols[size])
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return _with_spans(docs, id_col, text_col, span, words).mapInArrow(run, docs.schema)
