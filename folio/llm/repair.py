"""Conversation structure repair by a rank-compressed dynamic program."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.names import column, sliced
from folio.runtime import Scratch

SPACES = " \t\n\x0b\f\r"
NAMES = {"s": "system", "u": "user", "a": "assistant"}
#: Where a dialogue stands: nothing yet, after the system's turn, a user's, an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: What a user's or an assistant's turn makes of each state; nothing else may follow.
NEXT = {EMPTY: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
START: tuple = ((0, 0), None, None, None)


def runs(state: int) -> list[tuple[str, int]]:
    """Runs of inserted turns from a state, by length, and the states after. Longer
    ones go round in a circle, so they are never the cheapest."""
    out = [("", state)]
    for _ in range(2):
        who, state = NEXT[state]
        out.append((out[-1][0] + who, state))
    return out


def macros(initial: str, fault: str) -> list[tuple[int, int, int, int, str, str, str]]:
    """(from, to, cost, place of the code, run, edit, new initial): a run of inserts
    and one turn's edit.

    The code is an I for each insert and the edit's letter, so no code begins
    another, and audits of equally many turns compare as their codes' places do.
    """
    out = []
    for state in NEXT:
        for run, at in runs(state):
            cost, code = INSERT * len(run), "I" * len(run)
            out.append((state, at, cost + DELETE, code + "D", run, "D", ""))
            if fault in ("blank", "duplicate"):
                continue
            who, after = NEXT[at]
            stay = CUT * (fault == "truncated")
            out.append((state, after, cost + REROLE + stay, code + "R", run, "R", who))
            if initial == who:
                out.append((state, after, cost + KEEP + stay, code + "K", run, "K", ""))
            if initial == "s" and at == EMPTY:
                out.append((state, SYSTEM, cost + KEEP + stay, code + "K", run, "K", ""))
    places = {c: i for i, c in enumerate(sorted({x[3] for x in out}))}
    return [(f, t, c, places[code], run, edit, who) for f, t, c, code, run, edit, who in out]


class Steps:
    """One turn after the other over layers.

    A layer has, for each state the dialogue may begin in and each it may be in,
    the least cost and the rank of its least audit among all audits of the layer.
    The next layer's audits compare by the rank before and the place of the macro's
    code; the audits themselves are never made. Costs count from the layer's least
    one, so there are few different layers, and each is worked out once.
    """

    MOST = 200_000

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}
        self.of = {(i, f): macros(i, f) for i in ("s", "u", "a", "") for f in ("", "blank", "duplicate", "truncated")}

    def step(self, layer: tuple, initial: str, fault: str) -> tuple[tuple, int, tuple]:
        """The next layer, how much was taken off its costs, and for each of its
        cells the macro that led there."""
        key = (layer, initial if initial in NAMES else "", fault)
        if (found := self.known.get(key)) is None:
            if len(self.known) >= self.MOST:
                self.known.clear()
            found = self.known[key] = self._step(layer, self.of[key[1:]])
        return found

    @staticmethod
    def _step(layer: tuple, of: list[tuple]) -> tuple[tuple, int, tuple]:
        best: list[tuple | None] = [None] * len(layer)
        for base in range(0, len(layer), 4):
            for m in of:
                if cell := layer[base + m[0]]:
                    x = (cell[0] + m[2], cell[1], m[3], m)
                    k = base + m[1]
                    if best[k] is None or x[:3] < best[k][:3]:
                        best[k] = x
        ranks = {r: i for i, r in enumerate(sorted({x[1:3] for x in best if x}))}
        off = min(x[0] for x in best if x)
        return tuple(x and (x[0] - off, ranks[x[1:3]]) for x in best), off, tuple(x and x[3] for x in best)


def ending(costs: list[tuple | None]) -> tuple[int, int, str]:
    """(cost, state, run of inserts) of the least whole audit, from the last layer's cells."""
    found = []
    for state, cell in enumerate(costs):
        if cell:
            found += [(cell[0] + INSERT * len(run), cell[1], len(run), state, run) for run, at in runs(state) if at in (EMPTY, ASSISTANT)]
    cost, _, _, state, run = min(found)
    return cost, state, run


def composed(parts: Iterable[list[tuple | None]]) -> tuple[int, list[int], str]:
    """Cost, the states at the borders of a dialogue's parts, and the last inserts.

    A part is its last layer, 16 cells from state to state. Audits of several
    parts compare part by part, so ranks are made of pairs of ranks as in a step.
    """
    now: list[tuple | None] = list(START)
    back: list[list[int | None]] = []
    for part in parts:
        best: list[tuple | None] = [None] * 4
        for f, cell in enumerate(now):
            for t in range(4):
                if cell and (x := part[4 * f + t]):
                    y = (cell[0] + x[0], cell[1], x[1], f)
                    best[t] = y if best[t] is None else min(best[t], y)
        ranks = {r: i for i, r in enumerate(sorted({x[1:3] for x in best if x}))}
        now = [x and (x[0], ranks[x[1:3]]) for x in best]
        back.append([x and x[3] for x in best])
    cost, state, run = ending(now)
    states = [state]
    for b in reversed(back):
        states.append(b[states[-1]])
    return cost, states[::-1], run


#: No turns, from each state.
IDENTITY = tuple((0, 0) if f == t else None for f in range(4) for t in range(4))


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Sorted rows by their first columns."""
    rows = (r for b in sliced(batches, 5000) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, itemgetter(*range(keys)))


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, pos, initial, fault) in order to a row for each part."""
    steps = Steps()

    def made() -> Iterator[tuple]:
        for (key, part), rows in _grouped(batches, 2):
            layer, cost, illegal, first, last = IDENTITY, 0, 0, None, None
            for _, _, _, initial, fault in rows:
                layer, off, _ = steps.step(layer, initial, fault)
                cost += off
                illegal += last is not None and last + initial not in ("su", "ua", "au")
                first, last = initial if first is None else first, initial
            yield key, part, first, last, illegal, [x and x[0] + cost for x in layer], [x and x[1] for x in layer]

    kinds = [("key", pa.string()), ("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))]
    return _batched(made(), pa.schema(kinds))


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A dialogue's parts in order to where each begins and ends; the last one has
    the dialogue's cost and count of illegal neighbours."""

    def made() -> Iterator[tuple]:
        for _, rows in groupby(((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))), itemgetter(0)):
            parts = list(rows)  # a row for each range of rows
            cost, states, run = composed([None if c is None else (c, r) for c, r in zip(p[5], p[6], strict=True)] for p in parts)
            illegal = sum(p[4] for p in parts) + sum(p[3] + q[2] not in ("su", "ua", "au") for p, q in zip(parts, parts[1:], strict=False))
            for k, p in enumerate(parts):
                at_end = k == len(parts) - 1
                yield p[0], p[1], states[k], states[k + 1], run if at_end else "", cost if at_end else None, illegal if at_end else None

    kinds = [("key", pa.string()), ("part", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("run", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())]
    return _batched(made(), pa.schema(kinds))


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, pos, initial, fault, begin, end, run) in order to each turn's
    edit: forward over the layers once more, keeping a macro a cell, then back."""
    steps = Steps()

    def made() -> Iterator[tuple]:
        for _, rows in _grouped(batches, 2):
            back, places, layer = [], [], None
            for _, _, pos, initial, fault, begin, end, run in rows:
                if layer is None:
                    layer = tuple((0, 0) if s == begin else None for s in range(4))
                layer, _, by = steps.step(layer, initial, fault)
                back.append(by)
                places.append(pos)
            state, after = end, run
            found = []
            for pos, by in zip(reversed(places), reversed(back), strict=True):
                m = by[state]
                found.append((pos, m[4], m[5], m[6], after))
                state, after = m[0], ""
            yield from reversed(found)

    kinds = [("at", pa.int64()), ("before", pa.string()), ("edit", pa.string()), ("to", pa.string()), ("after", pa.string())]
    return _batched(made(), pa.schema(kinds))


class Repair:
    """The cheapest edits that give every dialogue the form (system? (user assistant)+)?.

    Turns go by number, those without one first, then role and text, and rows that
    repeat one come repeatedly. Null roles and texts are one space; null dialogue
    ids form one dialogue. A turn's first fault counts: blank (no character but
    the six ASCII white-space ones), duplicate (role and text as an earlier turn
    of the dialogue), truncated (its last such character is none of .!?). Of
    equally cheap edits those with the least audit in ASCII are made. Other columns
    aren't read. No rows give empty tables.

    Rows are dealt out by ranges of dialogue and turn and written; a dialogue may
    have any share of them. Each range is worked out for every state that its
    dialogue may stand in before it, which leaves 16 costs and ranks a dialogue
    and range; these are put together in order, and each range then finds its
    edits by itself.

    facts: key (names the dialogue, never null), part, pos (in the order of
    turns), turn, initial, fault. plans: a row for each dialogue and range, the
    last one of a dialogue with its cost and illegal neighbours. edits: pos (at),
    inserted turns' initials before and after, the edit, the new initial.
    """

    def __init__(self, turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        self.scratch = scratch = Scratch(turns.sparkSession, "repair")
        conv = column(conv_col)
        rows = turns.select(
            conv.alias("conv"),
            F.when(conv.isNull(), "-").otherwise(F.concat(F.lit("+"), conv.cast("string"))).alias("key"),
            column(turn_col).cast("long").alias("turn"),
            F.coalesce(column(role_col).cast("string"), F.lit(" ")).alias("role"),
            F.coalesce(column(text_col).cast("string"), F.lit(" ")).alias("text"),
        )
        order = ["key", F.asc_nulls_first("turn"), "role", "text", "tie"]
        dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
        self.turns = scratch.save(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "turns")
        bare = F.rtrim("text", F.lit(SPACES))
        same = F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
        told = self.turns.select("key", "part", "pos", "turn", F.substring("role", 1, 1).alias("initial"), F.unhex(same).alias("same"), F.when(bare == "", "blank").otherwise(F.when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")).alias("look"))
        told = scratch.save(told, "told")
        first = scratch.save(told.groupBy("key", "same").agg(F.min("pos").alias("first")), "first")
        fault = F.when(F.col("look") == "blank", "blank").when(F.col("pos") > F.col("first"), "duplicate").otherwise(F.col("look"))
        self.facts = scratch.save(told.join(first, ["key", "same"]).select("key", "part", "pos", "turn", "initial", fault.alias("fault")), "facts")
        scratch.drop("told", "first")
        narrow = self.facts.select("key", "part", "pos", "initial", "fault")
        parts = narrow.repartition("key", "part").sortWithinPartitions("key", "part", "pos").mapInArrow(_parts, "key string, part int, first string, last string, illegal long, costs array<long>, ranks array<int>")
        plans = parts.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_plans, "key string, part int, begin int, end int, run string, cost long, illegal long")
        self.plans = scratch.save(plans, "plans")
        routes = self.plans.select("key", "part", "begin", "end", "run")
        traced = narrow.join(routes, ["key", "part"]).select(*narrow.columns, "begin", "end", "run").repartition("key", "part").sortWithinPartitions("key", "part", "pos")
        self.edits = scratch.save(traced.mapInArrow(_traced, "at long, before string, edit string, to string, after string"), "edits")

    def edited(self) -> DataFrame:
        """(conv, key, pos, turn, role, text, before, edit, to, after) of every turn."""
        return self.turns.join(self.edits, F.col("pos") == F.col("at")).select("conv", "key", "pos", "turn", "role", "text", "before", "edit", "to", "after")

    def repaired(self) -> DataFrame:
        """(conv, key, pos, step, edit, role, text): the turns of the repaired dialogues,
        in order by pos and step."""
        called = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
        put = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.struct(F.lit("I").alias("edit"), F.element_at(called, x).alias("role"), F.lit("").alias("text")))
        own = F.struct("edit", F.when(F.col("edit") == "R", F.element_at(called, F.col("to"))).otherwise(F.col("role")).alias("role"), "text")
        mine = F.filter(F.array(own), lambda x: x["edit"] != "D")
        return self.edited().select("conv", "key", "pos", F.posexplode(F.concat(put("before"), mine, put("after"))).alias("step", "x")).select("conv", "key", "pos", "step", "x.*")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edited turns in order to each dialogue's audit and the hash of what it has become."""

    def made() -> Iterator[tuple]:
        for key, rows in groupby((r for b in sliced(batches, 500) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), itemgetter(0)):
            h, audit, begun = hashlib.sha256(), [], False
            for _, _, role, text, before, edit, to, after in rows:
                now = [(NAMES[x], "") for x in before]
                if edit != "D":
                    now.append((NAMES[to] if edit == "R" else role, text))
                audit.append("I" * len(before) + edit + "I" * len(after))
                for role_, text_ in [*now, *((NAMES[x], "") for x in after)]:
                    h.update(("\n" * begun + f"{role_}:{text_}").encode())
                    begun = True
            yield key, "".join(audit), h.hexdigest()

    return _batched(made(), pa.schema([("key", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())]), 500)


def audits(repair: Repair) -> DataFrame:
    """A row for each dialogue that has turns: key, gaps, counts of faults and
    illegal neighbours, cost, audit, and the SHA-256 of the repaired turns as
    role:text lines. A hash goes over its dialogue from the beginning, so the
    turns of one pass through one task, a few at a time."""
    n = lambda what: F.count_if(F.col("fault") == what).alias(what)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    counts = repair.facts.groupBy("key").agg(gaps, n("blank"), n("duplicate"), n("truncated"))
    costs = repair.plans.where("cost is not null").select("key", "illegal", "cost")
    rows = repair.edited().select("key", "pos", "role", "text", "before", "edit", "to", "after").repartition("key").sortWithinPartitions("key", "pos")
    return counts.join(costs, "key").join(rows.mapInArrow(_digests, "key string, audit string, repaired_sha256 string"), "key")


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns with faults by crc32 of "id:turn" modulo 20: 0 is dropped, 1 loses its
    text, 2 its marks .!?, 3 comes twice, 4 becomes the user's. Nulls are one space
    in that key, and null roles and texts become one."""
    one = lambda c: F.coalesce(column(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(one(conv_col), F.lit(":"), one(turn_col)).cast("binary")) % 20
    rows = turns.select(column(conv_col).alias(conv_col), column(turn_col).alias(turn_col), one(role_col).alias(role_col), one(text_col).alias(text_col), lot.alias("_lot")).where("_lot <> 0")
    text = F.when(F.col("_lot") == 1, "").when(F.col("_lot") == 2, F.translate(column(text_col), ".!?", "")).otherwise(column(text_col))
    rows = rows.withColumns({text_col: text, role_col: F.when(F.col("_lot") == 4, "user").otherwise(column(role_col))})
    return rows.withColumn("_copy", F.explode(F.when(F.col("_lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_lot", "_copy")


def damage_audits(turns: DataFrame) -> DataFrame:
    """audits() of damaged(turns) for every conv_id of turns, those that have lost
    all their turns included."""
    every = turns.select("conv_id").distinct().withColumn("key", F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string"))))
    found = every.join(audits(Repair(damaged(turns))), "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    counts = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
