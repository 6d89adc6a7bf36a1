"""Conversation repair, ranked search and token counts against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import repair, tokens, treaps
from folio.llm.queries import BYTE_PAIRS, QUERIES, TOKENIZERS

TURNS = "conv_id long, turn long, role string, text string"
VALID = re.compile(r"(s?(ua)+)?")


def brute_edits(initials, faults):
    """The cheapest edits by trying all of them, with up to two inserts at a place."""
    runs = [(r, len(r) * 3) for n in range(3) for r in map("".join, itertools.product("ua", repeat=n))]
    best = None
    choices = []
    for x, fault in zip(initials, faults, strict=True):
        stay = 3 * (fault == "truncated")
        edits = [("D", 4, "")] + ([] if fault in ("blank", "duplicate") else [("K", stay, x), ("R", 3 + stay, "u"), ("R", 3 + stay, "a")])
        choices.append([("I" * len(r) + e, c + k, r + to, r, e) for r, c in runs for e, k, to in edits])
    choices.append([("I" * len(r), c, r, r, "") for r, c in runs])
    for way in itertools.product(*choices):
        cost = sum(w[1] for w in way)
        if (best is None or cost <= best[0]) and VALID.fullmatch("".join(w[2] for w in way)):
            x = (cost, "".join(w[0] for w in way))
            best = x if best is None or x < best else best
    return best


def plain_edits(initials, faults):
    """The same for longer dialogues: least (cost, audit) of each state, audits as strings."""
    after = lambda s, x: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((s, x))

    def inserted(now):
        for _ in range(3):
            for s, (c, a) in list(now.items()):
                for x in "ua":
                    t = after(s, x)
                    if t is not None and (t not in now or (c + 3, a + "I") < now[t]):
                        now[t] = (c + 3, a + "I")
        return now

    def walks(s0):
        """All runs of up to two inserts."""
        out = [(s0, 0, "")]
        for n in (1, 2):
            for r in itertools.product("ua", repeat=n):
                s = s0
                for x in r:
                    s = s is not None and after(s, x) or None
                if s:
                    out.append((s, 3 * n, "I" * n))
        return out

    now = {"": (0, "")}
    for x, fault in zip(initials, faults, strict=True):
        new = {}
        stay = 3 * (fault == "truncated")
        for s0, (c0, a0) in now.items():
            for s, c, a in walks(s0):
                found = [(s, 4, "D")]
                if fault not in ("blank", "duplicate"):
                    found += [(after(s, x), stay, "K"), (after(s, "u"), 3 + stay, "R"), (after(s, "a"), 3 + stay, "R")]
                for t, k, e in found:
                    if t is not None and (t not in new or (c0 + c + k, a0 + a + e) < new[t]):
                        new[t] = (c0 + c + k, a0 + a + e)
        now = new
    return min((c0 + c, a0 + a) for s0, (c0, a0) in now.items() for s, c, a in walks(s0) if s in ("", "a"))


def by_layers(initials, faults, cuts=()):
    """The same by Steps over parts, put together, and traced."""
    steps, rows = repair.Steps(), list(zip(initials, faults, strict=True))
    borders = [0, *cuts, len(rows)]
    parts = []
    for lo, hi in itertools.pairwise(borders):
        layer, cost = repair.IDENTITY, 0
        for x, f in rows[lo:hi]:
            layer, off, _ = steps.step(layer, x, f)
            cost += off
        parts.append([x and (x[0] + cost, x[1]) for x in layer])
    cost, states, run = repair.composed(parts)
    audit = ""
    for (lo, hi), begin, end in zip(itertools.pairwise(borders), states, states[1:], strict=False):
        layer, back = tuple((0, 0) if s == begin else None for s in range(4)), []
        for x, f in rows[lo:hi]:
            layer, _, by = steps.step(layer, x, f)
            back.append(by)
        found, state = [], end
        for by in reversed(back):
            m = by[state]
            found.append("I" * len(m[4]) + m[5])
            state = m[0]
        audit += "".join(reversed(found))
    return cost, audit + "I" * len(run)


FAULTS = ["", "", "", "blank", "duplicate", "truncated"]


def test_edits_like_all_edits():
    rng = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(60 if n < 3 else 12):
            x, f = [rng.choice(["s", "u", "a", "t", " "]) for _ in range(n)], [rng.choice(FAULTS) for _ in range(n)]
            want = brute_edits(x, f)
            assert plain_edits(x, f) == want
            if n:
                assert by_layers(x, f) == want, (x, f)


def test_parts_give_the_same_edits():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(2, 40)
        x, f = [rng.choice("suuaaut") for _ in range(n)], [rng.choice(FAULTS) for _ in range(n)]
        want = plain_edits(x, f)
        cuts = sorted(rng.sample(range(1, n), rng.randrange(0, min(5, n))))
        assert by_layers(x, f, cuts) == want
    # cheapest audits that differ late
    assert by_layers("uauauaua" * 30, [""] * 240, [100, 200]) == (0, "K" * 240)


def plain_damage(rows):
    one = lambda v: " " if v is None else v
    for conv, turn, role, text in rows:
        lot, role, text = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20, one(role), one(text)
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        yield from [(conv, turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)


def plain_repair(rows):
    """Result rows by loops over each dialogue."""
    by = {conv: [] for conv, *_ in rows}
    for r in plain_damage(rows):
        by[r[0]].append(r[1:])
    for conv, of in by.items():
        of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in of:
            bare = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in of]
        cost, audit = plain_edits(initials, faults)
        out, k = [], 0
        for e in audit:
            last = out[-1][0][:1] if out else ""
            who = "assistant" if last == "u" else "user"
            if e == "I":
                out.append((who, ""))
                continue
            if e == "K":
                out.append(of[k][1:])
            elif e == "R":
                out.append((who, of[k][2]))
            k += 1
        turns = [t for t, _, _ in of if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials))
        n = Counter(faults)
        yield conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def told(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def test_repair_of_the_table(spark):
    got = QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.01")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = sorted(plain_repair(rows), key=repr)
    assert told(got) == want
    assert len(want) == 100 and len({w[7] for w in want}) > 20


def test_repair_of_odd_and_long_dialogues(spark):
    rng = random.Random(4)
    rows = [(None, k % 7 if k % 5 else None, rng.choice(["user", "assistant", None, "", "tool"]), rng.choice(["Yes.", "No", None, "", " \n", "a" * 3000 + "?"])) for k in range(60)]
    rows += [(9, k, rng.choice(["user", "assistant"]), f"{k} " + rng.choice(["x.", "y", "z!"])) for k in range(3000)]
    rows += [(5, None, "system", "Be."), (5, None, "system", "Be."), (6, 0, "é", "Ü."), (7, 1, "user", "a"), (7, 1, "user", "b.")]
    rows += [(c, 0, "user", "Alone.") for c in range(100, 160)]  # some lose their only turn
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", key string, pos int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the long one lies in several ranges
    try:
        got, want = told(repair.damage_audits(df)), sorted(plain_repair(rows), key=repr)
        made = repair.Repair(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want
    assert any(w[7] == "" for w in want)
    assert made.plans.groupBy("key").count().agg(F.max("count")).first()[0] > 1
    form = made.repaired().orderBy("key", "pos", "step").select("key", "role", "text").collect()
    for _, of in itertools.groupby(form, lambda r: r["key"]):
        assert VALID.fullmatch("".join(r["role"][:1] for r in of))
    assert repair.damage_audits(df.limit(0)).count() == 0


# --- ranked search

P = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(t):
    return P.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_ranked(docs, items, k=50):
    counts = [(i, Counter(brute_terms(t))) for i, t in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n_docs, n_terms, df = len(counts), sum(n for _, _, n in counts), Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in items:
        words, found = set(brute_terms(text)), []
        for i, c, n in counts:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_treaps_are_treaps():
    rng = np.random.default_rng(3)
    for n in (1, 2, 500):
        order = rng.integers(0, 40, n)
        left, right = treaps.treaps(np.array([0, n]), order)

        def walk(i, out, above, left=left, right=right, order=order):
            if i >= 0:
                assert above is None or order[i] <= above
                walk(left[i], out, order[i])
                out.append(i)
                walk(right[i], out, order[i])

        root, out = (set(range(n)) - set(left) - set(right)).pop(), []
        walk(root, out, None)
        assert out == list(range(n))


@pytest.mark.parametrize("postings", [60, 100_000])
def test_search_like_brute_force(spark, monkeypatch, postings):
    rng = random.Random(postings)
    vocabulary = ["der", "die", "x1", "é", "straße", "zug", *(f"w{k}" for k in range(60))]
    text = lambda n: " ".join(min(rng.choice(vocabulary), rng.choice(vocabulary)) for _ in range(n))
    docs = [(k // 2 * 3, text(rng.randrange(0, 60))) for k in range(400)] + [(9000 + k, "same Words, here; W1") for k in range(90)] + [(None, "der Zug w5"), (None, None), (7, ""), (8, "--- \n"), (5000, "w3 " * 30_000 + "é")]
    items = [(1, text(12)), (1, text(12)), (2, "same words here"), (None, "ZUG É der"), (4, None), (5, ""), (6, "absent"), *((10 + k, text(20)) for k in range(12))]
    monkeypatch.setattr(treaps, "POSTINGS", postings)
    made = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, item string").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    # the closure takes the bound to the workers
    got = treaps.ranked_search(made, asked)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_ranked(docs, items)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert treaps.ranked_search(made.limit(0), asked).count() == 0 == treaps.ranked_search(made, asked.limit(0)).count()
    monkeypatch.setattr(treaps, "ITEMS_AT_ONCE", 200)
    assert sorted(map(tuple, treaps.ranked_search(made, asked, 3).collect()), key=repr) == brute_ranked(docs, items, 3)


def test_search_leaves_most_of_a_segment():
    """The traversal scores few documents where a few stand out."""
    rng = np.random.default_rng(5)
    n, per = 4000, 6
    sizes = np.full(n, 40)
    terms = np.concatenate([np.sort(rng.choice(400, per, False)) for _ in range(n)]).astype(np.int32)
    tfs = np.ones(n * per, np.int64)
    tfs[: 60 * per] = 9
    terms[: 60 * per] = np.tile(np.arange(per), 60)
    row = treaps._segment(list(range(n)), sizes, terms, tfs, np.full(n, per), n, int(sizes.sum()))
    index = treaps.Index([row[0], *row[2:]], row[1], np.full(400, 1000))
    best, scored = treaps.Best(50, 0), []
    add = best.add
    best.add = lambda s, *a: (scored.append(len(s)), add(s, *a))
    index.search(np.arange(per), best)
    assert set(best.ids) == set(range(50)) and sum(scored) < n / 8


# --- token counts


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


ODD = [None, "", " ", "a", "Hello  world\n\n x", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "naïve 日本語 " * 50, "can't won't I'll", "x" * 200_000, ("lorem  ipsum dolor, it's 42 <|endoftext|> \n" * 5000), "word " * 60_000 + "   end", "é" * 40_000 + " tail", "\u0085   \x1c a b"]


def test_counts_like_the_library(spark, tmp_path):
    whole = library(BYTE_PAIRS)
    rows = [(k if k else None, t) for k, t in enumerate(ODD)] + [(3, "a"), (3, "a"), (99, "a")]
    df = spark.createDataFrame([(*r, 5, b"d") for r in rows], "doc_id long, text string, n_tokens int, digest binary").repartition(3)
    want = []
    for i, t in rows:
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    got = tokens.token_counts(df, BYTE_PAIRS)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert tokens.token_counts(df.limit(0), BYTE_PAIRS, str(tmp_path / "none")).count() == 0


def test_parts_count_as_the_whole():
    c, rng = tokens.Counter(BYTE_PAIRS), random.Random(7)
    assert c.splits and not tokens.Counter(f"{TOKENIZERS}/word_bpe_49k.json").splits
    for _ in range(20):
        t = "".join(rng.choice(["word", " ", "  ", "\n", "é", "1", ".", "'s", "_", "<|endoftext|>", "　", "\x1c"]) for _ in range(30_000))
        assert len(list(c.parts(t))) > 1
        assert c.counts([t, "", t[:10]]) == [len(c.of.encode(x, add_special_tokens=False).ids) for x in (t, "", t[:10])]


def test_pieces_count_as_their_texts(monkeypatch):
    rng, whole = random.Random(11), library(BYTE_PAIRS)
    bits = ["a", "'s", "'", "''ll", "é", "ß", "\u0130", " ", "  ", "\n", "\t", "1", "½", ".", "-_", "x'Re", "日", "\u00a0", "\x1f", "\x85", "<|endoftext|>", "<|end", "\u2028", "\r\n"]
    texts = ["".join(rng.choice(bits[: rng.choice([17, len(bits)])]) for _ in range(rng.randrange(40))) for _ in range(4000)]
    want = [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    c = tokens.Counter(BYTE_PAIRS)
    assert c.counts(texts) == want == c.counts(texts) and c.known
    monkeypatch.setattr(tokens, "PIECES", 30)
    monkeypatch.setattr(tokens, "AT_ONCE", 100)
    c.known.clear()
    assert c.counts(texts) == want and len(c.known) < 200


def test_only_misses_are_encoded_and_kept(spark, tmp_path):
    cache, frame = str(tmp_path / "cache"), lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = lambda: {p.name: spark.read.option("recursiveFileLookup", True).parquet(str(p)).count() for p in (tmp_path / "cache").iterdir()}
    first = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(frame(["one two", "one two", None, ""]), BYTE_PAIRS, cache).collect()}
    made = tokens.version(BYTE_PAIRS)
    assert first[0] == first[1] == 2 and files() == {made: 2}
    # a stored count is taken as it is, and only the new text is added
    digest = bytearray(hashlib.sha256(b"stored").digest())
    spark.createDataFrame([(digest, 77)], tokens.STORED).write.parquet(f"{cache}/{made}/other")
    again = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(frame(["stored", "one two", "three"]), BYTE_PAIRS, cache).collect()}
    assert again == {0: 77, 1: 2, 2: 1} and files() == {made: 4}
    # counts of two jobs side by side
    spark.createDataFrame([(digest, 77)], tokens.STORED).write.parquet(f"{cache}/{made}/twin")
    assert tokens.token_counts(frame(["stored"] * 3), BYTE_PAIRS, cache).count() == 3
    # another vocabulary has counts of its own
    words, squeezed = f"{TOKENIZERS}/word_bpe_49k.json", lambda c: F.regexp_replace(c, r"\s+", " ")
    got = tokens.token_counts(frame(["Stored  text", "Stored text"]), words, cache, normalise=squeezed, note="white space").collect()
    assert {r["n_tokens"] for r in got} == {len(library(words).encode("Stored text", add_special_tokens=False).ids)} and sorted(files().values()) == [1, 5]


def test_registered_queries_of_this_file(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_ranked_search"](spark, sf).collect()), key=repr) == brute_ranked(docs, items)
    whole = library(BYTE_PAIRS)
    want = {i: len(whole.encode(t or "", add_special_tokens=False).ids) for i, t in docs}
    assert {r["doc_id"]: r["n_tokens"] for r in QUERIES["op13_token_counts"](spark, sf).collect()} == want
