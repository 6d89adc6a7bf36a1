"""Quality rules, mixing, pieces, scores, digests, licences, records, dialogues."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from dataclasses import replace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from folio.llm import chat, digest, licences, mil, mixing, pieces, quality_rules, warc
from folio.llm.queries import PIECES


def frame(spark, texts):
    return spark.createDataFrame([(i, t, ["en", None][i % 2], f"s{i % 3}" if i % 4 else None, 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int")


TEXTS = [None, "", "  \n ", "one", "w " * 25, "\n".join(["same line here", "same line here", "", "", "other"]), "a b c d e f g h i a b c d e f g h x " + "z " * 9, "Ü#é* $x | <b> 100% & co\x0bnew", " ".join(str(i) for i in range(500)), "x" * 5000]


def brute_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), again, len(inside)


def test_counts_by_definition():
    rng = random.Random(2)
    for t in [*TEXTS, *(" ".join(rng.choice("abc") for _ in range(60)) for _ in range(20))]:
        assert quality_rules.counts((t or "").encode())[:5] == brute_counts(t)


def test_binomial_tail():
    for n, p in ((10, 0.3), (200, 0.01), (57, 0.5)):
        for k in range(n + 1):
            assert math.isclose(quality_rules.at_most(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9, abs_tol=1e-12)


def test_cutoffs_need_a_certificate():
    gaps = lambda good, bad: [(good, 0), *[(0, 0)] * (len(quality_rules.RULES["symbols"][1]) - 1), (0, bad)]
    assert quality_rules.choose({("en", "symbols"): gaps(5000, 90)}, 0.03, 0.05)["en"]["symbols"] == 0.5
    assert not quality_rules.choose({("en", "symbols"): gaps(50, 90)}, 0.03, 0.05)
    assert not quality_rules.choose({("en", "symbols"): [(900, 0), *[(0, 0)] * 8, (100, 200)]}, 0.03, 0.05)
    # strata that are too small alone are tested as one
    small = {(s, "symbols"): gaps(60, 9) for s in ("de", "es", "fr")}
    assert quality_rules.choose(small, 0.03, 0.05) == {s: {"symbols": 0.5} for s in ("de", "es", "fr")}
    assert set(quality_rules.choose(small | {("en", "symbols"): gaps(400, 9)}, 0.03, 0.05)) == {"de", "en", "es", "fr"}
    assert not quality_rules.choose({k: gaps(20, 9) for k in small}, 0.03, 0.05)


def plain_verdicts(docs, labels, risk=0.03, doubt=0.05):
    """kept of every row, with exact tail sums and row by row counts."""
    tail = lambda k, n: sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
    marks: dict = {}
    for i, q in labels:
        if q is not None:
            marks[i] = min(marks.get(i, 1), int(q >= 1))
    rows = []
    for i, t, lang, planned in docs:
        c = dict(zip(quality_rules.COUNTS, quality_rules.counts((t or "").encode()), strict=True))
        c["n_repeat_words"] = brute_counts(t)[4] if len(t or "") < 4000 else c["n_repeat_words"]
        ratio = {"symbols": c["n_symbols"] / max(c["word_chars"], 1), "shouting": c["n_upper"] / max(c["n_upper"] + c["n_lower"], 1), "marks": c["n_marks"] / max(c["n_words"], 1), "lines": c["n_dup_lines"] / max(c["n_lines"], 1), "repeats": c["n_repeat_words"] / max(c["n_words"], 1), "length": c["word_chars"] / max(c["n_words"], 1)}
        rows.append((i, lang or "", planned, c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"], ratio))
    labelled = [(lang, planned, marks[i], ratio) for i, lang, planned, failed, ratio in rows if not failed and i in marks]
    size = {lang: sum(1 for x in labelled if x[0] == lang and x[2]) for lang in {x[0] for x in labelled}}
    order = sorted((s for s in size if size[s]), key=lambda s: (-size[s], s))
    least = lambda names: (1 - risk) ** sum(size[s] for s in names)
    for k in range(len(order), -1, -1):
        groups = [[s] for s in order[:k]]
        if sum(map(least, groups)) > doubt:
            continue
        if order[k:] and sum(map(least, [*groups, order[k:]])) <= doubt:
            groups.append(order[k:])
        if groups:
            break
    cuts: dict = {}
    for group in groups:
        level = least(group) + (doubt - sum(map(least, groups))) / len(groups)
        good = [x for x in labelled if x[0] in group and x[2]]
        bad = [x[3] for x in labelled if x[0] in group and not x[2]]
        tested, drawn = [x[3] for x in good if not x[1]], [x[3] for x in good if x[1]]
        if tail(0, len(tested) // 2) > level:
            tested, drawn = [x[3] for x in good], []
        now, best = {r: math.inf for r in quality_rules.RULES}, 0
        while True:
            nexts = []
            for number, (r, (_, levels)) in enumerate(quality_rules.RULES.items()):
                over = lambda some, c, r=r: sum(x[r] > c for x in some)
                tighter = [c for c in reversed(levels) if c < now[r] and over(bad, c) > over(bad, now[r])]
                if tighter:
                    more_bad = over(bad, tighter[0]) - over(bad, now[r])
                    nexts.append(((over(drawn, tighter[0]) - over(drawn, now[r])) / more_bad, -more_bad, number, r, tighter[0]))
            if not nexts:
                break
            *_, r, c = min(nexts)
            now[r] = c
            lost, caught = (sum(x[r] > c for x in some for r, c in now.items()) for some in (tested, bad))
            if tail(lost, len(tested)) > level:
                break
            if caught - 3 * lost > best:
                best = caught - 3 * lost
                cuts |= {s: dict(now) for s in group}
    return {i: not failed and not any(ratio[r] > c for r, c in cuts.get(lang, {}).items()) for i, lang, _, failed, ratio in rows}, cuts


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_verdicts_on_the_tables(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).collect()
    want, cuts = plain_verdicts(rows, [(r.doc_id, r.quality) for r in labels.collect()])
    got = quality_rules.quality_rules(docs, labels).collect()
    assert {r.doc_id: r.kept for r in got} == want
    if sf == "sf0.01":
        assert set(cuts) == {"en", "de", "fr", "es"} and any(r.rule for r in got)


def test_few_labels_certify_a_joint_filter():
    """As sf0.1 has them: 1,640 good rows for one rule were needed before."""
    size = {rule: len(cuts) for rule, (_, cuts) in quality_rules.RULES.items()}
    table = {(s, rule): [(good, 0), *[(0, 0)] * (size[rule] - 1), (0, 20)] for s, good in (("en", 1340), ("de", 325), ("fr", 326), ("es", 209)) for rule in ("symbols", "shouting", "marks")}
    rare = {("it", "marks"): [(20, 0), *[(0, 0)] * (size["marks"] - 1), (0, 20)]}
    got = quality_rules.choose(table | rare, 0.03, 0.05)
    assert set(got) == {"en", "de", "fr", "es"} and all(set(of) == {"symbols", "shouting", "marks"} for of in got.values())
    # the joint filter as a whole keeps to the risk: each rule alone could pass
    many = {("en", rule): [(980, 0), *[(0, 0)] * (size[rule] - 1), (20, 90)] for rule in ("symbols", "shouting", "marks", "lines")}
    assert sum(len(of) for of in quality_rules.choose(many, 0.03, 0.05).values()) == 1
    # rows that aren't tested put a costly rule behind the others, so that it doesn't stop them
    costly = {("en", rule): [(1000 - bad, 0), *[(0, 0)] * (size[rule] - 1), (bad, 50)] for rule, bad in (("symbols", 100), ("marks", 0))}
    drawn = {("en", rule): [500 - bad, *[0] * (size[rule] - 1), bad] for rule, bad in (("symbols", 50), ("marks", 0))}
    assert set(quality_rules.choose(costly, 0.03, 0.05, drawn)["en"]) == {"marks"}


def test_rules_reject_junk_and_keep_the_rest(spark):
    rng = random.Random(4)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(40))
    rows = [(i, prose() if i % 10 else " ".join(w + "###" for w in prose().split()), "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(3000)] + [(5, None, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, labels).collect()}
    assert got == {i: i % 10 > 0 for i in range(3000)}
    assert quality_rules.keep_good(docs, labels).count() == 2700
    odd = frame(spark, TEXTS)
    none = labels.where("false")
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.quality_rules(odd, none).collect()}
    for i, t in enumerate(TEXTS):
        c = brute_counts(t)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        assert found[i] == (*c, failed, not failed)
    kept = quality_rules.keep_good(odd, none)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {i for i in found if found[i][6]}
    assert quality_rules.quality_rules(odd.where("false"), none).count() == 0


def test_knapsack_is_exact():
    rng = random.Random(8)
    for _ in range(60):
        sizes = np.array(sorted(rng.sample(range(1, 30), rng.randint(1, 5))))
        counts = np.array([rng.randint(0, 4) for _ in sizes])
        budget = rng.randint(0, 80)
        sums = {0}
        for s, c in zip(sizes, counts, strict=True):
            sums = {x + k * s for x in sums for k in range(c + 1)}
        take = mixing.knapsack(sizes, counts, budget)
        assert (take <= counts).all() and (take >= 0).all() and abs((take * sizes).sum() - budget) == min(abs(x - budget) for x in sums)
    big, n = np.array([3, 50, 999, 100_001]), np.array([10**6, 10**6, 10**5, 40])
    assert (mixing.fit(big, n, 77_777_777) * big).sum() == 77_777_777


def test_mix_hits_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 7, 50]))), f"src{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(600)]
    rows += [(1000 + i, "x y z", None) for i in range(9)] + [(2000, None, "src1"), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r.asDict() for r in mixing.mix_sources(docs).collect()]
    assert len(got) == len(rows)
    size: dict = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = [*sorted(s for s in size if s), None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        target = {s: 3.0 * size[s] if s in capped else rest * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        above = {s for s in names if target[s] > 3 * size[s]}
        if not above:
            break
        capped |= above
    of = {i: s for i, _, s in rows}
    taken: dict = {}
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == size[s] and math.isclose(r["target"], target[s]) and r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(key(r) for r in mixing.mix_sources(docs.repartition(7)).collect())
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and sum(len(r.text.split()) for r in copies.collect()) == sum(taken.values())
    assert mixing.mix_sources(docs.where("false")).count() == 0


def test_mix_shares_takes_among_equal_rows(spark):
    """A hot row: what is left over of its takes are copies of one, in several places."""
    rows = [(1, "a b", "s", 7)] * 2500 + [(i, "c d", "s", i) for i in range(2, 40)] + [(None, "e f g", None, 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    got = mixing.mixed_documents(docs).collect()
    taken = {True: 0, False: 0}
    for r in mixing.mix_sources(docs).collect():
        taken[r.doc_id is None] += r.taken
    assert sum(2 for r in got if r.doc_id is not None) == taken[False] and sum(3 for r in got if r.doc_id is None) == taken[True]
    assert all(r.n == {1: 7, None: 1}.get(r.doc_id, r.doc_id) for r in got)


def test_clashing_names_of_columns(spark):
    """Columns named like the operators' own come back as they were."""
    names = ["_n", "n", "_key", "key", "mark", "one", "two", "rows", "spare", "_rows", "_at", "_copy", "_id", "id", "draw", "stratum", "_stratum", "counts", "_counts", "doc", "_doc", "_text", "rule", "cuts", "base_failed", "Kept"]
    d = spark.createDataFrame([(i, " ".join(f"w{i}{k}" for k in range(25)), "en", f"s{i % 3}") for i in range(12)], "doc_id long, text string, lang string, source string").select("*", *(F.lit(7).alias(n) for n in names))
    d = d.union(d.where("doc_id = 2"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    for out in (quality_rules.keep_good(d, none), mixing.mixed_documents(d), pieces.encode_documents(d, PIECES)):
        rows = out.collect()
        assert out.columns[: len(d.columns)] == d.columns and rows and all(r[4 : 4 + len(names)] == (7,) * len(names) for r in rows)
    assert quality_rules.quality_rules(d, none).count() == 13 and mil.quality_scores(d, none).count() == 13


def test_pieces_like_the_library(spark):
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.Codec(pieces.Vocabulary.load(PIECES))
    rng = random.Random(6)
    parts = ["a", " ", "  ", "th", "er", "\n", "é", "日本語", "▁", "😀", "ing", "<0x0A>", "0", "--", "\t", "aaaa", "import ", "s.", "n't", "É", "\x00", "‍"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["a" * 5000, "日" * 700, "ab" * 900 + "é", "x" * 41 + " y"]
    for t in texts:
        assert codec.encode(t) == sp.encode(t)
        assert codec.decode(codec.encode(t)) == sp.decode(sp.encode(t))
    docs = frame(spark, [*TEXTS, *texts[:50]]).withColumn("ids", F.lit("clash"))
    for r in pieces.encode_documents(docs, PIECES).collect():
        if r.text is None:
            assert (r.n_ids, r.ids, r.exact) == (None, None, None)
        else:
            assert r.ids == sp.encode(r.text) and r.n_ids == len(r.ids) and r.exact == ("▁" not in r.text)
    assert pieces.encode_documents(docs.where("false"), PIECES).count() == 0


def test_search_streams_over_unsplit_texts():
    """Whole texts in one search, without cuts and memory: the library's ids, given
    out in many runs, with a window that a text's length doesn't widen."""
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.Codec(pieces.Vocabulary.load(PIECES), 1)
    rng = random.Random(12)
    docs = [" ".join("".join(rng.choice(["th", "er", "in", "on", "a", "e", "é", "st", "s", ".", "日"]) for _ in range(rng.randint(1, 5))) for _ in range(n)) for n in (3, 80, 900, 3000)]
    for t in [*docs, "a" * 3000, "x y\nz" * 500, "日本" * 600]:
        s = "▁" + t.replace(" ", "▁")
        codec.heads.clear()
        widest, extend = 0, codec.extend

        def counted(s, off, back, *rest):
            nonlocal widest
            extend(s, off, back, *rest)
            widest = max(widest, len(back))

        codec.extend = counted
        runs = [codec.ids_of(run) for run in codec.search(s)]
        codec.extend = extend
        assert [i for run in runs for i in run] == sp.encode(t)
        assert widest <= 6 * codec.longest + 4 * codec.STRIDE and (len(s) < 1000 or len(runs) > 3)


def test_unigram_paths_have_the_best_score():
    rng = random.Random(3)
    names = ["<unk>", "▁", *"abc", "▁a", "ab", "bc", "abc", "ca", "cab", "▁ab", "aa", "aaa"]
    v = pieces.Vocabulary(names, [0.0, *(-rng.uniform(1, 9) for _ in names[1:])], "unigram", 0, frozenset([0]))
    codec = pieces.Codec(v)
    cost = {n: s for n, s in zip(names, v.scores, strict=True)}
    for _ in range(200):
        t = "".join(rng.choice("abc z") for _ in range(rng.randint(1, 150)))
        best = {0: 0.0}
        s = "▁" + t.replace(" ", "▁")
        for i in range(1, len(s) + 1):
            best[i] = max([best[i - 1] + codec.low] * (s[i - 1] not in cost) + [best[j] + cost[s[j:i]] for j in range(max(0, i - 3), i) if s[j:i] in cost])
        got = codec.encode(t)
        if "z" not in t:
            assert "".join(names[i] for i in got) == s and math.isclose(sum(v.scores[i] for i in got), best[len(s)])


def test_search_tries_only_pieces_that_end_there():
    """Texts go through the states of the vocabulary, and no position looks up all
    the strings that end there; states are kept as the memory allows."""

    class Counted(dict):
        n = 0

        def __contains__(self, x):
            self.n += 1
            return dict.__contains__(self, x)

        def get(self, *x):
            self.n += 1
            return dict.get(self, *x)

    rng = random.Random(15)
    t = "".join(rng.choice(["th", "er", "in", " ", "on", "a", "é", "st", ".", "日", "\x00", "😀"]) for _ in range(3000))
    s = "▁" + t.replace(" ", "▁")
    want = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(t)
    for kind in ("bpe", "unigram"):
        codec = pieces.Codec(replace(pieces.Vocabulary.load(PIECES), kind=kind))
        first = [i for run in codec.search(s) for i in codec.ids_of(run)]
        codec.ids = Counted(codec.ids)
        assert [p for run in codec.search(s) for p in run] and codec.ids.n <= 2 * len(s)
        assert kind == "unigram" or first == want
        small = pieces.Codec(codec.v)
        small.most_steps = 50
        for k in range(0, len(s), 40):
            list(small.search(s[k : k + 40]))
            assert small.n_steps <= 50 + 41 * (1 + pieces.STATE) and len(small.heads) * (1 + pieces.STATE) <= small.n_steps
        assert [i for run in small.search(s) for i in small.ids_of(run)] == first


def test_gradients():
    rng = np.random.default_rng(0)
    model = mil.train([], np.zeros(0, np.float32))
    model.p = {k: rng.standard_normal(np.shape(v)) for k, v in model.p.items()}
    model.p["A"] /= 30
    x, starts, y = rng.standard_normal((6, mil.FEATURES)), np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model.forward(x, starts)["s"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    g = model.gradient(x, starts, y)
    for k in ("A", "a", "V", "U", "w", "c"):
        i = tuple(rng.integers(0, n) for n in model.p[k].shape)
        old = model.p[k][i]
        model.p[k][i] = old + 1e-5
        up = loss()
        model.p[k][i] = old - 1e-5
        down = loss()
        model.p[k][i] = old
        assert math.isclose(g[k][i], (up - down) / 2e-5, rel_tol=1e-4, abs_tol=1e-8)


def test_scores_by_plain_loops():
    """The model's score of a text, loop by loop."""
    rng = np.random.default_rng(4)
    model = mil.train([], np.zeros(0, np.float32), hidden=5, attention=3)
    model.p = {k: rng.standard_normal(np.shape(v)) / 4 for k, v in model.p.items()}
    model.mean, model.scale = rng.standard_normal(mil.FEATURES), rng.uniform(1, 3, mil.FEATURES)
    texts = ["", "a few words", "word " * 400, "é# " * 300 + "again and again and again " * 30]
    p = model.p
    for t, got in zip(texts, model.score([t.encode() for t in texts]), strict=True):
        hs, es = [], []
        for x in mil.passages(t.encode()):
            z = [(float(v) - m) / s for v, m, s in zip(x, model.mean, model.scale, strict=True)]
            h = [math.tanh(sum(z[i] * p["A"][i, j] for i in range(len(z))) + p["a"][j]) for j in range(5)]
            gate = [math.tanh(sum(h[j] * p["V"][j, k] for j in range(5))) / (1 + math.exp(-sum(h[j] * p["U"][j, k] for j in range(5)))) for k in range(3)]
            hs.append(h)
            es.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
        mean = [sum(e * h[j] for e, h in zip(es, hs, strict=True)) / sum(es) for j in range(5)]
        assert math.isclose(got, 1 / (1 + math.exp(-(sum(m * c for m, c in zip(mean, p["c"], strict=True)) + p["d"]))), rel_tol=1e-5)


def test_passages_by_plain_loops():
    """Bytes, byte pairs, words and repeated runs of each passage."""
    b = ("the same run of twenty-four bytes " * 3 + "é" * 300 + " tail").encode()
    x = mil.passages(b)
    assert len(x) == -(-len(b) // mil.PASSAGE) == 2
    starts = [i for i in range(len(b)) if b[i] not in b"\t\n\x0b\x0c\r " and (not i or b[i - 1] in b"\t\n\x0b\x0c\r ")]
    for k in range(2):
        part = range(k * mil.PASSAGE, min(len(b), (k + 1) * mil.PASSAGE))
        for v in range(256):
            assert math.isclose(x[k, v], math.log1p(sum(b[i] == v for i in part)), rel_tol=1e-5)
        pairs = [(b[i] * 167 + b[i + 1] * 59) % mil.HASHED for i in part if i + 1 < len(b)]
        assert all(math.isclose(x[k, 256 + h], math.log1p(pairs.count(h)), rel_tol=1e-5) for h in range(mil.HASHED))
        own = [i for i in starts if i in part]
        runs = [b[i : i + mil.GRAM] for i in starts if i + mil.GRAM <= len(b)]
        again = sum(runs.count(b[i : i + mil.GRAM]) > 1 for i in own if i + mil.GRAM <= len(b))
        assert math.isclose(x[k, -3], math.log1p(len(own)), rel_tol=1e-5) and math.isclose(x[k, -1], 4 * again / max(len(own), 1), rel_tol=1e-5)
        assert math.isclose(x[k, -2], math.log1p(len(starts)), rel_tol=1e-5)


def test_training_rows_are_whole_and_bounded(spark, monkeypatch):
    rows = [(i, "w " * (300 * (i % 3)), "en") for i in range(40)] + [(7, "w " * 300, "en")] * 3 + [(None, "x", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, None if i == 9 else i % 2) for i in range(40)] + [(8, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(mil, "train", lambda bags, y: seen.append((bags, y)))
    mil.fit(docs, labels)
    mil.fit(docs.repartition(3), labels, sample=10)
    mil.fit(docs, labels, passages_in_all=12)
    whole, few, short = ([len(b) for b in bags] for bags, _ in seen)
    free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2 and i != 9]
    assert sorted(whole) == sorted(max(1, -(-len("w " * (300 * (i % 3))) // mil.PASSAGE)) for i in free)
    assert len(few) == 10 and 10 <= sum(short) <= 12


def test_quality_scores_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    extra = docs.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**6)
    got = mil.quality_scores(docs.unionByName(extra), labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 60 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.collect()) and got.count() == 1002
    assert {r.score for r in mil.quality_scores(docs.limit(5), labels.where("false")).collect()} == {0.5}


def test_digests_of_neighbours(spark):
    rng = random.Random(1)
    texts = [*TEXTS, *("".join(rng.choice("abcdeé  ") for _ in range(rng.randint(1, 900))) for _ in range(30))]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in digest.neighbour_digests(docs.repartition(5)).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        t, u = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        e = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == digest.digest(digest.codes(t.encode())) and r.edited_fingerprint == digest.digest(digest.codes(e.encode()))
        assert r.near_edited == digest.likeness(digest.undigest(r.fingerprint), digest.undigest(r.edited_fingerprint)) and 0 <= r.near_next <= 1
    assert got[0].fingerprint == got[1].fingerprint and got[1].near_next == 1.0
    assert digest.neighbour_digests(docs.where("false")).count() == 0 and digest.neighbour_digests(docs.where("doc_id = 8")).first().near_next == 1.0
    brute = np.zeros(digest.BUCKETS, int)
    for i in range(len(b := texts[20].encode()) - 2):
        h = int.from_bytes(b[i : i + 3], "big") * 0x9E3779B1 & 0xFFFFFFFF
        brute[((h ^ h >> 15) * 0x85EBCA77 & 0xFFFFFFFF) >> 24] += 1
    assert (digest.bucket_counts(b) == brute).all()


def test_digests_of_ties_and_long_texts(spark):
    """Rows that share an id go by the hash of their text; null ids come last."""
    texts = [(3, "three"), (3, "drei"), (3, "three"), (2, "é" * 300_000), (2, None), (None, "nobody"), (1, "x " * 200_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = []
    for k, r in enumerate(order):
        t, u = r.text or "", order[(k + 1) % len(order)].text or ""
        e = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        want.append((r.doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), digest.digest(digest.codes(t.encode()))))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in digest.neighbour_digests(docs.repartition(4)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def licence_model(spark):
    return licences.train(spark)


def test_licences(spark, licence_model):
    texts = ["Some words.\n\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "licensed under cc by-sa 4.0", "You need a licence to drive this car.", None, "", "\n\n", "You need a licence to drive this car."]
    got = {r.doc_id: r for r in licences.licence_scan(frame(spark, texts), model=licence_model).collect()}
    assert [got[i].families for i in range(len(texts))] == [["Apache-2.0", "MIT"], ["GPL-3.0"], ["CC-BY-NC-4.0"], ["CC-BY-SA-4.0"], [], [], [], [], []]
    assert [got[i].n_paragraphs for i in range(len(texts))] == [2, 1, 1, 1, 1, 0, 0, 0, 1] and [f.line for f in got[0].findings] == [2, 3]
    assert licences.licence_scan(frame(spark, texts).where("false"), model=licence_model).count() == 0


def test_wrapped_licences(spark, licence_model):
    """Whole texts at narrow and wide columns, behind other paragraphs and in a long text."""
    names, texts = list(licences.TERMS), []
    for width in (40, 72, 10_000):
        texts += ["Copyright (c) 2020 J. Doe\n\n" + "\n\n".join(textwrap.fill(t, width) for t in licences.TERMS[f]) for f in names]
    texts.append("word of it\n" * 20_000 + "\n\n" + textwrap.fill(licences.TERMS["MIT"][0], 72))
    got = {r.doc_id: r for r in licences.licence_scan(frame(spark, texts), model=licence_model).collect()}
    for i, f in enumerate(names * 3):
        assert got[i].families == [f], (f, got[i])
    assert got[len(texts) - 1].families == ["MIT"] and got[len(texts) - 1].n_paragraphs == 2


def test_no_unrelated_sentence_is_taken(spark, licence_model):
    texts = [t for f, t in licences.held_out() if f == licences.UNKNOWN] + ["\n".join(licences.HELD_UNRELATED), " ".join(licences.UNRELATED)]
    assert not [r for r in licences.licence_scan(frame(spark, texts), model=licence_model).collect() if r.families]
    held = [(f, t) for f, t in licences.held_out() if f != licences.UNKNOWN]
    got = {r.doc_id: r for r in licences.licence_scan(frame(spark, [t for _, t in held]), model=licence_model).collect()}
    told = [{x.family for x in got[i].findings} for i in range(len(held))]
    assert sum(f in x for (f, _), x in zip(held, told, strict=True)) > 0.97 * len(held)
    assert sum(got[i].families == [f] for i, (f, _) in enumerate(held)) > 0.93 * len(held)


def plain_findings(text, model):
    """Findings by plain loops: grams, logits, softmax, share of a template's grams."""
    at, known = {g: i for i, g in enumerate(model.vocabulary)}, {w for g in model.vocabulary for w in g.split(" ")} - licences.STOP
    split = lambda t: re.sub(r"[.+-]*[^a-z0-9.+\x80-\U0010FFFF-]+[.+-]*", " ", f" {t.lower()} ").strip(" ").split(" ")
    hits = [(k, w) for k, line in enumerate((text or "").split("\n")) if set(w := split(line)) & known]
    runs, out = [], []
    for k, w in hits:
        if runs and runs[-1][-1][0] == k - 1:
            runs[-1].append((k, w))
        else:
            runs.append([(k, w)])
    for run in runs:
        found = []
        for unit in [*([x] for x in run), *([run] if len(run) > 1 else [])]:
            w = [x for _, words in unit for x in words]
            ids = {at[g] for g in [*w, *map(" ".join, zip(w, w[1:], strict=False))] if g in at}
            z = [(model.bias[c] + sum(model.weights[i][c] for i in ids)) / model.temperature for c in range(len(model.families))]
            best = max(range(len(z)), key=lambda c: (z[c], -c))
            p = 1 / sum(math.exp(x - z[best]) for x in z)
            near = [g for f, g in model.templates if f == best]
            if len(unit) > 1:
                near = [g for g in ([i for i in g if " " in model.vocabulary[i]] for g in near) if len(g) >= 3]
            likeness = max((len(ids & set(g)) / len(g) for g in near), default=0.0)
            if ids and best and p >= model.threshold:
                found.append((unit[0][0], len(unit), model.families[best], likeness))
        sure = [x for x in found if x[3] >= licences.CONFIRM]
        lines, whole = {x[2] for x in sure if x[1] == 1}, {x[2]: x[3] for x in sure if x[1] > 1}
        for x in found:
            if x[1] > 1 and x[2] not in lines or x[1] == 1 and (x[2] in whole or x[3] >= max(whole.values(), default=0) if x in sure else x[2] not in whole):
                out.append(x)
    return sorted(out)


def test_findings_by_plain_loops(spark, licence_model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text for r in docs] + [textwrap.fill(t, 50) for ts in licences.TERMS.values() for t in ts] + [t for _, t in licences.held_out()] + TEXTS
    got = {r.doc_id: r for r in licences.licence_scan(frame(spark, texts), model=licence_model).collect()}
    for i, t in enumerate(texts):
        want = plain_findings(t, licence_model)
        assert [(f.line, f.lines, f.family) for f in got[i].findings] == [x[:3] for x in want]
        assert all(math.isclose(f.similarity, x[3], abs_tol=1e-6) for f, x in zip(got[i].findings, want, strict=True))


def test_licence_lines_of_the_tables(spark, licence_model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    got = {r.doc_id: set(r.families) - {"Proprietary"} for r in licences.licence_scan(docs, model=licence_model).collect()}
    assert got == {r.doc_id: {f for line, f in want.items() if line in r.text.split("\n")} for r in docs.collect()}


def test_derivatives_link_to_their_response(spark):
    pages = spark.createDataFrame([(1, "http://a/", '<html lang="en"><title>T &amp; x</title><script>"</p>"</script><p>One<br>two &lt;3</p><a href="/l">go</a>'), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    source = {r.page_id: r for r in warc.responses(pages).collect()}
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 6
    for r in rows:
        assert r.refers_to == source[r.page_id].record_id and r.payload_digest == source[r.page_id].payload_digest
        assert r.content_length == len(r.block.encode()) and f"WARC-Refers-To: {r.refers_to}\r\n" in r.header and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
    block = {r.warc_type: r.block for r in rows if r.page_id == 1}
    assert block["conversion"] == "One\ntwo <3\ngo" and "outlink: /l L a/@href\r\n" in block["metadata"] and "http-status: 200\r\n" in block["metadata"]
    assert warc.derive(warc.responses(pages.where("false"))).count() == 0


def by_sql(sql, **tables):
    """The rows of an oracle over small tables, by column name."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, pa.Table.from_pylist([r.asDict() for r in df.collect()], df.schema and pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.dataType.simpleString()]) for f in df.schema])))
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return sorted(repr(sorted(zip(names, r, strict=True))) for r in found.fetchall())


def rows_of(df):
    return sorted(repr(sorted(r.asDict().items())) for r in df.collect())


def test_odd_pages_like_their_sql(spark):
    odd = [
        """<html lang=de><title>A &mdash; B &#8217;s &amp;lt; &unknown; & c &#x1F600;&#0;&#xD800;</title><a class='x' href='a?b=1&amp;c=2'>x</a><a href=plain>y</a><a  HREF = "sp aced">z</a><a data-href="no">w</a>""",
        "<html data-x='1' lang='fr'><p>caf&eacute;&nbsp;&#160;cr&egrave;me &lt;p&gt; &copy; &euro;5 &#39;q&apos; &quot;&#99999999; &#x; &;</p>",
        "&amp;amp; &AMP; &#65 &#65; a&b<br/>" + "x &lt; y\n" * 3000,
        None, "", "<p", "&", "<a href=>", "plain",
    ]
    pages = spark.createDataFrame([(i, f"http://{i}/", t) for i, t in enumerate([*odd, odd[0]])] + [(None, None, "<p>x")], "page_id long, url string, html string")
    assert rows_of(warc.derive(warc.responses(pages))) == by_sql(warc.oracle(), pages=pages)
    got = {(r.page_id, r.warc_type): r.block for r in warc.derive(warc.responses(pages)).collect()}
    assert "title: A — B ’s &lt; &unknown; & c 😀��\r\n" in got[0, "metadata"] and "language: de\r\n" in got[0, "metadata"]
    assert re.findall("outlink: (.*) L a/@href", got[0, "metadata"]) == ["a?b=1&c=2", "plain", "sp aced"]
    assert "language: fr\r\n" in got[1, "metadata"] and got[1, "conversion"].startswith("café crème <p> © €5 'q' \"")
    assert "http-content-type: text/html; charset=utf-8\r\nhttp-content-length: 8\r\n" in [b for (i, k), b in got.items() if i == 7 and k == "metadata"][0].replace("length: 9", "length: 8")


def test_what_a_page_never_shows_is_not_its_own(spark):
    page = """<!-- <html lang="xx"><title>old</title><a href="/gone">g</a> --><html lang="en"><script>var t = "<a href='/js'>j</a><title>no</title>";</script>
<style>a { content: "<a href=/css>" }</style><title>New <!-- and --> old</title><body><a href='/real'>r</a><SCRIPT type=x><a href=/too></SCRIPT ><a href="/last">l</a>"""
    pages = spark.createDataFrame([(1, "http://x/", page), (2, "u", "<script>never closed <a href=/a>")], "page_id long, url string, html string").withColumn("live", F.lit("own"))
    got = {(r.page_id, r.warc_type): r.block for r in warc.derive(warc.responses(pages)).collect()}
    meta = got[1, "metadata"]
    assert re.findall("outlink: (.*) L a/@href", meta) == ["/real", "/last"]
    assert "title: New <!-- and --> old\r\n" in meta and "language: en\r\n" in meta
    assert rows_of(warc.derive(warc.responses(pages))) == by_sql(warc.oracle(), pages=pages.drop("live"))


def test_long_and_odd_dialogues_like_their_sql(spark):
    rng = random.Random(3)
    rows = [(1, rng.choice([None, 5, 5, rng.randrange(4000)]), rng.choice(["ann", "bob", "system", None, "c d"]), rng.choice(["x", "hello there", None, "", "<|im_end|>"])) for _ in range(3000)]
    rows += [(rng.choice([None, 2, 3]), rng.randrange(3), rng.choice(["ann", "bob"]), "t" * rng.randrange(9)) for _ in range(200)] + [(4, 0, "system", "alone"), (5, 1, "ann", "y" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    want = by_sql(chat.oracle(), conversations=turns)
    assert rows_of(chat.perspectives(turns.repartition(7))) == want and len(want) > 9000
    assert chat.perspectives(turns.where("false")).count() == 0


def test_every_perspective(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", "Hey"), (1, 3000, "cy d", None), (2, 0, "system", "alone"), (None, None, None, "x"), (3, 0, "ann", "x"), (3, 0, "ann", "x")]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    one = sorted((r for r in got if r.conv_id == 1 and r.perspective == "bob"), key=lambda r: r.seq)
    text = "".join(r.rendered for r in one)
    assert text == "<|im_start|>system\nBe kind<|im_end|>\n<|im_start|>user name=ann\nHi < |im_end|><|im_end|>\n<|im_start|>assistant\nHey<|im_end|>\n<|im_start|>user name=cy_d\n<|im_end|>\n"
    assert all(text[r.char_start : r.char_end] == r.rendered for r in one)
    assert [text[r.mask_start : r.mask_end] for r in one if r.mask_start is not None] == ["Hey<|im_end|>"]
    assert {r.perspective for r in got if r.conv_id == 1} == {"ann", "bob", "cy d"} and not [r for r in got if r.conv_id == 2]
    assert [r.perspective for r in got if r.conv_id is None] == ["unknown"] and len([r for r in got if r.conv_id == 3]) == 2


def test_quick_patterns_are_equal():
    rng = random.Random(5)
    java = lambda p: re.compile(p.replace(r"\x{a0}", r"\xa0"))
    parts = ["<script>", "</script>", "<SCRIPT a>", "</script ", ">", "<style>", "</style>", "<title>", "</TITLE >", "<!--", "-->", "<", " ", "  ", "\n", "\t", "\xa0", "a", "&", "<b>"]
    for pattern, quick in warc.QUICK.items():
        to = r"\1 " if pattern == warc.SILENT else "\n" if pattern == warc.TIDY[1][0] else " "
        for _ in range(3000):
            s = "".join(rng.choices(parts, k=rng.randint(0, 14)))
            assert java(pattern).sub(to, s) == java(quick).sub(to, s), (pattern, s)


def test_page_text_is_worked_out_once(spark):
    plan = warc.derive(warc.responses(spark.createDataFrame([], "page_id long, url string, html string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("blockquote") == 1 and plan.count("charset\\s*=") == 1
