"""SimHash and suffix dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import minhash
from folio.llm.graph import components
from folio.llm.minhash import jaccard_dedup
from folio.llm.simhash import fingerprint, near_dedup, simhash_groups
from folio.llm.suffix import PRIMES, Hashed, powers, remove_repeats, suffix_digest
from folio.runtime import Scratch

SCHEMA = "doc_id long, text string, fp string, root int, n_chars long"


def frame(spark, texts, start=0):
    """Extra columns clash with names that the operators use inside."""
    return spark.createDataFrame([(i + start, t, "x", 1, len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def brute_print(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(prints))]


def test_fingerprint_by_definition():
    for t in ("", None, "one", "Two words", "a b c d e a b c", "Ünï Çode ÀB\x0bx y", "w " * 70000):
        assert fingerprint((t or "").encode()) & (2**64 - 1) == brute_print(t)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + rng.randrange(20), 200 + rng.randrange(20)) for _ in range(15)] + [(300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    near = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got[n] == min(seen)
    assert set(got) == set(near)


def test_groups_like_brute_force(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(150)) for _ in range(12)]
    texts = []
    for b in base:
        words = b.split()
        texts.append(b)
        for _ in range(4):
            w = words[:]
            w[rng.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    texts += [None, "", "  \n", "x", "x", "X", base[0]]
    got = {r.doc_id: r for r in simhash_groups(frame(spark, texts)).collect()}
    prints = [brute_print(t) for t in texts]
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == dict(enumerate(prints))
    assert {i: r.component_id for i, r in got.items()} == dict(enumerate(brute_components(prints)))


def test_dedup_keeps_one_row_of_each_group(spark):
    d = frame(spark, ["a b c d e f", "A b c d e f", "quite another text here now", None, ""]).union(frame(spark, ["a b c d e f"]))
    left = near_dedup(d)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [0, 2, 3]
    # an id that two groups share, and rows without one
    odd = d.union(frame(spark, ["yet another text of its own", "a b c d e f", "a b c d e f"], 2)).withColumn("doc_id", F.when(F.col("doc_id") < 4, F.col("doc_id")))
    assert sorted((r.doc_id for r in near_dedup(odd).collect()), key=str) == [0, 2, 2, 3, None, None]
    empty = d.where("false")
    assert simhash_groups(empty).count() == 0 and near_dedup(empty).count() == 0


def brute_likeness(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in (a, b)))
    return len(a & b) / len(a | b)


def test_stage_drops_edited_copies(spark):
    rng = random.Random(11)
    texts = []
    for edits in (1, 2, 4, 6, 30, 60):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
        texts.append(" ".join(words))
        for _ in range(3):
            w = words[:]
            for at in rng.sample(range(300), edits):
                w[at] = "new"
            texts.append(" ".join(w))
    texts += [texts[0].upper(), "quite short", "Quite  short", "quite other"]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if brute_likeness(texts[i], texts[j]) >= 0.8:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    got = [r.doc_id for r in corpus_pipeline.simhash_dedup(spark, frame(spark, texts), "").collect()]
    assert sorted(got) == sorted(set(root)) and len(got) < len(texts) - 8


def families(n, seed=5):
    """Texts on one template: pairs of a family have a likeness of about 0.84, others of about 0.6."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    template = [word() for _ in range(400)]
    for _ in range(n // 2):
        base = template[:]
        for at in rng.sample(range(400), 10):
            base[at] = word()
        near = base[:]
        for at in rng.sample(range(400), 7):
            near[at] = word()
        out += [" ".join(base), " ".join(near)]
    return out


@pytest.mark.parametrize("n", [1000])
def test_no_link_is_lost_in_a_crowd(spark, n):
    texts = families(n)
    group = {r["doc_id"]: r["group"] for r in minhash.jaccard_groups(frame(spark, texts)).collect()}
    alike = [k for k in range(0, n, 2) if brute_likeness(texts[k], texts[k + 1]) >= 0.8]
    linked = sum(group[k] == group[k + 1] for k in alike)
    assert len(alike) > 0.45 * n and linked >= 0.99 * len(alike)
    # what is joined is a family, or a pair that is really alike
    by = {}
    for k, g in group.items():
        by.setdefault(g, []).append(k)
    for of in by.values():
        assert len(of) == 1 or all(any(brute_likeness(texts[k], texts[j]) >= 0.8 for j in of if j != k) for k in of)


def test_whatever_stays_crowded_is_compared(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LEVELS", 1)
    texts = families(300)
    group = {r["doc_id"]: r["group"] for r in minhash.jaccard_groups(frame(spark, texts)).collect()}
    assert all((group[k] == group[k + 1]) == (brute_likeness(texts[k], texts[k + 1]) >= 0.8) for k in range(0, 300, 2))


def test_stage_keeps_odd_rows(spark):
    d = frame(spark, ["a b c d e f", None, "", "a b c d e f"])
    odd = d.union(d.withColumn("doc_id", F.lit(None).cast("long")))
    left = corpus_pipeline.simhash_dedup(spark, odd, "")
    assert left.columns == odd.columns and sorted((r.doc_id for r in left.collect()), key=str) == [0, 1, None, None, None, None]
    assert corpus_pipeline.simhash_dedup(spark, d.where("false"), "").count() == 0


def brute_spans(texts, span):
    seen = {}
    for t in texts:
        for p in range(len(t) - span + 1):
            seen[t[p : p + span]] = seen.get(t[p : p + span], 0) + 1
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - span + 1):
            if seen[t[p : p + span]] > 1:
                gone[p : p + span] = b"\x01" * span
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        yield len(t), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(left).hexdigest()


def suffix_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(80), prose(300)
    texts = [prose(rng.randint(1, 200)) for _ in range(12)]
    texts += [texts[0] + passage + texts[1], texts[2] + "\n" + passage, passage[:399], passage[:400], passage[3:]]
    texts += [long, long, long[:700] + "X" + long[701:], long[100:900] + prose(20) + long[300:]]
    texts += ["a" * 1000, "ab" * 600, "a" * 399, "a" * 400, None, "", passage * 3, long[:500] + "é" + long[500:]]
    # the same words around a difference in either direction
    texts += [prose(30) + long[i : i + 450] + prose(30) for i in (0, 10, 60, 61)]
    return texts


def test_removed_bytes_like_brute_force(spark):
    texts = suffix_texts()
    want = dict(enumerate(brute_spans([(t or "").encode() for t in texts], 400)))
    d = frame(spark, texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_digest(d).collect()}
    assert got == want
    # rows that share an id are still rows of their own
    twice = d.where("doc_id < 3").withColumn("doc_id", F.lit(9).cast("long"))
    raw = [(r.text or "").encode() for r in twice.union(twice).collect()]
    rows = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_digest(twice.union(twice)).collect())
    assert rows == sorted(brute_spans(raw, 400))
    assert suffix_digest(d.where("false")).count() == 0


def test_texts_without_repeats_stay_valid(spark):
    texts = ["é" * 500 + "x", "yy" + "é" * 500, "alone", None, ""]
    out = {r.doc_id: r for r in remove_repeats(frame(spark, texts), length_col="n_chars").collect()}
    assert (out[0].text, out[1].text, out[2].text, out[3].text, out[4].text) == ("x", "yy", "alone", None, "")
    assert (out[0].n_chars, out[1].n_chars, out[2].n_chars) == (1, 2, 5)


def brute_passages(texts, width):
    """The words of each text in passages of so many words that are found twice."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    for w in words:
        hit = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                hit |= set(range(i, i + width))
        yield hit


def test_passages_of_words_like_brute_force(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(n))
    one, two = prose(51), prose(140)
    texts = [prose(rng.randint(1, 150)) for _ in range(10)]
    texts += [f"{prose(40)} {one} {prose(10)}", f"{one}\n{prose(70)}", one.replace(" ", "\n\t"), " ".join(one.split()[1:]) + " " + prose(60)]
    texts += [two, f"{prose(20)} {two}", " ".join([*two.split()[:60], "é", *two.split()[61:]]), "a " * 200, "a b " * 60, "", None, "x" * 900]
    found = list(brute_passages(texts, 51))
    got = {r.doc_id: r.n_repeated_words for r in suffix_digest(frame(spark, texts), words=51).collect()}
    assert got == {i: len(hit) for i, hit in enumerate(found)} and sum(map(bool, got.values())) >= 8
    left = {r.doc_id: r.text for r in remove_repeats(frame(spark, texts), span=2000, words=51).collect()}
    for i, (t, hit) in enumerate(zip(texts, found, strict=True)):
        assert (left[i] or "").split() == [w for k, w in enumerate((t or "").split()) if k not in hit]


def test_names_tell_thue_morse_words_apart():
    t = "a"
    for _ in range(10):
        t += t.translate(str.maketrans("ab", "ba"))
    h = Hashed(np.frombuffer((t + t.translate(str.maketrans("ab", "ba"))).encode(), np.uint8))
    one, two = h.named(np.array([0, 1024]), np.array([1024, 2048]))
    assert one != two
    for prime, base in PRIMES:
        up, down = powers(prime, base)
        assert all(int(a) * int(b) % prime == 1 for a, b in zip(up[:3000:7], down[:3000:7], strict=True)) and int(up[5]) == pow(base, 5, prime)


def test_clashing_names_of_columns(spark):
    """Columns named like the operators' own come back as they were."""
    names = ["spans", "passages", "s", "e", "s2", "e2", "key", "mark", "one", "two", "id", "th", "_th", "_id", "group", "x", "_x", "_s"]
    d = frame(spark, ["y" * 500 + "a", "y" * 500 + "b", "b c", None, "", "b c"]).select("doc_id", "text", *(F.lit(7).alias(n) for n in names))
    d = d.union(d.where("doc_id = 2"))
    for left in (remove_repeats(d, words=51), near_dedup(d), jaccard_dedup(d)):
        rows = left.collect()
        assert left.columns == d.columns and rows and all(r[2:] == (7,) * len(names) for r in rows)


@pytest.mark.parametrize("span", [100])
def test_short_thresholds_are_refused(spark, span):
    with pytest.raises(ValueError):
        suffix_digest(frame(spark, ["x"]), span=span)
