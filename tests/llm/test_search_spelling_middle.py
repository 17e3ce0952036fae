"""Top-k search, spelling variants and fill-in-middle against brute force, with odd rows, hot keys and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelake.llm import fill_middle, pivot_search, spelling_variants

# ---- exact top-k


def best_by_brute_force(rows, k, step, scale=256):
    """rows: (id, list or None). Every pair, with Python's own integers."""
    whole = []
    for at, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v):
            whole.append((at, i, [math.floor(scale * x) for x in v]))
    out = []
    for at, i, v in whole:
        if i is None or i % step:
            continue
        scored = [(-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j is None, j or 0) for other, j, w in whole if other != at and len(w) == len(v)]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def searched(spark, rows, schema="vec_id long, embedding array<double>, row long, shelf int, v string, score string, rank int", **how):
    df = spark.createDataFrame([(*r, 1, 2, "v", "s", 3) for r in rows], schema).repartition(5)
    return sorted((tuple(r) for r in pivot_search.top_k(df, **how).collect()), key=repr)


def test_search_with_odd_vectors_ties_and_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(-40, 200)]
    rows += [(i, [0.25, 0.0, -0.5, 0.1, 0.0, 0.3]) for i in range(200, 320)]  # a third are one vector
    rows += [(10, [0.1] * 6), (10, [0.1] * 6), (10, [0.1] * 6), (None, [0.3] * 6), (None, [0.3] * 6)]
    rows += [(400, None), (401, []), (410, []), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (410, [float("nan")] * 6), (420, [float("inf")] + [0.0] * 5)]
    rows += [(430, [1.0, 2.0]), (440, [3.0, -1.0]), (450, [7.0]), (460, [1e308] * 6)]
    want = best_by_brute_force(rows, 5, 10)
    assert searched(spark, rows, query_step=10) == want
    assert searched(spark, rows, query_step=10, pivots=3, sample=20, shelf=16, annulus=4, group=3) == want


def test_search_with_scores_beyond_doubles(spark):
    rows = [(i, [float(2**40 + i), 3.0, float(-i)]) for i in range(60)] + [(100 + i, [1e30 * (i % 3), 1.0, -1e30]) for i in range(9)]
    want = best_by_brute_force(rows, 4, 10)
    assert searched(spark, rows, query_step=10, k=4) == want


def test_search_of_few_rows_and_none(spark):
    assert searched(spark, [(0, [0.1, 0.2])]) == [] and searched(spark, [(50, [0.1]), (1, [0.5])]) == [(50, 1, 1, 25 * 128)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pivot_search.top_k(empty).collect() == []


def test_annuli_are_searched_only_as_far_as_their_bounds_reach():
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(0, 60, (400, 8)))
    centres = pivot_search.fit_pivots(v, 6)
    far = pivot_search.distances(v, centres)
    own = far.argmin(axis=1)
    for q in range(0, 400, 37):
        for p in range(len(centres)):
            d = far[own == p, p]
            if len(d):
                ring = {"lo": d.min(), "hi": d.max(), "norm": (v[own == p] ** 2).sum(axis=1).max()}
                assert pivot_search._bound((v[q] ** 2).sum()[None], far[q: q + 1, p], ring)[0] >= (v[own == p] @ v[q]).max()


# ---- spelling variants

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def variants_by_brute_force(docs, least=7, deletes=31, least_count=2, ratio=10):
    counts = Counter()
    for i, text in docs:
        for w in RUNS.findall(text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if deletes and h % deletes == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            counts[w] += len(w) >= least
    n = {w: c for w, c in counts.items() if c >= least_count}

    def edits(w):
        rest = [w[:k] + w[k + 1:] for k in range(len(w))]
        return {("cut", r) for r in rest} | {("at", k, r) for k, r in enumerate(rest)}

    near, by = defaultdict(set), defaultdict(set)
    for w in n:
        for e in edits(w):
            by[e].add(w)
    for (kind, *_, rest), ws in by.items():
        if kind == "at":
            for a in ws:
                near[a] |= ws - {a}
        elif rest in n:
            near[rest] |= ws
            for a in ws:
                near[a].add(rest)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-n[x], x))
            if n[best] >= ratio * n[w]:
                form[w] = best

    def last(w):
        while w in form:
            w = form[w]
        return w

    return {(w, c, len(near[w]), form.get(w), n.get(form.get(w)), last(w)) for w, c in n.items()}


def variants(spark, docs, **how):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], "doc_id long, text string, word string, n long, form string").repartition(4)
    got = [(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling_variants.spelling_variants(df, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_variants_of_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, "Colours COLOURS coloürs colours, colourss ÀÉÎõûabc àéîõûabc×÷ ßßßßßßßß"), (3, "colours colours"), (3, "colours colours"), (None, "colours colourz colourz"),
            (None, None), (4, "abcdefghi " * 3000), (5, "q" * 4000 + " " + "q" * 4000), (6, "abcdefgh abcdefgh x 日本語日本語日本語日本語")]
    want = variants_by_brute_force(docs)
    assert variants(spark, docs) == want and len(want) == 5
    assert variants(spark, [(1, None)]) == set() and variants(spark, []) == set()
    with pytest.raises(ValueError):
        spelling_variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), least=6)


@pytest.mark.parametrize("common", [0, 3, 32, 10_000])
def test_variants_of_crowded_words(spark, common):
    rng = random.Random(common)
    words = ["aaaaaaa"] + ["".join(rng.choice("abé") for _ in range(rng.randint(6, 10))) for _ in range(900)]  # dense neighbourhoods, hot grams
    words += ["interna" + "".join(rng.choice("tional") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    docs = [(i, " ".join(rng.choices(words, k=200) + ["aaaaaaa"] * 100)) for i in range(30)]
    assert variants(spark, docs, common=common, deletes=7) == variants_by_brute_force(docs, deletes=7)


def test_forms_are_followed_to_the_last(spark):
    chain = [("abcdefgh", 2), ("abcdefg", 20), ("abcdefx", 200), ("abcdyfx", 2000), ("abzdyfx", 20000)]
    docs = [(1, " ".join(f"{w} " * n for w, n in chain))]
    got = {r[0]: r for r in variants(spark, docs, deletes=0)}
    assert {r[5] for r in got.values()} == {"abzdyfx"} and got["abcdefg"][3] == "abcdefx"


def test_an_edit_spares_all_grams_but_the_affected():
    rng = random.Random(1)
    made = ["".join(rng.choice("abc") for _ in range(rng.randint(7, 12))) for _ in range(400)]
    held = frozenset(w[p: p + q] for w in made for q in (2, 3, 4) for p in range(len(w)) if rng.random() < 0.3)
    for w in made:
        found = spelling_variants.grams(w, held)
        most = spelling_variants.affected(w, found, held)
        assert most < len(found)
        k, c = rng.randrange(len(w) + 1), rng.choice("abcd")
        for other in (w[:k] + c + w[k:], w[:k] + w[k + 1:], w[:k] + c + w[k + 1:]):
            there = spelling_variants.grams(other, held)
            kept = sum(any(p + s < len(there) and there[p + s] == g for s in {0, len(other) - len(w)} if p + s >= 0) for p, g in enumerate(found))
            assert kept >= len(found) - most


# ---- fill-in-middle

TOKENS = re.compile("[A-Za-z]+|[^A-Za-z]")


def middle_by_rule(i, text):
    text = text or ""
    w = TOKENS.findall(text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(w), "plain", None, None, text
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(w), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_middles_of_odd_texts(spark):
    rng = random.Random(8)
    texts = [None, "", "a", "é", " ", "x" * 300_000, "word and 12 words, " * 9000, "日本語 🎉 abcé́ def" * 900, "has <P> in it", "<S", "<<M>>", "< P>a<S <M", "\n\n\t ", "a\x00b", "ÀÀ" * 20_000]
    texts += ["".join(rng.choice(["ab", "Zq", " ", "\n", "é", "🎉", "<", ">", "P", "S", "M", "7"]) for _ in range(rng.randint(0, 3000))) for _ in range(250)]
    rows = [(k - 3, t) for k, t in enumerate(texts)] + [(None, "no id but text"), (None, None), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, form string, n long, output string").repartition(3)
    got = fill_middle.fill_middle(df).withColumn("back", fill_middle.restored("output", "form")).collect()
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == Counter((i, *middle_by_rule(i, t)) for i, t in rows)
    assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(df.where(F.lit(False))).collect() == []


def test_chunks_cover_texts_and_shared_ones_are_read_once():
    rng = random.Random(4)
    passage = " ".join("".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 9))) for _ in range(3000)).encode()
    texts = [bytes([97 + k]) * (7 * k + 1) + passage + b" end" * k for k in range(20)]
    for data in [*texts, b"", b"x" * 50_000, "é".encode() * 30_000, "🎉".encode() * 9000]:
        ends = fill_middle.chunk_ends(np.frombuffer(data, np.uint8))
        pieces = [data[a:b] for a, b in zip([0, *ends], ends)]
        assert b"".join(pieces) == data and all(0 < len(p) <= fill_middle.LARGEST for p in pieces)
        [p.decode() for p in pieces]
    known = fill_middle.Summaries()
    for t in texts:
        assert known.cuts(t, 5, 9)[0] == len(TOKENS.findall(t.decode()))
    once = len(fill_middle.chunk_ends(np.frombuffer(texts[0], np.uint8)))
    assert known.read < once + 3 * len(texts)  # only the chunks at the ends are each text's own
    small = fill_middle.Summaries(remembered=4000)
    for t in texts:
        assert small.cuts(t, 77, 123_456) == known.cuts(t, 77, 123_456)
    assert sum(map(len, small.young)) + sum(map(len, small.old)) <= 4000 + 2 * fill_middle.LARGEST
