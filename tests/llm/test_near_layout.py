"""Near dedup: how texts are stored, and that texts hashed together have the sketches of texts hashed alone."""

from __future__ import annotations

import random

import numpy as np

from gradelake.llm import near_dedup
from gradelake.llm.wordtext import words


def some_texts(rng, n):
    return [" ".join(rng.choice("abcdefgh") if rng.random() < 0.3 else f"w{rng.randrange(10**6)}" for _ in range(rng.choice((0, 1, 4, 5, 6, 60, 64, 90, 300)))) for _ in range(n)]


def test_texts_are_one_file_a_bucket(spark):
    texts = some_texts(random.Random(1), 600)
    docs = spark.createDataFrame(list(enumerate(texts + texts[:50])), "doc_id long, text string").repartition(12)
    before = {t.name for t in spark.catalog.listTables()}
    assert near_dedup.near_dedup(docs).filter("class_size > 1").count() >= 100
    made = [t.name for t in spark.catalog.listTables() if t.name.startswith("llm_texts_") and t.name not in before]
    # it was one a bucket and input task, so that files grew with the square of the input
    assert made and all(len(spark.table(name).inputFiles()) <= 48 for name in made)


def test_signatures_only_of_texts_that_meet(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(90)) for _ in range(100)]
    texts += [texts[0] + " end", texts[1] + " end"]
    seen = []
    plain = near_dedup.signed
    monkeypatch.setattr(near_dedup, "signed", lambda table, size: seen.append(table.count()) or plain(table, size))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i - 100 if i >= 100 else i for i in range(102)} and seen == [4]


def test_texts_hashed_together():
    texts = [None, "", *some_texts(random.Random(3), 200), " ".join("ab"[i % 2] for i in range(400))]
    for size in (5, 1):
        for text, (found, s) in zip(texts, near_dedup.read(texts, size), strict=True):
            assert found == words(text) and (s == near_dedup.shingles(words(text), size)).all()
            assert len(set(s.tolist())) == len(s) == (max(1, len(found) - size + 1) if found else 0)


def test_sketches_take_the_least_hashes_in_text_order(monkeypatch):
    s = near_dedup.shingles(words(" ".join(some_texts(random.Random(4), 40))))
    got = near_dedup.sketch(s, 7, 4)
    for k, seed in enumerate(near_dedup.SEEDS[:7]):
        out = seed
        for at in sorted(np.argsort(s * (seed | np.uint64(1)))[:4]):
            out = near_dedup.mixed(np.array([out * near_dedup._ODD + s[at]]))[0]
        assert out == got[k]
    monkeypatch.setattr(near_dedup, "BLOCK", 100)
    assert (near_dedup.sketch(s, 7, 4) == got).all() and len(s) > 200
