"""Near dedup on families of texts: the same classes as by brute force from few comparisons."""

from __future__ import annotations

import random

from gradelake.llm import near_dedup
from test_text_operators import brute_classes


def compared_pairs(monkeypatch):
    seen = []
    plain = near_dedup.compared

    def count(pairs, *rest):
        seen.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(near_dedup, "compared", count)
    return seen


def classes(spark, texts):
    return {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}


def test_texts_of_one_passage_are_not_all_compared(spark, monkeypatch):
    rng = random.Random(11)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(90)]
    texts = {i: " ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(60)]) for i in range(200)}
    texts |= {1000 + i: texts[i] + " end" for i in range(10)}
    seen = compared_pairs(monkeypatch)
    got = classes(spark, texts)
    assert all(got[1000 + i] == i for i in range(10)) and len(set(got.values())) == 200
    assert sum(seen) <= 40  # 200 texts hold 19,900 pairs


def test_a_cloud_of_copies_joins_by_its_least_changed_text(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    texts = {}
    for i in range(150):
        own = list(base)
        for at in rng.sample(range(150), i % 6):
            own[at] = f"own{i}x{at}"
        texts[i] = " ".join(own)
    seen = compared_pairs(monkeypatch)
    assert classes(spark, texts) == brute_classes(texts)
    assert sum(seen) <= 3000  # of 11,175
