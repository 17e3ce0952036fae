"""The pipeline against the same decisions made in plain Python."""

from __future__ import annotations

import hashlib

from conftest import FOLDER
from test_text_operators import brute_classes

import corpus_pipeline
from gradelake.llm.decontaminate import Windows, hits_in_shard
from gradelake.llm.wordtext import words


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_pipeline_decisions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = corpus_pipeline.keep_good_texts(spark, docs, FOLDER)
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(i in texts for i, q in labels.items() if q == 1) and sum(i in texts for i, q in labels.items() if q == 0) <= 1
    last = {}
    for i, t in texts.items():
        key = hashlib.sha256(lowered(t).encode()).digest()
        last[key] = max(last.get(key, i), i)
    texts = {i: texts[i] for i in last.values()}
    classes = brute_classes(texts)
    texts = {i: t for i, t in texts.items() if classes[i] == i}
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    window = Windows(items)
    ids = sorted(texts)
    hits = hits_in_shard([words(texts[i]) for i in ids], window)
    want = [i for i, (hit, _) in zip(ids, hits) if not (len(hit) and 20 * len(hit) >= len(words(texts[i])))]
    got = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert sorted(got.doc_id) == want and not got.duplicated(["bucket", "batch", "place"]).any()
    assert all(len(texts[i].split()) == n for i, n in zip(got.doc_id, got.length))
