"""The text operators against SQL, brute force, exact round trips and held-out rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import compare, duck
from conftest import FOLDER

from gradelake.llm import (
    decontaminate, exact_dedup, fm_index, language_id, line_templates, near_dedup, packing, quality_rules, sharding, substring_dedup, token_counts)
from gradelake.llm.queries import QUERIES, SQL, TOKENIZERS
from gradelake.llm.wordtext import words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    problems, _ = compare(spark, duck(FOLDER), FOLDER, QUERIES[name], SQL[name])
    assert not problems


# ---- token counts

def test_token_counts_equal_the_tokenizer(spark, docs, rows):
    sentencepiece = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("tokenizers")
    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = tokenizers.Tokenizer(tokenizers.models.Unigram(
        [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], unk_id=0, byte_fallback=True))
    vocabulary = token_counts.read_vocabulary(path)
    odd = ["  a  b", "\t\nx", "日本語 🎉 x", "a" * 300, "▁▁x y▁z", " " * 50, "x" * 5000 + " yes", "ÄÖÜ" * 100]
    counter = token_counts.Counter(vocabulary)
    for text in odd:
        assert counter.count(text) == len(whole.encode("▁" + text.replace(" ", "▁")).ids), text[:20]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, vocabulary).collect()}
    assert got == {i: len(whole.encode("▁" + r["text"].replace(" ", "▁")).ids) for i, r in rows.items()}


def test_token_ties_take_the_longest_last_piece():
    v = token_counts.Vocabulary((("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("aaa", -3.0)), -3.0, False)
    # all paths score alike; the last piece is the longest possible, and so on backwards
    assert token_counts.Counter(v).best("▁aaa") == (-4.0, 2)
    assert token_counts.Counter(v).best("▁zz")[1] == 3


# ---- decontamination

def test_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    for n, top in ((1, 2), (50, 2), (400, 3), (700, 9)):
        s = rng.integers(0, top + 1, n)
        index = fm_index.FMIndex(s)
        patterns = [rng.integers(1, top + 1, rng.integers(1, 5)) for _ in range(60)]
        table = np.zeros((60, 4), dtype=np.int64)
        for row, p in zip(table, patterns):
            row[: len(p)] = p
        lo, hi = index.search(table, np.array([len(p) for p in patterns]))
        for p, a, b in zip(patterns, lo, hi):
            want = [i for i in range(n - len(p) + 1) if (s[i: i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("block_bytes,shard_words", [(16 << 20, 1 << 20), (300, 60)])
def test_decontamination_in_blocks_and_shards(spark, docs, block_bytes, shard_words):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").unionByName(
        spark.createDataFrame([(900, "the"), (901, "of the"), (902, None), (903, "... !"), (None, "and the of zzz")], "item_id long, text string"))
    items = [(str(r["item_id"]).replace("None", "null"), words(r["text"])) for r in bench.collect()]
    windows = [(i, tuple(w[k: k + 13])) for i, w in items if w for k in range(max(1, len(w) - 12))]
    by = {}
    for i, w in windows:
        by.setdefault(w, set()).add(i)
    sizes = {len(w) for w in by}
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench, shard_words=shard_words, block_bytes=block_bytes).collect()}
    for r in docs.collect():
        w = words(r["text"])
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k: k + n])) in by:
                    hit.update(range(k, k + n))
                    found |= by[g]
        row = got[r["doc_id"]]
        assert (row["n_words"], row["n_hit"], row["items"]) == (len(w), len(hit), sorted(found))
        data = r["text"].encode()
        assert row["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
        assert sum(s["last"] - s["first"] + 1 for s in row["word_spans"]) == len(hit)
        assert [x for s in row["byte_spans"] for x in words(data[s["start"]:s["end"]].decode())] == [w[k] for k in sorted(hit)]


# ---- repeated strings

def repeats(texts, length):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        data = t.encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            if (w := data[p: p + length]) in seen:
                gone[p: p + length] = [True] * length
            seen.add(w)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in df.collect()}


def test_repeated_strings_by_brute_force(spark, docs, rows):
    assert result(substring_dedup.substring_dedup(docs)) == repeats({i: r["text"] for i, r in rows.items()}, 100)


def test_repeated_strings_in_small_alphabets(spark, monkeypatch):
    rng = random.Random(5)
    texts = {i: "".join(rng.choice("ab") for _ in range(rng.randrange(0, 90))) for i in range(60)} | {60: "ab" * 60, 61: "a" * 90, 62: "ba" * 30, 63: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = repeats(texts, 12)
    assert result(substring_dedup.substring_dedup(df, length=12, seed=4, sizes=(4, 1))) == want
    assert result(substring_dedup.substring_dedup(df, length=12, seed=12, sizes=(1,))) == want


# ---- shards

def test_shards_are_even_and_gapless(spark, docs, rows, tmp_path):
    got = sharding.shard_documents(docs, 7, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    size, slots = Counter(), {}
    for r in got:
        text = rows[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(7))
    assert max(size.values()) - min(size.values()) <= max(r["size"] for r in got)


def test_map_edits_move_little():
    weights = {s: (random.Random(s).randrange(50, 150), 1) for s in range(1000)}
    held = sharding.first_map(weights, 10)
    assert sharding.edited_map(held, weights, 10) == held or len(set(held.values())) == 10
    grown = sharding.edited_map(held, weights, 11)
    moved = [s for s in held if grown[s] != held[s]]
    load = Counter()
    for s, k in grown.items():
        load[k] += weights[s][0]
    assert len(moved) < 130 and max(load.values()) - min(load.values()) < 150
    assert sharding.first_map({s: (0, 0) for s in range(8)}, 3).keys() == set(range(8))


def test_map_versions_stay_readable(spark, tmp_path):
    weights = {0: (5, 1), 1: (7, 2)}
    sharding.save_map(spark, str(tmp_path), 1, {0: 0, 1: 1}, weights)
    sharding.save_map(spark, str(tmp_path), 2, {0: 1, 1: 1}, weights)
    assert [r["shard"] for r in sharding.load_map(spark, str(tmp_path), 1).orderBy("vslot").collect()] == [0, 1]


# ---- line templates

def test_templates_generalise_fields(spark):
    texts = [(i, f"Page {i} of {i + 7} printed by host{i}\nown {'a' * (i + 1)} line {'b' * (i + 2)} here {'c' * (i + 3)}\nAll rights reserved .") for i in range(8)]
    texts += [(20, "Report for user Anna was sent to printer"), *[(21 + k, f"Report for user {n} was sent to printer") for k, n in enumerate("Bo Cy Di Ed Flo".split())]]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(texts, "doc_id long, text string"), support=0.5).collect()}
    assert all(got[i]["n_dropped"] == 2 and got[i]["kept"].startswith("own a") for i in range(8))
    assert all(got[i]["kept"] == "" and got[i]["n_dropped"] == 1 for i in range(20, 26))


# ---- quality and language

def test_quality_on_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = quality_rules.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9 and got.score.between(0, 1).all()


def test_quality_rules_hold_alike_in_spark(spark, docs):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality_rules.STATS)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] < 0.7)).astype(float)
    model = quality_rules.fit(x, y, trees=20)
    df = spark.createDataFrame(x.tolist(), [quality_rules.PREFIX + s for s in quality_rules.STATS])
    got = np.array([r[0] for r in df.select(model.column()).collect()])
    total = model.intercept + sum(w * quality_rules.holds(x, r) for r, w in model.rules)
    assert np.allclose(np.sort(got), np.sort(1 / (1 + np.exp(-total)))) and ((got >= 0.5).mean() - y.mean()) < 0.1
    assert ((1 / (1 + np.exp(-total)) > 0.5) == y).mean() > 0.97


def test_network_gradients():
    rng = np.random.default_rng(2)
    w = {k: v.astype(np.float64) for k, v in language_id.fresh(3, rng, hidden=4, embed=3).items()}
    x = rng.integers(97, 103, (7, 5)).astype(np.uint8)
    live = (np.arange(7)[:, None] < np.array([7, 7, 4, 1, 6])[None]).astype(np.float64)[:, :, None]
    y, weight = np.array([0, 1, 2, 0, 1]), np.array([1.0, 0.5, 2.0, 1.0, 1.0])

    def loss():
        p, _, _ = language_id.probabilities(w, x, live)
        mass = live * weight[None, :, None]
        return float(-(np.log(p[:, np.arange(5), y])[:, :, None] * mass).sum() / mass.sum())

    g = language_id.gradients(w, x, live, y, weight)
    for k in w:
        at = np.unravel_index(int(np.abs(g[k]).argmax()), g[k].shape)
        kept, step = w[k][at], 1e-5
        w[k][at] = kept + step
        up = loss()
        w[k][at] = kept - step
        down = loss()
        w[k][at] = kept
        assert abs((up - down) / (2 * step) - g[k][at]) < 1e-7 + 1e-4 * abs(g[k][at]), k


def test_language_on_held_out_rows(spark, docs, rows):
    got = [r for r in language_id.languages(docs).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in got]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_every_language_is_learnt(spark):
    rng = random.Random(9)
    texts = [(i, " ".join(rng.choice(["the", "and", "of", "house"]) for _ in range(200)), "en") for i in range(2000)]
    texts += [(3000 + i, " ".join(rng.choice(["der", "und", "von", "haus"]) for _ in range(20000)), "de") for i in range(8)]
    texts += [(4000 + i, f"sõna {i}", "et") for i in range(8)] + [(5000, "", "xx")]
    rows, lengths, y, langs = language_id.training_pieces(spark.createDataFrame(texts, "doc_id long, text string, lang string"), 60, 300)
    assert langs == ["de", "en", "et"] and len(rows) == len(lengths) == len(y) <= 300
    n = np.bincount(y, minlength=3)
    assert n[0] == n[1] == 100 and 0 < n[2] <= 8


# ---- near duplicates

def brute_classes(texts):
    found = {i: words(t) for i, t in texts.items()}
    s = {i: near_dedup.shingles(w) for i, w in found.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and len(s[a]) and len(s[b]) and near_dedup.aligned(s[a], s[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_near_classes_by_brute_force(spark, docs, rows):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(docs).collect()}
    assert got == brute_classes({i: r["text"] for i, r in rows.items()})


def test_chains_of_edits_are_one_class(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = {}
    for i in range(40):
        texts[i] = " ".join(base)
        base[rng.randrange(300)] = f"new{i}"
    texts[90] = " ".join(f"x{rng.randrange(10**6)}" for _ in range(300))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_classes(texts) and set(got.values()) == {0, 90}


def test_near_pairs_in_a_large_passage_bucket(spark):
    rng = random.Random(6)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(170)]
    own = [[f"w{rng.randrange(10**9)}" for _ in range(30)] for _ in range(400)]
    texts = {i: " ".join(passage + w) for i, w in enumerate(own)}
    texts |= {1000 + i: " ".join(passage + own[i][:15] + [f"x{rng.randrange(10**9)}" for _ in range(10 + i % 10)]) for i in range(100, 130)}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_classes(texts) and sum(got[1000 + i] == i for i in range(100, 130)) == 30


def test_alignment_is_the_longest_common_chain():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(5, 60))
        a = rng.permutation(200)[:n].astype(np.uint64)
        b = a.copy()
        for _ in range(int(rng.integers(0, 8))):
            b[rng.integers(0, n)] = rng.integers(1000, 10**6)
        if rng.random() < 0.4:
            k = int(rng.integers(0, n))
            b = np.concatenate([b[k:], b[:k]])
        b = np.array(list(dict.fromkeys(b.tolist())), dtype=np.uint64)
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        common = int(table[-1, -1])
        assert near_dedup.aligned(a, b) == (5 * common >= 4 * (len(a) + len(b) - common))


# ---- packing

def test_buckets_have_least_padding():
    rng = random.Random(9)
    for _ in range(20):
        lengths = [rng.randrange(0, 30) for _ in range(25)]
        count = Counter(lengths)
        cells = [(v, n, v * n, v) for v, n in count.items()]
        for k in (1, 2, 3, 5):
            ends = packing.boundaries(cells, k)

            def cost(limits):
                return sum(min(e for e in limits if e >= v) - v for v in lengths)

            def best(values, k):
                from itertools import combinations
                top = max(values)
                return min(cost([*c, top]) for c in combinations(sorted(set(values) - {top}), min(k, len(set(values))) - 1))

            assert cost(ends) == best(lengths, k)


def test_batches_fit_the_budget(spark, docs, rows):
    got = packing.pack(docs, budget=2000, buckets=4, blocks=8).toPandas()
    assert sorted(got.doc_id) == sorted(rows)
    assert (got.length <= got.padded).all()
    assert all(len(rows[i]["text"].split()) == n for i, n in zip(got.doc_id, got.length))
    for (_, _), g in got.groupby(["bucket", "batch"]):
        assert len(g) == 1 or len(g) * g.padded.iloc[0] <= 2000
        assert sorted(g.place) == list(range(len(g)))
    for _, g in got.groupby("bucket"):
        full = g.groupby("batch").size()
        assert (full.sort_index().iloc[:-1] == max(1, 2000 // max(1, g.padded.iloc[0]))).all()


# ---- exact dedup

def test_chunks_join_to_the_text(spark):
    texts = ["", "a", "x" * 10000, "One. Two! " * 900, "\n" * 700, "ö. " * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(exact_dedup.chunks(F.col("text"))).collect()]
    assert ["".join(c) for c in got] == texts and len(got[2]) == 3 and len(got[3]) > 10


def test_ambiguous_fingerprints_are_no_identifiers(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "A", "c", "b"])], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))  # every fingerprint collides
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(df).collect()}
    assert got == {0: 2, 1: 4, 2: 2, 3: 3, 4: 4}
