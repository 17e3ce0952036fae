"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from gradelake.llm import decontaminate, exact_dedup, language_id, line_templates, near_dedup, packing, quality_rules, sharding, substring_dedup, token_counts
from gradelake.llm.queries import TOKENIZERS

CLASH = "row long, size long, bucket string, rest string, label string, n long, kept boolean, batch long, text_sha256 string, _stat_bytes_log double, cell int"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH
LONG = "Some long text without end, " * 12000
SOLID = "q" * 300_000
TEXTS = [(1, None), (2, ""), (3, "A b c d e f. One more line\nand another"), (3, "A b c d e f. One more line\nand another"), (None, "no id but words enough here"),
         (4, LONG), (5, SOLID), (6, "!!! ???"), (7, "日本語 テキスト 🎉"), (8, "   "), (9, "12345 678"), (None, None), (10, "a B c d e f. One more line\nand another")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if k % 3 == 0 else "en", None, None, 5, 5, "b", "r", "l", 1, False, 2, "s", 0.5, None) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 7), (4, 0, 7), (4, None, 7), (None, 1, 7), (77, 0, 7)], "doc_id long, quality int, row long")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one more line and another", "x"), (2, None, "x"), (None, "", "x")], "item_id long, text string, row string")


@pytest.fixture(scope="module")
def operators(tmp_path_factory, labels, bench):
    folder = str(tmp_path_factory.mktemp("maps"))
    vocabulary = token_counts.read_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    return {
        "exact": exact_dedup.exact_dedup, "tokens": lambda d: token_counts.token_counts(d, vocabulary), "clean": lambda d: decontaminate.decontaminate(d, bench),
        "strings": substring_dedup.substring_dedup, "shards": lambda d: sharding.shard_documents(d, 4, folder, slots=64), "lines": line_templates.drop_recurring_lines,
        "quality": lambda d: quality_rules.quality_scores(d, labels), "near": near_dedup.near_dedup, "pack": packing.pack, "language": language_id.languages}


NAMES = ["exact", "tokens", "clean", "strings", "shards", "lines", "quality", "near", "pack", "language"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(operators, none, name):
    assert operators[name](none).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_one_row_out_per_row_in(operators, odd, name):
    got = operators[name](odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in TEXTS)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_defined_results(operators, odd):
    exact = by_id(operators["exact"](odd))
    assert [exact[i][0]["keep_id"] for i in (1, 2, 3, 10)] == [2, 2, 10, 10] and exact[10][0]["group_size"] == 3
    assert exact[1][0]["text_sha256"] == hashlib.sha256(b"").hexdigest() and sorted(r["group_size"] for r in exact[None]) == [1, 3]
    near = by_id(operators["near"](odd))
    assert near[10][0]["class_id"] == 3 and near[10][0]["class_size"] == 3 and [r["kept"] for r in near[3]].count(True) == 1
    assert near[1][0]["class_size"] == near[2][0]["class_size"] == near[6][0]["class_size"] == 1
    tokens = by_id(operators["tokens"](odd))
    assert tokens[1][0]["n_tokens"] == tokens[2][0]["n_tokens"] == 0 and tokens[5][0]["n_chars"] == 300_000
    clean = by_id(operators["clean"](odd))
    assert clean[3][0]["contaminated"] and clean[10][0]["items"] == ["1"] and not clean[1][0]["contaminated"] and clean[6][0]["n_words"] == 0
    strings = by_id(operators["strings"](odd))
    assert strings[5][0]["n_removed"] == 300_000 - 100 + 99 and strings[1][0]["n_bytes"] == 0
    language = by_id(operators["language"](odd))
    assert {language[i][0]["lang_pred"] for i in (1, 2, 6, 8, 9)} == {"und"} and language[3][0]["lang_pred"] == "en"
    lines = by_id(operators["lines"](odd))
    assert (lines[1][0]["n_lines"], lines[1][0]["kept"]) == (1, "") and lines[4][0]["kept"] == LONG
    pack = by_id(operators["pack"](odd))
    assert pack[1][0]["length"] == 0 and pack[4][0]["place"] == 0 and len({(r["bucket"], r["batch"], r["place"]) for r in pack[3]}) == 2


def test_repeated_rows_get_equal_scores(operators, odd):
    got = by_id(operators["quality"](odd))
    assert got[3][0]["score"] == got[3][1]["score"] and 0 <= got[1][0]["score"] <= 1


def test_stages_keep_columns(spark, odd, none, labels, bench, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns, name
        assert stage(spark, none, str(tmp_path)).collect() == [], name
    kept = corpus_pipeline.drop_exact_copies(spark, odd, str(tmp_path)).collect()
    assert len(kept) == len(TEXTS) - 4 and [r["doc_id"] for r in kept].count(3) == 0
    assert len(corpus_pipeline.drop_near_copies(spark, odd, str(tmp_path)).collect()) == len(TEXTS) - 2
    left = [r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, odd, str(tmp_path)).collect()]
    assert not {3, 10} & set(left) and len(left) == len(TEXTS) - 3


def test_only_letters_have_a_language(spark, odd):
    """Number signs, letter numbers, combining marks, digits and marks alone are no letters (Unicode category L)."""
    without = ["½ ② ²", "Ⅳ Ⅻ ⅷ", "\u0301\u0302 \u0940", "١٢٣ ４５", "_ – … €", "🎉"]
    rows = [(100 + k, t) for k, t in enumerate(without)] + [(200, "½ é"), (201, "ª"), (202, "ʰ"), (203, "字 1")]
    got = by_id(language_id.languages(odd.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)))
    assert {got[i][0]["lang_pred"] for i, _ in rows if i < 200} == {"und"}
    assert all(got[i][0]["lang_pred"] == "en" for i, _ in rows if i >= 200)
