"""Repeated rows, clashing names and very long texts, where the operators' own tests do not have them."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from siltstone.llm.line_dedup import line_dedup
from siltstone.llm.mixing import mix_sources
from siltstone.llm.packing import pack
from siltstone.llm.token_counts import token_counts
from tests.llm.test_tokens import WORD as VOCABULARY
from tests.llm.test_tokens import check_packing

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k} of the" for k in range(40_000))


def line(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


def test_line_dedup_of_repeated_rows_and_a_long_text(spark):
    shared = "\n".join([line("a", 30), line("b", 30)])
    rows = [(1, f"{shared}\nown words"), (2, f"first\n{shared}"), (2, f"first\n{shared}"), (None, f"no id\n{shared}"), (3, LONG), (4, LONG.replace(" word9 ", "\nword9 ") + "\n" + shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS removed", "2 AS runs", "3 AS row", "4 AS _doc")
    got = sorted((str(r.doc_id), r.text, r.n_removed_lines, r.runs, r.row) for r in line_dedup(docs).collect())
    # the row without an id counts as the earliest, so all others lose the passage
    long_left = LONG.replace(" word9 ", "\nword9 ")
    assert got == sorted([("1", "own words", 2, 2, 3), ("2", "first", 2, 2, 3), ("2", "first", 2, 2, 3), ("None", f"no id\n{shared}", 0, 2, 3), ("3", LONG, 0, 2, 3), ("4", long_left, 2, 2, 3)])


def test_packing_with_clashing_names_and_repeated_rows(spark):
    rows = [(1, "some words"), (1, "some words"), (2, LONG), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS length", "3 AS rank", "4 AS part", "5 AS ids")
    packed = pack(docs, VOCABULARY, 0, capacity=256).collect()
    assert check_packing(rows, packed, 256) >= sum(r.length for r in packed) // 256


def test_token_counts_of_repeated_rows(spark):
    rows = [(1, "the same text"), (1, "the same text"), (None, "the same text"), (2, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS n_tokens")
    got = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len({(r.n_words, r.n_tokens, r.score) for r in got if r.doc_id != 2}) == 1
    assert [r.n_words for r in got if r.doc_id == 2] == [120_000]


def test_mixing_with_a_long_text_and_ties(spark):
    rows = [(1, LONG, "en", "a", 1), (2, "x y", "en", "b", 1), (2, "x y", "en", "b", 1), (3, None, "de", "a", 0)]
    docs = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS epoch", "2 AS budget", "3 AS row")
    got = mix_sources(docs, {"origin": F.col("source")}, {("b",): 1}, percent=100).collect()
    assert sorted((r.doc_id, r.n_tokens, r.epoch) for r in got) == [(1, 120_000, 0), (2, 2, 0), (2, 2, 0), (3, 0, 0)]
    assert {r.budget for r in got} == {2}


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_with_clashing_columns_long_texts_and_no_rows(spark, name):
    stage = dict(cp.STAGES)[name]
    text = "\n".join("the words of a text that is good and long enough to stay in " + line(f"w{k}x", 6) for k in range(12))
    rows = [(1, text, "en", "src0", len(text)), (1, text, "en", "src0", len(text)), (2, text.replace("w3x", "q"), None, None, None), (None, LONG, "en", "src1", len(LONG)), (4, "", "en", "src2", 0), (5, None, "en", "src2", None)]
    docs = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS kept", "2 AS removed", "3 AS epoch", "4 AS piece", "5 AS row")
    got = stage(spark, docs, "/none")
    if name != "best_fit_packing":
        assert got.columns == list(cp.COLUMNS)
    assert got.count() > 0
    assert stage(spark, docs.limit(0), "/none").count() == 0
