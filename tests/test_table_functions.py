"""Chunkers called as table functions."""

import pytest

from rankforge.operators.table_functions import pack_sentences, register_chunker


def test_numbers_run_through_the_pages_of_a_file(spark):
    def split(text):
        if "bad" in text:
            raise ValueError("refused")
        return text.split("|")

    register_chunker(spark, "cut_pages", split, "body", min_len=2)
    rows = [("f", 2, "cc|dd"), ("f", 1, "aa| |bb|x"), ("f", 3, "bad|page"), ("g", 1, None), ("g", 2, "ee")]
    spark.createDataFrame(rows, "file string, page int, body string").createOrReplaceTempView("cut_input")
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM cut_pages(TABLE(cut_input) PARTITION BY file ORDER BY page)").collect())
    assert got == [("f", 1, 0, "aa"), ("f", 1, 1, "bb"), ("f", 2, 2, "cc"), ("f", 2, 3, "dd"), ("f", 3, 4, "bad|page"), ("g", 2, 0, "ee")]
    with pytest.raises(Exception, match="no column body"):
        spark.sql("SELECT * FROM cut_pages(TABLE(SELECT 1 AS a))").collect()


def test_pack_sentences():
    assert pack_sentences(10)("One. Two. Three four five. Six!") == ["One. Two.", "Three four five.", "Six!"]
    assert pack_sentences(10)("") == []
