"""Text, score, id and statistic functions on hand-made and random cases."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankforge.functions import ids, names, scores, stats, text
from rankforge.operators import chunking


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_strip_and_tokens(spark):
    assert column(spark, ["　 a b\t\n", "", "  "], text.strip) == ["a b", "", ""]
    assert column(spark, ["Café, 한국어-TEXT_1!", "😀"], text.tokenize_words) == [["café", "한국어", "text_1"], []]
    assert column(spark, ["ab c", "한국어"], text.tokenize_bigrams) == [["ab", "c"], ["한국", "국어"]]


def test_target_page(spark):
    assert column(spark, ["12,13", " 7 ", "n/a", None, ""], text.target_page) == [12, 7, None, None, None]


def test_parse_lines(spark):
    got = column(spark, ["1. first\n\n- second\nx\n2024년 보고서", ""], lambda c: text.parse_lines(c, 3, F.lit("q")))
    assert got == [["first", "second", "년 보고서"], ["q", "q", "q"]]


def test_parse_keywords(spark):
    got = column(spark, ["a, bb\n- cc,1. dd," + "x" * 30 + ",ee,ff,gg"], text.parse_keywords)
    assert got == [["bb", "cc", "dd", "ee", "ff"]]


def python_score(content, reasoning):
    def last(s):
        found = re.findall(r"\b([1-5])\b", s)
        if found:
            return int(found[-1])
        digits = [c for c in s if c in "12345"]
        return int(digits[-1]) if digits else 0

    plain = re.sub(r"<think>.*?</think>", "", content, flags=re.S).strip()
    return last(content) or last(plain) or last(reasoning)


def test_extract_score_random(spark):
    rng = random.Random(2)
    parts = ["1", "4", "7", "10", "점", "수", " ", ".", "/", "Score:", "<think>", "</think>", "\n", "③", "_"]
    rows = [("".join(rng.choices(parts, k=rng.randint(0, 7))), "".join(rng.choices(parts, k=2))) for _ in range(400)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, r string")
    got = [r[0] for r in df.orderBy("i").select(scores.extract_score(F.col("c"), F.col("r"))).collect()]
    assert got == [python_score(*r) for r in rows]


def test_verdicts(spark):
    values = ["```json\n[1, 0, true]\n```", "x [0, 2] y", "[]", "[1.5]", '["1"]', "none", "[1,", "] ["]
    assert column(spark, values, scores.verdicts) == [[1, 0, 1], [0, 1], [], None, None, None, None, None]


def test_average_precision(spark):
    got = column(spark, [[1, 0, 1], [0, 0], [], None], scores.average_precision, "array<int>")
    assert got[0] == pytest.approx((1 + 2 / 3) / 2) and got[1:] == [0.0, 0.0, None]


def test_supported_share(spark):
    values = ['[{"supported": true}, {"supported": false}, 3]', "[]", "no"]
    got = column(spark, values, scores.supported_share)
    assert got[0] == pytest.approx(1 / 3) and got[1:] == [None, None]


def test_ids(spark):
    assert column(spark, ["item q012 x", "none", None], lambda c: ids.normalize_qid(c, F.lit(7))) == ["q012", "q007", "q007"]
    assert column(spark, ["gpt-5_4_1", "v2_5"], ids.restore_dots) == ["gpt-5.4_1", "v2.5"]
    long = "m" * 70
    safe = column(spark, [long + "a", long + "b"], ids.safe_id)
    assert safe[0] == safe[1] and len(safe[0]) == 64
    unique = column(spark, [long + "a", long + "b", "a/b", "a_b"], ids.unique_safe_id)
    assert len(set(unique)) == 4 and max(map(len, unique)) <= 64


def test_names(spark):
    got = column(spark, ["openai/gpt-oss_20b", "gpt-5", "my-gpt-x", "z-ai_glm-5", "supergemma4-26b"], names.candidate_family)
    assert got == ["gpt", "gpt", "other", "glm", "gemma"]
    assert column(spark, ["qwen-claude-distill", "gpt-oss"], names.judge_family) == ["qwen", "gpt"]
    assert column(spark, ["exaone3.5_32b", "moonshotai_kimi-k2.5", "x"], names.parameter_billions) == [32.0, 1000.0, None]


@pytest.mark.parametrize("k, low, high", [(236, 0.737, 0.829), (230, 0.716, 0.811), (222, 0.688, 0.786), (221, 0.684, 0.783), (218, 0.674, 0.774)])
def test_wilson_published(spark, k, low, high):
    lo, hi = stats.wilson(F.lit(k), F.lit(300))
    row = spark.range(1).select(F.round(lo, 3), F.round(hi, 3)).first()
    assert (row[0], row[1]) == (low, high)


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (5, 5)], "k int, n int")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    rows = [tuple(r) for r in df.select(lo, hi).collect()]
    assert rows[0] == (None, None) and rows[1][0] == 0.0 and rows[2][1] == 1.0


def recursive_split(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """Plain version: split at the coarsest separator present; too long pieces go one finer."""
    at = next(i for i, s in enumerate(separators) if s in text)
    sep, finer = separators[at], separators[at + 1 :]
    head, *rest = text.split(sep) if sep else ["", *text]
    out, run = [], []

    def pack():
        cur = []
        for piece in run:
            if cur and len("".join(cur)) + len(piece) > size:
                out.append("".join(cur))
                while cur and (len("".join(cur)) > overlap or len("".join(cur)) + len(piece) > size):
                    cur.pop(0)
            cur.append(piece)
        out.extend(["".join(cur)] if cur else [])
        run.clear()

    for piece in filter(None, [head, *(sep + r for r in rest)]):
        if len(piece) < size:
            run.append(piece)
        else:
            pack()
            out.extend(recursive_split(piece, size, overlap, finer) if finer else [piece])
    pack()
    return [c.strip() for c in out]


def test_recursive_chunks_against_plain_version(spark):
    rng = random.Random(4)
    texts = ["", "x", "\n\n", "a" * 500, "한😀 " * 90, "\n".join(["b" * 70] * 9)]
    for _ in range(80):
        words = ["".join(rng.choices("abcde", k=rng.randint(1, 60))) for _ in range(60)]
        texts.append("".join(w + rng.choice([" ", "\n", "\n\n", " \n"]) for w in words))
    for size, overlap in [(80, 20), (50, 0), (7, 3)]:
        got = column(spark, texts, lambda c: chunking.recursive_chunks(c, size, overlap, min_len=2))
        assert got == [[c for c in recursive_split(t, size, overlap) if len(c) >= 2] for t in texts]


def test_paragraph_chunks_cases(spark):
    long = "p" * 120
    pages = ["short", "s" * 60, f"{'a' * 60}\n\n{'b' * 60}\n\n{long}", f"{'a' * 20}\n\n{long}"]
    got = column(spark, pages, lambda c: chunking.paragraph_chunks(c, 100, 50))
    # too short is dropped, a paragraph over the size stays whole
    assert got == [[], ["s" * 60], ["a" * 60, "b" * 60, long], [long]]


def test_sentence_overlap(spark):
    body = " ".join(f"{c * 39}." for c in "abcd")
    got = column(spark, [body], lambda c: chunking.sentence_chunks(c, 85, 10))[0]
    assert got[0] == f"{'a' * 39}. {'b' * 39}." and got[1].startswith("b" * 9 + ". " + "c" * 39)


def test_question_ids_over_999(spark):
    df = spark.createDataFrame([("item q1234 x",), ("none",)], "raw string")
    assert [r[0] for r in df.select(ids.normalize_qid(F.col("raw"), F.lit(7))).collect()] == ["q1234", "q007"]
    row = spark.range(1).select(
        *ids.parsed(F.lit("m::q1234::correctness"), ids.COLON_ID, "m", "q", "k"), *ids.parsed(F.lit("m__q1234__x"), ids.LAZY_ID, "m2", "q2", "k2")
    ).first()
    assert (row.q, row.q2) == ("q1234", "1234")


def test_render_keeps_braces_in_values(spark):
    got = column(spark, ["{q} {a}"], lambda c: text.render("Q: {q} A: {a}.", q=c, a=F.lit("x")))
    assert got == ["Q: {q} {a} A: x."]


def test_log2_gain_matches_math():
    assert 1 / math.log2(3) == pytest.approx(0.6309297535714575)
