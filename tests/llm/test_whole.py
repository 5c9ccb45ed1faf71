"""Inputs on which an operator once did less than its whole job."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.llm import html_text, language_model, pii

# 3: language model


def test_rare_ngrams_of_a_large_corpus_count(spark, monkeypatch):
    """N-grams met once among 400,000 tokens are in the model, over many parts."""
    monkeypatch.setattr(language_model, "PART", 1 << 14)
    rows = [(0, "a b " * 200_000, True), (0, "x y z", True), (1, "x y z", False), (2, "q y z", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = {r.doc_id: r for r in language_model.score(docs, F.col("learn"), ["doc_id"]).where("doc_id > 0").collect()}
    total, kinds = 400_005, 6
    one = lambda c: (c + 0.5) / (total + 0.5 * (kinds + 1))
    # a history met once with one successor shares out a half
    two = 0.5 + 0.5 * one(1)
    end = 0.5 + 0.5 * one(2)
    three = 0.5 + 0.5 * two, 0.5 + 0.5 * end
    assert got[1].train_tokens == total and got[1].n_known == 4
    assert got[1].score == pytest.approx(sum(map(math.log10, (one(1), two, *three))), abs=1e-9)
    # an unseen word, then y as after any word, then a seen bigram and a seen trigram
    assert got[2].score == pytest.approx(sum(map(math.log10, (one(0), one(1), two, three[1]))), abs=1e-9)


# 5: main text


@pytest.mark.parametrize(
    "tag",
    ["<svg viewBox='0 0 1 1'/>", "<math/>", "<object data='x'/>", "<object data=x>", "<select name=a>", "<template>", "<noscript>",
     "<iframe src=x>", "<svg>", "<math>", "<select><option>One<option>Two", "<svg><!-- </svg> --><title>T</title></svg>"],
)
def test_text_after_a_raw_element_stays(tag):
    rest = "".join(f"<{name}>gone</{name}>" for name in ("svg", "math", "object", "select", "template", "noscript", "iframe"))
    page = f"<article><p>Before.</p>{tag}<p>After &amp; on.</p>{rest}<p>Late.</p></article>"
    assert html_text.main_text(page) == "Before. After & on. Late."


def test_text_only_elements_still_end_the_page():
    for name in ("script", "style", "textarea", "title"):
        assert html_text.main_text(f"<article><p>Before.</p><{name}>x<p>After.</p></article>") == "Before."
        assert html_text.main_text(f"<article><p>Before.</p><{name}>x<svg></{name}><p>After.</p></article>") == "Before. After."


def test_articles_keep_figures_and_partly_marked_elements():
    page = "<article><figure><figcaption>Caption.</figcaption></figure><p class='social-history'>One.</p><p class='x share'>Two.</p></article>"
    assert html_text.main_text(page) == "Caption. One."


def test_many_unclosed_raw_elements_take_linear_time():
    assert html_text.main_text("<article>" + "<object>a " * 200_000) == " ".join("a" * 200_000)


# 1: personal data


def test_long_secrets_are_proposed_whole():
    text = "number 7 api_key=" + "aB3x" * 100 + " end"
    assert ("secret", 17, 417) in [c[:3] for c in pii.candidates(text, pii.base_matches(text))]
    code = "x " + "q" * 80 + "7" * 300 + " y"
    assert ("secret", 2, 382) in [c[:3] for c in pii.candidates(code, pii.base_matches(code))]


def test_letters_only_secret_is_a_candidate():
    text = "password: correcthorsebattery"
    assert ("secret", 10, 29, None) in pii.candidates(text, pii.base_matches(text))


def test_long_secret_is_redacted_whole(spark):
    r = random.Random(5)
    make = lambda n: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(n))
    rows = [(i, f"the api_key={make(r.choice([20, 40, 300]))} of entry {i}, id 4{i:05d} and key = word{i % 50}") for i in range(600)]
    secret = make(400)
    docs = spark.createDataFrame([*rows, (-1, f"note 1 token={secret} end")], "doc_id long, text string")
    assert pii.redact(docs).filter("doc_id = -1").first().text == "note 1 token=[SECRET] end"


def test_equal_candidates_count_once_in_training(spark):
    texts = [("key = word1, card 4111 1111 1111 1111.",)] * 500 + [(f"token=abcdefgh{i}xyz",) for i in range(400)]
    docs = spark.createDataFrame(texts, "text string")
    every = pii.sample(docs).collect()
    assert len({r.h for r in every}) == len(every) < 500
    few = pii.sample(docs, sample_rows=100).collect()
    assert 50 < len(few) < 150 and {r.h for r in few} <= {r.h for r in every}


@pytest.fixture(scope="module")
def model(spark, sf):
    return pii.train(spark.read.parquet(f"{sf}/documents.parquet"))


def _accepted(model, text):
    base = pii.base_matches(text)
    more = [c for c in pii.candidates(text, base) if c[:3] not in {b[:3] for b in base if b[3]}]
    p = pii.probability(model, np.array([pii.features(text, *c[:3]) for c in more])) if more else []
    return [text[s:e] for _, s, e in pii._select(base, more, p, pii.THRESHOLD)]


def test_secrets_of_any_length_on_the_smallest_table(model):
    """The model of the given table, not of rows made for the test: whole secrets of 20 to 2,000 characters."""
    r = random.Random(99)
    found = total = 0
    for size in (20, 32, 40, 64, 128, 256, 400, 800, 2000):
        for chars in ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
            for i in range(10):
                value = "".join(r.choices(chars, k=size))
                total += 1
                found += _accepted(model, f"note {i} token={value} end") == [value]
    assert found >= 0.95 * total


@pytest.mark.parametrize("text", ["the key: something else", "token: password", "monkey key=values here", "auth: required now", "the key = documentation"])
def test_words_after_a_key_word_stay(model, text):
    assert _accepted(model, text) == []


def test_numbers_with_a_check_digit_are_taken(model):
    for text in ("pay 4111 1111 1111 1111 now", "card 5500005555555559 ok", "visa 4012-8888-8888-1881."):
        assert _accepted(model, text) == [re.search("[0-9][0-9 -]+[0-9]", text).group()]
