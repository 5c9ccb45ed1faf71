"""Scores and verdicts read from free judge text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankforge.functions.text import strip, strip_think

# Patterns that decide results. Word edges are spelled out
# because engines disagree on what a word is.
LONE_SCORE = r"(?<![\p{L}\p{N}_])([1-5])(?![\p{L}\p{N}_])"
LAST_DIGIT = r"(?s).*([1-5])"


def _int(text: Column) -> Column:
    return text.try_cast("int")


def last_lone_score(text: Column) -> Column:
    """Last 1-5 standing alone, else NULL."""
    found = F.regexp_extract_all(text, F.lit(LONE_SCORE), 1)
    return _int(F.get(found, F.size(found) - 1))


def last_score(text: Column) -> Column:
    """Last lone score, else the last digit 1-5 anywhere, else 0."""
    return F.coalesce(last_lone_score(text), _int(F.regexp_extract(text, LAST_DIGIT, 1)), F.lit(0))


def extract_score(content: Column, reasoning: Column) -> Column:
    """Score of the content, of the content without its think block, or of the reasoning."""
    return F.coalesce(
        F.nullif(last_score(content), F.lit(0)),
        F.nullif(last_score(strip_think(content)), F.lit(0)),
        last_score(reasoning),
        F.lit(0),
    )


def first_score(text: Column) -> Column:
    """First digit 1-5 anywhere, else 0."""
    return F.coalesce(_int(F.regexp_extract(text, "[1-5]", 0)), F.lit(0))


def first_digit(text: Column) -> Column:
    """First digit of any value, else 0."""
    return F.coalesce(_int(F.regexp_extract(text, "[0-9]", 0)), F.lit(0))


def json_array(text: Column) -> Column:
    """JSON array in a reply as ``array<variant>``, NULL when there is none."""
    body = strip(text)
    opened = F.when(
        body.startswith("```"),
        F.when(F.instr(body, "\n") > 0, F.regexp_replace(body, r"^[^\n]*\n", "")).otherwise(F.substring(body, 4, 2**31 - 1)),
    )
    fenced = F.when(opened.endswith("```"), F.regexp_replace(opened, r"(?s)```$", "")).otherwise(opened)
    inner = F.coalesce(fenced, body)
    return F.try_variant_get(F.try_parse_json(F.regexp_extract(inner, r"(?s)\[.*\]", 0)), "$", "array<variant>")


def verdicts(text: Column) -> Column:
    """0/1 list from a reply; NULL unless every element is an integer or boolean."""
    items = json_array(text)
    kind = lambda x: F.schema_of_variant(x)
    plain = F.forall(items, lambda x: kind(x).isin("BIGINT", "BOOLEAN"))
    truth = F.transform(
        items,
        lambda x: F.when(kind(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("int")).otherwise(
            (F.try_variant_get(x, "$", "bigint") != 0).cast("int")
        ),
    )
    return F.when(plain, truth)


def average_precision(flags: Column) -> Column:
    """Mean of the precisions at the relevant places; 0 when nothing is relevant."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("hits"), F.lit(0.0).alias("total"))

    def step(s, v):
        hits = s["hits"] + v
        return F.struct(
            (s["at"] + 1).alias("at"),
            hits.alias("hits"),
            (s["total"] + F.when(v == 1, hits / (s["at"] + 1)).otherwise(0.0)).alias("total"),
        )

    return F.aggregate(flags, start, step, lambda s: F.when(s["hits"] > 0, s["total"] / F.nullif(s["hits"], F.lit(0))).otherwise(0.0))


def supported_share(text: Column) -> Column:
    """Share of statements marked supported; NULL without any statement."""
    items = json_array(text)
    yes = F.filter(items, lambda x: F.coalesce(F.try_variant_get(x, "$.supported", "boolean"), F.lit(False)))
    return F.try_divide(F.size(yes), F.size(items))
