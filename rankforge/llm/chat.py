"""Chat transcripts as training strings, by built-in functions only.

Template: each run of turns of one role is a block

    <|im_start|>ROLE\\nTEXT<|part|>TEXT...<|im_end|>\\n

Inside texts and roles a backslash is doubled and ``<|`` becomes ``<\\|``, so no
control string can occur there; line feeds in roles become ``<\\-``. Both are
undone by ``unescape``. The loss mask is a list of code point ranges of the
string, one per assistant turn, without separators.

Turns are collected per conversation, sorted by (turn, role, text), merged by
an array aggregation and concatenated. Defined cases: null texts and roles are
empty; repeated rows are turns of their own; rows without ``conv_id`` form one
conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, PART, END = "<|im_start|>", "<|part|>", "<|im_end|>"
LEARNED = "assistant"

_BLOCKS = "array<struct<role:string,parts:array<string>>>"
_SPANS = "array<struct<start:bigint,end:bigint>>"


def escape(text):
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text):
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role):
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\-"))


def _unescape_role(role):
    return unescape(F.replace(role, F.lit("<\\-"), F.lit("\n")))


def _merge(done, turn):
    """Add a turn to the last block if the role is the same, else open a block."""
    last = F.element_at(done, -1)
    grown = F.struct(last["role"].alias("role"), F.concat(last["parts"], F.array(turn["text"])).alias("parts"))
    fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("parts"))
    return F.when(
        (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["role"] == turn["role"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown)),
    ).otherwise(F.concat(done, F.array(fresh)))


def _block(block):
    body = F.array_join(F.transform(block["parts"], escape), PART)
    return F.concat(F.lit(START), _escape_role(block["role"]), F.lit("\n"), body, F.lit(END + "\n"))


def _mask(state, block):
    """Advance over a block; note its parts if they are learned."""
    head = state["at"] + len(START) + 1 + F.length(_escape_role(block["role"]))

    def part(inner, text):
        end = inner["at"] + F.length(escape(text))
        span = F.array(F.struct(inner["at"].alias("start"), end.alias("end")))
        spans = F.when(block["role"] == LEARNED, F.concat(inner["spans"], span)).otherwise(inner["spans"])
        return F.struct((end + len(PART)).alias("at"), spans.alias("spans"))

    inside = F.aggregate(
        block["parts"], F.struct(head.cast("bigint").alias("at"), state["spans"].alias("spans")), part
    )
    end = inside["at"] - len(PART) + len(END) + 1
    return F.struct(end.cast("bigint").alias("at"), inside["spans"].alias("spans"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans), one row per conversation of (conv_id, turn, role, text)."""
    one = F.struct(
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    merged = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns")).select(
        "conv_id", F.aggregate("turns", F.array().cast(_BLOCKS), _merge).alias("blocks")
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("spans"))
    return merged.select(
        "conv_id",
        F.array_join(F.transform("blocks", _block), "").alias("formatted"),
        F.aggregate("blocks", start, _mask)["spans"].alias("loss_spans"),
    )


def read_back(formatted):
    """array<struct<role,text>> of the turns in a formatted string."""
    blocks = F.split(formatted, "\\Q" + START + "\\E", -1)

    def turns(block):
        role = F.substring_index(block, "\n", 1)
        skip = F.length(role) + 2
        body = F.substring(block, skip, F.length(block) - skip - len(END))
        return F.transform(
            F.split(body, "\\Q" + PART + "\\E", -1),
            lambda p: F.struct(_unescape_role(role).alias("role"), unescape(p).alias("text")),
        )

    return F.flatten(F.transform(F.slice(blocks, 2, F.size(blocks)), turns))


def learned_text(formatted, spans):
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
        ),
        "",
    )
