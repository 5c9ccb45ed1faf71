"""Text functions as Column expressions."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide results.
WORD_BREAK = r"[^\p{L}\p{N}_\s]"
LIST_PREFIX = r"^[\-\*\d\.\)\s]+"
THINK_BLOCK = r"(?s)<think>.*?</think>"
PARAGRAPH_BREAK = r"\n\s*\n|(?=\n#{1,3}\s+)"
CONTEXT_RULE = "\n\n---\n\n"


def strip(col: Column) -> Column:
    """Strip Unicode white space at both ends (``trim`` strips blanks only)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def not_blank(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: x != "")


def tokenize_words(col: Column) -> Column:
    """Lower-cased words: letters, digits and underscore of any script."""
    return not_blank(F.split(F.lower(F.regexp_replace(col, WORD_BREAK, " ")), r"\s+"))


def tokenize_bigrams(col: Column) -> Column:
    """Character pairs of each word; stands in for a morphological analyser."""

    def pairs(word):
        return F.when(F.length(word) < 2, F.array(word)).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))),
                lambda i: F.substring(word, i, F.lit(2)),
            )
        )

    return F.flatten(F.transform(tokenize_words(col), pairs))


def word_pairs(word: str) -> list[str]:
    """The terms that ``tokenize_bigrams`` makes of one word."""
    return [word[i : i + 2] for i in range(len(word) - 1)] or [word]


def _pairs_of_words(words: list[str]):
    """``(terms of each word, their numbers, distinct terms)`` of ``word_pairs``, by array operations."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    # an empty word is its own term: nothing follows it, as nothing follows a single character
    text = "".join([w or "\0" for w in words])
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size, empty = np.maximum(size, 1), size == 0
    each = np.maximum(size - 1, 1)
    starts = np.cumsum(size) - size
    at = np.repeat(starts - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    left = chars[at].astype(np.int64) + 2
    right = np.where(np.repeat(size == 1, each), 0, chars[np.minimum(at + 1, max(0, len(chars) - 1))].astype(np.int64) + 2)
    left[np.repeat(empty, each)] = 1
    used = np.zeros(0x110002, dtype=bool)
    used[left], used[right] = True, True
    number, found = np.cumsum(used) - 1, np.flatnonzero(used)
    pair = number[left] * len(found) + number[right]
    if len(found) ** 2 <= max(1 << 22, 8 * len(pair)):
        held = np.zeros(len(found) ** 2, dtype=bool)
        held[pair] = True
        distinct, code = np.flatnonzero(held), (np.cumsum(held) - 1)[pair]
    else:
        distinct, code = np.unique(pair, return_inverse=True)
    names = ["" if c < 2 else chr(c - 2) for c in found.tolist()]
    return each, code, [names[i // len(found)] + names[i % len(found)] for i in distinct.tolist()]


word_pairs.of_words = _pairs_of_words


def strip_think(col: Column) -> Column:
    return strip(F.regexp_replace(col, THINK_BLOCK, ""))


def _list_items(raw: Column) -> Column:
    return F.transform(
        F.filter(F.transform(raw, strip), lambda x: x != ""),
        lambda x: strip(F.regexp_replace(x, LIST_PREFIX, "")),
    )


def parse_lines(col: Column, n: int, fallback: Column) -> Column:
    """First ``n`` list lines longer than two characters, padded with ``fallback``."""
    kept = F.slice(F.filter(_list_items(F.split(col, "\n")), lambda x: F.length(x) > 2), 1, n)
    return F.concat(kept, F.array_repeat(fallback, F.lit(n) - F.size(kept)))


def parse_keywords(col: Column) -> Column:
    """First five keywords of 2 to 29 characters from a comma or line list."""
    items = _list_items(F.split(F.regexp_replace(col, "\n", ","), ","))
    return F.slice(F.filter(items, lambda x: (F.length(x) > 1) & (F.length(x) < 30)), 1, 5)


def first_line(col: Column) -> Column:
    return strip(F.element_at(F.split(col, "\n"), 1))


def target_page(raw: Column) -> Column:
    """Leading page of ``"12,13"`` as a number, NULL when it is not one."""
    return strip(F.element_at(F.split(raw, ","), 1)).try_cast("int")


def prefix(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def joined_by_rank(rank: Column, text: Column, separator: str) -> Column:
    """Aggregate: texts in rank order, joined by ``separator``."""
    ordered = F.array_sort(F.collect_list(F.struct(rank.alias("r"), text.alias("t"))))
    return F.array_join(F.transform(ordered, lambda x: x["t"]), separator)


def render(template: str, **values: Column) -> Column:
    """Fill ``{name}`` places of a template with columns."""
    parts, rest = [], template
    while rest:
        cut = min((rest.find("{%s}" % n), n) for n in values if "{%s}" % n in rest) if any(
            "{%s}" % n in rest for n in values
        ) else None
        if cut is None:
            parts.append(F.lit(rest))
            break
        at, name = cut
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def split_template(template: str, at: str) -> tuple[str, str]:
    """Cut a template before ``{at}``: a cacheable head and a varying tail."""
    cut = template.index("{%s}" % at)
    return template[:cut], template[cut:]
