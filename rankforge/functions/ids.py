"""Question ids, request ids and their way back."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id formats.
QID = r"q\d{3,}"
UNSAFE = r"[^a-zA-Z0-9_-]"
SAFE_LENGTH = 64
COLON_ID = r"^(.+)::(q\d{3,})::([a-z]+)$"
UNDERSCORE_ID = r"(?s)^(.*)__(.*)__(.*)$"
LAZY_ID = r"^(.+?)__q(\d{3,})__(\w+)$"


def qid(index: Column, width: int = 4) -> Column:
    return F.format_string(f"q%0{width}d", index)


def normalize_qid(raw: Column, index: Column) -> Column:
    """Id of three digits or more found in ``raw``, else made from the position."""
    return F.coalesce(F.nullif(F.regexp_extract(raw, QID, 0), F.lit("")), qid(index, 3))


def request_id(model: Column, question: Column, metric: Column) -> Column:
    return F.concat_ws("__", model, question, metric)


def safe_id(raw: Column) -> Column:
    """Request id in the allowed letters, cut to 64; different ids may meet."""
    return F.substring(F.regexp_replace(raw, UNSAFE, "_"), 1, SAFE_LENGTH)


def unique_safe_id(raw: Column) -> Column:
    """Like ``safe_id``; an id that loses letters ends in a hash of the whole."""
    safe = F.regexp_replace(raw, UNSAFE, "_")
    return F.when((safe == raw) & (F.length(raw) <= SAFE_LENGTH), raw).otherwise(
        F.concat(F.substring(safe, 1, SAFE_LENGTH - 17), F.lit("_"), F.substring(F.md5(raw), 1, 16))
    )


def parsed(raw: Column, pattern: str, *names: str) -> list[Column]:
    """Groups of a pattern as named columns, NULL where it does not match."""
    return [F.nullif(F.regexp_extract(raw, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)]


def restore_dots(name: Column) -> Column:
    return F.regexp_replace(name, r"(\d)_(\d)", "$1.$2")


def key_parts(key: Column, limit: int) -> Column:
    """``gen::model::qid`` cut at the first separators only."""
    return F.split(key, "::", limit)
