"""Rules that read a model's family, size, openness or origin off its name."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name rules, in order of precedence.
CANDIDATE_FAMILIES = [
    ("qwen", ["qwen"]),
    ("gpt", ["gpt-oss", "^gpt-"]),
    ("claude", ["claude"]),
    ("gemini", ["gemini"]),
    ("mistral", ["mistral"]),
    ("kimi", ["kimi", "moonshot"]),
    ("deepseek", ["deepseek"]),
    ("minimax", ["minimax"]),
    ("glm", ["glm", "z-ai"]),
    ("gemma", ["gemma"]),
    ("nemotron", ["nemotron", "nvidia"]),
    ("solar", ["solar"]),
    ("exaone", ["exaone"]),
    ("phi", ["phi"]),
    ("lfm", ["lfm"]),
    ("mimo", ["mimo", "xiaomi"]),
]
JUDGE_FAMILIES = [
    (f, [f]) for f in ("qwen", "gpt", "claude", "gemini", "gemma", "nemotron", "solar", "mistral", "llama")
]
VENDOR_RULES = [
    ("anthropic", ["claude"]),
    ("openai", ["gpt"]),
    ("google", ["gemini"]),
    ("deepseek", ["deepseek"]),
    ("moonshotai", ["kimi"]),
    ("alibaba", ["qwen"]),
    ("minimax", ["minimax"]),
    ("x-ai", ["grok"]),
    ("mistralai", ["mistral"]),
    ("xiaomi", ["mimo"]),
    ("z-ai", ["glm"]),
    ("nvidia", ["nemotron"]),
    ("upstage", ["solar"]),
]
OPEN_WEIGHT_WORDS = [
    "qwen", "deepseek", "exaone", "lfm", "phi", "minimax", "mistral", "moonshot",
    "kimi", "nemotron", "gpt-oss", "mimo", "glm", "supergemma", "gemma4", "solar-open",
]
SIZE_PATTERN = r"(?i)(\d+(?:\.\d+)?)b"
KNOWN_SIZES = {"moonshotai_kimi-k2.5": 1000.0, "moonshotai_kimi-k2.6": 1000.0, "mistralai_mistral-small-2603": 24.0}


def by_rules(name: Column, rules, default="other") -> Column:
    """First rule with a word in the lower-cased name; ``^`` anchors at the start."""
    low = F.lower(name)
    found = F
    for value, words in rules:
        hits = [low.startswith(w[1:]) if w.startswith("^") else F.contains(low, F.lit(w)) for w in words]
        found = found.when(reduce(lambda a, b: a | b, hits), value)
    return found.otherwise(default)


def candidate_family(name: Column) -> Column:
    return by_rules(name, CANDIDATE_FAMILIES)


def judge_family(name: Column) -> Column:
    return by_rules(name, JUDGE_FAMILIES)


def vendor(name: Column) -> Column:
    return by_rules(name, VENDOR_RULES, "unknown")


def open_by_words(name: Column) -> Column:
    low = F.lower(name)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in OPEN_WEIGHT_WORDS])


def open_by_list(name: Column, members) -> Column:
    return name.isin(*members)


def parameter_billions(name: Column, known=KNOWN_SIZES) -> Column:
    """Listed size, else the number before a ``b`` in the name, else NULL."""
    listed = F
    for key, value in known.items():
        listed = listed.when(name == key, value)
    return F.coalesce(listed, F.regexp_extract(name, SIZE_PATTERN, 1).try_cast("double")) if known else (
        F.regexp_extract(name, SIZE_PATTERN, 1).try_cast("double")
    )


def result_suffix(think: Column) -> Column:
    return F.when(think, "_think").when(~think, "_nothink").otherwise("")
