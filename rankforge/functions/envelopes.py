"""Provider replies and requests as JSON columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

CHAT = """custom_id string, error string, response struct<body: struct<
  choices: array<struct<message: struct<content: string>>>,
  usage: struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint,
    prompt_tokens_details: struct<cached_tokens: bigint>>>>"""
RESPONSES = """custom_id string, response struct<body: struct<
  output: array<struct<type: string, content: array<struct<type: string, text: string>>>>,
  choices: array<struct<message: struct<content: string>>>>>"""
MESSAGES = """custom_id string, result struct<type: string, message: struct<model: string,
  content: array<struct<type: string, text: string>>,
  usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint,
    cache_creation_input_tokens: bigint>>>"""
CANDIDATES = """key string, response struct<
  candidates: array<struct<content: struct<parts: array<struct<text: string>>>>>, text: string,
  usage_metadata: struct<prompt_token_count: bigint, candidates_token_count: bigint>,
  usageMetadata: struct<promptTokenCount: bigint, candidatesTokenCount: bigint>>"""
EMBEDDINGS = "custom_id string, response struct<body: struct<data: array<struct<index: int, embedding: array<double>>>>>"


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def chat_text(line: Column) -> Column:
    """First choice's content; empty on an error or an empty body."""
    e = F.from_json(line, CHAT)
    return _or_empty(F.when(e["error"].isNull(), F.get(e["response"]["body"]["choices"], 0)["message"]["content"]))


def chat_usage(line: Column) -> Column:
    """Prompt, completion and cached tokens, 0 where absent."""
    u = F.from_json(line, CHAT)["response"]["body"]["usage"]
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return F.struct(
        zero(u["prompt_tokens"]).alias("prompt"),
        zero(u["completion_tokens"]).alias("completion"),
        zero(u["prompt_tokens_details"]["cached_tokens"]).alias("cached"),
    )


def _texts(blocks: Column, kind: str) -> Column:
    return F.transform(F.filter(blocks, lambda b: b["type"] == kind), lambda b: _or_empty(b["text"]))


def responses_text(line: Column, mode: str = "all") -> Column:
    """Output text: of ``all`` blocks, of ``message`` blocks, or the ``first`` one.

    ``first`` falls back to the chat form when the reply has no output text.
    """
    body = F.from_json(line, RESPONSES)["response"]["body"]
    blocks = body["output"] if mode == "all" else F.filter(body["output"], lambda o: o["type"] == "message")
    texts = _texts(F.flatten(F.transform(blocks, lambda o: F.coalesce(o["content"], F.array()))), "output_text")
    if mode != "first":
        return _or_empty(F.array_join(texts, ""))
    filled = F.filter(texts, lambda t: t != "")
    return _or_empty(F.coalesce(F.get(filled, 0), F.get(body["choices"], 0)["message"]["content"]))


def messages_text(line: Column, mode: str = "all") -> Column:
    """Text blocks of a succeeded message, joined or the first one."""
    r = F.from_json(line, MESSAGES)["result"]
    texts = _texts(r["message"]["content"], "text")
    text = F.array_join(texts, "") if mode == "all" else F.get(texts, 0)
    return _or_empty(F.when(r["type"] == "succeeded", text))


def messages_cache_ratio(line: Column) -> tuple[Column, Column]:
    """Cached and all input tokens of a reply, to be summed and divided."""
    u = F.from_json(line, MESSAGES)["result"]["message"]["usage"]
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    read = zero(u["cache_read_input_tokens"])
    return read, read + zero(u["cache_creation_input_tokens"]) + zero(u["input_tokens"])


def candidates_text(line: Column) -> Column:
    """First non-empty part of any candidate, else the inline text."""
    r = F.from_json(line, CANDIDATES)["response"]
    parts = F.flatten(F.transform(r["candidates"], lambda c: F.coalesce(c["content"]["parts"], F.array())))
    filled = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t != "")
    return _or_empty(F.coalesce(F.get(filled, 0), r["text"]))


def candidates_prompt_tokens(line: Column) -> Column:
    """Prompt tokens under either spelling of the usage keys."""
    r = F.from_json(line, CANDIDATES)["response"]
    return F.coalesce(r["usage_metadata"]["prompt_token_count"], r["usageMetadata"]["promptTokenCount"])


def embedding_vectors(line: Column) -> Column:
    """Vectors of one reply in request order."""
    data = F.from_json(line, EMBEDDINGS)["response"]["body"]["data"]
    return F.transform(F.array_sort(data), lambda d: d["embedding"])


def chat_request(custom_id: Column, model: Column, prompt: Column, max_tokens: int) -> Column:
    """One request line for a chat batch."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    body = F.struct(model.alias("model"), F.array(message).alias("messages"), F.lit(0).alias("temperature"), F.lit(max_tokens).alias("max_tokens"))
    return F.to_json(
        F.struct(
            custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")
        )
    )


def parts_request(key: Column, prompt: Column) -> Column:
    """One request line for a batch of candidate-style models."""
    content = F.struct(F.lit("user").alias("role"), F.array(F.struct(prompt.alias("text"))).alias("parts"))
    return F.to_json(F.struct(key.alias("key"), F.struct(F.array(content).alias("contents")).alias("request")))
