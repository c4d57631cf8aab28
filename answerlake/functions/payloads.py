"""Model request/response payloads and answer-text patterns.

Payloads are built with ``to_json(struct(...))`` and read with ``from_json``
against an explicit schema: JVM-side, one pass, malformed bodies become NULL
instead of failing the job (P25).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.functions.text import JS_NOT_NL, JS_WS, js_trim, py_strip

# --- Fixed values: prompt template pieces and request parameters.
CONTEXT_SEP = ", "
CONTEXT_PREFIX = "Context: "
QUESTION_PREFIX = "\n\nQuestion: "
ANSWER_SUFFIX = "\n\nAnswer:"
DEFAULT_MODEL = "gpt-4o-mini"
ANSWER_MAX_TOKENS = 100

CHAT_RESPONSE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("object", T.StringType()),
    T.StructField("created", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("index", T.IntegerType()),
        T.StructField("message", T.StructType([
            T.StructField("role", T.StringType()),
            T.StructField("content", T.StringType())])),
        T.StructField("finish_reason", T.StringType())]))),
])

EMBEDDING_RESPONSE_SCHEMA = T.StructType([
    T.StructField("object", T.StringType()),
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("object", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("index", T.IntegerType())]))),
    T.StructField("model", T.StringType()),
])

CHAT_REQUEST_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType())]))),
    T.StructField("max_tokens", T.IntegerType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("top_p", T.DoubleType()),
])

#: Model, sampling limits and instruction of each request variant; variants without an instruction
#: send the user message alone.
REQUEST_VARIANTS = {
    "endpoint": {"model": "gpt-4", "max_tokens": 100, "n": 1, "temperature": 0.7},
    "categorise": {"model": "gpt-4o-mini", "max_tokens": 20, "temperature": 0.0, "top_p": 0.1},
    "candidate": {"model": "gpt-4o", "max_tokens": 150},
    "trivia": {"model": "gpt-4o", "max_tokens": 100},
}


def join_contexts(texts: Column) -> Column:
    """``', '.join(list)``."""
    return F.array_join(texts, CONTEXT_SEP)


def prompt(context: Column, question: Column) -> Column:
    """``Context: ...\\n\\nQuestion: ...\\n\\nAnswer:``."""
    return F.concat(F.lit(CONTEXT_PREFIX), context, F.lit(QUESTION_PREFIX), question, F.lit(ANSWER_SUFFIX))


def question_suffix(question: Column) -> Column:
    """The part of the prompt whose tokens are reserved by the budget rule."""
    return F.concat(F.lit("Question: "), question, F.lit(ANSWER_SUFFIX))


def chat_request(system: Column, user: Column, model: str = DEFAULT_MODEL,
                 max_tokens: int = ANSWER_MAX_TOKENS, temperature: float = 0.1) -> Column:
    """JSON body of a chat completion request (system + user message)."""
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.struct(
        F.lit(model).alias("model"),
        F.array(msg("system", system), msg("user", user)).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(1).alias("n"),
        F.lit(float(temperature)).alias("temperature")))


def request_body(variant: str, user: Column, system: Column | None = None) -> Column:
    """JSON body of one of ``REQUEST_VARIANTS`` around a built prompt; a NULL prompt has no request."""
    limits = dict(REQUEST_VARIANTS[variant])
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(*([message("system", system)] if system is not None else []), message("user", user))
    body = F.to_json(F.struct(F.lit(limits.pop("model")).alias("model"), messages.alias("messages"),
                              *[F.lit(v).alias(k) for k, v in limits.items()]))
    return F.when(user.isNotNull(), body)


def parse_chat_request(body: Column) -> Column:
    return F.from_json(body, CHAT_REQUEST_SCHEMA)


def chat_response_body(content: Column, resp_id: Column, model: str = DEFAULT_MODEL) -> Column:
    """A chat completion response envelope around ``content`` (for hooks/tests)."""
    return F.to_json(F.struct(
        resp_id.alias("id"), F.lit("chat.completion").alias("object"), F.lit(0).cast("long").alias("created"),
        F.lit(model).alias("model"),
        F.array(F.struct(F.lit(0).alias("index"),
                         F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message"),
                         F.lit("stop").alias("finish_reason"))).alias("choices")))


def response_content(body: Column) -> Column:
    """F8: ``choices[0].message.content.strip()``; NULL when unparseable."""
    parsed = F.from_json(body, CHAT_RESPONSE_SCHEMA)
    return py_strip(F.try_element_at(parsed.getField("choices"), F.lit(1)).getField("message").getField("content"))


def embedding_body(vec: Column) -> Column:
    return F.to_json(F.struct(
        F.lit("list").alias("object"),
        F.array(F.struct(F.lit("embedding").alias("object"), vec.cast("array<double>").alias("embedding"),
                         F.lit(0).alias("index"))).alias("data"),
        F.lit("embedding-model").alias("model")))


def embedding_vector(body: Column) -> Column:
    """``data[0].embedding``."""
    parsed = F.from_json(body, EMBEDDING_RESPONSE_SCHEMA)
    return F.try_element_at(parsed.getField("data"), F.lit(1)).getField("embedding")


# --- answer-text patterns of the browser side -------------------------------

URL_PATTERN = rf"http[^{JS_WS}]+"


def extract_reference(text: Column) -> tuple[Column, Column]:
    """first ``http\\S+``; text without that first occurrence, trimmed.

    Returns ``(text, reference)``; the reference defaults to the fixed text.
    """
    from answerlake.sources.inline import NO_REFERENCE
    url = F.regexp_extract(text, URL_PATTERN, 0)
    pos = F.position(url, text)  # 1-based position of the first occurrence
    head = F.when(pos > 1, text.substr(F.lit(1), pos - 1)).otherwise(F.lit(""))
    tail = text.substr(pos + F.length(url), F.length(text) + 1)
    cleaned = F.when(url == "", js_trim(text)).otherwise(js_trim(F.concat(head, tail)))
    reference = F.when(url == "", F.lit(NO_REFERENCE)).otherwise(url)
    return cleaned, reference


QUIZ_QUESTION = rf"(?i)Question:[{JS_WS}]*({JS_NOT_NL}*?)[{JS_WS}]*Answer:"


def quiz_answer_pattern(allowed: list[str]) -> str:
    return rf"(?i)Answer:[{JS_WS}]*(" + "|".join(allowed) + ")"


def parse_quiz(text: Column, allowed: list[str]) -> tuple[Column, Column]:
    """``(question, answer)``; both NULL unless both parts are present."""
    q = F.regexp_extract(text, QUIZ_QUESTION, 1)
    has_q = F.regexp_like(text, F.lit(QUIZ_QUESTION))
    a = F.regexp_extract(text, quiz_answer_pattern(allowed), 1)
    has_a = F.regexp_like(text, F.lit(quiz_answer_pattern(allowed)))
    ok = has_q & has_a
    return (F.when(ok, js_trim(q)), F.when(ok, js_trim(a)))
