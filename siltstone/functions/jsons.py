"""JSON as Column expressions: strict parsing, closed-schema validation, message fields."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Openers and closers of visible reasoning.
REASONING_BLOCKS = (
    r"(?is)<think(?:ing)?>.*?</think(?:ing)?>",
    r"(?is)<\|think\|>.*?<\|/think\|>",
    r"(?is)<\|channel>thought\s*.*?<channel\|>",
    r"(?is)<\|channel\|>thought\s*.*?<\|channel\|>",
)
#: Fixed value: a token that opens reasoning at the start of an answer.
LEADING_TOKEN = r"(?i)^\s*<\|think\|>\s*"
#: Fixed value: prose before a closer, which goes only if JSON follows it.
LEADING_PROSE = r"(?is)^\s*(?:(?!<think(?:ing)?>).)*?</think(?:ing)?>\s*(?=(?:```(?:json)?\s*)?\{)"
#: Fixed value: how much of an error's detail is kept.
MAX_DETAIL = 4000


def strip_reasoning(text: Column) -> Column:
    """Struct of the text without visible reasoning, and whether any was taken off."""
    cleaned = text
    for pattern in (*REASONING_BLOCKS, LEADING_TOKEN, LEADING_PROSE):
        cleaned = F.regexp_replace(cleaned, pattern, "")
    return F.struct(strip(cleaned).alias("text"), (cleaned != text).alias("removed"))


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """What ``made`` makes of a value that is worked out once, however often it is named in there."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _unfenced(bare: Column) -> Column:
    inner = F.regexp_extract(bare, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(F.startswith(bare, F.lit("```")) & bare.rlike(r"(?s)^```(?:json)?\s*.*?\s*```$"), strip(inner)).otherwise(bare)


def unfence(text: Column) -> Column:
    return once(strip(text), _unfenced)


def _is_one_value(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else (the parser by itself lets trailing text pass)."""
    wrapped = F.concat(F.lit('{"v":'), text, F.lit(',"w":1}'))
    keys = F.json_object_keys(wrapped)
    return F.coalesce((keys == F.array(F.lit("v"), F.lit("w"))) & (F.try_variant_get(F.try_parse_json(wrapped), "$.w", "int") == 1), F.lit(False))


def _judged(bare: Column) -> Column:
    problem = (
        F.when(bare.isNull(), "invalid_json")
        .when(F.startswith(bare, F.lit("{{")), "doubled_brace")
        .when(~_is_one_value(bare), "invalid_json")
        .when(~F.startswith(bare, F.lit("{")), "not_object")  # of one value without space before it
    )
    return once(problem, lambda p: F.struct(F.when(p.isNull(), bare).alias("json"), p.alias("problem")))


def parse_object(text: Column) -> Column:
    """Struct (json, problem): the object's text, or the first of doubled_brace, invalid_json, not_object."""
    return once(unfence(text), _judged)


def _type_ok(kind: Column, wanted: str | list[str]) -> Column:
    if isinstance(wanted, list):
        out = _type_ok(kind, wanted[0])
        for w in wanted[1:]:
            out = out | _type_ok(kind, w)
        return out
    patterns = {"string": r"^STRING$", "number": r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "integer": r"^BIGINT$", "boolean": r"^BOOLEAN$", "array": r"^ARRAY<", "object": r"^OBJECT<", "null": r"^VOID$"}
    return kind.rlike(patterns[wanted])


def _breaks(name: str, rules: Mapping[str, Any], code: str):
    return lambda x: F.coalesce(next(broken for c, broken in _value_problems(name, x, rules) if c == code), F.lit(False))


def _value_problems(name: str, value: Column, schema: Mapping[str, Any]) -> list[tuple[str, Column]]:
    """(code, whether it is broken) of one variant value, in order."""
    out: list[tuple[str, Column]] = []
    kind = F.schema_of_variant(value)
    wanted = schema.get("type")
    if wanted:
        out.append((f"{name}:type", ~_type_ok(kind, wanted)))
    plain = F.try_variant_get(value, "$", "string")
    if "enum" in schema:
        allowed = [x for x in schema["enum"] if x is not None]
        out.append((f"{name}:enum", ~F.coalesce(plain.isin(*allowed), F.lit(None in schema["enum"]))))
    if "pattern" in schema:
        out.append((f"{name}:pattern", ~plain.rlike(schema["pattern"])))
    if "minLength" in schema:
        out.append((f"{name}:minLength", F.char_length(plain) < schema["minLength"]))
    if "maxLength" in schema:
        out.append((f"{name}:maxLength", F.char_length(plain) > schema["maxLength"]))
    number = F.try_variant_get(value, "$", "double")
    if "minimum" in schema:
        out.append((f"{name}:minimum", number < schema["minimum"]))
    if "maximum" in schema:
        out.append((f"{name}:maximum", number > schema["maximum"]))
    if wanted == "array":
        items = F.try_variant_get(value, "$", "array<variant>")
        if "minItems" in schema:
            out.append((f"{name}:minItems", F.size(items) < schema["minItems"]))
        if "maxItems" in schema:
            out.append((f"{name}:maxItems", F.size(items) > schema["maxItems"]))
        if schema.get("uniqueItems"):
            texts = F.transform(items, lambda x: F.to_json(x))
            out.append((f"{name}:uniqueItems", F.size(F.array_distinct(texts)) < F.size(texts)))
        rules = schema.get("items", {})
        for code, _ in _value_problems(f"{name}[]", F.lit(None).cast("variant"), rules):
            out.append((code, F.exists(items, _breaks(f"{name}[]", rules, code))))
    return out


def opened(json: Column) -> Column:
    """Struct (keys, value) of an object's text. Put into a column of its own, it is parsed once for all rules."""
    return F.struct(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")).alias("keys"), F.try_parse_json(json).alias("value"))


def opened_problems(there: Column, schema: Mapping[str, Any]) -> list[tuple[str, Column]]:
    """(code, whether it is broken) for a closed object schema: required, unexpected, then each property's own rules. See ``opened``."""
    keys, parsed = there["keys"], there["value"]
    out = [(f"{name}:required", ~F.array_contains(keys, name)) for name in schema.get("required", [])]
    if schema.get("additionalProperties") is False:
        known = F.array(*[F.lit(n) for n in schema["properties"]])
        out.append(("unexpected", F.size(F.array_except(keys, known)) > 0))
    for name, rules in schema.get("properties", {}).items():
        value = F.try_variant_get(parsed, f"$.{name}", "variant")
        out += [(code, F.array_contains(keys, name) & broken) for code, broken in _value_problems(name, value, rules)]
    return out


def schema_problems(json: Column, schema: Mapping[str, Any]) -> list[tuple[str, Column]]:
    """The same for an object's text, parsed anew in each rule: for the odd row; else see ``opened``."""
    return opened_problems(opened(json), schema)


def first_problem(problems: list[tuple[str, Column]]) -> Column:
    """The code of the first rule that is broken; null if none is. A rule on a missing value is not broken."""
    out = F.lit(None).cast("string")
    for code, broken in reversed(problems):
        out = F.when(F.coalesce(broken, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def all_problems(problems: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in problems]), lambda x: x.isNotNull())


def schema_for_grammar(schema: Any, unsupported: tuple[str, ...] = ("uniqueItems",)) -> Any:
    """A copy of a schema without keywords that a decoding grammar does not know."""
    if isinstance(schema, Mapping):
        return {k: schema_for_grammar(v, unsupported) for k, v in schema.items() if k not in unsupported}
    return [schema_for_grammar(v, unsupported) for v in schema] if isinstance(schema, list) else schema


def canonical_json(**columns: Column) -> Column:
    """Compact JSON with sorted keys, nulls kept."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def field_state(json: Column, name: str) -> Column:
    """missing, null, empty or nonempty."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    value = F.get_json_object(json, f"$.{name}")
    return F.when(~F.array_contains(keys, name), "missing").when(value.isNull(), "null").when(value == "", "empty").otherwise("nonempty")


def message_text(response: Column, structured: bool = False) -> Column:
    """Struct (text, problem) of a chat response: no_choices, length_partial, length_empty, reasoning_only, no_content."""
    at = lambda path: F.get_json_object(response, path)
    said = {"content": "message.content", "reason": "finish_reason", "reasoning": "message.reasoning", "reasoning_content": "message.reasoning_content"}
    found = F.struct(at("$.choices[0]").isNotNull().alias("there"), *[at(f"$.choices[0].{path}").alias(name) for name, path in said.items()])
    return once(found, lambda m: _message_text(m, structured))


def _message_text(m: Column, structured: bool) -> Column:
    empty = F.coalesce(m["content"], F.lit("")) == ""
    fields = [F.coalesce(m[f], F.lit("")) for f in ("reasoning", "reasoning_content")]
    rescued = F.lit(None).cast("string")
    if structured:
        for f in reversed(fields):
            whole = (f != "") & parse_object(f)["problem"].isNull() & ~F.startswith(strip(f), F.lit("`"))
            rescued = F.when(whole, strip(f)).otherwise(rescued)
    rescued = F.when(empty & (m["reason"] == "stop"), rescued)

    def told(r: Column) -> Column:
        problem = (
            F.when(~m["there"], "no_choices")
            .when((m["reason"] == "length") & ~empty, "length_partial")
            .when(m["reason"] == "length", "length_empty")
            .when(~empty | r.isNotNull(), F.lit(None))
            .when((fields[0] != "") | (fields[1] != ""), "reasoning_only")
            .otherwise("no_content")
        )
        return F.struct(F.when(problem.isNull(), F.when(empty, r).otherwise(m["content"])).alias("text"), problem.alias("problem"))

    return once(rescued, told)


def _quoted(text: Column) -> Column:
    """A text between quotes, single ones unless it holds those alone."""
    plain = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(single)


def error_detail(body: Column) -> Column:
    """What an HTTP error body says: its error's fields, its detail, or all of it, cut to a fixed length."""
    value = F.try_parse_json(body)

    def shown(name: str) -> Column:
        at = F.try_variant_get(value, f"$.error.{name}", "variant")
        text = F.get_json_object(body, f"$.error.{name}")
        said = F.when(F.schema_of_variant(at) == "STRING", _quoted(text)).otherwise(text)
        return F.when(text != "", F.concat(F.lit(f"{name}="), said))

    joined = F.nullif(F.concat_ws(", ", *[shown(k) for k in ("message", "type", "param", "code")]), F.lit(""))
    detail = F.nullif(F.get_json_object(body, "$.detail"), F.lit(""))
    whole = F.when(F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), F.to_json(value))
    text = F.coalesce(joined, detail, whole, F.nullif(strip(body), F.lit("")), F.lit("empty error response"))
    return F.when(F.char_length(text) > MAX_DETAIL, F.concat(F.substring(text, 1, MAX_DETAIL), F.lit("... [truncated]"))).otherwise(text)


def request_summary(request: Column, standard: tuple[str, ...] = ("model", "messages", "temperature", "top_p", "max_tokens", "response_format")) -> Column:
    """What a request asked for, without the text of its messages."""
    messages = F.get_json_object(request, "$.messages")
    extra = F.array_sort(F.array_except(F.coalesce(F.json_object_keys(request), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in standard])))
    return F.struct(F.get_json_object(request, "$.model").alias("model"), F.json_array_length(messages).alias("message_count"), prompt_chars(request).alias("prompt_chars"), F.get_json_object(request, "$.response_format.type").alias("response_format"), extra.alias("extra_fields"))


def prompt_chars(request: Column) -> Column:
    contents = F.from_json(F.get_json_object(request, "$.messages"), "array<struct<role:string,content:string>>")
    return F.aggregate(contents, F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.char_length(m["content"]), F.lit(0)))


def is_retryable(status: Column) -> Column:
    return status.isin(408, 425, 429) | (status >= 500)


def backoff_seconds(attempt: Column, initial: float = 1.0, most: float = 30.0, factor: float = 2.0) -> Column:
    """Delay after an attempt (from 1), before jitter."""
    return F.least(F.lit(initial) * F.pow(F.lit(factor), F.greatest(attempt - 1, F.lit(0))), F.lit(most))
