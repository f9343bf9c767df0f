"""JSON schemas compiled to column rules over a variant.

Every keyword becomes one condition at its place in the document; what a row violates is listed as ``place:keyword``.
Known keywords: type, required, properties, additionalProperties (false), enum, const, pattern, minLength, maxLength,
minimum, maximum, minItems, maxItems, uniqueItems, items, contains, format (date, date-time), allOf, anyOf, not and
if/then/else. A keyword that the compiler doesn't know is refused, so no rule is passed over in silence.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTES = frozenset("$schema $id title description default examples $comment".split())
KNOWN = frozenset("type required properties additionalProperties enum const pattern minLength maxLength minimum maximum minItems maxItems uniqueItems items contains format allOf anyOf not if then else".split())
#: Between codes: a control character, which is part of no name.
_SEP = "\x1f"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _kind(v: Column) -> Column:
    """JSON type of a variant, without telling integers from other numbers."""
    return _with(F.schema_of_variant(v), lambda k: F.when(k.startswith("OBJECT"), "object").when(k.startswith("ARRAY"), "array").when(k == "VOID", "null").when(k.isin("STRING", "BOOLEAN"), F.lower(k)).otherwise("number"))


def _facts(v: Column, kind: Column) -> Column:
    """What the keywords ask of a variant; a field is null where the type has no such thing."""
    of = lambda name, to: F.when(kind == name, F.try_variant_get(v, "$", to))
    return F.struct(
        v.alias("v"), kind.alias("kind"), of("string", "string").alias("text"), of("number", "decimal(38,9)").alias("number"), of("boolean", "boolean").alias("flag"),
        of("array", "array<variant>").alias("items"), F.map_keys(of("object", "map<string,variant>")).alias("keys"),
    )


def _is(x: Column, name: str) -> Column:
    """Whether a value (by its facts) is of a JSON type."""
    if name == "integer":
        return (x["kind"] == "number") & F.coalesce(x["number"] % 1 == 0, F.lit(False))
    if name not in ("object", "array", "string", "boolean", "null", "number"):
        raise ValueError(f"no type {name}")
    return x["kind"] == name


def _equals(x: Column, value: Any) -> Column:
    """Whether a value (by its facts) is a scalar JSON value."""
    if value is None:
        return _is(x, "null")
    if isinstance(value, bool):
        return _sure(x["flag"] == value)
    if isinstance(value, str):
        return _sure(x["text"] == value)
    if isinstance(value, (int, float)):
        return _sure(x["number"] == F.lit(value).cast("decimal(38,9)"))
    raise ValueError(f"only scalars are compared: {value!r}")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def rules(schema: dict | bool, v: Column, at: str = "$", mark: str = "") -> Column:
    """The codes (place:keyword and ``mark``) that a variant violates, joined by _SEP; empty where it violates nothing or is absent (SQL null).

    A value and what is asked of it are bound once at each place, so the work grows with the schema, not with its depth.
    The result is always a concat_ws: its type and that it is never null are known without a look at what it is made of,
    which Spark takes anew for each row at each level of bound values.
    """
    if schema is True or schema is False:
        return F.concat_ws(_SEP, F.when(v.isNotNull() & F.lit(not schema), F.lit(f"{at}:false{mark}")))
    if unknown := set(schema) - KNOWN - NOTES:
        raise ValueError(f"{at}: no rule for {', '.join(sorted(unknown))}")
    if not set(schema) & KNOWN:
        return F.concat_ws(_SEP)

    def judged(x: Column) -> Column:
        return F.concat_ws(_SEP, *_judge(schema, x, at, mark))

    return F.concat_ws(_SEP, _with(v, lambda w: F.concat_ws(_SEP, F.when(w.isNotNull(), _with(_kind(w), lambda kind: _with(_facts(w, kind), judged))))))


def _judge(schema: dict, x: Column, at: str, mark: str) -> list[Column]:
    """What the keywords of a schema find by the facts of a value, and the places below: a code, null or joined codes each."""
    parts: list[Column] = []
    v, text, number, items = x["v"], x["text"], x["number"], x["items"]

    def rule(keyword: str, applies: Column, good: Column) -> None:
        parts.append(F.when(_sure(applies) & ~_sure(good), F.lit(f"{at}:{keyword}{mark}")))

    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        rule("type", F.lit(True), _any([_is(x, n) for n in names]))
    if "enum" in schema:
        rule("enum", F.lit(True), _any([_equals(x, e) for e in schema["enum"]]))
    if "const" in schema:
        rule("const", F.lit(True), _equals(x, schema["const"]))
    size = F.char_length(text)
    for keyword, good in {"minLength": lambda n: size >= n, "maxLength": lambda n: size <= n, "pattern": lambda p: text.rlike(p)}.items():
        if keyword in schema:
            rule(keyword, _is(x, "string"), good(schema[keyword]))
    if "format" in schema:
        rule("format", _is(x, "string"), _format(text, schema["format"]))
    for keyword, good in {"minimum": lambda n: number >= n, "maximum": lambda n: number <= n}.items():
        if keyword in schema:
            rule(keyword, _is(x, "number"), good(schema[keyword]))
    array = _is(x, "array")
    for keyword, good in {"minItems": lambda n: F.size(items) >= n, "maxItems": lambda n: F.size(items) <= n}.items():
        if keyword in schema:
            rule(keyword, array, good(schema[keyword]))
    if schema.get("uniqueItems"):
        rule("uniqueItems", array, _with(F.transform(items, lambda e: F.to_json(e)), lambda as_text: F.size(F.array_distinct(as_text)) == F.size(as_text)))
    if "contains" in schema:
        rule("contains", array, F.exists(items, lambda e: valid(schema["contains"], e)))
    if "items" in schema:  # a code counts once, whichever elements violate it
        parts.append(F.array_distinct(F.transform(items, lambda e: rules(schema["items"], e, f"{at}[]", mark))))
    obj = _is(x, "object")
    for name in schema.get("required") or []:
        rule(f"required.{name}", obj, F.array_contains(x["keys"], name))
    if schema.get("additionalProperties") is False:
        allowed = F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>")
        rule("additionalProperties", obj, F.size(F.array_except(x["keys"], allowed)) == 0)
    elif not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at}: additionalProperties can only be true or false")
    for name, below in schema.get("properties", {}).items():
        parts.append(rules(below, F.when(obj, F.try_variant_get(v, f"$['{name}']", "variant")), f"{at}.{name}", mark))
    for below in schema.get("allOf", []):
        parts.append(rules(below, v, at, mark))
    if "anyOf" in schema:
        rule("anyOf", F.lit(True), _any([valid(below, v) for below in schema["anyOf"]]))
    if "not" in schema:
        rule("not", F.lit(True), ~valid(schema["not"], v))
    if "if" in schema:
        then, other = (rules(schema.get(branch, True), v, at, f"({branch}){mark}") for branch in ("then", "else"))
        parts.append(F.when(valid(schema["if"], v), then).otherwise(other))
    return parts


def _format(text: Column, name: str) -> Column:
    if name == "date":
        return text.rlike(_DATE) & F.try_to_date(text, "yyyy-MM-dd").isNotNull()
    if name == "date-time":
        return text.rlike(_TIME) & text.try_cast("timestamp").isNotNull()
    raise ValueError(f"no rule for format {name}")


def valid(schema: dict | bool, v: Column) -> Column:
    """Whether a variant violates nothing; never null."""
    return ~rules(schema, v).rlike(f"[^{_SEP}]")


def violations(schema: dict, document: Column) -> Column:
    """Sorted distinct codes of what a JSON text violates; ``$:json`` alone for one that is none or null."""
    codes = _with(F.try_parse_json(document), lambda v: F.concat_ws(_SEP, F.when(v.isNull(), F.lit("$:json")).otherwise(rules(schema, v))))
    return F.array_sort(F.array_distinct(F.filter(F.split(codes, _SEP), lambda code: code != "")))
