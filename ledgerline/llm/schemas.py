"""Validation of JSON values against JSON schemas; a schema that says what is not looked at is refused."""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction

_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int,
    "number": (int, float),
}
#: Keywords that say nothing about a value.
ANNOTATIONS = frozenset("$schema $id $comment title description default examples deprecated readOnly writeOnly".split())
NUMBERS = frozenset("minimum maximum exclusiveMinimum exclusiveMaximum multipleOf".split())
COUNTS = frozenset("minLength maxLength minItems maxItems minProperties maxProperties".split())
LISTS_OF_SCHEMAS = frozenset("anyOf allOf oneOf".split())
KNOWN = NUMBERS | COUNTS | LISTS_OF_SCHEMAS | ANNOTATIONS | frozenset(
    "type enum const properties required additionalProperties patternProperties items uniqueItems pattern not".split()
)


def check_schema(schema: object, at: str = "$") -> None:
    """An error if schema is none, or has a keyword that faults does not look at or cannot read."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at} is no schema")
    unknown = sorted(set(schema) - KNOWN)
    if unknown:
        raise ValueError(f"{at} has unknown keywords: {', '.join(unknown)}")
    kinds = schema.get("type", [])
    if set([kinds] if isinstance(kinds, str) else kinds) - set(_TYPES):
        raise ValueError(f"{at} has an unknown type")
    for word in NUMBERS | COUNTS:
        n = schema.get(word, 1)
        if isinstance(n, bool) or not isinstance(n, (int, float) if word in NUMBERS else int) or (word == "multipleOf" and n <= 0):
            raise ValueError(f"{at}.{word} is {n!r}")
    for pattern in [*filter(None, [schema.get("pattern")]), *schema.get("patternProperties", ())]:
        try:
            re.compile(pattern)
        except (re.error, TypeError) as e:
            raise ValueError(f"{at} has a pattern that cannot be read: {pattern!r}") from e
    for word in ("items", "additionalProperties", "not"):
        if word in schema:
            check_schema(schema[word], f"{at}.{word}")
    for word in ("properties", "patternProperties"):
        for name, inner in schema.get(word, {}).items():
            check_schema(inner, f"{at}.{name}")
    for word in LISTS_OF_SCHEMAS & set(schema):
        for i, inner in enumerate(schema[word]):
            check_schema(inner, f"{at}.{word}[{i}]")


def _plain(value: object) -> str:
    """Equal for equal JSON values alone: true is not 1, but 1.0 is."""

    def same(x: object) -> object:
        if isinstance(x, float) and x.is_integer():
            return int(x)
        if isinstance(x, dict):
            return {k: same(v) for k, v in x.items()}
        return [same(v) for v in x] if isinstance(x, list) else x

    return json.dumps(same(value), sort_keys=True)


def _in_object(value: dict, schema: dict, at: str) -> list[str]:
    known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
    other = schema.get("additionalProperties", True)
    found = [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
    for k, v in value.items():
        inner = [known[k]] if k in known else []
        inner += [s for p, s in patterns.items() if re.search(p, k)]
        if not inner and other is False:
            found.append(f"{at}.{k}: unknown")
            continue
        for s in inner or [other]:
            found += faults(v, s, f"{at}.{k}")
    if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", math.inf):
        found.append(f"{at}: {len(value)} properties")
    return found


def _in_list(value: list, schema: dict, at: str) -> list[str]:
    found = [f for i, v in enumerate(value) for f in faults(v, schema.get("items", True), f"{at}[{i}]")]
    if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
        found.append(f"{at}: {len(value)} items")
    if schema.get("uniqueItems") and len(set(map(_plain, value))) < len(value):
        found.append(f"{at}: items repeat")
    return found


def _in_number(value: float, schema: dict, at: str) -> list[str]:
    inside = schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf)
    inside &= schema.get("exclusiveMinimum", -math.inf) < value < schema.get("exclusiveMaximum", math.inf)
    found = [] if inside else [f"{at}: out of range"]
    if "multipleOf" in schema and Fraction(str(value)) % Fraction(str(schema["multipleOf"])):
        found.append(f"{at}: no multiple of {schema['multipleOf']}")
    return found


def faults(value: object, schema: dict | bool, at: str = "$") -> list[str]:
    """What in value breaks schema, by the keywords of KNOWN; check_schema refuses all others. A pattern is looked for
    anywhere in a string, a multiple is told in decimals."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    kinds = schema.get("type", list(_TYPES))
    kinds = [kinds] if isinstance(kinds, str) else kinds

    def is_a(kind: str) -> bool:
        if kind == "integer" and isinstance(value, float):
            return value.is_integer()
        return isinstance(value, _TYPES[kind]) and (kind == "boolean" or not isinstance(value, bool))

    if not any(map(is_a, kinds)):
        return [f"{at}: no {' or '.join(kinds)}"]
    found = []
    for word, listed in (("enum", schema.get("enum")), ("const", [schema.get("const")])):
        if word in schema and _plain(value) not in map(_plain, listed):
            found.append(f"{at}: not listed")
    if isinstance(value, dict):
        found += _in_object(value, schema, at)
    elif isinstance(value, list):
        found += _in_list(value, schema, at)
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            found.append(f"{at}: length {len(value)}")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: no {schema['pattern']}")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        found += _in_number(value, schema, at)
    for inner in schema.get("allOf", ()):
        found += faults(value, inner, at)
    if "anyOf" in schema and all(faults(value, inner, at) for inner in schema["anyOf"]):
        found.append(f"{at}: fits none of anyOf")
    if "oneOf" in schema and sum(not faults(value, inner, at) for inner in schema["oneOf"]) != 1:
        found.append(f"{at}: fits not one of oneOf")
    if "not" in schema and not faults(value, schema["not"], at):
        found.append(f"{at}: fits not")
    return found
