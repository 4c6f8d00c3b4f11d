"""JSON schemas: every keyword, JSON equality, and schemas that are refused."""

import pytest

from ledgerline.llm import schemas, tools


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"pattern": "^a+$"}, ["aa", 5], ["ab", ""]), ({"minLength": 1, "maxLength": 2}, ["é", "日本"], ["", "abc"]),
        ({"enum": [1, "x", None]}, [1, 1.0, "x", None], [True, 0, "1"]), ({"const": {"a": [1]}}, [{"a": [1.0]}], [{"a": [True]}, None]),
        ({"minItems": 1, "maxItems": 2}, [[1], [1, 2]], [[], [1, 2, 3]]), ({"uniqueItems": True}, [[1, True, "1"], []], [[1, 1.0], [{"a": 1}, {"a": 1}]]),
        ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, [2, 2.9, "x", True], [1, 3]), ({"minimum": 1, "maximum": 3}, [1, 3], [0.9, 3.1]),
        ({"multipleOf": 0.1}, [0.3, 2, 0], [0.35]), ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["x", 6], [4]),
        ({"oneOf": [{"minimum": 1}, {"maximum": 3}]}, [0, 4], [2]), ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, [2], [0, 4]),
        ({"not": {"type": "null"}}, [0], [None]), ({"items": {"type": "integer"}}, [[1, 2.0]], [[1, "2"], [True]]), ({"items": False}, [[]], [[1]]),
        ({"minProperties": 1, "maxProperties": 1}, [{"a": 1}], [{}, {"a": 1, "b": 2}]), ({"type": ["integer", "null"]}, [1, None, 2.0], [1.5, "1", True]),
        ({"properties": {"a": {"type": "string"}}, "patternProperties": {"^n_": {"type": "number"}}, "additionalProperties": {"type": "boolean"}},
         [{"a": "x", "n_1": 2, "z": True}], [{"a": 1}, {"n_1": "2"}, {"z": 1}]),
    ],
)
def test_keywords(schema, good, bad):
    schemas.check_schema(schema)
    assert [v for v in good if schemas.faults(v, schema)] == [] and [v for v in bad if not schemas.faults(v, schema)] == []


@pytest.mark.parametrize("schema", [
    {"minimun": 1}, {"$ref": "#/x"}, {"properties": {"a": {"format": "date"}}}, {"items": [{"type": "string"}]}, {"anyOf": [{"if": {}}]},
    {"pattern": "("}, {"type": "text"}, {"minLength": "1"}, {"multipleOf": 0}, 5,
])
def test_schemas_with_more_than_is_looked_at_are_refused(schema, table):
    with pytest.raises(ValueError):
        schemas.check_schema(schema)
    calls = table([], "conv_id long, call_id string, turn int, name string, arguments string, after string")
    with pytest.raises(ValueError):
        tools.link_calls(calls, table([], "conv_id long, call_id string, turn int, content string"), {"tool": schema})
