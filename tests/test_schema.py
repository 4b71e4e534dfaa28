from __future__ import annotations

import copy
import json
import random
import re

import pytest

from markbook.sources import documents as docs
from markbook.sources import schema as sc


def kind_of(value):
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int) or (isinstance(value, float) and value == int(value)):
        return "integer"
    return {float: "number", str: "string", list: "array", dict: "object", type(None): "null"}[type(value)]


def plain(schema, value, at, root):
    """The rules one after the other, by recursion over the value."""
    while isinstance(schema, dict) and "$ref" in schema:
        parts, schema = schema["$ref"][2:].split("/"), root
        for part in parts:
            schema = schema[part]
    here = at or "document"
    if isinstance(schema, bool):
        return [] if schema else [f"{here}: not allowed"]
    kind, out = kind_of(value), []
    types = schema.get("type")
    types = [types] if isinstance(types, str) else types
    right = types is None or kind in types or (kind == "integer" and "number" in types)
    if not right:
        out.append(f"{here}: not a{'n' if types[0][0] in 'aio' else ''} {' or '.join(types)}")
    choices = schema.get("enum", [schema["const"]] if "const" in schema else None)
    if right and choices is not None and not any(kind_of(c) == kind and c == value for c in choices):
        out.append(f"{here}: not allowed")
    if kind in ("integer", "number"):
        low, high = schema.get("minimum"), schema.get("maximum")
        if low is not None and high is not None:
            out += [f"{here}: outside {low}..{high}"] * (not low <= value <= high)
        elif low is not None:
            out += [f"{here}: below {low}"] * (value < low)
        elif high is not None:
            out += [f"{here}: above {high}"] * (value > high)
        out += [f"{here}: not above {schema.get('exclusiveMinimum')}"] * (value <= schema.get("exclusiveMinimum", -1e99))
        out += [f"{here}: not below {schema.get('exclusiveMaximum')}"] * (value >= schema.get("exclusiveMaximum", 1e99))
        if "multipleOf" in schema and value % schema["multipleOf"]:
            out.append(f"{here}: not a multiple of {schema['multipleOf']}")
    if kind == "string":
        out += [f"{here}: shorter than {schema.get('minLength')}"] * (len(value) < schema.get("minLength", 0))
        out += [f"{here}: longer than {schema.get('maxLength')}"] * (len(value) > schema.get("maxLength", 1e99))
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{here}: does not match {schema['pattern']}")
    if kind == "array":
        out += [f"{here}: fewer than {schema.get('minItems')}"] * (len(value) < schema.get("minItems", 0))
        out += [f"{here}: more than {schema.get('maxItems')}"] * (len(value) > schema.get("maxItems", 1e99))
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            out.append(f"{here}: repeats a value")
        for i, v in enumerate(value):
            out += plain(schema.get("items", True), v, f"{at}[{i}]", root)
    if kind == "object":
        properties, below = schema.get("properties", {}), lambda n: f"{at}.{n}" if at else n
        for name in schema.get("required", []):
            out += [f"{below(name)}: missing"] * (name not in value)
        for name, v in value.items():
            out += plain(properties.get(name, schema.get("additionalProperties", True)), v, below(name), root)
        out += [f"{here}: fewer than {schema.get('minProperties')} members"] * (len(value) < schema.get("minProperties", 0))
        out += [f"{here}: more than {schema.get('maxProperties')} members"] * (len(value) > schema.get("maxProperties", 1e99))
    for part in schema.get("allOf", []):
        out += plain(part, value, at, root)
    if "anyOf" in schema and all(plain(p, value, at, root) for p in schema["anyOf"]):
        out.append(f"{here}: fits no alternative")
    if "oneOf" in schema and sum(not plain(p, value, at, root) for p in schema["oneOf"]) != 1:
        out.append(f"{here}: does not fit one alternative")
    if "not" in schema and not plain(schema["not"], value, at, root):
        out.append(f"{here}: not allowed")
    return out


def broken(draw, value):
    """A copy with one place changed at random."""
    value = copy.deepcopy(value)
    at, steps = value, draw.randrange(1, 5)
    for step in range(steps):
        if not at:
            break
        keys = list(at) if isinstance(at, dict) else range(len(at))
        key = draw.choice(list(keys))
        if step + 1 < steps and isinstance(at[key], dict | list) and at[key]:
            at = at[key]
            continue
        change = draw.randrange(3)
        if change == 0:
            del at[key]
        elif change == 1:
            at[key] = draw.choice([None, True, 0, 7, 2.0, 2.5, -1, "", "Year 3", "text", "x" * 9, [], ["a"], ["a", "a"], {}, {"a": 1}])
        elif isinstance(at, dict):
            at[draw.choice(["extra", "y", "answer"])] = draw.choice([1, "z", None])
        break
    return value


ALL_RULES = {
    "definitions": {
        "name": {"type": "string", "minLength": 2, "maxLength": 8, "pattern": "^[a-z' ]+$"},
        "pair": {"type": "array", "items": {"$ref": "#/definitions/name"}, "minItems": 1, "maxItems": 2, "uniqueItems": True},
    },
    "type": "object",
    "properties": {
        "a": {"$ref": "#/definitions/name"},
        "b": {"type": ["integer", "null"], "exclusiveMinimum": 0, "exclusiveMaximum": 10},
        "c": {"type": "number", "minimum": -1.5, "multipleOf": 0.5},
        "d": {"$ref": "#/definitions/pair"},
        "e": {"enum": ["it's", 3, True, None]},
        "f": {"const": 2},
        "g": {"type": "object", "additionalProperties": {"type": "integer"}, "minProperties": 1, "maxProperties": 2},
        "h": {"anyOf": [{"type": "string"}, {"type": "integer", "maximum": 3}], "not": {"const": "no"}},
        "i": {"oneOf": [{"type": "number"}, {"type": "integer"}, {"type": "string"}]},
        "j": {"allOf": [{"minLength": 3}, {"pattern": "^x"}], "maximum": 4},
        "k": False,
        "odd name.": {"type": "boolean"},
    },
    "required": ["a", "missing"],
    "additionalProperties": False,
}
GOOD = {"a": "it's", "b": None, "c": 2.5, "d": ["ab", "cd"], "e": 3, "f": 2.0, "g": {"x": 1}, "h": "yes", "i": 1.5, "j": "xyz",
        "odd name.": True}


def check(spark, rules, values):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, document string")
    got = {r["i"]: sorted(r["v"]) for r in rows.select("i", sc.violations(rules, "document").alias("v")).collect()}
    told = 0
    for i, value in enumerate(values):
        expected = sorted(plain(rules, value, "", rules))
        assert got[i] == expected, value
        told += len(expected)
    return told


def test_the_document_format_equals_plain_checks(spark, sample):
    draw = random.Random(1)
    values = [sample]
    for _ in range(400):
        values.append(broken(draw, draw.choice(values[-20:] + [sample] * 20)))
    assert check(spark, docs.FORMAT, values) > 300


def test_every_rule_equals_plain_checks(spark):
    draw = random.Random(2)
    values = [GOOD, {**GOOD, "missing": 1}, {}, [], "x", 3, None, {"k": 1}]
    for _ in range(500):
        values.append(broken(draw, draw.choice([GOOD, *values[-10:]])) if isinstance(values[-1], dict) else dict(GOOD))
    assert check(spark, ALL_RULES, values) > 800


def test_texts_that_are_no_json(spark):
    rows = spark.createDataFrame([(None,), ("",), ("{",), ("{}",)], "document string")
    got = [r["v"] for r in rows.select(sc.violations({"required": ["a"]}, "document").alias("v")).collect()]
    assert got == [["not JSON"]] * 3 + [["a: missing"]]


@pytest.mark.parametrize(
    ("rules", "message"),
    [
        ({"if": {}}, "not supported: if"),
        ({"properties": {"a": {"$ref": "#"}}}, "refers to itself"),
        ({"$ref": "other.json"}, "lies outside"),
        ({"$ref": "#/definitions/a"}, "is not there"),
        ({"type": "text"}, "unknown type"),
        ({"enum": [[1]]}, "only plain values"),
        ({"items": [{}]}, "a list of items"),
        ({"items": 3}, "is no schema"),
    ],
)
def test_schemas_that_cannot_be_compiled(rules, message):
    compiler = sc._Compiler(rules)
    with pytest.raises(sc.SchemaError, match=message):
        compiler.checks(rules, "v", "k", "''", ("#",))
