"""Draft-07 JSON Schemas as Column expressions.

A schema becomes one SQL expression over a variant, which lists what a document breaks as
``path: message``.  Nothing is interpreted per row: the keywords are read once, when the
expression is built.  Texts that are no rule (titles, descriptions, formats) are passed over;
a keyword that is not supported is an error, so no rule is skipped silently.

``format`` is an annotation, as in the draft.  ``pattern`` is a Java regular expression.  A
number with a zero fraction is an integer; a boolean is not.  A null is a value of type
``null``, not an absent one.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = "cast(array() as array<string>)"
_ANNOTATIONS = {
    "$schema", "$id", "$comment", "title", "description", "default", "examples", "format", "definitions", "$defs",
    "readOnly", "writeOnly", "contentMediaType", "contentEncoding",
}
_RULES = {
    "$ref", "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf",
    "minLength", "maxLength", "pattern", "items", "minItems", "maxItems", "uniqueItems", "properties", "required",
    "additionalProperties", "minProperties", "maxProperties", "allOf", "anyOf", "oneOf", "not",
}
_TYPES = ("string", "integer", "number", "boolean", "object", "array", "null")


class SchemaError(ValueError):
    """A schema that is wrong, or asks for more than an expression can say."""


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _number(value) -> str:
    return f"cast('{value!r}' as double)"


class _Compiler:
    def __init__(self, root: dict | bool) -> None:
        self.root = root
        self.names = count()

    def let(self, value: str, body: Callable[[str], str]) -> str:
        """Name a value, so that it is worked out once."""
        name = f"x{next(self.names)}"
        return f"get(transform(array({value}), {name} -> {body(name)}), 0)"

    def kind(self, value: str) -> str:
        """JSON type of a variant; null where it is absent."""
        number = f"try_variant_get({value}, '$', 'double')"
        return self.let(
            f"schema_of_variant({value})",
            lambda t: f"""case
              when {t} = 'STRING' then 'string' when {t} = 'BIGINT' then 'integer'
              when {t} like 'DECIMAL%' or {t} in ('DOUBLE', 'FLOAT')
                then if({number} = floor({number}), 'integer', 'number')
              when {t} = 'BOOLEAN' then 'boolean' when {t} = 'VOID' then 'null'
              when {t} like 'ARRAY%' then 'array' when {t} is not null then 'object' end""",
        )

    def resolved(self, schema, stack: tuple[str, ...]):
        """Follow references within the schema; one that leads back to itself has no expression."""
        while isinstance(schema, dict) and "$ref" in schema:
            ref = schema["$ref"]
            if ref in stack:
                raise SchemaError(f"{ref} refers to itself")
            if not ref.startswith("#"):
                raise SchemaError(f"{ref} lies outside the schema")
            stack += (ref,)
            schema = self.root
            for part in ref[1:].strip("/").split("/") if ref != "#" else ():
                try:
                    schema = schema[part.replace("~1", "/").replace("~0", "~")]
                except (KeyError, TypeError):
                    raise SchemaError(f"{ref} is not there") from None
        if not isinstance(schema, bool | dict):
            raise SchemaError(f"{schema!r} is no schema")
        unknown = set(schema) - _ANNOTATIONS - _RULES if isinstance(schema, dict) else ()
        if unknown:
            raise SchemaError(f"not supported: {', '.join(sorted(unknown))}")
        return schema, stack

    def found(self, schema, value: str, at: str, stack: tuple[str, ...], absent: str = "null") -> str:
        """Messages about a value and, where it is absent, ``absent``."""

        def look(v: str) -> str:
            def with_kind(k: str) -> str:
                return f"if({k} is null, array({absent}), {self.joined(self.checks(schema, v, k, at, stack))})"

            return self.let(self.kind(v), with_kind)

        return self.let(value, look)

    @staticmethod
    def joined(parts: list[str]) -> str:
        return f"concat({', '.join(parts)})" if parts else NOTHING

    def checks(self, schema, value: str, kind: str, at: str, stack: tuple[str, ...]) -> list[str]:
        schema, stack = self.resolved(schema, stack)
        where = "'document'" if at == "''" else at
        if isinstance(schema, bool):
            return [] if schema else [f"array(concat({where}, ': not allowed'))"]

        def told(condition: str, message: str) -> str:
            return f"array(if({condition}, concat({where}, {_text(': ' + message)}), null))"

        out = []
        right = "true"
        if "type" in schema:
            right, message = self.types(schema["type"], kind)
            out.append(told(f"not {right}", message))
        for name in ("enum", "const"):
            if name in schema:
                allowed = self.allowed(schema[name] if name == "enum" else [schema[name]], value, kind)
                out.append(told(f"{right} and not ({allowed})", "not allowed"))
        out += [told(f"{kind} in ('integer', 'number') and {c}", m) for c, m in self.numbers(schema, value)]
        out += [told(f"{kind} = 'string' and {c}", m) for c, m in self.strings(schema, value)]
        out += self.arrays(schema, value, kind, at, stack, told)
        out += self.objects(schema, value, kind, at, stack, told)
        out += self.combined(schema, value, kind, at, stack, told)
        return out

    def types(self, types, kind: str) -> tuple[str, str]:
        names = [types] if isinstance(types, str) else list(types)
        if not names or any(n not in _TYPES for n in names):
            raise SchemaError(f"unknown type {types!r}")
        kinds = {*names, *(["integer"] if "number" in names else [])}
        listed = ", ".join(f"'{k}'" for k in _TYPES if k in kinds)
        article = "an" if names[0][0] in "aio" else "a"
        return f"{kind} in ({listed})", f"not {article} {' or '.join(names)}"

    def allowed(self, choices: list, value: str, kind: str) -> str:
        if not isinstance(choices, list) or not choices:
            raise SchemaError("an enum lists its values")
        texts = [c for c in choices if isinstance(c, str)]
        numbers = [c for c in choices if isinstance(c, int | float) and not isinstance(c, bool)]
        flags = [c for c in choices if isinstance(c, bool)]
        tests = []
        if texts:
            tests.append(f"{kind} = 'string' and try_variant_get({value}, '$', 'string') in ({', '.join(map(_text, texts))})")
        if numbers:
            listed = ", ".join(map(_number, numbers))
            tests.append(f"{kind} in ('integer', 'number') and try_variant_get({value}, '$', 'double') in ({listed})")
        if flags:
            listed = ", ".join(str(f).lower() for f in flags)
            tests.append(f"{kind} = 'boolean' and try_variant_get({value}, '$', 'boolean') in ({listed})")
        if None in choices:
            tests.append(f"{kind} = 'null'")
        if len(texts) + len(numbers) + len(flags) + choices.count(None) < len(choices):
            raise SchemaError("only plain values can be compared")
        return " or ".join(f"({t})" for t in tests)

    def numbers(self, schema: dict, value: str) -> list[tuple[str, str]]:
        number = f"try_variant_get({value}, '$', 'double')"
        low, high = schema.get("minimum"), schema.get("maximum")
        out = []
        if low is not None and high is not None:
            out.append((f"{number} not between {_number(low)} and {_number(high)}", f"outside {low}..{high}"))
        elif low is not None:
            out.append((f"{number} < {_number(low)}", f"below {low}"))
        elif high is not None:
            out.append((f"{number} > {_number(high)}", f"above {high}"))
        if (least := schema.get("exclusiveMinimum")) is not None:
            out.append((f"{number} <= {_number(least)}", f"not above {least}"))
        if (most := schema.get("exclusiveMaximum")) is not None:
            out.append((f"{number} >= {_number(most)}", f"not below {most}"))
        if (step := schema.get("multipleOf")) is not None:
            out.append((f"{number} / {_number(step)} <> floor({number} / {_number(step)})", f"not a multiple of {step}"))
        return out

    def strings(self, schema: dict, value: str) -> list[tuple[str, str]]:
        text = f"try_variant_get({value}, '$', 'string')"
        out = []
        if (least := schema.get("minLength")) is not None:
            out.append((f"char_length({text}) < {int(least)}", f"shorter than {int(least)}"))
        if (most := schema.get("maxLength")) is not None:
            out.append((f"char_length({text}) > {int(most)}", f"longer than {int(most)}"))
        if (pattern := schema.get("pattern")) is not None:
            out.append((f"not ({text} rlike {_text(pattern)})", f"does not match {pattern}"))
        return out

    def arrays(self, schema: dict, value: str, kind: str, at: str, stack, told) -> list[str]:
        if not {"items", "minItems", "maxItems", "uniqueItems"} & set(schema):
            return []
        if isinstance(schema.get("items"), list):
            raise SchemaError("not supported: a list of items")
        elements = f"""coalesce(if({kind} = 'array', try_variant_get({value}, '$', 'array<variant>'), null),
          cast(array() as array<variant>))"""
        out = []
        if (least := schema.get("minItems")) is not None:
            out.append(told(f"{kind} = 'array' and size({elements}) < {int(least)}", f"fewer than {int(least)}"))
        if (most := schema.get("maxItems")) is not None:
            out.append(told(f"{kind} = 'array' and size({elements}) > {int(most)}", f"more than {int(most)}"))
        if schema.get("uniqueItems"):
            e = f"e{next(self.names)}"
            texts = f"transform({elements}, {e} -> to_json({e}))"
            out.append(told(f"{kind} = 'array' and size(array_distinct({texts})) < size({elements})", "repeats a value"))
        if "items" in schema:
            e, i = f"e{next(self.names)}", f"i{next(self.names)}"
            inside = self.let(
                self.kind(e),
                lambda k: self.joined(self.checks(schema["items"], e, k, f"concat({at}, '[', {i}, ']')", stack)),
            )
            out.append(f"flatten(transform({elements}, ({e}, {i}) -> {inside}))")
        return out

    def objects(self, schema: dict, value: str, kind: str, at: str, stack, told) -> list[str]:
        properties, required = schema.get("properties", {}), schema.get("required", [])
        parts = []
        for name in [*properties, *(n for n in required if n not in properties)]:
            here = self.below(at, name)
            absent = f"concat({here}, ': missing')" if name in required else "null"
            parts.append(self.found(properties.get(name, True), self.member(value, name), here, stack, absent))
        fields = f"try_variant_get({value}, '$', 'map<string,variant>')"
        extra = schema.get("additionalProperties", True)
        if extra is not True:
            listed = f"array({', '.join(map(_text, properties))})" if properties else NOTHING
            n = f"n{next(self.names)}"
            here = f"concat({at}, if({at} = '', '', '.'), {n})"
            inside = self.let(
                f"element_at({fields}, {n})",
                lambda v: self.let(self.kind(v), lambda k: self.joined(self.checks(extra, v, k, here, stack))),
            )
            parts.append(f"flatten(transform(array_except(map_keys({fields}), {listed}), {n} -> {inside}))")
        for name, sign, word in (("minProperties", "<", "fewer"), ("maxProperties", ">", "more")):
            if name in schema:
                bound = int(schema[name])
                parts.append(told(f"cardinality({fields}) {sign} {bound}", f"{word} than {bound} members"))
        return [f"if({kind} = 'object', {self.joined(parts)}, {NOTHING})"] if parts else []

    def combined(self, schema: dict, value: str, kind: str, at: str, stack, told) -> list[str]:
        out = []
        for part in schema.get("allOf", []):
            out += self.checks(part, value, kind, at, stack)

        def fits(part) -> str:
            return f"not exists({self.joined(self.checks(part, value, kind, at, stack))}, m -> m is not null)"

        if "anyOf" in schema:
            out.append(told(f"not ({' or '.join(map(fits, schema['anyOf']))})", "fits no alternative"))
        if "oneOf" in schema:
            number = " + ".join(f"if({fits(part)}, 1, 0)" for part in schema["oneOf"])
            out.append(told(f"({number}) <> 1", "does not fit one alternative"))
        if "not" in schema:
            out.append(told(fits(schema["not"]), "not allowed"))
        return out

    @staticmethod
    def member(value: str, name: str) -> str:
        if "'" in name or '"' in name or "\\" in name:
            raise SchemaError(f"not supported: a member named {name}")
        path = _text(f'$["{name}"]')
        return f"variant_get({value}, {path}, 'variant')"

    @staticmethod
    def below(at: str, name: str) -> str:
        return _text(name) if at == "''" else f"concat({at}, {_text('.' + name)})"


def violations(rules: dict | bool, document: str, where: str = "", root: dict | bool | None = None) -> Column:
    """What the JSON text column ``document`` breaks, as an array of ``path: message``.

    ``where`` is the path of the document itself, if it is a part of another; ``root`` is the
    schema that references are looked up in, by default ``rules``.  Text that is null or
    no JSON breaks ``not JSON`` alone.
    """
    compiler = _Compiler(rules if root is None else root)
    at = _text(where)

    def look(v: str) -> str:
        def with_kind(k: str) -> str:
            parts = compiler.checks(rules, v, k, at, ())
            return f"filter({compiler.joined(parts)}, m -> m is not null)"

        return f"if({v} is null, array('not JSON'), {compiler.let(compiler.kind(v), with_kind)})"

    return F.expr(compiler.let(f"try_parse_json(`{document}`)", look))
