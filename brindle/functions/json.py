"""SQL/JSON over text and VARIANT columns, as Spark SQL text."""

from __future__ import annotations

import re


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(text: str, name: str, use) -> str:
    """use(name) with the text evaluated once; a column needs no binding."""
    if re.fullmatch(r"`[^`]+`\.`[^`]+`", text):
        return use(text)
    return f"(transform(array({text}), {name} -> {use(name)})[0])"


def path_of(path: str) -> str:
    """$.key[0].other as Spark's variant path; a key is anything up to the next dot or bracket."""
    if not path.startswith("$"):
        raise ValueError(f"a JSON path starts with $: {path!r}")
    out, at = "$", 1
    while at < len(path):
        if path[at] == ".":
            end = min((i for i in (path.find(".", at + 1), path.find("[", at + 1)) if i >= 0), default=len(path))
            key = path[at + 1 : end]
            if not key:
                raise ValueError(f"an empty key in JSON path {path!r}")
            out += "['" + key.replace("'", "\\'") + "']"
            at = end
        elif path[at] == "[":
            end = path.index("]", at)
            if not path[at + 1 : end].isdigit():
                raise ValueError(f"a bad index in JSON path {path!r}")
            out += path[at : end + 1]
            at = end + 1
        else:
            raise ValueError(f"a bad JSON path {path!r}")
    return out


def valid(text: str) -> str:
    """Strict validity; the two wraps reject what a lenient reader leaves after the first value."""
    return f"(coalesce(try_parse_json(concat('[', {text}, ']')) IS NOT NULL AND try_parse_json(concat('{{\"a\":', {text}, '}}')) IS NOT NULL AND try_parse_json({text}) IS NOT NULL, false))"


def document(text: str, kind: str) -> str:
    return text if kind == "JSONB" else f"parse_json({text})"


def at_path(text: str, kind: str, path: str) -> str:
    return f"variant_get({document(text, kind)}, {quote(path_of(path))}, 'variant')"


def scalar_text(v: str) -> str:
    """A scalar as text, numbers without a needless .0; objects, arrays and null are NULL."""
    kind, number = f"schema_of_variant({v})", f"try_variant_get({v}, '$', 'double')"
    return (
        f"(CASE WHEN {v} IS NULL OR is_variant_null({v}) OR {kind} RLIKE '^(OBJECT|ARRAY)' THEN NULL"
        f" WHEN {kind} = 'DOUBLE' AND {number} = floor({number}) THEN CAST(CAST({number} AS BIGINT) AS STRING)"
        f" ELSE try_variant_get({v}, '$', 'string') END)"
    )


def json_value(text: str, kind: str, path: str) -> str:
    return bound(at_path(text, kind, path), "v", scalar_text)


def json_value_as(text: str, kind: str, path: str, to: str, slow: str) -> str:
    """CAST(JSON_VALUE(...) AS INT or FLOAT): digits are read at once, anything else goes through ``slow``, the two steps."""
    pattern, sql = ("^[+-]?[0-9]+$", "BIGINT") if to == "INT" else ("^[+-]?[0-9]+([.][0-9]+)?$", "DOUBLE")
    read = f"try_variant_get({document(text, kind)}, {quote(path_of(path))}, 'string')"
    return f"(transform(array({read}), s -> CASE WHEN s IS NULL THEN NULL WHEN s RLIKE '{pattern}' THEN CAST(s AS {sql}) ELSE {slow} END)[0])"


def json_query(text: str, kind: str, path: str) -> str:
    return bound(at_path(text, kind, path), "v", lambda v: f"(CASE WHEN schema_of_variant({v}) RLIKE '^(OBJECT|ARRAY)' THEN to_json({v}) END)")


def json_exists(text: str, kind: str, path: str) -> str:
    return f"(CASE WHEN {text} IS NOT NULL THEN {at_path(text, kind, path)} IS NOT NULL END)"


def quoted(text: str) -> str:
    wrapped = f"to_json(named_struct('a', {text}))"
    return f"substring({wrapped}, 6, length({wrapped}) - 6)"


def fragment(text: str, kind: str) -> str:
    """A value inside JSON_OBJECT or JSON_ARRAY; text that is itself JSON is embedded as it is."""
    if kind == "NULL":
        return "'null'"
    if kind in ("TEXT", "JSON", ""):
        return f"coalesce(CASE WHEN {valid(text)} THEN {text} ELSE {quoted(text)} END, 'null')"
    if kind == "JSONB":
        return f"coalesce(to_json({text}), 'null')"
    if kind == "FLOAT":
        return f"coalesce({float_json(text)}, 'null')"
    return f"coalesce(CAST({text} AS STRING), 'null')"


def _digits(x: str) -> tuple[str, str, str]:
    """(sign, digits, exponent) as texts, of a number whose own text has an exponent: -1.25E-7 is -, 125, -7."""
    s = f"CAST({x} AS STRING)"
    digits = f"regexp_replace(translate(split_part({s}, 'E', 1), '-.', ''), '0+$', '')"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END)", digits, f"CAST(split_part({s}, 'E', 2) AS INT)"


def plain_float(x: str) -> str:
    """The shortest digits without an exponent, whatever the size."""
    sign, digits, e = _digits(x)
    small = f"concat({sign}, '0.', repeat('0', - {e} - 1), {digits})"
    large = f"concat({sign}, CASE WHEN length({digits}) <= {e} + 1 THEN rpad({digits}, {e} + 1, '0') ELSE concat(substring({digits}, 1, {e} + 1), '.', substring({digits}, {e} + 2)) END)"
    return (
        f"(CASE WHEN {x} = floor({x}) AND abs({x}) < 1e15 THEN CAST(CAST({x} AS BIGINT) AS STRING)"
        f" WHEN NOT contains(CAST({x} AS STRING), 'E') THEN CAST({x} AS STRING) WHEN {e} < 0 THEN {small} ELSE {large} END)"
    )


def float_text(text: str) -> str:
    return bound(text, "f", plain_float)


def float_json(text: str) -> str:
    """As float_text(), with an exponent below 1e-6 and from 1e21 on."""

    def one(x: str) -> str:
        sign, digits, e = _digits(x)
        mantissa = f"CASE WHEN length({digits}) = 1 THEN {digits} ELSE concat(substring({digits}, 1, 1), '.', substring({digits}, 2)) END"
        return f"(CASE WHEN {x} <> 0 AND (abs({x}) < 1e-6 OR abs({x}) >= 1e21) THEN concat({sign}, {mantissa}, CASE WHEN {e} < 0 THEN 'e' ELSE 'e+' END, {e}) ELSE {plain_float(x)} END)"

    return bound(text, "f", one)


def json_table(text: str, kind: str, path: str, columns: list[tuple[str, str, str]]) -> str:
    """A query with one row for each element of the array at path, or one for an object or scalar."""
    v = at_path(text, kind, path.removesuffix("[*]"))
    cast = {"INT": "try_variant_get({e}, {p}, 'bigint')", "FLOAT": "try_variant_get({e}, {p}, 'double')", "JSON": "to_json(variant_get({e}, {p}, 'variant'))", "JSONB": "variant_get({e}, {p}, 'variant')"}
    cols = []
    for name, want, at in columns:
        p = quote(path_of(at))
        cols.append((scalar_text(f"variant_get(e, {p}, 'variant')") if want == "TEXT" else cast[want].format(e="e", p=p)) + f" AS `{name}`")
    rows = f"CASE WHEN v IS NULL OR is_variant_null(v) THEN array() WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN CAST(v AS ARRAY<VARIANT>) ELSE array(v) END"
    return f"SELECT {', '.join(cols)} FROM (SELECT explode({rows}) AS e FROM (SELECT {v} AS v))"
