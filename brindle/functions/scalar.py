"""Numeric, string and conversion functions, as Spark SQL text."""

from __future__ import annotations

from . import json as J

#: name: (least and most arguments, type of the result or None for that of the first argument)
SIGNATURES = {
    "ABS": (1, 1, None), "ROUND": (1, 2, None), "MOD": (2, 2, None), "CEIL": (1, 1, "INT"), "FLOOR": (1, 1, "INT"), "POWER": (2, 2, "FLOAT"),
    "LENGTH": (1, 1, "INT"), "UPPER": (1, 1, "TEXT"), "LOWER": (1, 1, "TEXT"), "SUBSTRING": (2, 3, "TEXT"), "TRIM": (1, 1, "TEXT"), "CONCAT": (1, 99, "TEXT"),
    "COALESCE": (1, 99, None), "NULLIF": (2, 2, None), "JSON_OBJECT": (0, 99, "JSON"), "JSON_ARRAY": (0, 99, "JSON"),
    "JSON_VALUE": (2, 2, "TEXT"), "JSON_QUERY": (2, 2, "JSON"), "JSON_EXISTS": (2, 2, "BOOL"),
}
NUMBERS, TEXTS = ("INT", "FLOAT", "NULL", ""), ("TEXT", "JSON", "NULL", "")


def call(name: str, args: list[str], kinds: list[str]) -> str:
    """The call of a dialect function other than the JSON path functions."""
    a = args[0] if args else ""
    if name in ("ABS", "ROUND", "MOD", "CEIL", "FLOOR", "POWER") and any(k not in NUMBERS for k in kinds):
        raise TypeError(f"{name} takes numbers")
    if name in ("LENGTH", "UPPER", "LOWER", "TRIM", "CONCAT") and any(k not in TEXTS for k in kinds) or name == "SUBSTRING" and kinds[0] not in TEXTS:
        raise TypeError(f"{name} takes text")
    if name == "ROUND":
        digits = args[1] if len(args) > 1 else "0"
        p = f"power(10.0D, {digits})"
        rounded = f"(signum({a}) * floor(abs(CAST({a} AS DOUBLE)) * {p} + 0.5D) / {p})"
        if kinds[0] == "INT":
            return f"(CASE WHEN {digits} >= 0 THEN CAST({a} AS BIGINT) ELSE CAST({rounded} AS BIGINT) END)"
        return rounded
    if name == "MOD":
        return f"({a} % {args[1]})"
    if name == "LENGTH":
        return f"CAST(length({a}) AS BIGINT)"
    if name == "POWER":
        return f"power(CAST({a} AS DOUBLE), CAST({args[1]} AS DOUBLE))"
    if name == "SUBSTRING":
        size = f", greatest({args[2]}, 0)" if len(args) > 2 else ""
        return f"substring({a}, CAST(greatest({args[1]}, 1) AS INT){size})"
    if name == "TRIM":
        return f"regexp_replace({a}, '^(?U:\\\\s)+|(?U:\\\\s)+$', '')"
    if name == "NULLIF" and "" not in kinds and "NULL" not in kinds and (kinds[0] in NUMBERS) != (kinds[1] in NUMBERS):
        return a
    if name == "JSON_OBJECT":
        if len(args) % 2 or any(k not in TEXTS for k in kinds[::2]):
            raise TypeError("JSON_OBJECT takes text keys, each with a value")
        parts = [f"{J.quoted(args[i])}, ':', {J.fragment(args[i + 1], kinds[i + 1])}" for i in range(0, len(args), 2)]
        return "concat('{', " + ", ',', ".join(parts) + ("," if parts else "") + " '}')"
    if name == "JSON_ARRAY":
        parts = [J.fragment(x, k) for x, k in zip(args, kinds, strict=True)]
        return "concat('[', " + ", ',', ".join(parts) + ("," if parts else "") + " ']')"
    return f"{name.lower()}({', '.join(args)})"


def cast(text: str, kind: str, to: str) -> str:
    if kind == "BOOL":
        raise TypeError("a truth value cannot be cast")
    if to == "INT":
        if kind in ("TEXT", "JSON"):
            return J.bound(text, "t", lambda t: f"(CASE WHEN {t} IS NULL THEN NULL WHEN {t} RLIKE '^[+-]?[0-9]+$' THEN CAST({t} AS BIGINT) ELSE CAST(raise_error('not an integer') AS BIGINT) END)")
        return f"CAST({text} AS BIGINT)"
    if to == "FLOAT":
        return f"CAST({text} AS DOUBLE)"
    if to == "TEXT":
        return J.float_text(text) if kind == "FLOAT" else f"to_json({text})" if kind == "JSONB" else f"CAST({text} AS STRING)"
    if to == "JSON":
        return text if kind == "JSON" else f"to_json({text})" if kind == "JSONB" else f"(CASE WHEN {text} IS NULL OR {J.valid(text)} THEN {text} ELSE CAST(raise_error('not JSON') AS STRING) END)"
    return text if kind == "JSONB" else f"parse_json(CASE WHEN {text} IS NULL OR {J.valid(text)} THEN {text} ELSE CAST(raise_error('not JSON') AS STRING) END)"


def match(text: str, term: str, tokenizer: str) -> str:
    """text @@ term: a whole word of the text, or with the bigram tokenizer any part of it. Most texts are told by a plain
    search; only those that have the term somewhere are searched for it as a word."""
    part = f"contains(lower({text}), lower({term}))"
    if tokenizer == "bigram":
        return f"coalesce({part}, false)"
    inside, outside = "[a-z0-9\\\\x{80}-\\\\x{10FFFF}]", "[^a-z0-9\\\\x{80}-\\\\x{10FFFF}]"
    quoted = f"concat('(^|{outside})\\\\Q', lower({term}), '\\\\E($|{outside})')"
    single = f"({term} RLIKE '^(?i){inside}*$')"
    return f"coalesce({part} AND {single} AND lower({text}) RLIKE {quoted}, false)"
