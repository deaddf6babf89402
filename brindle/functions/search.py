"""Tokens of literals and lookups in posting tables, for searches that a GIN index answers."""

from __future__ import annotations

from . import json as J


def tokens_of(text: str, tokenizer: str) -> list[str]:
    """What a literal's rows have all of, by the same rules, in plain Python."""
    low = text.lower()
    if tokenizer == "bigram":
        return sorted({low[i : i + 2] for i in range(len(low) - 1)})
    out, word = [], ""
    for ch in low + " ":
        if ch.isascii() and not ("a" <= ch <= "z" or "0" <= ch <= "9"):
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return sorted(set(out))


def rows_with(view: str, tokens: list[str]) -> str:
    """SQL of the ids that have all of these tokens."""
    listed = ", ".join(J.quote(t) for t in tokens)
    if len(tokens) == 1:
        return f"SELECT id FROM {view} WHERE token = {listed}"
    return f"SELECT id FROM {view} WHERE token IN ({listed}) GROUP BY id HAVING count(*) = {len(tokens)}"
