"""JSON records of real rows with planted faults, as expressions that Spark SQL and DuckDB read alike."""

from __future__ import annotations

import json

_WRONG = {"string": 5, "integer": 1.5, "number": "x", "boolean": 1, "array": {}, "object": []}


def _bad_values(kind: str, rule: dict) -> list:
    """Values that break a rule of a field each, and some that are right but rare."""
    out = [_WRONG[kind], None]
    for word, values in (("minLength", [""]), ("format", ["yesterday", "10:00", "2026"]), ("items", [[], [1, "a", -1, True]]), ("enum", ["zz", 7])):
        out += values if word in rule else []
    return out + [rule[w] + d for w, d in (("minimum", -1), ("maximum", 1)) if w in rule] + ([True] if kind == "number" else [])


def record_text(rules: list, expressions: dict[str, str | None]) -> tuple[str, int]:
    """JSON text of a row, and the number n of faults: a row with ``fault`` from 0 to n - 1 has that one,
    others keep the contract.

    ``expressions`` gives SQL for fields (by their path) that are no column of their own name; None
    leaves out an optional one.
    """
    n = 0

    def fault(value: str) -> str:
        nonlocal n
        n += 1
        return f" WHEN {n - 1} THEN '{value}'"

    def good(kind: str, rule: dict, path: str) -> str | None:
        if kind == "object":
            return members(rule["properties"], path)
        found = expressions.get(path, path.rsplit(".", 1)[-1])
        if found is None:
            return None
        return f"concat('\"', {found}, '\"')" if kind == "string" else found if kind == "array" else f"CAST({found} AS STRING)"

    def members(rules: list, at: str) -> str:
        parts = []
        for field, kind, _, rule in rules:
            value = good(kind, rule, f"{at}.{field}" if at else field)
            whens = fault("") + "".join(fault(f'"{field}":{json.dumps(bad)},') for bad in _bad_values(kind, rule))
            parts.append(f"CASE fault{whens} ELSE " + (f"concat('\"{field}\":', {value}, ',')" if value else "''") + " END")
        parts.append("CASE fault" + fault('"zone":1,"also":null,') + " ELSE '' END")
        return f"replace(concat('{{', {', '.join(parts)}, '}}'), ',}}', '}}')"

    text = members(rules, "")
    return f"CASE fault{fault('[1]')}{fault('{}')} ELSE {text} END", n
