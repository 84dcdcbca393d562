"""Contract validation of JSON records: every violated rule as ``path: message``."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import parse_iso

Rules = list[tuple[str, str, bool, dict]]

_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN")
_NONE = "array<string>"


def _kinds(held: Column) -> dict[str, Column]:
    """For each kind whether a variant of this schema has it; a null, as JSON has it, has none."""
    number = held.isin(*_NUMBERS) | held.startswith("DECIMAL")
    return {"string": held == "STRING", "integer": held == "BIGINT", "number": number, "boolean": held == "BOOLEAN", "array": held.startswith("ARRAY"), "object": held.startswith("OBJECT")}


def _is_kind(value: Column, kind: Column | str) -> Column:
    kinds = _kinds(F.schema_of_variant(value))
    if isinstance(kind, str):
        return F.coalesce(kinds[kind], F.lit(False))
    found = functools.reduce(lambda when, k: when.when(kind == k, kinds[k]), kinds, F)
    return F.coalesce(found, F.lit(False))


def _rule(field: str, kind: str, required: bool, rule: dict) -> Column:
    """A rule as a row of literals: the bounds (null where there is none), and what is said of a value beyond."""
    has = lambda word, kind, value=lambda x: x: F.lit(value(rule[word]) if word in rule else None).cast(kind).alias(word)
    enum = F.array(*(F.lit(str(x)) for x in rule["enum"])) if "enum" in rule else F.lit(None).cast(_NONE)
    says = {"enum": "expected one of {}", "minLength": "minLength {}", "pattern": "pattern {}", "minimum": "minimum {}", "maximum": "maximum {}", "minItems": "minItems {}"}
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(kind).alias("kind"),
        F.lit(required).alias("required"),
        enum.alias("enum"),
        has("minLength", "int"),
        F.lit(rule.get("format") == "date-time").alias("time"),
        has("pattern", "string", lambda x: f"^(?:{x})$"),
        has("minimum", "double"),
        has("maximum", "double"),
        has("minItems", "int"),
        *(F.lit(text.format(rule[word]) if word in rule else None).cast("string").alias(f"says_{word}") for word, text in says.items()),
    )


def _broken(value: Column, r: Column, path: Column) -> Column:
    """Messages on a value of the right kind; what a rule does not ask for is not looked at."""
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    say = lambda what: F.concat(path, F.lit(": "), what)
    asked = lambda word, cond: F.when(r[word].isNotNull() & cond, say(r[f"says_{word}"]))
    return F.array_compact(
        F.array(
            asked("enum", ~F.array_contains(r["enum"], text)),
            asked("minLength", F.length(text) < r["minLength"]),
            F.when(r["time"] & parse_iso(text).isNull(), say(F.lit("invalid date-time"))),
            asked("pattern", ~F.rlike(text, r["pattern"])),
            asked("minimum", number < r["minimum"]),
            asked("maximum", number > r["maximum"]),
            asked("minItems", F.size(F.try_variant_get(value, "$", "array<variant>")) < r["minItems"]),
        )
    )


def _one(value: Column, r: Column, path: Column) -> Column:
    return F.when(_is_kind(value, r["kind"]), _broken(value, r, path)).otherwise(F.array(F.concat(path, F.lit(": expected "), r["kind"])))


def _fine(value: Column, kind: str, rule: dict) -> Column:
    """Whether a value surely keeps its rule: a test that Spark compiles, so that few values are gone through by ``_one``."""
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    tests = {
        "enum": lambda x: text.isin(*map(str, x)),
        "minLength": lambda x: F.length(text) >= x,
        "format": lambda x: parse_iso(text).isNotNull() if x == "date-time" else F.lit(True),
        "pattern": lambda x: text.rlike(f"^(?:{x})$"),
        "minimum": lambda x: number >= x,
        "maximum": lambda x: number <= x,
        "minItems": lambda x: F.size(F.try_variant_get(value, "$", "array<variant>")) >= x,
    }
    return F.coalesce(functools.reduce(lambda a, b: a & b, (tests[word](x) for word, x in rule.items() if word in tests), _is_kind(value, kind)), F.lit(False))


def _runs(rules: Rules) -> list[tuple[bool, Rules]]:
    """The rules in order, as runs of those with items or properties and of those without."""
    return [(nested, list(run)) for nested, run in itertools.groupby(rules, lambda r: "items" in r[3] or "properties" in r[3])]


def _suspects(rules: Rules, values: Column) -> Column:
    """Positions of the rules whose fields are absent or not surely fine, as text."""
    return F.concat_ws(",", *(F.when(~_fine(F.try_element_at(values, F.lit(field)), kind, rule), str(i)) for i, (field, kind, _, rule) in enumerate(rules, 1)))


def _simple(rules: Rules, values: Column, suspects: Column, path: Column) -> Column:
    """Messages on fields next to each other without parts of their own. Spark interprets what stands
    within a lambda, so it has the rules as data and goes through the suspects only."""
    every = F.array(*(_rule(*r) for r in rules))

    def of(k: Column) -> Column:
        r = F.element_at(every, k.cast("int"))
        where = F.concat(path, F.lit("."), r["field"])
        absent = F.when(r["required"], F.array(F.concat(where, F.lit(": missing required property")))).otherwise(F.array().cast(_NONE))
        return F.when(F.map_contains_key(values, r["field"]), _one(F.try_element_at(values, r["field"]), r, where)).otherwise(absent)

    return F.when(suspects == "", F.array().cast(_NONE)).otherwise(F.flatten(F.transform(F.split(suspects, ","), of)))


def _parts(field: str, kind: str, required: bool, rule: dict, values: Column, path: Column, objects: dict[str, Column], at: str) -> Column:
    """Messages on a field that has items or properties with rules."""
    where, name, r = F.concat(path, F.lit(f".{field}")), F.lit(field), _rule(field, kind, required, rule)
    value = F.try_element_at(values, name)
    found = [_broken(value, r, where)]
    if "items" in rule:
        item = _rule("", *rule["items"][:1], True, rule["items"][1])
        found.append(F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v, i: _one(v, item, F.concat(where, F.lit("["), i.cast("string"), F.lit("]"))))))
    if "properties" in rule:
        found.append(_object_errors(rule["properties"], objects, f"{at}.{field}", where, rule.get("closed", True)))
    absent = F.array(F.concat(where, F.lit(": missing required property"))) if required else F.array().cast(_NONE)
    typed = F.when(_is_kind(value, kind), F.concat(*found)).otherwise(F.array(F.concat(where, F.lit(f": expected {kind}"))))
    return F.when(F.map_contains_key(values, name), typed).otherwise(absent)


def _object_errors(rules: Rules, objects: dict[str, Column], at: str, path: Column, closed: bool) -> Column:
    values, found = objects[at], [F.array().cast(_NONE)]
    for i, (nested, run) in enumerate(_runs(rules)):
        found += [_parts(*r, values, path, objects, at) for r in run] if nested else [_simple(run, values, objects[f"{at} {i}"], path)]
    if closed:
        found.append(F.transform(objects[f"{at} others"], lambda k: F.concat(path, F.lit("."), k, F.lit(": additional property not allowed"))))
    return F.concat(*found)


def _others(rules: Rules, values: Column) -> Column:
    """Properties that no rule knows, in order."""
    return F.array_sort(F.array_except(F.map_keys(values), F.array(*(F.lit(r[0]) for r in rules))))


def _objects(rules: Rules, at: str = "$") -> dict[str, Rules]:
    """The objects that the rules describe, by path, from the outermost."""
    found = {at: rules}
    for field, _, _, rule in rules:
        if "properties" in rule:
            found |= _objects(rule["properties"], f"{at}.{field}")
    return found


def validate(records: DataFrame, json_col: str, rules: Rules, path: str = "$", closed: bool = True) -> DataFrame:
    """The records with ``errors``: messages of the broken rules, in order of the rules, then of
    properties that the contract does not know. Text that is no JSON object breaks one rule.

    A rule of an object may have ``properties`` (rules, closed unless ``closed`` is False), one of an
    array ``items``: the kind and the rule of each item, which is no object with properties.
    Each object is taken apart once, into a map of its values."""
    held = records.select(F.struct(*records.columns).alias("row"), F.try_parse_json(json_col).alias("doc"))
    inside = _objects(rules)
    names = {at: f"object{i}" for i, at in enumerate(inside)}
    held = held.select("row", *(F.try_variant_get("doc", at, "map<string,variant>").alias(n) for at, n in names.items()))
    # Columns of their own: suspects are used twice, so that Spark doesn't put the two steps together, and sorting keeps
    # the step out of the one method of a whole stage, which would be too long for the JVM to compile.
    runs = {f"{at} {i}": (f"suspects{i}_{names[at]}", _suspects(run, F.col(names[at]))) for at, own in inside.items() for i, (nested, run) in enumerate(_runs(own)) if not nested}
    runs |= {f"{at} others": (f"others_{names[at]}", _others(own, F.col(names[at]))) for at, own in inside.items()}
    held = held.select("*", *(x.alias(c) for c, x in runs.values()))
    objects = {at: F.col(n) for at, n in names.items()} | {at: F.col(c) for at, (c, _) in runs.items()}
    found = _object_errors(rules, objects, "$", F.lit(path), closed)
    errors = F.when(objects["$"].isNotNull(), found).otherwise(F.array(F.lit(f"{path}: expected object")))
    return held.select("row.*", errors.alias("errors"))


def validate_lines(lines: DataFrame, rules: Rules, path: str = "$") -> DataFrame:
    """JSON lines (column ``value``), blank ones left out, with their ``errors``."""
    return validate(lines.where(F.trim("value") != ""), "value", rules, path)


def error_counts(validated: DataFrame) -> DataFrame:
    """One row: records, records with an error, and errors."""
    n = F.size("errors")
    return validated.agg(F.count("*").alias("records"), F.count_if(n > 0).alias("bad_records"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("errors"))
