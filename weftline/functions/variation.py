"""Variation of schemas with their documents, augmentation of samples, coercion. Chance comes from seeded generators,
so a row always varies alike wherever it runs."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterator
from typing import Any

from weftline.functions.json_schema import Schema, compile_schema, first_type, is_type, null_result
from weftline.functions.scores import MISSING

WORDS = "account amount batch branch channel city code color country currency detail grade index label level limit model origin phase price priority rate ratio region score segment shift source stage status symbol target title token unit value vendor version weight zone".split()
SEPARATORS = tuple((a, b) for a in (",", ", ") for b in (":", ": "))
NEW_KINDS = ("boolean", "integer", "number", "string")
JUNK = ("#", "@", "~", "%%", "^", "\\", "`", "¤", "§", "{{", "]]")


def copied(value: Any) -> Any:
    """A copy of a JSON value; parts that it has twice become two."""
    kind = type(value)
    if kind is dict:
        return {k: copied(v) for k, v in value.items()}
    return [copied(v) for v in value] if kind is list else value


def coerce(value: Any, kinds: list[str]) -> Any:
    """A value as the first of the kinds that takes it; raises ValueError if none does."""
    if value is None and "null" in kinds:
        return None
    for kind in sorted((k for k in kinds if k != "null"), key=lambda k: k != "string"):
        if kind in ("object", "array"):
            if is_type(value, kind):
                return value
        elif kind == "string":
            return value if isinstance(value, str) else str(value)
        elif kind == "integer":
            if is_type(value, "integer"):
                return int(value)
            if isinstance(value, str):
                try:
                    return int(value)
                except ValueError:
                    pass
        elif kind == "number":
            if is_type(value, "number"):
                return value
            if isinstance(value, str):
                try:
                    return float(value)
                except ValueError:
                    pass
        elif kind == "boolean":
            if isinstance(value, bool):
                return value
            word = str(value).lower()
            if word in ("true", "1", "false", "0"):
                return word in ("true", "1")
    raise ValueError(f"{value!r} isn't any of {kinds}")


def _objects(schema: Schema, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Schema]]:
    """Object schemas and their paths; `[]` stands for the items of a list."""
    if isinstance(schema.get("properties"), dict):
        yield path, schema
        for k, v in schema["properties"].items():
            if isinstance(v, dict):
                yield from _objects(v, (*path, k))
    if isinstance(schema.get("items"), dict):
        yield from _objects(schema["items"], (*path, "[]"))


def _require_all(schema: Schema) -> None:
    schema.update(required=[*schema["properties"]])


def drop_keys(schema: Schema, rng: random.Random, share: float = 0.2, in_place: bool = False) -> tuple[Schema, list[str]]:
    """Drop properties at random, at exact paths; an object keeps one at least."""
    out, gone = schema if in_place else copied(schema), []
    for path, part in list(_objects(out)):
        for k in list(part["properties"]):
            if len(part["properties"]) > 1 and rng.random() < share:
                del part["properties"][k]
                gone.append(".".join((*path, k)))
        _require_all(part)
    return out, gone


def add_keys(schema: Schema, rng: random.Random, share: float = 0.3, most: int = 3, in_place: bool = False) -> tuple[Schema, list[str]]:
    """Add nullable scalar properties to objects at random."""
    out, new = schema if in_place else copied(schema), []
    for path, part in list(_objects(out)):
        if rng.random() < share:
            for _ in range(rng.randint(1, most)):
                name = "_".join(rng.sample(WORDS, 2))
                if name not in part["properties"]:
                    part["properties"][name] = {"type": [rng.choice(NEW_KINDS), "null"]}
                    new.append(".".join((*path, name)))
        _require_all(part)
    return out, new


def retype(schema: Schema, rng: random.Random, share: float = 0.3, in_place: bool = False) -> tuple[Schema, dict[str, str]]:
    """Turn numbers into strings at random, nested ones too."""
    out, changed = schema if in_place else copied(schema), {}
    for path, part in list(_objects(out)):
        for k, v in part["properties"].items():
            if isinstance(v, dict) and first_type(v) in ("number", "integer") and rng.random() < share:
                v["type"] = ["string", "null"]
                changed[".".join((*path, k))] = "string"
    return out, changed


def _edit(data: Any, path: list[str], act: Callable[[dict, str], None]) -> None:
    if len(path) == 1 and isinstance(data, dict):
        act(data, path[0])
    elif path[0] == "[]" and isinstance(data, list):
        for x in data:
            _edit(x, path[1:], act)
    elif isinstance(data, dict) and path[0] in data and len(path) > 1:
        _edit(data[path[0]], path[1:], act)


def apply_changes(data: Any, changes: dict[str, Any]) -> Any:
    """Retype, remove and add as null what the changes say."""
    out = copied(data)

    def turn(d: dict, k: str) -> None:
        if d.get(k) is not None:
            d[k] = str(d[k])

    for path in changes.get("retyped", {}):
        _edit(out, path.split("."), turn)
    for path in changes.get("dropped", []):
        _edit(out, path.split("."), lambda d, k: d.pop(k, None))
    for path in changes.get("added", []):
        _edit(out, path.split("."), lambda d, k: d.setdefault(k, None))
    return out


def rebuilt(data: Any, schema: Schema, changes: dict[str, Any]) -> Any:
    """The document under a changed schema: changes applied, top-level properties in the schema's order, missing ones
    null, all coerced and validated. Raises ValueError for no document, all nulls, or an invalid one."""
    out = apply_changes(data, changes)
    if not isinstance(out, dict) or not out:
        raise ValueError("no object")
    out = {k: coerce(out.get(k), s["type"] if isinstance(s.get("type"), list) else [s.get("type", "null")]) if isinstance(s, dict) and "type" in s else out.get(k) for k, s in schema.get("properties", {}).items()}
    if all(v is None for v in out.values()):
        raise ValueError("all null")
    if why := compile_schema(schema)(out):
        raise ValueError(why)
    return out


def vary(schema: Schema, data: Any, seed: int) -> tuple[Schema, Any, dict[str, Any]]:
    """A varied schema, the document under it, and the changes. Raises ValueError where none fits."""
    rng = random.Random(seed)
    new, dropped = drop_keys(schema, rng)
    new, retyped = retype(new, rng, in_place=True)
    new, added = add_keys(new, rng, in_place=True)
    changes = {"dropped": dropped, "retyped": retyped, "added": added}
    return new, rebuilt(data, new, changes), changes


def presented(text: str, rng: random.Random) -> str:
    """A JSON text written anew with other blanks, key order and escapes; other texts as they are."""
    if not text.lstrip().startswith(("{", "[")):
        return text
    try:
        value = json.loads(text)
    except ValueError:
        return text
    separators = rng.choice(SEPARATORS)
    return json.dumps(value, separators=separators, indent=rng.choice([None, 0, 1, 2, 3, 4]), sort_keys=rng.random() < 0.5, ensure_ascii=rng.random() < 0.5)


def corrupted(text: str, rng: random.Random) -> str:
    """One to five junk symbols put in at random places."""
    for _ in range(rng.randint(1, 5)):
        at = rng.randint(0, len(text))
        text = text[:at] + rng.choice(JUNK) + text[at:]
    return text


Sample = dict[str, Any]
Step = Callable[[Sample, random.Random], Sample]


def step_drop_schema(s: Sample, rng: random.Random) -> Sample:
    return {**s, "schema": MISSING}


def step_vary(s: Sample, rng: random.Random) -> Sample:
    if s["schema"] == MISSING:
        return s
    try:
        schema, data, _ = vary(json.loads(s["schema"]), json.loads(s["output"]), rng.randrange(2**32))
    except (ValueError, TypeError):
        return s
    return {**s, "schema": json.dumps(schema), "output": json.dumps(data)}


def step_present(s: Sample, rng: random.Random) -> Sample:
    return {**s, "input_data": presented(s["input_data"], rng)}


def step_corrupt(s: Sample, rng: random.Random) -> Sample:
    return {**s, "input_data": corrupted(s["input_data"], rng)}


def step_negative(others: list[str], in_order: bool = False) -> Step:
    """Another schema that the output doesn't fit, with an empty result; two tries, or each of `others` in order."""

    def act(s: Sample, rng: random.Random) -> Sample:
        if s["schema"] == MISSING:
            return s
        for other in others if in_order else [rng.choice(others) for _ in range(2 if others else 0)]:
            if other != s["schema"] and compile_schema(json.loads(other))(json.loads(s["output"])) is not None:
                return {**s, "schema": other, "output": json.dumps(null_result(json.loads(other)))}
        return s

    return act


def augmented(sample: Sample, seed: int, steps: list[tuple[Step, float]]) -> Sample:
    """The steps in order, each with its chance; a step that fails leaves the sample as it is."""
    rng = random.Random(seed)
    for step, chance in steps:
        if rng.random() < chance:
            try:
                sample = step(sample, rng)
            except (ValueError, KeyError, TypeError):
                continue
    return sample
