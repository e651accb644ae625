"""Synthetic tables: a random frame, its schema, its rows as JSON, and its text in one of ten renderings."""

from __future__ import annotations

import csv
import io
import json
import random
from datetime import date, timedelta
from html import escape
from typing import Any

import pandas as pd
import yaml

from weftline.functions.formats import YAML_DUMPER, HtmlTable, MarkdownTable
from weftline.functions.json_schema import Schema, compile_schema, strict
from weftline.functions.variation import WORDS

RENDERINGS = ("csv", "latex", "xml", "sql", "markdown", "string", "html", "json", "python_string", "yaml")
CONTENT_TYPE = {"csv": "CSV", "latex": "LATEX", "xml": "XML", "sql": "SQL", "markdown": "MARKDOWN", "string": "STRING", "html": "HTML", "json": "JSON", "python_string": "PYTHON_STRING", "yaml": "YAML"}
GAPS = (*"_- ", "")
CSV_SIGNS = "|;,\t"
SHAPES = {"columns", "index", "split"}
FIRST = "Ada Ben Cleo Dev Eli Fay Gus Hana Ivo Jun Kira Leo Mia Noa Omar Pia".split()
LAST = "Abel Brook Castro Dietz Engel Flores Grant Huber Ito Jansen Klein Lopez".split()


def _day(r: random.Random) -> str:
    return (date(1950, 1, 1) + timedelta(days=r.randrange(27_000))).isoformat()


GENERATORS: dict[str, tuple[str, Any]] = {
    "name": ("string", lambda r: f"{r.choice(FIRST)} {r.choice(LAST)}"), "first": ("string", lambda r: r.choice(FIRST)), "last": ("string", lambda r: r.choice(LAST)), "word": ("string", lambda r: r.choice(WORDS)), "words": ("string", lambda r: " ".join(r.sample(WORDS, 3))),
    "upper": ("string", lambda r: r.choice(WORDS).upper()), "code": ("string", lambda r: f"{r.choice('ABCDEF')}{r.randrange(1000, 9999)}"), "mail": ("string", lambda r: f"{r.choice(FIRST).lower()}@{r.choice(WORDS)}.example"), "host": ("string", lambda r: f"{r.choice(WORDS)}.example.org"), "path": ("string", lambda r: "/" + "/".join(r.sample(WORDS, 2))),
    "date": ("string", _day), "year": ("integer", lambda r: r.randrange(1950, 2030)), "time": ("string", lambda r: f"{r.randrange(24):02}:{r.randrange(60):02}"), "phone": ("string", lambda r: f"555 {r.randrange(1000, 9999)}"), "color": ("string", lambda r: r.choice(["red", "green", "blue", "white"])),
    "small": ("integer", lambda r: r.randrange(10)), "int": ("integer", lambda r: r.randrange(10**6)), "signed": ("integer", lambda r: r.randrange(-1000, 1000)), "ratio": ("number", lambda r: round(r.random(), 3)), "price": ("number", lambda r: round(r.uniform(1, 999), 2)), "percent": ("number", lambda r: round(r.uniform(0, 100), 1)),
    "flag": ("boolean", lambda r: r.random() < 0.5), "none": ("string", lambda r: None), "empty": ("string", lambda r: ""),
}


KINDS = list(GENERATORS)
Row = dict[str, Any]


def table(rng: random.Random, plain_names: bool = False) -> tuple[list[Row], Schema]:
    """One to five rows, two to ten columns, and the schema of one object or of a list of objects."""
    rows, cols = rng.randint(1, 5), rng.randint(2, 10)
    style, gap = rng.choice(["words", "numbers", "one"]), "_" if plain_names else rng.choice(GAPS)
    names: list[str] = []
    while len(names) < cols:
        name = f"col{gap}{len(names) + 1}" if style == "numbers" and not plain_names else gap.join(rng.sample(WORDS, 1 if style == "one" else 2))
        names += [] if name in names else [name]
    kinds = [rng.choice(KINDS) for _ in names]
    columns = [[GENERATORS[k][1](rng) for _ in range(rows)] for k in kinds]
    row: Schema = {"type": "object", "properties": {n: {"type": GENERATORS[k][0]} for n, k in zip(names, kinds)}}
    return [dict(zip(names, r)) for r in zip(*columns)], strict(row if rows == 1 else {"type": "array", "items": row})


def rendered(rows: list[Row], how: str, rng: random.Random) -> str:
    """Rows of the same members as a text; a data frame is made only where its own text is asked for."""
    names = list(rows[0])
    text = lambda v: "" if v is None else str(v)
    if "csv" == how:
        out = io.StringIO()
        csv.writer(out, delimiter=rng.choice(CSV_SIGNS), lineterminator="\n").writerows([names, *(r.values() for r in rows)])
        return out.getvalue()
    if how == "latex":
        lines = [" & ".join(names), *(" & ".join(map(text, r.values())) for r in rows)]
        return "\\begin{tabular}{" + "l" * len(names) + "}\n" + " \\\\\n".join(lines) + " \\\\\n\\end{tabular}"
    if how == "xml":
        as_attribute = {n for n in names if rng.random() < 0.3}
        out = []
        for r in rows:
            attributes = "".join(f' {n}="{escape(text(r[n]))}"' for n in names if n in as_attribute)
            out.append(f"<row{attributes}>" + "".join(f"<{n}>{escape(text(r[n]))}</{n}>" for n in names if n not in as_attribute) + "</row>")
        return "<data>" + "".join(out) + "</data>"
    if how == "sql":
        literal = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
        return f"INSERT INTO `{rng.choice(WORDS)}` (" + ", ".join(f"`{c}`" for c in names) + ") VALUES " + ", ".join("(" + ", ".join(map(literal, r.values())) + ")" for r in rows) + ";"
    if how == "markdown":
        return MarkdownTable().write(rows)
    if how == "string":
        return pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names}).to_string(index=False)
    if how == "html":
        return HtmlTable().write(rows)
    orient = rng.choice(sorted(SHAPES))
    shaped = {"split": {"columns": names, "data": [list(r.values()) for r in rows]}, "index": {str(i): r for i, r in enumerate(rows)}, "columns": {c: {str(i): r[c] for i, r in enumerate(rows)} for c in names}}[orient]
    if how == "json":
        return json.dumps(shaped)
    if how == "python_string":
        return str(shaped)
    if how == "yaml":
        return yaml.dump(shaped, Dumper=YAML_DUMPER, sort_keys=False)
    raise ValueError(f"unknown rendering {how}")


def triplet(seed: int) -> dict[str, str] | None:
    """input_data, content_type, schema and output of a synthetic table, or None if its rows don't fit the schema."""
    rng = random.Random(seed)
    how = rng.choice(RENDERINGS)
    rows, schema = table(rng, plain_names=how in ("xml", "sql"))
    output = rows[0] if len(rows) == 1 else rows
    if compile_schema(schema)(output) is not None:
        return None
    return {"input_data": rendered(rows, how, rng), "content_type": CONTENT_TYPE[how], "schema": json.dumps(schema), "output": json.dumps(output)}
