"""JSON values in texts: fences, parsing and writing by format, canonical text, traversal.

Plain functions on Python values; the operators run them in Arrow batches. Payloads stay JSON strings in tables, as
key order matters to the text formats.
"""

from __future__ import annotations

import ast
import csv
import io
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Any

import yaml

CONTENT_TYPES = ("JSON", "CSV", "MARKDOWN", "STRING", "XML", "HTML", "TEXT", "OTHER", "YAML", "TOML", "PYTHON_STRING", "SQL", "LATEX")
AS_IS = {"MARKDOWN", "STRING", "TEXT", "OTHER", "PYTHON_STRING", "SQL", "LATEX"}


def minified(value: Any) -> str:
    """Sorted keys, no blanks, ASCII only."""
    return json.dumps(value, separators=(",", ":"), sort_keys=True)


def minified_text(text: str | None) -> str | None:
    """A JSON text minified; any other text as it is."""
    try:
        return None if text is None else minified(json.loads(text))
    except ValueError:
        return text


def parsed_or_text(raw: str) -> Any:
    """The JSON value of a text, or the text."""
    try:
        return json.loads(raw)
    except ValueError:
        return raw


def without_comments(text: str) -> str:
    """Drop // to the end of its line, URLs included."""
    return re.compile("/" * 2 + r"[^\n]*\n").sub("", text)


def fenced(text: str, most: int = 10, kind: str = "json") -> list[Any]:
    """Values of the fenced blocks that parse, `most` at the most. A block can't hold parentheses or back ticks."""
    plain = text.strip().translate({0x201C: '"', 0x201D: '"'})
    out: list[Any] = []
    for block in re.findall(rf"```{kind}\s*([^(`)]+)\s*```", plain):
        if len(out) == most:
            break
        try:
            out.append(parse(without_comments(block.strip()), kind.upper()))
        except Exception:  # whatever a format's parser raises, the block isn't of that format
            continue
    return out


class _Tags(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tree: list[Any] = []
        self.open: list[list[Any]] = [self.tree]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node: list[Any] = []
        self.open[-1].append({"tag": tag, "attrs": dict(attrs), "children": node})
        if tag not in {"br", "hr", "img", "meta", "link", "input"}:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if len(self.open) > 1:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.open[-1].append(data)


def parse(text: str, kind: str) -> Any:
    """Load a text of a format; raises what its parser raises."""
    if kind == "JSON":
        return json.loads(text)
    if kind == "XML":
        return xml_tree(ET.fromstring(text))
    if kind == "CSV":
        return list(csv.DictReader(io.StringIO(text)))
    if kind == "YAML":
        return yaml.safe_load(text)
    if kind == "TOML":
        return tomllib.loads(text)
    if kind == "HTML":
        if not (text.startswith("<") and text.endswith(">")):
            raise ValueError("not an HTML text")
        tags = _Tags()
        tags.feed(text)
        return tags.tree
    if kind == "PYTHON_STRING":
        return ast.literal_eval(text)
    raise ValueError(f"no parser for {kind}")


def written(value: Any, kind: str) -> str:
    """A value as a text of a format."""
    if kind in AS_IS:
        return str(value)
    if kind == "JSON":
        return json.dumps(value, indent=1, ensure_ascii=False, default=iso)
    if kind == "YAML":
        return yaml.dump(value)
    if kind == "TOML":
        from weftline.functions.formats import toml_text

        return toml_text(value)
    if kind == "CSV":
        out = io.StringIO()
        names = list(dict.fromkeys(k for row in value for k in row))
        writer = csv.DictWriter(out, names, lineterminator="\n")
        writer.writeheader()
        writer.writerows(value)
        return out.getvalue()
    if kind == "XML":
        from weftline.functions.formats import XmlText

        return XmlText().write(value)
    raise ValueError(f"no writer for {kind}")


def iso(value: Any) -> str:
    """Dates and times in JSON."""
    if hasattr(value, "isoformat"):
        return value.isoformat()
    raise TypeError(f"not serialisable: {type(value).__name__}")


def xml_tree(element: ET.Element) -> dict[str, Any]:
    """Attributes, text as _text, and a list of the children of each tag."""
    out: dict[str, Any] = dict(element.attrib)
    if element.text and element.text.strip():
        out["_text"] = element.text.strip()
    for child in element:
        out.setdefault(child.tag, []).append(xml_tree(child))
    return out


def without_nulls(value: Any) -> Any:
    """Drop null members of objects and null items of lists, at any depth."""
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [without_nulls(v) for v in value if v is not None]
    return value


def blanked(value: Any) -> Any:
    """Every scalar but null replaced by an empty string: the shape of a document, for the index."""
    if isinstance(value, dict):
        return {k: blanked(v) for k, v in value.items()}
    if isinstance(value, list):
        return [blanked(v) for v in value]
    return None if value is None else ""


def index_text(value: Any) -> str:
    return json.dumps(blanked(value), indent=1).lower()


def holds_something(value: Any) -> bool:
    members = value.values() if isinstance(value, dict) else value
    return any(bool(x) for x in members)


def containers(value: Any, depth: int = 3, path: str = "$") -> Iterator[tuple[str, Any]]:
    """Objects and lists within a value, outer ones first, with their paths. One without any true member is left out
    together with all below it; below `depth` levels nothing is looked at."""
    if not isinstance(value, (dict, list)) or not holds_something(value):
        return
    yield path, value
    if depth == 0:
        return
    if isinstance(value, dict):
        for k, v in value.items():
            if isinstance(v, (dict, list)):
                yield from containers(v, depth - 1, f"{path}.{k}")
    else:
        for i, v in enumerate(value):
            yield from containers(v, depth - 1, f"{path}[{i}]")


def or_none(f: Callable[[str], Any]) -> Callable[[str], Any]:
    """The function with None in place of the failures that odd texts bring about."""

    def g(x: str) -> Any:
        try:
            return f(x)
        except (ValueError, TypeError, RecursionError, AttributeError):
            return None

    return g


def as_json(text: str | None, kind: str) -> str | None:
    """A text of a format as JSON; None if it isn't of that format."""
    try:
        return json.dumps(parse(text or "", kind), default=iso)
    except Exception:  # whatever a format's parser raises
        return None
