"""Text formats of JSON documents. A format is kept for a document only if its text leads back to the document.

A Format writes a value and loads a text; `converted` does both and compares. New formats are added with `register`.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
import tomllib
from collections.abc import Callable
from html import escape, unescape
from typing import Any

import yaml

from weftline.functions.json_values import parse, parsed_or_text, without_nulls


class Unfit(ValueError):
    """The document can't be told in this format."""


class Format:
    """One format. options() draws its parameters from a seed; check() decides whether a text stands for a value."""

    name = ""

    def options(self, seed: int) -> dict[str, Any]:
        return {}

    def write(self, value: Any, **options: Any) -> str:
        raise NotImplementedError

    def load(self, text: str) -> Any:
        raise NotImplementedError

    def check(self, value: Any, text: str) -> bool:
        return self.load(text) == value

    def surely(self, value: Any) -> bool:
        """Whether the text of a simple document leads back by its form, so that it needn't be loaded to tell."""
        return False


_WORD = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,59}")
_SPOKEN = set("yes no on off true false null none inf nan".split())


def is_word(text: str) -> bool:
    """A short name that no format takes for anything else."""
    return _WORD.fullmatch(text) is not None and text.lower() not in _SPOKEN


def simple(value: Any, depth: int = 0) -> bool:
    """Words, truths and integers within objects and lists that aren't empty, with words as names. Such documents have
    one text in each of the formats for nested values, and it leads back."""
    kind = type(value)
    if kind is int:
        return -(10**15) < value < 10**15
    if kind is str:
        return is_word(value)
    if kind is dict:
        return 0 < len(value) and depth < 20 and all([type(k) is str and is_word(k) and simple(v, depth + 1) for k, v in value.items()])
    if kind is list:
        return 0 < len(value) and depth < 20 and all([simple(v, depth + 1) for v in value])
    return kind is bool


#: The library's C versions where it has them; their texts and values are the same.
YAML_DUMPER = getattr(yaml, "CDumper", yaml.Dumper)
YAML_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def simple_yaml(value: Any, sort_keys: bool, indent: int) -> list[str] | None:
    """The lines that the library writes for a simple document, or None if a part is met twice, which it gives a name."""
    step, met = indent if 2 <= indent <= 9 else 2, set()

    def told(v: Any, at: int) -> list[str]:
        met.add(id(v))
        pad, out = " " * at, []
        if type(v) is dict:
            for k, x in sorted(v.items(), key=lambda i: i[0]) if sort_keys else v.items():
                kind = type(x)
                if kind is dict or kind is list:
                    if id(x) in met:
                        raise Unfit("met twice")
                    out.append(f"{pad}{k}:")
                    out += told(x, at + step if kind is dict else at)
                else:
                    out.append(f"{pad}{k}: {_yaml_scalar(x)}")
            return out
        for x in v:
            kind = type(x)
            if kind is dict or kind is list:
                if id(x) in met:
                    raise Unfit("met twice")
                first, *rest = told(x, at + step)
                out.append(f"{pad}-{first[at + 1:]}")
                out += rest
            else:
                out.append(f"{pad}- {_yaml_scalar(x)}")
        return out

    try:
        return told(value, 0)
    except Unfit:
        return None


def _yaml_scalar(v: Any) -> str:
    return v if type(v) is str else str(v).lower()


class YamlText(Format):
    name = "YAML"

    def options(self, seed: int) -> dict[str, Any]:
        return {"sort_keys": bool(seed & 1), "indent": (seed >> 1) % 5}

    def write(self, value: Any, **options: Any) -> str:
        if isinstance(value, (dict, list)) and simple(value) and (lines := simple_yaml(value, options.get("sort_keys", True), options.get("indent") or 0)):
            return "\n".join(lines) + "\n"
        return yaml.dump(value, Dumper=YAML_DUMPER, **options)

    def surely(self, value: Any) -> bool:
        return isinstance(value, (dict, list)) and simple(value)

    def load(self, text: str) -> Any:
        return yaml.load(text, Loader=YAML_LOADER)  # noqa: S506 - a safe loader


_BARE = re.compile(r"[A-Za-z0-9_-]+")


def _toml_key(key: str) -> str:
    return key if _BARE.fullmatch(key) else json.dumps(key)


def _toml_value(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False).replace("\x7f", "\\u007f")
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(_toml_value, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{_toml_key(k)} = {_toml_value(v)}" for k, v in value.items()) + "}"
    raise Unfit(f"TOML has no {type(value).__name__}")


def toml_text(value: dict[str, Any], path: tuple[str, ...] = ()) -> str:
    """Scalars first, then tables and arrays of tables."""
    is_table = lambda v: isinstance(v, dict)
    is_tables = lambda v: isinstance(v, list) and bool(v) and all(map(is_table, v))
    lines = [f"{_toml_key(k)} = {_toml_value(v)}" for k, v in value.items() if not is_table(v) and not is_tables(v)]
    out = "".join(x + "\n" for x in lines)
    for k, v in value.items():
        head = ".".join(map(_toml_key, (*path, k)))
        if is_table(v):
            out += ("\n" if out else "") + f"[{head}]\n" + toml_text(v, (*path, k))
        elif is_tables(v):
            out += "".join(f"\n[[{head}]]\n" + toml_text(x, (*path, k)) for x in v)
    return out


class TomlText(Format):
    """A list is a table with its indexes as keys; nulls are left out, in what is compared too."""

    name = "TOML"

    def write(self, value: Any, **options: Any) -> str:
        value = without_nulls(value)
        return toml_text({str(i): x for i, x in enumerate(value)} if isinstance(value, list) else value)

    def load(self, text: str) -> Any:
        value = tomllib.loads(text)
        return list(value.values()) if value and all(k.isdigit() for k in value) else value

    def check(self, value: Any, text: str) -> bool:
        return self.load(text) == without_nulls(value)

    def surely(self, value: Any) -> bool:
        return isinstance(value, dict) and simple(value)


class PythonText(Format):
    name = "PYTHON_STRING"

    def write(self, value: Any, **options: Any) -> str:
        return str(value)

    def load(self, text: str) -> Any:
        return ast.literal_eval(text)

    def surely(self, value: Any) -> bool:
        return isinstance(value, (dict, list)) and simple(value)


def rows_of(value: Any) -> list[dict[str, Any]]:
    rows = [value] if isinstance(value, dict) else value
    if not all(isinstance(r, dict) for r in rows):
        raise Unfit("only objects and lists of objects are tables")
    return rows


def _number(text: str) -> Any:
    """What a table's cell says, without blanks around it: nothing, an integer, a number, or text."""
    text = text.strip()
    if text == "":
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


Rows = list[list[str]]


class HtmlTable(Format):
    """A head of the first object's keys and a row for each object, every value as its text. Two nested forms are told
    as rows of (key, name, value), where further names of a key leave its cell blank: an object of a value and then an
    object, under a head, and an object of objects, without one."""

    name = "HTML"

    def cells(self, value: Any) -> tuple[list[str] | None, Rows]:
        """The head, or None, and the body."""
        rows = rows_of(value)
        head = list(rows[0])
        inner = [v for v in value.values() if isinstance(v, dict)] if isinstance(value, dict) else []
        if not inner:
            return head, [[str(r[k]) for k in head] for r in rows]
        if len(inner) == len(head):
            return None, [[k if i == 0 else "", str(n), str(v)] for k, d in value.items() for i, (n, v) in enumerate(d.items())]
        if len(head) != 2 or not isinstance(value[head[1]], dict):
            raise Unfit("no table of this nesting leads back")
        return head, [[str(value[head[0]]) if i == 0 else "", str(n), str(v)] for i, (n, v) in enumerate(inner[0].items())]

    def write(self, value: Any, **options: Any) -> str:
        head, body = self.cells(value)
        line = lambda tag, row: "<tr>" + "".join(f"<{tag}>{escape(c, quote=False)}</{tag}>" for c in row) + "</tr>"
        top = "" if head is None else f"<thead>{line('th', head)}</thead>"
        return f"<table>{top}<tbody>{''.join(line('td', r) for r in body)}</tbody></table>"

    def load(self, text: str) -> Any:
        lines = [(m[0].startswith("<tr><th"), [unescape(c) for c in re.findall(r"<t[hd]>(.*?)</t[hd]>", m[0], flags=re.S)]) for m in re.finditer(r"<tr>.*?</tr>", text, flags=re.S)]
        if not lines:
            return {}
        if lines[0][0]:
            return self.value(lines[0][1], [r for _, r in lines[1:]])
        return self.value(None, [r for _, r in lines])

    def value(self, head: list[str] | None, body: Rows) -> Any:
        if head is not None and not (len(body) > 1 and any(len(r) > len(head) for r in body)):
            out = [{k: _number(c) for k, c in zip(head, r)} for r in body]
            return out[0] if len(body) == 1 and len(body[0]) == len(head) else out
        told: dict[str, Any] = {}
        at = None
        for key, name, cell in (r for r in body if len(r) == 3):
            if head is not None:
                if key:
                    told[head[0]] = _number(key)
                told.setdefault(head[1], {})[name.strip()] = _number(cell)
            else:
                at = key or at
                told.setdefault(at, {})[name] = _number(cell)
        return told


class MarkdownTable(HtmlTable):
    """A pipe table of flat objects. Stars and underscores are escaped; pipes and line ends in values don't survive."""

    name = "MARKDOWN"

    def write(self, value: Any, **options: Any) -> str:
        head, body = self.cells(value)
        if head is None or any(len(r) != len(head) for r in body):
            raise Unfit("no nested objects")
        line = lambda row: "| " + " | ".join(re.sub(r"([*_])", r"\\\1", c).replace("\n", " ") for c in row) + " |"
        return "\n".join([line(head), "| " + " | ".join(["---"] * len(head)) + " |", *map(line, body)])

    def load(self, text: str) -> Any:
        rows = [[re.sub(r"\\([*_])", r"\1", c.strip()) for c in line.strip()[1:-1].split("|")] for line in text.strip().split("\n")]
        return self.value(rows[0], rows[2:])


class CsvText(Format):
    """Nested objects are columns with dotted names; no quoting, so commas and line ends in values don't survive."""

    name = "CSV"

    def flat(self, row: dict[str, Any], before: str = "") -> dict[str, str]:
        out: dict[str, str] = {}
        for k, v in row.items():
            if isinstance(v, dict):
                out |= self.flat(v, f"{before}{k}.")
            elif isinstance(v, list) and v and isinstance(v[0], dict):
                raise Unfit("lists of objects aren't cells")
            else:
                out[before + k] = str(v)
        return out

    def write(self, value: Any, **options: Any) -> str:
        rows = [self.flat(r) for r in rows_of(value)]
        head = list(dict.fromkeys(k for r in rows for k in r))
        return "".join(",".join(x) + "\n" for x in [head, *([r.get(k, "") for k in head] for r in rows)])

    def cell(self, text: str) -> Any:
        if text in ("True", "False", "None"):
            return {"True": True, "False": False, "None": None}[text]
        if text.isdigit():
            return int(text)
        if "." in text:
            try:
                return float(text)
            except ValueError:
                pass
        return text

    def load(self, text: str) -> Any:
        """A blank cell is an absent member where there are several rows, and an empty text where there is one."""
        head, *lines = [line.split(",") for line in text.strip().split("\n")]
        out = []
        for cells in lines:
            row: dict[str, Any] = {}
            for k, c in zip(head, cells):
                if c == "" and len(lines) > 1:
                    continue
                *path, last = k.split(".")
                at = row
                for p in path:
                    at = at.setdefault(p, {})
                at[last] = self.cell(c)
            out.append(row)
        return out[0] if len(out) == 1 else out or {}


class SqlInsert(Format):
    """One INSERT statement; strings aren't escaped, so quotes and brackets in values don't survive."""

    name = "SQL"
    _statement = re.compile(r"INSERT INTO users \((?P<head>[^)]+)\) VALUES (?P<rows>.+);")
    _literal = re.compile(r"(?:[^,']|'[^']*(?:'|$))+")

    def literal(self, v: Any) -> str:
        if isinstance(v, (dict, list)):
            raise Unfit("nested values aren't literals")
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    def write(self, value: Any, **options: Any) -> str:
        rows = rows_of(value)
        head = list(rows[0])
        tuples = ", ".join("(" + ", ".join(self.literal(r[k]) for k in head) + ")" for r in rows)
        return f"INSERT INTO users ({', '.join(head)}) VALUES {tuples};"

    def meaning(self, text: str) -> Any:
        if text == "NULL":
            return None
        if len(text) > 1 and text[0] == text[-1] == "'":
            inside = text[1:-1]
            return parsed_or_text(inside) if inside[:1] in ("{", "[") else inside
        if text.removeprefix("-").isdigit():
            return int(text)
        if "." in text:
            try:
                return float(text)
            except ValueError:
                return text
        return {"true": True, "false": False}.get(text.lower(), text)

    def load(self, text: str) -> Any:
        m = self._statement.match(text.strip())
        if not m:
            raise Unfit("no INSERT statement")
        head = [k.strip() for k in m["head"].split(",")]
        out = []
        for body in re.findall(r"\((?P<row>[^)]+)\)", m["rows"]):
            cells = [self.meaning(c.strip()) for c in self._literal.findall(body)]
            if len(cells) < len(head):
                raise Unfit("a tuple has fewer values than columns")
            out.append(dict(zip(head, cells)))
        return out[0] if len(out) == 1 else out


_XML_NAME = re.compile(r"[^\W\d][\w.-]*")


class XmlText(Format):
    """Elements by key with their types as attributes, list members as `item`. A text stands for a value if it has
    the value's top-level names and scalars."""

    name = "XML"

    def escaped(self, text: str) -> str:
        return escape(text, quote=False).replace('"', "&quot;").replace("'", "&apos;")

    def tag(self, key: str) -> tuple[str, str]:
        """Name and attributes: numbers get a letter, blanks an underscore, what is no name goes into an attribute."""
        for name in (key, "n" + key if key.isdigit() else key, key.replace(" ", "_")):
            if _XML_NAME.fullmatch(name):
                return name, ""
        return "key", f' name="{self.escaped(key)}"'

    def element(self, key: str, v: Any, typed: bool = True) -> str:
        name, attributes = self.tag(key)
        if typed:
            attributes += f' type="{"null" if v is None else type(v).__name__}"'
        if isinstance(v, dict):
            inner = "".join(self.element(k, x) for k, x in v.items())
        elif isinstance(v, list):
            inner = "".join(self.element("item", x) for x in v)
        else:
            inner = "" if v is None else str(v).lower() if isinstance(v, bool) else self.escaped(str(v))
        return f"<{name}{attributes}>{inner}</{name}>"

    def write(self, value: Any, **options: Any) -> str:
        return self.element("root", value, typed=False)

    def load(self, text: str) -> Any:
        return parse(text, "XML")

    def check(self, value: Any, text: str) -> bool:
        if isinstance(value, list):
            return all(self.check(v, text) for v in value)
        if not isinstance(value, dict):
            raise Unfit("lists of scalars aren't told")
        told = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else "" if isinstance(v, (dict, list)) else str(v)
        return all(k in text and told(v) in text for k, v in value.items())


FORMATS: dict[str, Format] = {}


def register(fmt: Format) -> None:
    """Add a format under its name."""
    FORMATS[fmt.name] = fmt


for _f in (XmlText(), YamlText(), TomlText(), MarkdownTable(), PythonText(), CsvText(), HtmlTable(), SqlInsert()):
    register(_f)


def seed_of(*parts: Any) -> int:
    """A number drawn from the parts, alike everywhere."""
    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:8], "big")


def converted(value: Any, name: str, seed: int = 0) -> tuple[str | None, dict[str, Any], str | None]:
    """(text, options, None), or (None, options, why not)."""
    fmt = FORMATS[name]
    options = fmt.options(seed)
    try:
        if not value:
            raise Unfit("nothing to convert")
        text = fmt.write(value, **options)
        return (text, options, None) if fmt.surely(value) or fmt.check(value, text) else (None, options, "the text doesn't lead back")
    except Exception as e:  # any failure of a format's parser means that the document doesn't survive
        return None, options, f"{type(e).__name__}: {e}"[:200]


Writer = Callable[[Any], str]
