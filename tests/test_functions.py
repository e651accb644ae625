"""Plain functions: JSON texts, schemas, formats, scores, variation. Expected values follow the fixtures of the survey."""

import json
import random
import xml.etree.ElementTree as ET

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions import formats as f
from weftline.functions import json_schema as js
from weftline.functions import json_values as jv
from weftline.functions import scores, tabular, variation

PAIR = [{"who": "Ann", "years": 41}, {"who": "Bo", "years": 7}]
MIXED = {"who": "Ann", "years": 41, "mark": 2.75, "live": True, "memo": None}
NESTED = {"who": "Ann", "more": {"years": 41, "town": "Rome"}}
DEEP = [{"who": "Ann", "more": [{"years": 41}]}, {"who": "Bo", "more": [{"years": 7}]}]


def text(value, name):
    return f.converted(value, name)[0]


def el(tag, *inner, **attributes):
    """An element with what is in it."""
    return f"<{tag}" + "".join(f' {k}="{v}"' for k, v in attributes.items()) + ">" + "".join(inner) + f"</{tag}>"


def tr(tag, *cells):
    return el("tr", *(el(tag, c) for c in cells))


@pytest.mark.parametrize(
    ("name", "value", "want"),
    [
        ("HTML", PAIR[0], el("table", el("thead", tr("th", "who", "years")), el("tbody", tr("td", "Ann", "41")))),
        ("HTML", PAIR, el("table", el("thead", tr("th", "who", "years")), el("tbody", tr("td", "Ann", "41"), tr("td", "Bo", "7")))),
        ("HTML", NESTED, el("table", el("thead", tr("th", "who", "more")), el("tbody", tr("td", "Ann", "years", "41"), tr("td", "", "town", "Rome")))),
        ("HTML", {"a": {"x": 1, "y": "p"}, "b": {"z": 2.5}}, el("table", el("tbody", tr("td", "a", "x", "1"), tr("td", "", "y", "p"), tr("td", "b", "z", "2.5")))),
        ("MARKDOWN", {"a_b": "*x", "c": 2}, "| a\\_b | c |\n| --- | --- |\n| \\*x | 2 |"),
        ("CSV", [{"a": 1}, {"b": "x"}], "a,b\n1,\n,x\n"),
        ("CSV", {"a": "", "b": 1}, "a,b\n,1\n"),
        ("SQL", [{"a": -3, "b": True}, {"b": False, "a": None}], "INSERT INTO users (a, b) VALUES (-3, True), (NULL, False);"),
        ("XML", {"1": 5}, el("root", el("n1", "5", type="int"))),
        ("MARKDOWN", PAIR, "| who | years |\n| --- | --- |\n| Ann | 41 |\n| Bo | 7 |"),
        ("CSV", PAIR, "who,years\nAnn,41\nBo,7\n"),
        ("CSV", NESTED, "who,more.years,more.town\nAnn,41,Rome\n"),
        ("CSV", MIXED, "who,years,mark,live,memo\nAnn,41,2.75,True,None\n"),
        ("SQL", PAIR, "INSERT INTO users (who, years) VALUES ('Ann', 41), ('Bo', 7);"),
        ("XML", MIXED, el("root", el("who", "Ann", type="str"), el("years", "41", type="int"), el("mark", "2.75", type="float"), el("live", "true", type="bool"), el("memo", type="null"))),
        ("XML", DEEP[:1], el("root", el("item", el("who", "Ann", type="str"), el("more", el("item", el("years", "41", type="int"), type="dict"), type="list"), type="dict"))),
        ("PYTHON_STRING", MIXED, str(MIXED)),
        ("TOML", {"a": 1, "n": None, "t": {"x": "y"}, "l": [{"p": 1}, {"p": 2}]}, 'a = 1\n\n[t]\nx = "y"\n\n[[l]]\np = 1\n\n[[l]]\np = 2\n'),
    ],
)
def test_written_texts(name, value, want):
    assert text(value, name) == want


@pytest.mark.parametrize(
    ("name", "value"),
    [(n, v) for n in f.FORMATS for v in ({}, [])] + [("HTML", [{"a": 1}, {"b": 2}]), ("MARKDOWN", [{"a": 1}, {"b": 2}]), ("MARKDOWN", NESTED), ("SQL", NESTED), ("CSV", DEEP), ("HTML", {"a": True}), ("HTML", {"a": "12"}), ("HTML", PAIR[:1]), ("CSV", {"a": -3}), ("CSV", {"a": "x,y"}), ("SQL", {"a": "it's, so"}), ("SQL", {"a": "f(x)"}), ("XML", {"a": "<b>"}), ("XML", {"a": "it's"}), ("XML", {"a b": 1}), ("XML", [1, 2]), ("HTML", {"a": None}), ("HTML", [{"a": {"b": 1}}, {"a": {"b": 2}}]), ("HTML", {"n": {"x": 1, "y": 2}, "s": 1}), ("HTML", {"s": 1, "t": 2, "n": {"x": 1, "y": 2}}), ("HTML", {"s": 1, "n": {"x": 1}}), ("MARKDOWN", {"a": "x|y"}), ("CSV", {"a": ""}), ("SQL", {"a": 1e20}), ("SQL", {"a": "[1]"})],
)
def test_documents_that_do_not_survive(name, value):
    assert text(value, name) is None and f.converted(value, name)[2]


@pytest.mark.parametrize("value", [PAIR, MIXED, NESTED, DEEP, [1, "two", None], {"a": {"b": {"c": [1, 2]}}}])
@pytest.mark.parametrize("name", ["YAML", "TOML", "PYTHON_STRING"])
def test_round_trips(name, value):
    fmt = f.FORMATS[name]
    got = fmt.load(fmt.write(value, **fmt.options(5)))
    assert got == (jv.without_nulls(value) if name == "TOML" else value)


def test_toml_lists_are_tables_of_indexes():
    import tomllib

    assert tomllib.loads(text(["x", "y", 3], "TOML")) == {"0": "x", "1": "y", "2": 3}


leaf = st.none() | st.booleans() | st.integers(-5, 10**6) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8)
value = st.recursive(leaf, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(min_size=1, max_size=5), x, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(value, st.sampled_from(sorted(f.FORMATS)), st.integers(0, 20))
def test_a_kept_text_leads_back(v, name, seed):
    got, _, error = f.converted(v, name, seed)
    assert (got is None) == (error is not None)
    if got is not None:
        assert f.FORMATS[name].check(v, got)


def test_fences():
    block = "Intro\n```json\n{\"a\": 1}\n```\n"
    assert jv.fenced("none") == [] and jv.fenced(block) == [{"a": 1}] and jv.fenced(block * 2) == [{"a": 1}] * 2
    assert jv.fenced(block + "```json\n{broken\n```") == [{"a": 1}]
    assert jv.fenced("```json\n{\"a\": 1}") == []
    assert jv.fenced('```json\n{“a”: 1, // why\n"b": 2}\n```') == [{"a": 1, "b": 2}]
    assert jv.fenced('```json\n{"a": "f(x)"}\n```') == []  # no parentheses in a block
    assert len(jv.fenced(block * 12)) == 10


def test_json_texts():
    assert jv.minified({"b": 1, "a": "é"}) == '{"a":"\\u00e9","b":1}'
    assert jv.minified_text("not json") == "not json" and jv.minified_text(None) is None and jv.minified_text('{"b": 1.0, "a": 2}') == '{"a":2,"b":1.0}'
    assert jv.without_comments("a // b\nc") == "a c" and jv.parsed_or_text("[1]") == [1] and jv.parsed_or_text("x") == "x"
    assert jv.without_nulls({"a": None, "b": [None, {"c": None}]}) == {"b": [{}]}
    assert jv.blanked({"a": 1, "b": [None, "x"]}) == {"a": "", "b": [None, ""]}
    assert jv.xml_tree(ET.fromstring('<r a="1"><b>x</b><b>y</b></r>')) == {"a": "1", "b": [{"_text": "x"}, {"_text": "y"}]}
    assert jv.as_json("a: 1", "YAML") == '{"a": 1}' and jv.as_json("a = ", "TOML") is None and jv.as_json(None, "JSON") is None
    with pytest.raises(ValueError):
        jv.parse("no tags", "HTML")


def test_containers():
    deep = {"a": {"b": {"c": {"d": {"e": 1}}}}}
    assert [p for p, _ in jv.containers(deep)] == ["$", "$.a", "$.a.b", "$.a.b.c"]
    assert [p for p, _ in jv.containers(deep, 0)] == ["$"]
    assert list(jv.containers({})) == list(jv.containers([])) == list(jv.containers({"a": 0, "b": "", "c": []})) == []
    assert [p for p, _ in jv.containers([{"x": 1}, {"y": 0}, [2]])] == ["$", "$[0]", "$[2]"]


def test_strict_schemas():
    s = dict(type="object", title="T", properties={"day": dict(type="date"), "tags": dict(type="array", minItems=2, items=dict(type="object", properties={"format": dict(type="string", format="email")})), "any": dict(type=["string", "integer"])})
    assert js.strict(s) == dict(type=["object", "null"], properties={"day": dict(type=["string", "null"]), "tags": dict(type=["array", "null"], items=dict(type=["object", "null"], properties={"format": dict(type=["string", "null"])}, required=["format"], additionalProperties=False)), "any": dict(type=["string", "integer", "null"])}, required=["day", "tags", "any"], additionalProperties=False)
    for word in ("allOf", "oneOf", "anyOf"):
        with pytest.raises(js.SchemaError):
            js.strict({word: []})
    refs = dict(definitions={"p": dict(type="object", properties={"n": dict(type="integer")})}, type="object", properties={"x": dict(**{"$ref": "#/definitions/p"})})
    assert js.strict(refs)["properties"]["x"]["properties"] == {"n": dict(type=["integer", "null"])} and "$defs" not in js.strict(refs)
    assert js.strict(refs, expand=False)["properties"]["x"] == dict(**{"$ref": "#/$defs/p"})


schemas = st.recursive(st.sampled_from([dict(type=k) for k in ("string", "integer", "number", "boolean", "null", "date")]), lambda x: st.dictionaries(st.sampled_from("abcd"), x, min_size=1, max_size=3).map(lambda p: dict(type="object", properties=p)) | x.map(lambda i: dict(type="array", items=i)), max_leaves=6)


@settings(max_examples=150, deadline=None)
@given(schemas, st.integers(0, 10**6))
def test_strict_is_idempotent_and_instances_fit(s, seed):
    once = js.strict(s)
    assert js.strict(once) == once
    assert js.compile_schema(once)(js.instance(once, seed)) is None


@settings(max_examples=150, deadline=None)
@given(value)
def test_a_value_fits_its_inferred_schema(v):
    assert js.compile_schema(js.infer(v))(v) is None


def test_references():
    base = dict(**{"$id": "https://x.org/s.json"}, **{"$defs": {"a": dict(type="object", properties={"n": dict(type="integer")}), "b": dict(**{"$ref": "#/$defs/a"}), "loop": dict(**{"$ref": "#/$defs/loop"})}})
    assert js.resolve("#/$defs/a", base)["type"] == "object" and js.resolve("#", base) is base
    assert js.resolve("s.json#/$defs/a", base)["type"] == "object" and js.resolve("https://x.org/s.json#/$defs/a", base)["type"] == "object"
    assert js.resolve("https://y.org/t#/q", base, lambda url: {"q": dict(type="null")}) == dict(type="null")
    for bad in ("#/$defs/none", "#$defs/a", "other.json#/a", "https://y.org/t"):
        with pytest.raises(js.SchemaError):
            js.resolve(bad, base)
    assert js.expand_references(dict(**{"$ref": "#/$defs/b"}, title="own"), base) == {**base["$defs"]["a"], "title": "own"}
    with pytest.raises(js.SchemaError):
        js.expand_references(dict(**{"$ref": "#/$defs/loop"}), base)
    assert js.status(json.dumps(dict(type="object", properties=dict(x={"$ref": "#"}))), "expand")["status"] == "deleted"
    assert js.status('{"type": "object"}', "expand")["status"] == "skipped" and js.status("[]")["status"] == "deleted" and js.status(None)["status"] == "deleted"
    assert js.status(json.dumps(dict(**{"$defs": dict(a=dict(type="string"))}, type="object", properties=dict(x={"$ref": "#/$defs/a"}))), "expand")["status"] == "updated"


def test_sub_schemas():
    s = dict(type="object", **{"$defs": {"d": dict(type="object", properties={"z": dict(type="string")}), "p": dict(type="string")}}, properties={"a": dict(type="array", items=dict(**{"$ref": "#/$defs/d"})), "o": dict(type="object", properties={"i": dict(type="object", properties={})}), "s": dict(type="string"), "bad": dict(type="object", properties={"q": dict(type="what")})})
    assert [p for p, _ in js.sub_schemas(s)] == ["$defs.d", "properties.a", "properties.a.items.ref:#/$defs/d", "properties.o", "properties.o.properties.i"]
    assert list(js.sub_schemas(dict(type="object", properties={"me": dict(**{"$ref": "#"})}))) == []


def test_quality():
    assert js.good_quality(dict(type="object", properties={"a": {}})) and js.good_quality(dict(type=["array", "null"], items={"x": 1}))
    assert not any(map(js.good_quality, ({}, [], dict(type="string"), dict(type="object"), dict(type="array", items={}), dict(properties={"a": {}}))))


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        (dict(type="integer"), [1, 1.0, -3], [1.5, True, "1", None]), (dict(type="number"), [1, 1.5], [False, "x"]), (dict(type=["string", "null"]), ["", None], [1]), (dict(type="object", properties={"a": dict(type="integer")}, required=["a"], additionalProperties=False), [{"a": 1}], [{}, {"a": "x"}, {"a": 1, "b": 2}]),
        (dict(type="array", items=dict(type="boolean"), maxItems=2), [[], [True]], [[1], [True] * 3]), (dict(enum=["a", 1]), ["a", 1], ["b", True]), (dict(const=0), [0, 0.0], [False, 1]), (dict(minimum=2, maximum=3), [2, 3, "x"], [1, 4]), (dict(minLength=2, pattern="^a"), ["ab", 5], ["a", "bb"]),
        (dict(anyOf=[dict(type="string"), dict(minimum=5)]), ["x", 6], [1]), ({"oneOf": [dict(type="integer"), dict(minimum=5)]}, [1, 5.5], [7]), ({"not": dict(type="string")}, [1], ["x"]), (dict(**{"$ref": "#/$defs/t"}, **{"$defs": {"t": dict(type="string")}}), ["x"], [1]), (dict(additionalProperties=dict(type="integer")), [{"z": 1}], [{"z": "1"}]), (dict(items=[dict(type="integer")]), [[1, "x"]], [["x"]]), ({"uniqueItems": True}, [[1, 2]], [[1, 1]]),
    ],
)
def test_validation(schema, good, bad):
    wrong = js.compile_schema(schema)
    assert all(wrong(v) is None for v in good) and all(wrong(v) is not None for v in bad)


@pytest.mark.parametrize("bad", [dict(type="what"), dict(properties=[]), dict(items=3), dict(required="a"), [], dict(**{"$ref": "#/nope"}), {"pattern": "("}])
def test_what_is_no_schema(bad):
    with pytest.raises(js.SchemaError):
        js.compile_schema(bad)


@pytest.mark.parametrize(
    ("answer", "correct", "want"),
    [
        ({"a": 1, "b": 2}, {"a": 1, "b": 2}, (0, 0, 0, 1.0)), (dict(a=1, b=2, c=3), {"a": 1, "b": 2}, (2, 6, 0, 0.8125)), ({"a": 1}, {"a": 1, "b": 2}, (2, 0, 6, 0.7)), ({"a": 1, "b": 3}, {"a": 1, "b": 2}, (1, 1, 1, 0.9231)),
        ({"a": 1, "c": 2}, {"a": 1, "b": 2}, (1, 1, 1, 0.9231)), ({}, {}, (0, 0, 0, 1.0)), ({"a": {"nested": 1}}, {"a": {"nested": 2}}, (1, 1, 1, 0.9444)), (dict(items=[1, 2, 3]), dict(items=[1, 2]), (2, 2, 0, 0.9375)),
    ],
)
def test_differences(answer, correct, want):
    assert scores.differences(answer, correct) == want


def test_assessment():
    schema = json.dumps(dict(type="object", properties={"a": dict(type="integer")}, required=["a"]))
    kinds = lambda *x: scores.assess(*x)["error_type"]
    assert kinds(None, schema, "{}") == kinds("{}", schema, "{}", "timeout") == "request"
    assert kinds("{", schema, "{}") == "json" and kinds('{"a": "x"}', schema, '{"a": 1}') == "schema" and kinds('{"a": 2}', schema, '{"a": 1}') == "content"
    assert scores.assess('```json\n{"a": 1}\n```', schema, '{"a": 1}')["correct"]
    both = scores.assess("{}", schema, "{}")
    assert both["correct"] and both["error_type"] == "schema"  # correct, and yet against the schema
    assert kinds("{}", schema, "{}", None, "negative") is None and kinds("{}", scores.MISSING, "{}") is None


@pytest.mark.parametrize(
    ("value", "kinds", "want"),
    [(True, ["string"], "True"), (5, ["string", "null"], "5"), ("x", ["string"], "x"), ("12", ["integer"], 12), (3.0, ["integer"], 3), ("2.5", ["number"], 2.5), ("TRUE", ["boolean"], True), (0, ["boolean"], False), (None, ["integer", "null"], None), ({"a": 1}, ["object"], {"a": 1})],
)
def test_coercion(value, kinds, want):
    assert variation.coerce(value, kinds) == want


@pytest.mark.parametrize(("value", "kinds"), [("x", ["integer"]), (2.5, ["integer"]), ("maybe", ["boolean"]), ([], ["object"]), (None, ["string"][:0])])
def test_failed_coercion(value, kinds):
    with pytest.raises(ValueError):
        variation.coerce(value, kinds)


SCHEMA = js.strict(dict(type="object", properties={"a": dict(type="integer"), "b": dict(type="object", properties={"a": dict(type="number"), "c": dict(type="string")}), "l": dict(type="array", items=dict(type="object", properties={"n": dict(type="integer"), "m": dict(type="string")}))}))
DATA = {"a": 1, "b": {"a": 2.5, "c": "x"}, "l": [{"n": 1, "m": "p"}, {"n": 2, "m": "q"}]}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9))
def test_varied_documents_fit(seed):
    new, data, changes = variation.vary(SCHEMA, DATA, seed)
    assert js.compile_schema(new)(data) is None and list(data) == list(new["properties"])
    assert variation.vary(SCHEMA, DATA, seed) == (new, data, changes)


def test_rebuilding():
    assert variation.rebuilt(DATA, SCHEMA, {}) == DATA
    assert variation.apply_changes(DATA, {"dropped": ["b.a"], "retyped": {"l.[].n": "string"}, "added": ["z"]}) == {"a": 1, "b": {"c": "x"}, "l": [{"n": "1", "m": "p"}, {"n": "2", "m": "q"}], "z": None}
    for bad in ({}, {"a": None}, []):
        with pytest.raises(ValueError):
            variation.rebuilt(bad, js.strict(dict(type="object", properties={"a": dict(type="integer")})), {})


def test_augmentation_steps():
    sample = {"input_data": '{"a": 1}', "schema": json.dumps(dict(type="object", properties={"a": dict(type="integer")})), "output": '{"a": 1}'}
    rng = random.Random(1)
    assert variation.step_drop_schema(sample, rng)["schema"] == scores.MISSING
    assert json.loads(variation.presented('{"a": [1, "é"]}', rng)) == {"a": [1, "é"]} and variation.presented("a: 1", rng) == "a: 1"
    assert len(variation.corrupted("abc", rng)) > 3
    other = json.dumps(dict(type="array"))
    got = variation.step_negative([other])(sample, rng)
    assert (got["schema"], got["output"]) == (other, "[]")
    assert variation.step_negative([sample["schema"]])(sample, rng) == sample == variation.step_negative([])(sample, rng)


def test_tables():
    seen = set()
    for seed in range(120):
        t = tabular.triplet(seed)
        if t:
            seen.add(t["content_type"])
            assert js.check(t["output"], t["schema"]) is None and t == tabular.triplet(seed)
    assert len(seen) == 10


@pytest.mark.parametrize("schema, good, bad", [
    ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"required": ["a"]}, "else": {"required": ["b"]}}, [{"k": 1, "a": 0}, {"k": 2, "b": 0}, {"b": 0}], [{"k": 1, "b": 0}, {"k": 2, "a": 0}]),
    ({"dependencies": {"a": ["b"], "c": {"required": ["d"]}}}, [{"a": 1, "b": 1}, {}, {"c": 1, "d": 1}], [{"a": 1}, {"c": 1}]),
    ({"dependentRequired": {"a": ["b"]}, "dependentSchemas": {"c": {"minProperties": 2}}}, [{"a": 1, "b": 2}, {"c": 1, "x": 1}], [{"a": 1}, {"c": 1}]),
    ({"contains": {"type": "integer"}}, [[1], ["a", 2]], [[], ["a"]]),
    ({"contains": {"type": "integer"}, "minContains": 2, "maxContains": 3}, [[1, 2], [1, "x", 2, 3]], [[1], [1, 2, 3, 4]]),
    ({"propertyNames": {"pattern": "^[a-z]+$"}}, [{"ab": 1}], [{"A": 1}]),
    ({"items": [{"type": "integer"}], "additionalItems": False}, [[1], []], [[1, 2], ["a"]]),
    ({"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}, [[1, "a"], []], [[1, 2], ["a"]]),
    ({"patternProperties": {"^x": {"type": "integer"}}, "properties": {"xa": {"minimum": 5}}}, [{"xa": 6}, {"y": "s"}], [{"xa": 4}, {"xa": "s"}, {"xb": "s"}]),
    ({"multipleOf": 0.1}, [0.3, 1, "text"], [0.35]),
    ({"format": "date"}, ["2024-02-29", 5], ["2023-02-29", "x"]),
    ({"format": "date-time"}, ["2024-01-31T10:00:00Z", "2024-01-31t10:00:00.5+01:00"], ["2024-01-31", "2024-13-01T10:00:00Z"]),
    ({"format": "time"}, ["10:00:00Z"], ["25:00:00Z"]),
    ({"format": "email"}, ["a@b.org"], ["a@b", "a b@c.d"]),
    ({"format": "hostname"}, ["a-b.example"], ["-a.b", "a_b"]),
    ({"format": "ipv4"}, ["10.0.0.1"], ["10.0.0.256", "1.2.3"]),
    ({"format": "ipv6"}, ["::1"], ["::g", "1.2.3.4"]),
    ({"format": "uri"}, ["http://a/b?c#d"], ["no scheme", "/a"]),
    ({"format": "uuid"}, ["123e4567-e89b-12d3-a456-426614174000"], ["123e4567"]),
    ({"format": "json-pointer"}, ["/a~0b", ""], ["a", "/~2"]),
    ({"format": "regex"}, ["a+"], ["("]),
    ({"format": "unheard-of"}, ["anything"], []),
])
def test_validation_keywords(schema, good, bad):
    text = json.dumps(schema)
    assert [js.check(json.dumps(x), text) for x in good] == [None] * len(good)
    assert all(js.check(json.dumps(x), text) for x in bad)
    if "format" in schema:
        assert not any(js.check(json.dumps(x), text, formats=False) for x in bad)


def test_tables_have_the_texts_of_data_frames():
    """Rows are written without a data frame; one is made for its own text alone."""
    import io
    from unittest import mock

    import pandas as pd
    import yaml

    made = {how: [] for how in tabular.RENDERINGS}
    with mock.patch.object(tabular.pd, "DataFrame", side_effect=pd.DataFrame) as frames:
        for seed in range(600):
            rng = random.Random(seed)
            how = rng.choice(tabular.RENDERINGS)
            before = frames.call_count
            t = tabular.triplet(seed)
            assert frames.call_count - before == (how == "string")
            made[how].append(t)
    for t in made["csv"]:
        rows = json.loads(t["output"])
        df = pd.DataFrame(rows if isinstance(rows, list) else [rows], dtype=object)
        assert t["input_data"] in {df.to_csv(sep=s, index=False) for s in tabular.CSV_SIGNS}
    for t in made["yaml"]:
        assert t["input_data"] == yaml.dump(yaml.safe_load(io.StringIO(t["input_data"])), sort_keys=False)


simple_parts = st.recursive(st.one_of(st.integers(-(10**9), 10**9), st.booleans(), st.sampled_from("n y alpha Beta c_1 Order O".split())), lambda x: st.one_of(st.lists(x, min_size=1, max_size=4), st.dictionaries(st.sampled_from("n y key lines Part_2 x".split()), x, min_size=1, max_size=4)))


@given(simple_parts, st.integers(0, 9))
@settings(max_examples=400, deadline=None)
def test_simple_documents_have_the_library_s_text_and_lead_back(value, seed):
    import yaml

    assert f.simple(value)
    for name in ("YAML", "TOML", "PYTHON_STRING"):
        fmt = f.FORMATS[name]
        if fmt.surely(value):
            options = fmt.options(seed)
            text = fmt.write(value, **options)
            assert fmt.check(value, text)
            assert name != "YAML" or text == yaml.dump(value, Dumper=f.YAML_DUMPER, **options)


def test_what_isn_t_simple_is_loaded_to_tell():
    part = [1]
    for value in ({"a": "yes"}, {"a": "x y"}, {"1": 2}, {"null": 1}, {"a": 1.5}, {"a": None}, {"a": []}, {}, [{}], {"a": {"b": "a" * 61}}, {"a": 10**15}):
        assert not f.simple(value) and not any(fmt.surely(value) for fmt in f.FORMATS.values())
    assert "&id001" in f.FORMATS["YAML"].write({"a": part, "b": part})  # the library names what is met twice
    assert not f.FORMATS["TOML"].surely([{"a": 1}, 5])  # tables come after other members, so the order is lost
    value = {"key": 1, "lines": [{"n": 1, "part": 2}]}
    for name in ("YAML", "TOML", "PYTHON_STRING"):
        assert f.FORMATS[name].surely(value)


def test_equal_answers_need_no_matching():
    from unittest import mock

    with mock.patch.object(scores.difflib, "SequenceMatcher", side_effect=AssertionError):
        assert scores.differences({"a": [1, "x" * 300], "b": None}, {"b": None, "a": [1, "x" * 300]}) == (0, 0, 0, 1.0)
    assert scores.differences({"a": 1}, {"a": 1.0})[0] == 1  # equal values, other texts
    assert scores.assess('{"a": 1}', None, '{"a": 1.0}')["correct"] and scores.assess('{"a": 1}', None, '{"a": 1.0}')["similarity"] < 1


def test_kept_answers_are_told_once_and_bounded():
    asked = []
    f_ = js.kept(lambda x: asked.append(x) or x, most=2, longest=5)
    assert [f_(x) for x in ("a", "a", "b", "b", "c", "a", "longer", "longer")] == ["a", "a", "b", "b", "c", "a", "longer", "longer"]
    assert asked == ["a", "b", "c", "a", "longer", "longer"]


def test_varying_leaves_schema_and_document_alone():
    from unittest import mock

    schema, data = json.loads(json.dumps(SCHEMA)), json.loads(json.dumps(DATA))
    with mock.patch.object(variation, "copied", side_effect=variation.copied) as copies:
        for seed in range(50):
            copies.reset_mock()
            variation.vary(schema, data, seed)
            assert sum(c.args[0] is schema for c in copies.call_args_list) == 1
    assert schema == SCHEMA and data == DATA
