"""DataFrame operators beyond what the catalogue compares with SQL: storage, layouts, groups, samples, streaming."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import json_schema as js
from weftline.operators import cleaning, evaluation, generation, graph, retrieval, sampling, training
from weftline.operators.numbering import numbered
from weftline.sources import layouts, ngrams, results
from weftline.storage import SCHEMAS, Store, new_id
from weftline.streaming import ingest

SCHEMA = json.dumps(js.strict(dict(type="object", properties={"name": dict(type="string"), "age": dict(type="integer")})))
CHUNK = SCHEMAS["chunks"]


def chunk(i, content, kind="JSON", schema="s1", parent=None, doc=None, meta="{}"):
    return (i, content, kind, False, doc, parent, False, schema, meta)


@pytest.fixture
def small(spark):
    chunks = spark.createDataFrame([chunk("c1", '{"name": "Ann", "age": 41}'), chunk("c2", '[{"name": "Ann", "age": 1}, {"name": "Bo", "age": 2}]', schema="s2"), chunk("c3", '{"name": "Cy", "age": 5}', schema=None), chunk("c4", "<x/>", "XML")], CHUNK)
    schemas = spark.createDataFrame([("s1", SCHEMA, False, None, "{}"), ("s2", json.dumps(dict(type="array", items=json.loads(SCHEMA))), False, "s1", "{}"), ("s3", json.dumps(dict(type="object", properties={"zeta": dict(type="string")}, required=["zeta"])), False, None, "{}"), ("s4", '{"type": "what"}', False, None, "{}")], SCHEMAS["json_schemas"])
    conversions = spark.createDataFrame([("v1", "c4", "s1", "c1", 0, "{}")], SCHEMAS["schema_conversions"])
    return chunks, schemas, conversions


def test_code_is_shipped_where_executors_lack_it(tmp_path, monkeypatch):
    import zipfile

    from weftline import session

    class Context:
        applicationId = "app"
        files: list = []

        def addPyFile(self, path):  # noqa: N802
            self.files.append(path)

    class Session:
        sparkContext = Context()

    session.ship(Session())
    assert Context.files == []  # the tests' executors have it
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("PYTHONPATH", "/nowhere")
    session.ship(Session())
    session.ship(Session())
    assert len(Context.files) == 1 and "weftline/storage.py" in zipfile.ZipFile(Context.files[0]).namelist()


def test_store(spark, tmp_path, small):
    store = Store(spark, f"file://{tmp_path}/db")
    store.create()
    assert all(store.read(n).count() == 0 for n in SCHEMAS)
    store.append("chunks", small[0])
    store.scope(lambda t: {"chunks": t["chunks"].where("false")}, preview=True)
    assert store.read("chunks").count() == 4
    store.scope(lambda t: {"chunks": t["chunks"].where("content_type = 'JSON'")})
    store.vacuum("chunks", 1)
    assert store.sql("SELECT count(*) AS n FROM chunks").first().n == 3
    assert len(list((tmp_path / "db" / "chunks").iterdir())) == 2  # one version and the pointer


def test_ids_tell_nulls_from_blanks(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), (None, "a")], "x string, y string")
    assert df.select(new_id(F.col("x"), F.col("y"))).distinct().count() == 3


def test_two_stage_duplicates(spark):
    make = lambda *t: spark.createDataFrame(list(enumerate(t)), "id long, content string")
    assert cleaning.drop_duplicate_chunks(make("A", "A", "a", "a")).count() == 1
    assert cleaning.drop_duplicate_chunks(make("A", "a ")).count() == 2
    assert cleaning.drop_duplicate_chunks(make(None, None, "")).count() >= 1


def test_documents_by_meta_then_content(spark):
    rows = [("1", "s", "x", "TEXT", "m"), ("2", "s", "y", "TEXT", "m"), ("3", "t", "z", "TEXT", "m2"), ("4", "t", "z", "TEXT", "m3"), ("5", "u", "z", "TEXT", "m4")]
    got = cleaning.drop_duplicate_documents(spark.createDataFrame(rows, SCHEMAS["source_documents"]))
    assert {r.id for r in got.collect()} == {"1", "3", "5"}


def test_schemas_are_repointed_everywhere(spark):
    schemas = spark.createDataFrame([("a", "X", False, None, None), ("b", "X", False, None, None), ("c", "Y", False, None, None)], SCHEMAS["json_schemas"])
    chunks = spark.createDataFrame([chunk("1", "x", schema="b"), chunk("2", "x", schema=None)], CHUNK)
    conv = spark.createDataFrame([("v", "1", "b", "1", None, None)], SCHEMAS["schema_conversions"])
    s, c, v = cleaning.drop_duplicate_schemas(schemas, chunks, conv)
    assert {r.id for r in s.collect()} == {"a", "c"} and {(r.id, r.schema_id) for r in c.collect()} == {("1", "a"), ("2", None)} and v.first().schema_id == "a"


def test_dangling_broken_and_repairs(spark, small):
    chunks, schemas, conversions = small
    assert {r.id for r in cleaning.dangling_schemas(schemas, chunks).collect()} == {"s3", "s4"}
    assert {r.id for r in cleaning.drop_broken_schemas(schemas).collect()} == {"s1", "s2", "s3"}
    broken = chunks.withColumn("schema_id", F.when(F.col("id") == "c1", "s3").when(F.col("id") == "c2", "gone").otherwise(F.col("schema_id")))
    assert {r.id: r.schema_id for r in cleaning.clear_broken_mappings(broken, schemas).collect()} == {"c1": None, "c2": None, "c3": None, "c4": None}
    assert cleaning.invalid_conversions(conversions, chunks.where("id != 'c4'"), schemas).count() == 1 and cleaning.invalid_conversions(conversions, chunks, schemas).count() == 0
    v, c, s = cleaning.drop_format(conversions, chunks, schemas)
    assert v.count() == 0 and {r.id for r in c.collect()} == {"c2", "c3"} and {r.id for r in s.collect()} == {"s2", "s3", "s4"}
    docs = spark.createDataFrame([("d1", "s", "x", "TEXT", "{}"), ("d2", "s", "y", "TEXT", "{}")], SCHEMAS["source_documents"])
    own = spark.createDataFrame([chunk("k", "x", doc="d1"), chunk("l", "x", doc="d2")], CHUNK)
    d, c = cleaning.delete_documents(docs, own, docs.where("id = 'd1'"))
    assert [r.id for r in d.collect()] == ["d2"] and [r.id for r in c.collect()] == ["l"]
    assert {r.content for r in cleaning.clear_content(docs).collect()} == {""}


def test_not_in_with_nulls(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "id string")
    some, nulls = (spark.createDataFrame([(x,) for x in v], "parent_document_id string") for v in (["a"], ["a", None]))
    assert cleaning.documents_without_chunks_null_aware(docs, some).count() == 1 and cleaning.documents_without_chunks_null_aware(docs, nulls).count() == 0 and cleaning.documents_without_chunks(docs, nulls).count() == 1


def plain_groups(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain_groups(edges)
    named = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in edges] + [(None, "x")], "a string, b string")
    assert {r.node: r.label for r in graph.components(named).collect()} == {f"n{k:03}": f"n{v:03}" for k, v in plain_groups(edges).items()}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_many_edges(spark):
    """700,000 edges and more: chains of six with shuffled names, and one hub with a third of all nodes."""
    name = lambda c: (c * 7919) % 700_001
    chains = spark.range(699_996).where("id % 6 < 5").select(name(F.col("id")).alias("a"), name(F.col("id") + 1).alias("b"))
    got = graph.components(chains.union(spark.range(1_000_000, 1_120_000).select("id", F.lit(1_050_000).cast("long"))))
    want = spark.range(699_996).groupBy(F.floor(F.col("id") / 6)).agg(F.min(name(F.col("id"))).alias("low"), F.collect_list(name(F.col("id"))).alias("n")).where(F.size("n") > 1)
    want = want.select(F.explode("n").alias("node"), F.col("low").alias("label")).union(spark.range(1_000_000, 1_120_000).select("id", F.lit(1_000_000).cast("long")))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_intermediates_are_removed(spark):
    from weftline import storage

    before = set(storage._MADE)
    with storage.scratch():
        df = storage.materialise(spark.range(5), "t")
        assert df.count() == 5 and set(storage._MADE) - before == {df.written_at}
    assert set(storage._MADE) == before
    df = storage.materialise(spark.range(5), "t")
    storage.discard(df)
    assert set(storage._MADE) == before


def test_a_folder_of_this_machine_is_refused_on_a_cluster():
    from weftline import storage

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(dict)  # noqa: N815

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        storage.shared_dir(Cluster())


def test_roots(spark):
    rows = [(i, i - 1 if i else None) for i in range(20)] + [(50, 99), (60, 61), (61, 62), (62, 60), (70, 60), (80, 80)]
    got = {r.node: r.root for r in graph.roots(spark.createDataFrame(rows, "id long, parent_id long")).collect()}
    assert got == {**{i: 0 for i in range(20)}, 50: 99, 60: 60, 61: 60, 62: 60, 70: 60, 80: 80}


def test_groups_share_any_signature(spark):
    docs = spark.createDataFrame([("d1", "src", "", "JSON", '{"source_dataset_index": "7"}'), ("d2", "src", "", "JSON", '{"source_dataset_index": "7"}')], SCHEMAS["source_documents"])
    chunks = [chunk(f"i{k}", t, "TEXT", doc=d) for k, t, d in [(1, "abc", None), (2, "CBA", None), (3, "x1", "d1"), (4, "x22", "d2"), (5, "alone", None), (6, "other", None)]] + [chunk(f"o{k}", f'{{"k": "{"abcdefg"[k] * (k + 9)}"}}', schema=f"s{k}") for k in range(1, 7)]
    chunks.append(chunk("p", "parent", "TEXT"))
    chunks = [(*c[:5], "p", *c[6:]) if c[0] in ("i5", "i6") else c for c in chunks]
    schemas = [(f"s{k}", f"schema {'z' * k * 3}", False, None, None) for k in range(1, 7)]
    conv = [(f"v{k}", f"i{k}", f"s{k}", f"o{k}", None, "{}") for k in range(1, 7)]
    c, s, v = spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(schemas, SCHEMAS["json_schemas"]), spark.createDataFrame(conv, SCHEMAS["schema_conversions"])
    got = {r.id: r for r in graph.assign_groups(v, c, s, docs).collect()}
    g = {k: r.group_id for k, r in got.items()}
    assert g["v1"] == g["v2"] and g["v3"] == g["v4"] and g["v5"] == g["v6"] and len(set(g.values())) == 3 and min(g.values()) == 0
    assert all(json.loads(r.meta)["group"] == str(r.group_id) for r in got.values())


@pytest.mark.parametrize("want", [1, 7, 50])
def test_split_keeps_groups_whole(spark, want):
    rng = random.Random(5)
    rows = [(g, i) for g in range(60) for i in range(rng.choice([1, 1, 2, 3, 9, 30]))]
    split = graph.split_groups(spark.createDataFrame(rows, "group_id long, i int"), want).collect()
    sizes = {}
    for g, _ in rows:
        sizes[g] = sizes.get(g, 0) + 1
    assert {r.group_id: r["size"] for r in split} == sizes
    test = [r for r in split if r.is_test]
    top = sorted(sizes, key=lambda g: (-sizes[g], g))[:2]
    assert 0 < sum(r["size"] for r in test) <= want and not {r.group_id for r in test} & set(top)
    with pytest.raises(ValueError):
        graph.split_groups(spark.createDataFrame(rows, "group_id long, i int"), len(rows))


def test_numbering(spark):
    df = spark.range(1000).repartition(7)
    got = numbered(df, [F.col("id").desc()], "k", first=1).collect()
    assert {r.id: r.k for r in got} == {i: 1000 - i for i in range(1000)}


def test_bm25_equals_the_plain_version(spark):
    texts = ["the cat sat", "the dog, the dog", "a bird", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    tok = [r.t for r in docs.orderBy("id").select(retrieval.tokens("content").alias("t")).collect()]
    got = {r.doc: r.score for r in retrieval.scores(docs, spark.createDataFrame([(0, "the dog")], "query_id long, query string")).collect()}
    want = retrieval.plain_bm25(tok, tok[1][:3])
    assert all(abs(got.get(i, 0) - w) < 1e-9 for i, w in enumerate(want))


@pytest.mark.parametrize("block_docs", [20_000, 30])
def test_search_by_blocks_equals_the_full_scores(spark, block_docs):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(150)] + [(900, ""), (901, None)], "id long, content string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices(words, k=4))) for i in range(25)] + [(99, "absent")], "query_id long, query string")
    full = {(r.query_id, r["rank"]): (r.doc, r.score) for r in retrieval.top_k(retrieval.scores(docs, queries), 5).collect()}
    got = {(r.query_id, r["rank"]): (r.doc, r.score) for r in retrieval.search(docs, queries, 5, block_docs=block_docs).collect()}
    assert got.keys() == full.keys() and all(abs(got[k][1] - full[k][1]) < 2e-6 for k in full) and sum(got[k][0] == full[k][0] for k in full) >= 0.98 * len(full)


def test_mapping_takes_the_first_that_fits(spark, small):
    chunks, schemas, _ = small
    got = {r.id: r for r in retrieval.map_chunks(chunks, schemas).collect()}
    assert got["c3"].schema_id == "s1" and json.loads(got["c3"].meta)["schema_source"] == "mapped" and got["c4"].schema_id == "s1" and got["c4"].meta == "{}"


def test_format_conversions(spark, small):
    chunks, _, conversions = small
    fresh, links = generation.format_conversions(chunks.where("id != 'c4'").union(chunks.where("id = 'c4'")), conversions)
    rows = fresh.collect()
    assert {(r.parent_chunk_id, r.content_type) for r in rows if r.parent_chunk_id == "c1"} == {("c1", k) for k in ("YAML", "TOML", "MARKDOWN", "PYTHON_STRING", "CSV", "HTML", "SQL")}  # XML is there already
    assert len({r.id for r in rows}) == len(rows) == links.count() and all(r.matches_parent_chunk for r in rows)
    assert {r.input_chunk_id for r in links.collect()} == {r.id for r in rows}


def test_sub_documents(spark):
    deep = json.dumps({"a": {"b": {"c": "x" * 50}}, "d": [{"e": "y" * 40}], "f": {}})
    rows = spark.createDataFrame([chunk("c1", deep), chunk("c2", "{}"), chunk("c3", "not json"), chunk("c4", None)], CHUNK)
    all_ = generation.sub_documents(rows, source="chunks", least=40, share=1.0).collect()
    assert len(all_) == 4 and all(r.parent_chunk_id == "c1" and json.loads(r.meta)["source"] == "extracted_sub_json" for r in all_)
    assert generation.sub_documents(rows, source="chunks", least=40, share=0.5).count() == 2 and generation.sub_documents(rows, source="chunks", least=40, share=0.01).count() == 1
    assert generation.sub_documents(rows, source="documents", least=1000).count() == 0
    assert generation.sub_documents(rows, source="chunks", least=40, share=1.0, most=3).count() == 3


def lookup(url):
    if url != "http://known/one.json":
        raise js.SchemaError(url)
    return {"type": "object", "properties": {"a": {"type": "integer"}}}


def test_urls_are_resolved(spark):
    rows = [("u", '{"type": "object", "properties": {"x": {"$ref": "http://known/one.json"}}}'), ("v", '{"$ref": "http://gone"}')]
    schemas = spark.createDataFrame([(*r, False, None, "{}") for r in rows], SCHEMAS["json_schemas"])
    got = {r.id: r for r in generation.normalised_schemas(schemas, "expand", resolver=lookup).collect()}
    assert (got["u"].status, got["v"].status) == ("updated", "deleted") and json.loads(got["u"].content)["properties"]["x"] == lookup("http://known/one.json")
    assert [json.loads(r.content) for r in generation.sub_schemas(schemas, resolver=lookup).collect()] == [lookup("http://known/one.json")]
    assert {r.status for r in generation.normalised_schemas(schemas, "expand").collect()} == {"deleted"}


def test_one_whole_row_of_each_repeated_key(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, None, "n"), (5, None, "m")], "id long, k string, v string")
    assert sorted(map(tuple, cleaning.any_row_of(df, ["k"], "id").collect())) == [(1, "a", "x"), (4, None, "n")]
    assert cleaning.any_row_of(df, ["k"], "id", only_repeated=False).count() == 3


def test_schema_normalisation_states(spark, small):
    got = {r.id: r.status for r in generation.normalised_schemas(small[1]).collect()}
    assert got == {"s1": "skipped", "s2": "updated", "s3": "updated", "s4": "deleted"}


def test_variations_and_tables_as_rows(spark, small):
    chunks, schemas, _ = small
    s, c, v = generation.as_varied_rows(generation.varied_schemas(chunks, schemas, 3))
    assert s.columns == [x.split()[0] for x in SCHEMAS["json_schemas"].split(", ")] and c.count() == s.count() == v.count() > 0
    assert {r.parent_chunk_id for r in c.collect()} == {"c1"}
    s, c, v = generation.as_synthetic_rows(generation.synthetic_tables(spark.range(20)))
    assert c.count() == 2 * s.count() == 2 * v.count() and c.join(s.select(F.col("id").alias("schema_id")), "schema_id", "left_anti").count() == 0
    kids = c.where("parent_chunk_id is not null")
    assert kids.join(c.select(F.col("id").alias("parent_chunk_id")), "parent_chunk_id").count() == s.count()  # lineage is kept


def test_providers_and_their_checks(spark, small):
    chunks, schemas, _ = small
    got = generation.inferred_schemas(chunks).collect()
    assert [r.chunk_id for r in got] == ["c3"] and js.check('{"name": "Cy", "age": 5}', got[0].schema) is None
    assert generation.inferred_schemas(chunks, provider=lambda text: '{"type": "array"}').count() == 0
    assert {r.schema_id for r in generation.generated_chunks(schemas, chunks).collect()} == {"s3"}
    assert generation.generated_chunks(schemas, chunks, dangling_only=False, provider=lambda text, seed: "{}").count() == 0


@pytest.fixture
def samples(spark):
    kinds = ["a", "b", "c"]
    schema = lambda k: json.dumps(dict(type="object", properties={k: dict(type="integer")}, required=[k]))
    rows = [(f"in {i}", schema(kinds[i % 3]), json.dumps({kinds[i % 3]: i}), (None, "TEXT", None, kinds[i % 3], f"v{i}", i % 2 == 0, i % 5, False, None, None)) for i in range(40)]
    return spark.createDataFrame(rows, sampling.SAMPLE)


def test_missing_and_negative_samples(samples):
    missing = sampling.missing_schema_samples(samples).collect()
    assert len(missing) == 2 and all(r.schema == "[MISSING]" and r.meta.is_test and r.meta.synthetic_type == "missing_schema" for r in missing)
    negative = sampling.negative_samples(samples).collect()
    assert len(negative) == 10 and all(r.output == "{}" and r.meta.schema_id != r.meta.original_schema_id and r.meta.synthetic_type == "negative" for r in negative)
    assert sampling.negative_samples(samples.where("meta.schema_id = 'a'")).count() == 0 and sampling.negative_samples(samples.where("false")).count() == 0
    assert sorted(map(str, negative)) == sorted(map(str, sampling.negative_samples(samples.repartition(3)).collect()))


def test_expansion_is_planned_alike_at_every_size(spark, small):
    """Small tables of chunks aren't broadcast, so that what is shuffled grows as the input does."""
    chunks, schemas, conversions = small
    for df in (cleaning.expanded(conversions, chunks, schemas), cleaning.expanded(conversions, chunks.where("content_type = 'XML'"), schemas, chunks)):
        assert df._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") >= 2
        row = df.first()
        assert (df.count(), row.id, row.input_content, row.output_content, row.schema_content) == (1, "v1", "<x/>", '{"name": "Ann", "age": 41}', SCHEMA)


def test_expansion_with_odd_references(spark):
    """Null and missing references go, repeated conversions and repeated chunks multiply, null contents stay."""
    text = "id long, content string"
    inputs = spark.createDataFrame([(1, "i1"), (-1, "i-1"), (2, None), (3, "i3"), (3, "again"), (None, "no")], text)
    outputs = spark.createDataFrame([(1, "o1"), (-1, "o-1"), (4, "o4"), (None, "no")], text)
    schemas = spark.createDataFrame([(1, "s1"), (None, "no")], text)
    v = [(1, 1, 1), (-1, 1, 1), (1, -1, 1), (2, 1, 1), (3, 4, 1), (3, 4, 1), (4, 1, 1), (1, 3, 1), (1, 1, 2), (None, 1, 1), (1, None, 1), (1, 1, None)]
    got = cleaning.expanded(spark.createDataFrame(v, "input_chunk_id long, output_chunk_id long, schema_id long"), inputs, schemas, outputs)
    rows = sorted(map(str, ((r.input_content, r.output_content, r.schema_content) for r in got.collect())))
    assert rows == sorted(map(str, [("i1", "o1", "s1"), ("i-1", "o1", "s1"), ("i1", "o-1", "s1"), (None, "o1", "s1"), *[("i3", "o4", "s1"), ("again", "o4", "s1")] * 2]))


def test_export_keeps_group_0(spark, small):
    chunks, schemas, conversions = small
    split = spark.createDataFrame([(0, True)], "group_id long, is_test boolean")
    got = sampling.export_samples(conversions, chunks, schemas, split).collect()
    assert len(got) == 1 and got[0].meta.group == 0 and got[0].meta.is_test and got[0].input_data == "<x/>"
    assert cleaning.eligible_for_export(conversions, chunks, legacy_drop_group0=True).count() == 0


def test_dataset_sinks(spark, samples, tmp_path):
    results.write_dataset(samples, str(tmp_path / "d"))
    back = results.read_dataset(spark, str(tmp_path / "d"), "test")
    assert back.count() == 20 and back.where("meta.is_test").count() == 20
    results.write_samples(samples, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 40
    (tmp_path / "r" / "m1").mkdir(parents=True)
    (tmp_path / "r" / "m1" / "results.json").write_text(json.dumps([{"sample_id": 1}, {"sample_id": 2}]))
    assert {r.model for r in results.read_results(spark, str(tmp_path / "r")).collect()} == {"m1"}
    assert "<object>" in results.safe_json({"x": object()})


def test_scored_results(spark):
    schema = json.dumps(dict(type="object", properties={"a": dict(type="integer")}))
    rows = [('{"a": 1}', schema, '{"a": 1}', None, None), ('{"a": "x"}', schema, '{"a": 1}', None, None), ("{", schema, "{}", None, None), (None, schema, "{}", "timeout", None), ('{"a": 2}', schema, '{"a": 1}', None, None)]
    got = evaluation.scored(spark.createDataFrame(rows, "completion string, schema string, correct_answer string, request_error string, synthetic_type string"))
    told = evaluation.summary(got).first()
    assert (told.request_errors, told.json_errors, told.schema_errors, told.content_errors, told.correct_rate, told.n) == (20.0, 20.0, 20.0, 20.0, 20.0, 5)


def test_bucket_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 500, 501, 1000, 1200)], "n long")
    got = {r.bucket: r.n for r in evaluation.length_buckets(df, "n", F.lit(False)).collect()}
    assert got == {500: 2, 1000: 2}


def test_training_rows(spark):
    df = spark.createDataFrame([([5, 6], [7], 0), ([5], [8, 9, 10], 0)], "p array<int>, t array<int>, b int")
    m = training.masked(df, "p", "t", 1, 2)
    assert [tuple(r.labels) for r in m.collect()] == [(-100, -100, -100, 7, 2), (-100, -100, 8, 9, 10, 2)]
    assert [r.length for r in training.within_length(m, 5).collect()] == [5] and training.within_length(m, None).count() == 2
    padded = training.padded(m, "b", 0, 4).collect()
    assert {len(r.input_ids) for r in padded} == {8} and sum(padded[0].attention_mask) in (5, 6)
    long = m.withColumn("original_input_ids", F.array(F.lit(1))).withColumn("original_labels", F.array(F.lit(1)))
    assert sorted(len(r.input_ids) for r in training.reverted_if_long(long, 5).collect()) == [1, 5]
    q = spark.createDataFrame([("g", 5), ("g", 1), ("g", 9), ("h", None)], "g string, v long")
    assert {r.g: r.value for r in training.floor_percentile(q, "g", "v", 0.9).collect()} == {"g": 5, "h": 0}


def test_layouts(spark, tmp_path):
    assert layouts.layout_of("/x/SchemaStore/schemastore/") is layouts.schema_store and layouts.layout_id("a/B/c") == "b/c"
    with pytest.raises(KeyError):
        layouts.layout_of("no/such")
    raw = layouts.raw_records(spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string"), "src")["source_documents"]
    assert raw.select("id").distinct().count() == 3 and json.loads(raw.orderBy("content").first().content) == {"a": 1, "b": "x"}
    good = json.dumps(dict(type="object", properties=dict(a=dict(type="integer"))))
    rows = spark.createDataFrame([(good, '{"a": 1}'), (good, '{"a": "x"}'), ('{"type": "string"}', '"x"'), ('{"anyOf": []}', "{}")], "schema string, response string")
    got = layouts.schema_and_answer(rows, "src")
    assert {r.status: r.n for r in got["status"].collect()} == {"ok": 1, "answer doesn't fit": 1, "low quality": 1, "no strict schema": 1}
    assert got["chunks"].count() == got["source_documents"].count() == 4 and got["json_schemas"].count() == 1
    assert got["chunks"].where("schema_id is not null").join(got["json_schemas"].select(F.col("id").alias("schema_id")), "schema_id").count() == 1
    assert layouts.schema_and_answer(rows, "src", limit=2)["chunks"].count() == 2
    (tmp_path / "src").mkdir()
    for name, lines in {"a": ["z", "b"], "b": ["a", "z", "c"]}.items():
        (tmp_path / "src" / f"{name}.json").write_text("\n".join(json.dumps({"a": x}) for x in lines))
    placed = layouts.in_source_order(spark.read.schema("a string").json(str(tmp_path / "src")))
    docs = layouts.raw_records(placed, "src")["source_documents"]
    assert {json.loads(r.meta)["source_dataset_index"]: json.loads(r.content)["a"] for r in docs.collect()} == dict(enumerate("zbazc"))
    assert {json.loads(r.content)["a"] for r in layouts.raw_records(placed, "src", limit=2)["source_documents"].collect()} == {"z", "b"}
    talk = placed.selectExpr("array(struct(concat('{\"k\": \"', a, '\"}') as value)) conversations", "concat('{\"type\": \"object\", \"properties\": {\"', a, '\": {\"type\": \"integer\"}}}') schema", "__place")
    told = layouts.conversations(talk, "src")["source_documents"].collect()
    assert {json.loads(r.meta)["source_dataset_index"]: json.loads(r.content)["k"] for r in told} == {0: "z", 1: "b", 2: "a", 4: "c"}  # the first of each, with its own index
    chats = spark.createDataFrame([([{"value": "q"}, {"value": "<think>no</think> {\"a\": 1}"}], good), ([{"value": "{\"a\": 1}"}], good + " "), ([{"value": "x" * 10_001}], good)], "conversations array<struct<value:string>>, schema string")
    assert layouts.conversations(chats, "src")["chunks"].count() == 1
    assert layouts.schemas_only(rows, "src")["json_schemas"].count() == 1
    for path, text in {"schemas/one.json": good, "tests/one/a.json": '{"a": 1}', "tests/one/b.yaml": "a: 2", "tests/one/c.toml": 'a = "x"', "tests/two/d.json": "{}"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    store = layouts.schema_store(spark, str(tmp_path))
    assert store["json_schemas"].count() == 1 and store["chunks"].count() == 3 and store["schema_conversions"].count() == 1


def test_ngram_source(spark, tmp_path):
    block = '```json\n{"text": "' + "word " * 30 + '"}\n```'
    (tmp_path / "shard-0.jsonl").write_text("\n".join(json.dumps({"doc_id": f"d{i}", "spans": ["about cats", block if i % 2 else "none"]}) for i in range(4)))
    (tmp_path / "shard-1.jsonl").write_text(json.dumps({"doc_id": "d1", "spans": ["cats too", block], "meta": {"u": 1}}))
    spark.dataSource.register(ngrams.NgramSource)
    hits = spark.read.format("ngrams").option("folder", str(tmp_path)).option("query", "cats").load()
    assert hits.count() == 5 and {r.doc_id for r in ngrams.fenced_chunks(hits).collect()} == {"d1", "d3"}
    assert spark.read.format("ngrams").option("folder", str(tmp_path)).option("query", "dogs").load().count() == 0
    flaky = spark.read.format("ngrams").option("client", "tests.flaky_index:client").option("query", "x").load()
    assert sorted((r.shard, r["rank"], r.doc_id) for r in flaky.collect()) == [(s, k, f"{s}-{k}") for s in (0, 1) for k in range(5)]
    waits, calls = [], iter([ngrams.RateLimited(7), OSError(), "ok"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert ngrams.with_retries(call, sleep=waits.append) == "ok" and waits[0] == 7 and 2 <= waits[1] <= 4


def test_streamed_documents_are_kept_once(spark, tmp_path):
    schema = "content string, arrived timestamp"
    for k in range(3):
        spark.sql(f"SELECT * FROM VALUES ('A b', TIMESTAMP'2024-01-01'), (' a B', TIMESTAMP'2024-01-01 01:00:00'), ('new {k}', TIMESTAMP'2024-01-01') t(content, arrived)").write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = ingest.without_copies(ingest.read_stream(spark, str(tmp_path / "in"), schema, 1))
        ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = [r.content.strip().lower() for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == ["a b", "new 0", "new 1", "new 2"]


def test_costly_passes_are_spread_over_the_session_s_parts(spark, tmp_path):
    """A file of one row group isn't one task."""
    from weftline.plans import catalogue
    from weftline.sources import layouts

    sf = "/root/testdata/sf0.001"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    for name in ("format_yaml", "format_toml", "diff_metrics", "tabular"):
        assert parts(catalogue.QUERIES[name](spark, sf)) == n
    rows = spark.range(200).select(F.lit('{"type": "object", "properties": {"k": {"type": "integer"}}}').alias("schema"), F.format_string('{"k": %d}', "id").alias("response")).coalesce(1)
    chunks = layouts.schema_and_answer(rows, "x")["chunks"]
    assert chunks.select(F.input_file_name().alias("f")).distinct().count() == n


def test_token_ids_are_packed_and_handed_on_in_lots(spark, monkeypatch):
    from weftline.operators import training

    texts = [None, "", "é" * 7, "x" * 50, *("ab\U0001f600" for _ in range(30))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").coalesce(1)
    monkeypatch.setattr(training, "LOT", 10)
    got = {r.id: r.ids for r in df.select("id", training.tokens("t", lambda s: [ord(c) for c in s]).alias("ids")).collect()}
    assert got == {i: None if t is None else [ord(c) for c in t] for i, t in enumerate(texts)}


def test_pairs_of_query_and_document_are_spread(spark):
    """Postings are put together by document in as many tasks as the session's shuffles have, however few they are."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = spark.range(300).select("id", F.format_string("word%d rare%d common", F.col("id") % 7, "id").alias("content"))
    queries = spark.createDataFrame([(1, "common word3")], "query_id int, query string")
    got = retrieval.scores(docs, queries)
    assert got.count() == 300 and got.select(F.spark_partition_id().alias("p")).distinct().count() == n


def test_parts_are_sampled_in_the_session_s_parts(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(200).select(F.concat(F.lit("o"), "id").alias("id"), F.format_string('{"a": {"b": [%d, 1, 2, 3, 4, 5, 6, 7]}}', "id").alias("content"))
    plan = generation.sub_documents(rows, source="documents", least=10)._jdf.queryExecution().toString()
    assert "hashpartitioning(parent" in plan and f", {n}), REPARTITION_BY_NUM" in plan
