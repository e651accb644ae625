"""Every registered query against its SQL in DuckDB, and what queries without SQL promise."""

import hashlib
import json

import pytest

from tests.compare import check, tables
from weftline.functions import tabular, variation
from weftline.functions.json_schema import check as wrong
from weftline.operators import sampling
from weftline.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    check(spark, con, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)


def test_expansion_shuffles_numbers_for_keys(spark):
    """Orders and parts are joined by merging, not broadcast while they are small, and no text is made of their keys."""
    plan = catalogue.QUERIES["expand_conversions"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "concat(" not in plan


def test_varied_documents_fit_their_schemas(spark):
    got = catalogue.QUERIES["vary_schema"](spark, SF).collect()
    assert got and all(wrong(r.data, r.schema) is None for r in got)
    assert any(json.loads(r.changes)["dropped"] for r in got) and any(json.loads(r.changes)["added"] for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, catalogue.QUERIES["vary_schema"](spark, SF).repartition(3).collect()))


def test_synthetic_tables_fit_their_schemas(spark):
    got = catalogue.QUERIES["tabular"](spark, SF).collect()
    assert len(got) > 1000 and all(wrong(r.output, r.schema) is None for r in got)
    assert len({r.content_type for r in got}) == 10


def draw(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_tables_equal_the_plain_generator(spark):
    got = {r.key: (r.input_data, r.content_type, r.schema, r.output) for r in catalogue.QUERIES["tabular"](spark, SF).collect()}
    keys = [r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()]
    want = {k: tabular.triplet(draw(f"{k}:0")) for k in keys}
    assert got == {k: (t["input_data"], t["content_type"], t["schema"], t["output"]) for k, t in want.items() if t}


def test_variations_equal_the_plain_ones(spark):
    got = {(r.chunk_id, r.number): (r.schema_id, json.loads(r.schema), json.loads(r.data)) for r in catalogue.QUERIES["vary_schema"](spark, SF).collect()}
    want = {}
    for r in catalogue._json_chunks(spark, SF).collect():
        for k in range(2):
            try:
                schema, data, _ = variation.vary(json.loads(catalogue.ORDER_SCHEMA), json.loads(r.content), draw(f"{r.id}:{k}:0"))
            except (ValueError, TypeError, KeyError, AttributeError):
                continue
            want[r.id, k] = ("order", json.loads(json.dumps(schema)), json.loads(json.dumps(data)))
    assert got == want


def test_augmented_samples_equal_the_plain_steps(spark):
    """Row by row, in order: another schema that the output doesn't fit, no schema, presentation, a varied schema."""
    rows = catalogue._samples(spark, SF).selectExpr("*", "pmod(xxhash64(input_data, schema, 0), 1L << 40) seed").collect()
    own = {}
    for r in rows:
        own[r.meta.schema_id] = min(own.get(r.meta.schema_id, r.schema), r.schema)
    order = sorted(own, key=lambda s: (hashlib.sha256(f"{s}:negative".encode()).hexdigest(), s))
    want = []
    for r in rows:
        steps = [(variation.step_drop_schema, 0.1), (variation.step_present, 0.5), (variation.step_vary, 0.1)]
        if r.seed % 1000 < 100:
            near = [own[order[((r.seed >> 10) + t * 7919) % len(order)]] for t in range(2)]
            steps.insert(0, (variation.step_negative(near, in_order=True), 1.0))
        new = variation.augmented({"input_data": r.input_data, "schema": r.schema, "output": r.output}, r.seed, steps)
        want.append((new["input_data"], new["schema"], new["output"], r.input_data, r.schema, r.output))
    got = catalogue.QUERIES["augment"](spark, SF).collect()
    assert sorted((r.input_data, r.schema, r.output, r.original_input, r.original_schema, r.original_output) for r in got) == sorted(want)


def test_augmented_samples_keep_their_originals(spark):
    got = catalogue.QUERIES["augment"](spark, SF).collect()
    assert any(r.schema == "[MISSING]" for r in got) and any(r.input_data != r.original_input for r in got)
    assert all(json.loads(r.input_data) == json.loads(r.original_input) for r in got)


def test_augmented_samples_have_negatives(spark):
    got = catalogue.QUERIES["augment"](spark, SF).collect()
    own = {r.original_schema for r in got}
    negative = [r for r in got if r.schema in own and r.schema != r.original_schema]
    assert len(own) > 1 and 0.04 < len(negative) / len(got) < 0.12  # chance 0.1, less what later steps change again
    assert all(r.output == "{}" and wrong(r.original_output, r.schema) is not None for r in negative)
    again = sampling.augmented(catalogue._samples(spark, SF).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    none = sampling.augmented(catalogue._samples(spark, SF), others=[]).collect()
    assert not [r for r in none if r.schema in own and r.schema != r.original_schema]


def test_whole_texts_are_tokenised(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    width, want = {}, {}
    for r in rows:
        width[r.conv_id] = max(width.get(r.conv_id, 0), -(-(len(r.role) + len(r.text) + 2) // 8) * 8)
    for r in rows:
        t, n = [ord(c) for c in r.text], len(r.role) + len(r.text) + 2
        rest = width[r.conv_id] - n
        parts = ([1, *map(ord, r.role), *t, 2] + [0] * rest, [-100] * (len(r.role) + 1) + t + [2] + [-100] * rest, [1] * n + [0] * rest)
        want[r.conv_id, r.turn] = tuple(",".join(map(str, x)) for x in parts)
    got = catalogue.QUERIES["tokenise_mask_pad"](spark, SF).collect()
    assert len(got) == len(rows) == len(want) and max(len(r.text) for r in rows) > 5
    assert {(r.conv_id, r.turn): (r.input_ids, r.labels, r.attention_mask) for r in got} == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_groups_hold_whichever_customers_have_orders(spark, tmp_path):
    """Neither customers at the seam of two records nor customers that lie in no table part a group."""
    import pandas as pd

    orders = [(k, c, "F") for k, c in enumerate([0, 1, 3, 6, 7, 9, 9, 12, 13, 17, 18, 31, 44, 45, 53, 58])]
    pd.DataFrame(orders, columns=["o_orderkey", "o_custkey", "o_orderstatus"]).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame({"c_custkey": [k for k in range(40) if k not in (5, 12, 17)]}).to_parquet(tmp_path / "customer.parquet")
    check(spark, tables(tmp_path), catalogue.QUERIES["assign_groups"], catalogue.ORACLES["assign_groups"], tmp_path)
