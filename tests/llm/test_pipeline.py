"""The pipeline's stages against plain versions of what they decide."""

import hashlib
import math
import re

import corpus_pipeline
from tests.llm.test_operators import plain_components, plain_hits, plain_leaf, targets
from weftline.llm import sharding

SF = "/root/testdata/sf0.001"


def plain_mix(rows):
    """(doc_id, text) for every time that a document is taken: each source's documents in the order of a digest, once and
    again up to the source's target, the last one cut after as many words as are left."""
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    out = []
    for source, target in targets(sizes).items():
        own = sorted((hashlib.md5(f"{r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest()}:mix".encode()).hexdigest(), r.doc_id, r.text) for r in rows if r.source == source)
        room = math.floor(target)
        for turn in range(2):
            for _, doc, text in own:
                n = len(text.split())
                take = min(n, room)
                if take or not n and not turn:
                    out.append((doc, text if take == n else re.match(rf"(\s*\S+){{{take}}}", text)[0]))
                room -= take
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    one = steps["language"](spark, docs, SF)
    assert one.columns == columns and one.count() == len(rows)  # all are prose in known languages
    two = steps["near_duplicates"](spark, one, SF)
    label = plain_components(list(rows.items()))
    kept = {r.doc_id for r in two.collect()}
    assert two.columns == columns and kept == {d for d, c in label.items() if d == c}
    three = steps["decontamination"](spark, two, SF)
    clean = {d for d in kept if not plain_hits(rows[d], items)[1]}
    assert three.columns == columns and {r.doc_id for r in three.collect()} == clean
    four = steps["mixing"](spark, three, SF)
    mixed = four.collect()
    assert four.columns == columns and sorted((r.doc_id, r.text) for r in mixed) == sorted(plain_mix(three.collect()))
    assert all(r.n_chars == len(r.text) for r in mixed)
    five = steps["sharding"](spark, four, SF).collect()
    one, more = sharding.tree(24), sharding.tree(25, base=24)
    assert sorted((r.doc_id, r.text, r.shard, r.grown_shard) for r in five) == sorted((r.doc_id, r.text, plain_leaf(r.doc_id, one), plain_leaf(r.doc_id, more)) for r in mixed)
    for shard in {r.shard for r in five}:
        own = sorted((r.slot, hashlib.md5(f"{r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest()}:slot".encode()).hexdigest()) for r in five if r.shard == shard)
        assert [x for x, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and all(0 <= r.shard < 24 for r in got)
    for shard in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))


def test_stages_take_odd_tables(spark):
    """Nulls, empty texts, repeated rows, columns with clashing names, and no rows at all."""
    from tests.llm.test_operators import odd

    for docs in (odd(spark), odd(spark).where("false")):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, docs, SF)
            assert k == 4 or got.columns == columns
            assert len(set(got.columns)) == len(got.columns) and got.count() <= 2 * docs.count()
