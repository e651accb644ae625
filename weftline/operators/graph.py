"""Lineage roots, signatures, connected components, group ranks and the leakage-free split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftline.operators.udfs import sorted_digest
from weftline.storage import discard, materialise


def roots(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """(node, root): the end of each row's chain of parents; an absent parent row is itself the root. Pointers are
    doubled each round, so depth d takes log2(d) joins. Rows on a cycle, or that lead to one, get the least node met."""
    p = nodes.select(F.col(node).alias("node"), F.coalesce(F.col(parent), F.col(node)).alias("up"))
    p = materialise(p.where("node is not null").dropDuplicates(["node"]).withColumn("low", F.least("node", "up")), "roots")
    before = -1
    while True:
        hop = p.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("low").alias("far_low"))
        step = p.select("node", "up", "low").join(hop, "up", "left").select("node", F.coalesce("far", "up").alias("up"), F.least("low", F.coalesce("far_low", "low")).alias("low"), F.col("up").alias("old"), F.col("low").alias("old_low"))
        seen = Observation()  # counted while the round is written
        step = step.observe(seen, F.count_if(F.col("up") != F.col("old")).alias("moved"), F.count_if(F.col("low") < F.col("old_low")).alias("lower"))
        old, p = p, materialise(step, "roots")
        moved, lower = seen.get["moved"], seen.get["lower"]
        discard(old)
        # As chains have nodes at every depth, some come to rest in each round while any chain moves. If as many move
        # as before, and none has met a lesser node, all that move go round on cycles.
        if not moved or moved == before and not lower:
            return p.select("node", F.when(F.col("up") == F.col("old"), F.col("up")).otherwise(F.col("low")).alias("root"))
        before = moved


def content_signature(text: Column | str) -> Column:
    """Digest of the text's sorted lower-case characters, so order doesn't matter."""
    return sorted_digest(F.lower(F.col(text) if isinstance(text, str) else text))


def dataset_signature(*metas: tuple[Column, Column]) -> Column:
    """source:index of the first (source, meta) whose meta has a source_dataset_index."""
    index = lambda m: F.get_json_object(m, "$.source_dataset_index")
    return F.coalesce(*[F.concat(s, F.lit(":"), index(m)) for s, m in metas])


def signatures(conversions: DataFrame, chunks: DataFrame, schemas: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, signature): what makes conversions belong together. Chains of parents, contents, and datasets."""
    chunk_root = roots(chunks, "id", "parent_chunk_id")
    schema_root = roots(schemas, "id", "parent_schema_id")
    d = documents.select(F.col("id").alias("doc"), F.col("source").alias("doc_source"), F.col("meta").alias("doc_meta"))
    c = chunks.join(chunk_root.select(F.col("node").alias("id"), "root"), "id", "left").join(d, chunks["parent_document_id"] == d["doc"], "left")
    side = lambda k: c.select(F.col("id").alias(f"{k}_chunk_id"), content_signature("content").alias(f"{k}_content"), F.col("root").alias(f"{k}_root"), F.col("doc_source").alias(f"{k}_source"), F.col("doc_meta").alias(f"{k}_meta"))
    s = schemas.join(schema_root.select(F.col("node").alias("id"), F.col("root").alias("schema_root")), "id", "left").select(F.col("id").alias("schema_id"), content_signature("content").alias("schema_content"), "schema_root", F.col("meta").alias("schema_meta"))
    rows = conversions.select("id", "input_chunk_id", "output_chunk_id", "schema_id").join(side("input"), "input_chunk_id", "left").join(side("output"), "output_chunk_id", "left").join(s, "schema_id", "left")
    data = dataset_signature((F.col("input_source"), F.col("input_meta")), (F.col("output_source"), F.col("output_meta")), (F.get_json_object("schema_meta", "$.source_dataset_name"), F.col("schema_meta")))
    tag = lambda t, x: F.when(x.isNotNull(), F.concat(F.lit(t + ":"), x))
    all_ = F.array_compact(F.array(tag("parent_chunk", F.col("input_root")), tag("parent_chunk", F.col("output_root")), tag("input", F.col("input_content")), tag("output", F.col("output_content")), tag("schema", F.col("schema_content")), tag("parent_schema", F.col("schema_root")), tag("dataset", data)))
    return rows.select("id", F.explode(F.array_distinct(all_)).alias("signature"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of the edges (a, b) reaches.

    Alternating star contraction. With each edge from its larger to its smaller end, the large-star step hangs the
    larger neighbours of every node below its least neighbour, and the small-star step hangs a node's smaller
    neighbours, and the node, below the least of them. Both keep components and end in one star a component, in a
    number of rounds that grows with the square of the logarithm of the nodes at most; stars of a least node, as
    they come from groups, are recognised in the first round. Each step is written to the shared folder and the one
    before is removed. The least neighbours are pre-aggregated and the other side of each join is a plain scan, so
    AQE can split a hot node; there is one way for all sizes. Edges with a null are left out."""
    pairs = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialise(pairs, "edges")
    now, old = pairs.where("u > v"), []
    while True:
        near = now.select(F.col("v").alias("x"), "v").union(now.select("u", "v")).groupBy("x").agg(F.min("v").alias("m"))
        hung, spare = Observation(), Observation()  # counted while the steps are written
        large = now.join(near.select(F.col("x").alias("v"), "m"), "v").observe(hung, F.count_if(F.col("m") < F.col("v")).alias("n"))
        large = materialise(large.select("u", F.col("m").alias("v")), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").observe(spare, F.count_if(F.col("v") > F.col("m")).alias("n"))
        rest = rest.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialise(rest.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(large, *old)
        now, old = small, [small]
        if not hung.get.get("n") and not spare.get.get("n"):
            break
    roots_ = now.select("v", "v").union(pairs.where("u = v"))  # a node may have an edge to itself alone
    return now.union(roots_).toDF("node", "label").groupBy("node").agg(F.min("label").alias("label"))


def signature_components(edges: DataFrame, node: str = "id", signature: str = "signature") -> DataFrame:
    """(node, component): nodes that share signatures, directly or through others; the least node names a component.
    Every node is linked to the least node of each signature, a star and not all pairs."""
    e = materialise(edges.select(F.col(node).alias("node"), F.col(signature).alias("s")), "signatures")
    heads = materialise(e.where("s is not null").groupBy("s").agg(F.min("node").alias("head")), "heads")
    star = e.join(heads, "s").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    label = components(materialise(star, "star"))
    return e.select("node").distinct().join(label, "node", "left").select("node", F.coalesce("label", "node").alias("component"))


def rank_groups(members: DataFrame, component: str = "component", node: str = "node") -> DataFrame:
    """(component, size, group_id): 0 is the largest; ties go by the first member. Numbers come from a range sort and
    the counts of its parts, not from one task."""
    from weftline.operators.numbering import numbered

    sizes = members.groupBy(component).agg(F.count("*").alias("size"), F.min(node).alias("first"))
    return numbered(sizes, [F.col("size").desc(), F.col("first")], "group_id").select(component, "size", "group_id")


def assign_groups(conversions: DataFrame, chunks: DataFrame, schemas: DataFrame, documents: DataFrame) -> DataFrame:
    """Conversions with group_id and meta.group."""
    member = signature_components(signatures(conversions, chunks, schemas, documents))
    ranks = rank_groups(member)
    group = member.join(ranks, "component").select(F.col("node").alias("id"), F.col("group_id").alias("__group"))
    out = conversions.join(group, "id", "left")
    fresh = F.from_json("meta", "map<string,string>")
    clean = F.map_filter(F.coalesce(fresh, F.create_map().cast("map<string,string>")), lambda k, v: k != "group")
    told = F.to_json(F.map_concat(clean, F.create_map(F.lit("group"), F.col("__group").cast("string"))))
    return out.withColumn("group_id", F.col("__group").cast("long")).withColumn("meta", F.when(F.col("__group").isNotNull(), told).otherwise(F.col("meta"))).select(*conversions.columns)


def split_groups(members: DataFrame, test_size: int, seed: str = "split", exclude_top: int = 2, group: str = "group_id") -> DataFrame:
    """(group_id, size, is_test): whole groups for a test set of at most test_size rows, none of the exclude_top
    largest. Groups come in the order of a digest; one larger than what is still wanted is passed over, and half of the
    others, by the digest, are too. Only candidate group sizes are folded in order: those up to test_size, and as many
    as can matter, since each taken group has a row at least. Needs 0 < test_size < rows."""
    sizes = members.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group_id")).agg(F.count("*").alias("size"))
    sizes = materialise(sizes, "sizes")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not 0 < test_size < total:
        raise ValueError(f"test_size must lie between 0 and {total}")
    digest = F.sha2(F.concat_ws(":", "group_id", F.lit(seed)), 256)
    top = sizes.orderBy(F.col("size").desc(), "group_id").limit(exclude_top).select("group_id")
    fit = sizes.join(F.broadcast(top), "group_id", "left_anti").where(F.col("size") <= test_size).withColumn("digest", digest)
    coin = fit.where(F.substring("digest", 64, 1).isin(*"02468ace"))
    coin = materialise(coin, "candidates")
    taken, left, last = [], test_size, ("", None)
    while left:
        # The next thousand that still fit. Each taken group has a row at least, so the rounds are bounded by test_size.
        after = coin.where(F.col("size") <= left)
        if last[1] is not None:
            after = after.where((F.col("digest") > last[0]) | ((F.col("digest") == last[0]) & (F.col("group_id") > F.lit(last[1]))))
        batch = after.orderBy("digest", "group_id").limit(1000).select("group_id", "size", "digest").collect()
        if not batch:
            break
        for r in batch:
            if r["size"] <= left:
                taken.append(r["group_id"])
                left -= r["size"]
        last = (batch[-1]["digest"], batch[-1]["group_id"])
    chosen = sizes.sparkSession.createDataFrame([(g,) for g in taken], "group_id " + sizes.schema["group_id"].dataType.simpleString())
    return sizes.join(chosen.withColumn("is_test", F.lit(True)), "group_id", "left").select("group_id", "size", F.coalesce("is_test", F.lit(False)).alias("is_test"))


def test_rows(n: int) -> int:
    """Rows to hold out of n: a twentieth of small sets, at least one; 5000 of larger ones."""
    return max(1, n // 20) if n <= 5000 else min(5000, n // 20)
