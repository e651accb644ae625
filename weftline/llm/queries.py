"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontam, langid, mixing, neardup, quality, secrets, sharding, token_counts, toxicity, warc

#: File of the tokenizer in the folder of public vocabularies; another path may be given.
TOKENIZER = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizer_path())
    return told.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"), carry=("doc_id",))
    place = lambda k: F.try_element_at("copies", F.lit(k))["position"].alias(f"position_{k}")
    told = mixed.select("row.doc_id", "size", "source_size", "target", "taken", place(1), place(2))
    return told.orderBy(F.col("position_1").asc_nulls_last(), "doc_id")  # the range sort by training position


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages")).drop("url")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.secret_spans(_read(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("items")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"), carry=("doc_id",)).select("row.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(_read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_source_mixing, op3_warc_round_trip, op4_secret_scan, op5_language_id, op6_decontamination, op7_sharding, op8_toxicity, op9_near_dedup, op10_quality_rules, pipeline)}

_WORDS = r"[^\x20\x09-\x0D]+"


def _crc_table() -> list[int]:
    """The table of CRC-32, for SQL engines without the function."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


_TREES = [(grown, sharding.levels(sharding.tree(24 + grown, base=24))) for grown in (0, 1)]
#: (grown, level, node, path, weight, number) of the trees of 24 shards and one more.
_NODES = ", ".join(f"({g}, {k}, {node}, '{path}', {weight!r}::DOUBLE, {number})" for g, levels in _TREES for k, level in enumerate(levels) for node, children in enumerate(level) for path, weight, number in children)


def _step(level: int) -> str:
    """The descent of one level in SQL: the number of the child with the least draw."""
    return f"""s{level + 1} AS (SELECT r, grown, arg_min(number, -ln((('0x' || substr(md5(key || ':' || path), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE) / weight) AS node
  FROM s{level} JOIN d USING (r) JOIN nodes USING (grown, node) WHERE level = {level} GROUP BY r, grown)"""


ORACLES: dict[str, str] = {
    # Sizes, ranks and water levels; the level that holds is the first under which no other source is above its cap.
    "op2_source_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS size,
         md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')), 'mix')) AS digest
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS total, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS rank
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + rank % 3] AS weight, 2 * total AS cap FROM s),
k AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS n,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
             sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest
      FROM w),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(total) FROM w)::DOUBLE - capped) / rest AS level FROM k),
level AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY n LIMIT 1),
t AS (SELECT source, rank, total, CASE WHEN weight * level.level > cap THEN cap::DOUBLE ELSE weight * level.level END AS target FROM w, level),
p AS (
  SELECT d.doc_id, d.size, t.rank, t.total, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - start)) AS first, greatest(0, least(size, floor(target)::BIGINT - start - total)) AS second,
         start / target AS u1, (start + total) / target AS u2, [0.5, 1.0, 1.5][1 + rank % 3]::DOUBLE AS m, [1.0, 0.0, -1.0][1 + rank % 3]::DOUBLE AS slope
  FROM p)
SELECT doc_id, size, total AS source_size, target, (first + second)::BIGINT AS taken,
       CASE WHEN first > 0 OR size = 0 AND start <= target THEN CASE WHEN u1 <= 0 THEN 0.0 ELSE 2.0 * u1 / (m + sqrt(m * m + 2.0 * slope * u1)) END END AS position_1,
       CASE WHEN second > 0 THEN CASE WHEN u2 <= 0 THEN 0.0 ELSE 2.0 * u2 / (m + sqrt(m * m + 2.0 * slope * u2)) END END AS position_2
FROM c""",
    "op3_warc_round_trip": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f""",
    "op6_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM g, unnest(range(1, len(w) - k + 2)) AS x(i)),
ks AS (SELECT DISTINCT k FROM pat),
win AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM d, ks, unnest(range(1, len(w) - k + 2)) AS x(i) WHERE len(w) >= k),
occ AS (SELECT DISTINCT r, i, win.k, item_id FROM win JOIN pat ON win.win = pat.win AND win.k = pat.k),
hit AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT DISTINCT r, i, k FROM occ) o, unnest(range(i, i + k)) AS x(j) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)""",
    "op7_sharding": f"""
WITH c AS (SELECT {_crc_table()}::BIGINT[] AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, (strlen(coalesce(text, '')) + 8)::BIGINT AS size,
             md5(coalesce(text, '')) AS digest, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
x AS (SELECT r, doc_id, key, size, digest, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM d, c),
nodes(grown, level, node, path, weight, number) AS (VALUES {_NODES}),
s0 AS (SELECT r, grown, 0 AS node FROM d, (VALUES (0), (1)) g(grown)),
{_step(0)},
{_step(1)},
{_step(2)},
p AS (SELECT r, max(node) FILTER (grown = 0) AS shard, max(node) FILTER (grown = 1) AS grown_shard FROM s3 GROUP BY r)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY md5(key || ':' || digest || ':slot'), doc_id NULLS FIRST, size, crc) - 1)::BIGINT AS slot, grown_shard
FROM x JOIN p USING (r)""",
    # Exact links by shared shingles; components by a recursive walk, as the groups here are small.
    "op9_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM d, unnest(range(1, greatest(len(w), 2))) AS x(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk AS (SELECT doc_id AS start, doc_id AS node FROM n UNION SELECT start, b FROM walk JOIN u ON a = node),
c AS (SELECT start, min(node) AS low FROM walk GROUP BY start)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, d.doc_id = coalesce(c.low, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.start = d.doc_id""",
}
