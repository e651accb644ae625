"""Near-duplicate removal with SetSketch registers (operator 9).

1. Each document's distinct 2-word shingles fill the registers of a SetSketch: register i keeps the least of
   exponential hash values, truncated to a power of `base`. Registers are mergeable by maximum, and two registers are
   equal with a probability near the Jaccard similarity. Points come from one Poisson process per shingle, in
   ascending order and cut off where no register can change, so filling them takes about n + m log m steps.
2. A node is an id with a text. Nodes with equal keys of their shingle sets form a class; only its first node goes on.
3. Runs of `rows` registers are band keys. In each band bucket every member is paired with the least member (a star,
   linear in the bucket); a pair goes on if the maximum likelihood estimate of its similarity from the registers and
   set sizes is within five standard errors of the threshold. These pairs, and each member of a class with its first
   node, are confirmed on the full shingle sets.
4. Confirmed links give components. Buckets that still hold several components are compared across components only,
   in blocks of at most 2 x block rows, through the registers, each pair in the first band that it shares; what passes
   is confirmed alike. So every pair of different sets that shares a band and isn't yet connected is decided once,
   and no group's pairs are all emitted.
5. Components of all links; a document is kept if it has the least doc_id of its component.

With the default 48 bands of 5 registers a pair at the threshold of 0.75 shares no band with probability 2e-6.

Every step is the same at every size. The texts of nodes that are in a pair are joined once, by id and digest of the
text, and written; registers are shuffled once to leave out copies, and where pairs are estimated.

Cases: ids are of any type that can be ordered. Null or empty texts have no shingles and are linked with nothing; one
word is one shingle; very long texts are taken whole. Rows that repeat a doc_id are one document, and the links of each
of their texts count; a null doc_id is in no component: component_id is null and the row is kept. Ties can't arise, as
ids are ordered and equal ids are one document. No rows give no rows. Only the id and text columns are read, so names
of others can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_map, materialise, slices, split_words
from weftline.operators.graph import components
from weftline.storage import discard

BASE, RATE, LIMIT = 1.001, 20.0, 65_534
BANDS, ROWS = 48, 5
#: Members of sets whose points are drawn at once; a matter of memory only, as registers are minima.
AT_ONCE = 1 << 14
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct 2-word shingles of all texts one after another, and where each text's begin."""
    codes, starts, vocab = split_words(texts, lower=True)
    codes = codes.astype(np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocab.cast(pa.binary()).to_pylist()), np.uint64, len(vocab))
    size = len(vocab) + 1
    pairs = codes[:-1] * size + codes[1:] if len(codes) else codes
    sets = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        sets.append(np.unique(pairs[a : b - 1]) if b - a > 1 else codes[a:b] * size + size - 1)
    ends = np.cumsum([0, *map(len, sets)])
    flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
    second = np.concatenate([hashes, np.array([0x5851F42D4C957F2D], np.uint64)])[flat % size]
    return mix64(mix64(hashes[flat // size] + _GOLD) * np.uint64(3) + second), ends


def set_keys(flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """128-bit keys of the sets, whatever the order of their members."""
    out = []
    for salt in (1, 2):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(flat + np.uint64(salt * int(_GOLD) % 2**64)), dtype=np.uint64)])
        out.append(sums[ends[1:]] - sums[ends[:-1]])
    return [a.tobytes() + b.tobytes() for a, b in zip(*out)]


def _fill(least: np.ndarray, state: np.ndarray, owner: np.ndarray, until: np.ndarray) -> None:
    """Lower the registers `least` of the sets `owner` by the points of their members `state` up to the times `until`."""
    m, reached, count, width = least.shape[1], np.zeros(len(state)), 0, 4
    while len(state):
        steps = mix64(state[:, None] + _GOLD * np.arange(count + 1, count + width + 1, dtype=np.uint64))
        u = ((steps >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        times = reached[:, None] + np.cumsum(-np.log(u), axis=1) / (RATE * m)
        inside = times <= until[owner][:, None]
        place = (mix64(steps + _GOLD) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        flat_at = (owner[:, None] * m + place.astype(np.int64))[inside]
        np.minimum.at(least.reshape(-1), flat_at, times[inside])
        more = inside[:, -1]
        state, owner, reached, count = state[more], owner[more], times[more, -1], count + width
        width = min(64, width * 2)


def registers(flat: np.ndarray, ends: np.ndarray, m: int) -> np.ndarray:
    """Registers of each set, one row a set, as uint16; a set without members has zeros."""
    n = np.diff(ends)
    least = np.full((len(n), m), np.inf)
    todo = np.flatnonzero(n)
    until = np.zeros(len(n))
    until[todo] = (math.log(m) + 4) / (RATE * n[todo])
    while len(todo):
        owner = np.repeat(todo, n[todo])
        index = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in todo.tolist()])
        for at in range(0, len(index), AT_ONCE):
            _fill(least, flat[index[at : at + AT_ONCE]], owner[at : at + AT_ONCE], until)
        todo = todo[np.isinf(least[todo]).any(1)]
        until[todo] *= 2
    out = np.zeros((len(n), m), np.uint16)
    some = n > 0
    out[some] = np.clip(np.floor(1 - np.log(least[some]) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the Jaccard similarity from how many registers are larger, smaller and equal, given the
    set sizes, and its standard error. By bisection of the likelihood's slope, which falls."""
    m = a.shape[1]
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = m - up - down
    u = na / (na + nb)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    scale = (BASE - 1) / BASE
    log_base = math.log(BASE)

    def parts(j: np.ndarray) -> tuple[np.ndarray, ...]:
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        p, q = -np.log1p(-x * scale) / log_base, -np.log1p(-y * scale) / log_base
        dp, dq = -v * scale / (1 - x * scale) / log_base, -u * scale / (1 - y * scale) / log_base
        return p, q, dp, dq

    low, high = np.zeros(len(u)), top.copy()
    for _ in range(24):
        j = (low + high) / 2
        p, q, dp, dq = parts(j)
        slope = up * dp / p + down * dq / q - same * (dp + dq) / np.maximum(1 - p - q, 1e-12)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    j = (low + high) / 2
    p, q, dp, dq = parts(np.clip(j, 0.01, 0.99 * top))
    info = m * (dp**2 / p + dq**2 / q + (dp + dq) ** 2 / np.maximum(1 - p - q, 1e-9))
    return j, 1 / np.sqrt(np.maximum(info, 1e-9))


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose sizes allow the threshold and whose estimate is within five standard errors of it."""
    fit = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
    j, error = estimate(a, b, na, nb)
    # The error at the threshold itself, or at the estimate, whichever is larger.
    wide = np.maximum(error, math.sqrt(threshold * (1 - threshold) / a.shape[1]))
    return fit & (j + 5 * wide >= threshold)


def _digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _id_key(column: str) -> Column:
    """A text for every id, and another for null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def sketch(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", m: int = BANDS * ROWS) -> DataFrame:
    """Per row: doc_id, digest (of the text), n_shingles, set_key, registers (uint16, little endian)."""
    cols = docs.select(F.col(id_col).alias("doc_id"), _digest(text_col).alias("digest"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                flat, ends = shingle_sets(part.column("text"))
                regs = registers(flat, ends, m)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(np.diff(ends), pa.int64()), pa.array(set_keys(flat, ends), pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "digest", "n_shingles", "set_key", "registers"])

    return arrow_map(cols, run, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, digest binary, n_shingles bigint, set_key binary, registers binary")


def _registers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def _passing(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that may be linked by their registers."""
    side = lambda c: sketches.select(F.col("uid").alias(c), F.col("n_shingles").alias("n" + c), F.col("registers").alias("r" + c))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                yield x.loc[may_link(_registers(x["ra"]), _registers(x["rb"]), x["na"].to_numpy(float), x["nb"].to_numpy(float), threshold), ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a bigint, b bigint")


def _texts(docs: DataFrame, nodes: DataFrame, uids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, text) of the nodes in uids, written. Equal rows are combined before the shuffle."""
    rows = docs.select(_id_key(id_col).alias("id"), _digest(text_col).alias("digest"), F.col(text_col).alias("text")).dropDuplicates(["id", "digest"])
    wanted = nodes.join(uids, "uid", "left_semi").select("uid", _id_key("doc_id").alias("id"), "digest")
    return materialise(rows.join(wanted, ["id", "digest"]).select("uid", "text"), "texts")


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, copy) whose full shingle sets reach the threshold, or are equal where copy is true."""
    side = lambda c: texts.select(F.col("uid").alias(c), F.col("text").alias("t" + c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, frozenset()
        for batch in batches:
            keep = []
            for ta, tb, copy in zip(batch.column("ta"), batch.column("tb"), batch.column("copy").to_pylist()):
                text, other = ta.as_py(), tb.as_py()
                if text == other:
                    keep.append(True)
                    continue
                if text != last:
                    last, seen = text, shingles(text)
                more = shingles(other)
                same = len(seen & more)
                keep.append(100 * same >= (100 if copy else percent) * (len(seen) + len(more) - same))
            yield batch.select(["a", "b", "copy"]).filter(pa.array(keep, pa.bool_()))

    return arrow_map(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "copy", "ta", "tb"), run, "a bigint, b bigint, copy boolean")


def shingles(text: str | None) -> frozenset:
    """The set of a text, plainly: words of A-Z folded text between blanks, in twos."""
    words = (text or "").encode().lower().split()
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([tuple(words)] if words else [])


def _linked(docs: DataFrame, id_col: str, text_col: str, percent: int, bands: int, rows: int, block: int, null_ids: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, digest, n_shingles; nodes: uid, doc_id, digest, n rows; edges a, b between uids), all written."""
    sketches = materialise(sketch(docs, id_col=id_col, text_col=text_col, m=bands * rows).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    real = sketches.where("n_shingles > 0" if null_ids else "n_shingles > 0 and doc_id is not null")
    nodes = materialise(real.groupBy("doc_id", "digest", "set_key").agg(F.min("uid").alias("uid"), F.count("*").alias("n")), "nodes")
    classes = nodes.groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "digest", "uid")).alias("rep"), F.count("*").alias("m")).where("m > 1")
    classes = materialise(classes.select("set_key", F.col("rep.uid").alias("a")), "classes")
    copies = materialise(nodes.join(classes, "set_key").where("uid != a").select("a", F.col("uid").alias("b")), "copies")
    while True:
        links, reps, held, passed, texts = _stars(docs, sketches, nodes, copies, id_col, text_col, percent, bands, rows)
        refuted = copies.join(links.where("copy"), ["a", "b"], "left_anti")
        if not refuted.head(1):
            break
        # Another set with the same key: no copy, so it takes part in the search as a node of its own.
        fewer = materialise(copies.join(refuted, ["a", "b"], "left_anti"), "copies")
        discard(links, reps, held, passed, texts, copies)
        copies = fewer
    more = _across(reps, held, passed, components(links), percent / 100, bands, rows, block)
    more = materialise(_confirm(more.withColumn("copy", F.lit(False)), texts, percent), "more-links")
    edges = materialise(links.select("a", "b").union(more.select("a", "b")), "links")
    told = materialise(sketches.select("doc_id", "digest", "n_shingles"), "rows")
    discard(sketches, classes, copies, links, reps, held, passed, texts, more)
    return told, nodes, edges


def _stars(docs: DataFrame, sketches: DataFrame, nodes: DataFrame, copies: DataFrame, id_col: str, text_col: str, percent: int, bands: int, rows: int) -> tuple[DataFrame, ...]:
    """Confirmed links of copies and of the buckets' stars; the sketches of nodes that are no copies; the rows of buckets
    with two members or more; the pairs that were confirmed or not; the texts of all nodes that are in a pair."""
    reps = nodes.select("uid").join(copies.select(F.col("b").alias("uid")), "uid", "left_anti")
    reps = materialise(sketches.select("uid", "n_shingles", "registers").join(reps, "uid", "left_semi"), "reps")
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))
    hashed = F.xxhash64("band", F.substring("registers", F.col("band") * (2 * rows) + 1, F.lit(2 * rows)))
    # The last bits of a key tell its band.
    key = F.shiftleft(hashed, (bands - 1).bit_length()).bitwiseOR(F.col("band").cast("long"))
    keyed = reps.select("uid", "registers", band.alias("band")).select(key.alias("key"), "uid")
    buckets = keyed.groupBy("key").agg(F.min("uid").alias("first"), F.max("uid").alias("last"))
    buckets = materialise(buckets.where("first < last").drop("last"), "buckets")
    held = materialise(keyed.join(buckets, "key"), "held")
    uids = held.select("uid").union(copies.select("a")).union(copies.select("b")).distinct()
    texts = _texts(docs, nodes, uids, id_col, text_col)
    star = held.where("uid > first").select(F.col("first").alias("a"), F.col("uid").alias("b")).distinct()
    passed = materialise(_passing(star, reps, percent / 100), "passed")
    asked = passed.withColumn("copy", F.lit(False)).union(copies.withColumn("copy", F.lit(True)))
    links = materialise(_confirm(asked, texts, percent), "star-links")
    discard(buckets)
    return links, reps, held, passed, texts


def _across(reps: DataFrame, held: DataFrame, passed: DataFrame, label: DataFrame, threshold: float, bands: int, rows: int, block: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and may be linked by their registers, each once and none
    that `passed` has. Buckets of three members or more, in several components, are compared block by block."""
    label = materialise(label.withColumnRenamed("node", "uid"), "labels")
    many = held.groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    rest = held.select("key", "uid").join(many, "key").join(label, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    rest = materialise(rest, "rest")
    still = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    blocks = F.ceil(F.col("n") / block).cast("int")
    facing = rest.join(still, "key").join(reps, "uid").withColumn("own", F.pmod(F.xxhash64("uid", "key"), blocks).cast("int"))
    facing = facing.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    mask = (1 << (bands - 1).bit_length()) - 1

    def across(x: pd.DataFrame) -> pd.DataFrame:
        regs, n, ids, labels, own = _registers(x["registers"]), x["n_shingles"].to_numpy(float), x["uid"].to_numpy(), x["label"].to_numpy(), x["own"].to_numpy()
        one_block = x["i"].iat[0] == x["j"].iat[0]
        own_band = int(x["key"].iat[0]) & mask
        # Pairs with fewer equal registers than five deviations below the threshold aren't estimated.
        enough = regs.shape[1] * threshold - 5 * math.sqrt(regs.shape[1] * threshold * (1 - threshold))
        left, right = [], []
        for k in range(len(x) - 1):
            fit = (labels[k + 1 :] != labels[k]) & (np.minimum(n[k + 1 :], n[k]) >= threshold * np.maximum(n[k + 1 :], n[k]) - 1e-9)
            if not one_block:
                fit &= own[k + 1 :] != own[k]
            at = np.flatnonzero(fit) + k + 1
            if len(at):
                equal = regs[at] == regs[k]
                some = equal.sum(1) >= enough
                first = equal[some].reshape(-1, bands, rows).all(2).argmax(1)
                at = at[some][first == own_band]
            left.append(np.full(len(at), k))
            right.append(at)
        a, b = (np.concatenate(v) if v else np.empty(0, int) for v in (left, right))
        for lo in range(0, len(a), 4096):
            part = slice(lo, lo + 4096)
            good = may_link(regs[a[part]], regs[b[part]], n[a[part]], n[b[part]], threshold)
            a[part], b[part] = np.where(good, a[part], -1), np.where(good, b[part], -1)
        a, b = ids[a[a >= 0]], ids[b[b >= 0]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}, dtype="int64")

    # Comparisons take long for the bytes that they read, so the parts aren't coalesced by size.
    tasks = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = facing.select("key", "i", "j", "uid", "label", "own", "n_shingles", "registers").repartition(tasks, "key", "i", "j")
    return met.groupBy("key", "i", "j").applyInPandas(across, "a bigint, b bigint").join(passed, ["a", "b"], "left_anti")


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, bands: int = BANDS, rows: int = ROWS, block: int = 256) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    told, nodes, edges = _linked(docs, id_col, text_col, percent, bands, rows, block, False)
    ids = nodes.groupBy("doc_id").agg(F.min("uid").alias("a"), F.max("uid").alias("b")).where("a < b").select("doc_id", "a")
    same = nodes.join(ids, "doc_id").where("uid > a").select("a", F.col("uid").alias("b"))
    final = components(edges.union(same)).join(nodes.select(F.col("uid").alias("node"), "doc_id"), "node").select("doc_id", "label")
    final = materialise(final.distinct(), "final")
    low = final.groupBy("label").agg(F.min("doc_id").alias("low"))
    final = final.join(low, "label").select("doc_id", "low")
    component = F.coalesce("low", "doc_id")
    return told.join(final, "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, bands: int = BANDS, rows: int = ROWS, block: int = 256) -> DataFrame:
    """One row of each group of equal or linked texts, with all its columns: that with the least id, a null id last, then
    the least digest of the text. Of rows with the same id and text that with the least JSON form stays. Here an id with
    several texts is several documents. Rows without words all stay."""
    told, nodes, edges = _linked(docs, id_col, text_col, percent, bands, rows, block, True)
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "digest")
    final = materialise(components(edges).join(nodes.select(F.col("uid").alias("node"), "doc_id", "digest"), "node"), "final")
    first = final.groupBy("label").agg(F.min(place).alias("first"))
    dropped = final.join(first, "label").where(place != F.col("first")).select(_id_key("doc_id").alias("id"), "digest")
    again = nodes.where("n > 1").select(_id_key("doc_id").alias("id"), "digest")
    dropped = materialise(dropped, "dropped")
    whole = docs.select(F.struct("*").alias("row"), _id_key(id_col).alias("id"), _digest(text_col).alias("digest")).join(dropped, ["id", "digest"], "left_anti")
    if again.head(1):
        many = whole.join(again, ["id", "digest"], "left_semi").groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
        whole = whole.join(again, ["id", "digest"], "left_anti").select("row").union(many.select("row"))
    return whole.select("row.*")
