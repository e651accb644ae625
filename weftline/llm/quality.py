"""Quality rules by learned decision lists (operator 10).

Statistics of whole texts are taken in one pass. From labelled documents a decision list is learned by sequential
covering: a rule, a conjunction of thresholds, is grown on two thirds of the rows by information gain, pruned on the
other third, and kept if it is precise there; the rows that it covers are set aside and the next rule is grown. The
list is emitted as one ordered Spark conditional expression, so applying it needs no Python and can be read.

Learning takes at most train_rows labelled documents with at most train_bytes of text, by a digest of id and text; of an
id all rows are in the same third.

Cases: null texts count as empty; very long texts are read whole; ratios over no words are 0; lines are cut at \\n only; a
document with several label rows is learned from each, rows alike in id, text and label once, null labels aren't
learned from; rows that repeat an id are judged one by one; of tests with equal gain the first feature, the least
threshold and `above` win; without labels, or without a rule precise enough, the list keeps every document that the base
rules keep; no documents give no rows. Only the id and text columns and the label columns are read, so names of others
can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_map, fold_of, labelled_sample, slices, split_words
from weftline.storage import discard

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
_SYMBOLS = bytes(range(256)).translate(None, b"#*$%&|<>")
_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_MARKS = bytes(b for b in range(256) if b not in b"!?")
_LEADS = bytes(range(0x80, 0xC0))
_BLANKS = b" \t\n\x0b\x0c\r"


def repeats(codes: np.ndarray, starts: np.ndarray, n_vocab: int) -> np.ndarray:
    """Words of each text that lie in a window of 5 words found twice or more in the text. Windows are numbered
    exactly: pairs of numbers get numbers of their own, for 2, 4 and 5 words."""
    n = len(codes)
    counts = np.zeros(len(starts) - 1, np.int64)
    if n < WINDOW:
        return counts

    def numbered(a: np.ndarray, b: np.ndarray, top: int) -> tuple[np.ndarray, int]:
        coded = pa.array(a.astype(np.int64) * top + b).dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)

    two, _ = numbered(codes[:-1], codes[1:], n_vocab)
    four, k4 = numbered(two[:-2], two[2:], int(two.max()) + 1)
    five, k5 = numbered(four[:-1], codes[4:].astype(np.int64), max(n_vocab, 1))
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = row[: n - 4] == row[4:]
    key = pa.array(row[: n - 4][whole] * k5 + five[whole]).dictionary_encode().indices.to_numpy()
    again = np.zeros(n - 4, bool)
    again[whole] = np.bincount(key, minlength=1)[key] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.bincount(row, np.cumsum(edge[:-1]) > 0, len(starts) - 1).astype(np.int64)


def duplicate_lines(data: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    lines = [x for x in data.split(b"\n") if x.strip(_BLANKS)]
    return len(lines) - len(set(lines)), len(lines)


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and the counts of COUNTS, from the whole text."""
    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                codes, starts, vocab = split_words(part.column("text"))
                raw = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
                chars = [len(x.translate(None, _LEADS + _BLANKS)) for x in raw]
                lines = [duplicate_lines(x) for x in raw]
                out = [np.diff(starts), chars, [len(x.translate(None, _SYMBOLS)) for x in raw], [a for a, _ in lines], repeats(codes, starts, len(vocab)), [b for _, b in lines], [len(x.translate(None, _UPPER)) for x in raw], [len(x.translate(None, _MARKS)) for x in raw]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in out)], ["doc_id", *COUNTS])

    return arrow_map(cols, run, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(0.0)


def features() -> dict[str, Column]:
    """The statistics that rules may test."""
    return {"n_words": F.col("n_words").cast("double"), "mean_word": ratio("word_chars", "n_words"), "symbols_per_word": ratio("n_symbols", "n_words"), "dup_lines": ratio("n_dup_lines", "n_lines"), "repeat_words": ratio("n_repeat_words", "n_words"), "words_per_line": ratio("n_words", "n_lines"), "upper": ratio("n_upper", "word_chars"), "marks_per_word": ratio("n_marks", "n_words")}


@dataclass(frozen=True)
class Test:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.threshold if self.above else x[:, self.feature] <= self.threshold


def covers(rule: list[Test], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= t.holds(x)
    return out


def grow(x: np.ndarray, y: np.ndarray, most: int, steps: int = 64) -> list[Test]:
    """Add the test of most information gain until no bad row's neighbour is good, or `most` tests."""
    rule: list[Test] = []
    inside = np.ones(len(y), bool)
    while len(rule) < most and inside.any() and not y[inside].all():
        p0, n0 = y[inside].sum(), inside.sum()
        best, gain = None, 1e-9
        for f in range(x.shape[1]):
            values = np.unique(x[inside, f])
            marks = (values[1:] + values[:-1]) / 2
            if len(marks) > steps:
                marks = np.unique(np.quantile(x[inside & y, f], np.linspace(0, 1, steps)))
            for t in marks.tolist():
                for above in (True, False):
                    c = inside & Test(f, above, t).holds(x)
                    p, n = y[c].sum(), c.sum()
                    if p and (g := p * (math.log2(p / n) - math.log2(p0 / n0))) > gain:
                        best, gain = Test(f, above, t), g
        if best is None:
            break
        best = widened(best, x[inside], y[inside])
        rule.append(best)
        inside &= best.holds(x)
    return rule


def widened(test: Test, x: np.ndarray, y: np.ndarray) -> Test:
    """The same test on the rows at hand, its threshold halfway between the values that it leaves and the nearest bad
    value that it covers, so that new good rows just beyond the old ones aren't hit."""
    holds, v = test.holds(x), x[:, test.feature]
    bad, left = v[holds & y], v[~holds]
    if not len(bad) or not len(left):
        return test
    near, edge = (bad.min(), left.max()) if test.above else (bad.max(), left.min())
    return Test(test.feature, test.above, float((near + edge) / 2))


def prune(rule: list[Test], x: np.ndarray, y: np.ndarray) -> list[Test]:
    """The beginning of the rule that is worth most on rows it wasn't grown on; longer wins among equals."""
    def worth(r: list[Test]) -> float:
        c = covers(r, x)
        p = y[c].sum()
        return (2 * p - c.sum()) / max(1, c.sum()) if c.any() else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=[])


def learn(x: np.ndarray, y: np.ndarray, third: np.ndarray, *, most_rules: int = 12, most_tests: int = 3, precision: float = 0.97, least: int = 3) -> list[list[Test]]:
    """Rules for the bad rows (y true), in order, grown on the rows outside `third` and pruned on those in it. Each must be precise on all rows that earlier rules left, and cover
    `least` bad ones at least."""
    rules: list[list[Test]] = []
    left = np.ones(len(y), bool)
    while len(rules) < most_rules and y[left & ~third].any():
        rule = prune(grow(x[left & ~third], y[left & ~third], most_tests), x[left & third], y[left & third])
        c = left & covers(rule, x)
        if not rule or y[c].sum() < least or y[c].mean() < precision:
            break
        rules.append(rule)
        left &= ~c
    return rules


def as_column(rules: list[list[Test]]) -> Column:
    """True for a document that no rule rejects: WHEN rule 1 THEN false WHEN rule 2 .. ELSE true."""
    cols, out = list(features().values()), None
    for rule in rules:
        test = F.lit(True)
        for t in rule:
            test = test & (cols[t.feature] > t.threshold if t.above else cols[t.feature] <= t.threshold)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", train_rows: int = 4000, train_bytes: int = 64 << 20, seed: str = "quality") -> list[list[Test]]:
    few = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(quality_col) == 0).alias("bad"))
    rows = labelled_sample(docs, few, id_col=id_col, text_col=text_col, most_rows=train_rows, most_bytes=train_bytes, seed=seed)
    told = statistics(rows.select(F.struct("id", "bad").alias("key"), "text"), id_col="key", text_col="text")
    names = list(features())
    got = told.select("doc_id.id", "doc_id.bad", *[c.alias(n) for n, c in features().items()]).toPandas()
    discard(rows)
    got = got.sort_values(["id", "bad", *names])
    third = np.array([fold_of(k, 3) == 2 for k in got["id"].tolist()], bool)
    return learn(got[names].to_numpy(float).reshape(len(got), len(names)), got["bad"].to_numpy(bool), third)


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept."""
    rules = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return statistics(docs, id_col=id_col, text_col=text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & as_column(rules))
