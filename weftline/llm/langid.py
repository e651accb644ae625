"""Language identification with hyperdimensional profiles (operator 5).

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each
permuted (rotated) by its place. A text's vector bundles (adds) the vectors of its n-grams, a language's prototype
bundles its training texts. The language is the one whose prototype has the largest cosine with the text's vector.

Bundles are built from n-gram counts: the count of an n-gram times its vector is the sum over its occurrences. A text
needs one pass, no shuffle, and prototypes of a fixed size (dimension x languages). Training reads about
train_per_lang texts of each language, drawn by a hash of id and seed; that is the bound of the sample. Tasks bundle
them, so the driver gets no text or n-gram.

Cases: `und` with score 0 for null texts, texts without letters, and if nothing was learned; very long texts are read
whole; equal cosines go to the first language by code point; rows with null lang aren't learned from, rows that repeat
an id are drawn together and each is answered by itself; no rows give no rows. Only id, text and lang columns are read,
so names of others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_map, slices

N = 3
UNKNOWN = "und"
#: n-gram vectors that a worker remembers; others are built again. A matter of speed only.
REMEMBERED = 24_000


def letter_vector(code: int, dim: int) -> np.ndarray:
    return np.random.default_rng(code).integers(0, 2, dim, dtype=np.int8) * 2 - 1


class Space:
    """Vectors of letters and n-grams, alike in every process."""

    def __init__(self, dim: int) -> None:
        self.dim = dim
        self.letters: dict[int, list[np.ndarray]] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((REMEMBERED, dim), np.int8)  # 1 KB a row in 1024 dimensions
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def _letter(self, code: int) -> list[np.ndarray]:
        if code not in self.letters:
            v = letter_vector(code, self.dim)
            self.letters[code] = [np.roll(v, N - 1 - k) for k in range(N)]
        return self.letters[code]

    def vector(self, key: int) -> np.ndarray:
        a, b, c = self._letter(key >> 42), self._letter(key >> 21 & 0x1FFFFF), self._letter(key & 0x1FFFFF)
        return a[0] * b[1] * c[2]

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of at most REMEMBERED keys, one a row."""
        if len(self.rows) + len(keys) > REMEMBERED:
            self.rows.clear()
        at = np.empty(len(keys), np.int64)
        for i, k in enumerate(keys.tolist()):
            if (row := self.rows.get(k)) is None:
                row = self.rows[k] = len(self.rows)
                self.table[row] = self.vector(k)
            at[i] = row
        return self.table[at].astype(np.float32)

    def bundles(self, keys: np.ndarray, counts: np.ndarray, block: int = 2048) -> np.ndarray:
        """Sums of the n-gram vectors, weighed by the counts of each text."""
        out = np.zeros((len(counts), self.dim), np.float32)
        for k in range(0, len(keys), block):
            out += counts[:, k : k + block] @ self.vectors(keys[k : k + block])
        return out

    def grams(self, text: str | None) -> np.ndarray:
        """Keys of the n-grams of a text: letters in lower case, anything else one blank, a letter in the middle."""
        codes = np.frombuffer(" {} ".format((text or "").lower()).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(self.is_letter[codes], codes, 32)
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])].astype(np.int64)
        keys = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
        return keys[codes[1:-1] != 32]


def counted(space: Space, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts and a matrix of their counts by text."""
    grams = [space.grams(t) for t in texts]
    keys = pa.array(np.concatenate(grams)).dictionary_encode()
    distinct, codes = keys.dictionary.to_numpy(), keys.indices.to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    return distinct, np.bincount(rows * len(distinct) + codes, minlength=len(texts) * len(distinct)).reshape(len(texts), len(distinct)).astype(np.float32)


_SPACES: dict[int, Space] = {}


def space(dim: int) -> Space:
    if dim not in _SPACES:
        _SPACES[dim] = Space(dim)
    return _SPACES[dim]


def learn(train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = 1024, train_per_lang: int = 1500, seed: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes. Each task bundles what it has of every language, and the bundles, whole
    numbers, are added by Spark; the driver gets a vector for each language."""
    rows = train.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = rows.groupBy("lang").count().withColumn("share", F.least(F.lit(1.0), F.lit(float(train_per_lang)) / F.col("count"))).select("lang", "share")
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(sizes), "lang").where(draw < F.col("share")).select("lang", "text")  # a row per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, sums = space(dim), {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                for lang in set(langs):
                    keys, n = np.unique(np.concatenate([sp.grams(t) for g, t in zip(langs, texts) if g == lang]), return_counts=True)
                    own = sums.setdefault(lang, {})
                    for k, c in zip(keys.tolist(), n.tolist()):
                        own[k] = own.get(k, 0) + c
        for lang, own in sums.items():
            keys, n, vector = np.array(list(own), np.int64), np.array(list(own.values()), np.float64), np.zeros(dim)
            for at in range(0, len(keys), 2048):
                vector += n[at : at + 2048] @ sp.vectors(keys[at : at + 2048]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim, pa.string()), pa.array(np.arange(dim), pa.int64()), pa.array(vector.astype(np.int64))], ["lang", "place", "n"])

    told = arrow_map(sample, run, "lang string, place bigint, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(told["lang"].unique())
    table = told.pivot(index="lang", columns="place", values="n").sort_index()
    return langs, table.to_numpy(float).reshape(len(langs), dim)


def least_cosine(counts: np.ndarray, dim: int) -> np.ndarray:
    """By row of n-gram counts, the cosine that a text must reach to count as identified. Cosines of unrelated vectors
    spread by 1 / sqrt(dim), whatever the length: 4.5 of that, as the largest of several languages is taken. Letters of a
    learned script share n-grams with a language by chance, and kindred languages share more; that part of the cosine
    grows with sum / length of the counts, the root of the number of different n-grams. A text in a learned language
    grows faster, so longer texts must reach more, by 0.16 at most."""
    spread = counts.sum(1) / np.maximum(1, np.linalg.norm(counts, axis=1))
    return 4.5 / dim**0.5 + np.clip(0.01 * (spread - 7), 0, 0.16)


class Model:
    """Languages in order and their prototypes, scaled to length 1."""

    def __init__(self, langs: list[str], prototypes: np.ndarray) -> None:
        norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
        self.langs, self.unit = langs, (prototypes / np.where(norms == 0, 1, norms)).astype(np.float32)

    def told(self, texts: list[str | None], block: int = 64) -> tuple[list[str], list[float]]:
        """Language and cosine of each text."""
        return self.weighed(texts, block)[:2]

    def weighed(self, texts: list[str | None], block: int = 64) -> tuple[list[str], list[float], list[float]]:
        """Language and cosine of each text, and the cosine that a text of its n-gram counts must reach to be more than
        chance (least_cosine)."""
        preds, scores, cuts = [UNKNOWN] * len(texts), [0.0] * len(texts), [1.0] * len(texts)
        if not self.langs:
            return preds, scores, cuts
        sp = space(self.unit.shape[1])
        for at in range(0, len(texts), block):
            keys, counts = counted(sp, texts[at : at + block])
            if not len(keys):
                continue
            vectors = sp.bundles(keys, counts)
            length = np.linalg.norm(vectors, axis=1)
            cosines = (vectors @ self.unit.T) / np.where(length == 0, 1, length)[:, None]
            least = least_cosine(counts, self.unit.shape[1])
            for i, (best, row, some) in enumerate(zip(cosines.argmax(1).tolist(), cosines, counts.any(1).tolist())):
                if some:
                    preds[at + i], scores[at + i], cuts[at + i] = self.langs[best], min(1.0, max(0.0, float(row[best]))), float(least[i])
        return preds, scores, cuts


def is_held(id_col: str, folds: int = 4, held: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held, F.lit(False))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options: object) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Learns from the rows that aren't held out by crc32 of the id."""
    model = Model(*learn(docs.where(~is_held(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col, **options))
    cols = docs.select(F.col(id_col).alias("doc_id"), is_held(id_col).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                preds, scores = model.told(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return arrow_map(cols, run, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float | None = None, **options: object) -> DataFrame:
    """The rows of docs, all columns, whose language is identified with a score of at least `least`, or where that is None,
    of at least what is beyond chance for the text (least_cosine)."""
    model = Model(*learn(docs.where(~is_held(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1 << 19):
                told = zip(*model.weighed(part.column(text_col).to_pylist()))
                yield part.filter(pa.array([p != UNKNOWN and c >= (cut if least is None else least) for p, c, cut in told], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
