"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 6).

The patterns are the windows of 10 consecutive words of the benchmark items; an item with fewer words is one pattern.
Patterns of one length share a table: for the block of words that ends at a position, the shift table says how far
the search may jump without passing an occurrence; where it may not jump, the bucket of patterns with the same hash of
their last words is compared directly, by the words' hashes and then by their bytes. Many stretches of text are
searched in step, so that a step is an array operation. A search visits about one word in nine and stays in one pass
over the documents, without a shuffle.

The benchmark is a stated query set of any size. Tasks cut it into blocks of at most block_bytes of text and compile each
into the shared folder, measured at 8 bytes of tables a byte of benchmark. A worker takes up to hold_bytes of documents and then all blocks in turn, so what it holds is bounded by block_bytes and hold_bytes
whatever the benchmark's size, and each block is read once for hold_bytes of text.

Cases: null or empty texts have no words; very long texts are searched whole, in overlapping stretches; items without
words are no patterns; items with equal words are all reported; equal item ids are reported once; a null item id is
left out of the list but its words are hit; rows that repeat a doc_id are answered one by one; empty tables give no
hits. Overlapping occurrences are all found. Only the id and text columns are read, so names of others can't clash.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_map, fresh_path, materialise, slices
from weftline.storage import discard

WIDTH = 10
#: Words whose hash selects a bucket, at the end of a pattern.
SUFFIX = 4
#: Windows of a text that are searched as one of many stretches.
STRETCH = 512
#: ASCII letters to lower case, digits and bytes of other characters kept, all else a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
#: What is left of eight bytes, by how many of them belong to a word.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Words:
    """The words of all texts one after another: their bytes from `begin` to `end` in `data`, a hash of each, and where
    each text's words begin (`starts`, one more at the end)."""

    def __init__(self, texts: pa.Array) -> None:
        parts = [(t or b"").translate(_FOLD) for t in texts.cast(pa.binary()).to_pylist()]
        self.data = b" ".join([b"", *parts, b" " * 8])
        raw = np.frombuffer(self.data, np.uint8)
        inside = raw != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edges = edges.astype(np.int32)  # a text has less than 2 GB
        self.begin, self.end = edges[::2], edges[1::2]
        places = np.cumsum([1, *(len(x) + 1 for x in parts)])
        self.starts = np.searchsorted(self.begin, places)
        eight = np.ndarray((len(raw) - 7,), "<u8", self.data, strides=(1,))  # the eight bytes from each place on
        self.hash = np.zeros(len(self.begin), np.uint64)
        todo, at = np.arange(len(self.begin)), self.begin
        while len(todo):
            left = self.end[todo] - at
            mixed = (self.hash[todo] ^ eight[at] & _KEPT[np.minimum(left, 8)]) * _K1
            self.hash[todo] = mixed ^ mixed >> np.uint64(29)
            more = left > 8
            todo, at = todo[more], at[more] + 8
        self.hash = (self.hash ^ (self.end - self.begin).astype(np.uint64)) * _K2

    def run(self, first: int, length: int) -> list[bytes]:
        """Some words as they are."""
        return self.data[self.begin[first] : self.end[first + length - 1]].split()


class WuManber:
    """Search for patterns of one length: windows of the words `own` at `at`, for the items `owner`."""

    def __init__(self, length: int, own: Words, at: np.ndarray, owner: np.ndarray, inside: np.ndarray) -> None:
        self.length, self.block = length, min(2, length)
        self.own, ids = own, own.hash
        end = at + length
        order = np.lexsort((self._mixed(ids, end, length), self._mixed(ids, end, SUFFIX)))
        at_, self.owners = at[order], owner[order]
        # Equal windows stand together and are compared once; `first` tells where the owners of each begin.
        new = np.ones(len(at_), bool)
        new[1:] = np.any([ids[at_[1:] + k] != ids[at_[:-1] + k] for k in range(length)], axis=0)
        for i in np.flatnonzero(~new).tolist():
            new[i] = own.run(at_[i], length) != own.run(at_[i - 1], length)
        self.first = np.append(np.flatnonzero(new), len(at_))
        self.at = at_[new]
        self.hashes = self._mixed(ids, self.at + length, SUFFIX)
        # The table has four places or more for each pattern. Blocks that share a place take the shorter shift, which
        # is safe. `inside` tells how far into its item each pattern begins: the first one has a block at any distance
        # from its end; of later ones only the last block is new.
        self.mask = np.uint64((1 << max(4, int(4 * len(at) + 1).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, min(255, length - self.block + 1), np.uint8)
        np.minimum.at(self.shift, self._place(ids, at + length), np.uint8(0))
        first = at[inside == 0]
        for end in range(self.block, length):
            np.minimum.at(self.shift, self._place(ids, first + end), np.uint8(min(255, length - end)))

    def _place(self, x: np.ndarray, end: np.ndarray) -> np.ndarray:
        mixed = x[end - 1] * _K1
        if self.block == 2:
            mixed = mixed ^ x[end - 2] * _K2
        return (mixed ^ mixed >> np.uint64(29)) * _K3 >> np.uint64(20) & self.mask

    def _mixed(self, x: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
        """A hash of the last `most` words of windows that end at `end`."""
        out = np.zeros(len(end), np.uint64)
        for k in range(min(most, self.length)):
            out = (out ^ x[end - 1 - k]) * _K1
            out ^= out >> np.uint64(32)
        return out

    def search(self, texts: Words) -> tuple[np.ndarray, np.ndarray]:
        """Begins, as numbers of words, and owners of all occurrences."""
        length, x, starts = self.length, texts.hash, texts.starts
        room = np.diff(starts) - length + 1  # windows of each text
        stretches = np.where(room > 0, -(-room // STRETCH), 0)
        row = np.repeat(np.arange(len(room)), stretches)
        step = np.arange(len(row)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        begin = starts[row] + step * STRETCH
        last = np.minimum(begin + STRETCH - 1, starts[row] + room[row] - 1) + length  # ends of the last windows
        end, found = begin + length, []
        while len(end):
            jump = self.shift[self._place(x, end)].astype(np.int64)
            here = jump == 0
            if here.any():
                found.append(end[here])
            end = end + np.where(here, 1, jump)
            on = end <= last
            end, last = end[on], last[on]
        end = np.concatenate(found) if found else np.empty(0, np.int64)
        hashes = self._mixed(x, end, SUFFIX)
        low = np.searchsorted(self.hashes, hashes, "left")
        count = np.searchsorted(self.hashes, hashes, "right") - low
        pattern = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        begin = np.repeat(end, count) - length
        for k in range(length):
            same = x[begin + k] == self.own.hash[self.at[pattern] + k]
            begin, pattern = begin[same], pattern[same]
        same = [texts.run(b, length) == self.own.run(a, length) for b, a in zip(begin.tolist(), self.at[pattern].tolist())]
        begin, pattern = begin[np.array(same, bool)], pattern[np.array(same, bool)]
        first, count = self.first[pattern], self.first[pattern + 1] - self.first[pattern]
        return np.repeat(begin, count), self.owners[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]


class Block:
    """The tables of some items, by pattern length, and the items' ids."""

    def __init__(self, items: Iterable[tuple[object, str | None]], width: int = WIDTH) -> None:
        items = list(items)
        self.owners = [item for item, _ in items]
        own = Words(pa.array([t for _, t in items], pa.string()))
        sizes = np.diff(own.starts)
        lengths = np.minimum(sizes, width)
        self.tables = []
        for length in sorted(set(lengths[lengths > 0].tolist())):
            some = np.flatnonzero(lengths == length)
            n = sizes[some] - length + 1
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(own.starts[some], n) + inside
            self.tables.append(WuManber(length, own, at.astype(np.int32), np.repeat(some, n).astype(np.int32), inside))


def _save_blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, block_bytes: int) -> list[str]:
    """Compile the benchmark in the shared folder, by tasks that each hold one block at a time; the files of finished
    tasks, whose names alone reach the driver, a name for block_bytes of benchmark or a smaller partition."""
    folder = fresh_path(benchmark.sparkSession, "patterns")
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        names: list[str] = []
        block: list = []
        held = 0

        def flush() -> None:
            names.append(f"{base}/{uuid.uuid4().hex}")
            with store.open_output_stream(names[-1]) as out:
                out.write(pickle.dumps(Block(block, width)))

        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                block.append((item, text))
                held += len(text or "") + 8
                if held >= block_bytes:
                    flush()
                    block, held = [], 0
        if block:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    made = materialise(arrow_map(items, run, "file string"), "pattern-files")
    files = sorted(r.file for r in made.collect())
    discard(made)
    return [folder, *files]


_BLOCK: dict[str, Block] = {}


def _load(folder: str, name: str) -> Block:
    """One block's tables; a worker keeps the last."""
    if name not in _BLOCK:
        _BLOCK.clear()
        store, _ = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(name) as f:
            _BLOCK[name] = pickle.loads(f.read())
    return _BLOCK[name]


def _held(batches: Iterator[pa.RecordBatch], text_col: str, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Pieces of the batches in lots of about `most` bytes of text."""
    lot, size = [], 0
    for batch in batches:
        for part in slices(batch, text_col):
            lot.append(part)
            size += part.nbytes
            if size >= most:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


def scan(batches: Iterator[pa.RecordBatch], paths: list[str], text_col: str, hold_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[set]]]:
    """Pieces of the batches with words, hit words and items of each row."""
    folder, *files = paths
    for lot in _held(batches, text_col, hold_bytes):
        pieces = [Words(part.column(text_col)) for part in lot]
        edges = [np.zeros(len(texts.hash) + 1, np.int32) for texts in pieces]
        items: list[dict[int, set]] = [{} for _ in pieces]
        for name in files:
            block = _load(folder, name)
            for texts, edge, own in zip(pieces, edges, items):
                for table in block.tables:
                    begin, owner = table.search(texts)
                    if not len(begin):
                        continue
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + table.length, -1)
                    rows = np.searchsorted(texts.starts, begin, "right") - 1
                    for pair in np.unique(rows * len(block.owners) + owner).tolist():
                        own.setdefault(pair // len(block.owners), set()).add(block.owners[pair % len(block.owners)])
        for part, texts, edge, own in zip(lot, pieces, edges, items):
            covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])[texts.starts]
            yield part, np.diff(texts.starts), np.diff(covered), [own.get(i, set()) - {None} for i in range(part.num_rows)]


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = 16 << 20, hold_bytes: int = 16 << 20) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, items (sorted), contaminated."""
    paths = _save_blocks(benchmark, item_col, item_text, width, block_bytes)
    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, n, hit, items in scan(batches, paths, "text", hold_bytes):
            lists = [sorted(set(map(str, x))) for x in items]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in lists], pa.int64()), pa.array(digest, pa.string()), pa.array(lists, pa.list_(pa.string())), pa.array(hit > 0, pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "items", "contaminated"])

    return arrow_map(cols, run, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, items array<string>, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = 16 << 20, hold_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs without a hit word, with all their columns; one pass, no join."""
    paths = _save_blocks(benchmark, item_col, item_text, width, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, hit, _ in scan(batches, paths, text_col, hold_bytes):
            yield part.filter(pa.array(hit == 0, pa.bool_()))

    return arrow_map(docs, run, docs.schema)
