"""Token counts by prefix dynamic programming (operator 1).

For byte-pair merging, the tokens of any text are the only sequence whose neighbours are all *stable*: encoding
the two pieces joined gives the two pieces back. So the last token of every prefix follows from the last tokens of
shorter prefixes: among the pieces that end at a position, exactly one is stable after the prefix before it. The
count at a position is one more than the count where that piece begins. Truncation and budget questions are then
look-ups in the counts; nothing is encoded again.

Cases: null or empty text has no tokens; no rows give no rows. Repeated rows, ties and extra columns don't matter: only the
id and text columns are read, and each row is answered by itself. Very long texts take time in proportion to their
length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_map, slices

SPACE = "▁"
#: Distinct segments whose counts a worker remembers before it starts anew; a matter of speed only.
REMEMBERED = 400_000
#: Pairs of pieces whose stability a worker remembers before it starts anew; a matter of speed only.
PAIRS = 2_000_000
#: Characters of a segment whose table is remembered.
HEAD = 6


class PrefixCounter:
    """Exact token counts of every prefix under a SentencePiece BPE model with byte fallback."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(lib.get_piece_size()) if not (lib.IsControl(i) or lib.IsUnknown(i) or lib.IsByte(i) or lib.IsUnused(i))]
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        self.longest = max(map(len, self.score))
        self._stable: dict[str, dict[str, bool]] = defaultdict(dict)
        self._pairs = 0
        self._heads: dict[str, tuple[list[int], list[str]]] = {}
        inner = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        # Text may be cut wherever no piece spans the cut: before a space mark that follows other text, and around
        # line ends, unless this model has pieces there.
        cut_space = not any(pair[1] == SPACE != pair[0] for pair in inner)
        cut_line = not any("\n" in pair for pair in inner)
        line = r"\n" if cut_line else ""
        whole = rf"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + rf"|{line}" * cut_line
        self._cut = re.compile(whole if cut_space else r"(?s).+").findall
        # Nor does a piece join ASCII punctuation to anything but spaces and a few characters; texts without those
        # are cut there too, so that words are met again without their commas.
        is_mark = lambda c: "!" <= c <= "~" and not c.isalnum()
        joined = {c for pair in inner if is_mark(pair[0]) != is_mark(pair[1]) and SPACE not in pair for c in pair if not is_mark(c)}
        self._odd = re.compile("[" + "".join(map(re.escape, joined)) + "]" if joined else r"(?!)").search
        marks = re.escape("".join(c for c in map(chr, range(33, 127)) if is_mark(c)))
        fine = rf"{SPACE}*[^{SPACE}{line}{marks}]+|{SPACE}*[{marks}]+|{SPACE}+" + rf"|{line}" * cut_line
        self._cut_fine = re.compile(fine).findall if cut_space else self._cut
        self._total = _Totals(self)
        for text in ("Ab  cd\n e,f", f"x{SPACE}é中\U0001f600 \t", "<s> </s><unk>"):
            if self.count(text) != len(lib.encode(text)):
                raise ValueError(f"not a BPE model without normalisation: {model}")

    def _merge(self, text: str) -> list[str]:
        """Plain merging, for pairs of pieces only: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score.get(parts[i] + parts[i + 1]), -i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _is_stable(self, left: str, right: str) -> bool:
        self._pairs += 1
        known = self._stable[left][right] = self._merge(left + right) == ([left, right] if left else [right])
        return known

    def _segment(self, text: str) -> list[int]:
        """Counts after 0, 1, .. characters of a segment that no piece leaves. The table of a segment's first characters
        is remembered, as many segments begin alike."""
        head = text[:HEAD]
        if (known := self._heads.get(head)) is None:
            if len(self._heads) >= REMEMBERED:
                self._heads.clear()
            known = self._heads[head] = self._extend(head, [0], [""])
        if len(text) == len(head):
            return known[0]
        return self._extend(text, known[0].copy(), known[1].copy())[0]

    def _extend(self, text: str, counts: list[int], last: list[str]) -> tuple[list[int], list[str]]:
        """Go on from a table of the first characters: counts of the prefixes, and the last piece of each."""
        if self._pairs > PAIRS:
            self._stable.clear()
            self._pairs = 0
        score, stable, longest = self.score, self._stable, self.longest
        rows = [stable[x] for x in last]
        for end in range(len(counts), len(text) + 1):
            for begin in range(end - longest if end > longest else 0, end):
                piece = text[begin:end]
                if piece in score or begin == end - 1:
                    ok = rows[begin].get(piece)
                    if ok or ok is None and self._is_stable(last[begin], piece):
                        counts.append(counts[begin] + (1 if piece in score else len(piece.encode())))
                        last.append(piece)
                        rows.append(stable[piece])
                        break
            else:
                raise AssertionError("no stable piece")
        return counts, last

    def _segments(self, text: str) -> list[str]:
        if not text:
            return []
        return (self._cut if self._odd(text) else self._cut_fine)(SPACE + text.replace(" ", SPACE))

    def count(self, text: str | None) -> int:
        return sum(map(self._total.__getitem__, self._segments(text or "")))

    def prefixes(self, text: str | None) -> list[int]:
        """Token counts of text[:0], text[:1], .. text."""
        out, base = [], 0
        for segment in self._segments(text or ""):
            counts = self._segment(segment)
            out += [base + c for c in counts[1:]]
            base = out[-1]
        return [0, *out[1:]]  # out[0] is the mark put before the text

    def cut(self, text: str, budget: int) -> str:
        """The longest prefix that takes at most `budget` tokens."""
        counts = self.prefixes(text)
        return text[: max(i for i, c in enumerate(counts) if c <= budget)]


class _Totals(dict):
    def __init__(self, counter: PrefixCounter) -> None:
        super().__init__()
        self.counter = counter

    def __missing__(self, segment: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        total = self.counter._segment(segment)[-1]
        if len(segment) < 64:
            self[segment] = total
        return total


_LOADED: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    """The counter of a model, loaded once in each worker."""
    if model not in _LOADED:
        _LOADED[model] = PrefixCounter(model)
    return _LOADED[model]


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens. One pass without a shuffle; the counts come from the prefix tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for batch in batches:
            for part in slices(batch, "text"):
                tokens = pa.array([count(t) for t in part.column("text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), tokens], ["doc_id", "n_bytes", "n_tokens"])

    cols = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return arrow_map(cols, run, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")


def truncate(docs: DataFrame, model: str, budget: int, text_col: str = "text") -> DataFrame:
    """All columns of docs with the text cut to its longest prefix of at most `budget` tokens; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = counter(model).cut
        for batch in batches:
            for part in slices(batch, text_col):
                texts = pa.array([None if t is None else cut(t, budget) for t in part.column(text_col).to_pylist()], part.column(text_col).type)
                yield part.set_column(part.schema.get_field_index(text_col), text_col, texts)

    return arrow_map(docs, run, docs.schema)


def prefix_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and counts, the token counts of the prefixes of 0, 1, .. characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(model).prefixes
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([prefixes(t) for t in part.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "counts"])

    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(cols, run, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, counts array<int>")
