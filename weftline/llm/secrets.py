"""Secret scans with a guess-cost model (operator 4).

Base spans are three fixed patterns. The method adds spans of kind `cred`: values that follow a credential word, the
base pattern's or another, and that are costly to guess. The cost of a value is the least, over all ways to cut it into
dictionary words, dates, repeats, keyboard walks, sequences and brute-force characters, of the sum of the parts' log10
guesses; it is found by dynamic programming over the ends of parts, exactly. A value is added if its cost reaches
min_cost. A value in quotes ends at the same quote; a bare one at a blank, less closing punctuation.

The dictionary is ranked: common passwords, then the whole words of a public vocabulary of 49,000 entries in its order,
which follows frequency; its file is a parameter (`vocabulary`), and it is broadcast, at most MOST_WORDS words.

Cases: null and empty texts have no spans and the digest of an empty string; very long texts and values are taken
whole; rows that repeat an id are answered one by one; equal spans of one kind can't occur; an added span is left out
if a base span or another added one contains it entirely, and may else overlap base spans, which stay as they are. No
rows give no rows. Only the id and text columns are read, so names of others can't clash.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_map, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Credential words, the base pattern's among them, and values with the characters that it stops at.
CONTEXT = re.compile(r"""(?:password|passwd|secret|token|api_?key|pwd|passphrase|passcode|credentials?|bearer|private_?key|access_?key|auth_?key|client_?id|login|pin)["']?\x20*(?:[:=]\x20*|(?<=bearer)\x20)(?:"([!#-~]{6,})|'([!-&(-~]{6,})|(?!["'])([!-~]{6,}))""", re.I | re.A)
#: The longest end of a value that can begin the next match: a credential word, a quote and a sign.
TAIL = len('credentials":')
WORDS_BASE = ("passw", "secret", "token", "apikey", "api_key")
WORDS_CONTEXT = (*WORDS_BASE, "pwd", "passphrase", "passcode", "credential", "bearer", "private", "access", "auth", "client", "login", "pin")
KINDS = ("assign", "access", "hex", "cred")

_COMMON = "password 123456 secret admin welcome qwerty letmein login master dragon monkey shadow sunshine princess football baseball iloveyou trustno1 superman batman hello freedom whatever starwars passw0rd changeme default test guest root user demo example sample token key value public private account system server database network internet computer company business service summer winter spring autumn january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday love money house world peace happy lucky orange purple silver golden yellow green black white none null true false string number client access bearer the and for you that with this from have not are was your all can one out more".split()
_LEET = str.maketrans("4@301$57", "aaeoisst")
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")
_NEAR = {a + b for row in _ROWS for a, b in zip(row, row[1:])} | {b + a for row in _ROWS for a, b in zip(row, row[1:])}
_SEP, _YEAR, _MONTH, _DAY = "[-/._]?", r"(?:19|20)\d\d", "(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
#: Forms of dates; each ends at one place at most from where it begins.
DATES = tuple(re.compile(x) for x in (_YEAR + _SEP + _MONTH + _SEP + _DAY, _DAY + _SEP + _MONTH + _SEP + _YEAR, _MONTH + _SEP + _DAY + _SEP + _YEAR, _YEAR))
MOST_WORDS = 60_000
SHORTEST, LONGEST = 3, 24
VOCABULARY = "word_bpe_49k.json"

Words = dict[str, int]


def dictionary(vocabulary: str | None) -> Words:
    """Ranks of words: the common ones, then the whole words (ASCII letters) of a vocabulary file in its order."""
    words = dict.fromkeys(_COMMON)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            known = json.load(f)["model"]["vocab"]
        whole = (w.removesuffix("</w>") for w in sorted(known, key=known.get) if w.endswith("</w>"))
        words.update(dict.fromkeys(w for w in whole if w.isascii() and w.isalpha() and SHORTEST <= len(w) <= LONGEST))
    return {w: i + 1 for i, w in enumerate(list(words)[:MOST_WORDS])}


def default_words() -> Words:
    import public_tokenizers

    return dictionary(str(public_tokenizers.path(VOCABULARY)))


def char_guesses(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


def word_cost(exact: str, words: Words) -> float | None:
    """Guesses for a word of the dictionary, in any case and with digits for letters; None for another text."""
    low = exact.lower()
    rank, leet = words.get(low), 0.0
    if rank is None:
        rank = words.get(low.translate(_LEET))
        if rank is None:
            return None
        leet = math.log10(4)
    more = 0.0 if exact == low else math.log10(2) if exact.istitle() or exact.isupper() else math.log10(2) * sum(x.isupper() for x in exact)
    return math.log10(rank + 1) + more + leet


class _Run:
    """The least cost over the parts of one kind that end at a place: best[begin] + log10(guesses x length), for all
    begins of the run that goes on there, three characters long or more. As log10(end - begin) grows more slowly for
    earlier begins, one that isn't better than an earlier one when it comes to count never will be, so few are kept."""

    def __init__(self) -> None:
        self.first, self.kept = 0, []

    def cost(self, best: list[float], end: int, goes_on: bool) -> float:
        if not goes_on:
            self.first, self.kept = end - 1, []
        begin = end - 3
        if begin < self.first:
            return math.inf
        least = min((best[b] + math.log10(end - b) for b in self.kept), default=math.inf)
        own = best[begin] + math.log10(3)
        if own < least:
            self.kept = [b for b in self.kept if best[b] < best[begin]] + [begin]
            return own
        return least


def guess_cost(value: str, words: Words) -> float:
    """log10 of the guesses that the cheapest segmentation needs. Time is in proportion to the value's length."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    best = [0.0] * (n + 1)
    repeat, walk, up, down = _Run(), _Run(), _Run(), _Run()
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit():
            for form in DATES:
                if m := form.match(value, i):
                    dates.setdefault(m.end(), []).append(i)
    longest = min(LONGEST, max(map(len, words), default=0))
    for end in range(1, n + 1):
        size = char_guesses(value[end - 1])
        cost = best[end - 1] + math.log10(size)
        for width in range(SHORTEST, min(longest, end) + 1):
            begin = end - width
            if low[begin:end] in words or plain[begin:end] in words:
                cost = min(cost, best[begin] + word_cost(value[begin:end], words))
        for begin in dates.get(end, ()):
            cost = min(cost, best[begin] + date_cost(end - begin))
        a, b = (low[end - 2], low[end - 1]) if end > 1 else ("", low[0])
        step = ord(b) - ord(a) if a else 0
        cost = min(cost, repeat.cost(best, end, a == b) + math.log10(size), walk.cost(best, end, a + b in _NEAR) + math.log10(47 * 4), min(up.cost(best, end, step == 1), down.cost(best, end, step == -1)) + math.log10(4 * size))
        best[end] = cost
    return best[n]


def date_cost(length: int) -> float:
    return math.log10(365 * 120 if length > 4 else 120)


def find(text: str | None, words: Words, min_cost: float = 10.0) -> tuple[list[tuple[int, int, str]], float]:
    """Spans (begin, end, kind) by begin and kind, and the highest cost of a credential value."""
    text = text or ""
    low = text.lower()
    spans, highest = [], 0.0
    if any(w in low for w in WORDS_BASE):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                spans.append((m.start(), m.end(), "assign"))
                highest = max(highest, guess_cost(m[2], words))
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if any(w in low for w in WORDS_CONTEXT):
        base, k, covered, at = sorted(spans), 0, 0, 0
        while m := CONTEXT.search(text, at):
            begin, end = m.span(m.lastindex)
            at = max(begin, end - TAIL)
            if m.lastindex == 3:  # bare
                end = begin + len(text[begin:end].rstrip("\"',;.)"))
            while k < len(base) and base[k][0] <= m.start():
                covered, k = max(covered, base[k][1]), k + 1
            if end - begin < 6 or end <= covered:
                continue
            cost = guess_cost(text[begin:end], words)
            highest = max(highest, cost)
            if cost >= min_cost:
                spans.append((m.start(), end, "cred"))
                covered = end
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))), highest


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_cost: float = 10.0, words: Words | None = None) -> DataFrame:
    """Per row: doc_id, spans (array of start, end, kind; code points, end exclusive), max_cost. One pass, no shuffle."""
    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    told = docs.sparkSession.sparkContext.broadcast(default_words() if words is None else words)  # at most MOST_WORDS
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [find(t, told.value, min_cost) for t in part.column("text").to_pylist()]
                spans = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s, _ in found], kind)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), spans, pa.array([c for _, c in found], pa.float64())], ["doc_id", "spans", "max_cost"])

    return arrow_map(cols, run, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:bigint,end:bigint,kind:string>>, max_cost double")


def digest_columns(spans: DataFrame) -> DataFrame:
    """The query's columns from the spans."""
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias("n_" + k)
    base = F.filter("spans", lambda s: s["kind"] != "cred")
    return spans.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "max_cost")


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[secret]", min_cost: float = 10.0, words: Words | None = None) -> DataFrame:
    """All columns of docs, each span replaced by `mark`; overlapping spans are replaced as one."""
    told = docs.sparkSession.sparkContext.broadcast(default_words() if words is None else words)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for a, b, _ in find(text, told.value, min_cost)[0]:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = pa.array([clean(t) for t in part.column(text_col).to_pylist()], part.column(text_col).type)
                yield part.set_column(part.schema.get_field_index(text_col), text_col, texts)

    return arrow_map(docs, run, docs.schema)
