"""Sparse word features shared by the linear models of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from weftline.llm.common import split_words

#: A-Z to lower case, ASCII punctuation to blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Beginnings of words that are features besides the whole word, in characters.
STEMS = (4,)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word codes of all texts one after another, where each text's begin, and the words by code."""
    folded = pa.array([(t or "").encode().translate(_FOLD) for t in texts], pa.binary()).cast(pa.string())
    codes, starts, vocab = split_words(folded)
    return codes, starts, vocab.to_pylist()


def ids(words: list[str]) -> np.ndarray:
    """Feature numbers of each word, one column a kind: the whole word, then its beginnings."""
    out = np.empty((len(words), 1 + len(STEMS)), np.uint64)
    digest = xxhash.xxh3_64_intdigest
    for i, w in enumerate(words):
        out[i, 0] = digest(w)
        for k, n in enumerate(STEMS):
            out[i, k + 1] = digest("^" + w[:n])
    return out
