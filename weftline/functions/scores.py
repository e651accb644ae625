"""Differences between an answer and the correct one, and the taxonomy of a sample's errors."""

from __future__ import annotations

import difflib
import json
import re
from typing import Any

from weftline.functions.json_schema import check
from weftline.functions.json_values import minified

MISSING = "[MISSING]"


def similarity(a: str, b: str) -> float:
    """Matching share of two texts (Ratcliff and Obershelp), to 4 places."""
    return round(difflib.SequenceMatcher(None, a, b).ratio(), 4)


def unmatched(truth: str, other: str) -> int:
    """Characters of `truth` outside all blocks that it has in common with `other`."""
    common = sum(m.size for m in difflib.SequenceMatcher(None, truth, other).get_matching_blocks())
    return max(0, len(truth) - common)


def differences(answer: Any, correct: Any) -> tuple[int, int, int, float]:
    """(lines, characters added, characters missing, similarity) of the answer against the correct value. Lines are
    those of indented, sorted JSON; added or removed, whichever are more."""
    a, c = minified(answer), minified(correct)
    if a == c:  # alike in all three measures, as lines and texts are made from the same values in the same order
        return 0, 0, 0, 1.0
    lines = lambda v: json.dumps(v, indent=1, sort_keys=True).split("\n")
    changes = [x for x in list(difflib.unified_diff(lines(correct), lines(answer), n=0, lineterm=""))[2:] if not x.startswith("@@")]
    plus = sum(x.startswith("+") for x in changes)
    against = difflib.SequenceMatcher(None, c, a)
    missing = max(0, len(c) - sum(m.size for m in against.get_matching_blocks()))
    return max(plus, len(changes) - plus), unmatched(a, c), missing, round(against.ratio(), 4)


def postprocessed(text: str) -> Any:
    """The value in a completion, with or without a fence. Raises ValueError if it isn't JSON."""
    return json.loads(re.sub(r"^\s*```(?:json)?|```\s*$", "", text))


def assess(completion: str | None, schema: str | None, correct: str | None, request_error: str | None = None, synthetic_type: str | None = None) -> dict[str, Any]:
    """error_type (request, json, schema, content or null), correct, and the differences. A negative sample, and one
    whose schema is missing, isn't validated. An answer may be correct and yet break the schema."""
    out: dict[str, Any] = {"error_type": None, "correct": False, "schema_ok": None, "diff_lines": None, "chars_added": None, "chars_missing": None, "similarity": None}
    if request_error or completion is None:
        return {**out, "error_type": "request"}
    try:
        answer = postprocessed(completion)
        truth = json.loads(correct or "null")
    except ValueError:
        return {**out, "error_type": "json"}
    out["correct"] = answer == truth
    out["diff_lines"], out["chars_added"], out["chars_missing"], out["similarity"] = differences(answer, truth)
    if synthetic_type != "negative" and schema and schema != MISSING:
        out["schema_ok"] = check(json.dumps(answer), schema) is None
    out["error_type"] = "schema" if out["schema_ok"] is False else None if out["correct"] else "content"
    return out
