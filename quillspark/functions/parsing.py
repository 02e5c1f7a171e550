"""Model responses to tags.

A response is what stands outside its thinking spans and its code fence. Three readings are tried on it, and
the first that applies gives the tags: JSON as a whole, the complete strings of a list "tags" that was cut
off, and items of free text. from_json repairs what it can't read in its own way, so the readings are Python
on Arrow batches; a response that several rows share is read once a batch.

Null, empty and blank responses give no tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from json import JSONDecoder

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The key of the list, what parts and surrounds items of free text, and their length.
KEY, APART, AROUND, LONGEST_TAG = "tags", ",;\n", " \"'\t-•", 80

_FENCE = "```"
_MARK = re.compile(r"(</?think>)", re.I)
_OPENING = re.compile(rf'"{KEY}"\s*:\s*\[')
_TO_LINES = str.maketrans(dict.fromkeys(APART, "\n"))
_JSON = JSONDecoder()


def outside_thinking(text: str) -> str:
    """Without thinking spans. A mark that has no partner goes alone."""
    said, thought = [], None
    for k, part in enumerate(_MARK.split(text)):
        if k % 2 == 0:
            (said if thought is None else thought).append(part)
        elif part[1] != "/":
            thought = [] if thought is None else thought
        else:
            thought = None
    return "".join(said + (thought or []))


def outside_fence(text: str) -> str:
    if text.startswith(_FENCE):
        text = text[len(_FENCE) :].removeprefix("json").lstrip()
    return text[: -len(_FENCE)].rstrip() if text.endswith(_FENCE) else text


def _whole(body: str) -> Iterator[str] | None:
    """All of it is JSON: a list, or an object with a list."""
    try:
        value, end = _JSON.raw_decode(body)
    except (ValueError, RecursionError):
        return None
    if body[end:].strip(" \t\r\n"):
        return None
    value = value.get(KEY) if isinstance(value, dict) else value
    return map(str, value) if isinstance(value, list) else None


def _cut_off(body: str) -> Iterator[str] | None:
    """Strings that begin and end after the opening of the list; None if there is none."""
    opening = _OPENING.search(body)
    if not opening:
        return None

    def strings():
        begin = body.find('"', opening.end())
        while begin >= 0 and (end := body.find('"', begin + 1)) >= 0:
            if end == begin + 1:  # nothing between: the second may open the next
                begin = end
            else:
                yield body[begin + 1 : end]
                begin = body.find('"', end + 1)

    found = strings()
    first = next(found, None)
    return None if first is None else (x for part in ((first,), found) for x in part)


def _items(body: str) -> Iterator[str]:
    return (x for line in body.translate(_TO_LINES).split("\n") if 0 < len(x := line.strip(AROUND).strip()) < LONGEST_TAG)


def parse_response(text: str | None, most: int = 30) -> list[str]:
    """Tags of a response in its order. Only free text is cut to `most`."""
    body = outside_fence(outside_thinking(text or "").strip())
    for reading in (_whole, _cut_off):
        if (tags := reading(body)) is not None:
            return [x for tag in tags if (x := tag.strip())]
    return list(islice(_items(body), most))


def parse_responses(c: Column, most: int = 30) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        once = {x: parse_response(x, most) for x in s.dropna().unique()}
        return s.map(lambda x: once.get(x, []))

    return run(c)


def finetuned_tags(c: Column, most: int = 30) -> Column:
    """Thinking removed, parsed, tags normalised, every branch cut to most."""
    from quillspark.functions.text import normalize_tag, remove_thinking

    tags = F.transform(parse_responses(remove_thinking(c), most), normalize_tag)
    return F.slice(F.filter(tags, lambda t: t != ""), 1, most)
