"""Strict JSON: whole values only, no NaN, bounded depth; and one canonical spelling."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

MAX_DEPTH = 64
_BLANKS = re.compile(r"[ \t\n\r]*")
_scan_string = json.decoder.scanstring


class BadJson(ValueError):
    """The text is no JSON value of the kind that is asked for. Carries no input."""


def _no_constant(_name: str):
    raise BadJson("number is not finite")


_lenient = json.JSONDecoder(parse_constant=_no_constant)


def _unique(pairs: list[tuple]) -> dict:
    made = dict(pairs)
    if len(made) != len(pairs):
        raise BadJson("repeated key")
    return made


_unique_keys = json.JSONDecoder(parse_constant=_no_constant, object_pairs_hook=_unique)


def depth(value: object) -> int:
    """Nested arrays and objects of a value."""
    deepest, level = 0, [value]
    while level:
        level = [c for v in level if isinstance(v, (dict, list)) for c in (v.values() if isinstance(v, dict) else v)]
        deepest += 1
    return deepest - 1


def loads(text: str, unique: bool = True) -> object:
    """The value of a text that is one JSON value and nothing else; unique: keys of an object may not repeat."""
    try:
        value, end = (_unique_keys if unique else _lenient).raw_decode(text, _BLANKS.match(text).end())
    except (ValueError, RecursionError):
        raise BadJson("not JSON") from None
    if _BLANKS.match(text, end).end() != len(text):
        raise BadJson("text after the value")
    return value


def members(text: str) -> Iterator[tuple[str, object, str]]:
    """Key, value and the value's own text of each member of a text that is one JSON object, repeats included."""
    skip = lambda i: _BLANKS.match(text, i).end()
    at = skip(0)
    if text[at : at + 1] != "{":
        raise BadJson("not an object")
    at, first = skip(at + 1), True
    while True:
        if text[at : at + 1] == "}" and first:
            break
        if text[at : at + 1] != '"':
            raise BadJson("not JSON")
        try:
            key, at = _scan_string(text, at + 1, True)
            at = skip(at)
            if text[at : at + 1] != ":":
                raise BadJson("not JSON")
            start = skip(at + 1)
            value, end = _lenient.raw_decode(text, start)
        except (ValueError, RecursionError):
            raise BadJson("not JSON") from None
        yield key, value, text[start:end]
        at, first = skip(end), False
        if text[at : at + 1] == "}":
            break
        if text[at : at + 1] != ",":
            raise BadJson("not JSON")
        at = skip(at + 1)
    if skip(at + 1) != len(text):
        raise BadJson("text after the value")


def canonical(value: object) -> str:
    """Sorted keys, no blanks, characters as they are, finite numbers."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
