"""Parts of a JSON document pulled out of its bytes one by one, so that a document may be larger than what is decoded."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .strict_json import BadJson, loads

_BLANKS = re.compile(rb"[ \t\n\r]*+")
_STRING = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
_SCALAR = re.compile(rb'[^ \t\n\r,:"{}\[\]]++')
#: All up to the next bracket that stands in no string.
_TO_BRACKET = re.compile(rb'(?:[^"{}\[\]]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+([{}\[\]])', re.DOTALL)


class Reader:
    """A place in a document of bytes (or any buffer). members() and elements() stop before each value; whoever asks takes
    it with value(), members() or elements() before the next. What isn't strict JSON, a repeated key included, is BadJson,
    at the latest when end() is called. A value is decoded as a whole, nothing else is."""

    def __init__(self, data):
        self.data, self.at = data, 0
        self._skip()

    def opens(self, bracket: bytes) -> bool:
        """Whether the next value is an object (b"{") or array (b"[")."""
        return bytes(self.data[self.at : self.at + 1]) == bracket

    def value(self):
        start, first = self.at, bytes(self.data[self.at : self.at + 1])
        if first in (b"{", b"["):
            open_ = 0
            while True:
                found = _TO_BRACKET.match(self.data, self.at)
                if not found:
                    raise BadJson("not JSON")
                self.at = found.end()
                open_ += 1 if found[1] in (b"{", b"[") else -1
                if not open_:
                    break
        else:
            found = (_STRING if first == b'"' else _SCALAR).match(self.data, self.at)
            if not found:
                raise BadJson("not JSON")
            self.at = found.end()
        try:
            text = str(self.data[start : self.at], "utf-8")
        except UnicodeDecodeError:
            raise BadJson("not JSON") from None
        self._skip()
        return loads(text)

    def members(self) -> Iterator[str]:
        """The keys of an object, each before its value is taken."""
        seen = set()
        for _ in self._parts(b"{", b"}"):
            key = self.value()
            if not isinstance(key, str) or key in seen:
                raise BadJson("repeated key" if isinstance(key, str) else "not JSON")
            seen.add(key)
            self._take(b":")
            yield key

    def elements(self) -> Iterator[None]:
        """Stops before each element of an array."""
        return self._parts(b"[", b"]")

    def end(self) -> None:
        if self.at != len(self.data):
            raise BadJson("text after the value")

    def _parts(self, first: bytes, last: bytes) -> Iterator[None]:
        self._take(first)
        if not self.opens(last):
            yield
            while self.opens(b","):
                self._take(b",")
                yield
        self._take(last)

    def _take(self, what: bytes) -> None:
        if not self.opens(what):
            raise BadJson("not JSON")
        self.at += 1
        self._skip()

    def _skip(self) -> None:
        self.at = _BLANKS.match(self.data, self.at).end()
