"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a byte string is valid BPE, and it ends in one token that the prefix fixes. So an
array with each prefix's last token is the whole encoding: following it backwards gives the tokens of any prefix. The
last token of a prefix is the one token ending there whose predecessor, the last token of the shorter prefix, may
stand before it; whether two tokens may stand side by side is decided by undoing their merges. Entries depend on no
more bytes than the longest token has, so appending only adds entries, and an edit changes entries only from its
start to where as many entries agree with the old ones again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let_go
from .hashed_text import text_runs

#: Pairs of tokens that a worker remembers at most in a task; pieces of text after which those of before are forgotten that
#: were not met since; characters of texts that are split at once.
MOST_PAIRS, MOST_PIECES, RUN = 700_000, 120_000, 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class Vocabulary:
    """Ranks of tokens, which must hold every single byte; a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        #: Tokens that merges lead to; others stand for a whole match only.
        self.reached: dict[bytes, int] = {}
        #: Pairs of tokens (as one number) that were looked at before, and whether they may stand side by side.
        self.adjoining: dict[int, bool] = {}
        self.width = max(ranks.values()).bit_length()
        #: By last byte, the lengths of tokens that end in it, short ones first.
        ends: dict[int, set[int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            ends.setdefault(token[-1], set()).add(len(token))
            pair = self._merged_from(token, rank)
            self.halves[rank] = pair or (rank, rank)
            if pair:
                self.joined[pair] = rank
            if pair or len(token) == 1:
                self.reached[token] = rank
        self.ends = {byte: sorted(lengths) for byte, lengths in ends.items()}

    def _merged_from(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and tokens that merges don't lead to."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], rank))
            if self.ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def may_adjoin(self, left: int, right: int) -> bool:
        """Whether left then right is the encoding of their bytes. Goes back through the two tokens' merges, latest
        first, and looks whether the pieces that meet at the border would have merged with each other before."""
        until = len(self.tokens) + 1
        while True:
            both = self.joined.get((left, right))
            if both is not None and both < until:
                return False
            inner, outer = self.halves[left][1], self.halves[right][0]
            if inner == left and outer == right:
                return True
            # of equal merges the left one goes first, so a merge at the border of the right token's rank comes late
            if outer == right or inner != left and left > right:
                until, left = left, inner
            else:
                until, right = right + 1, outer


class PrefixEncoding:
    """The encoding of a byte string that grows and changes. last[i] is the last token of the first i bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        self._extend(start + 1, len(self.data) + 1)

    def become(self, data: bytes) -> None:
        """Other data; entries of the prefix that both share stay."""
        shared = min(len(data), len(self.data))
        if self.data[:shared] != data[:shared]:
            shared = next(i for i, (a, b) in enumerate(zip(self.data, data)) if a != b)
        del self.last[shared + 1 :]
        self.data = data
        self._extend(shared + 1, len(data) + 1)

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Puts data in place of bytes start to stop; returns how many entries were computed anew."""
        if not 0 <= start <= stop <= len(self.data):
            raise ValueError("not a range of the data")
        old, shift = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last, agree = old[: start + 1], 0
        for end in range(start + 1, len(self.data) + 1):
            self._extend(end, end + 1)
            agree = agree + 1 if end > start + len(data) and self.last[end] == old[end - shift] else 0
            if agree >= self.vocabulary.longest:
                self.last += old[end - shift + 1 :]
                return end - start
        return len(self.data) - start

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first end bytes, of all without end."""
        end, out = len(self.data) if end is None else end, []
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]

    def _extend(self, start: int, stop: int) -> None:
        """The entries from start to before stop. One token only fits each, so short ones are tried first."""
        data, last, v = self.data, self.last, self.vocabulary
        ends, rank_of, known, width = v.ends, v.reached.get, v.adjoining, v.width
        for end in range(start, stop):
            for length in ends[data[end - 1]]:
                if length >= end:
                    token = rank_of(data[:end]) if length == end else None
                    if token is None:
                        raise ValueError("the vocabulary lacks a byte")
                    last.append(token)
                    break
                token = rank_of(data[end - length : end])
                if token is None:
                    continue
                pair = last[end - length] << width | token
                fits = known.get(pair)
                if fits is None:
                    if len(known) >= MOST_PAIRS:
                        known.clear()
                    fits = known[pair] = v.may_adjoin(last[end - length], token)
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")


class Codec:
    """Whole texts to token ids and back. Each match of the pattern is encoded by itself and remembered; those that are
    new in a batch are encoded in sorted order, so that each takes over the entries of the prefix it shares with the
    one before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        #: Decimal ids, joined by spaces, of pieces met lately, and of those met before.
        self.pieces: dict[str, str] = {}
        self.before: dict[str, str] = {}
        self.token = {str(i): t for i, t in self.vocabulary.tokens.items()}

    def encode(self, texts: Iterable[str | None]) -> Iterator[str]:
        """Of each text (null: empty) the decimal ids, joined by spaces."""
        for run in text_runs(texts, RUN):
            parts = [self.split(t or "") for t in run]
            if len(self.pieces) > MOST_PIECES:
                self.before, self.pieces = self.pieces, {}
            walk = PrefixEncoding(self.vocabulary)
            for piece in sorted(set().union(*parts) - self.pieces.keys()):
                self.pieces[piece] = self.before.get(piece) or self._ids(piece, walk)
            for part in parts:
                yield " ".join(map(self.pieces.__getitem__, part))

    def _ids(self, piece: str, walk: PrefixEncoding) -> str:
        data = piece.encode("utf-8", "replace")
        whole = self.vocabulary.ranks.get(data)
        if whole is not None:
            return str(whole)
        walk.become(data)
        return " ".join(map(str, walk.tokens()))

    def forget(self) -> None:
        """Lets pieces and pairs go. The vocabulary stays, as it takes a second to build."""
        self.pieces, self.before = {}, {}
        self.vocabulary.adjoining = {}

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.split()))


def bpe_codes(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> Column:
    """A struct column of a whole text (null: empty): n_tokens, token_ids (array<int>), decoded (binary; equals the
    text's bytes). The vocabulary has a fixed size and is broadcast."""
    shared, name = df.sparkSession.sparkContext.broadcast((ranks, pattern)), _name(ranks, pattern)

    @F.pandas_udf("n_tokens bigint, token_ids array<int>, decoded binary")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            codec = _codec(shared, name)
            rows = [(len(x), x, codec.decode(s)) for s in codec.encode(texts) for x in [np.fromstring(s, np.int32, sep=" ")]]
            yield pd.DataFrame(rows, columns=["n_tokens", "token_ids", "decoded"])
        _forget()

    return coded.asNondeterministic()(F.col(text))


def bpe_digests(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> Column:
    """A struct column of a whole text (null: empty): n_tokens, ids_sha256 (of the decimal ids joined by one space),
    decoded_sha256 (of the bytes that the ids decode to), without moving ids and bytes out of the workers."""
    shared, name = df.sparkSession.sparkContext.broadcast((ranks, pattern)), _name(ranks, pattern)

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(list(_digests(_codec(shared, name), texts)), columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        _forget()

    return digests.asNondeterministic()(F.col(text))


def _digests(codec: Codec, texts: pd.Series) -> Iterator[tuple[int, str, str]]:
    for ids in codec.encode(texts):
        decoded = hashlib.sha256(codec.decode(ids)).hexdigest()
        yield (ids.count(" ") + 1 if ids else 0), hashlib.sha256(ids.encode()).hexdigest(), decoded


def _name(ranks: dict[bytes, int], pattern: str) -> str:
    """The same for the same vocabulary and pattern alone."""
    return hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()


#: Of a Python worker, as building the merge tables takes a second: the codec that it used last.
_codecs: dict[str, Codec] = {}


def _codec(shared, name: str) -> Codec:
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(*shared.value)
    return _codecs[name]


def _forget() -> None:
    """At a task's end: idle workers stay beside their executor, and later stages need the memory."""
    for codec in _codecs.values():
        codec.forget()
    let_go()
