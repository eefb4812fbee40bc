"""What a worker remembers of the token ids that it has made: little in a task, and nothing after it."""

import random

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from runlore.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_pieces_of_long_ago_are_forgotten():
    rng, codec, most = random.Random(4), bpe.Codec(RANKS, public_tokenizers.PATTERN), 0
    for _ in range(20):
        text = "the same " + " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(20_000))
        assert [*map(int, next(codec.encode([text])).split())] == TIKTOKEN.encode_ordinary(text)
        most = max(most, len(codec.pieces) + len(getattr(codec, "before", ())))
    assert most < 300_000 and " same" in codec.pieces
    ids = [*codec.encode([text, None, text])]
    codec.forget()
    assert not codec.pieces and not codec.before and [*codec.encode([text, None, text])] == ids


def test_nothing_is_kept_after_a_task(spark):
    """The columns' functions, as a worker runs them."""
    docs = spark.createDataFrame([("some words",)], "text string")
    texts = ["some words and " + random.Random(i).choice("xyz") * 30 for i in range(40)] + [None]
    for make in (bpe.bpe_codes, bpe.bpe_digests):
        run = made_by(make, docs)
        found = [n for part in run(iter([pd.Series(texts[:20]), pd.Series(texts[20:])])) for n in part["n_tokens"]]
        assert found == [len(TIKTOKEN.encode_ordinary(t or "")) for t in texts]
        assert bpe._codecs and not any(c.pieces or c.before or c.vocabulary.adjoining for c in bpe._codecs.values())


def made_by(make, docs):
    """The Python function behind a column."""
    made, given = [], F.pandas_udf
    try:
        F.pandas_udf = lambda kinds: lambda f: made.append(f) or given(f, kinds)
        make(docs, RANKS, public_tokenizers.PATTERN)
    finally:
        F.pandas_udf = given
    return made[0]
