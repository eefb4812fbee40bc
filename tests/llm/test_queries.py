"""The contract columns of the queries over the smallest tables, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import duckdb
import public_tokenizers
import pytest
import tiktoken

from runlore.llm import bpe, queries
from runlore.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}


def held(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n == 0


def kinds(df, n):
    return [x.simpleString() for x in df.schema.fields[:n]]


def test_op1(spark, texts):
    df = queries.op1_toxicity(spark, SF)
    assert kinds(df, 4) == ["doc_id:bigint", "held_out:boolean", "score:double", "predicted:int"]
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == held(r.doc_id, 5) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op2(spark, texts):
    df = queries.op2_suffix_dedup(spark, SF)
    assert kinds(df, 5) == ["doc_id:bigint", "n_bytes:bigint", "n_removed:bigint", "n_spans:bigint", "kept_sha256:string"]
    raw = {i: t.encode() for i, t in texts.items()}
    long, short = (Counter(t[p : p + n] for t in raw.values() for p in range(len(t) - n + 1)) for n in (400, 256))
    covered = lambda t, seen, n: {q for p in range(len(t) - n + 1) if seen[t[p : p + n]] > 1 for q in range(p, p + n)}
    for r in df.collect():
        t = raw[r.doc_id]
        gone, shared = covered(t, long, 400), covered(t, short, 256)
        assert (r.n_bytes, r.n_removed, r.n_passage_bytes, r.has_passage) == (len(t), len(gone), len(shared), int(bool(shared)))
        assert r.n_spans == sum(p - 1 not in gone for p in gone)


def test_op3(spark):
    df = queries.op3_html_text(spark, SF)
    assert kinds(df, 4) == ["page_id:bigint", "url:string", "text:string", "n_chars:bigint"]
    rows = df.collect()
    assert len(rows) == table(spark, SF, "pages").count() and all(r.n_chars == len(r.text) and r.text == r.text.strip() for r in rows)


@pytest.mark.parametrize("name", ["op4_line_dedup", "op5_jaccard", "op9_top_k"])
def test_against_sql(spark, name):
    """Queries with SQL, over the smallest tables, against DuckDB's rows."""
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(rows)


def test_op6(spark, texts):
    df = queries.op6_bpe(spark, SF)
    assert kinds(df, 4) == ["doc_id:bigint", "n_tokens:bigint", "ids_sha256:string", "decoded_sha256:string"]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    for r in df.collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids)).encode()), digest(texts[r.doc_id].encode()))


def test_op7(spark, texts):
    df = queries.op7_quality(spark, SF)
    assert kinds(df, 6) == ["doc_id:bigint", "n_words:bigint", "word_chars:bigint", "n_symbols:bigint", "n_dup_lines:bigint", "n_repeat_words:bigint"]
    rows = df.collect()
    assert len(rows) == len(texts) and {r.kept for r in rows} == {True, False}
    for r in rows:
        t = texts[r.doc_id]
        words = WORD.findall(t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = Counter(windows)
        repeated = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
        lines = t.split("\n")
        doubles = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), doubles, len(repeated), failed)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected and not (failed and r.kept)


def test_op8(spark, texts):
    df = queries.op8_mixing(spark, SF)
    assert kinds(df, 5) == ["doc_id:bigint", "size:bigint", "source_size:bigint", "target:double", "taken:bigint"]
    rows, source = df.collect(), {r.doc_id: r.source for r in table(spark, SF, "documents").collect()}
    assert len(rows) == len(texts)
    taken, target, sizes = Counter(), {}, {}
    for r in rows:
        assert r.size == len(WORD.findall(texts[r.doc_id])) and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        sizes.setdefault(source[r.doc_id], []).append(r.size)
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(sizes[s]) / 2 + 1, s  # words stay the same until the last document is rounded
    assert sum(target.values()) == pytest.approx(1.5 * sum(map(sum, sizes.values())))


def test_op10(spark, texts):
    df = queries.op10_lm_score(spark, SF)
    assert kinds(df, 7) == [
        "doc_id:bigint", "held_out:boolean", "n_tokens:bigint", "n_known:bigint", "train_tokens:bigint", "base_score:double", "score:double",
    ]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: [*WORD.findall(t.translate(lower)), None] for i, t in texts.items()}
    counts = Counter(w for i, t in tokens.items() if not held(i, 10) for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in df.collect():
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id, 10), len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)) and r.score < 0
