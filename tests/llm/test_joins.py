"""Jaccard components, repeated strings, line dedup: against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from runlore.llm import components, jaccard, line_dedup, suffix_dedup
from runlore.llm.jaccard import Bands

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    words = (text or "").translate(LOWER).encode().split()
    return frozenset(zip(*[words[j:] for j in range(k)])) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(corpus, k, percent):
    """Places of rows by component."""
    sets = [shingles(r[1], k) for r in corpus]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(i)
    return sets, list(groups.values())


@pytest.mark.parametrize(("k", "percent", "broadcast"), [(3, 90, 100_000), (5, 80, 0), (2, 50, 100_000)])
def test_components(docs, corpus, k, percent, broadcast, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST", broadcast)
    sets, groups = brute(corpus, k, percent)
    got = Counter((r.id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, k, percent).collect())
    expected = Counter()
    for g in groups:
        ids = [corpus[i][0] for i in g if corpus[i][0] is not None]
        for i in g:
            own = corpus[i][0]
            expected[(own, len(sets[i]), (min(ids) if ids else None) if sets[i] else own)] += 1
    assert got == expected


def test_one_of_each_component_stays(docs, corpus):
    _, groups = brute(corpus, 5, 80)
    kept = jaccard.drop_near_duplicates(docs, 5, 80)
    assert kept.columns == docs.columns
    wordless = sum(not shingles(r[1], 5) for r in corpus)
    assert kept.count() == wordless + sum(bool(shingles(corpus[g[0]][1], 5)) for g in groups)


def test_texts_without_a_repeated_signature(spark):
    """Runs of texts that meet nothing, and a table of texts of which none meets another."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**12, 60))) for i in range(40)] + [(40, None), (41, "")]
    alone = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = jaccard.jaccard_components(alone, 3, 90).collect()
    assert sorted((r.id, r.component_id) for r in found) == [(i, i) for i in range(42)]
    assert jaccard.drop_near_duplicates(alone, 5, 80).count() == 42


def test_empty_joins(no_docs):
    assert jaccard.jaccard_components(no_docs).count() == 0 and jaccard.drop_near_duplicates(no_docs).count() == 0
    assert suffix_dedup.without_repeats(no_docs).count() == 0 and line_dedup.drop_boilerplate_lines(no_docs).count() == 0


def test_signatures_meet_for_all_linked_sets():
    """Sets that are edits of each other within the bound share a signature, common shingles or not."""
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for size in (5, 9, 12, 25, 60, 200, 700):
            words = [f"t{x}" for x in rng.integers(0, 10**9, size)]
            differ = (100 - percent) * 2 * size // (100 + percent)
            other = words[differ // 2 :] + [f"n{i}" for i in range(differ - differ // 2)]
            sets = jaccard.shingle_sets([" ".join(words), " ".join(other)], 1)
            for common in (np.zeros(0, np.uint64), np.sort(sets.token[::2].copy()), np.sort(np.unique(sets.token))):
                doc, sig = jaccard._signatures(sets, Bands(percent, 1000), common)
                both = set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist())
                x, y = (set(sets.token[sets.doc == d].tolist()) for d in (0, 1))
                if 100 * len(x & y) >= percent * len(x | y) and x != y:
                    assert both, (percent, size)


def test_connected_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000, 1000 + i) for i in range(200)] + [(i, i + 1) for i in range(2000, 2100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeated_strings(docs, corpus, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    raw = [(r[1] or "").encode() for r in corpus]
    seen = Counter(t[p : p + 400] for t in raw for p in range(len(t) - 399))
    short = Counter(t[p : p + 256] for t in raw for p in range(len(t) - 255))
    expected = Counter()
    for r, t in zip(corpus, raw, strict=True):
        gone, reach = bytearray(len(t)), 0
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                start = max(p, reach)
                gone[start : p + 400] = b"\1" * (p + 400 - start)
                reach = p + 400
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        shared = {q for p in range(len(t) - 255) if short[t[p : p + 256]] > 1 for q in range(p, p + 256)}
        expected[(r[0], len(t), sum(gone), spans, len(shared), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())] += 1
    got = Counter(
        (r.id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), sum(s.end - s.start for s in r.passages), hashlib.sha256(r.kept).hexdigest())
        for r in suffix_dedup.without_repeats(docs).collect()
    )
    assert got == expected and sum(n for (_, _, gone, _, _, _), n in got.items() if gone) > 10


def test_anchors_across_chunks(monkeypatch):
    """A text that is taken in several chunks has the anchors and documents that it has in one."""
    data = np.random.default_rng(2).integers(97, 101, 30_000).astype(np.uint8)
    ends = np.array([12_000, 12_100, 30_000])
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.anchors(data, ends), strict=True)]
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 5_000)
    parts = [np.concatenate(x) for x in zip(*suffix_dedup.anchors(data, ends), strict=True)]
    for a, b in zip(whole, parts, strict=True):
        assert (a == b).all()


def test_lines(docs, corpus):
    pages, holders = Counter(r[3] for r in corpus), defaultdict(set)
    for i, r in enumerate(corpus):
        for line in (r[1] or "").split("\n"):
            if line.strip(" "):
                holders[(r[3], line.strip(" "))].add(i)
    bad = {k for k, v in holders.items() if len(v) >= 2 and len(v) > 0.1 * pages[k[0]]}
    expected = Counter()
    for r in corpus:
        lines = r[1].split("\n") if r[1] is not None else []
        kept = [x for x in lines if (r[3], x.strip(" ")) not in bad]
        expected[(r[0], None if r[1] is None else "\n".join(kept), r[4], len(lines), len(lines) - len(kept))] += 1
    cleaned = line_dedup.drop_boilerplate_lines(docs)
    assert Counter((r.doc_id, r.text, r.size, r.n_lines, r.n_removed) for r in cleaned.collect()) == expected and bad
