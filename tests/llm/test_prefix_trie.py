"""The prefix trie against plain Python; the tree's layouts."""

import random
from collections import Counter

import pytest

from runlore.llm import prefix_trie, queries
from runlore.llm.prefix_trie import Node, conversation_keys, prefix_nodes, reach, with_shared_starts

from .brute_trie import nodes, rebuilt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, digest string, depth int"


def trie(df):
    return Counter(map(tuple, prefix_nodes(with_shared_starts(conversation_keys(df))).collect()))


@pytest.fixture(scope="module")
def conversations():
    """Common first turns, copies, prefixes of each other, nulls, ties, repeated rows, a long conversation, negative ids."""
    rng = random.Random(4)
    rows = []
    for c in range(-7, 260):
        if c % 11 == 3:
            continue  # absent, bases among them
        n = rng.choice([0, 1, 2, 3, 6, 12])
        turns = [("user" if i % 2 == 0 else "assistant", "hello é" if rng.random() < 0.6 else f"text {rng.randrange(3)}") for i in range(n)]
        rows += [(c, i, r, t, "x", 1) for i, (r, t) in enumerate(turns)]
    rows += [(c, i, "user", f"copied {i}", None, 2) for c in range(300, 420) for i in range(10)]  # one conversation very often
    rows += [(500, i, "user", f"long {i % 7}", None, None) for i in range(3000)]
    rows += [(501, i, "user", f"long {i % 7}", None, None) for i in range(2500)]
    rows += [(600, None, None, None, None, None), (600, None, "user", "", None, None), (600, 0, None, "x", None, None), (600, 0, None, "x", None, None)]
    rows += [(601, 5, "", "", None, None), (602, 1, "user", "tie b", None, None), (602, 1, "user", "tie a", None, None), (None, 0, "user", "no conversation", None, None)]
    return rows


@pytest.mark.parametrize(("keys", "spines", "broadcast"), [(40_000, 4_000, 50_000), (7, 4, 0), (1, 9, 50_000)])
def test_nodes(spark, conversations, monkeypatch, keys, spines, broadcast):
    """One shard, and many whose spines are merged in several turns."""
    monkeypatch.setattr(prefix_trie, "SHARD_KEYS", keys)
    monkeypatch.setattr(prefix_trie, "SHARD_SPINES", spines)
    monkeypatch.setattr(prefix_trie, "BROADCAST", broadcast)
    df = spark.createDataFrame(conversations, SCHEMA).repartition(3)
    assert trie(df) == Counter(nodes(rebuilt([r[:4] for r in conversations])))


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie(empty) == Counter()
    only_null = spark.createDataFrame([(None, 1, "user", "x", None, None)], SCHEMA)
    assert trie(only_null) == Counter()


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = queries.op12_prefix_trie(spark, sf)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint"] * 7 + ["string"]
    assert Counter(map(tuple, found.collect())) == Counter(nodes(rebuilt(rows)))


def test_layouts_grow():
    """Children are found and come in order in every layout; paths are cut where keys part."""
    rng = random.Random(2)
    for n in (3, 4, 5, 16, 17, 48, 49, 256):
        node, order = Node(b""), rng.sample(range(256), n)
        for b in order:
            node.put(b, Node(bytes([b])))
        assert [c.path[0] for c in node.children()] == sorted(order)
        assert all((node.find(b) is not None) == (b in order) for b in range(256))
        kind = 256 if n > 48 else 48 if n > 16 else 16
        assert len(node.places) == 256 if kind == 256 else len(node.bytes) == (256 if kind == 48 else n)
    root = Node(b"")
    keys = [bytes(rng.randrange(3) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    for k in keys:
        reach(root, k, 0, len(k)).value = k
    found, open_ = set(), [(root, b"")]
    while open_:
        node, before = open_.pop()
        whole = before + node.path
        assert node.value in (None, whole)
        found |= {whole} if node.value else set()
        assert node is root or node.value or len(list(node.children())) > 1
        open_ += [(c, whole) for c in node.children()]
    assert found == set(keys)
