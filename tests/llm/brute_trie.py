"""The trie's nodes in plain Python."""

import hashlib
import math
import zlib
from collections import defaultdict


def rebuilt(rows):
    """Sequences by conversation from rows (conv_id, turn, role, text); remainders have the sign of the id, as in SQL."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:24] + f"{len(text.encode()):08x}"
            own[c].append(((turn is not None, turn or 0), digest, (role, text)))
    ordered = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in ordered.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = ordered.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    return out


def nodes(sequences):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in sequences.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = children[p]
        leaves[p] = sum(leaves[k] for k in kids) if kids else 1
        saved[p] = sum(saved[k] for k in kids) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    ]
