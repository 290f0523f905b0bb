"""The conversation trie against brute force, with ranges, chunks and segments cut small."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchyard.llm import tries

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c in own:
        own[c] = [t[2:] for t in sorted(own[c])]
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        gain = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += gain
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of():
    rng = np.random.default_rng(5)
    say = lambda: str(rng.choice(["hello", "", "ça va 😀", "no", "y" * 50]))
    rows = []
    for c in [*range(0, 40), 100, 101, 102, 205, *range(300, 330)]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ["user", "assistant"][t % 2], say()))
    for c in range(1000, 1040):  # copies, and one opening that most share
        rows += [(c, t, "user", f"the same {t}") for t in range(4)]
    for c in range(1100, 1130):
        rows += [(c, 0, "system", "opening"), (c, 1, "user", f"own {c % 7}"), (c, 2, "user", f"own {c}")]
    for c in (2000, 2001):  # long ones, alike nearly to their end
        rows += [(c, t, "user", f"step {t}" if t < 37 else f"{c}") for t in range(40)]
    rows += [(50, 3, None, "x"), (50, None, "user", None), (50, None, None, "first"), (50, 3, None, "x"), (50, 3, None, "w"), (50, 3, "", "x"), (None, 0, "user", "lost")]
    rows += [(77, 0, "user", "one turn, all of it replaced by none"), (8888, 0, "user", "without a base"), (8889, 0, "user", "without a base")]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA).repartition(5)
    return df.select("*", *(F.lit(1).alias(c) for c in ("n", "at", "path", "end", "part", "row", "own", "depth")))


@pytest.mark.parametrize("sizes", [{}, {"alone": 3, "chunk": 20, "ids": 2}, {"segment": 3, "alone": 4, "chunk": 6, "ids": 1}])
def test_against_brute_force(table, sizes):
    got = tries.prefix_trie(table, **sizes)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows_of())


def test_no_conversations(table):
    assert tries.prefix_trie(table.where("false")).collect() == []
    assert tries.prefix_trie(table.where("conv_id is null")).collect() == []


def test_conversations_without_turns(spark):
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)
    got = tries.prefix_trie(spark.createDataFrame([(c, 0, "user", "gone")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@settings(deadline=None, max_examples=100)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=6), min_size=1, max_size=25))
def test_louds_gives_back_the_trie(sequences):
    entry = lambda x: bytes([x]) * 16 + (x + 1).to_bytes(8, "big")
    paths = sorted({b"".join(map(entry, s)) for s in sequences})
    trie = tries.Trie(paths)
    prefixes = {p[: tries.WIDTH * d] for p in paths for d in range(len(p) // tries.WIDTH + 1)}
    ways = [trie.path_to(i) for i in range(len(trie.degrees))]
    assert sorted(ways) == sorted(prefixes) and [trie.path_to(e) for e in trie.ends] == paths
    assert [len(w) for w in ways] == sorted(len(w) for w in ways)  # level order
    assert all(w[: -tries.WIDTH] == ways[p] for w, p in zip(ways[1:], trie.parent[1:]))
    assert len(trie.bits) == (2 * len(ways) - 1 + 7) // 8
