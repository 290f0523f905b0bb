"""Windows without padding: sums and places against brute force, whole tables against the tokenizer."""

import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchyard.llm import packing, slack
from matchyard.llm.base import documents

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def laid_out(places):
    """Of each sequence the (offset, length) in it, of each piece the (start, length) of its parts."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for p in places:
        for i in range(p.count):
            nth = p.first + i
            sequences[p.base + nth // p.copies].append((p.offset + nth % p.copies * p.length, p.length))
            pieces[p.origin, p.rank + i].append((p.start, p.length))
    return sequences, pieces


def gapless(spans):
    at = 0
    for start, length in sorted(spans):
        assert start == at and length > 0
        at += length
    return at


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 9), max_size=7))
def test_every_token_lies_in_one_window_and_none_is_padded(counts):
    places, n = slack.minimum_slack(counts, 16)
    sequences, pieces = laid_out(places)
    assert sorted(sequences) == list(range(n))
    lengths = Counter(gapless(s) for s in sequences.values())
    total = sum(x * k for x, k in counts.items())
    assert lengths == Counter([16] * (total // 16) + [1 << b for b in range(4) if total % 16 >> b & 1])
    assert Counter(length for length, _ in pieces) == Counter(counts)
    for (length, _), parts in pieces.items():
        assert gapless(parts) == length


@settings(deadline=None, max_examples=200)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), min_size=1, max_size=4), st.integers(0, 40))
def test_the_filling_is_the_fullest_there_is(left, room):
    found = slack.fullest(sorted(left), left, room)
    assert len({x for x, _ in found}) == len(found) and all(0 < n <= left[x] for x, n in found)
    sums = (sum(x * n for x, n in zip(left, take)) for take in product(*(range(n + 1) for n in left.values())))
    assert sum(x * n for x, n in found) == max(s for s in sums if s <= room)


def test_pieces_are_cut_only_where_none_fits():
    places, n = slack.minimum_slack({10: 3, 6: 5, 3: 2}, 16)
    assert n == 5 and sum(p.count for p in places) == 3 + 5 + 2 + 1  # 10 + 6 three times; 6 + 6 + 3 and 1 of a 3; its other 2
    assert slack.minimum_slack({3000: 10**9}, 4096)[1] >= 3000 * 10**9 // 4096  # counts, not pieces, are worked on
    assert slack.minimum_slack({}, 16) == ([], 0)


def check_whole(rows, got, capacity):
    ids = {}
    for i, (doc, text, *_) in enumerate(rows):
        ids[i] = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, slack.END], "<u4")
    by_doc, expected = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for i, (doc, *_) in enumerate(rows):
        expected[doc].append(ids[i])
    assert by_doc.keys() == expected.keys()
    for doc, pieces in by_doc.items():
        assert sum(p[1] for p in pieces) == sum(map(len, expected[doc]))
        for start, length, crc, tokens in pieces:
            assert any(len(e) == tokens and zlib.crc32(e[start : start + length].tobytes()) == crc for e in expected[doc])
        if len(expected[doc]) == 1:
            assert gapless((s, n) for s, n, *_ in pieces) == len(expected[doc][0])
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    lengths = Counter(gapless(s) for s in sequences.values())
    total = sum(map(len, ids.values()))
    assert lengths == Counter([capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1) if total % capacity >> b & 1])


@pytest.mark.parametrize("capacity", [64, 4096])
def test_odd_texts(spark, capacity):
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "Ünï 中文 😀 <|endoftext|> \x01"), (4, "the same id"), (None, "no id"), (5, "again"), (5, "again"), (6, "word " * 9000), (7, "a" * 3000)]
    rows += [(10 + i, f"text {i} " * (1 + i % 40)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.select("*", *(F.lit(9).alias(c) for c in ("row", "part", "nth", "length", "before", "rank", "ids", "start")))
    check_whole(rows, slack.pack(docs, capacity=capacity).collect(), capacity)
    empty = slack.pack(docs.where("false"), capacity=capacity)
    assert empty.collect() == [] and empty.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_whole_table_with_ids(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    got = slack.pack(docs, payload=True).collect()
    check_whole([(r["doc_id"], r["text"]) for r in docs.collect()], got, 4096)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
