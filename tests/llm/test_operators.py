"""The corpus operators against brute force, on odd rows: nulls, empty and long texts, ties, repeats, extra columns."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchyard.llm import components as component_module
from matchyard.llm import jaccard, language, lm, mixing, packing, quality, suffixes, tiles, topk, toxicity
from matchyard.llm.base import documents
from matchyard.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
#: Names that the operators use inside.
CLASHES = ("row", "key", "n", "fp", "size", "at", "one", "before", "k1", "_k1", "token", "a", "b", "score", "_keep_0", "target", "word", "tf")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus():
    rng = np.random.default_rng(4)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(400)] + ["É", "naïve", "中文", "😀", "don't", "A.B", "x" * 300]
    draw = lambda n: [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)]
    texts = [" ".join(draw(int(n))) for n in rng.integers(1, 260, 40)]
    base = draw(120)
    for i in range(75):  # a group of near copies, longer than a short list
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 4))):
            words[at] = f"edit{i}x{at}"
        texts.append(" ".join(words))
    passage = " ".join(draw(60))
    texts += [" ".join(draw(30)) + "\n" + passage + "\t" + " ".join(draw(25)) for _ in range(12)]
    for n in range(5, 26):  # small sets, near and equal
        words = draw(n + 4)
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join(words[1:]), "  ".join(words).upper()]
    texts += [texts[3]] * 5 + ["", None, " \n\t ", "one", "One", "one two", "!!!", "a" * 5000, "ab" * 3000, " ".join(draw(9000)), "é" * 400]
    rows = [(i * 3, t, "en" if i % 3 else None, None if i % 11 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "a row without an id", None, None, 0)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_packing_round_trip(docs, rows):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(path("word_bpe_49k.json")).encode
    expected, ids_of = Counter(), defaultdict(bytes)
    for doc, text, *_ in rows:
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected[doc, p, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.pack(docs, payload=True).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        ids_of[r["sequence_id"]] += b""
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(by) == packing.lower_bound(Counter(r["length"] for r in got), 2048)


def test_bin_completion_beats_or_equals_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(150):
        counts = Counter(int(x) for x in rng.integers(1, 60, rng.integers(1, 25)))
        found = packing.bin_completion(counts, 60)
        used = Counter()
        for pattern, times in found:
            assert sum(k * c for k, c in pattern) <= 60
            for k, c in pattern:
                used[k] += c * times
        assert used == counts
        n, fit = sum(t for _, t in found), sum(t for _, t in packing.best_fit(counts, 60))
        assert packing.lower_bound(counts, 60) <= n <= fit
    # best-fit decreasing takes three sequences of 10 for 5, 4, 3, 3, 3, 2; two are enough
    assert sum(t for _, t in packing.bin_completion({5: 1, 4: 1, 3: 3, 2: 1}, 10)) == 2


def fewest(lengths, capacity):
    """Sequences of an optimal packing, by trying everything."""
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            put(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best


def test_bin_completion_is_optimal_without_a_bound():
    rng = np.random.default_rng(21)
    better = 0
    for _ in range(300):
        lengths = sorted((int(x) for x in rng.integers(3, 19, rng.integers(4, 11))), reverse=True)
        n = sum(t for _, t in packing.bin_completion(Counter(lengths), 20, None))
        assert n == fewest(lengths, 20), lengths
        better += n < sum(t for _, t in packing.best_fit(Counter(lengths), 20))
    assert better


def test_bin_completion_beats_best_fit_on_a_table(spark):
    docs = spark.createDataFrame([(i, " ".join(["a"] * (n - 1))) for i, n in enumerate((5, 4, 3, 3, 3, 2))], "doc_id long, text string")
    got = packing.pack(docs, capacity=10).collect()
    assert len({r["sequence_id"] for r in got}) == 2 and sum(t for _, t in packing.best_fit(Counter(r["length"] for r in got), 10)) == 3


def test_words_are_encoded_as_in_the_text():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t, encoder = Tokenizer.from_file(path("word_bpe_49k.json")), packing.Encoder(path("word_bpe_49k.json"))
    rng = np.random.default_rng(3)
    parts = ["long", "wörter", "aé", *"aÉß'S1٣.,!\x01\x00\x1c\x85\xa0 ́ΣςΑİ中🙂‍<|>", " ", "\n", "\x0b", "<|endoftext|>", "<|ENDOFTEXT|>", "'re", "J̌", "क़"]
    for _ in range(3000):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 30)))
        raw = text.encode()
        raw = raw if b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw else raw.lower()
        known = {}
        packing.learn(encoder, set(raw.split()), known)
        assert b"".join(known[w] for w in raw.split()) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def sets_of(rows):
    out = []
    for _, text, *_ in rows:
        w = WORD.findall(lower(text))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def test_jaccard_join(docs, rows):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    expected = Counter((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect())
    assert got == expected


def test_packed_sets():
    for n in (1, 2, 5, 300, 70_000):
        tokens = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
        assert (jaccard.unpacked(jaccard.packed(tokens)) == tokens).all()


def test_small_boundary_follows_cost():
    assert jaccard.boundary({5: 100, 9: 100, 14: 100}, 0.0) < jaccard.boundary({5: 100, 9: 100, 14: 100}, 1000.0) == jaccard.MOST_SMALL


@pytest.mark.parametrize("at_once", [1_000_000, 0])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(component_module, "AT_ONCE", at_once)
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(900, i) for i in range(901, 960)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    assert {(r["node"], r["component"]) for r in components(df).collect()} == {(x, find(x)) for x in linked}


def vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16))
    v = [base[i % 40] * rng.uniform(0.5, 2) + rng.normal(size=16) * [0, 0.02, 0.05, 0.2][i % 4] for i in range(400)]
    rows = [(i, [float(x) for x in x], [0, 1, None][i % 3] if i % 7 else 0) for i, x in enumerate(v)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, float("inf"), 0.0], [1.0, None], [1.0], [1e200] * 16]
    rows += [(400 + 50 * i, x, 0) for i, x in enumerate(odd)] + [rows[5], rows[50], (None, rows[7][1], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("row", "v", "pivot", "ring", "part", "tile", "n_links", "component")})


def usable(x):
    return x is not None and all(c is not None and np.isfinite(c) for c in x)


def test_top_k(spark):
    rows, df = vectors(spark)
    df = df.where("embedding is null or not exists(embedding, x -> abs(x) > 1e100)")
    good = [(i, np.array([int(np.floor(256 * c)) for c in x] + [0] * (16 - len(x)), object)) for i, x, _ in rows if i is not None and usable(x) and not any(abs(c) > 1e100 for c in x)]
    expected = set()
    for q in {i for i, _ in good if i % 50 == 0}:
        mine = max((tuple(x), k) for k, (i, x) in enumerate(good) if i == q)[1]
        hits = sorted((-int(good[mine][1] @ x), i) for i, x in good if i != q)[:5]
        expected |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)}
    for annulus, pivots in ((1024, 48), (16, 5)):
        got = [tuple(r) for r in topk.search(df, annulus=annulus, pivots=pivots).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    assert topk.search(df.limit(0)).count() == 0


def test_products_beyond_floating_point():
    a = np.array([[2.0**40, 3.0]])
    assert topk.products(a, np.array([[2.0**14, 1.0]]))[0, 0] == 2**54 + 3


def test_near_duplicate_vectors(spark):
    rows, df = vectors(spark)
    live = [k for k, (_, x, label) in enumerate(rows) if usable(x) and any(c != 0 for c in x) and label is not None]
    unit = {k: np.array(rows[k][1] + [0.0] * (16 - len(rows[k][1]))) for k in live}
    unit = {k: v / np.abs(v).max() for k, v in unit.items()}
    links, parent = Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(live, 2):
        if rows[i][2] == rows[j][2] and unit[i] @ unit[j] / np.sqrt((unit[i] @ unit[i]) * (unit[j] @ unit[j])) >= 0.98:
            links[i] += 1
            links[j] += 1
            parent[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    expected = Counter((r[0], links[k], least.get(find(k)) if links[k] else r[0]) for k, r in enumerate(rows))
    for tile in (1024, 16):
        got = tiles.near_duplicates(df, tile=tile).collect()
        assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == expected
        assert all(r["kept"] == (r["vec_id"] == r["component_id"] or r["component_id"] is None) for r in got)
    assert tiles.near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, s, e = tiles.quantise(x)
    rough = (c * s[:, None]) @ (c * s[:, None]).T
    bound = (1 + e)[:, None] * e + (1 + e) * e[:, None] + e[:, None] * e
    assert (np.abs(rough - x @ x.T) <= bound).all() and bound.max() < 0.1


def brute_spans(texts):
    seen = Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199))
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        yield gone


@pytest.mark.parametrize("hot, bits, shown", [((4096, 65_536), (18, 29), 1), ((2, 2), (18, 29), 64), ((2, 2), (6, 8), 1)])
def test_suffixes(docs, rows, monkeypatch, hot, bits, shown):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "FILTER_BITS", bits)
    monkeypatch.setattr(suffixes, "SHOWN", shown)
    texts = [(r[1] or "").encode() for r in rows]
    expected = Counter()
    for r, b, gone in zip(rows, texts, brute_spans(texts)):
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        starts = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        expected[r[0], len(b), int(gone.sum()), starts, hashlib.sha256(rest).hexdigest()] += 1
    got = suffixes.remove_repeats(docs, keep=("lang", "row")).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == expected
    assert all(r["row"] == 0 for r in got)


def suffix_rows(rows):
    import pyarrow as pa

    return [pa.RecordBatch.from_arrays([pa.array([r[i]], t) for i, t in enumerate(suffixes._RUN_TYPES)], names=suffixes._RUN_NAMES) for r in rows]


def test_suffix_buckets_in_small_batches(monkeypatch):
    rng = np.random.default_rng(8)
    body = bytes(rng.integers(97, 100, 260).astype(np.uint8))
    other = lambda: body[:32] + bytes(rng.integers(97, 123, 228).astype(np.uint8))
    rows = [(0, g, bytes([g]) * 32, 0, 1000 + g * 10 + min(k, 1), k, g, 0, 61, 0, True, body if k < 2 else other()) for g in range(6) for k in range(4)]
    monkeypatch.setattr(suffixes, "AT_ONCE", 1)
    got = sorted((r["k2"], r["k1"], r["a"], r["b"]) for b in suffixes._sort_buckets(iter(suffix_rows(rows))) for r in b.to_pylist() if r["edge"] is None)
    assert got == sorted((g, k, 0, 260) for g in range(6) for k in range(2))


def test_equal_suffixes_on_both_sides_of_a_boundary(spark):
    body = bytes(range(97, 117)) * 10
    found = []
    for bucket in (3, 4):  # as if a splitter parted equal leading tokens
        rows = [(bucket, 1, body[:32], 0, 5, bucket, 9, 40, 1, 0, True, body)]
        found += [r for b in suffixes._sort_buckets(iter(suffix_rows(rows))) for r in b.to_pylist()]
    got = suffixes.across_buckets(spark.createDataFrame(found, suffixes._FOUND)).collect()
    assert sorted(tuple(r) for r in got) == [(3, 9, 40, 240), (4, 9, 40, 240)]


def test_equal_hashes_of_different_runs_are_told_apart():
    one, two = b"a" * 32 + b"x" * 168, b"a" * 32 + b"y" * 168
    rows = [(0, 1, b"a" * 32, 0, 5, k, 9, 0, 1, 0, True, body) for k, body in enumerate((one, two, one))]
    got = [(r["k1"], r["a"], r["b"]) for b in suffixes._sort_buckets(iter(suffix_rows(rows))) for r in b.to_pylist() if r["edge"] is None]
    assert sorted(got) == [(0, 0, 200), (2, 0, 200)]


def test_multikey_quicksort():
    rng = np.random.default_rng(9)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1000:1400] = text[2000:2400]
    at, group = np.arange(2900), rng.integers(0, 3, 2900)
    group[1000:1400] = group[2000:2400]
    for length in (8, 20, 61, 200):
        some = at[: 3000 - length][:2900]
        order, same = suffixes.multikey_quicksort(suffixes.tokens_at(text), some, group[: len(some)], length)
        keys = [(group[i], text[some[i] : some[i] + length].tobytes()) for i in order]
        assert sorted(order) == list(range(len(some))) and keys == sorted(keys)
        assert [False, *(x == y for x, y in zip(keys, keys[1:]))] == same.tolist()


def test_mixing(docs, rows):
    got = mixing.mix(docs, keep=("row",)).collect()
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    total, order = sum(sizes.values()), [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = {}
    while True:  # reshare the excess until none is above
        free = [s for s in order if s not in capped]
        share = {s: (total - sum(capped.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    target = capped | share
    assert len(got) == len(rows)
    # rows of one source are told apart by their source's size and target
    want = Counter((r[0], len(WORD.findall(r[1] or "")), sizes[r[3]], round(target[r[3]], 6)) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == want
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got) and sum(r["taken"] for r in got) == total
    for packet in (7, 1024):
        want = queue(rows, sizes, target, order, packet)
        again = Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(docs.repartition(5), packet=packet).collect())
        assert again == want


def queue(rows, sizes, target, order, packet):
    """Fair queueing in plain Python: packets of all sources by finish time, until the words of all rows are used up."""
    queues = {s: [] for s in order}
    for i, (doc, text, _, source, _) in enumerate(rows):
        key = hashlib.md5(f"{'' if doc is None else doc}:{mixing.SEED}".encode()).hexdigest()
        queues[source].append((key, doc or 0, len(WORD.findall(text or "")), i))
    packets, taken, left = [], Counter(), sum(sizes.values())
    for ix, s in enumerate(order):
        at = 0
        for _ in range(3):
            for _, _, size, i in sorted(queues[s]):
                for k in range(0, size, packet):
                    n = min(packet, size - k)
                    packets.append(((at + k + n) / target[s], ix, at + k, n, i))
                at += size
    for _, _, _, n, i in sorted(packets):
        taken[i] += min(n, left)
        left -= min(n, left)
    return Counter((r[0], len(WORD.findall(r[1] or "")), taken[i]) for i, r in enumerate(rows))


def test_mixing_takes_each_source_near_its_target(spark):
    rows = [(i, "w " * (1 + i % 40), f"s{i % 6}") for i in range(600)] + [(900, "w " * 5000, "s1")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), packet=16).toPandas()
    for _, g in got.groupby(got.doc_id % 6 * (got.doc_id < 900) + (got.doc_id == 900)):
        assert g.target.nunique() == 1 and abs(g.taken.sum() - g.target.iloc[0]) <= 16 * 6


def test_lm_counts_and_base(docs, rows):
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [[*WORD.findall(lower(r[1])), None] for r in rows]
    c = Counter(t for r, w in zip(rows, tokens) if not fold(r[0]) for t in w)
    n, v = sum(c.values()), len(c)
    for head in (1 << 18, 40, 1):
        got = lm.score(docs, clustered=30, classes=6, head=head).collect()
        base = lambda w: round(sum(np.log10((c[t] + 1) / (n + v + 1)) for t in w), 6)
        want = Counter((r[0], fold(r[0]), len(w), sum(c[t] > 0 for t in w), n, base(w)) for r, w in zip(rows, tokens))
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(10)
    group = np.arange(30) % 3  # words of group g are followed by words of group g + 1
    counts = np.array([[rng.poisson(20) if group[j] == (group[i] + 1) % 3 else 0 for j in range(30)] for i in range(30)])
    counts = np.pad(counts, ((0, 2), (0, 2)))
    order = rng.permutation(30)
    of = lm.exchange(counts[np.ix_([*order, 30, 31], [*order, 30, 31])], 3, 2)
    assert list(of[30:]) == [3, 4]
    assert all(len({of[i] for i in range(30) if group[order[i]] == g}) == 1 for g in range(3)) and len(set(of[:30])) == 3


@pytest.mark.parametrize("piece", [64, 2, 1])
def test_crf_marginals_equal_enumeration(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    rng = np.random.default_rng(11)
    moves, start, first = rng.normal(size=(2, 2)), rng.normal(size=2), np.array([0, 6, 6, 7, 12])
    emission = rng.normal(size=12) * 2
    gamma, pairs, log_z = toxicity.forward_backward(emission, first, start, moves)
    both = np.zeros((2, 2))
    for d, (a, b) in enumerate(zip(first[:-1], first[1:])):
        weights = {}
        for tags in itertools.product((0, 1), repeat=b - a):
            w = sum(start[t] for t in tags[:1]) + sum(emission[a + i] for i, t in enumerate(tags) if t) + sum(moves[x, y] for x, y in zip(tags, tags[1:]))
            weights[tags] = np.exp(w)
        z = sum(weights.values())
        assert np.allclose(gamma[a:b], [sum(w for t, w in weights.items() if t[i]) / z for i in range(b - a)]) and np.isclose(log_z[d], np.log(z))
        for t, w in weights.items():
            for x, y in zip(t, t[1:]):
                both[x, y] += w / z
    assert np.allclose(pairs, both)


def test_attention_gradient():
    rng = np.random.default_rng(12)
    x, at, y = rng.normal(size=(60, quality.FEATURES)), np.array([0, 1, 10, 30, 60]), np.array([0.0, 1, 0, 1])
    w = quality.fit(x, at, y, epochs=200)
    *_, attention, _, p = quality._forward(w, x, at)
    assert np.allclose(np.add.reduceat(attention, at[:-1]), 1) and ((p > 0.5) == (y == 1)).all()


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def truth(spark):
    rows = documents(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic").collect()
    return {r["doc_id"]: r for r in rows}


def test_classifiers_on_held_out_rows(spark, truth):
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    for found, label, column, least in (
        (language.identify(documents(spark, SF)), "lang", "lang_pred", 0.97),
        (quality.classify(spark, documents(spark, SF), SF), "quality", "predicted", 0.95),
    ):
        got = found.collect()
        assert len(got) == len(truth) and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
        test = [(r[column], truth[r["doc_id"]][label]) for r in got if r["held_out"] and truth[r["doc_id"]][label] is not None]
        assert sum(a == b for a, b in test) / len(test) >= least, label


def test_held_out_toxic_documents_are_found(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(truth[r["doc_id"]], r["predicted"]) for r in toxicity.classify(spark, documents(spark, sf), sf).where("held_out").collect() if truth.get(r["doc_id"]) is not None]
    toxic, clean = [p for y, p in got if y == 1], [p for y, p in got if y == 0]
    assert len(toxic) > 100 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def crf_score(model, text):
    """A document's score in plain Python: one chain of log-odds, forward and backward, then the regression."""
    raw = "".join(c.lower() if c < "\x80" else c for c in text or "")
    words = [w.encode() for w in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", raw)]
    place = {int(f): i + 1 for i, f in enumerate(model["vocabulary"])}
    hashed = lambda b: int(toxicity.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
    odds = []
    for w in words:
        features = [hashed(w)] + [int(toxicity.mix(np.array([hashed(w[:k]) ^ k], np.uint64))[0]) for k in toxicity.PREFIXES if len(w) > k]
        odds.append(float(model["bias"][0] + sum(model["word"][place[f]] for f in features if f in place)))
    n, m, start = len(odds), np.exp(model["moves"]), np.exp(model["start"])
    psi = [np.array([1.0, np.exp(o)]) for o in odds]
    alpha, beta = [], [np.ones(2)] * n
    for t in range(n):
        a = psi[t] * (alpha[-1] @ m if t else start)
        alpha.append(a / a.sum())
    for t in range(n - 2, -1, -1):
        b = m @ (psi[t + 1] * beta[t + 1])
        beta[t] = b / b.sum()
    p = [float((a * b)[1] / (a * b).sum()) for a, b in zip(alpha, beta)]
    x = np.array([max(p, default=0.0), np.log1p(sum(q for q in p if q > 0.05)), 1.0])
    return 1 / (1 + np.exp(-np.clip(x @ model["document"], -40, 40)))


def test_toxicity_scores_equal_plain_python(spark):
    docs = documents(spark, SF)
    model = toxicity.train(spark, docs, SF)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = toxicity.score(docs, model).collect()
    some = [r for r in got if len(texts[r["doc_id"]] or "") < 20_000][:150] + sorted(got, key=lambda r: -r["score"])[:30]
    assert all(abs(r["score"] - crf_score(model, texts[r["doc_id"]])) < 1e-6 for r in some)


def test_classifiers_on_odd_rows(spark, docs, rows, tmp_path):
    labels = spark.createDataFrame([(r[0], (r[0] // 3) % 2, (r[0] // 3) % 5 == 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for found in (language.identify(docs), quality.classify(spark, docs, str(tmp_path)), toxicity.classify(spark, docs, str(tmp_path), spans=True)):
        got = found.collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows) and all(0 <= r["score"] <= 1 for r in got)
    und = {r["doc_id"] for r in language.identify(docs).where("lang_pred = 'und'").collect()}
    assert und == {r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")}


def test_toxic_spans_point_at_words(spark):
    docs = documents(spark, SF)
    got = toxicity.classify(spark, docs, SF, spans=True).where("size(spans) > 0").join(docs.select("doc_id", "text"), "doc_id").collect()
    words = Counter(r["text"].encode()[s["begin"] : s["end"]].decode().lower() for r in got for s in r["spans"])
    assert words and all(w.isalnum() for w in words)


def test_empty_tables(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for found in (packing.pack(empty), jaccard.near_duplicates(empty), suffixes.remove_repeats(empty), mixing.mix(empty), lm.score(empty), language.identify(empty), quality.classify(spark, empty, str(tmp_path)), toxicity.classify(spark, empty, str(tmp_path))):
        assert found.count() == 0
