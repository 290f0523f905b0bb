"""Near-duplicate documents: Jaccard join of word shingle sets, size-aware, heavy and light."""

from __future__ import annotations

import zlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchyard.llm.base import arrow_stage, BROADCAST_KEYS, collect_garbage, ints, pull, put, release, small, stash, text_blocks, trimmed
from matchyard.llm.components import components
from matchyard.llm.words import mix, shingle_sets, word_hashes

#: Words in a shingle. Two sets link when 5 * intersection >= 4 * union.
SHINGLE = 5
#: Counters in each of the two rows of the frequency sketch, and in a slice of it. A partition counts up to 255 in each:
#: what is more frequent than that anywhere is frequent enough.
SKETCH, SLICE = 1 << 23, 1 << 18
#: Sets above this size never count as small: subsets of a set of n miss at most n // 5 members, 1160 of them at 19.
MOST_SMALL = 19
#: Members from which on a list is long. Shorter ones are compared pair by pair at once.
LONG = 64
#: Rounds in which long lists are compared with one member only, before what is open is compared pair by pair.
STAR_ROUNDS = 3
#: Open pairs that are compared without further rounds.
FEW_PAIRS = 100_000
#: Bits of a set's signature.
SIGNATURE = 2048
#: Rounds in which the likeliest pair of each component is tested, before all pairs left are.
TEST_ROUNDS = 2
#: Pairs of one set that are tested in one group.
SHARE = 256


def needed(n, m):
    """Members that sets of n and m must share."""
    return -(-4 * (n + m) // 9)


def _sets(column):
    for row, after, data, offsets in text_blocks(column):
        words, first = word_hashes(data, offsets)
        tokens, begins = shingle_sets(words, first, SHINGLE)
        yield row, after, tokens, begins


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[begins[1:]] - total[begins[:-1]]


def _prints(tokens, begins) -> np.ndarray:
    """Fingerprint of each set."""
    return mix(_sums(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begins) ^ np.diff(begins).astype(np.uint64))


def _cells(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (tokens & np.uint64(SKETCH - 1)).astype(np.int64), ((tokens >> np.uint64(32)) & np.uint64(SKETCH - 1)).astype(np.int64)


def _signatures(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """SIGNATURE parity bits of each set, as longs. Two sets' signatures differ in at most as many bits as the sets in
    members."""
    n = len(begins) - 1
    owner = np.repeat(np.arange(n), np.diff(begins))
    cell = owner * SIGNATURE + ((tokens >> np.uint64(48)) % np.uint64(SIGNATURE)).astype(np.int64)
    bits = np.bincount(cell, minlength=n * SIGNATURE).reshape(n, SIGNATURE) & 1
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)


_SCAN = "doc_id long, n int, fp long, signature array<long>, tokens binary, slice int, counters binary"
_SCAN_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary())
_SCAN_NAMES = [x.split()[0] for x in _SCAN.split(", ")]


def _scan(batches):
    """Size, fingerprint and signature of every set, and small sets themselves; at the end of the partition, its part of
    the frequency sketch."""
    sketch = np.zeros((2, SKETCH), np.uint16)
    for batch in batches:
        sizes, prints, signatures, small_sets = [], [], [], []
        for _, _, tokens, begins in _sets(batch.column(1)):
            n = np.diff(begins)
            sizes.append(n)
            prints.append(_prints(tokens, begins))
            signatures.append(_signatures(tokens, begins))
            small_sets += [tokens[begins[i] : begins[i + 1]].tobytes() if 0 < k <= MOST_SMALL else None for i, k in enumerate(n.tolist())]
            for r, cell in enumerate(_cells(tokens)):
                np.add.at(sketch[r], cell, np.uint16(1))
        if not sizes:
            continue
        n = np.concatenate(sizes)
        bits = np.concatenate(signatures)
        found = [batch.column(0), pa.array(n.astype(np.int32)), pa.array(ints(np.concatenate(prints)), mask=n == 0), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bits.shape[1], pa.int32()), pa.array(bits.ravel())), pa.array(small_sets, pa.binary())]
        yield pa.RecordBatch.from_arrays([*found, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=_SCAN_NAMES)
    flat = sketch.reshape(-1, SLICE)
    some = np.flatnonzero(flat.any(axis=1))
    if len(some):
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), t) for t in _SCAN_TYPES[:5]), pa.array(some.astype(np.int32)), pa.array([zlib.compress(np.minimum(flat[i], 255).astype(np.uint8).tobytes(), 6) for i in some], pa.binary())], names=_SCAN_NAMES)


def _add_counters(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(c), np.uint8).astype(np.uint64)
            held[k] = held[k] + part if k in held else part
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(np.minimum(c, 2**16 - 1).astype(np.uint16).tobytes(), 1) for c in held.values()], pa.binary())], names=["slice", "counters"])


def levels(sketch: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """0 for tokens as rare as the sketch can tell, then one more for each doubling."""
    base = 2 * sketch[0].sum(dtype=np.uint64) / SKETCH + 8
    a, b = _cells(tokens)
    count = np.minimum(sketch[0][a], sketch[1][b])
    out = np.zeros(len(tokens), np.int64)
    high = count > base
    out[high] = np.floor(np.log2(count[high] / base)).astype(np.int64) + 1
    return out


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """The largest set size for which enumerating subsets costs no more, over all sets up to it, than scanning lists.

    A set of n has sum(C(n, k), k <= n // 5) subsets, and n - ceil(4n/5) + 1 lists of about `list_length` to scan."""
    best, saved = 0, 0.0
    for n in range(1, MOST_SMALL + 1):
        subsets = sum(comb(n, k) for k in range(n // 5 + 1))
        saved += sizes.get(n, 0) * ((n - -(-4 * n // 5) + 1) * (1 + list_length) - subsets)
        if saved >= 0:
            best = n
    return best


def _entries(gone, sketch, small_size: int):
    """(token, fp, place) of each set's rarest tokens, place being n and the position in one number, as many as a partner must share one of. Sets so small that any
    partner is small are left out."""

    def run(batches):
        counters = sketch.value
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            done = np.zeros(0, np.uint64)
            for row, after, tokens, begins in _sets(batch.column(1)):
                n = np.diff(begins)
                fp = _prints(tokens, begins)
                use = (n > 0) & (5 * n > 4 * small_size)
                if gone is not None:
                    use &= ~np.isin(keys[row:after] ^ ints(fp), gone.value)
                use &= ~np.isin(fp, done)
                some = np.flatnonzero(use)
                _, at = np.unique(fp[some], return_index=True)  # the same set twice in a batch: once is enough
                use[:] = False
                use[some[at]] = True
                done = np.union1d(done, fp[use])
                owner = np.repeat(np.arange(len(n)), n)
                level = levels(counters, tokens)
                pos = np.arange(len(tokens)) - begins[owner]
                if level.any():  # tokens come sorted by hash, so only sets with frequent ones are sorted again
                    order = np.lexsort((pos, level, owner))
                    tokens = tokens[order]
                prefix = (n - -(-4 * n // 5) + 1) * use
                take = pos < prefix[owner]
                of = owner[take]
                yield pa.RecordBatch.from_arrays([pa.array(ints(tokens[take])), pa.array(ints(fp[of])), pa.array(n[of] << 32 | pos[take])], names=["token", "fp", "place"])

    return run


def _subsets(batches):
    """(token, fp, n, pos): hash and size of every subset that a partner of a small set may have to share."""
    for batch in batches:
        fp, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for size in np.unique(n):
            of = np.flatnonzero(n == size)
            for k in range(0, len(of), 2000):
                some = of[k : k + 2000]
                members = np.frombuffer(b"".join(batch.column(2)[int(i)].as_py() for i in some), np.uint64).reshape(len(some), size)
                members = mix(members ^ np.uint64(0x3C3C3C3C3C3C3C3C))
                total = members.sum(axis=1, dtype=np.uint64)
                keys, left = [], []
                for missing in range(size // 5 + 1):
                    for left_out in combinations(range(size), missing):
                        keys.append(mix(total - members[:, list(left_out)].sum(axis=1, dtype=np.uint64)) ^ np.uint64(size - missing))
                        left.append(size - missing)
                shape = (len(keys), len(some))
                yield pa.RecordBatch.from_arrays([pa.array(ints(np.stack(keys).ravel())), pa.array(np.broadcast_to(fp[some], shape).ravel()), pa.array(np.full(shape[0] * shape[1], size, np.int32)), pa.array(np.repeat(np.array(left, np.int32), len(some)))], names=["token", "fp", "n", "pos"])


def _lists(small_size: int):
    """Reads the inverted lists; rows arrive sorted by (token, fp). Short lists give the pairs (a, b) that may link; of
    long ones every member is passed on, with the first as the list's pivot. Lists of one set give nothing."""
    names = ["a", "b", "token", "fp", "n", "pos", "p_fp", "p_n", "p_pos"]

    def may_link(n, m, i, j):
        low, high = np.minimum(n, m), np.maximum(n, m)
        return (high > small_size) & (5 * low >= 4 * high) & (9 * (1 + np.minimum(n - i - 1, m - j - 1)) >= 4 * (n + m))

    def short(token, fp, n, pos):
        found = []
        at = np.arange(len(token))
        for step in range(1, LONG):
            at = at[at + step < len(token)]
            at = at[token[at] == token[at + step]]
            if not len(at):
                break
            other = at + step
            ok = may_link(n[at], n[other], pos[at], pos[other])
            found.append((fp[at[ok]], fp[other[ok]]))  # sorted by fp: a < b
        if not found:
            return None
        a, b = (np.concatenate(c) for c in zip(*found))
        pairs = np.unique(np.stack([b, a], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *(pa.nulls(len(pairs), t) for t in [pa.int64(), pa.int64(), pa.int32(), pa.int32()] + [pa.int64(), pa.int32(), pa.int32()])], names=names)

    def long(rows, pivot):
        n = len(rows[0])
        first = [pa.array(np.full(n, x, c.dtype)) for x, c in zip(pivot, rows[1:])]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *map(pa.array, rows), *first], names=names)

    def run(batches):
        held, pivot = None, None  # rows of the list at the end of the batch before; its pivot once it is long
        for batch in batches:
            if not len(batch):
                continue
            place = batch.column(2).to_numpy()
            rows = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), (place >> 32).astype(np.int32), (place & 0xFFFFFFFF).astype(np.int32)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            same = np.zeros(len(rows[0]), bool)
            same[1:] = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
            if same.any():  # a set that several documents brought
                rows = [c[~same] for c in rows]
            token = rows[0]
            begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(begin, len(token)))
            if pivot is not None and len(begin) > 1:  # the long list ends here
                # its last row was passed on before
                yield long([c[1 : size[0]] for c in rows], pivot) if size[0] > 1 else long([c[:0] for c in rows], pivot)
                rows = [c[size[0] :] for c in rows]
                token, begin, size, pivot = rows[0], begin[1:] - size[0], size[1:], None
            elif pivot is not None:
                yield long([c[1:] for c in rows], pivot)
                held = [c[-1:] for c in rows]
                continue
            last = begin[-1]
            big = size >= LONG
            for i in np.flatnonzero(big[:-1]):
                part = [c[begin[i] : begin[i] + size[i]] for c in rows]
                yield long(part, [c[0] for c in part[1:]])
            done = np.repeat(~big, size)
            done[last:] = False
            if (found := short(*(c[done] for c in rows))) is not None:
                yield found
            held = [c[last:] for c in rows]
            if big[-1]:
                pivot = [c[0] for c in held[1:]]
                yield long(held, pivot)
                held = [c[-1:] for c in held]
        if held is not None and pivot is None and (found := short(*held)) is not None:
            yield found

    return run


def _may_link(a: str, b: str, small_size: int) -> Column:
    """Length and position filters of two entries of a list; two small sets are left to their subsets."""
    n, m, i, j = (F.col(c) for c in (f"{a}n", f"{b}n", f"{a}pos", f"{b}pos"))
    return (F.greatest(n, m) > small_size) & (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * (1 + F.least(n - i - 1, m - j - 1)) >= 4 * (n + m))


def packed(tokens: np.ndarray) -> bytes:
    """Sorted tokens in about 7 bytes each: the leading 16 bits as differences, compressed, and the rest as it is."""
    lead = np.diff((tokens >> np.uint64(48)).astype(np.uint16), prepend=np.uint16(0))
    return zlib.compress(lead.tobytes(), 1) + np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(body) -> np.ndarray:
    inflate = zlib.decompressobj()
    lead = np.cumsum(np.frombuffer(inflate.decompress(body), np.uint16), dtype=np.uint64)
    out = np.zeros((len(lead), 8), np.uint8)
    out[:, :6] = np.frombuffer(inflate.unused_data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel() | (lead << np.uint64(48))


def _send(batches):
    """Sends the set of each document to the groups that it is tested in."""
    for batch in batches:
        targets = batch.column(1)
        for row, _, tokens, begins in _sets(batch.column(0)):
            fp = ints(_prints(tokens, begins))
            out: list[list] = [[], [], [], []]
            for i in np.flatnonzero(np.diff(begins) > 0):
                body = None
                for t in targets[row + int(i)].as_py():
                    if t["fp"] != fp[i]:
                        continue  # another text under the same id
                    body = body or packed(tokens[begins[i] : begins[i + 1]])
                    for c, x in zip(out, (t["key"], t["salt"], fp[i], body)):
                        c.append(x)
            for i in range(0, len(out[0]), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 500], t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["key", "salt", "fp", "tokens"])


def _test(key, table):
    """The sets of a group that link with the one the group is named for."""
    fp, body = table.column("fp").combine_chunks(), table.column("tokens").combine_chunks()
    fp = fp.to_numpy()
    head = np.flatnonzero(fp == key[0].as_py())
    found = []
    if len(head):
        b = unpacked(body[int(head[0])].as_py())
        for i in np.flatnonzero(fp != key[0].as_py()):
            a = unpacked(body[int(i)].as_py())
            shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            if shared >= needed(len(a), len(b)):
                found.append(int(fp[i]))
    return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([key[0].as_py()] * len(found), pa.int64())})


def differing(x: str, y: str) -> Column:
    """Bits in which two signatures differ."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, p: t + p)


def near_enough(n: str, m: str, x: str, y: str) -> Column:
    """Whether signatures leave it possible that two sets of n and m members link."""
    both = F.col(n) + F.col(m)
    return differing(x, y) <= both - 2 * F.ceil(both * 4 / 9)


def test_pairs(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs: a written table (a, b) of fingerprints. Those whose sets link, written.

    Sets are rebuilt from the one document that stands for each and sent once to every group they are tested in: the
    pairs of a b, in shares of at most about SHARE, so a set with very many partners is in many groups."""
    loads = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("salts"))
    dealt = stash(pairs.join(loads, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt")), "dealt")
    sent = dealt.select(F.col("a").alias("fp"), F.col("b").alias("key"), "salt").unionByName(dealt.select(F.col("b").alias("fp"), F.col("b").alias("key"), "salt").distinct())
    sent = sent.join(classes.select("fp", F.col("one").alias("_one")), "fp").groupBy("_one").agg(F.collect_list(F.struct("fp", "key", "salt")).alias("targets"))
    sent = stash(sent, "targets")
    texts = docs.join(small(sent), F.col("doc_id").eqNullSafe(F.col("_one"))).select("text", "targets")
    groups = arrow_stage(texts, _send, "key long, salt int, fp long, tokens binary")
    return stash(groups.groupBy("key", "salt").applyInArrow(trimmed(_test), "a long, b long"), "links")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs: a written table (a, b) of fingerprints. Links that connect what all links among the pairs connect.

    Signatures drop most pairs that only share a passage. Of the rest, the likeliest pair of each set is tested first,
    then that of each component of what is linked so far, and at last all pairs between components. So a group of many
    alike sets needs few tests, and no pair that could connect more is left out."""
    few = small(pairs)

    def end(x: str) -> DataFrame:
        return few.join(classes.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}")), x)

    likely = end("a").join(end("b"), ["a", "b"]).where(near_enough("n_a", "n_b", "s_a", "s_b"))
    rest = stash(likely.select("a", "b", (differing("s_a", "s_b") / (F.col("n_a") + F.col("n_b"))).alias("apart"), F.col("a").alias("p_a"), F.col("b").alias("p_b")), "likely")
    links = None
    for turn in range(TEST_ROUNDS + 1):
        if not rest.limit(1).count():
            break
        if turn < TEST_ROUNDS:
            best = F.min(F.struct("apart", "a", "b")).alias("x")
            each = rest.select("p_a", "apart", "a", "b").unionByName(rest.select(F.col("p_b").alias("p_a"), "apart", "a", "b"))
            chosen = stash(each.groupBy("p_a").agg(best).select("x.a", "x.b").distinct(), "pairs")
        else:
            chosen = rest.select("a", "b")
        found = test_pairs(chosen, docs, classes)
        # rounds are many small jobs, whose plans and broadcasts would fill the driver until it happens to collect them
        collect_garbage(docs.sparkSession)
        links = found if links is None else links.unionByName(found)
        if turn == TEST_ROUNDS:
            break
        parts = small(stash(components(links, what="parts"), "parts"))
        side = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"p_{x}"))  # noqa: E731, B023
        rest = rest.select("a", "b", "apart").join(small(chosen), ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
        rest = rest.withColumns({"p_a": F.coalesce("p_a", "a"), "p_b": F.coalesce("p_b", "b")}).where("p_a <> p_b")
        rest = stash(rest.select("a", "b", "apart", "p_a", "p_b"), "rest")
    return links if links is not None else rest.select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs: doc_id (integer), text. One row per row: doc_id, n_shingles, component_id.

    1. Equal sets become one class, known by its fingerprint; only classes are compared, so copies are never paired.
    2. Small sets (see `boundary`) enumerate the subsets that a partner of each size must share. Equal subsets of the
       required size are a link; all holders of a subset that can link by it link to its smallest holder, so a star of
       links stands for all pairs. 3. Larger sets put their rarest tokens in inverted lists, rare by a sketch of all
       tokens' frequency, so that passages which many documents share aren't scanned. Short lists are compared
       pair by pair. Long ones are first compared with one member; what is then in the same component needs no
       comparing. The pairs still open after some rounds are compared all.
    No list, candidate or partner is capped. Null or empty text and text without words is an empty set, linked with
    nothing, of its own component. Rows that repeat are in one class; a null doc_id is in its class but can't name it
    (component_id is null when no other member has an id). An empty table gives none."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.select(F.xxhash64("doc_id").alias("key"), "text")
    scan = stash(arrow_stage(docs, _scan, _SCAN), "scan")
    sets = scan.where("slice is null").select("doc_id", "n", "fp")
    shapes = scan.where("slice is null and n > 0").select("doc_id", "n", "fp", "signature", "tokens")
    parts = scan.where("slice is not null").select("slice", "counters")
    counters = np.zeros((2 * SKETCH // SLICE, SLICE), np.uint16)
    summed = arrow_stage(parts.repartition(2 * SKETCH // SLICE, "slice"), _add_counters, "slice int, counters binary")
    for r in summed.collect():  # as many rows as the sketch has slices
        counters[r["slice"]] = np.frombuffer(zlib.decompress(r["counters"]), np.uint16)
    counters = counters.reshape(2, SKETCH)
    grouped = shapes.groupBy("fp").agg(F.min("doc_id").alias("one"), F.first("n").alias("n"), F.count(F.lit(1)).alias("times"), F.first("signature").alias("signature"), F.first("tokens").alias("tokens"))
    classes = stash(grouped, "classes")

    sizes = {r["n"]: r["k"] for r in classes.where(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    total = float(counters[0].sum(dtype=np.uint64))
    squares = sum(float((part.astype(np.float64) ** 2).sum()) for part in counters[0].reshape(-1, SLICE))
    list_length = max(0.0, squares / total - total / SKETCH - 1) if total else 0.0
    small_size = boundary(sizes, list_length)

    copies = sets.join(small(classes.where("times > 1").select("fp", "one")), "fp").where("doc_id <> one").select((F.xxhash64("doc_id").bitwiseXOR(F.col("fp"))).alias("pair")).distinct()
    copies = stash(copies, "copies")
    gone = None
    if 0 < copies.count() <= BROADCAST_KEYS:
        gone = put(spark, np.sort(pull(copies).pair.to_numpy(np.int64)))
    sketch = put(spark, counters)
    del counters
    collect_garbage(spark)
    entries = arrow_stage(rows, _entries(gone, sketch, small_size), "token long, fp long, place long")

    edges = []
    if small_size >= 4:
        few = classes.where((F.col("n") >= 4) & (F.col("n") <= small_size)).select("fp", "n", "tokens")
        subsets = stash(arrow_stage(few, _subsets, "token long, fp long, n int, pos int"), "subsets")
        least = subsets.groupBy("token").agg(F.min(F.struct("n", "fp")).alias("least"), F.count(F.lit(1)).alias("holders")).where("holders > 1")
        edges.append(subsets.join(least, "token").where("fp <> least.fp and 4 * (n + least.n) <= 9 * pos").select(F.col("fp").alias("a"), F.col("least.fp").alias("b")))
    ordered = entries.repartition("token").sortWithinPartitions("token", "fp")
    read = stash(arrow_stage(ordered, _lists(small_size), "a long, b long, token long, fp long, n int, pos int, p_fp long, p_n int, p_pos int"), "lists")
    release(spark, [], [v for v in (gone, sketch) if v is not None])  # what was read with them is written
    collect_garbage(spark)
    lists = read.where("token is not null").drop("a", "b")
    stars = lists.where((F.col("fp") != F.col("p_fp")) & _may_link("", "p_", small_size)).select(F.greatest("fp", "p_fp").alias("a"), F.least("fp", "p_fp").alias("b"))
    pairs = stash(read.where("a is not null").select("a", "b").unionByName(stars).distinct(), "pairs")
    edges.append(verify(pairs, docs, classes))
    seen = pairs
    for turn in range(STAR_ROUNDS):
        links = edges[0]
        for e in edges[1:]:
            links = links.unionByName(e)
        joined = stash(components(links, what="parts").withColumnsRenamed({"node": "fp", "component": "part"}), "joined")
        own = lists.select("token", "fp", "n", "pos").join(small(joined), "fp", "left").withColumn("part", F.coalesce("part", "fp"))
        members = stash(lists.select("fp").distinct(), "members")
        marks = classes.select("fp", F.col("signature").alias("sig")).join(small(members), "fp")
        own = stash(own.join(marks, "fp"), "owned")
        by_part = own.groupBy("token", "part").agg(F.count(F.lit(1)).alias("c"))
        by_list = by_part.groupBy("token").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q")).where("s * s > q")
        by_list = stash(by_list, "open")
        state = by_list.agg(F.sum(F.expr("(s * s - q) div 2")).alias("pairs"), F.sum("s").alias("rows")).first()
        if not state["rows"]:
            break
        own = own.join(by_list.select("token"), "token", "left_semi")
        last = turn == STAR_ROUNDS - 1 or state["pairs"] <= max(FEW_PAIRS, 16 * state["rows"])
        if last:
            x, y = (own.select("token", *(F.col(c).alias(f"{p}{c}") for c in ("fp", "n", "pos", "part", "sig"))) for p in ("x_", "y_"))
            more = x.join(y, "token").where((F.col("x_part") != F.col("y_part")) & (F.col("x_fp") > F.col("y_fp")) & _may_link("x_", "y_", small_size) & near_enough("x_n", "y_n", "x_sig", "y_sig"))
        else:
            pivot = own.groupBy("token").agg(F.min_by(F.struct("fp", "n", "pos", "part"), F.xxhash64("fp", F.lit(turn))).alias("y"))
            pivot = pivot.select("token", *(F.col(f"y.{c}").alias(f"y_{c}") for c in ("fp", "n", "pos", "part")))
            x = own.select("token", *(F.col(c).alias(f"x_{c}") for c in ("fp", "n", "pos", "part")))
            more = x.join(pivot, "token").where((F.col("x_part") != F.col("y_part")) & _may_link("x_", "y_", small_size))
        more = more.select(F.greatest("x_fp", "y_fp").alias("a"), F.least("x_fp", "y_fp").alias("b")).distinct().join(seen, ["a", "b"], "left_anti")
        more = stash(more, "pairs")
        edges.append(verify(more, docs, classes))
        seen = seen.unionByName(more)
        if last:
            links = links.unionByName(edges[-1])
            joined = stash(components(links, what="parts").withColumnsRenamed({"node": "fp", "component": "part"}), "joined")
            break
    named = classes.join(joined, "fp", "left").where("times > 1 or part is not null").withColumn("part", F.coalesce("part", "fp"))
    named = named.select("fp", "one", "part")
    label = named.groupBy("part").agg(F.min("one").alias("component_id"))
    named = stash(named.join(label, "part").select("fp", "component_id", F.lit(True).alias("known")), "named")
    out = sets.join(small(named), "fp", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
