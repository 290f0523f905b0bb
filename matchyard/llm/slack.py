"""Packing documents into windows without padding by minimum bin slack: subset sums over the lengths that are left."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict, deque
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchyard.llm.base import arrow_stage, small, stash
from matchyard.llm.packing import TOKENIZER, token_ids

CAPACITY = 4096
END = 2


class Place(NamedTuple):
    """Where a run of pieces goes. Of the pieces that are `origin` long those of rank `rank` and the `count - 1` after it
    give their tokens from `start` on, `length` of them: the i-th stands at place `first + i` among its window's pieces of that
    length, `copies` in each sequence from `base` on, the first of them at `offset`."""

    origin: int
    rank: int
    count: int
    start: int
    length: int
    base: int
    copies: int
    offset: int
    first: int


def fullest(sizes: list[int], left: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset (length, times) of what is left whose sum comes closest to `room` from below.

    Bit t of a set tells whether t is a sum; lengths enter from the longest, each as often as it is left, until `room`
    itself is a sum or all have entered. Counts are found backwards through the sets, of each length as few as can be."""
    usable, sets, mask = [], [1], (2 << room) - 1
    for at in range(bisect_right(sizes, room) - 1, -1, -1):
        x = sizes[at]
        bits, n, step = sets[-1], min(left[x], room // x), 1
        while n > 0:
            step = min(step, n)
            bits |= bits << (x * step)
            n -= step
            step *= 2
        usable.append(x)
        sets.append(bits & mask)
        if bits >> room & 1:
            break
    total = sets[-1].bit_length() - 1
    found = []
    for i in range(len(usable), 0, -1):
        n = 0
        while not sets[i - 1] >> total & 1:
            total -= usable[i - 1]
            n += 1
        if n:
            found.append((usable[i - 1], n))
    return found


def minimum_slack(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Place], int]:
    """Places for pieces of 1 to `capacity` tokens, given by length with counts, and the number of sequences.

    The longest piece left opens a window; fullest() fills it; the same filling serves as many windows as the counts
    allow. Where the fullest sum leaves slack, one piece that is left is cut and fills it, so no window is padded and a
    piece is cut only where no whole ones fit. What remains under one window goes, in the same way, into sequences whose
    lengths are its powers of two. The windows are found from counts alone: at most `capacity` lengths, whatever the
    number of documents."""
    lots: dict[int, deque] = defaultdict(deque)
    left = {x: n for x, n in counts.items() if n}
    for x, n in left.items():
        lots[x].append((x, 0, n, 0))
    sizes, total, base = sorted(left), sum(x * n for x, n in left.items()), 0
    places: list[Place] = []

    def add(x: int, lot: tuple[int, int, int, int]) -> None:
        if x not in left:
            insort(sizes, x)
            left[x] = 0
        left[x] += lot[2]
        lots[x].append(lot)

    def draw(x: int, n: int) -> list[tuple[int, int, int, int]]:
        left[x] -= n
        if not left[x]:
            del left[x]
            sizes.pop(bisect_left(sizes, x))
        out = []
        while n:
            origin, rank, count, start = lots[x].popleft()
            k = min(n, count)
            out.append((origin, rank, k, start))
            if k < count:
                lots[x].appendleft((origin, rank + k, count - k, start))
            n -= k
        return out

    while total:
        window = capacity if total >= capacity else 1 << (total.bit_length() - 1)
        filling: Counter = Counter()
        at = bisect_right(sizes, window)
        if at:
            filling[sizes[at - 1]] = 1
            left[sizes[at - 1]] -= 1
            filling.update(dict(fullest(sizes, left, window - sizes[at - 1])))
            left[sizes[at - 1]] += 1
        slack = window - sum(x * n for x, n in filling.items())
        need, cut = Counter(filling), None
        if slack:  # the longest piece beside the filling: it is longer than the slack, or it would have been taken
            cut = next(x for x in reversed(sizes) if left[x] > filling[x])
            need[cut] += 1
        times = min(left[x] // n for x, n in need.items())
        offset = 0
        for x, n in sorted(filling.items(), reverse=True):
            first = 0
            for origin, rank, count, start in draw(x, n * times):
                places.append(Place(origin, rank, count, start, x, base, n, offset, first))
                first += count
            offset += n * x
        if cut:
            first = 0
            for origin, rank, count, start in draw(cut, times):
                places.append(Place(origin, rank, count, start, slack, base, 1, offset, first))
                add(cut - slack, (origin, rank, count, start + slack))
                first += count
        base += times
        total -= times * window
    return places, base


def _pieces(path: str, capacity: int, width: str):
    """A mapInArrow function: (row, doc_id, text) to pieces of at most `capacity` ids, numbered within the task and length."""

    def run(batches):
        from pyspark import TaskContext

        part, given = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch, found in token_ids(path, END, batches):
            doc, start, length, crc, tokens, nth, ids = [], [], [], [], [], [], []
            for i, raw in enumerate(found):
                for at in range(0, len(raw), 4 * capacity):
                    piece = raw[at : at + 4 * capacity]
                    n = len(piece) // 4
                    doc.append(i)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(piece))
                    tokens.append(len(raw) // 4)
                    nth.append(int(given[n]))
                    given[n] += 1
                    ids.append(np.frombuffer(piece, "<u4").astype(width).tobytes())
            arrays = [batch.column(1).take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens, nth)), pa.array([part] * len(doc), pa.int32()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", "part", "ids"])

    return run


def _place(places: list[Place], capacity: int, width: str, payload: bool):
    """A mapInArrow function: ranked pieces to the pieces that are packed, of which one may give several."""
    table = np.array(sorted(places, key=lambda p: (p.origin, p.start, p.rank)), np.int64).reshape(-1, len(Place._fields))
    groups, of = np.unique(table[:, 0] * (capacity + 1) + table[:, 3], return_inverse=True)
    keys = (of << 50) + table[:, 1]

    def run(batches):
        for batch in batches:
            start, length, crc, tokens, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "length", "ids_crc32", "doc_tokens", "rank"))
            out, active, at = [], np.arange(len(length)), np.zeros(len(length), np.int64)
            while len(active):  # as often as a piece has parts
                group = np.searchsorted(groups, length[active] * (capacity + 1) + at[active])
                row = table[np.searchsorted(keys, (group << 50) + rank[active], "right") - 1]
                nth = row[:, 8] + rank[active] - row[:, 1]
                out.append((active, at[active], row[:, 4], row[:, 5] + nth // row[:, 6], row[:, 7] + nth % row[:, 6] * row[:, 4]))
                at[active] += row[:, 4]
                active = active[at[active] < length[active]]
            if not out:
                continue
            owner, inner, size, sequence, offset = (np.concatenate(x) for x in zip(*out))
            sums, ids = crc[owner].copy(), batch.column("ids")
            parts: list[bytes | None] = [None] * len(owner)
            for i in range(len(owner)) if payload else np.flatnonzero(size < length[owner]).tolist():
                raw = np.frombuffer(ids[int(owner[i])].as_buffer(), width)[inner[i] : inner[i] + size[i]].astype("<u4").tobytes()
                sums[i] = zlib.crc32(raw)
                parts[i] = raw if payload else None
            arrays = [batch.column("doc_id").take(pa.array(owner)), *map(pa.array, (start[owner] + inner, size, sums, tokens[owner], sequence, offset))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(parts, pa.binary())] * payload], names=[*names, *["ids"] * payload])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, payload: bool = False) -> DataFrame:
    """docs: doc_id, text. One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and `ids`,
    little-endian, with `payload`).

    Every row of docs is a document of its own, also if its doc_id is null or repeats. Null or empty text is the end id
    alone; a text longer than `capacity` gives whole windows and a rest; other columns are left out. Documents are
    tokenised once and written; each task numbers its pieces by length, and what the tasks before it have is added from
    a table of (task, length) counts, so no piece is sorted or shuffled. Only the number of pieces by length, `capacity`
    figures at most, reaches the driver, where minimum_slack() finds the windows. Sequences have no padding: all are
    `capacity` long but the last few, which are powers of two. No rows give none."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    from tokenizers import Tokenizer

    width = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.lit(0).alias("row"), "doc_id", "text")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, nth long, part int, ids binary"
    pieces = stash(arrow_stage(rows, _pieces(tokenizer, capacity, width), schema), "windows")
    by_task = stash(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places, _ = minimum_slack(counts, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = stash(by_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "ranks")
    torn = sorted({p.origin for p in places if p.length < p.origin})
    ids = F.col("ids") if payload else F.when(F.col("length").isin(torn), F.col("ids"))
    ranked = pieces.withColumn("ids", ids).join(small(before), ["part", "length"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("nth") + F.col("before")).alias("rank"), "ids")
    out = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * payload
    return arrow_stage(ranked, _place(places, capacity, width, payload), out)
