"""Best-fit packing of documents into sequences by bin completion."""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchyard.llm.base import arrow_stage, running_before, stash

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words met in several texts whose ids a Python worker keeps, about 30 MB, and words that it keeps within
#: a task until they are as many.
WORD_CACHE, PASSING = 150_000, 250_000
#: Nodes visited before the best packing found so far is taken; levels of the search that keep their place in memory.
NODES, LEVELS = 20_000, 64

Pattern = tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over lengths with counts: (pattern, how many sequences have it)."""
    open_: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in open_ or not open_[room]:
            insort(rooms, room)
        open_[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = min(capacity // length, left)
                times = max(1, left // each)
                put(capacity - each * length, ((length, each),), times)
                left -= each * times
                continue
            room = rooms[at]
            pattern, times = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            each = min(room // length, left)
            used = min(times, left // each)
            if used < times:
                put(room, pattern, times - used)
            put(room - each * length, (*pattern, (length, each)), used)
            left -= each * used
    return [x for room in rooms for x in open_[room]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by Martello and Toth's argument on long pieces."""
    lengths = sorted(counts)
    volume = sum(k * n for k, n in counts.items())
    best = -(-volume // capacity)
    for k in [0, *(x for x in lengths if x <= capacity // 2)]:
        large = sum(n for x, n in counts.items() if x > capacity - k)
        middle = [(x, n) for x, n in counts.items() if capacity // 2 < x <= capacity - k]
        low = sum(x * n for x, n in counts.items() if k <= x <= capacity // 2)
        room = sum((capacity - x) * n for x, n in middle)
        best = max(best, large + sum(n for _, n in middle) + max(0, -(-(low - room) // capacity)))
    return best


def completions(sizes: list[int], left: dict[int, int], room: int, most_waste: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of `room` that waste `most_waste` at most, one by one, fullest first, then with the longest
    pieces first. None is left out: a filling isn't given if a piece that is left would still fit into it, or if one
    piece would fill the room exactly. The sums that can be reached with the shorter pieces lead the search, so that it
    never runs into a dead end."""
    usable = sizes[: bisect_right(sizes, room)]
    if usable and usable[-1] == room:
        yield (room,)
        return
    reach = [1]  # bit t of reach[i]: the first i lengths can be added up to t
    for x in usable:
        bits, n, step = reach[-1], min(left[x], room // x), 1
        while n:
            step = min(step, n)
            bits |= bits << (x * step)
            n -= step
            step *= 2
        reach.append(bits & ((2 << room) - 1))

    def fill(i: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        for j in range(bisect_right(usable, total, 0, i) - 1, -1, -1):
            x = usable[j]
            if not reach[j + 1] >> total & 1:
                return
            for n in range(min(left[x], total // x), 0, -1):
                if reach[j] >> (total - n * x) & 1:
                    for rest in fill(j, total - n * x):
                        yield (x,) * n + rest

    for waste in range(min(room, most_waste) + 1):
        if reach[-1] >> (room - waste) & 1:
            small_ones = usable[: bisect_right(usable, waste)]
            for filling in fill(len(usable), room - waste):
                if all(filling.count(x) == left[x] for x in small_ones):
                    yield filling


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES) -> list[tuple[Pattern, int]]:
    """Packs lengths (1 to capacity, with counts) into few sequences: (pattern, times).

    Depth first: the longest piece left is filled up by each undominated completion in turn, as often at once as
    the counts allow, then once less, and so on. A branch ends when its waste exceeds what a packing one better than the
    incumbent could waste. Best-fit decreasing is the first incumbent. `nodes` is the only bound of the search, after
    which the incumbent stands; None searches until the optimum is proven, however long that takes."""
    counts = {k: n for k, n in counts.items() if n}
    best = best_fit(counts, capacity)
    best_n, floor = sum(n for _, n in best), lower_bound(counts, capacity)
    if best_n == floor:
        return best
    total = sum(k * n for k, n in counts.items())
    left, sizes = dict(counts), sorted(counts)
    path: list[tuple[tuple[int, ...], int]] = []
    waste = bins = seen = 0

    def options() -> Iterator[tuple[tuple[int, ...], int]]:
        top = sizes[-1]
        own = dict(left) | {top: left[top] - 1}
        for filling in completions([x for x in sizes if own[x]], own, capacity - top, (best_n - 1) * capacity - total - waste):
            whole = (top, *filling)
            for times in range(min(left[x] // n for x, n in Counter(whole).items()), 0, -1):
                yield whole, times

    def apply(filling: tuple[int, ...], times: int) -> None:
        nonlocal waste, bins
        for x, n in Counter(filling).items():
            left[x] -= n * times
            if not left[x]:
                sizes.pop(bisect_left(sizes, x))
        path.append((filling, times))
        waste += (capacity - sum(filling)) * times
        bins += times

    def undo() -> None:
        nonlocal waste, bins
        filling, times = path.pop()
        for x, n in Counter(filling).items():
            if not left[x]:
                insort(sizes, x)
            left[x] += n * times
        waste -= (capacity - sum(filling)) * times
        bins -= times

    # Of each level how many fillings were tried. Only the deepest levels keep their enumeration; others begin it anew.
    stack: list[list] = [[options(), 0]]
    while stack and (nodes is None or seen < nodes):
        if stack[-1][0] is None:
            stack[-1][0] = islice(options(), stack[-1][1], None)
        stack[-1][1] += 1
        chosen = next(stack[-1][0], None)
        if chosen is None:
            stack.pop()
            if path:
                undo()
            continue
        apply(*chosen)
        seen += 1
        if not sizes:
            if bins < best_n:
                best_n = bins
                merged: dict[Pattern, int] = defaultdict(int)
                for filling, times in path:
                    merged[tuple(sorted(Counter(filling).items(), reverse=True))] += times
                best = list(merged.items())
                if best_n == floor:
                    break
            undo()
        elif waste > (best_n - 1) * capacity - total:
            undo()
        else:
            stack.append([options(), 0])
            if len(stack) > LEVELS:
                stack[-1 - LEVELS][0] = None
    return best


#: Stands between words that are encoded together: a word of its own that is one token, found in no other word.
MARK = "\x01"


#: Words that normalisation leaves as they are and pre-tokenisation leaves whole.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: What the vocabulary writes at the end of a token that ends a word.
WORD_END = "</w>"


class Encoder:
    """A tokenizer, beside it one that skips what does nothing to plain words, and which ids end a word."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers, Tokenizer

        self.whole, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ids = self.whole.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        for token, i in ids.items():
            self.ends[i] = token.endswith(WORD_END)
        self.mark = self.whole.encode(MARK, add_special_tokens=False).ids[0]

    def ids(self, tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian, 4 bytes each) of words without ASCII white space. Many are encoded as one text: plain words
        are cut where a token ends a word, others at MARK, and those that hold MARK are encoded one by one."""
        out, rest = {}, []
        texts = [w.decode() for w in words]
        plain = [(w, t) for w, t in zip(words, texts) if PLAIN.fullmatch(t)]
        for i in range(0, len(plain), 4096):
            some = plain[i : i + 4096]
            ids = self.ids(self.plain, " ".join(t for _, t in some))
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) != len(some):  # a vocabulary that marks no ends
                rest += some
                continue
            raw = ids.tobytes()
            out.update((w, raw[a:b]) for (w, _), a, b in zip(some, [0, *cuts], cuts))
        rest += [(w, t) for w, t in zip(words, texts) if w not in out] if len(out) < len(words) else []
        marked = [(w, t) for w, t in rest if MARK not in t]
        for i in range(0, len(marked), 4096):
            some = marked[i : i + 4096]
            ids = self.ids(self.whole, f" {MARK} ".join(t for _, t in some))
            cuts = (np.flatnonzero(ids == self.mark) * 4).tolist()
            raw = ids.tobytes()
            out.update((w, raw[a:b]) for (w, _), a, b in zip(some, [0, *(c + 4 for c in cuts)], [*cuts, len(raw)]))
        for w, t in rest:
            if MARK in t:
                out[w] = self.ids(self.whole, t).tobytes()
        return out


#: What a worker keeps from task to task: an encoder and ids of words.
_known: dict[str, tuple[Encoder, dict[bytes, bytes]]] = {}

#: ASCII marks; the tokenizer always parts a run of them from a letter before it. (The apostrophe can belong to one after.)
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)


def learn(encoder: Encoder, words: set[bytes], known: dict[bytes, bytes]) -> None:
    """Adds words to `known`. A word that is letters and then marks gets the ids of the two parts, one after the other."""
    parted, fresh = [], set()
    for w in words:
        head = w.rstrip(MARKS)
        if head and len(head) < len(w) and (head[-1:].isalnum() if head[-1] < 128 else unicodedata.normalize("NFC", head[-4:].decode(errors="ignore")[-1:]).lower().isalpha()) and b"<|" not in w:
            tail = w[len(head) :]
            parted.append((w, head, tail))
            fresh.update(x for x in (head, tail) if x not in known)
        else:
            fresh.add(w)
    known.update(encoder.encode_words(list(fresh)))
    for w, head, tail in parted:
        known[w] = known[head] + known[tail]


def token_ids(path: str, end: int, batches) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch, and the ids (little-endian, 4 bytes each) of the texts in its third column, `end` after each. Ids are
    looked up by words between ASCII white space; the tokenizer drops white space and never joins words over it, so that
    is exact. A worker keeps the ids of words that several texts hold, WORD_CACHE of them at most; where fewer than half
    of the words are known, it starts anew."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _known:
        _known[path] = Encoder(path), {}
    encoder, known = _known[path]
    last = end.to_bytes(4, "little")
    passing: dict[bytes, bytes] = {}
    for batch in batches:
        asked = missed = 0
        out: list[bytes] = []
        texts = batch.column(2).cast(pa.large_binary() if pa.types.is_large_string(batch.schema.field(2).type) else pa.binary())
        for text in texts.to_pylist():
            text = text or b""
            if not (b"<|" in text or b"\xcc" in text or b"\xcd" in text):
                text = text.lower()  # the tokenizer does so too; only its own marks and combining marks come before
            words = text.split()
            found = list(map(known.get, words))
            asked += len(words)
            if None in found:
                at = [i for i, f in enumerate(found) if f is None]
                missed += len(at)
                if len(passing) > PASSING:
                    passing.clear()
                missing = {words[i] for i in at}
                seen = [w for w in missing if w in passing]
                if len(known) < WORD_CACHE:
                    known.update((w, passing[w]) for w in seen)
                if len(seen) < len(missing):
                    learn(encoder, missing.difference(seen), passing)
                for i in at:
                    found[i] = passing[words[i]]
            out.append(b"".join([*found, last]))
        if len(known) >= WORD_CACHE and 2 * missed > asked:  # another kind of text
            known.clear()
        yield batch, out


def tokenize(path: str, capacity: int, payload: bool):
    """A mapInArrow function: (row, doc_id, text) to pieces."""

    def run(batches):
        types = (pa.int64(), None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ("row", "doc_id", "piece", "start", "length", "ids_crc32", "ids")
        keep = 7 if payload else 6
        for batch, found in token_ids(path, 0, batches):
            out: list[list] = [[], [], [], [], [], [], []]
            for row, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), found):
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, x in zip(out, (row, doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part if payload else None)):
                        column.append(x)
            arrays = [pa.array(x, t or batch.schema.field(1).type) for x, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays(arrays[:keep], names=names[:keep])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, payload: bool = False, nodes: int | None = NODES) -> DataFrame:
    """docs: doc_id, text. One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and `ids`,
    little-endian, with `payload`).

    Every row of docs is a document of its own, also if its doc_id is null or repeats. Null or empty text is the end id
    alone. Documents are tokenised once; only the number of pieces by length, at most `capacity` figures, reaches the
    driver. The packing found there is a list of patterns; each piece gets its place by its rank among the pieces of its
    length, and ranks are counted in ranges, so that a very frequent length doesn't land in one task. No rows give none."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * payload
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    pieces = arrow_stage(rows, tokenize(tokenizer, capacity, payload), schema)
    at = (F.xxhash64("row", "doc_id", "piece").bitwiseAND(F.lit((1 << 52) - 1)).cast("double")) / F.lit(2.0**52)
    pieces = stash(pieces.withColumns({"at": at, "one": F.lit(1)}), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = sorted(bin_completion(counts, capacity, nodes)) if counts else []
    # For each length: from which rank on, which pattern, its first sequence, copies in a sequence and first offset.
    table, given, base = [], defaultdict(int), 0
    for pattern, times in patterns:
        offset = 0
        for length, copies in pattern:
            table.append((length, given[length], base, copies, offset))
            given[length] += copies * times
            offset += copies * length
        base += times
    table.sort()
    lengths, ranks, bases, copies, offsets = (np.array(x, np.int64) for x in (zip(*table) if table else [[]] * 5))
    keys = lengths * (1 << 50) + ranks

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "before"))
            at = np.searchsorted(keys, length * (1 << 50) + rank, "right") - 1
            nth = rank - ranks[at]
            more = [pa.array(bases[at] + nth // copies[at]), pa.array(offsets[at] + nth % copies[at] * length)]
            names = [n for n in batch.schema.names if n not in ("row", "at", "one", "before")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *more], names=[*names, "sequence_id", "offset"])

    ranked = running_before(pieces, ["length"], "at", ["row", "piece"], "one")
    out = f"length long, doc_id {kind}, piece int, start long, ids_crc32 long" + ", ids binary" * payload
    ranked = ranked.select("length", "doc_id", "piece", "start", "ids_crc32", *["ids"] * payload, "row", "at", "one", F.col("before").cast("long").alias("before"))
    return arrow_stage(ranked, place, f"{out}, sequence_id long, offset long").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * payload)
