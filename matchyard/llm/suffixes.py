"""Exact substring deduplication over the suffixes of all documents that can have a partner."""

from __future__ import annotations

import hashlib
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchyard.llm.base import arrow_stage, BROADCAST_KEYS, ints, pull, put, stash, text_blocks
from matchyard.llm.labelled import share
from matchyard.llm.words import _BYTE, SEGMENT, mix, powers, span_hashes

#: Bytes of a string that counts as repeated; bytes of the gram that anchors a suffix; bytes of a token.
WINDOW, GRAM, TOKEN = 200, 32, 8
#: Bits of the filter of repeated grams: 16 per gram, between these powers of two (32 KB to 64 MB).
FILTER_BITS = (18, 29)
#: A gram's suffixes are split by their next tokens from as many occurrences on as a partition has at an even deal, but
#: within these bounds.
HOT = (512, 65_536)
#: One gram in SHOWN tells its bytes, for splitters, and every one that a partition holds OFTEN; about SPLITTERS of each
#: kind are looked at.
SHOWN, OFTEN, SPLITTERS = 64, 8, 50_000
#: Suffixes that begin at most so many bytes before their anchor are known by what follows it, others by what precedes it.
NEAR = 84


def suffix_runs(data: np.ndarray, offsets: np.ndarray):
    """Runs of neighbouring windows with the same anchor: (first position, windows, document, anchor's position, gram hash).

    A window's anchor is the gram in it with the least hash, so equal windows have it at the same place. Windows don't
    cross documents; runs end where a segment does, equally for nobody, which costs partners but loses none: windows
    are compared one by one in the end."""
    w = WINDOW - GRAM + 1
    up, down = powers()
    steps = np.zeros(len(data) + 1, np.int32)
    np.add.at(steps, offsets[:-1], 1)
    np.add.at(steps, np.maximum(offsets[:-1], offsets[1:] - WINDOW + 1), -1)
    inside = np.cumsum(steps)[: len(data)] > 0
    for base in range(0, max(0, len(data) - WINDOW + 1), SEGMENT - WINDOW + 1):
        part = data[base : base + SEGMENT]
        m = len(part) - WINDOW + 1
        at = np.flatnonzero(inside[base : base + m])
        if not len(at):
            continue
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(part) - GRAM + 1])
        key = (grams & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(grams), dtype=np.uint64)
        have = 1
        while have * 2 <= w:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        key = np.minimum(key[:m], key[w - have : w - have + m])
        anchor = (key[at] & np.uint64(0xFFFFF)).astype(np.int64)
        doc = np.searchsorted(offsets, at + base, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        # anchors have small hashes by choice; mixed again they are spread evenly
        yield at[first] + base, count, doc[first], anchor[first] + base, mix(grams[anchor[first]] ^ np.uint64(0x27D4EB2F165667C5))


def tokens_at(data: np.ndarray) -> np.ndarray:
    """The token that begins at each byte, as a number in the order of bytes."""
    out = np.empty(max(0, len(data) - TOKEN + 1), np.uint64)
    for k in range(min(TOKEN, len(out))):
        n = (len(data) - k) // TOKEN
        out[k::TOKEN] = data[k : k + n * TOKEN].view(">u8")
    return out


def multikey_quicksort(tokens: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorts suffixes, which begin `at` places of a text, within their group by their first `length` bytes. Returns the
    order, and for each place in it whether its suffix equals the one before there in all these bytes.

    All open segments are parted at once: a segment's middle suffix lends its token as pivot, less, equal and greater
    are three new segments, and those that were equal go on with the next token. A segment ends when one suffix is left
    or when no token is."""
    n = len(at)
    order = np.argsort(group, kind="stable")
    out, same = order.copy(), np.zeros(n, bool)
    steps = -(-length // TOKEN)
    place, idx = np.arange(n), order
    seg = np.cumsum(np.append(False, group[order][1:] != group[order][:-1]))[:n]
    depth = np.zeros(int(seg[-1]) + 1 if n else 0, np.int64)
    while len(idx):
        begin = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        count = np.diff(np.append(begin, len(seg)))
        done = depth >= steps
        inner = np.repeat(done, count)
        inner[begin] = False
        same[place[inner]] = True
        keep = (count > 1) & ~done
        begin, count, depth, kept = begin[keep], count[keep], depth[keep], np.repeat(keep, count)
        place, idx = place[kept], idx[kept]
        if not len(idx):
            break
        seg = np.repeat(np.arange(len(count)), count)
        # the last token may reach over the end: it begins earlier, which repeats bytes known to be equal
        token = tokens[at[idx] + np.minimum(depth * TOKEN, length - TOKEN)[seg]]
        pivot = token[np.cumsum(count) - count + count // 2][seg]
        part = seg * 3 + 1 + (token > pivot) - (token < pivot)
        by = np.argsort(part, kind="stable")
        idx, part = idx[by], part[by]
        out[place] = idx
        new = np.append(True, part[1:] != part[:-1])
        seg = np.cumsum(new) - 1
        depth = depth[part[new] // 3] + (part[new] % 3 == 1)
    return out, same


def _skip(batch: pa.RecordBatch, gone: np.ndarray | None) -> pa.Array:
    """The texts of a batch (k1, k2, text), null where (k1, k2) is among the sorted keys of copies."""
    text = batch.column(2)
    if gone is None or not len(gone):
        return text
    key = batch.column(0).to_numpy() ^ mix(batch.column(1).to_numpy().view(np.uint64)).view(np.int64)
    hit = gone[np.minimum(np.searchsorted(gone, key), len(gone) - 1)] == key
    return pc.if_else(pa.array(~hit), text, pa.scalar(None, text.type))


def _grams(gone):
    """(gram, count, 1 where that is at least OFTEN, the gram's four tokens where it is shown), added up by partition."""

    def run(batches):
        found: list[tuple] = []  # gram, count, tokens

        def add_up() -> tuple:
            g, first, inverse = np.unique(np.concatenate([x for x, _, _ in found]), return_index=True, return_inverse=True)
            n = np.bincount(inverse, np.concatenate([x for _, x, _ in found]), minlength=len(g)).astype(np.int64)
            return g, n, np.concatenate([x for _, _, x in found])[first]

        for batch in batches:
            for _, _, data, offsets in text_blocks(_skip(batch, gone.value if gone else None)):
                for _, _, _, anchor, grams in suffix_runs(data, offsets):
                    g, first, n = np.unique(grams, return_index=True, return_counts=True)
                    found.append((g, n, np.ascontiguousarray(data[anchor[first][:, None] + np.arange(GRAM)]).view(f"V{GRAM}").ravel()))
            if len(found) > 32:
                found = [add_up()]
        if not found:
            return
        g, n, lead = add_up()
        often = n >= OFTEN
        shown = often | (g % np.uint64(SHOWN) == 0)
        for i in range(0, len(g), 1 << 16):
            part = slice(i, i + (1 << 16))
            tokens = (lead[part].view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64).reshape(-1, GRAM // TOKEN)
            yield pa.RecordBatch.from_arrays([pa.array(ints(g[part])), pa.array(n[part]), pa.array(often[part].astype(np.int32)), *(pa.array(tokens[:, k], mask=~shown[part]) for k in range(GRAM // TOKEN))], names=["gram", "n", "often", "t1", "t2", "t3", "t4"])

    return run


_RUNS = "bucket int, gram long, lead binary, context long, token long, k1 long, k2 long, start long, windows int, anchor int, answer boolean, body binary"
_RUN_NAMES = [x.split()[0] for x in _RUNS.split(", ")]
_RUN_TYPES = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())


def _split(p0, count, doc, anchor, gram, parts):
    """Runs of heavy grams in two: suffixes that begin NEAR before the anchor at most, and those that begin earlier.
    Returns the runs in order, and of each half of a heavy one (begin, end) of the tokens that it is known by, else 0."""
    heavy = parts > 1
    cut = np.clip(anchor - NEAR, p0, p0 + count)  # the first suffix of the second half
    first = np.where(heavy, cut - p0, count)
    two = np.stack([first, count - first], axis=1).ravel()
    begin = np.stack([p0, p0 + first], axis=1).ravel()
    a = np.repeat(anchor, 2)
    late = np.tile([False, True], len(p0))
    known_from = np.where(np.repeat(heavy, 2), np.where(late, a, a - NEAR - 1), 0)
    known_to = np.where(np.repeat(heavy, 2), np.where(late, a - NEAR + WINDOW, a), 0)
    some = np.flatnonzero(two)
    return begin[some], two[some], np.repeat(doc, 2)[some], a[some], np.repeat(gram, 2)[some], np.repeat(parts, 2)[some], known_from[some], known_to[some]


def _runs(gone, bits, filter_bits: int, hot, splitters):
    """Runs with a repeated gram. A run whose bytes were met before in the batch is answered at once (gram null: bytes to
    remove), and so is the first of them, which still goes on as a partner for others."""

    def run(batches):
        cuts, (hot_grams, hot_parts) = splitters.value, hot.value
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cols: list[list] = [[] for _ in range(9)]
            for row, _, data, offsets in text_blocks(_skip(batch, gone.value if gone else None)):
                raw = data.tobytes()
                for p0, count, doc, anchor, gram in suffix_runs(data, offsets):
                    at = gram >> np.uint64(64 - filter_bits)
                    hit = np.flatnonzero(bits.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                    if not len(hit):
                        continue
                    p0, count, doc, anchor, gram = p0[hit], count[hit], doc[hit], anchor[hit], gram[hit]
                    j = np.minimum(np.searchsorted(hot_grams, gram), max(0, len(hot_grams) - 1))
                    parts = np.where(hot_grams[j] == gram, hot_parts[j], 1) if len(hot_grams) else np.ones(len(gram), np.int64)
                    p0, count, doc, anchor, gram, parts, known_from, known_to = _split(p0, count, doc, anchor, gram, parts)
                    end = p0 + count - 1 + WINDOW
                    token = mix(span_hashes(data, p0, end) ^ (anchor - p0).astype(np.uint64))
                    context = np.zeros(len(p0), np.uint64)
                    heavy = np.flatnonzero(known_to)
                    if len(heavy):
                        context[heavy] = [zlib.crc32(raw[a:b]) + 1 + len(raw[a:b]) * 2**33 for a, b in zip(known_from[heavy].tolist(), known_to[heavy].tolist())]
                    leads = np.ascontiguousarray(data[anchor[:, None] + np.arange(GRAM)]).view(f"S{GRAM}").ravel()
                    bucket = (np.searchsorted(cuts, leads, "right") + mix(context) % parts.astype(np.uint64) * (context > 0)).astype(np.int64) % (len(cuts) + 1)
                    lead = [raw[x : x + GRAM] for x in anchor.tolist()]
                    body = [raw[x:y] for x, y in zip(p0.tolist(), end.tolist())]
                    for c, x in zip(cols, (bucket, gram, context, token, doc + row, p0 - offsets[doc], count, anchor - p0)):
                        c.append(x)
                    cols[8].append((lead, body))
            if not cols[0]:
                continue
            bucket, gram, context, token, doc, start, count, anchor = (np.concatenate(c) for c in cols[:8])
            lead, body = ([x for part in cols[8] for x in part[k]] for k in (0, 1))
            _, first, inverse = np.unique(mix(gram ^ mix(context)) ^ token, return_index=True, return_inverse=True)
            head = first[inverse]
            again = np.array([h != i and body[h] == body[i] for i, h in enumerate(head.tolist())])
            answered = again.copy()
            answered[head[again]] = True
            at = np.flatnonzero(answered)
            if len(at):  # in order of document and position: neighbours that meet are one span
                at = at[np.lexsort((start[at], doc[at]))]
                d, a, b = doc[at], start[at], start[at] + count[at] - 1 + WINDOW
                new = np.append(True, (d[1:] != d[:-1]) | (a[1:] > np.maximum.accumulate(b + d * (1 << 40))[:-1] - d[1:] * (1 << 40)))
                i = np.flatnonzero(new)
                b = np.maximum.reduceat(b, i)
                for k in range(0, len(i), 20_000):
                    part = i[k : k + 20_000]
                    n = len(part)
                    known = {"bucket": bucket[at[part]], "k1": k1[d[part]], "k2": k2[d[part]], "start": a[part], "windows": b[k : k + 20_000] - a[part] + 1 - WINDOW}
                    yield pa.RecordBatch.from_arrays([pa.array(known[c], t) if c in known else pa.nulls(n, t) for c, t in zip(_RUN_NAMES, _RUN_TYPES)], names=_RUN_NAMES)
            rest = np.flatnonzero(~again)
            for k in range(0, len(rest), 20_000):
                i = rest[k : k + 20_000]
                some = i.tolist()
                values = (bucket[i], ints(gram[i]), [lead[x] for x in some], ints(context[i]), ints(token[i]), k1[doc[i]], k2[doc[i]], start[i], count[i], anchor[i], ~answered[i], [body[x] for x in some])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, _RUN_TYPES)], names=_RUN_NAMES)

    return run


_FOUND = "k1 long, k2 long, a long, b long, side int, edge binary"


def _spans(k1, k2, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())], names=["k1", "k2", "a", "b", "side", "edge"])


def _bucket(rows: list[pa.RecordBatch], ends: list) -> pa.RecordBatch:
    """Sorts the suffixes of whole groups (lead, context) and returns the bytes that equal neighbours cover. The least and
    the greatest suffix are added to `ends`: (bytes, k1, k2, start, whether an answer is wanted)."""
    t = pa.Table.from_batches(rows).combine_chunks()
    context, token, start, windows, anchor = (t.column(c).to_numpy() for c in ("context", "token", "start", "windows", "anchor"))
    answer = t.column("answer").to_numpy(zero_copy_only=False)
    lead, body = t.column("lead").combine_chunks(), t.column("body").combine_chunks()
    if isinstance(body, pa.ChunkedArray):
        lead, body = lead.chunk(0), body.chunk(0)
    n = len(t)
    leads = np.frombuffer(lead.buffers()[2], f"V{GRAM}")[lead.offset : lead.offset + n]
    group = np.cumsum(np.append(False, (leads[1:] != leads[:-1]) | (context[1:] != context[:-1])))[:n]
    # runs with the same bytes are one class, known by its first; a hash finds them, the bytes decide
    order = np.lexsort((token, group))
    new = np.append(True, (token[order][1:] != token[order][:-1]) | (group[order][1:] != group[order][:-1]))
    head = np.empty(n, np.int64)
    head[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    alike = pc.equal(body, body.take(pa.array(head))).to_numpy(zero_copy_only=False) & (anchor == anchor[head])
    head = np.where(alike, head, np.arange(n))
    heads, of, times = np.unique(head, return_inverse=True, return_counts=True)
    whole = np.flatnonzero(times[of] > 1)
    several = np.bincount(group[heads])[group[heads]] > 1
    sorted_heads = heads[several | (np.arange(len(heads)) == 0) | (np.arange(len(heads)) == len(heads) - 1)]
    base = np.cumsum(np.append(0, pc.binary_length(body.take(pa.array(sorted_heads))).to_numpy()))
    text = np.frombuffer(b"".join(body[int(i)].as_buffer() for i in sorted_heads), np.uint8)
    owner = np.repeat(np.arange(len(sorted_heads)), windows[sorted_heads])
    off = np.arange(len(owner)) - np.repeat(np.cumsum(windows[sorted_heads]) - windows[sorted_heads], windows[sorted_heads])
    row = sorted_heads[owner]
    # equal suffixes have their anchor at the same distance
    place, same = multikey_quicksort(tokens_at(text), base[owner] + off, group[row] * WINDOW + anchor[row] - off)
    for at in (place[0], place[-1]):
        i = row[at]
        ends.append((text[base[owner[at]] + off[at] :][:WINDOW].tobytes(), t.column("k1")[int(i)].as_py(), t.column("k2")[int(i)].as_py(), int(start[i] + off[at]), bool(answer[i])))
    repeated = np.zeros(len(place), bool)
    repeated[place[same | np.append(same[1:], False)]] = True
    repeated &= times[of[row]] == 1  # a class of several repeats whole
    row, off = row[repeated], off[repeated]  # in order of run and place
    new = np.append(True, (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1))[: len(row)]
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(row)) - 1 if len(i) else i
    hit = np.concatenate([whole, row[i]])
    a = np.concatenate([start[whole], start[row[i]] + off[i]])
    b = np.concatenate([start[whole] + windows[whole] - 1 + WINDOW, start[row[i]] + off[j] + WINDOW])
    ok = answer[hit]
    return _spans(t.column("k1").to_numpy()[hit[ok]], t.column("k2").to_numpy()[hit[ok]], a[ok], b[ok])


#: Bytes of runs that a bucket sorts at once, which takes some thirty times as many; a group (lead, context) is never torn.
AT_ONCE = 1 << 20


def _pieces(batches):
    """The same rows in batches of AT_ONCE bytes at most, if a row isn't longer."""
    for batch in batches:
        step = max(1, len(batch) * AT_ONCE // max(1, batch.nbytes))
        yield from (batch.slice(i, step) for i in range(0, len(batch), step))


def _sort_buckets(batches):
    """A bucket's runs arrive sorted by (lead, context), spilling where they must. Complete groups are sorted together,
    about AT_ONCE bytes a time. Bytes that were answered before (gram null) pass through. At the end the bucket's least
    (side 0) and greatest (side 1) suffix, to be compared with those of the buckets beside it."""
    held: list[pa.RecordBatch] = []
    ends: list[tuple] = []
    size, bucket = 0, 0
    for batch in _pieces(batches):
        known = batch.column("gram").is_null()
        if known.true_count:
            done = batch.filter(known)
            a = done.column("start").to_numpy()
            yield _spans(done.column("k1").to_numpy(), done.column("k2").to_numpy(), a, a + done.column("windows").to_numpy() - 1 + WINDOW)
            batch = batch.filter(batch.column("gram").is_valid())
        if not len(batch):
            continue
        bucket = batch.column("bucket")[0].as_py()
        size += batch.nbytes
        if size > AT_ONCE and held:
            old = held[-1].slice(len(held[-1]) - 1)
            same = pc.and_(pc.equal(batch.column("lead"), old.column("lead")[0]), pc.equal(batch.column("context"), old.column("context")[0])).to_numpy(zero_copy_only=False)
            cut = len(batch) if same.all() else int(np.argmin(same))
            if cut < len(batch):
                held.append(batch.slice(0, cut))
                yield _bucket([x for x in held if len(x)], ends)
                ends[1:] = ends[-1:]
                batch = batch.slice(cut)
                held, size = [], batch.nbytes
        held.append(batch)
    if held:
        yield _bucket(held, ends)
    if ends:
        two = [(0, *ends[0]), (1, *ends[-1])]
        sides, edges, k1, k2, a, wanted = zip(*two)
        yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(a), pa.array([x + WINDOW if w else x for x, w in zip(a, wanted)]), pa.array([2 * bucket + x for x in sides], pa.int32()), pa.array(edges, pa.binary())], names=["k1", "k2", "a", "b", "side", "edge"])


def across_buckets(found: DataFrame) -> DataFrame:
    """Spans of a bucket's last suffix and the next bucket's first where these are equal. Two rows a bucket are compared."""
    ends = found.where("edge is not null")
    order = Window.orderBy("side")
    before, after = F.lag("edge").over(order) == F.col("edge"), F.lead("edge").over(order) == F.col("edge")
    return ends.withColumn("equal", F.coalesce(before & (F.col("side") % 2 == 0), F.lit(False)) | F.coalesce(after & (F.col("side") % 2 == 1), F.lit(False))).where("equal and b > a").select("k1", "k2", "a", "b")


def _cut(batches):
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        names = batch.schema.names
        text = batch.column(names.index("text"))
        starts, ends = batch.column(names.index("a")), batch.column(names.index("b"))
        for i in range(len(batch)):
            data = (text[i].as_py() or "").encode()
            spans, removed, kept, at = 0, 0, [], 0
            if starts[i].is_valid and len(starts[i]):
                a = np.asarray(starts[i].values.to_numpy(zero_copy_only=False), np.int64)
                b = np.asarray(ends[i].values.to_numpy(zero_copy_only=False), np.int64)
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
                for x, y in zip(a[new], b[np.append(new[1:], len(a)) - 1]):
                    kept.append(data[at:x])
                    at = int(y)
                    spans += 1
                    removed += int(y - x)
            kept.append(data[at:])
            rest = b"".join(kept)
            for c, x in zip(out, (len(data), removed, spans, hashlib.sha256(rest).hexdigest(), rest.decode(errors="ignore") if text[i].is_valid else None)):
                c.append(x)
        passed = [n for n in names if n not in ("a", "b", "text")]
        arrays = [batch.column(names.index(n)) for n in passed]
        arrays += [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*passed, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs: doc_id, text and the columns in `keep`. One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    `kept` (the remaining text; bytes of a character that was cut apart are left out of it, not of the digest), `keep`.

    1. Documents with the same text are found first; all but one per text stay out of the search and lose every byte
       (from 200 bytes on). 2. Every document's suffixes are anchored (see `suffix_runs`); a filter of the anchor grams
       that occur twice, of bounded size and without false negatives, drops suffixes that can't have a partner. Beyond
       its bound a join by gram drops them too.
    3. The rest is range-partitioned by its leading tokens, the 32 bytes of the anchor: splitters come from a sample of the
       repeated grams with their counts, and bucket k is partition k. A gram heavier than a bucket is split by its next
       tokens: suffixes that begin near the anchor by the bytes after it, others by the bytes before it.
    4. Buckets are sorted, by leading tokens in Spark, which may spill, and then suffix by suffix by multikey quicksort over
       tokens of 8 bytes; neighbours with the same 200 bytes are repeats. The last suffix of a bucket is compared with the
       first of the next. Equal suffixes have equal leading and next tokens, so they meet in one bucket.
    Hashes only deal, filter and find candidates; bytes decide, but for whole texts (128 bits of hash and the length).
    Null or empty text has no bytes; rows that repeat are copies; a null doc_id is as good as
    any; an empty table gives none."""
    spark = docs.sparkSession
    names = {c: F.col(f"`{c}`") for c in keep}
    rows = docs.select(F.xxhash64("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), "text")
    keys = stash(rows.select("k1", "k2", F.xxhash64(F.lit(7), "text").alias("k3"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).where("n >= 200"), "texts")
    copies = keys.groupBy("k2", "k3", "n").agg(F.count(F.lit(1)).alias("times"), F.min("k1").alias("one")).where("times > 1")
    members = stash(keys.join(copies, ["k2", "k3", "n"]).select("k1", "k2", "n", (F.col("k1") != F.col("one")).alias("other")), "copies")
    n_gone = members.where("other").count()
    gone = None
    if 0 < n_gone <= BROADCAST_KEYS:
        pairs = pull(members.where("other").select("k1", "k2"))
        gone = put(spark, np.unique(pairs.k1.to_numpy() ^ mix(pairs.k2.to_numpy().view(np.uint64)).view(np.int64)))
    elif n_gone:
        rows = rows.join(members.where("other").select("k1", "k2").distinct(), ["k1", "k2"], "left_anti").select("k1", "k2", "text")

    tokens = ("t1", "t2", "t3", "t4")
    counted = arrow_stage(rows, _grams(gone), "gram long, n long, often int, t1 long, t2 long, t3 long, t4 long")
    grams = stash(counted.groupBy("gram").agg(F.sum("n").alias("n"), F.max("often").alias("often"), *(F.max(t).alias(t) for t in tokens)).where("n > 1"), "grams")
    n_grams = grams.count()
    filter_bits = min(max(FILTER_BITS[0], int(16 * n_grams).bit_length()), FILTER_BITS[1])
    at = F.shiftrightunsigned("gram", 64 - filter_bits)
    maps = grams.groupBy(F.shiftright(at, 15).alias("slice")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    bits = np.zeros(1 << (filter_bits - 3), np.uint8)
    for r in maps:
        bits[r["slice"] << 12 : (r["slice"] + 1) << 12] |= np.frombuffer(r["bits"], np.uint8)[: min(4096, len(bits))]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    floor = min(max(HOT[0], (grams.agg(F.sum("n")).first()[0] or 0) // partitions), HOT[1])
    hot = grams.where(F.col("n") >= floor)
    while hot.count() > BROADCAST_KEYS:
        floor *= 2
        hot = grams.where(F.col("n") >= floor)
    frame = pull(hot.select("gram", "n"))
    order = np.argsort(frame.gram.to_numpy(np.int64).view(np.uint64))
    # as many parts as buckets of `floor`, and twice as many, for parts are uneven
    table = frame.gram.to_numpy(np.int64).view(np.uint64)[order], 1 + 2 * frame.n.to_numpy(np.int64)[order] // floor
    # grams that are frequent somewhere are all shown; of the others each stands for SHOWN. What is beyond `floor` is split
    shown = grams.where("t1 is not null").withColumn("weight", F.least("n", F.lit(floor)) * F.when(F.col("often") == 1, 1).otherwise(SHOWN))
    some = [pull(share(shown.where(F.col("often") == k), SPLITTERS, "gram")) for k in (0, 1)]
    some = some[0].merge(some[1], how="outer").sort_values(list(tokens))
    weight = np.cumsum(some.weight.to_numpy(np.int64))
    edges = np.unique(np.searchsorted(weight, weight[-1] * np.arange(1, partitions) / partitions)) if len(weight) else np.zeros(0, int)
    lead = np.ascontiguousarray((some[list(tokens)].to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")[edges])
    share_out = partial(put, spark)
    splitters = share_out(np.unique(lead.view(f"S{GRAM}").ravel()))
    runs = arrow_stage(rows, _runs(gone, share_out(bits), filter_bits, share_out(table), splitters), _RUNS)
    if 16 * n_grams > 1 << FILTER_BITS[1]:
        runs = runs.where("gram is null").unionByName(runs.where("gram is not null").join(grams.select("gram"), "gram", "left_semi").select(*_RUN_NAMES))
    bound = runs.repartitionById(partitions, "bucket").sortWithinPartitions("lead", "context")
    found = stash(arrow_stage(bound, _sort_buckets, _FOUND), "found")
    found = found.where("edge is null").select("k1", "k2", "a", "b").unionByName(across_buckets(found))
    whole = members.select("k1", "k2", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")).distinct()
    spans = found.unionByName(whole).groupBy("k1", "k2").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    spans = spans.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    source = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("_k1"), F.xxhash64("text").alias("_k2"), *(names[c].alias(f"_keep_{i}") for i, c in enumerate(keep)))
    joined = source.join(spans, ["_k1", "_k2"], "left").select("doc_id", "text", "a", "b", *(f"_keep_{i}" for i in range(len(keep))))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("a", "b", "text")]
    out = arrow_stage(joined, _cut, ", ".join([*fields, "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", "kept string"]))
    return out.withColumnsRenamed({f"_keep_{i}": c for i, c in enumerate(keep)})
