"""The trie of conversations by their turns: LOUDS tries of ranges of sorted turn sequences, upper levels merged apart."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchyard.llm.base import arrow_stage, pull, small, stash

#: Conversations that share their first turns, and how many: below MOST, by the checksum of the id.
FAMILY, MOST = 100, 6
#: Turns of a conversation that stand in one row; what comes after them is a trie of its own, hung below.
SEGMENT = 1 << 10
#: Sequences that one task takes without ranges, and turns of a trie that is held at once.
ALONE, CHUNK = 5_000, 500_000
#: Ids of a text that is hashed in one go.
IDS = 20_000
#: Bytes of a turn in a path: its digest and its text's code points.
WIDTH = 24
ROOT = bytes(WIDTH)
NONE_SHA = hashlib.sha256(b"").hexdigest()


# -- tries --------------------------------------------------------------------------------------------------------------


def louds(degrees: np.ndarray) -> np.ndarray:
    """The level-order unary degree sequence, packed: for each node in level order a one for each child, then a zero."""
    bits = np.ones(int(degrees.sum()) + len(degrees), np.uint8)
    bits[np.cumsum(degrees + 1) - 1] = 0
    return np.packbits(bits)


def parents(packed: np.ndarray, nodes: int) -> np.ndarray:
    """Of each node but the first its parent: the k-th one belongs to node k, and the zeros before it are the nodes
    whose children are all listed."""
    ones = np.flatnonzero(np.unpackbits(packed, count=2 * nodes - 1))
    return ones - np.arange(len(ones))


class Trie:
    """A trie in level order of sorted paths: node 0 stands above all; `labels` of the others, `bits` as louds() has them,
    `levels` with the first node of each level (and one more entry), `ends` with the node that each path ends at."""

    def __init__(self, paths: list[bytes]):
        lengths = np.array([len(p) // WIDTH for p in paths])
        entries = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, WIDTH // 8)
        starts = np.cumsum(lengths) - lengths
        self.ends = np.zeros(len(paths), np.int64)
        labels, degrees, self.levels, total = [], [], [0, 1], 1
        active, node = np.arange(len(paths)), np.zeros(len(paths), np.int64)
        for depth in range(int(lengths.max(initial=0))):
            more = lengths[active] > depth
            active, node = active[more], node[more]
            entry = entries[starts[active] + depth]
            fresh = np.ones(len(active), bool)
            fresh[1:] = (node[1:] != node[:-1]) | (entry[1:] != entry[:-1]).any(axis=1)
            labels.append(entry[fresh])
            degrees.append(np.bincount(node[fresh] - self.levels[-2], minlength=self.levels[-1] - self.levels[-2]))
            node = total - 1 + np.cumsum(fresh)
            total += int(fresh.sum())
            self.levels.append(total)
            self.ends[active] = node
        degrees.append(np.zeros(self.levels[-1] - self.levels[-2], np.int64))
        self.labels = np.concatenate(labels) if labels else np.zeros((0, WIDTH // 8), np.uint64)
        self.degrees = np.concatenate(degrees).astype(np.int64)
        self.bits = louds(self.degrees)
        self.parent = np.concatenate([[-1], parents(self.bits, total)]).astype(np.int64)

    def path_to(self, node: int) -> bytes:
        out = []
        while node > 0:
            out.append(self.labels[node - 1].tobytes())
            node = int(self.parent[node])
        return b"".join(reversed(out))

    def above(self, end: int, length: int) -> list[int]:
        """The nodes of the first `length` levels on the way to a node."""
        way = []
        while end > 0:
            way.append(end)
            end = int(self.parent[end])
        return way[::-1][:length]


def common(a: bytes, b: bytes) -> int:
    """How many turns two paths begin with alike."""
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(p, np.uint64, n * WIDTH // 8).reshape(n, -1) for p in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n


_OUT = "conv_id long, depth long, parent_conv_id long, parent_key binary, n long, children long, leaves long, saved long, sha string, key binary, path binary"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]


def _finish(rows: list[dict], before: int, after: int, least: int, depth: int, keys: bool) -> pa.RecordBatch:
    """The nodes of sorted rows. Those that other rows share, on the first path down to `before` turns and on the last
    down to `after`, and all of the first `least` levels are given as rows of their path; of the others the totals are
    final. depth: of a path of one turn."""
    trie = Trie([r["path"] for r in rows])
    nodes = len(trie.degrees)
    n, children, leaves, saved = (np.zeros(nodes, np.int64) for _ in range(4))
    conv = np.full(nodes, np.iinfo(np.int64).max)
    for total, name in ((n, "n"), (children, "children"), (leaves, "leaves"), (saved, "saved")):
        np.add.at(total, trie.ends, np.array([r[name] for r in rows], np.int64))
    np.minimum.at(conv, trie.ends, np.array([r["conv_id"] for r in rows], np.int64))
    sha = np.full(nodes, None, object)
    for end, r in zip(trie.ends.tolist(), rows):
        sha[end] = r["sha"] or sha[end]
    shared = np.zeros(nodes, bool)
    shared[: trie.levels[least + 1]] = True
    shared[[*trie.above(int(trie.ends[0]), before), *trie.above(int(trie.ends[-1]), after)]] = True
    points = np.concatenate([[0], trie.labels[:, -1].copy().view(">i8")])
    level = np.repeat(np.arange(len(trie.levels) - 1), np.diff(trie.levels))
    for first, last in zip(trie.levels[-2:0:-1], trie.levels[:1:-1]):  # reverse level order
        own = first + np.flatnonzero(~shared[first:last])
        up = trie.parent[own]
        children[own] += trie.degrees[own]
        leaves[own] += children[own] == 0
        saved[own] += (n[own] - 1) * points[own]
        for total in (n, leaves, saved):
            np.add.at(total, up, total[own])
        np.minimum.at(conv, up, conv[own])
        np.add.at(children, up[shared[up]], 1)
    done = np.flatnonzero(~shared)
    up = trie.parent[done]
    open_, known = shared[up], {int(u): hashlib.md5(trie.path_to(int(u))).digest() for u in np.unique(up[shared[up]]) if u}
    merged = np.flatnonzero(shared)[1:]
    merged = merged[(n[merged] > 0)]
    both = np.concatenate([done, merged])
    pad = lambda x: [*x, *[None] * len(merged)]
    columns = [
        conv[both], level[both] - 1 + depth, pad([None if o else int(c) for o, c in zip(open_, conv[up])]), pad([known.get(int(u)) if o else None for o, u in zip(open_, up)]),
        n[both], children[both], leaves[both], saved[both], sha[both], pad([hashlib.md5(trie.path_to(int(i))).digest() if keys else None for i in done]), [*[None] * len(done), *(trie.path_to(int(i)) for i in merged)],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _tries(around: dict[int, tuple[int, int]], depth: int, keys: bool, least: int, chunk: int):
    """A mapInArrow function over rows sorted by (part, path): tries of about `chunk` turns, and never of two parts.
    around: how many turns a part's first and last path have in common with its neighbours'. `least` levels stay shared."""

    def run(batches):
        held: list[dict] = []
        size = before = 0
        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["part"] != held[-1]["part"] or size > chunk):
                    same = r["part"] == held[-1]["part"]
                    after = common(held[-1]["path"], r["path"]) if same else around[held[-1]["part"]][1]
                    yield _finish(held, before, after, least, depth, keys)
                    before, held, size = after if same else around[r["part"]][0], [], 0
                elif not held:
                    before = around[r["part"]][0]
                held.append(r)
                size += len(r["path"]) // WIDTH
        if held:
            yield _finish(held, before, around[held[-1]["part"]][1], least, depth, keys)

    return run


def _overlaps(batches):
    for batch in batches:
        rows = batch.to_pylist()
        found = [[r["part"], common(r["low"], r["before"]) if r["before"] else 0, common(r["high"], r["after"]) if r["after"] else 0] for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int32()) for i in range(3)], names=["part", "before", "after"])


_SUMS = ("n", "children", "leaves", "saved")


def _levels(rows: DataFrame, depth: int, least: int, alone: int, chunk: int) -> tuple[list[DataFrame], DataFrame]:
    """rows: path, n, conv_id, children, leaves, saved, sha, one for each path. Written tables of finished nodes, and the
    rows of those that stay shared, the first `least` turns of the paths.

    Rows are sorted by path and dealt into ranges, so a beginning that very many share lies in as many tasks as it
    needs. Each task builds tries of its ranges; what two ranges share is a row of the next, far smaller table, until
    nothing is shared but what must be."""
    finished: list[DataFrame] = []
    while True:
        few = rows.limit(alone + 1).count() <= alone
        ranged = rows.coalesce(1) if few else rows.repartitionByRange("path")
        ranged = stash(ranged.withColumn("part", F.spark_partition_id()), "ranges")
        ends = ranged.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))
        by_part = Window.orderBy("part")  # a row for each range
        ends = ends.withColumns({"before": F.lag("high").over(by_part), "after": F.lead("low").over(by_part)})
        around = {p: (a, b) for p, a, b in pull(arrow_stage(ends, _overlaps, "part int, before int, after int")).itertuples(index=False)}
        found = stash(arrow_stage(ranged.repartition("part").sortWithinPartitions("part", "path"), _tries(around, depth, bool(finished), least, chunk), _OUT), "nodes")
        finished.append(found.where("path is null"))
        shared = found.where("path is not null").groupBy("path").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in _SUMS), F.max("sha").alias("sha"))
        rows = stash(shared, "shared")
        deep = F.octet_length("path") > least * WIDTH
        if not rows.where(deep).limit(1).count():
            return finished, rows


# -- conversations ------------------------------------------------------------------------------------------------------


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns: conv_id, turn, role, text. Two written tables: conversations (conv_id, n: rebuilt turns) and rebuilt turns
    (conv_id, at: from 0, entry: digest and code points in hexadecimal).

    Rows are sorted over all conversations, and a turn's place in its own is counted from the rows before it in its range
    and the conversation's rows in earlier ranges: a conversation of any length is spread over tasks."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("salt")]
    entry = F.concat(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")), F.lpad(F.hex(F.char_length("text")), 16, "0"))
    t = t.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", entry.alias("entry"))
    t = stash(t.withColumn("row", F.monotonically_increasing_id()), "turns").withColumn("part", F.shiftright("row", 33))
    runs = t.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("k"))
    by_conv = Window.partitionBy("conv_id")
    runs = runs.withColumns({"sooner": F.coalesce(F.sum("k").over(by_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("k").over(by_conv)})
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST
    runs = stash(runs.withColumns({"head": head, "base": F.col("conv_id") - F.col("conv_id") % FAMILY}), "runs")
    convs = runs.where("sooner = 0").select("conv_id", "n", "head", "base")
    bases = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    bases = bases.withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0))))
    bases = stash(bases.select("conv_id", "base", "head", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("head"))).alias("n")), "conversations")
    runs = runs.select("conv_id", "part", "first", "sooner", "head").join(bases.select("conv_id", "taken"), "conv_id")
    placed = t.join(small(stash(runs, "offsets")), ["conv_id", "part"]).withColumn("own", F.col("row") - F.col("first") + F.col("sooner"))
    placed = stash(placed.select("conv_id", "own", "entry", "head", "taken"), "placed")
    rest = placed.where("own >= head").select("conv_id", (F.col("own") - F.col("head") + F.col("taken")).alias("at"), "entry")
    heads = placed.where(f"own < {MOST - 1}").select(F.col("conv_id").alias("base"), F.col("own").alias("at"), "entry")
    heads = heads.join(bases.where("taken > 0").select("base", "conv_id", "taken"), "base").where("at < taken").select("conv_id", "at", "entry")
    return bases.select("conv_id", "n"), stash(rest.unionByName(heads), "rebuilt")


def _chain(batches):
    """(conv_id, segment, digest) by conversation and segment: what comes before each segment, as a digest, and with it."""
    conv, state = None, ROOT[:16]
    for batch in batches:
        out = []
        for c, segment, digest in zip(*(batch.column(i).to_pylist() for i in range(3))):
            conv, state = (conv, state) if c == conv else (c, ROOT[:16])
            after = hashlib.md5(state + digest).digest()
            out.append((c, segment, state, after))
            state = after
        arrays = zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary())) if out else ()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in arrays], names=["conv_id", "segment", "root", "end"]) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())], names=["conv_id", "segment", "root", "end"])


def _id_texts(most: int):
    """(end, at, ids) of rows sorted by (end, conv_id): comma-joined ids of `most` rows at most, numbered in the range."""

    def run(batches):
        from pyspark import TaskContext

        at, end, held = TaskContext.get().partitionId() << 32, None, []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([at], pa.int64()), pa.array([",".join(map(str, held))], pa.string())], names=["end", "at", "ids"])

        for batch in batches:
            for e, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (e != end or len(held) >= most):
                    yield row()
                    at, held = at + 1, []
                end = e
                held.append(conv)
        if held:
            yield row()

    return run


def _digests(batches) -> Iterator[pa.RecordBatch]:
    """(end, sha) of rows sorted by (end, at)."""
    end, state = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([state.hexdigest()])], names=["end", "sha"])
    for batch in batches:
        for e, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if state is not None and e == end:
                state.update(b",")
            else:
                if state is not None:
                    yield row()
                end, state = e, hashlib.sha256()
            state.update(ids.encode())
    if state is not None:
        yield row()


def prefix_trie(turns: DataFrame, segment: int = SEGMENT, alone: int = ALONE, chunk: int = CHUNK, ids: int = IDS) -> DataFrame:
    """turns: conv_id, turn, role, text. One row per node of the trie of rebuilt conversations: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. The other parameters shape the work (see
    SEGMENT, ALONE, CHUNK and IDS), not the result.

    Turns are ordered by turn, null first; ties by role, then text; a null role or text is empty. A conversation takes the
    first turns of the one whose id is its own without the remainder by FAMILY (of the sign of the id), as rebuilt() says.
    Rows without conv_id belong to none and are left out; rows that repeat are turns each; other columns are left out. No
    conversations give no rows, not even the root.

    Turns are told apart by 128 bits of digest and their code points. Equal sequences become one row with their number
    before any trie is built. A conversation of more than `segment` turns is cut into segments; the deepest tries are built
    first, and their totals are handed up to the nodes they hang from. A node's list of ids is hashed in order of the
    ids, text by text of `ids` ids each, as they stream by."""
    convs, entries = rebuilt(turns)
    cut = entries.withColumn("segment", F.expr(f"at div {segment}")).groupBy("conv_id", "segment")
    blob = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "entry"))), lambda x: x["entry"]), ""))
    segments = stash(cut.agg(blob.alias("turns")), "segments")
    last = segments.agg(F.max("segment")).first()[0]
    digests = segments.select("conv_id", "segment", F.unhex(F.md5("turns")).alias("digest"))
    if last:
        digests = digests.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    chain = stash(arrow_stage(digests, _chain, "conv_id long, segment long, root binary, end binary"), "chain")
    longest = F.expr(f"(n - 1) div {segment}")
    at_end = chain.join(convs.where("n > 0").select("conv_id", longest.alias("segment")), ["conv_id", "segment"], "left_semi").select("end", "conv_id")
    at_end = at_end.unionByName(convs.where("n = 0").select(F.lit(ROOT[:16]).alias("end"), "conv_id"))
    texts = stash(arrow_stage(at_end.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id"), _id_texts(ids), "end binary, at long, ids string"), "ids")
    shas = stash(arrow_stage(texts.repartition("end").sortWithinPartitions("end", "at"), _digests, "end binary, sha string"), "ends")
    whole = segments.join(chain, ["conv_id", "segment"]).select("segment", "conv_id", "end", F.concat(F.col("root"), F.lit(bytes(8)), F.col("turns")).alias("path"))
    rows = whole.groupBy("segment", "path", "end").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    bare = convs.where("n = 0").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).where("n > 0")
    rows = rows.unionByName(bare.select(F.lit(0).cast("long").alias("segment"), F.lit(ROOT).alias("path"), F.lit(ROOT[:16]).alias("end"), "n", "conv_id"))
    rows = stash(rows.join(shas, "end", "left"), "sequences")
    below, out, heads = None, [], []
    for nth in range(last or 0, -1, -1):
        own = rows.where(F.col("segment") == nth)
        if below is None:
            own = own.withColumns({c: F.lit(0).cast("long") for c in _SUMS[1:]})
        else:
            own = own.join(below, "end", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in _SUMS[1:]})
            heads.append(own.join(below, "end", "left_semi").select(F.unhex(F.md5(F.concat("end", F.lit(bytes(8))))).alias("key"), F.col("conv_id").alias("up")))
        finished, shared = _levels(own.drop("segment", "end"), nth * segment, int(nth > 0), alone, chunk)
        out += [finished[0], *finished[1:]]
        heads += [f.select("key", F.col("conv_id").alias("up")) for f in finished[1:]]
        below = shared.select(F.substring("path", 1, 16).alias("end"), *_SUMS[1:])
    nodes = out[0]
    for more in out[1:]:
        nodes = nodes.unionByName(more)
    if heads:
        known = heads[0]
        for more in heads[1:]:
            known = known.unionByName(more)
        nodes = nodes.join(small(stash(known.withColumnRenamed("key", "parent_key"), "parents")), "parent_key", "left")
    else:
        nodes = nodes.withColumn("up", F.lit(None).cast("long"))
    return nodes.select("conv_id", "depth", F.coalesce("up", "parent_conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(NONE_SHA)).alias("ends_sha256"))
