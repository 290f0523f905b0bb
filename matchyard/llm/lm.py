"""Scoring texts by a Brown class-based bigram model: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchyard.llm.base import arrow_stage, crc_mod, ints, pull, put, stash, text_blocks
from matchyard.llm.words import mix, word_hashes

#: Words that the driver clusters first and the least number of classes; words whose counts are broadcast at least.
CLUSTERED, CLASSES, HEAD = 1024, 64, 1 << 18
#: Every word that occurs so often is clustered, however many there are.
LEAST = 64
#: Rounds over half of all clustered words each, on the executors.
ROUNDS = 4
#: Rounds over all words in which none or some move.
SWEEPS = 8
#: The end of a text, counted as a token.
END = np.uint64(0x656E64206F66)


def held_out():
    """Rows that nothing is learnt from: crc32 of the id as text, modulo 7, is 2. A null id is learnt from."""
    return F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))


def _streams(column):
    """Blocks of token hashes, each text's words and then END: (first row, tokens, where each text begins)."""
    for row, _, data, offsets in text_blocks(column):
        words, first = word_hashes(data, offsets)
        n = len(first) - 1
        tokens = np.insert(words, first[1:], END)
        yield row, tokens, first + np.arange(n + 1)


def _count(batches):
    """(word, count) of the partition."""
    held_words, held_counts, size = [], [], 0

    def add_up():
        words, inverse = np.unique(np.concatenate(held_words), return_inverse=True)
        return words, np.bincount(inverse, np.concatenate(held_counts)).astype(np.int64)

    for batch in batches:
        for _, tokens, _ in _streams(batch.column(0)):
            words, counts = np.unique(tokens, return_counts=True)
            held_words.append(words)
            held_counts.append(counts)
            size += len(words)
        if size > 3_000_000:
            words, counts = add_up()
            if len(words) > 1_500_000:  # written early, so a partition of any size fits
                for i in range(0, len(words), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(ints(words[i : i + (1 << 16)])), pa.array(counts[i : i + (1 << 16)])], names=["word", "c"])
                held_words, held_counts, size = [], [], 0
            else:
                held_words, held_counts, size = [words], [counts], len(words)
    if held_words:
        words, counts = add_up()
        for i in range(0, len(words), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(ints(words[i : i + (1 << 16)])), pa.array(counts[i : i + (1 << 16)])], names=["word", "c"])


def _find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


def _bigrams(shared):
    """(cell, count) of neighbouring clustered words; whatever isn't clustered is one word, and a text begins after END."""

    def run(batches):
        keys, ids, end = shared.value
        n = len(keys) + 1
        held, size = [], 0

        def add_up():
            cells, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([h[1] for h in held])).astype(np.int64)
            return cells, counts

        def rows(cells, counts):
            for i in range(0, len(cells), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(cells[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], names=["cell", "c"])

        for batch in batches:
            for _, tokens, first in _streams(batch.column(0)):
                at, known = _find(keys, tokens)
                w = np.where(known, ids[at] if len(ids) else 0, n - 1)
                before = np.empty_like(w)
                before[1:] = w[:-1]
                before[first[:-1]] = end
                held.append(np.unique(before * n + w, return_counts=True))
                size += len(held[-1][0])
            if size > 3_000_000:
                cells, counts = add_up()
                held, size = [(cells, counts)], len(cells)
                if size > 1_500_000:  # written early, so a partition of any size fits
                    yield from rows(cells, counts)
                    held, size = [], 0
        if held:
            yield from rows(*add_up())

    return run


def _entries(column):
    """A batch of neighbour lists, flat: where each word's begin, the neighbours, whether they come before it, counts."""
    values = column.flatten()
    code = values.field("code").to_numpy()
    return column.offsets.to_numpy() - column.offsets[0].as_py(), code >> 1, code & 1, values.field("c").to_numpy()


def _class_table(shared, m: int):
    """(cell, count) of neighbouring classes."""

    def run(batches):
        of, table = shared.value, np.zeros(m * m)
        for batch in batches:
            at, other, side, c = _entries(batch.column(1))
            word, after = np.repeat(batch.column(0).to_numpy(), np.diff(at)), side == 0
            table += np.bincount(of[word[after]].astype(np.int64) * m + of[other[after]], c[after], minlength=m * m)
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[some].astype(np.int64))], names=["cell", "c"])

    return run


def _gains(table: np.ndarray, of: int, slots: np.ndarray, n: np.ndarray, classes: int) -> np.ndarray:
    """What the criterion of exchange() gains by each class of a word that was taken out of class `of`."""
    m = len(table)
    r, c = np.zeros(m), np.zeros(m)
    after = slots < m
    before = (slots >= m) & (slots < 2 * m)
    r[slots[after]], c[slots[before] - m] = n[after], n[before]
    s = float(n[slots == 2 * m].sum())
    out, into = r.sum(), c.sum()
    r[of] -= s
    c[of] -= s
    # only cells that the word touches change: its row and column leave class `of` and enter another
    kr, kc = np.flatnonzero(r), np.flatnonzero(c)
    rows, columns = table[:classes, kr].copy(), table[kc, :classes].copy()
    # the table without the word
    in_row, in_column = np.flatnonzero(kr == of), np.flatnonzero(kc == of)
    rows[:, in_row] -= c[:classes, None]
    columns[in_column, :] -= r[None, :classes]
    if of < classes:
        rows[of] -= r[kr]
        columns[:, of] -= c[kc]
        rows[of, in_row] -= s
        columns[in_column, of] -= s
    gain = (_f(rows + r[kr]) - _f(rows)).sum(axis=1) + (_f(columns + c[kc][:, None]) - _f(columns)).sum(axis=0)
    own = table.diagonal()[:classes].copy()
    left, right = table.sum(axis=1)[:classes], table.sum(axis=0)[:classes]
    if of < classes:
        own[of] -= r[of] + c[of] + s
        left[of] -= out
        right[of] -= into
    gain += _f(own + r[:classes] + c[:classes] + s) - _f(own + r[:classes]) - _f(own + c[:classes]) + _f(own)
    return gain - (_f(left + out) - _f(left) + _f(right + into) - _f(right))


def _best_class(shared, classes: int):
    """(word, class) of the words that are to move where the best class isn't the word's own."""

    def run(batches):
        table, of, moving = shared.value
        m = len(table)
        for batch in batches:
            word = batch.column(0).to_numpy()
            at, other, side, c = _entries(batch.column(1))
            slot = of[other] + side * m
            words, best = [], []
            for i in np.flatnonzero(moving[word]):
                w, part = word[i], slice(at[i], at[i + 1])
                n = np.bincount(slot[part], c[part], minlength=2 * m + 1)
                n[2 * m] = c[part][(other[part] == w) & (side[part] == 0)].sum()
                slots = np.flatnonzero(n)
                gain = _gains(table, int(of[w]), slots, n[slots], classes)
                b = int(gain.argmax())
                if of[w] >= classes or gain[b] > gain[of[w]] + 1e-9:
                    words.append(w)
                    best.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array(best, pa.int32())], names=["word", "class"])

    return run


def neighbours(bigrams: DataFrame) -> DataFrame:
    """bigrams: (a, b, c). One written row per word: the words beside it, each as its number doubled, one more if it comes
    before, and how often. A word has twice as many entries as there are clustered words at most."""
    after = bigrams.select(F.col("a").alias("word"), F.struct((F.col("b") * 2).cast("long").alias("code"), "c").alias("entry"))
    before = bigrams.select(F.col("b").alias("word"), F.struct((F.col("a") * 2 + 1).cast("long").alias("code"), "c").alias("entry"))
    return stash(after.unionByName(before).groupBy("word").agg(F.collect_list("entry").alias("near")), "neighbours")


def exchange_all(near: DataFrame, of: np.ndarray, classes: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words and their class table, by the criterion of exchange() in rounds on the executors.

    near: see neighbours(); the last two words are fixed. At first every word without a class gets the best one; in each
    later round half of the words move together, as if the others stayed. A round that lowers the criterion is undone,
    and the other half still has its turn. Rounds only read: words have their neighbours beside them, and what is
    shuffled is the class table."""
    spark, m = near.sparkSession, classes + 2

    def table_of(of: np.ndarray) -> np.ndarray:
        cells = pull(arrow_stage(near, _class_table(put(spark, of), m), "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")))
        table = np.zeros(m * m)
        table[cells.cell.to_numpy(np.int64)] = cells.c.to_numpy(float)
        return table.reshape(m, m)

    def criterion(table: np.ndarray) -> float:
        return float(_f(table).sum() - _f(table.sum(axis=0)).sum() - _f(table.sum(axis=1)).sum())

    words = np.arange(len(of))
    half = mix(words.astype(np.uint64)) & np.uint64(1)
    table = table_of(of)
    for k in range(rounds + 1):
        moving = (of >= classes) if k == 0 else half == k % 2
        moving[-2:] = False
        if not moving.any():
            continue
        moves = pull(arrow_stage(near, _best_class(put(spark, (table, of, moving)), classes), "word int, class int"))
        new = of.copy()
        new[moves["word"].to_numpy()] = moves["class"].to_numpy()
        after = table_of(new)
        if k == 0 or criterion(after) > criterion(table):
            of, table = new, after
    return of, table


def _f(x):
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, classes: int, fixed: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word of a bigram table (words by falling frequency; the last `fixed` words keep a class each).

    Brown's criterion, the likelihood of the class bigram model, is raised by moving one word at a time to its best
    class, starting from classes by frequency rank, until a round moves none."""
    n = len(counts)
    total = classes + fixed
    of = np.concatenate([np.arange(n - fixed) % classes, classes + np.arange(fixed)])
    counts = counts.astype(float)
    table = np.zeros((total, total))
    np.add.at(table, (of[:, None], of[None, :]), counts)
    left, right = table.sum(axis=1), table.sum(axis=0)
    out_of, into, diagonal = counts.sum(axis=1), counts.sum(axis=0), counts.diagonal()
    for _ in range(sweeps):
        moved = 0
        for w in range(n - fixed):
            a, s = of[w], diagonal[w]
            r = np.bincount(of, counts[w], minlength=total)
            c = np.bincount(of, counts[:, w], minlength=total)
            r[a] -= s
            c[a] -= s
            table[a] -= r
            table[:, a] -= c
            table[a, a] -= s
            left[a] -= out_of[w]
            right[a] -= into[w]
            gain = (_f(table + r) - _f(table)).sum(axis=1) + (_f(table + c[:, None]) - _f(table)).sum(axis=0)
            own = table.diagonal()
            gain += _f(own + r + c + s) - _f(own + r) - _f(own + c) + _f(own)
            gain -= _f(left + out_of[w]) - _f(left) + _f(right + into[w]) - _f(right)
            b = int(gain[:classes].argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            of[w] = b
            table[b] += r
            table[:, b] += c
            table[b, b] += s
            left[b] += out_of[w]
            right[b] += into[w]
        if not moved:
            break
    return of


def _log10(x):
    return np.log10(np.maximum(x, 1e-300))


def train(docs: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES, head: int = HEAD, least: int = LEAST) -> tuple[dict, DataFrame]:
    """The model, which grows with the words that occur `least` times, and the written table (word, c) of all training counts.

    Words are counted over all training texts. The `clustered` most frequent are clustered by their bigrams on
    the driver, then all that occur `least` times on the executors, in more classes the more they are; rarer words are one
    more class and END one of its own. Class transitions are interpolated with class frequencies (Witten and Bell);
    in the class of other words, counts are discounted by the share of words seen once. What that frees is shared evenly
    among as many unseen words as the class has seen ones, so no unseen word is likelier than one seen once."""
    spark = docs.sparkSession
    rows = docs.where(~held_out()).select("text")
    counts = stash(arrow_stage(rows, _count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    bands = counts.groupBy(F.floor(F.log2("c") * 16).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("k")).collect()
    floor, held = 0, 0
    for r in sorted(bands, key=lambda r: -r["band"]):  # whole bands of counts, as many as fit
        held += r["k"]
        if held > head:
            floor = r["band"] + 1
            break
    top = pull(counts.where((F.floor(F.log2("c") * 16) >= floor) | (F.col("c") >= least)))
    top = top.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    words, c = top.word.to_numpy(np.int64).view(np.uint64), top.c.to_numpy(np.int64)
    chosen = np.flatnonzero(words != END)
    seeds = min(clustered, len(chosen))
    k = max(seeds, int((c[chosen] >= least).sum()))
    chosen = chosen[:k]
    classes = max(classes, int(2 * k ** (1 / 3)))
    vocabulary = np.append(words[chosen], END)
    order = np.argsort(vocabulary)
    shared = put(spark, (vocabulary[order], order, k))
    cells = arrow_stage(rows, _bigrams(shared), "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c"))
    bigrams = stash(cells.select(F.expr(f"cell div {k + 2}").cast("int").alias("a"), (F.col("cell") % (k + 2)).cast("int").alias("b"), "c"), "bigrams")
    # the most frequent words first: whatever else there is stands as one word beside them
    place = lambda x: F.when(F.col(x) < seeds, F.col(x)).when(F.col(x) == k, seeds).otherwise(seeds + 1)
    near = pull(bigrams.groupBy(place("a").alias("a"), place("b").alias("b")).agg(F.sum("c").alias("c")))
    table = np.zeros((seeds + 2, seeds + 2), np.int64)
    table[near.a.to_numpy(int), near.b.to_numpy(int)] = near.c.to_numpy(np.int64)
    first = exchange(table, min(classes, max(1, seeds)), 2)
    m = int(first.max()) + 1
    of = np.full(k + 2, m - 1, np.int32)
    of[:seeds], of[k] = first[:seeds], m - 2
    if k > seeds:
        of, pairs = exchange_all(neighbours(bigrams), of, m - 2)
    else:
        pairs = np.zeros((m, m))
        np.add.at(pairs, (of[:, None], of[None, :]), table)
    into = pairs.sum(axis=0)
    unigram = (into + 0.5) / (into.sum() + 0.5 * m)
    outgoing, kinds = pairs.sum(axis=1, keepdims=True), (pairs > 0).sum(axis=1, keepdims=True)
    moves = (pairs + np.maximum(kinds, 1) * unigram) / (outgoing + np.maximum(kinds, 1))
    other_n = int(n) - int(c[chosen].sum()) - int(c[words == END].sum())
    other_v = int(v) - k - int((words == END).sum())
    ones, twos = counts.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    ones, twos = (x - int((c[chosen] == y).sum()) - int((c[words == END] == y).sum()) for x, y in ((ones, 1), (twos, 2)))
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    emission = np.full(len(words), np.nan)
    emission[chosen] = _log10(c[chosen] / into[of[:k]])
    emission[words == END] = 0.0
    rest = np.isnan(emission)
    emission[rest] = _log10((c[rest] - discount) / (other_n + 0.5))
    cls = np.full(len(words), m - 1)
    cls[chosen], cls[words == END] = of[:k], m - 2
    by = np.argsort(words)
    model = {"words": words[by], "counts": c[by], "class": cls[by], "emission": emission[by], "moves": _log10(moves), "n": int(n), "v": int(v), "discount": discount, "other_n": other_n, "unseen": float(_log10((discount + 0.5 / (other_v + 1)) / (other_n + 0.5)))}
    return model, counts


_PART = "row long, word long, tf long, doc struct<doc_id:{kind},held_out:boolean,n:bigint,known:bigint,base:double,score:double>"


def _score(shared, schema: pa.DataType):
    """For each text what its frequent words give (word: a mark no count is for, tf 0), and its other words."""

    def run(batches):
        model = shared.value
        end = len(model["moves"]) - 2
        for batch in batches:
            rows = batch.column(1).to_numpy()
            out: list[list] = [[] for _ in range(3)]
            sums: list[list] = [[] for _ in range(4)]
            for row, tokens, first in _streams(batch.column(0)):
                n = len(first) - 1
                at, known = _find(model["words"], tokens)
                cls = np.where(known, model["class"][at] if len(model["class"]) else 0, end + 1)
                before = np.empty_like(cls)
                before[1:] = cls[:-1]
                before[first[:-1]] = end
                score = model["moves"][before, cls] + (np.where(known, model["emission"][at], 0) if len(at) and len(model["words"]) else 0)
                base = np.where(known, np.log10(model["counts"][at] + 1.0), 0) if len(model["words"]) else np.zeros(len(tokens))
                doc = np.repeat(np.arange(n), np.diff(first))
                sums[0].append(np.diff(first))
                sums[1].append(np.bincount(doc, known, minlength=n).astype(np.int64))
                sums[2].append(np.bincount(doc, base, minlength=n))
                sums[3].append(np.bincount(doc, score, minlength=n))
                word, doc = tokens[~known], doc[~known]
                order = np.lexsort((word, doc))
                word, doc = word[order], doc[order]
                new = np.ones(len(word), bool)
                new[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
                begin = np.flatnonzero(new)
                out[0].append(rows[row + doc[begin]])
                out[1].append(ints(word[begin]))
                out[2].append(np.diff(np.append(begin, len(word))))
            if not out[0]:
                continue
            own = pa.StructArray.from_arrays([batch.column(2), batch.column(3), *(pa.array(np.concatenate(s)) for s in sums)], fields=list(schema))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ints(mix(rows.view(np.uint64) ^ END))), pa.array(np.zeros(len(rows), np.int64)), own], names=["row", "word", "tf", "doc"])
            row, word, tf = (np.concatenate(c) for c in out)
            for i in range(0, len(row), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(row[part]), pa.array(word[part]), pa.array(tf[part].astype(np.int64)), pa.nulls(len(row[part]), schema)], names=["row", "word", "tf", "doc"])

    return run


def score(docs: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES, head: int = HEAD, least: int = LEAST) -> DataFrame:
    """docs: doc_id, text. One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts of frequent and of clustered words are broadcast; the others' are joined to the (text, word) pairs by word.
    So no very frequent word reaches that join, and no text's words are gathered in one task but as sums. All unseen
    words are one word to both models. Null or empty text is the end alone; rows that repeat are scored each and counted
    each; a null doc_id is learnt from; an empty table gives none."""
    spark = docs.sparkSession
    model, counts = train(docs, clustered, classes, head, least)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("text", F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"))
    fields = pa.struct([("doc_id", docs.select("doc_id").limit(0).toArrow().schema.field(0).type), ("held_out", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    parts = arrow_stage(rows, _score(put(spark, model), fields), _PART.format(kind=kind))
    d, low = float(model["discount"]), float(_log10(model["other_n"] + 0.5))
    rare = counts.where(F.col("c") < int(model["counts"].min())) if len(model["counts"]) else counts  # what isn't broadcast
    joined = parts.join(rare, "word", "left")
    seen = F.col("c").isNotNull()
    tf = F.col("tf")
    base = tf * F.when(seen, F.log10(F.col("c") + 1.0)).otherwise(0.0)
    own = tf * F.when(seen, F.log10(F.col("c") - F.lit(d)) - F.lit(low)).otherwise(F.lit(float(model["unseen"])))
    sums = joined.groupBy("row").agg(
        F.max("doc.doc_id").alias("doc_id"), F.bool_or("doc.held_out").alias("held_out"), F.max("doc.n").alias("n_tokens"),
        (F.max("doc.known") + F.sum(F.when(seen, tf).otherwise(0))).alias("n_known"),
        (F.max("doc.base") + F.sum(base)).alias("known_base"), (F.max("doc.score") + F.sum(own)).alias("score"),
    )
    total = np.log10(model["n"] + model["v"] + 1.0)
    out = sums.withColumn("base_score", F.col("known_base") - F.col("n_tokens") * F.lit(float(total)))
    return out.select("doc_id", "held_out", "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score")
