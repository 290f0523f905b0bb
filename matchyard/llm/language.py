"""Language of whole texts: known words first, then progressively shorter character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchyard.llm.base import arrow_stage, ints, pull, put, stash, text_blocks
from matchyard.llm.labelled import held_out
from matchyard.llm.words import mix, span_hashes, word_spans

#: For each language: documents to learn from (about), words and n-grams of each length that the model keeps for it.
SAMPLE, FEATURES = 4000, 20_000
#: n-gram lengths in characters, tried in this order for a word that isn't known.
LENGTHS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
#: Added to every count; how strongly the words of a text, which aren't independent, count together.
SMOOTH, TEMPER = 0.5, 4.0

#: What parts words: ASCII other than letters. Letters of any script have bytes from 128 on.
_APART = np.array([not chr(b).isalpha() if b < 128 else False for b in range(256)])
_LEAD = np.array([b < 0x80 or b >= 0xC0 for b in range(256)])


def words_of(column: pa.Array):
    """Blocks of lower-cased texts: (row, data, offsets, starts, ends, first word of each document, word hashes)."""
    for row, _, data, offsets in text_blocks(pc.utf8_lower(column)):
        starts, ends, first = word_spans(data, offsets, _APART)
        yield row, data, offsets, starts, ends, first, span_hashes(data, starts, ends)


def ngrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams (in characters, word ends marked) of the given words, and the word of each."""
    size = ends - starts
    owner = np.repeat(np.arange(len(starts)), size)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    lead = _LEAD[data[at]] | (at == starts[owner])
    begins, who = at[lead], owner[lead]
    new = np.ones(len(begins), bool)
    new[1:] = who[1:] != who[:-1]
    last = np.ones(len(begins), bool)
    last[:-1] = new[1:]
    stop = np.append(begins[1:], 0)
    stop[last] = ends[who[last]]
    # a character's code: its bytes as one number; 1 and 2 mark the word's begin and end
    code = np.zeros(len(begins), np.uint64)
    for k in range(4):
        has = begins + k < stop
        code[has] = code[has] * np.uint64(256) + data[begins[has] + k]
    count = np.bincount(who, minlength=len(starts)) + 2
    base = np.cumsum(count) - count
    stream = np.zeros(count.sum(), np.uint64)
    stream[base], stream[base + count - 1] = 1, 2
    nth = np.arange(len(who)) - np.repeat(np.cumsum(count - 2) - (count - 2), count - 2)
    stream[base[who] + 1 + nth] = code
    if n == 1:
        return mix(code ^ np.uint64(0x11)), who
    of = np.repeat(np.arange(len(starts)), count)
    if len(stream) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(stream) - n + 1, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + stream[k : len(stream) - n + 1 + k])
    same = of[: len(h)] == of[n - 1 :]
    return h[same] ^ np.uint64(n), of[: len(h)][same]


def _counts(batches):
    """(lang, level, feature, count): level 0 words, else n-grams of that length, added up by block of texts."""
    for batch in batches:
        names, code = np.unique(np.array(batch.column(1).to_pylist(), str), return_inverse=True)
        for row, data, _, starts, ends, first, hashes in words_of(batch.column(0)):
            lang = np.repeat(code[row : row + len(first) - 1], np.diff(first))
            for level in (0, *LENGTHS):
                h, who = ngrams(data, starts, ends, level) if level else (hashes, np.arange(len(hashes)))
                of = lang[who]
                for k in np.unique(of):
                    f, n = np.unique(h[of == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([names[k]] * len(f)), pa.array(np.full(len(f), level, np.int32)), pa.array(ints(f)), pa.array(n)], names=["lang", "level", "feature", "n"])


def train(docs: DataFrame) -> dict:
    """docs: doc_id, text, lang. Learns from a sample of each language, of about SAMPLE of its rows that aren't held out.

    Counts are added up where the documents are; of each level the most frequent features of each language reach the
    driver, with their counts in all languages. The model holds the counts that aren't 0."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    limits = docs.sparkSession.createDataFrame([(x, int((1 << 52) * min(1.0, SAMPLE / n))) for x, n in sizes.items()], "lang string, most long")
    spread = F.xxhash64("doc_id", F.lit(17)).bitwiseAND(F.lit((1 << 52) - 1))
    rows = rows.join(F.broadcast(limits), "lang").where(spread < F.col("most")).select("text", "lang")
    counts = arrow_stage(rows, _counts, "lang string, level int, feature long, n long").groupBy("level", "feature", "lang").agg(F.sum("n").alias("n"))
    whole = stash(counts.groupBy("level", "feature").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by")).where("all > 1"), "features")
    each = whole.select("level", "feature", F.inline("by"))
    first = F.row_number().over(Window.partitionBy("level", "lang").orderBy(F.desc("n"), "feature"))
    chosen = each.withColumn("_k", first).where(F.col("_k") <= FEATURES).select("level", "feature").distinct()
    kept = stash(each.join(chosen, ["level", "feature"], "left_semi"), "kept")
    model: dict = {"langs": langs, "levels": {}}
    index = {x: i for i, x in enumerate(langs)}
    for level in (0, *LENGTHS):
        top = pull(kept.where(F.col("level") == level).select("feature", "lang", "n"))
        keys, row = np.unique(top.feature.to_numpy(np.int64).view(np.uint64), return_inverse=True)
        lang, n = top.lang.map(index).to_numpy(np.int64), top.n.to_numpy(float)
        totals = np.bincount(lang, n, minlength=len(langs)) + SMOOTH * (len(keys) + 1)
        order = np.lexsort((lang, row))
        at = np.append(0, np.cumsum(np.bincount(row, minlength=len(keys))))
        scores = np.log((n + SMOOTH) / totals[lang]).astype(np.float32)
        model["levels"][level] = (keys, at, lang[order].astype(np.int32), scores[order], np.log(SMOOTH / totals).astype(np.float32))
    return model


def _rows(model: dict, level: int, at: np.ndarray) -> np.ndarray:
    """Log frequencies in each language of the features with these places."""
    _, begin, lang, scores, none = model["levels"][level]
    size = begin[at + 1] - begin[at]
    out = np.tile(none, (len(at), 1))
    cells = np.arange(size.sum()) + np.repeat(begin[at] - (np.cumsum(size) - size), size)
    out[np.repeat(np.arange(len(at)), size), lang[cells]] = scores[cells]
    return out


def _look_up(model: dict, level: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = model["levels"][level][0]
    if not len(keys):
        return np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return at, keys[at] == hashes


def word_scores(model: dict, data, starts, ends, hashes) -> np.ndarray:
    """Log frequency of each word in each language; a word that isn't known gets the mean over its known n-grams of the
    longest length of which any is known. A word without any counts for nothing."""
    out = np.zeros((len(hashes), len(model["langs"])), np.float32)
    at, known = _look_up(model, 0, hashes)
    out[known] = _rows(model, 0, at[known])
    left = np.flatnonzero(~known)
    for n in LENGTHS:
        if not len(left):
            break
        h, who = ngrams(data, starts[left], ends[left], n)
        at, known = _look_up(model, n, h)
        hits = np.bincount(who[known], minlength=len(left))
        rows = _rows(model, n, at[known])
        for k in range(rows.shape[1]):
            out[left, k] = np.bincount(who[known], rows[:, k], minlength=len(left)) / np.maximum(hits, 1)
        left = left[hits == 0]
    return out


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs: doc_id, text. One row per row: doc_id, held_out, lang_pred, score (its share of the tempered posterior)."""
    shared = put(docs.sparkSession, model)

    def run(batches):
        model = shared.value
        names = np.array([*model["langs"], UNKNOWN], object)
        for batch in batches:
            best, score = [], []
            lettered = pc.fill_null(pc.match_substring_regex(batch.column(0), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for row, data, _, starts, ends, first, hashes in words_of(batch.column(0)):
                n = len(first) - 1
                if not model["langs"]:
                    best.append(np.zeros(n, int))
                    score.append(np.zeros(n))
                    continue
                unique, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                each = word_scores(model, data, starts[at], ends[at], unique)
                doc = np.repeat(np.arange(n), np.diff(first))
                total = np.stack([np.bincount(doc, each[inverse, k], minlength=n) for k in range(each.shape[1])], axis=1)
                total /= np.sqrt(np.maximum(np.diff(first), 1))[:, None] * TEMPER / 4
                total -= total.max(axis=1, keepdims=True)
                p = np.exp(total)
                p /= p.sum(axis=1, keepdims=True)
                top = p.argmax(axis=1)
                none = ~lettered[row : row + n]
                best.append(np.where(none, len(model["langs"]), top))
                score.append(np.where(none, 0.0, p[np.arange(n), top]))
            best = np.concatenate([np.zeros(0, int), *best])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(names[best], pa.string()), pa.array(np.concatenate([np.zeros(0), *score]))], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("text", "doc_id", held_out().alias("held_out"))
    return arrow_stage(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from docs (doc_id, text, lang) and predicts the language of every row's whole text.

    Null text and text without a letter is `und` with score 0; ties go to the first language by name; rows that repeat
    get the same; a null doc_id is not held out and never learnt from; without any language every text is `und`; an
    empty table gives none."""
    return predict(docs, train(docs))
