"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchyard.llm.base import arrow_stage, pull, put, text_blocks
from matchyard.llm.labelled import held_out, sample
from matchyard.llm.words import LOWER, mix, span_hashes, word_spans

#: Words of a passage; labelled documents to learn from (about) and the most passages one of them may have.
PASSAGE, SAMPLE, MOST_PASSAGES = 64, 6000, 1000
HIDDEN, GATE, EPOCHS, SEED = 24, 12, 30, 5

#: Byte classes: lower case, upper case, digit, space, other than ASCII, control, then one for each punctuation mark.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[128:] = 0, 1, 2, 3, 4
_MARKS = np.flatnonzero([32 < b < 127 and not chr(b).isalnum() for b in range(256)])
_CLASS[_MARKS] = 6 + np.arange(len(_MARKS))
CLASSES = 6 + len(_MARKS)
FEATURES = CLASSES + 9


def _by_passage(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[begins[1:]] - total[begins[:-1]]


def _repeated(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether the same hash came earlier with the same owner."""
    order = np.lexsort((np.arange(len(hashes)), hashes, owner))
    h, o = hashes[order], owner[order]
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    return again


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the whole texts, and each document's first passage. Without words: one, all zeros."""
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first)
    count = np.maximum(1, -(-words // PASSAGE))
    at = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(words)), count)
    begin = first[doc] + (np.arange(at[-1]) - at[doc]) * PASSAGE
    begins = np.append(begin, first[-1])
    n = np.maximum(np.diff(begins), 0).astype(float)
    out = np.zeros((at[-1], FEATURES), np.float32)
    if not len(starts):
        return out, at
    passage = np.repeat(np.arange(at[-1]), np.diff(begins))
    length = ends - starts
    full = n > 0
    byte_from = np.where(full, starts[np.minimum(begin, len(starts) - 1)], 0)
    byte_to = np.where(full, ends[np.maximum(begins[1:] - 1, 0)], 0)
    size = np.maximum(byte_to - byte_from, 1)
    of = np.repeat(np.arange(at[-1]), np.where(full, byte_to - byte_from, 0))
    where = np.arange(len(of)) - np.repeat(np.cumsum(np.where(full, byte_to - byte_from, 0)) - np.where(full, byte_to - byte_from, 0), np.where(full, byte_to - byte_from, 0)) + np.repeat(byte_from, np.where(full, byte_to - byte_from, 0))
    counts = np.bincount(of * CLASSES + _CLASS[data[where]], minlength=at[-1] * CLASSES).reshape(-1, CLASSES)
    out[:, :CLASSES] = np.sqrt(counts / size[:, None])
    per = np.maximum(n, 1)
    low = span_hashes(LOWER[data], starts, ends)
    three = np.full(len(low), np.uint64(0))
    if len(low) > 2:
        three[:-2] = mix(low[:-2] + mix(low[1:-1] + mix(low[2:])))
    owner = np.repeat(np.arange(len(words)), words)
    upper = np.zeros(len(data) + 1)
    np.cumsum((data >= 65) & (data <= 90), out=upper[1:])
    shout = upper[ends] - upper[starts]
    last = _CLASS[data[ends - 1]]
    extra = (
        _by_passage(length, begins) / per / 10,
        np.sqrt(np.maximum(_by_passage(length.astype(float) ** 2, begins) / per - (_by_passage(length, begins) / per) ** 2, 0)) / 10,
        _by_passage(_repeated(low, passage), begins) / per,
        _by_passage(_repeated(low, owner), begins) / per,
        _by_passage(_repeated(three, owner), begins) / per,
        _by_passage((shout > 1) & (shout * 2 > length), begins) / per,
        _by_passage(last >= 6, begins) / per,
        _by_passage(length == 1, begins) / per,
        np.log1p(n) / 5,
    )
    for i, x in enumerate(extra):
        out[:, CLASSES + i] = x
    return out, at


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w: dict, x: np.ndarray, at: np.ndarray):
    """Encoded passages, gates, attention (it sums to 1 in each document), weighted passages and scores."""
    h = np.tanh(((x - w["mean"]) / w["scale"]) @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * s) @ w["a"]
    e = e - np.repeat(np.maximum.reduceat(e, at[:-1]), np.diff(at))
    a = np.exp(e)
    a = a / np.repeat(np.add.reduceat(a, at[:-1]), np.diff(at))
    z = np.add.reduceat(a[:, None] * h, at[:-1], axis=0)
    return h, t, s, a, z, _sigmoid(z @ w["c"] + w["d"])


def fit(x: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Adam on the log loss; gradients through the gated attention, by documents in small batches."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "a": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}
    fixed = {"mean": x.mean(axis=0) if len(x) else np.zeros(FEATURES), "scale": x.std(axis=0) + 1e-2 if len(x) else np.ones(FEATURES)}
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w["d"][0] = np.log(rate / (1 - rate))
    if len(y) == 0 or y.min() == y.max():  # nothing to tell apart: the base rate
        w["c"][:] = 0
        return w | fixed
    m, v, step = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 128):
            docs = np.sort(order[i : i + 128])
            n = at[docs + 1] - at[docs]
            bounds = np.concatenate([[0], np.cumsum(n)])
            rows = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(at[docs], n)
            part = x[rows]
            h, t, s, a, z, p = _forward(w | fixed, part, bounds)
            g = (p - y[docs]) / len(docs)
            dz = g[:, None] * w["c"]
            up = np.repeat(dz, n, axis=0)
            da = (up * h).sum(axis=1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, bounds[:-1]), n))
            dts = de[:, None] * w["a"]
            dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
            dh = (a[:, None] * up + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
            grads = {"c": z.T @ g, "d": np.array([g.sum()]), "a": (t * s).T @ de, "V": h.T @ dt, "U": h.T @ ds, "W": ((part - fixed["mean"]) / fixed["scale"]).T @ dh, "b": dh.sum(axis=0)}
            step += 1
            for k, grad in grads.items():
                grad = grad + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                w[k] -= 0.01 * 0.5 ** (epoch / 10) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w | fixed


def spread(n: int, most: int | None = None) -> np.ndarray:
    """Which of n passages a document is learnt from: all up to MOST_PASSAGES, else so many, evenly spread. It is scored by all."""
    most = MOST_PASSAGES if most is None else most
    return np.arange(n) if n <= most else np.arange(most) * n // most


def _sampled(batches):
    for batch in batches:
        bags, labels = [], batch.column(1).to_pylist()
        for row, after, data, offsets in text_blocks(batch.column(0)):
            x, at = passages(data, offsets)
            bags += [x[at[i] + spread(at[i + 1] - at[i])].tobytes() for i in range(after - row)]
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(bags, pa.binary())], names=["y", "bag"])


def train(spark: SparkSession, docs: DataFrame, sf_dir: str, most: int = SAMPLE) -> dict:
    """Learns from a bounded sample of labelled documents; passages are encoded where the documents are."""
    table = pull(arrow_stage(sample(spark, docs, sf_dir, "quality", most), _sampled, "y int, bag binary"))
    order = sorted(range(len(table)), key=lambda i: (table.bag[i], table.y[i]))  # no matter how partitions came in
    bags = [np.frombuffer(table.bag[i], np.float32).reshape(-1, FEATURES) for i in order]
    at = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(int)
    x = np.concatenate(bags) if bags else np.zeros((0, FEATURES))
    return fit(x.astype(float), at, np.array([table.y[i] for i in order], float))


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs: doc_id, text and `keep`. One row per row: doc_id, held_out, score, predicted, `keep`. Null text is empty."""
    weights = put(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            found = [np.zeros(0)]
            for _, _, data, offsets in text_blocks(batch.column(0)):
                x, at = passages(data, offsets)
                found.append(_forward(weights.value, x.astype(float), at)[-1])
            names = batch.schema.names[1:]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.concatenate(found))], names=[*names, "score"])

    kept = {f"_keep_{i}": c for i, c in enumerate(keep)}
    rows = docs.select("text", "doc_id", held_out().alias("held_out"), *(F.col(f"`{c}`").alias(k) for k, c in kept.items()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", score double"
    out = arrow_stage(rows, run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return out.withColumnsRenamed(kept)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Trains on the labelled documents that aren't held out and scores every row of docs.

    Each passage of 64 words is encoded; gated attention weights, learnt from document labels alone, add the passages
    of a document up to one representation, which is scored. Empty, null and very long texts are scored like others
    (an empty text is one empty passage); rows that repeat get the same score; a null doc_id is not held out and never
    learnt from; without labels of both kinds every score is the base rate; an empty table gives none."""
    return score(docs, train(spark, docs, sf_dir), keep)
