"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchyard.llm.base import arrow_stage, ints, pull, put, stash, text_blocks
from matchyard.llm.labelled import held_out, labels_of, sample
from matchyard.llm.words import LOWER, mix, span_hashes, word_spans

#: Labelled documents to learn from (about, shared between the labels); features with a weight of their own.
SAMPLE, VOCABULARY = 8000, 50_000
#: Tokens that are stepped through at once; a document is one chain over as many pieces as it takes.
PIECE = 64
#: Bytes of the prefixes that are features beside the word itself.
PREFIXES = (4, 5, 6, 7, 8)
#: A token of a toxic document is labelled toxic if a feature of it has odds so much higher among toxic documents, and a
#: log likelihood ratio against chance of so much.
LEAST_ODDS, LEAST_EVIDENCE = 12.0, 7.0
#: Features that may be chosen, those with the most evidence.
CANDIDATES = 3000
#: Tokens of the documents, toxic and clean, that the field is fit on: whole documents of the sample up to so many.
TOKENS, EPOCHS = 400_000, 40
#: From which document score on a document counts as toxic.
THRESHOLD = 0.7

#: Tokens are runs of letters, digits and bytes other than ASCII; everything else parts them.
_APART = np.array([not (chr(b).isalnum() or b >= 128) if b < 128 else False for b in range(256)])


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(features, starts, ends, first token of each document): hashes of the word and of its prefixes, 0 where it has
    none longer than itself. A-Z are lower-cased."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, _APART)
    columns = [span_hashes(data, starts, ends)]
    for k in PREFIXES:
        columns.append(np.where(ends - starts > k, mix(span_hashes(data, starts, np.minimum(ends, starts + k)) ^ np.uint64(k)), np.uint64(0)))
    return np.stack(columns, axis=1), starts, ends, first


def _ids(vocabulary: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Places in the vocabulary from 1 on, 0 for features out of it."""
    if not len(vocabulary):
        return np.zeros(features.shape, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, features), len(vocabulary) - 1)
    return np.where(vocabulary[at] == features, at + 1, 0)


def pieces(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and document of the pieces of all documents' tokens."""
    n = np.diff(first)
    count = -(-n // PIECE)
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = first[doc] + nth * PIECE
    return begin, np.minimum(PIECE, first[doc + 1] - begin), doc


def forward_backward(emission: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray):
    """emission: log-odds of state 1 of all tokens. Marginals of state 1, pair marginals summed, log partition by document.

    Each document is one chain. All pieces are stepped through at once, first for what a piece makes of either state
    that comes in; then states are carried from piece to piece, and steps within the pieces give the marginals. Sums
    are kept normalised, so nothing overflows."""
    begin, length, doc = pieces(first)
    n, gamma, pairs, log_z = len(begin), np.zeros(len(emission)), np.zeros((2, 2)), np.zeros(len(first) - 1)
    if not n:
        return gamma, pairs, log_z
    at = begin[:, None] + np.arange(PIECE)
    live = np.arange(PIECE) < length[:, None]
    odds = np.exp(np.clip(np.where(live, emission[np.minimum(at, len(emission) - 1)], 0), -30, 30))
    psi = np.stack([np.ones_like(odds), odds], axis=2)
    m, e0 = np.exp(moves), np.exp(start)

    carry = np.tile(np.eye(2), (n, 1, 1))  # [piece, state that comes in, state now]
    scale = np.zeros(n)
    for t in range(int(length.max())):
        new = (carry @ m if t else carry) * psi[:, t, None, :]
        total = new.sum(axis=(1, 2))
        on = live[:, t]
        carry = np.where(on[:, None, None], new / total[:, None, None], carry)
        scale += np.where(on, np.log(total), 0)
    nth = np.arange(n) - np.searchsorted(doc, doc)
    by = np.argsort(nth, kind="stable")
    rounds = np.searchsorted(nth[by], np.arange(nth.max() + 2))
    enter, leave = np.tile(e0, (n, 1)), np.ones((n, 2))
    for j in range(len(rounds) - 1):
        some = by[rounds[j] : rounds[j + 1]]
        if j:
            out = (enter[some - 1, None, :] @ carry[some - 1])[:, 0]
            total = out.sum(axis=1, keepdims=True)
            log_z += np.bincount(doc[some], np.log(total[:, 0]) + scale[some - 1], minlength=len(log_z))
            enter[some] = (out / total) @ m
    last = np.append(doc[1:] != doc[:-1], True)
    log_z += np.bincount(doc[last], np.log((enter[last, None, :] @ carry[last])[:, 0].sum(axis=1)) + scale[last], minlength=len(log_z))
    for j in range(len(rounds) - 2, 0, -1):
        some = by[rounds[j] : rounds[j + 1]]
        back = (carry[some] @ leave[some][:, :, None])[:, :, 0] @ m.T
        leave[some - 1] = back / back.sum(axis=1, keepdims=True)

    alpha = np.empty((PIECE, n, 2))
    a = enter
    for t in range(int(length.max())):
        new = (a @ m if t else a) * psi[:, t]
        a = np.where(live[:, t, None], new / new.sum(axis=1, keepdims=True), a)
        alpha[t] = a
    beta, found = leave, np.zeros((n, PIECE))
    for t in range(int(length.max()) - 1, -1, -1):
        g = alpha[t] * beta
        found[:, t] = g[:, 1] / g.sum(axis=1)
        onward = psi[:, t] * beta
        inside = live[:, t]
        if t:
            before, ok = alpha[t - 1], inside
        else:  # the last token of the piece before
            ok = inside & (nth > 0)
            before = np.vstack([np.ones((1, 2)), a[:-1]])
        joint = before[:, :, None] * m * onward[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True))[ok].sum(axis=0)
        back = onward @ m.T
        beta = np.where(inside[:, None], back / back.sum(axis=1, keepdims=True), beta)
    gamma[at[live]] = found[live]
    return gamma, pairs, log_z


def fit(features: np.ndarray, first: np.ndarray, tags: np.ndarray, vocabulary: np.ndarray, epochs: int = EPOCHS) -> dict:
    """Adam on the log likelihood of the tags given the tokens of whole documents, with an L2 penalty. A token's log-odds
    are a bias and its features' weights."""
    ids = _ids(vocabulary, features)
    w = {"word": np.zeros(len(vocabulary) + 1), "bias": np.full(1, -4.0), "start": np.zeros(2), "moves": np.zeros((2, 2))}
    length = np.diff(first)
    some = np.flatnonzero(length)
    if not len(some) or not tags.any():
        return w
    m, v, step = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
    rng = np.random.default_rng(8)
    for epoch in range(epochs):
        order = rng.permutation(some)
        part = np.cumsum(length[order]) // 100_000  # documents of about so many tokens together
        for docs in np.split(order, np.flatnonzero(np.diff(part)) + 1):
            n = length[docs]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(first[docs] - (ends - n), n)
            begins = np.append(0, ends)
            word, tag = ids[at], tags[at]
            gamma, pairs, _ = forward_backward(w["word"][word].sum(axis=1) + w["bias"], begins, w["start"], w["moves"])
            diff = gamma - tag
            inner = np.ones(len(tag), bool)
            inner[begins[:-1]] = False
            seen = np.bincount(2 * tag[:-1][inner[1:]] + tag[1:][inner[1:]], minlength=4).reshape(2, 2)
            g1 = gamma[begins[:-1]]
            g0 = np.array([(1 - g1).sum(), g1.sum()]) - np.bincount(tag[begins[:-1]], minlength=2)
            word_gradient = np.bincount(word.ravel(), np.repeat(diff, word.shape[1]), minlength=len(w["word"]))
            word_gradient[0] = 0
            grads = {"word": word_gradient, "bias": np.array([diff.sum()]), "start": g0, "moves": pairs - seen}
            step += 1
            for k, grad in grads.items():
                grad = grad / (len(tag) / PIECE) + 1e-6 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                w[k] -= 0.2 * 0.5 ** (epoch / 15) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def marginals(model: dict, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability that each token is toxic."""
    emission = model["bias"][0] + model["word"][_ids(model["vocabulary"], features)].sum(axis=1)
    return forward_backward(emission, first, model["start"], model["moves"])[0]


def aggregate(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each document: the largest marginal and the logarithm of one plus their sum, small ones left out."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    most = np.zeros(len(first) - 1)
    np.maximum.at(most, doc, p)
    total = np.bincount(doc, np.where(p > 0.05, p, 0), minlength=len(first) - 1)
    return np.stack([most, np.log1p(total)], axis=1)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the aggregates, by Newton's method with a small penalty; rows are weighted."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([0.1, 0.1, 1e-3])
        w -= np.linalg.solve(h, x.T @ (weight * (p - y)) + np.array([0.1, 0.1, 1e-3]) * w)
    return w


def _feature_counts(batches):
    """(feature, toxic documents, clean documents) of the sample, added up by batch."""
    for batch in batches:
        y = batch.column(1).to_numpy()
        found, toxic = [], []
        for row, _, data, offsets in text_blocks(batch.column(0)):
            features, _, _, first = tokens(data, offsets)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first) * features.shape[1])
            flat = features.ravel()
            order = np.lexsort((flat, doc))
            h, d = flat[order], doc[order]
            new = h != 0
            new[1:] &= (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            found.append(h[new])
            toxic.append(y[row + d[new]] == 1)
        if not found:
            continue
        h, inverse = np.unique(np.concatenate(found), return_inverse=True)
        t = np.bincount(inverse, np.concatenate(toxic), minlength=len(h)).astype(np.int64)
        n = np.bincount(inverse, minlength=len(h)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ints(h)), pa.array(t), pa.array(n - t)], names=["feature", "toxic", "clean"])


def _hits(candidates):
    """Of each document of the sample: its label and which candidate features it holds."""

    def run(batches):
        for batch in batches:
            out = []
            for _, _, data, offsets in text_blocks(batch.column(0)):
                features, _, _, first = tokens(data, offsets)
                ids = _ids(candidates.value, features)
                out += [np.unique(ids[a:b])[:].astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], names=["y", "ids"])

    return run


def choose(holds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features whose tokens are toxic, from a table documents x candidates, one after the other by evidence.

    A toxic document counts half as much each time that a chosen feature is found in it; so what merely stands beside
    toxic words, in copies of a document for example, is explained by them and isn't chosen."""
    clean = holds[y == 0].sum(axis=0).astype(float)
    toxic, weight = holds[y == 1].astype(float), np.ones(int((y == 1).sum()))
    chosen: list[int] = []
    n_clean = float((y == 0).sum())
    while True:
        total = weight.sum()
        if not total or not n_clean:
            return np.array(sorted(chosen), int)
        k = weight @ toxic
        rate, n = total / (total + n_clean), k + clean
        with np.errstate(divide="ignore", invalid="ignore"):
            evidence = np.where(k > 0, k * np.log(k / (n * rate)), 0) + np.where(clean > 0, clean * np.log(clean / (n * (1 - rate))), 0)
        odds = (k + 0.5) / (total - k + 0.5) / ((clean + 0.5) / (n_clean - clean + 0.5))
        evidence[odds < LEAST_ODDS] = 0
        evidence[chosen] = 0
        best = int(evidence.argmax()) if len(evidence) else -1
        if best < 0 or evidence[best] < LEAST_EVIDENCE:
            return np.array(sorted(chosen), int)
        chosen.append(best)
        weight = weight * np.where(toxic[:, best] > 0, 0.5, 1)


def _tagged(lexicon):
    """Documents of the sample: label, features, tags as bytes, number of tokens."""

    def run(batches):
        for batch in batches:
            y = batch.column(1).to_numpy()
            out: list[list] = [[], [], []]
            for row, _, data, offsets in text_blocks(batch.column(0)):
                features, _, _, first = tokens(data, offsets)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                tags = np.isin(features, lexicon.value).any(axis=1) & (y[row + doc] == 1)
                for a, b in zip(first[:-1], first[1:]):
                    out[0].append(features[a:b].tobytes())
                    out[1].append(tags[a:b].astype(np.uint8).tobytes())
                    out[2].append(b - a)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["y", "words", "tags", "n"])

    return run


def _aggregates(model):
    def run(batches):
        for batch in batches:
            found = [np.zeros((0, 2))]
            for _, _, data, offsets in text_blocks(batch.column(0)):
                features, _, _, first = tokens(data, offsets)
                found.append(aggregate(marginals(model.value, features, first), first))
            x = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["y", "most", "total"])

    return run


def train(spark: SparkSession, docs: DataFrame, sf_dir: str, most: int = SAMPLE) -> dict:
    """Token labels come from document labels: tokens with a feature whose odds are much higher in toxic documents, beyond
    chance, are toxic there."""
    share_out = partial(put, spark)
    rows = stash(sample(spark, docs, sf_dir, "toxic", most, by_label=True), "labelled")
    sides = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sides.get(1, 0), sides.get(0, 0)
    all_sides = {r["y"]: r["n"] for r in labels_of(spark, sf_dir, "toxic").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = arrow_stage(rows, _feature_counts, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic + clean > 1")
    odds = (F.col("toxic") + 0.5) / (n_toxic - F.col("toxic") + 0.5) / ((F.col("clean") + 0.5) / (n_clean - F.col("clean") + 0.5))
    rate, n = n_toxic / max(1, n_toxic + n_clean), F.col("toxic") + F.col("clean")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * max(p, 1e-9)))).otherwise(0.0)
    evidence = part(F.col("toxic"), rate) + part(F.col("clean"), 1 - rate)
    top = pull(counts.withColumns({"odds": odds, "evidence": evidence}).orderBy(F.desc("evidence"), "feature").limit(VOCABULARY))
    vocabulary = np.sort(top.feature.to_numpy(np.int64).view(np.uint64))
    likely = np.sort(top.feature[(top.evidence >= LEAST_EVIDENCE) & (top.odds >= LEAST_ODDS)][:CANDIDATES].to_numpy(np.int64).view(np.uint64))
    held = pull(arrow_stage(rows, _hits(share_out(likely)), "y int, ids binary"))
    holds = np.zeros((len(held), len(likely) + 1), bool)
    for i, ids in enumerate(held.ids):
        holds[i, np.frombuffer(ids, np.int32)] = True
    lexicon = likely[choose(holds[:, 1:], held.y.to_numpy())]
    tagged = stash(arrow_stage(rows, _tagged(share_out(lexicon)), "y int, words binary, tags binary, n long"), "tagged")
    both = []
    for side in (1, 0):  # whole documents of each label by a hash, as many as their tokens allow
        of_side = tagged.where(F.col("y") == side)
        n = of_side.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        spread = F.xxhash64("words", F.lit(17)).bitwiseAND(F.lit((1 << 52) - 1))
        got = pull(of_side.where(spread <= int((1 << 52) * min(1.0, TOKENS / max(1, n)))).select("words", "tags").orderBy("words"))
        both += zip(got.words, got.tags)
    features = np.frombuffer(b"".join(x for x, _ in both), np.uint64).reshape(-1, 1 + len(PREFIXES))
    tags = np.frombuffer(b"".join(t for _, t in both), np.uint8).astype(int)
    model = fit(features, np.concatenate([[0], np.cumsum([len(t) for _, t in both])]).astype(int), tags, vocabulary)
    model["vocabulary"] = vocabulary
    if n_toxic and n_clean:
        x = pull(arrow_stage(rows, _aggregates(share_out(model)), "y int, most double, total double")).sort_values(["y", "most", "total"])
        y = x.y.to_numpy(float)
        # the sample holds more of the rarer label than the labels do
        weight = np.where(y == 1, all_sides[1] / n_toxic, all_sides[0] / n_clean)
        model["document"] = calibrate(x[["most", "total"]].to_numpy(), y, weight / weight.mean())
    else:
        n_toxic, n_clean = all_sides.get(1, 0), all_sides.get(0, 0)
        rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        model["document"] = np.array([0, 0, np.log(rate / (1 - rate))])
    return model


def score(docs: DataFrame, model: dict, spans: bool = False) -> DataFrame:
    """docs: doc_id, text. doc_id, held_out, score, predicted; with `spans` also `spans`, offsets in bytes of the text's
    UTF-8 form (begin, end, probability) of tokens that are toxic rather than not."""
    weights = put(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            found, where = [np.zeros(0)], []
            for _, _, data, offsets in text_blocks(batch.column(0)):
                features, starts, ends, first = tokens(data, offsets)
                p = marginals(weights.value, features, first)
                x = np.column_stack([aggregate(p, first), np.ones(len(first) - 1)])
                found.append(1 / (1 + np.exp(-np.clip(x @ weights.value["document"], -40, 40))))
                if spans:
                    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                    out: list[list] = [[] for _ in range(len(first) - 1)]
                    for k in np.flatnonzero(p > 0.5):
                        out[doc[k]].append({"begin": int(starts[k] - offsets[doc[k]]), "end": int(ends[k] - offsets[doc[k]]), "probability": float(p[k])})
                    where += out
            arrays = [batch.column(1), batch.column(2), pa.array(np.concatenate(found))]
            if spans:
                arrays.append(pa.array(where, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "spans"][: len(arrays)])

    rows = docs.select("text", "doc_id", held_out().alias("held_out"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double" + ", spans array<struct<begin:bigint,end:bigint,probability:double>>" * spans
    return arrow_stage(rows, run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str, spans: bool = False) -> DataFrame:
    """Trains on the labelled documents that aren't held out and scores every row of docs over its whole text.

    A document's tokens are one chain, however long; forward-backward gives each token's marginal, and a logistic
    regression on the largest and the sum gives the document's score. Empty and null text has no tokens and the score of no evidence;
    rows that repeat get the same score; a null doc_id is not held out and never learnt from; without labels of both
    kinds every score is the base rate; an empty table gives none."""
    return score(docs, train(spark, docs, sf_dir), spans)
