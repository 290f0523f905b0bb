"""Scores of learnt models against plain Python that reads their counts or weights one by one."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from matchyard.llm import language, lm, quality

WORD = re.compile("[^\x20\x09-\x0d]+")
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def texts():
    rng = np.random.default_rng(11)
    tongue = {"aa": "abcdeé", "bb": "cdefgh", "cc": "ghijkü"}
    rows = []
    for i in range(120):
        lang = ["aa", "bb", "cc"][i % 3]
        words = ["".join(rng.choice(list(tongue[lang]), int(rng.integers(1, 6)))) for _ in range(int(rng.integers(1, 30)))]
        rows.append((i, " ".join(words).capitalize() + (", 12" if i % 4 else "!"), lang if i % 10 else None))
    return [*rows, (900, "zzz qqq", "aa"), (901, "", None), (902, None, "bb"), (903, "42 !!", None), (904, "a Ab abc", None)]


def test_language_scores(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 10**9)
    rows = texts()
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    apart = re.compile("[\x00-\x40\x5b-\x60\x7b-\x7f]+")
    words = lambda t: [w for w in apart.split((t or "").lower()) if w]

    def grams(w, n):
        marked = list(w) if n == 1 else ["^", *w, "$"]
        return [(*marked[i : i + n],) for i in range(len(marked) - n + 1)]

    counts = {level: defaultdict(Counter) for level in (0, *language.LENGTHS)}
    for i, text, lang in rows:
        if lang is not None and text is not None and not got[i]["held_out"]:
            for w in words(text):
                counts[0][w][lang] += 1
                for n in language.LENGTHS:
                    for g in grams(w, n):
                        counts[n][g][lang] += 1
    langs = ["aa", "bb", "cc"]
    logs = {}
    for level, table in counts.items():
        table = {f: c for f, c in table.items() if sum(c.values()) > 1}
        totals = {x: sum(c[x] for c in table.values()) + language.SMOOTH * (len(table) + 1) for x in langs}
        logs[level] = {f: [math.log((c[x] + language.SMOOTH) / totals[x]) for x in langs] for f, c in table.items()}
    for i, text, _ in rows:
        found = words(text)
        if not found:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        total = np.zeros(3)
        for w in found:
            if w in logs[0]:
                total += logs[0][w]
                continue
            for n in language.LENGTHS:
                known = [logs[n][g] for g in grams(w, n) if g in logs[n]]
                if known:
                    total += np.mean(known, axis=0)
                    break
        total /= math.sqrt(len(found)) * language.TEMPER / 4
        p = np.exp(total - total.max())
        p /= p.sum()
        assert got[i]["score"] == pytest.approx(p.max(), abs=1e-4), (i, text)
        if np.sort(p)[-1] - np.sort(p)[-2] > 1e-3:
            assert got[i]["lang_pred"] == langs[int(p.argmax())]


def test_language_model_scores(spark):
    rows = [(i, t) for i, t, _ in texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = {"clustered": 12, "classes": 4, "head": 20, "least": 4}
    got = {r["doc_id"]: r for r in lm.score(docs, **sizes).collect()}
    model, _ = lm.train(docs, **sizes)
    end = len(model["moves"]) - 2
    train = Counter(w for i, t in rows if not got[i]["held_out"] for w in [*WORD.findall(low(t)), None])
    data = np.frombuffer(" ".join(w for w in train if w).encode(), np.uint8)
    hashes, _ = lm.word_hashes(data, np.array([0, len(data)]))
    key = dict(zip((w for w in train if w), hashes.tolist())) | {None: int(lm.END)}
    at = {int(w): i for i, w in enumerate(model["words"])}
    for i, t in rows:
        tokens, before, score, base = [*WORD.findall(low(t)), None], end, 0.0, 0.0
        for w in tokens:
            c = train.get(w, 0)
            base += math.log10((c + 1) / (sum(train.values()) + len(train) + 1))
            k = at.get(key.get(w))
            cls = int(model["class"][k]) if k is not None else end + 1
            if k is not None:
                emission = float(model["emission"][k])
            elif c:
                emission = math.log10((c - model["discount"]) / (model["other_n"] + 0.5))
            else:
                emission = model["unseen"]
            score += float(model["moves"][before, cls]) + emission
            before = cls
        assert got[i]["score"] == pytest.approx(score, rel=1e-9) and got[i]["n_tokens"] == len(tokens)
    seen = [10 ** model["emission"][at[key[w]]] for w in train if key[w] in at]
    assert all(0 < p <= 1 + 1e-9 for p in seen)
    assert np.allclose((10.0 ** model["moves"]).sum(axis=1), 1)  # transitions are probabilities


def test_attention_scores():
    rng = np.random.default_rng(2)
    sizes = [1, 3, 7, 2]
    at = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.normal(size=(at[-1], quality.FEATURES))
    w = quality.fit(x, at, np.array([0.0, 1.0, 1.0, 0.0]), epochs=2)
    scores = quality._forward(w, x, at)[-1]
    for d in range(len(sizes)):
        encoded, weights = [], []
        for row in x[at[d] : at[d + 1]]:
            h = [math.tanh(sum((row[j] - w["mean"][j]) / w["scale"][j] * w["W"][j, k] for j in range(len(row))) + w["b"][k]) for k in range(w["W"].shape[1])]
            gate = sum(w["a"][g] * math.tanh(sum(h[k] * w["V"][k, g] for k in range(len(h)))) / (1 + math.exp(-sum(h[k] * w["U"][k, g] for k in range(len(h))))) for g in range(w["V"].shape[1]))
            encoded.append(h)
            weights.append(math.exp(gate))
        z = [sum(a * h[k] for a, h in zip(weights, encoded)) / sum(weights) for k in range(len(encoded[0]))]
        assert scores[d] == pytest.approx(1 / (1 + math.exp(-(sum(z[k] * w["c"][k] for k in range(len(z))) + w["d"][0]))), rel=1e-9)


def test_long_documents_are_learnt_from_too():
    assert quality.spread(5).tolist() == [0, 1, 2, 3, 4]
    some = quality.spread(10_000)
    assert len(some) == quality.MOST_PASSAGES and len(set(some)) == len(some) and some[0] == 0 and some[-1] >= 9_900
