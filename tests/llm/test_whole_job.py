"""Operators over all of their input: what a bound once left out."""

import numpy as np
import pytest

import corpus_pipeline
from matchyard.llm import base, jaccard, language, lm


def test_words_beyond_the_first_are_clustered(spark):
    rng = np.random.default_rng(3)
    word = lambda g: f"{'abc'[g]}{int(rng.integers(20))}"  # noqa: E731  of 60 words; one of group g comes before one of g + 1
    docs = spark.createDataFrame([(i, " ".join(word((i + k) % 3) for k in range(200))) for i in range(90)], "doc_id long, text string").repartition(3)
    model, _ = lm.train(docs, clustered=12, classes=3)
    assert len(model["words"]) == 61
    words = lm.word_hashes(np.frombuffer("".join(f"{g}{i} " for g in "abc" for i in range(20)).encode(), np.uint8), np.array([0, sum(len(f"{g}{i} ") for g in "abc" for i in range(20))]))[0]
    of = model["class"][lm._find(model["words"], words)[0]].reshape(3, 20)
    other = len(model["moves"]) - 1
    assert not (of == other).any()
    assert not {int(x) for x in of[0]} & {int(x) for x in of[1]} and not {int(x) for x in of[1]} & {int(x) for x in of[2]}


@pytest.mark.parametrize("w", [0, 7, 20])
def test_gains_are_differences_of_the_criterion(w):
    rng = np.random.default_rng(4)
    counts, of, classes = rng.poisson(3, (23, 23)).astype(float), np.append(rng.integers(0, 4, 20), [5, 4, 5]), 4
    of[20] = 5  # a word without a class yet

    def table_of(of):
        table = np.zeros((6, 6))
        np.add.at(table, (of[:, None], of[None, :]), counts)
        return table

    def criterion(t):
        return lm._f(t).sum() - lm._f(t.sum(axis=0)).sum() - lm._f(t.sum(axis=1)).sum()

    def with_class(b):
        new = of.copy()
        new[w] = b
        return criterion(table_of(new))

    r, c = np.bincount(of, counts[w], minlength=6), np.bincount(of, counts[:, w], minlength=6)
    slots, n = np.arange(13), np.concatenate([r, c, [counts[w, w]]])
    gain = lm._gains(table_of(of), int(of[w]), slots[n > 0], n[n > 0], classes)
    assert np.allclose(gain - gain[0], [with_class(b) - with_class(0) for b in range(classes)])


def test_small_languages_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 20)
    rng = np.random.default_rng(5)
    of = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(30))
    rows = [(i, of("abcdefgh"), "large") for i in range(2000)] + [(5000 + i, of("abcdefgz"), "small") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs).where("doc_id >= 5000 and held_out").collect()
    assert len(got) > 5 and {r["lang_pred"] for r in got} == {"small"}


def test_no_language_is_left_out(spark):
    docs = spark.createDataFrame([(8 * k + i, f"{chr(97 + k // 26)}{chr(97 + k % 26)}q", f"l{k:03d}") for k in range(210) for i in range(8)], "doc_id long, text string, lang string")
    got = language.identify(docs).collect()
    wrong = [(r["doc_id"], r["lang_pred"], r["score"]) for r in got if r["lang_pred"] != f"l{r['doc_id'] // 8:03d}"]
    assert not wrong


def test_the_other_text_of_an_id_stays(spark):
    copied = " ".join(f"word{i}" for i in range(80))
    clean = " ".join(f"other{i}" for i in range(80))
    rows = [(1, copied), (2, copied), (2, clean), (3, clean + " end"), (4, "alone"), (4, "alone"), (None, copied)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in got) == sorted([(0, copied), (1, copied), (2, clean), (4, "alone")])


def test_the_pipeline_writes_token_ids(spark):
    docs = spark.createDataFrame([(i, f"some text {i} " * (1 + i)) for i in range(20)], "doc_id long, text string")
    got = corpus_pipeline.packing_stage(spark, docs, "").collect()
    assert got and all(len(r["ids"]) == 4 * r["length"] for r in got)


def test_the_join_frees_what_it_broadcast(spark):
    before = len(base.shared(spark))
    rows = [(i, " ".join(f"w{i % 7}x{k}" for k in range(30 + i % 2))) for i in range(40)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i % 7 for i, _ in rows}
    assert len(base.shared(spark)) == before
