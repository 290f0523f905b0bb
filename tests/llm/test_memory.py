"""What a task holds at once doesn't grow with what it reads."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from matchyard.llm import suffixes


class Held:
    def __init__(self, value):
        self.value = value


@pytest.fixture(scope="module")
def bucket():
    """Runs of 4,000 pairs of texts that differ in the middle, in order and in batches as large as Spark's."""
    rng = np.random.default_rng(5)
    first = [rng.integers(97, 123, 1500, np.uint8).tobytes().decode() for _ in range(4000)]
    texts = [t for x in first for t in (x, x[:700] + "#" + x[701:])]
    ids = pa.array(np.arange(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["k1", "k2", "text"])
    run = suffixes._runs(None, Held(np.full(1 << 15, 255, np.uint8)), 18, Held((np.zeros(0, np.uint64), np.zeros(0, np.int64))), Held(np.zeros(0, f"S{suffixes.GRAM}")))
    # one text a call, as only repeats of other calls are left to the sort
    rows = pa.Table.from_batches([r for i in range(len(texts)) for r in run([batch.slice(i, 1)])])
    return rows.sort_by([("lead", "ascending"), ("context", "ascending")]).combine_chunks().to_batches(max_chunksize=10_000)


def test_a_bucket_is_sorted_in_small_pieces(bucket):
    assert sum(b.nbytes for b in bucket) > 20e6
    tracemalloc.start()
    try:
        found = list(suffixes._sort_buckets(iter(bucket)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30e6
    covered = np.zeros((8000, 1500), bool)
    for b in found:
        for k, x, y, edge in zip(*(b.column(c).to_pylist() for c in ("k1", "a", "b", "edge"))):
            if edge is None:
                covered[k, x:y] = True
    expected = np.ones(1500, bool)
    expected[700] = False
    assert (covered == expected).all()


def test_counts_of_many_keys_are_summed_in_little_memory():
    from matchyard.llm import phrases

    rng = np.random.default_rng(9)
    parts = [rng.integers(0, 1 << 40, 200_000, np.uint64) << np.uint64(24) for _ in range(14)]
    tally = phrases.Tally()
    for part in parts:
        assert not list(tally.add(part))  # 2.8 million keys are held
    tracemalloc.start()
    try:
        keys, counts = tally.total()
        rows, largest = 0, 0
        for batch in phrases._counted(keys, counts, 6):
            rows, largest = rows + sum(len(x) // 8 for x in batch.column(1).to_pylist()), max(largest, batch.nbytes)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert counts.sum() == 2_800_000 and rows == len(keys) and (keys[1:] > keys[:-1]).all()
    assert largest < 5e6 and peak < 120e6


def test_filters_are_freed(spark):
    from matchyard.llm import base, phrases

    before = len(base.shared(spark))
    docs = spark.createDataFrame([("to be or not to be, to be or not",)] * 30, "text string").selectExpr("text", "'en' as lang")
    assert phrases.collocations(docs, least=10).count()
    assert len(base.shared(spark)) == before
