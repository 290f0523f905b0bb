"""The pipeline's stages, each judged on its own input."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__
from matchyard.llm import jaccard, mixing, packing, quality
from matchyard.llm.base import documents

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = documents(spark, SF)
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, tables[-1], SF)
        out.write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
        assert i == 4 or tables[-1].columns == docs.columns
    ids = [Counter(r["doc_id"] for r in t.select("doc_id").collect()) for t in tables]
    good = quality.classify(spark, docs, SF).where("predicted = 1").collect()
    assert ids[1] == Counter(r["doc_id"] for r in good)
    groups = jaccard.near_duplicates(tables[1]).collect()
    assert ids[2] == Counter(r["doc_id"] for r in groups if r["doc_id"] == r["component_id"])
    assert ids[3] == ids[2] and tables[3].where("length(text) <> n_chars").count() == 0
    taken = Counter({r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(tables[3]).where("size > 0").collect()})
    assert ids[4] == +taken
    assert tables[5].agg({"length": "sum"}).first()[0] == packing.pack(tables[4]).agg({"length": "sum"}).first()[0]
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == tables[5].columns and run.count() == tables[5].count()


def test_entry_registers_every_operator():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_rows_that_repeat_and_nulls(spark, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, f"text {i} " * (1 + i), None, None, None) for i in range(40)] + [(3, "text 3 " * 4, None, None, None), (None, "no id", None, None, None), (50, None, "en", "s", 0), (51, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    rows = docs.collect()
    assert rows and all(len(r["ids"]) == 4 * r["length"] for r in rows)


def test_empty_tables_and_extra_columns(spark, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ("row", "key", "n", "size", "at", "score", "token", "before", "k1", "kept", "predicted", "n_bytes", "_rows")
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(i, f"text {i} " * (1 + i), "en", "s", 0) for i in range(40)] + [(60, long, "en", "t", 0), (61, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        ids = Counter(r["doc_id"] for r in got.collect())
        assert set(ids) <= {r[0] for r in rows} and (name != "suffix_dedup" or ids == Counter(r[0] for r in rows))
        assert got.where("row <> 0 or k1 <> 8").count() == 0


def test_a_stage_leaves_other_results_alone(spark):
    """A result that was made before and not read yet outlives a stage, and a second run the first one's result."""
    docs = spark.createDataFrame([(i, f"some words {i} and more of them {i % 7}", "en", f"s{i % 3}", 30) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    from matchyard.llm import language

    earlier = language.identify(docs)
    packed = [corpus_pipeline.packing_stage(spark, docs, "") for _ in range(2)]
    corpus_pipeline.suffix_stage(spark, docs, "").collect()
    corpus_pipeline.mixing_stage(spark, docs, "").collect()
    assert earlier.count() == 60 and [p.count() for p in packed] == [60, 60]
