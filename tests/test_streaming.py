"""Files that arrive page by page, over micro-batches and a restart."""

import pyspark.sql.functions as F

from matchyard.streaming import project

SCHEMA = "file string, source string, page int, expected int"
EXPECTED = [("p1", "plan"), ("s1", "shop"), ("s2", "shop"), ("s3", "shop")]


def test_partial_results_and_a_restart(spark, tmp_path):
    source, root, at = tmp_path / "pages", f"file://{tmp_path}/out", [1000.0]
    source.mkdir()

    def arrive(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{source}")

    def run():
        refresh = project.Refresh(spark.createDataFrame(EXPECTED, "file string, source string"), lambda files: files.groupBy("source").agg(F.sum("pages").alias("pages")), root, 60, lambda: at[0])
        refresh.start(spark.readStream.schema(SCHEMA).parquet(f"file://{source}"), f"file://{tmp_path}/check").awaitTermination()  # a new process each time
        last = refresh.last(spark)
        rows = {r["source"]: r["pages"] for r in spark.read.parquet(last["rows"]).collect()} if last["rows"] else None
        return last["kind"], last["files"], rows

    arrive(("s1", "shop", 1, 1), ("p1", "plan", 1, 2), ("p1", "plan", 1, 2))
    assert run() == (None, 0, None)  # a plan isn't complete; its page came twice
    arrive(("p1", "plan", 2, 2), ("s2", "shop", 1, 3))
    assert run() == ("partial", 2, {"plan": 2, "shop": 1})
    arrive(("s2", "shop", 2, 3), ("s2", "shop", 3, 3))
    at[0] += 30
    assert run() == ("partial", 2, {"plan": 2, "shop": 1})  # too early for another
    at[0] += 40
    arrive(("s1", "shop", 1, 1))
    assert run() == ("partial", 3, {"plan": 2, "shop": 4})  # due now, though nothing else came
    at[0] += 1
    arrive(("s3", "shop", 1, 1))
    assert run() == ("final", 4, {"plan": 2, "shop": 5})  # the last one doesn't wait
    arrive(("s3", "shop", 1, 1), ("s3", "shop", 2, 1))
    assert run()[:2] == ("final", 4)
