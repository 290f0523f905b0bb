"""The driver's tables as records of this engine. Arithmetic only, so SQL can state the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of an element record, each an expression over lineitem.
ELEMENT = {
    "id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint), cast(round(l_extendedprice * 100) as bigint), cast(round(l_discount * 100) as bigint), cast(round(l_tax * 100) as bigint), date_format(l_shipdate, 'yyyyMMdd'))",
    "source": "case when l_linenumber % 2 = 1 then 'plan' else 'shop' end",
    "type": "l_returnflag",
    "level": "concat('N', cast(year(l_shipdate) % 4 as string))",
    "row": "char(cast(65 + l_suppkey % 12 as int))",
    "col": "cast(l_partkey as double) + case when l_linenumber % 5 = 0 then 0.4D else 0.0D end",
    "file": "cast(l_suppkey % 5 as int)",
    "page": "cast(l_orderkey % 7 as int)",
    "count": "cast(case when l_orderkey % 23 = 0 then 6 else 4 end as int)",
    "size": "case when l_partkey % 17 = 0 then '35M' else '25M' end",
    "tie_size": "case when l_suppkey % 19 = 0 then '15M' else '10M' end",
    "spacing_mm": "case when l_linenumber = 7 then null when l_partkey % 13 = 0 then 304.8D else 152.4D end",
    "tie_count": "cast(case when l_linenumber % 2 = 1 then null else 20 + l_orderkey % 5 end as int)",
    "overall": "round(1 - l_tax * 5, 3)",
}

#: The same in DuckDB's SQL, as a common table expression for the oracles.
ELEMENTS_SQL = """
elements AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
                   CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS id,
         CASE WHEN l_linenumber % 2 = 1 THEN 'plan' ELSE 'shop' END AS source,
         l_returnflag AS type, 'N' || CAST(year(l_shipdate) % 4 AS VARCHAR) AS level,
         chr(CAST(65 + l_suppkey % 12 AS INTEGER)) AS "row",
         CAST(l_partkey AS DOUBLE) + CASE WHEN l_linenumber % 5 = 0 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS col,
         CAST(l_suppkey % 5 AS INTEGER) AS file, CAST(l_orderkey % 7 AS INTEGER) AS page,
         CAST(CASE WHEN l_orderkey % 23 = 0 THEN 6 ELSE 4 END AS INTEGER) AS "count",
         CASE WHEN l_partkey % 17 = 0 THEN '35M' ELSE '25M' END AS size,
         CASE WHEN l_suppkey % 19 = 0 THEN '15M' ELSE '10M' END AS tie_size,
         CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 13 = 0 THEN 304.8::DOUBLE ELSE 152.4::DOUBLE END AS spacing_mm,
         CAST(CASE WHEN l_linenumber % 2 = 1 THEN NULL ELSE 20 + l_orderkey % 5 END AS INTEGER) AS tie_count,
         round(1 - l_tax * 5, 3) AS overall
  FROM lineitem)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*(F.expr(e).alias(k) for k, e in ELEMENT.items()))


LEVELS_SQL = """
levels AS (
  SELECT 'N' || CAST(year(o_orderdate) % 4 AS VARCHAR) AS level,
         CAST((year(o_orderdate) % 4) * 3500 + count(*) % 100 AS DOUBLE) AS elevation_mm
  FROM orders GROUP BY year(o_orderdate) % 4)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate") % 4
    rows = table(spark, sf_dir, "orders").groupBy(year.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.concat(F.lit("N"), F.col("y").cast("string")).alias("level"), (F.col("y") * 3500 + F.col("n") % 100).cast("double").alias("elevation_mm"))


BARS_SQL = """
bars AS (
  SELECT l_orderkey AS element, CASE WHEN l_linenumber % 2 = 1 THEN 'plan' ELSE 'shop' END AS source,
         CASE l_partkey % 3 WHEN 0 THEN '15M' WHEN 1 THEN '20M' ELSE NULL END AS size,
         CAST(CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 1 + l_quantity % 3 END AS INTEGER) AS "count",
         CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 100.0 + 0.75 * (l_suppkey % 3) END AS spacing_mm
  FROM lineitem)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bar statements of elements: one element per order, plan lines odd and shop lines even."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as element",
        "case when l_linenumber % 2 = 1 then 'plan' else 'shop' end as source",
        "case l_partkey % 3 when 0 then '15M' when 1 then '20M' else null end as size",
        "cast(case when l_partkey % 11 = 0 then null else 1 + l_quantity % 3 end as int) as count",
        "case when l_suppkey % 4 = 0 then null else 100.0D + 0.75D * (l_suppkey % 3) end as spacing_mm",
    )


NOTES_SQL = """
notes AS (
  SELECT l_orderkey * 8 + l_linenumber AS note, l_partkey, l_suppkey, l_orderkey, l_linenumber,
         CAST(l_quantity AS BIGINT) AS q,
         CASE l_suppkey % 4 WHEN 0 THEN '15M' WHEN 1 THEN '20m' WHEN 2 THEN '25M' ELSE '45M' END AS s
  FROM lineitem)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that the text queries print and read back."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber as note", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "cast(l_quantity as bigint) as q",
        "case l_suppkey % 4 when 0 then '15M' when 1 then '20m' when 2 then '25M' else '45M' end as s",
    )


WORDS_SQL = """
lines AS (
  SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
tokens AS (
  SELECT page, line_no, line, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS k FROM lines),
words AS (
  SELECT page, line_no, k, text, x0, x0 + length(text) * 5.0 AS x1, line_no * 12.0 AS y0, line_no * 12.0 + 8.0 + (length(text) % 3) AS y1 FROM (
    SELECT page, line_no, k, text,
           5.0 * COALESCE(SUM(length(text) + 1 + CASE WHEN k % 9 = 8 THEN 4 ELSE 0 END) OVER (PARTITION BY page, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0
    FROM tokens) WHERE text <> '')"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned words of documents: a line is 12 high, a character 5 wide, and after every ninth word there is a gap."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.select("page", "line_no", F.posexplode(F.split("line", " ")).alias("k", "text"))
    before = Window.partitionBy("page", "line_no").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    step = F.length("text") + 1 + F.when(F.col("k") % 9 == 8, 4).otherwise(0)
    rows = rows.withColumn("x0", 5.0 * F.coalesce(F.sum(step).over(before), F.lit(0))).where("text <> ''")
    y = F.col("line_no") * 12.0
    return rows.select("page", "line_no", "k", "text", "x0", (F.col("x0") + F.length("text") * 5.0).alias("x1"), y.alias("y0"), (y + 8.0 + F.length("text") % 3).alias("y1"))
