"""Project folders: which files there are, on which side they are, and what type their folder says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchyard.config import Config

SHOP_FOLDER = "DA"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, relative path and length of every PDF below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    root = folder.rstrip("/").removeprefix("file://") + "/"
    return files.select("path", F.substring_index("path", root, -1).alias("name"), "length")


def folder_type(name: Column, config: Config = Config()) -> Column:
    """Type of a path below the shop folder: of the first folder that names one, else of the file's stem."""

    def of(part: Column) -> Column:
        out = F.lit(None).cast("string")
        for word, kind in reversed(config.folder_types):
            out = F.when(F.contains(F.lower(part), F.lit(word)), kind).otherwise(out)
        return out

    parts = F.split(name, "/")
    folders = F.filter(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), of), lambda x: x.isNotNull())
    return F.coalesce(F.get(folders, F.lit(0)), of(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")))


def by_shop_folder(files: DataFrame, config: Config = Config()) -> DataFrame:
    """Plans lie in the project folder itself, shop files anywhere below its shop folder; others take no part."""
    inside = F.col("name").startswith(SHOP_FOLDER + "/")
    plan = ~F.contains("name", F.lit("/"))
    out = files.where(inside | plan).withColumn("source", F.when(inside, "shop").otherwise("plan"))
    return out.withColumn("type", F.when(inside, folder_type(F.substring(F.col("name"), len(SHOP_FOLDER) + 2, 10_000), config)))


def by_any_shop_folder(files: DataFrame) -> DataFrame:
    """A file below any folder of the shop folder's name is a shop file, every other a plan."""
    folders = F.slice(F.split("name", "/"), 1, F.greatest(F.size(F.split("name", "/")) - 1, F.lit(0)))
    return files.withColumn("source", F.when(F.exists(folders, lambda x: F.upper(x) == SHOP_FOLDER), "shop").otherwise("plan"))
