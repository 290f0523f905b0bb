"""Bundles: a project's records and side tables as JSON files in a folder, with a version."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchyard.functions.ids import global_id
from matchyard.operators.checks import key_of

VERSION = "0.1.0"
ARMATURE = "array<struct<repere:string,diametre:string,quantite:int,espacement_mm:double,longueur_mm:double>>"
STRICT = f"id string, source string, fichier string, feuillet string, page int, x double, y double, type_element string, element string, armature {ARMATURE}"
MATCH_KEY = "struct<type:string,level:string,row:string,col:double,span_from:double,span_to:double>"
QUALITY = "struct<overall:double,type_conf:double,level_conf:double,consistency_passed:array<string>,consistency_failed:array<string>,flags:array<string>>"
EXTENDED = f"{STRICT}, match_key {MATCH_KEY}, grid string, level string, section_mm array<double>, bbox array<double>, quality {QUALITY}, extraction_method string, raw_text string, provenance map<string,string>"
TABLES = {
    "elements.ext": EXTENDED,
    "levels": "level string, name string, elevation_mm double",
    "sheets": "fichier string, page int, feuillet string, kind string, type_element string, level string, layer string, width double, height double, rotation int, revision string, layout string",
    "ids": "element_id string, match_key string, global_id string",
}


@dataclass
class Bundle:
    project: str
    tables: dict[str, DataFrame]

    def __getattr__(self, name: str) -> DataFrame:
        found = self.__dict__.get("tables", {})
        if name in found:
            return found[name]
        raise AttributeError(name)


def read_strict(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(STRICT).option("multiLine", "true").json(f"{folder}/elements.json")


def read(spark: SparkSession, folder: str) -> Bundle:
    """Tables are read lazily by schema; a bundle of another version is an error."""
    manifest = spark.read.option("multiLine", "true").schema("contract_version string, project string").json(f"{folder}/manifest.json").first()
    if manifest is None or manifest["contract_version"] != VERSION:
        raise ValueError(f"{folder} has version {manifest and manifest['contract_version']}, {VERSION} is read here")
    tables = {name.split(".")[0]: spark.read.schema(schema).option("multiLine", "true").json(f"{folder}/{name}.json") for name, schema in TABLES.items()}
    return Bundle(manifest["project"], tables)


def flat(elements: DataFrame) -> DataFrame:
    """Bundle records as the flat records that the operators take: the first two bar groups are the profile."""
    bar = lambda i, f: F.get("armature", F.lit(i))[f]
    k = F.col("match_key")
    return elements.select("id", "source", k["type"].alias("type"), "level", k["row"].alias("row"), k["col"].alias("col"), F.col("fichier").alias("file"), "page", bar(0, "quantite").alias("count"), bar(0, "diametre").alias("size"), bar(1, "diametre").alias("tie_size"), bar(1, "espacement_mm").alias("spacing_mm"), bar(1, "quantite").alias("tie_count"), F.col("quality.overall").alias("overall"))


def stable_json(value: object) -> str:
    """Sorted keys, two spaces, a final line feed: the same value gives the same text."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def write(bundle: Bundle, folder: str | Path) -> None:
    """Writes a bundle of one project for other tools. Records are sorted; an id that comes twice is an error.

    A bundle is one small file per table by its format, so its rows come to the driver; larger results stay in Parquet."""
    records = bundle.tables["elements"]
    twice = records.groupBy("id").count().where("count > 1").orderBy("id").limit(3).collect()
    if twice:
        raise ValueError(f"ids that come twice, such as {[r['id'] for r in twice]}")
    ordered = records.orderBy("source", "fichier", "page", "id")
    keyed = ordered.withColumn("_key", key_of("match_key.type", "match_key.level", "match_key.row", "match_key.col"))
    out = {
        "elements.ext": ordered, "elements": ordered.select(*(f.split()[0] for f in STRICT.split(", ") if f.split()[0] in records.columns)),
        "ids": keyed.select(F.col("id").alias("element_id"), F.col("_key").alias("match_key"), global_id(F.col("_key")).alias("global_id")),
        "levels": bundle.tables["levels"], "sheets": bundle.tables["sheets"].orderBy("fichier", "page"),
    }
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    for name, rows in out.items():
        _replace(folder / f"{name}.json", stable_json([json.loads(j) for j in rows.toJSON().collect()]))
    counts = records.agg(F.count(F.lit(1)).alias("elements"), F.count_if(F.col("source") == "plan").alias("plan"), F.count_if(F.col("source") == "shop").alias("shop")).first().asDict()
    _replace(folder / "manifest.json", stable_json({"contract_version": VERSION, "project": bundle.project, "counts": counts}))


def _replace(path: Path, text: str) -> None:
    """A reader sees the old file or the new one, never half of it."""
    new = path.with_suffix(".new")
    new.write_text(text, encoding="utf-8", newline="\n")
    new.replace(path)
