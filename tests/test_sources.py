import json
import uuid

import pytest
from pyspark.sql import functions as F

from matchyard import config
from matchyard.functions.freeform import read_line
from matchyard.functions.ids import DIGITS, NAMESPACE, global_id
from matchyard.operators import bars, matching
from matchyard.sources import bundle, files, pages


def test_global_ids_follow_the_standard(spark):
    keys = ["colonne|N2|K|4", "", "é|1"]

    def plain(key):
        b = uuid.uuid5(uuid.UUID(NAMESPACE), key).bytes
        digits = lambda v, n: "".join(DIGITS[v // 64**k % 64] for k in range(n - 1, -1, -1))
        return digits(b[0], 2) + "".join(digits(int.from_bytes(b[i : i + 3]), 4) for i in range(1, 16, 3))

    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", global_id(F.col("k")).alias("g")).collect()
    assert {r["k"]: r["g"] for r in got} == {k: plain(k) for k in keys}


def test_discovery(spark, tmp_path):
    for name in ("s1.pdf", "S2.PDF", "notes.txt", "DA/Colonnes/a.pdf", "DA/x/beam list.pdf", "other/b.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = files.listing(spark, str(tmp_path))
    strict = {r["name"]: (r["source"], r["type"]) for r in files.by_shop_folder(found).collect()}
    assert strict == {"s1.pdf": ("plan", None), "S2.PDF": ("plan", None), "DA/Colonnes/a.pdf": ("shop", "colonne"), "DA/x/beam list.pdf": ("shop", "poutre")}
    loose = {r["name"]: r["source"] for r in files.by_any_shop_folder(found).collect()}
    assert loose["other/b.pdf"] == "plan" and loose["DA/Colonnes/a.pdf"] == "shop" and len(loose) == 5


def element(id, source="plan", row="K"):
    return {"id": id, "source": source, "fichier": "a.pdf", "page": 1, "x": 1.0, "y": 2.0, "type_element": "colonne", "element": "C1", "level": "N2", "grid": f"{row}-4",
            "armature": [{"diametre": "25M", "quantite": 4}, {"diametre": "10M", "espacement_mm": 152.4}], "match_key": {"type": "colonne", "level": "N2", "row": row, "col": 4.0}, "quality": {"overall": 0.9}}


def test_bundle_round_trip(spark, tmp_path):
    rows = spark.read.schema(bundle.EXTENDED).json(spark.sparkContext.parallelize([json.dumps(element("b", "shop")), json.dumps(element("a"))]))
    empty = {n: spark.createDataFrame([], bundle.TABLES[n]) for n in ("levels", "sheets")}
    bundle.write(bundle.Bundle("P", {"elements": rows, **empty}), tmp_path)
    first = (tmp_path / "elements.ext.json").read_bytes()
    again = bundle.read(spark, str(tmp_path))
    bundle.write(again, tmp_path)
    assert (tmp_path / "elements.ext.json").read_bytes() == first
    assert [r["id"] for r in bundle.read_strict(spark, str(tmp_path)).collect()] == ["a", "b"]
    flat = bundle.flat(again.tables["elements"])
    assert matching.key_match(flat).count() == 1 and flat.where("count = 4 and spacing_mm = 152.4").count() == 2
    (tmp_path / "manifest.json").write_text('{"contract_version": "0.0.9", "project": "P"}')
    with pytest.raises(ValueError, match="version"):
        bundle.read(spark, str(tmp_path))
    with pytest.raises(ValueError, match="twice"):
        bundle.write(bundle.Bundle("P", {"elements": rows.union(rows), **empty}), tmp_path)


def test_unknown_settings_are_an_error(tmp_path):
    (tmp_path / "c.json").write_text('{"near_column_limit": 0.4, "folder_types": [["post", "colonne"]]}')
    assert config.load(tmp_path / "c.json").folder_types == (("post", "colonne"),)
    (tmp_path / "c.json").write_text('{"nearcolumn": 1}')
    with pytest.raises(ValueError, match="nearcolumn"):
        config.load(tmp_path / "c.json")


def test_word_source(spark, tmp_path, monkeypatch):
    pages.register(spark)
    with pytest.raises(Exception, match="parser"):
        spark.read.format("positioned_words").load("x").collect()


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("ARM: 8-25M", [{"role_hint": "main", "count": 8, "size": "25M"}]),
        ('LIG. 10M@6" c/c', [{"role_hint": "ties", "size": "10M", "spacing_mm": 152.4}]),
        ("12(6)-20M", [{"role_hint": None, "count": 12, "secondary_count": 6, "size": "20M"}]),
        ("3x4 25M B7-01", [{"role_hint": None, "groups": 3, "count": 4, "size": "25M", "mark": "B7-01"}]),
        ("3 + 12 15M", [{"role_hint": None, "count": 15, "size": "15M"}]),
        ("620 20M", [{"role_hint": None, "suspect": 620, "size": "20M"}]),
        ("3 15UJ2-05", [{"role_hint": None, "count": 3, "size": "15M", "mark": "15UJ2-05"}]),
        ("20Z3150", [{"role_hint": None, "size": "20M", "mark": "20Z3150"}]),
        ("4 10M T4 @ 300", [{"role_hint": None, "count": 4, "size": "10M", "mark": "T4", "spacing_mm": 300.0}]),
        ("nothing here", []),
        (None, []),
    ],
)
def test_lines(line, expected):
    assert read_line(line)["bars"] == expected


def test_line_measures():
    got = read_line('COL 18"x24" 35 MPa 1200 mm long')
    assert (got["section"], got["strength"], got["length_mm"]) == ([457.2, 609.6], 35, 1200.0)
    assert read_line("3x4")["section"] is None


def test_bar_comparison(spark):
    kind = "array<struct<role_hint:string,count:int,secondary_count:int,groups:int,size:string,spacing_mm:double>>"
    bar = lambda role=None, count=None, second=None, groups=None, size=None, spacing=None: (role, count, second, groups, size, spacing)
    notes = [
        (1, [bar("main", 8, size="25M"), bar("ties", size="10M", spacing=150.0)], [bar("ties", size="10M", spacing=152.4), bar("main", 6, size="25M")]),
        (2, [bar(count=8, size="25M")], [bar(count=6, size="20M")]),
        (3, [bar(count=8, size="25M")], [bar(count=6, size="25M")]),
        (4, [bar("dowel", 8)], [bar("ties", 8)]),
        (5, None, [bar(count=8, second=2, groups=3, size="25M")]),
        (6, [bar(count=8, second=4, size="25M")], [bar(count=6, second=4, size="25M")]),
    ]
    got = {r["id"]: r for r in bars.compare_notes(spark.createDataFrame(notes, f"id int, plan_bars {kind}, shop_bars {kind}")).collect()}
    said = {k: [tuple(x) for x in r["records"]] for k, r in got.items()}
    assert ("counted bars count", "8", "6", "different") in said[1] and ("spaced bars spacing_mm", "150.0", "152.4", "equal") in said[1]
    assert said[2] == [("counted bars", "8 25M", "6 20M", "not_comparable")]
    assert [r[3] for r in said[3]] == ["possible_difference", "equal"] and [r[3] for r in said[4]] == ["plan_only", "shop_only"]
    assert said[5] == [("bars", None, "3 x 8 (2) 25M", "shop_only")] and ("counted bars count", "8", "6", "different") in said[6]
    assert {k: r["status"] for k, r in got.items()} == {1: "differs", 2: "uncertain", 3: "uncertain", 4: "uncertain", 5: "uncertain", 6: "differs"}
