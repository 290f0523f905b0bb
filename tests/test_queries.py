"""Every registered query of the engine against its SQL, at the smallest scale."""

from decimal import Decimal

import duckdb
import pyarrow as pa
import pytest

from matchyard.plans import catalogue, drawings, findings  # noqa: F401  they register their queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def family(t):
    if pa.types.is_integer(t) or (pa.types.is_decimal(t) and t.scale == 0):
        return "integer"
    if pa.types.is_floating(t) or pa.types.is_decimal(t):
        return "number"
    return "text" if pa.types.is_string(t) or pa.types.is_large_string(t) else str(t).split("[")[0].split("<")[0]


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if v != v else round(float(v), 9)
    if isinstance(v, list):
        return [plain(x) for x in v]
    return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v


def rows(table, columns):
    """Values as they are typed: a null is a null and 1 isn't 1.0."""
    whole = [family(table.schema.field(c).type) == "integer" for c in columns]
    return sorted((tuple(int(r[c]) if w and r[c] is not None else plain(r[c]) for c, w in zip(columns, whole)) for r in table.select(columns).to_pylist()), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    found = catalogue.QUERIES[name](spark, DATA).toArrow()
    assert len(found)
    if name in catalogue.ORACLE_SQL:
        expected = sql.execute(catalogue.ORACLE_SQL[name]).to_arrow_table()
        columns = sorted(expected.schema.names)
        assert sorted(found.schema.names) == columns
        assert [family(found.schema.field(c).type) for c in columns] == [family(expected.schema.field(c).type) for c in columns]
        assert rows(found, columns) == rows(expected, columns)
