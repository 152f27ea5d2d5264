"""Every query with an oracle against DuckDB on the smallest tables."""

import math
import os
import re
from decimal import Decimal

import duckdb
import pytest

from strandline.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables aren't here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def number(value):
    return isinstance(value, (float, Decimal)) and math.isfinite(value)


def cell(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    return repr(float(value)) if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool) else str(value)


def same(a, b):
    """Rows are the same if their numbers are, to the last place that rounding leaves."""
    return all(math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-5) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b))


def grouped(columns, rows):
    """Rows by all that isn't a fraction; the fractions of such a group sorted."""
    order, groups = sorted(range(len(columns)), key=lambda i: columns[i]), {}
    for r in rows:
        cells = [(i, float(r[i]) if number(r[i]) and float(r[i]) != int(r[i]) else cell(r[i])) for i in order]
        groups.setdefault(tuple("fraction" if isinstance(c, float) else c for _, c in cells), []).append([c for _, c in cells if isinstance(c, float)])
    return groups


def differences(columns, got, wanted):
    """Rows without a partner on the other side, whole numbers that only rounding made so included."""
    got, wanted = grouped(columns, got), grouped(columns, wanted)
    rest, missing = [], []
    for key in got.keys() | wanted.keys():
        a, b = sorted(got.get(key, [])), sorted(wanted.get(key, []))
        if len(a) != len(b) or not all(map(same, a, b)):
            rest += [_filled(key, x) for x in a]
            missing += [_filled(key, x) for x in b]
    for row in list(rest):
        partner = next((m for m in missing if same(row, m)), None)
        if partner is not None:
            rest.remove(row)
            missing.remove(partner)
    return rest, missing


def _filled(key, fractions):
    some = iter(fractions)
    cells = [next(some) if c == "fraction" else c for c in key]
    return tuple(float(c) if isinstance(c, str) and re.fullmatch(r"-?\d+(\.\d+)?(e-?\d+)?", c) else c for c in cells)


#: Queries that find nothing in the smallest tables.
EMPTY = {"lane_bands", "lane_offset"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_oracle(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    want = oracle.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got, expected = [tuple(r[c] for c in columns) for r in df.collect()], want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert len(got) == len(expected) and (got or name in EMPTY)
    assert differences(columns, got, expected) == ([], [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_oracle_has_rows(spark, name):
    assert not QUERIES[name](spark, SF).isEmpty()
